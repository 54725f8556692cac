"""Quality rules that look at lines first: failing lines go, then documents that lost too much of their text.

Everything is column expressions; nothing leaves the JVM and nothing is shuffled.

A line fails as **punctuation** if it is stray, if over a tenth of its characters are symbols,
or if doubled marks (`!!`, `??`) stand after more than one word in four; as **navigation** if it
has two or more separators (`|`, `»`, `›`, `•`, or `>` and `/` between blanks) and as many of them as one per four words, if it is one of three
menu items or more in succession, or a whole menu in one line; as
**boilerplate** if it has at most `BOILERPLATE_WORDS` words, holds one of a few set phrases as whole words, and
shows a second sign: another phrase, a copyright notice, or that the phrases are over half of its words; or if it has no sentence mark, is short and
begins with one of a few set beginnings.
Lines without a word are layout: never counted, kept as they are.

A menu item has no sentence mark, at most `ITEM_WORDS` words, begins with a capital, a digit or a letter of a script without case, and has
no list mark, no sign of code, no pause at its end, and none of a few words that tie sentences together (`is`, `the`, `und`, …); a line that
ends with a colon absolves those after it. Lines without a word between items do not part them. A menu in one line has
`MENU_WORDS` words or more like that in at most `MENU_CHARS` characters, seven in ten of which begin with a capital, and is no part of a sentence with the next lines.

A line without a sentence mark of any script is stray if it is short and stands alone, or if
it is longer and each of its words comes twice on average. It does not stand alone if the line
before it ends within a sentence, if it has two words or more and ends at a comma or colon, if the next line begins in
lower case, or if the next has no mark either: so lines of wrapped prose, verse, lists and code stay.
Thai and Lao have no sentence marks, and their lines are never stray.

NULL is a text without words. A document without words fails the base rules.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from lendlane.llm.common import BLANKS, whole_row

# The base rules.
LEAST_WORDS = 10
WINDOW = 5
MOST_REPEATED = 20
SYMBOLS = "#*$%&|<>"

# Latin and CJK; then Greek, Armenian, Hebrew, Arabic, Syriac, Indic, Tibetan, Burmese, Ethiopic, Khmer, Mongolian, others.
SENTENCE_MARKS = ".!?…。！？" + "．｡‼⁇⁈⁉" + "\u037e։׃؟۔܀܁܂।॥།༎။።፧፨។៕᠃᠉᙮꓿꘎꘏"
# A sentence mark, then nothing but closing quotes, brackets and blanks.
SENTENCE_END = rf"[{SENTENCE_MARKS}][\p{{Pe}}\p{{Pf}}\p{{Pi}}\"'\s]*$"
PAUSE_END = r"\S\s+\S.*[,;:、，；：،؛\-–—][\s]*$"
UNMARKED_SCRIPTS = r"[\u0E00-\u0EFF]"
# A stray line has at most so many words and fewer than so many characters, or is repetitive.
SHORT_WORDS = 8
SHORT_CHARS = 40
SEPARATORS = "|»›•"
SPACED_SEPARATORS = (" > ", " / ")
# Menus: the words of an item, the items in succession, the words of a menu in one line and their capitals, in tenths.
ITEM_WORDS = 4
ITEMS = 3
MENU_WORDS = 8
MENU_CHARS = 600
MENU_CAPITALS = 7
# Words that tie a sentence together and hardly ever stand in a menu; signs of lists and code.
TIES = ("a an the is are was were be been am has have had do does did will would can could that which who what this these those it he "
        "she they we i and but or if than then not so as at into le la les un une des est sont et mais qui que il elle el los las es "
        "son y pero der die das ein eine ist sind und aber nicht ich").split()
LISTED = r"^\s*([-*+–—•·]|\d+[.)]|[a-zA-Z][.)])\s|[(){}\[\]=;\\]"
ITEM_HEAD = r"^\s*[\p{Lu}\p{Lt}\p{Lo}\p{Nd}]"
BEGINNINGS = ("posted by", "posted on", "posted in", "filed under", "read more", "share this", "leave a reply", "leave a comment", "skip to")
BEGUN_WORDS = 8
DOUBLED = ("!!", "??")
BOILERPLATE = (
    "all rights reserved", "copyright", "terms of use", "terms of service",
    "privacy policy", "cookie", "javascript", "click here", "subscribe to", "sign up", "log in", "lorem ipsum",
)
BOILERPLATE_WORDS = 25
# These are also what clean texts are about: all of them together count as one sign.
TOPICS = ("copyright", "cookie", "cookies", "javascript")
PHRASES = rf"(?<![\p{{L}}\p{{N}}])({'|'.join(BOILERPLATE)})(?![\p{{L}}\p{{N}}])".replace("cookie", "cookies?")
NOTICE = r"©|copyright (\(c\)|\d{4})"
# A document goes if less than this share of its words is left.
LEAST_LEFT = 0.5


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with the value worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def contains_any(text: Column, parts: Iterable[str]) -> Column:
    return reduce(Column.__or__, [F.contains(text, F.lit(p)) for p in parts])


def count_of(characters: str, text: Column) -> Column:
    """How many characters of `text` are among `characters`; most texts have none, which is cheaper to find."""
    counted = F.length(text) - F.length(F.translate(text, characters, ""))
    return F.when(contains_any(text, characters), counted).otherwise(F.lit(0))


def has_word(text: Column) -> Column:
    return text.rlike(r"[^\x20\x09-\x0D]")


def repeated_words(found: Column, window: int = WINDOW) -> Column:
    """Words in windows that occur twice or more, the first time included.

    Windows are compared by hash first; only a text in which hashes repeat has its windows sorted.
    """
    starts = lambda w: F.sequence(F.lit(0), F.size(w) - window)
    hashed = lambda w: F.transform(starts(w), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(window)]))

    def covered(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def repeats(p: Column) -> Column:
            same = lambda k, j: F.coalesce(F.get(p, k)["h"] == F.get(p, j)["h"], F.lit(False))
            again = F.filter(p, lambda x, k: same(k, k - 1) | same(k, k + 1))
            return F.sort_array(F.transform(again, lambda x: x["i"]))

        # Windows overlap: each adds the words up to the next one's start, the last all of its own.
        spans = lambda s: F.aggregate(
            F.transform(s, lambda x, k: F.least(F.coalesce(F.get(s, k + 1) - x, F.lit(window)), F.lit(window))),
            F.lit(0), lambda total, x: total + x)
        return let(placed, lambda p: let(repeats(p), spans))

    none = F.lit(0)
    checked = let(hashed(found), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(covered(h)))
    return F.when(F.size(found) < window, none).otherwise(checked)


def unmarked(line: Column) -> Column:
    """Whether a line has no sentence mark."""
    return ~line.rlike(f"[{SENTENCE_MARKS}]")


def alone(lines: Column, i: Column) -> Column:
    """Whether line `i`, which has no sentence mark, is no part of a sentence, a list or the like with the lines next to it."""
    before, after = (F.coalesce(F.get(lines, j), F.lit("")) for j in (i - 1, i + 1))
    prose = lambda line: has_word(line) & (count_of(SEPARATORS, line) < 2)
    unfinished = prose(before) & ~before.rlike(SENTENCE_END)
    goes_on = F.get(lines, i).rlike(PAUSE_END) | after.rlike(r"^\s*\p{Ll}") | (prose(after) & unmarked(after))
    return ~(unfinished | goes_on)


def stray(lines: Column, line: Column, i: Column) -> Column:
    """Whether `line`, number `i` of `lines` and with a word, fails for want of a sentence mark."""
    short = lambda w: (F.size(w) <= SHORT_WORDS) & (F.length(line) < SHORT_CHARS)
    repetitive = lambda w: 2 * F.size(F.array_distinct(w)) <= F.size(w)
    fails = lambda w: F.when(short(w), alone(lines, i)).otherwise(repetitive(w))
    return unmarked(line) & ~line.rlike(UNMARKED_SCRIPTS) & let(words(line), fails)


def is_boilerplate(line: Column, n: Column) -> Column:
    """Whether a line of `n` words has two signs of boilerplate."""
    lower = F.lower(line)
    two_signs = lambda found: (F.size(found) > 0) & (
        (2 * F.size(words(F.array_join(found, " "))) > n) | lower.rlike(NOTICE)
        | (F.size(F.array_distinct(F.transform(found, lambda x: F.when(x.isin(*TOPICS), "").otherwise(x)))) > 1))
    return (n <= BOILERPLATE_WORDS) & contains_any(lower, BOILERPLATE) & let(F.regexp_extract_all(lower, F.lit(PHRASES), F.lit(1)), two_signs)


def separators_of(line: Column) -> Column:
    spaced = reduce(Column.__add__, [
        F.when(F.contains(line, F.lit(m)), (F.length(line) - F.length(F.replace(line, F.lit(m)))) / len(m)).otherwise(F.lit(0.0)) for m in SPACED_SEPARATORS])
    return count_of(SEPARATORS, line) + spaced


def word_count(line: Column) -> Column:
    return F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))


def tied(line: Column) -> Column:
    """Whether some of a line's words tie a sentence together."""
    return F.lower(line).rlike(rf"(?<![\p{{L}}\p{{N}}])({'|'.join(TIES)})(?![\p{{L}}\p{{N}}])")


def is_item(line: Column) -> Column:
    """Whether an unmarked line with a word looks like an entry of a menu."""
    plain = line.rlike(ITEM_HEAD) & ~line.rlike(LISTED) & ~line.rlike(UNMARKED_SCRIPTS) & ~line.rlike(r"[,;:、，；：،؛–—-]\s*$")
    return (F.length(line) < SHORT_CHARS) & (word_count(line) <= ITEM_WORDS) & plain & ~tied(line)


def is_menu(lines: Column, i: Column) -> Column:
    """Whether line `i`, which has no sentence mark, is a menu of its own."""
    line, after = F.get(lines, i), F.coalesce(F.get(lines, i + 1), F.lit(""))
    capitals = F.regexp_count(line, F.lit(r"(?<![^\x20\x09-\x0D])[\p{Lu}\p{Lt}]"))
    listed = lambda n: (n >= MENU_WORDS) & (10 * capitals >= MENU_CAPITALS * n)
    return (F.length(line) <= MENU_CHARS) & let(word_count(line), listed) & ~line.rlike(LISTED) & ~line.rlike(PAUSE_END) & ~after.rlike(
        r"^\s*\p{Ll}") & ~tied(line)


def in_a_menu(facts: Column, at: Column) -> Column:
    """Whether the line with number `at` among those with words is one of `ITEMS` menu items in succession."""
    item = lambda k: F.coalesce(F.get(facts, at + k)["item"], F.lit(False))
    runs = [reduce(Column.__and__, [item(k) for k in range(first, first + ITEMS)]) for first in range(1 - ITEMS, 1)]
    return item(0) & reduce(Column.__or__, runs)


def breaks_a_rule(line: Column) -> Column:
    """Whether a line that has a word fails, whatever its sentence marks."""
    symbols = 10 * count_of(SYMBOLS, line) > F.length(line)
    left = lambda mark: F.length(F.replace(line, F.lit(mark)))
    doubled = reduce(Column.__add__, [F.length(line) - left(mark) for mark in DOUBLED])  # two characters each
    separators = separators_of(line)
    by_words = lambda n: (2 * doubled > n) | ((separators >= 2) & (4 * separators >= n)) | is_boilerplate(line, n)
    return symbols | let(F.size(words(line)), by_words)


def begins_as_boilerplate(line: Column) -> Column:
    """Whether an unmarked line is short and begins with a set beginning."""
    lower = F.lower(F.ltrim(line))
    begun = reduce(Column.__or__, [F.startswith(lower, F.lit(b)) for b in BEGINNINGS])
    return begun & (F.size(words(line)) <= BEGUN_WORDS)


def good_lines(text: Column) -> Column:
    """The lines that stay. Only a text that has any of the tell-tale strings has all rules tried on each line, and only
    unmarked lines are looked at together with the lines next to them."""
    telling = contains_any(text, [*SYMBOLS, *SEPARATORS, *SPACED_SEPARATORS, *DOUBLED])
    suspect = telling | contains_any(F.lower(text), BOILERPLATE)

    def stay(lines: Column) -> Column:
        # For each line whether it has a word and whether it is without a sentence mark; found once.
        worded = lambda l: F.struct(l.alias("line"), has_word(l).alias("word"))
        with_words = lambda l: F.struct(l["line"].alias("line"), l["word"].alias("word"), (l["word"] & unmarked(l["line"])).alias("bare"))
        return let(F.transform(F.transform(lines, worded), with_words), lambda each: judged(lines, each))

    def judged(lines: Column, each: Column) -> Column:
        bare = F.exists(each, lambda l: l["bare"])
        poor = lambda l: F.coalesce(suspect, F.lit(False)) & breaks_a_rule(l)
        # Most texts have a mark in every line.
        simple = F.filter(lines, lambda l: ~has_word(l) | ~poor(l))
        marked = F.when(suspect, simple).otherwise(lines)
        return F.when(~bare, marked).otherwise(let(items(each), lambda facts: kept(lines, each, facts, poor)))

    def items(each: Column) -> Column:
        """Of lines with words in their order: the number in the text, and whether they are menu items."""
        numbered = F.filter(F.transform(each, lambda l, i: F.struct(l.alias("l"), i.alias("i"))), lambda x: x["l"]["word"])
        told = F.transform(numbered, lambda x: F.struct(
            x["i"].alias("i"), F.when(x["l"]["bare"], is_item(x["l"]["line"])).otherwise(F.lit(False)).alias("item"),
            x["l"]["line"].rlike(r":\s*$").alias("colon")))
        # A line that ends with a colon absolves the next one, and with it what follows directly.
        return F.transform(told, lambda x, k: F.struct(
            x["i"].alias("i"), (x["item"] & ~F.coalesce(F.get(told, k - 1)["colon"], F.lit(False))).alias("item")))

    def kept(lines: Column, each: Column, facts: Column, poor: Callable[[Column], Column]) -> Column:
        menu = F.transform(F.filter(F.transform(facts, lambda x, k: F.struct(x["i"].alias("i"), in_a_menu(facts, k).alias("in"))),
                                    lambda x: x["in"]), lambda x: x["i"])

        def fails(l: Column, i: Column, menu: Column) -> Column:
            line = l["line"]
            by_itself = F.array_contains(menu, i) | stray(lines, line, i) | begins_as_boilerplate(line) | is_menu(lines, i)
            return l["word"] & (poor(line) | (l["bare"] & by_itself))

        return let(menu, lambda m: F.transform(F.filter(
            F.transform(each, lambda l, i: F.struct(l["line"].alias("line"), fails(l, i, m).alias("out"))), lambda x: ~x["out"]), lambda x: x["line"]))

    return let(F.split(text, "\n"), stay)


def rules(text: Column) -> Column:
    """A struct: the base figures, `base_failed`, `clean_text`, `n_words_left` and `kept`. NULL is an empty text."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    long = lambda c: c.cast("long")
    lines = F.filter(F.split(text, "\n"), has_word)
    figures = lambda w: F.struct(
        long(F.size(w)).alias("n_words"),
        long(F.length(F.array_join(w, ""))).alias("word_chars"),
        long(count_of(SYMBOLS, text)).alias("n_symbols"),
        let(lines, lambda l: long(F.size(l) - F.size(F.array_distinct(l)))).alias("n_dup_lines"),
        long(repeated_words(w)).alias("n_repeat_words"),
        F.array_join(good_lines(text), "\n").alias("clean_text"),
    )
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "clean_text"]

    def judged(f: Column) -> Column:
        failed = (f["n_words"] < LEAST_WORDS) | (100 * f["n_repeat_words"] > MOST_REPEATED * f["n_words"])
        same = F.length(f["clean_text"]) == F.length(text)
        left = F.when(same, f["n_words"]).otherwise(long(F.size(words(f["clean_text"]))))
        return F.struct(*[f[c].alias(c) for c in base], failed.alias("base_failed"), left.alias("n_words_left"))

    def verdict(f: Column) -> Column:
        kept = ~f["base_failed"] & (f["n_words_left"] >= LEAST_LEFT * f["n_words"])
        return F.struct(*[f[c].alias(c) for c in [*base, "base_failed", "n_words_left"]], kept.alias("kept"))

    return let(let(let(words(text), figures), judged), verdict)


def judge(docs: DataFrame) -> DataFrame:
    """One row per row of `docs` (`doc_id`, `text`): the figures, the cleaned text and the verdict."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), rules(F.col("text")).alias("rules")).select("doc_id", "rules.*")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with their cleaned text and its length in `n_chars`; all columns of `docs`."""
    # Exploding no or one struct drops the others; a filter would work out the rules once more.
    passed = F.explode(F.filter(F.array(rules(F.col("text"))), lambda r: r["kept"]))
    columns = [c for c in docs.columns]
    held = docs.select(whole_row(columns).alias("row"), passed.alias("rules"))
    clean = F.col("rules.clean_text")
    cleaned = {"text": clean, "n_chars": F.length(clean).cast("long")}
    return held.select(*[cleaned[c].alias(c) if c in cleaned else F.col("row")[c].alias(c) for c in columns])
