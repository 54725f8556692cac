"""The first listed phrase that a row's texts hold, for phrase lists that come as a table.

`guards.input_guard` spells a handful of phrases out in the plan. Here all phrases are searched for in one pass
over a text, by an Aho-Corasick automaton that each task builds, so the work hardly grows with their number.

Matching is as in the guards: upper and lower case are one, and `.*` in a phrase stands for anything up to the
line feed. The first field that holds a phrase counts, and in it the phrase of the least `place`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

GAP = ".*"
# What bounds a whole word.
BLANKS = " \t\n\v\f\r"
HIT = "field_no int, place long, phrase string"
# Characters of phrases in one automaton, about 200 bytes each; more phrases take several passes.
AUTOMATON_CHARS = 1_000_000


def finder(phrases: list[tuple[int, str]], whole_words: bool = False) -> Callable[[str], tuple[int, str] | None]:
    """A function that gives the (place, phrase) of least place in a lower-case text.

    A phrase without characters is in no text. With `whole_words`, each part of a phrase must lie between blanks.
    """
    users: dict[str, list[tuple[tuple[int, str], int, int]]] = {}
    for place, phrase in phrases:
        parts = [p for p in phrase.split(GAP) if p]
        for k, part in enumerate(parts):
            users.setdefault(part, []).append(((place, phrase), k, len(parts)))
    if not users:
        return lambda text: None
    automaton = ahocorasick.Automaton()
    for part, own in users.items():
        automaton.add_word(part, (len(part), part.count("\n"), sorted(own)))
    automaton.make_automaton()

    def first(text: str) -> tuple[int, str] | None:
        best = None
        reached: dict[tuple[int, str], tuple[int, int, int]] = {}  # parts found, where the last one ended, its line
        line, feed = 0, text.find("\n")
        for last, (length, feeds, own) in automaton.iter(text):
            start, end = last + 1 - length, last + 1
            while -1 < feed < end:
                line, feed = line + 1, text.find("\n", feed + 1)
            if whole_words and ((start and text[start - 1] not in BLANKS) or (end < len(text) and text[end] not in BLANKS)):
                continue
            for key, k, n in own:
                if best is not None and key >= best:
                    break
                if n > 1:
                    found, upto, on_line = reached.get(key, (0, 0, 0))
                    if found and on_line != line - feeds:
                        found = upto = 0
                    if k != found or start < upto:
                        continue
                    reached[key] = (found + 1, end, line)
                    if found + 1 < n:
                        continue
                best = key
        return best

    return first


def first_phrase(df: DataFrame, fields: list[str], phrases: DataFrame, whole_words: bool = False,
                 automaton_chars: int = AUTOMATON_CHARS) -> DataFrame:
    """`df` with `hit_field`, `hit_place` and `hit_phrase`, NULL where no field holds a phrase.

    `phrases` has `place` and `phrase`; the least place of a repeated phrase counts, and NULLs and empty phrases are in no
    text. The phrases are measured first and cut into lists of bounded length, one pass each; no row is moved.
    """
    listed = phrases.select(F.col("place").cast("long").alias("place"), F.lower("phrase").alias("phrase")).where(
        "place IS NOT NULL AND phrase <> ''").groupBy("phrase").agg(F.min("place").alias("place"))
    chars = listed.agg(F.sum(F.length("phrase"))).first()[0] or 0
    lists = max(1, -(-chars // automaton_chars))
    hits = []
    for k in range(lists):
        own = listed.where(F.pmod(F.xxhash64("phrase"), F.lit(lists)) == k)
        found = [(r["place"], r["phrase"]) for r in own.collect()]  # about `automaton_chars` characters at most
        if found:
            hits.append(_searched(found, whole_words)(*[F.lower(F.col(f).cast("string")) for f in fields]))
    if not hits:
        hits = [F.lit(None).cast(f"struct<{HIT.replace(' ', ':').replace(',:', ',')}>")]
    named = df.withColumn("hit", F.array_min(F.array(*hits)))
    names = F.array(*[F.lit(f) for f in fields])
    return named.withColumns({
        "hit_field": F.get(names, F.col("hit.field_no")), "hit_place": F.col("hit.place"), "hit_phrase": F.col("hit.phrase")}).drop("hit")


def _searched(phrases: list[tuple[int, str]], whole_words: bool):
    kind = pa.struct([("field_no", pa.int32()), ("place", pa.int64()), ("phrase", pa.string())])

    @F.arrow_udf(HIT)
    def search(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        first = finder(phrases, whole_words)
        for columns in batches:
            out = []
            for texts in zip(*columns):
                hit = None
                for no, text in enumerate(texts):
                    found = first(text.as_py()) if text.is_valid else None
                    if found:
                        hit = {"field_no": no, "place": found[0], "phrase": found[1]}
                        break
                out.append(hit)
            yield pa.array(out, kind)

    return search
