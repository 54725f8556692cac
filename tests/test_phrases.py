"""Phrase tables against one regular expression for each phrase."""

import functools
import random
import re

import pytest

from lendlane.operators import phrases


@functools.cache
def pattern(phrase, whole_words):
    bound = r"(?:(?<=[ \t\n\v\f\r])|\A)%s(?:(?=[ \t\n\v\f\r])|\Z)" if whole_words else "%s"
    parts = [re.escape(p) for p in phrase.split(".*") if p]
    return re.compile(r"[^\n]*".join(bound % p for p in parts)) if parts else re.compile("(?!)")


def plain(text, listed, whole_words=False):
    """The first phrase found, each looked for by itself."""
    return next(((place, p) for place, p in sorted(listed) if pattern(p, whole_words).search(text)), None)


@pytest.mark.parametrize("whole_words", [False, True])
def test_finder_equals_a_search_for_each_phrase(whole_words):
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("ab ") for _ in range(draw.randint(1, 4)))
    for _ in range(3000):
        listed = [(n, ".*".join(word() for _ in range(draw.choice((1, 1, 2, 3))))) for n in range(draw.randint(0, 6))]
        text = "".join(draw.choice("aabb  \n") for _ in range(draw.randint(0, 30)))
        assert phrases.finder(listed, whole_words)(text) == plain(text, listed, whole_words), (listed, text)


def test_ten_thousand_phrases(spark):
    draw = random.Random(6)
    words = ["".join(draw.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    listed = [(n, f"{draw.choice(words)} {draw.choice(words)}{draw.choice(['', '', '.*' + draw.choice(words)])}") for n in range(10_000)]
    rows = [(n, None if n % 9 == 0 else draw.choice(words), " ".join(draw.choices(words, k=draw.randint(0, 8)))) for n in range(200)]
    rows += [(200, None, None), (201, "", ""), (202, "X", listed[3][1].replace(".*", " x ").upper()), (202, "X", "\n".join(listed[4][1].split(".*")))]
    table = spark.createDataFrame(rows, "id long, title string, text string").repartition(3)
    given = spark.createDataFrame(listed + [(5, None), (6, ""), (None, words[0]), (20_000, listed[7][1])], "place long, phrase string")
    expected = []
    for n, title, text in rows:
        hits = [(f, *h) for f, t in (("title", title), ("text", text)) if t is not None and (h := plain(t.lower(), listed))]
        expected.append((n, *(hits[0] if hits else (None, None, None))))
    key = lambda r: tuple(map(str, r))
    for chars in (phrases.AUTOMATON_CHARS, 40_000):
        got = phrases.first_phrase(table, ["title", "text"], given, automaton_chars=chars)
        assert sorted(map(tuple, got.select("id", "hit_field", "hit_place", "hit_phrase").collect()), key=key) == sorted(expected, key=key)
    assert sum(e[1] is not None for e in expected) > 20


def test_no_phrases_and_no_rows(spark):
    none = spark.createDataFrame([], "place long, phrase string")
    table = spark.createDataFrame([("a",)], "text string")
    assert phrases.first_phrase(table, ["text"], none).first().asDict() == {
        "text": "a", "hit_field": None, "hit_place": None, "hit_phrase": None}
    some = spark.createDataFrame([(1, "a")], "place long, phrase string")
    assert phrases.first_phrase(table.limit(0), ["text"], some).count() == 0
