"""Chat formatting read back, and mixtures against plain apportionment."""

import hashlib
import itertools
import shutil
from fractions import Fraction

import pytest

from llm_tables import documents, no_docs, odd_docs  # noqa: F401

from lendlane.llm import chat_prefix, mixing
from lendlane.session import shared_folder

TURNS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "a\\<turn>b</turn>\\"), (1, 2, "user", None), (1, 3, "assistant", "<says>"), (1, 4, "user", "end"),
    (2, 0, "system", "only"), (None, 5, "assistant", ""), (3, 1, None, "x"), (3, 1, "assistant", "y"), (3, 1, "assistant", "y"),
    (4, 0, "us<says>er\\", "\n"), (4, None, "assistant", "𝄞é"),
]


@pytest.fixture(scope="module")
def formatted(spark):
    chats = spark.createDataFrame([(*t, "clash", 1) for t in TURNS], "conv_id long, turn long, role string, text string, rendered string, start int")
    folder = shared_folder(spark, "t")
    chat_prefix.write(chats, folder)
    chat_prefix.expand(spark, folder)
    return folder


def turns_of(conv_id):
    own = [(t, r or "", x or "") for c, t, r, x in TURNS if c == conv_id]
    return sorted(own, key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))


@pytest.mark.parametrize("read", [chat_prefix.digests, chat_prefix.prefix_digests])
def test_digests(spark, formatted, read):
    rows = {r.conv_id: r for r in read(spark, formatted).collect()}
    assert set(rows) == {t[0] for t in TURNS}
    for conv_id, r in rows.items():
        own = turns_of(conv_id)
        loss = "".join(x for _, role, x in own if role == "assistant")
        assert r.n_turns == len(own)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{x}\n" for _, role, x in own).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


@pytest.mark.parametrize("piece_chars", [chat_prefix.PIECE_CHARS, 30, 1])
def test_each_assistant_turn_is_an_example(spark, formatted, piece_chars, tmp_path):
    shutil.copytree(formatted, tmp_path / "chat", ignore=shutil.ignore_patterns("examples"))
    folder = str(tmp_path / "chat")
    chat_prefix.expand(spark, folder, piece_chars)
    pieces = sorted(chat_prefix.examples(spark, folder).collect(), key=lambda r: (r.conv_id is not None, r.conv_id or 0, r.record, r.piece))
    assert sorted(map(str, chat_prefix.digests(spark, folder).collect())) == sorted(map(str, chat_prefix.prefix_digests(spark, folder).collect()))
    for conv_id in {r.conv_id for r in pieces}:
        own = turns_of(conv_id)
        records = {}
        for r in pieces:
            if r.conv_id == conv_id:
                records.setdefault(r.record, []).append(r)
        assert [k for k, rows in records.items() if rows[-1].loss_start is not None] == [k for k, t in enumerate(own) if t[1] == "assistant"]
        for k, rows in records.items():
            assert [t for r in rows for t in chat_prefix.parsed(r.text)] == [(role, x) for _, role, x in own[: k + 1]]
            assert rows[-1].n_turns == k + 1 and all(r.loss_start is None for r in rows[:-1])
            if rows[-1].loss_start is not None:
                assert chat_prefix.unescaped(rows[-1].text[rows[-1].loss_start : rows[-1].loss_end]) == own[k][2]
                assert rows[-1].text[rows[-1].loss_end :] == chat_prefix.CLOSE
        assert max(records) == len(own) - 1 and [r.final for r in pieces if r.conv_id == conv_id] == [
            k == len(own) - 1 for k, rows in records.items() for _ in rows]


def test_a_very_long_conversation_keeps_each_turn_once(spark):
    n = 100_000
    chat = spark.range(n).selectExpr("1L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('t', id) as text")
    folder = shared_folder(spark, "t")
    chat_prefix.write(chat, folder)
    (row,) = chat_prefix.prefix_digests(spark, folder).collect()
    said = [("user" if k % 2 == 0 else "assistant", f"t{k}") for k in range(n)]
    loss = "".join(x for role, x in said if role == "assistant")
    assert (row.n_turns, row.loss_sha256) == (n, hashlib.sha256(loss.encode()).hexdigest())
    assert row.turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in said).encode()).hexdigest()
    upto = list(itertools.accumulate(len(r) + len(x) + 19 for r, x in said))
    assert row.formatted_chars == sum(upto[1::2])


def test_no_conversations(spark):
    folder = shared_folder(spark, "t")
    chat_prefix.write(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), folder)
    chat_prefix.expand(spark, folder)
    assert chat_prefix.digests(spark, folder).count() == 0 == chat_prefix.prefix_digests(spark, folder).count()


def one_by_one(votes, seats, most):
    given = [0] * len(votes)
    for _ in range(seats):
        open_ = [i for i in range(len(votes)) if given[i] < most[i] and votes[i] > 0]
        if not open_:
            break
        given[max(open_, key=lambda i: (Fraction(votes[i]) / (2 * given[i] + 1), -i))] += 1
    return given


@pytest.mark.parametrize("votes, seats, most", [
    ([53, 24, 23], 7, [99] * 3), ([5, 5, 5, 5], 6, [99] * 4), ([100, 1, 0], 50, [9, 99, 99]), ([Fraction(7, 3), 9], 0, [5, 5]),
    ([1000, 10, 10, 3], 400, [300, 300, 2, 300]), ([3, 2], 100, [4, 5]),
])
def test_sainte_lague(votes, seats, most):
    assert mixing.apportion(votes, seats, most) == one_by_one(votes, seats, most)


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    out, left, open_ = {}, Fraction(sum(sizes.values())), names
    while True:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            return weight, out | share
        out |= {s: Fraction(3 * sizes[s]) for s in over}
        left -= sum(out[s] for s in over)
        open_ = [s for s in open_ if s not in over]


def plain_mix(docs):
    """Targets, then seats one by one, of (source, words) rows with one shard a source."""
    sizes = {}
    for s, n in docs:
        sizes[s] = sizes.get(s, 0) + n
    weight, wanted = plain_targets(sizes)
    most = {s: 3 * -(-n // mixing.BLOCK_WORDS) for s, n in sizes.items()}
    seats = {s: most[s] for s in sizes if wanted[s] == 3 * sizes[s]}
    rest = sorted((s for s in sizes if s not in seats), key=lambda s: (s is None, s or ""))
    given = one_by_one([wanted[s] for s in rest], round(Fraction(sum(wanted[s] for s in rest), mixing.BLOCK_WORDS)), [most[s] for s in rest])
    return sizes, wanted, seats | dict(zip(rest, given))


MIXTURES = {
    "null last": [("a", 100), ("b", 100), (None, 100)],
    "a limit": [("a", 1), ("b", 5000), ("c", 5000)],
    "no words": [("a", 0), ("b", 0)],
    "one": [("x", 777)],
    "many ties": [(f"s{i:03}", 640 + (i * 37) % 200) for i in range(90)],
    "more than blocks": [(f"s{i:03}", 3 + i % 7) for i in range(200)] + [("", 40), (None, 9)],
    "steep": [(f"k{i}", 4**i) for i in range(9)] + [("é", 70000), ("\U0001d11e", 65), ("\uffff", 64)],
}


@pytest.mark.parametrize("name", MIXTURES)
def test_quotas_equal_seats_given_one_by_one(spark, name):
    docs = MIXTURES[name]
    sizes, wanted, seats = plain_mix(docs)
    table = spark.createDataFrame([(i, s, " ".join(["w"] * n)) for i, (s, n) in enumerate(docs)], "doc_id long, source string, text string")
    rows = mixing.stored(mixing.sized(table), "t").repartition(5)
    dealt, quota = mixing.quotas(rows)
    place = {r.place: r for r in dealt.collect()}
    assert {r.source: (r.source_size, r.target) for r in place.values()} == {s: (sizes[s], float(wanted[s])) for s in sizes}
    assert {place[r.q_place].source: r.quota for r in quota.collect()} == {s: n for s, n in seats.items() if sizes[s]}
    blocks = {s: max(1, -(-n // mixing.BLOCK_WORDS)) for s, n in sizes.items()}
    for r in mixing.taken(rows).collect() if name == "steep" else []:
        s = docs[r.doc_id][0]
        # A source of one document gives its blocks whole; its last one may be short.
        assert sizes[s] * (seats[s] // blocks[s]) <= r.taken <= min(3 * sizes[s], seats[s] * mixing.BLOCK_WORDS)


def test_shards_of_a_tree(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FAN", 3)
    words = [(p, shard, 10 + (p * 31 + shard * 17) % 90) for p, n in ((0, 1), (1, 3), (2, 25)) for shard in range(n)]
    shards = spark.createDataFrame([(*w, 3 * -(-w[2] // 8)) for w in words], "place long, shard long, words long, most long")
    asked = {0: 4, 1: 11, 2: 200}
    got = mixing.shard_quotas(shards, spark.createDataFrame(list(asked.items()), "place long, seats long"), 25).collect()
    assert len(got) == len(words) and {p: sum(r.quota for r in got if r.place == p) for p in asked} == asked
    total = sum(w for p, _, w in words if p == 2)
    for r in got:
        own = next(w for p, shard, w in words if (p, shard) == (r.place, r.shard))
        if r.place == 1:
            three = [w for p, _, w in words if p == 1]
            assert r.quota == one_by_one(three, 11, [99] * 3)[r.shard]
        if r.place == 2:
            assert abs(r.quota - 200 * own / total) <= 2


def test_mix_comes_near_its_targets(spark, documents):
    rows = mixing.mix(documents).collect()
    again = mixing.mix(documents.repartition(7)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    source = {r.doc_id: r.source for r in documents.collect()}
    for s in set(source.values()):
        own = [r for r in rows if source[r.doc_id] == s]
        assert sum(r.size for r in own) == own[0].source_size
        assert abs(sum(r.taken for r in own) - own[0].target) <= 3 * mixing.BLOCK_WORDS
        assert all(0 <= r.taken <= 3 * r.size for r in own)


def test_mixed_documents_hold_the_words_taken(odd_docs, documents, no_docs):
    taken = {}
    for r in mixing.mix(documents).collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken
    got = {}
    for r in mixing.mixed_documents(documents).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(r.text.split())
        assert r.n_chars == len(r.text)
    assert got == {k: n for k, n in taken.items() if n}
    assert mixing.mixed_documents(odd_docs).columns == odd_docs.columns
    rows = mixing.mix(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(r.taken == 0 for r in rows if r.doc_id in (0, 1, 2))
    assert mixing.mix(no_docs).count() == 0 and mixing.mixed_documents(no_docs).count() == 0
