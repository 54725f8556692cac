"""Mixing sources to target weights, by Sainte-Laguë apportionment of equal-token blocks.

A document's size is its number of words. Sources in code point order, NULL last,
weigh 5, 2, 1 and so on in turn and share the size of the whole corpus; a target
stops at three times its source, and the excess is shared again by weight.

Blocks of `BLOCK_WORDS` words are then given out, one by one as it were, each to the
source with the highest quotient target / (2 * blocks + 1), and a source's blocks in the same
way to its shards by their size. Sources, shards and quotas are tables; only sums reach the driver. In a shard, documents lie in an order drawn
from the seed and are cut into blocks end to end; the quota of blocks is taken
from a block drawn from the seed onwards, in a circle, as often as it goes round.
At most two documents of a shard are taken in part.

NULL and empty texts have no words and none are taken. Repeated rows are
documents of their own. Without words no target and no block arises.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from lendlane.llm.common import BLANKS, shuffle_partitions, sorted_groups, stored, whole_row

# Weights in turn, and the most times a source or document is taken.
WEIGHTS = (5, 2, 1)
MOST_TIMES = 3
BLOCK_WORDS = 64
# Words of a shard, documents of a shard, and branches of a node where shards are many.
SHARD_WORDS = 250_000
SHARD_DOCS = 20_000
FAN = 4096
SEED = 20


def apportion(votes: list[Fraction | int], seats: int, most: list[int]) -> list[int]:
    """Seats by highest quotients votes / (2 k + 1), none over its `most`; equal quotients go to the earlier one.

    The seats above a common divisor are counted at once, the last few by their quotients.
    """
    seats = min(seats, sum(m for m, v in zip(most, votes) if v > 0))
    if not seats:
        return [0] * len(votes)
    at = lambda d: [min(m, int((v / d + 1) // 2)) if v > 0 else 0 for v, m in zip(votes, most)]
    low = min(Fraction(v) / (2 * m + 1) for v, m in zip(votes, most) if v > 0 and m > 0)  # here all have their most
    high = Fraction(2 * max(votes) + 1)  # and here none has a seat
    while sum(at(low)) - sum(at(high)) > len(votes):
        middle = (low + high) / 2
        if sum(at(middle)) >= seats:
            low = middle
        else:
            high = middle
    given = at(high)
    queue = [(-Fraction(v) / (2 * g + 1), i) for i, (v, g, m) in enumerate(zip(votes, given, most)) if v > 0 and g < m]
    heapq.heapify(queue)
    for _ in range(seats - sum(given)):
        _, i = heapq.heappop(queue)
        given[i] += 1
        if given[i] < most[i]:
            heapq.heappush(queue, (-Fraction(votes[i]) / (2 * given[i] + 1), i))
    return given


def sized(docs: DataFrame, *carried: Column) -> DataFrame:
    """`doc_id`, `source`, `size`, a random but repeatable number for each row, and what else is asked for."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    size = F.size(F.filter(F.split(text, BLANKS), lambda w: w != "")).cast("long")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"),
        F.xxhash64(F.lit(SEED), F.col("doc_id"), text).alias("draw"), *carried)


def source_places(rows: DataFrame) -> DataFrame:
    """One row for each source: its `place` in code point order from 0, NULL last, `weight`, `words` and number of `shards`.

    Sources are sorted in parts and numbered through by the parts' counts, so no task holds them all.
    """
    words, n_docs = F.col("words"), F.col("docs")
    found = stored(rows.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("docs")), "mix-sources")
    order = [F.col("source").isNull(), F.col("source")]
    parts = stored(found.repartitionByRange(shuffle_partitions(rows.sparkSession), *order).withColumn("part", F.spark_partition_id()),
                   "mix-source-parts")
    shards = F.greatest(F.lit(1), F.ceil(words / SHARD_WORDS), F.ceil(n_docs / SHARD_DOCS)).cast("long")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("place") % len(WEIGHTS) + 1).cast("int")).cast("long")
    return stored(nth(parts, F.lit(True), order, "place").withColumns({"weight": weight, "shards": shards}).drop("docs"), "mix-places")


def nth(parts: DataFrame, among: Column, order: list[Column], name: str) -> DataFrame:
    """How many rows of `among` lie before each row, in a table whose `part`s follow one another."""
    counts = parts.groupBy("part").agg(F.count(F.when(among, 1)).alias("n"))
    before = counts.select(F.col("part").alias("b_part"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    here = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(F.sum(F.when(among, 1).otherwise(0)).over(here), F.lit(0))
    joined = parts.join(before, F.col("part") == F.col("b_part"))
    return joined.withColumn(name, (F.col("before") + own).cast("long")).drop("before", "b_part")


def _beyond(left: int, weights: int, or_equal: bool = False) -> Column:
    """Whether a source's share of `left` by weight is more than its limit; exact."""
    share = F.col("weight").cast("decimal(18,0)") * F.lit(Decimal(left)).cast("decimal(19,0)")
    limit = (MOST_TIMES * F.col("words")).cast("decimal(19,0)") * F.lit(Decimal(weights)).cast("decimal(18,0)")
    return share >= limit if or_equal else share > limit


def _open_share(sources: DataFrame, total: int, closed: Column) -> tuple[int, int]:
    """Words left for the sources that are not closed, and their weights."""
    r = sources.agg(F.sum(F.when(closed, MOST_TIMES * F.col("words"))).alias("gone"), F.sum(F.when(~closed, F.col("weight"))).alias("weights")).first()
    return total - (r["gone"] or 0), r["weights"] or 0


def share_of(sources: DataFrame) -> tuple[int, int]:
    """Words and weights of the sources below their limit, which give `weight * words / weights` each.

    Each round closes the sources whose share is beyond their limit; one aggregate a round.
    """
    total = sources.agg(F.sum("words")).first()[0] or 0
    now = _open_share(sources, total, F.lit(False))
    while True:
        then = _open_share(sources, total, _beyond(*now))
        if then == now:
            return now
        now = then


def source_quotas(sources: DataFrame, left: int, weights: int) -> DataFrame:
    """`place` and `seats`, the blocks a source gives, by the highest quotients weight / (2 * blocks + 1).

    `sources` has `most` too. Those at their limit give every block as often as may be. For the others a common
    divisor is sought by aggregates: 10 / j is one for a whole number j, since weights are 5, 2 and 1. What is
    left over goes to the sources with the next quotient, earlier ones first.
    """
    full = _beyond(left, weights, or_equal=True)
    total = sources.agg(F.sum("words")).first()[0] or 0
    words, open_weights = _open_share(sources, total, full)
    others = sources.where(~full)
    all_blocks = others.agg(F.sum("most")).first()[0] or 0
    seats = min(round(Fraction(words, BLOCK_WORDS)), all_blocks)
    at = lambda j: F.least(F.col("most"), F.floor((F.col("weight") * j + 10) / 20).cast("long"))
    j, step, given = 0, 1, 0
    if open_weights:
        # Without limits the divisor lies about here.
        j = max(0, 20 * words // (BLOCK_WORDS * open_weights) - 25)
        while True:
            tried = [j + step * k for k in range(64)]
            sums = others.agg(*[F.sum(at(F.lit(t))).alias(f"t{k}") for k, t in enumerate(tried)]).first()
            within = [k for k in range(64) if sums[k] <= seats]
            if not within:
                j, step = 0, 64**6
                continue
            j, given = tried[within[-1]], sums[within[-1]]
            if given == all_blocks or (step == 1 and within[-1] < 63):
                break
            step = step * 64 if within[-1] == 63 else step // 64
    now = F.when(full, F.col("most")).otherwise(at(F.lit(j)))
    next_ = ~full & (at(F.lit(j + 1)) > at(F.lit(j)))
    counted = nth(sources.withColumns({"seats": now, "next": next_}), F.col("next"), [F.col("place")], "turn")
    return counted.select("place", (F.col("seats") + F.when(F.col("next") & (F.col("turn") < seats - given), 1).otherwise(0)).alias("seats"))


def shard_quotas(shards: DataFrame, seats: DataFrame, most_shards: int) -> DataFrame:
    """`place`, `shard` and `quota`: a source's blocks given out to its shards by their words.

    Shards hang on a tree of `FAN` branches a node, one level for up to `FAN` shards; a node's blocks are given out
    to its branches. A group is the branches of one node.
    """
    schema = "place long, node long, quota long"

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["place", "parent"]):
            column = lambda c: group.column(c).to_pylist()
            quota = apportion(column("words"), column("seats")[0], column("most"))
            yield pa.RecordBatch.from_arrays([pa.array(column("place"), pa.int64()), pa.array(column("node"), pa.int64()),
                                              pa.array(quota, pa.int64())], names=["place", "node", "quota"])

    levels = 1
    while FAN**levels < most_shards:
        levels += 1
    given = seats.select(F.col("place").alias("g_place"), F.lit(0).cast("long").alias("g_node"), F.col("seats"))
    for level in reversed(range(levels)):
        nodes = shards.groupBy("place", F.floor(F.col("shard") / FAN**level).cast("long").alias("node")).agg(
            F.sum("words").alias("words"), F.sum("most").alias("most"))
        known = nodes.withColumn("parent", F.floor(F.col("node") / FAN).cast("long")).join(
            given, (F.col("place") == F.col("g_place")) & (F.col("parent") == F.col("g_node")))
        dealt = known.select("place", "parent", "node", "words", "most", "seats").repartition("place", "parent")
        done = dealt.sortWithinPartitions("place", "parent", "node").mapInArrow(give, schema)
        given = done.select(F.col("place").alias("g_place"), F.col("node").alias("g_node"), F.col("quota").alias("seats"))
    return given.select(F.col("g_place").alias("place"), F.col("g_node").alias("shard"), F.col("seats").alias("quota"))


def quotas(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of stored `sized` rows: each with its source's figures and its shard; and each shard's words and quota of blocks.

    Sources and shards stay tables. Joins carry no hint: Spark broadcasts what it measures to be small.
    """
    sources = source_places(rows)
    left, weights = share_of(sources)
    share = F.col("weight") * F.lit(left) / F.lit(max(weights, 1))
    target = F.when(_beyond(left, weights), (MOST_TIMES * F.col("words")).cast("double")).otherwise(share.cast("double"))
    figures = sources.select(F.col("source").alias("s_source"), "place", F.col("words").alias("source_size"), target.alias("target"), "shards")
    dealt = rows.join(figures, rows["source"].eqNullSafe(figures["s_source"])).withColumn(
        "shard", F.pmod(F.xxhash64(F.lit("shard"), "draw"), F.col("shards"))).drop("s_source", "shards")
    most = MOST_TIMES * F.ceil(F.col("words") / BLOCK_WORDS).cast("long")
    shards = stored(dealt.groupBy("place", "shard").agg(F.sum("size").alias("words")).where("words > 0").withColumn("most", most), "mix-shards")
    limits = shards.groupBy(F.col("place").alias("m_place")).agg(F.sum("most").alias("m_most"))
    limited = stored(sources.join(limits, F.col("place") == F.col("m_place"), "left").withColumn(
        "most", F.coalesce("m_most", F.lit(0)).cast("long")).drop("m_place", "m_most"), "mix-limits")
    seats = source_quotas(limited, left, weights)
    most_shards = sources.agg(F.max("shards")).first()[0] or 1
    given = shard_quotas(shards, seats, most_shards)
    whole = shards.join(given.withColumnsRenamed({"place": "q_place", "shard": "q_shard"}),
                        (F.col("place") == F.col("q_place")) & (F.col("shard") == F.col("q_shard")))
    return dealt, stored(whole.select("q_place", "q_shard", F.col("words").alias("shard_words"), "quota"), "mix-quotas")


def taken(rows: DataFrame) -> DataFrame:
    """Stored `sized` rows with `source_size`, `target`, `taken` (words, repeats counted) and what that is made of.

    `times` whole documents, and from the last round the words `a` to `a + main` and `c` to `c + wrapped`.
    """
    dealt, quota = quotas(rows)
    here = (dealt["place"] == quota["q_place"]) & (dealt["shard"] == quota["q_shard"])
    placed = dealt.join(quota, here, "left").drop("q_place", "q_shard")
    order = Window.partitionBy("place", "shard").orderBy("draw", "doc_id", "size")
    at = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = F.ceil(F.col("shard_words") / BLOCK_WORDS)
    first = F.pmod(F.xxhash64(F.lit(SEED), F.col("source"), F.col("shard")), blocks)
    drawn = placed.withColumns({"at": at, "blocks": blocks, "first": first, "times": F.floor(F.col("quota") / blocks)})
    end, last = F.col("at") + F.col("size"), F.col("first") + F.col("quota") - F.col("times") * F.col("blocks")
    zero = F.lit(0).cast("long")
    # From the first block drawn onwards; what goes past the last block begins again at block 0.
    upto = F.least(last * BLOCK_WORDS, F.col("shard_words"))
    again = F.greatest(last - F.col("blocks"), zero) * BLOCK_WORDS
    a, c = F.greatest(F.col("at"), F.col("first") * BLOCK_WORDS), F.col("at")
    main, wrapped = F.greatest(F.least(end, upto) - a, zero), F.greatest(F.least(end, again) - c, zero)
    known = lambda x: F.coalesce(x, zero).cast("long")
    cut = drawn.withColumns({"times": known(F.col("times")), "main": known(main), "wrapped": known(wrapped),
                             "a": known(a - F.col("at")), "c": zero})
    words = F.col("times") * F.col("size") + F.col("main") + F.col("wrapped")
    return cut.withColumn("taken", words).drop("draw", "place", "shard", "shard_words", "quota", "at", "blocks", "first")


def mix(docs: DataFrame) -> DataFrame:
    """`doc_id`, `size`, `source_size`, `target`, `taken` and its parts for each row of `docs` (`doc_id`, `source`, `text`)."""
    return taken(stored(sized(docs), "sizes")).drop("source")


def words_between(text: str, first: int, n: int) -> str:
    """`n` words of a text from the given one on, with what is between them."""
    found = [m.span() for m in re.finditer(r"[^\x20\x09-\x0d]+", text)]
    return text[found[first][0] : found[first + n - 1][1]]


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mixture itself, with all columns of `docs`: a row for each time a document is taken, whole or in part.

    `n_chars`, where there is one, is that of the row's text.
    """
    columns = docs.columns
    rows = taken(stored(sized(docs, whole_row(columns).alias("row")), "mix-rows")).where("taken > 0")
    schema = docs.schema

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, kind = [], batch.schema.field("row").type
            for r in batch.to_pylist():
                row, parts = r["row"], [(r["a"], r["main"]), (r["c"], r["wrapped"])]
                whole = r["times"] + sum(n == r["size"] for _, n in parts)
                out += [row] * whole
                for first, n in parts:
                    if 0 < n < r["size"]:
                        text = words_between(row["text"], first, n)
                        out.append(row | {"text": text} | ({"n_chars": len(text)} if "n_chars" in row else {}))
            yield pa.RecordBatch.from_struct_array(pa.array(out, kind))

    return rows.select("row", "size", "times", "main", "wrapped", "a", "c").mapInArrow(written, schema)
