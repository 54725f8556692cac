"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are
context, and its text alone is trainable. Turns after the last assistant turn, or
all of a conversation without one, are kept as a record with nothing trainable.

The records of a conversation are prefixes of one rendering. `write` keeps each
turn once (`turns`) and a row per record that says how far its prefix reaches and
which part is trainable (`records`); this grows with the conversations, not with
the square of their length, and is the form for very long ones. `expand` makes
the examples themselves of it (`examples`): every record's whole text, in pieces
of whole turns of about `PIECE_CHARS` code points, with the trainable span marked
in the last piece. No conversation is gathered: its rendering is cut to pieces
first, and a record meets the pieces before its end in an equality join.

A turn is rendered as `<turn>ROLE<says>TEXT</turn>`. In roles and texts a backslash
stands before each backslash and before each of these three marks, so no text can
pass for a mark, and taking the backslashes away gives the text back.

Turns are ordered by `turn`, then role and text. NULL roles and texts are empty; a
NULL conv_id is a conversation like any other; repeated rows are turns of their own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lendlane.llm.common import shuffle_partitions

OPEN, SAYS, CLOSE = "<turn>", "<says>", "</turn>"
ASSISTANT = "assistant"
RECORDS = "conv_id long, record long, n_turns long, start long, chars long, loss_start long, loss_end long, final boolean"
TURNS = "conv_id long, position long, start long, rendered string"
EXAMPLES = "conv_id long, record long, n_turns long, piece long, text string, loss_start int, loss_end int, final boolean"
# Code points from which a piece of an example is ended by the next turn.
PIECE_CHARS = 1 << 16
# A role or text: nothing in it is a mark unless a backslash stands before it.
INNER = r"((?:[^\\<]++|\\.|<(?!/?turn>|says>))*+)"
RENDERED = re.compile(f"{OPEN}{INNER}{SAYS}{INNER}{CLOSE}", re.DOTALL)


def escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in (OPEN, SAYS, CLOSE):
        out = F.replace(out, F.lit(mark), F.lit("\\" + mark))
    return out


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def parsed(rendered: str) -> Iterator[tuple[str, str]]:
    """Role and text of each rendered turn."""
    end = 0
    while end < len(rendered):
        found = RENDERED.match(rendered, end)
        if found is None:
            raise ValueError(f"no turn at code point {end} of a rendered text")
        yield unescaped(found[1]), unescaped(found[2])
        end = found.end()


def rendered_turns(conversations: DataFrame) -> DataFrame:
    """One row per turn: its place, its rendering, where that starts, and where its text starts in it."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    head = F.concat(F.lit(OPEN), escaped(F.col("role")), F.lit(SAYS))
    drawn = rows.select("*", F.length(head).cast("long").alias("lead"),
                        F.concat(head, escaped(F.col("text")), F.lit(CLOSE)).alias("rendered"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return drawn.select(
        "conv_id", (F.row_number().over(order) - 1).cast("long").alias("position"),
        F.coalesce(F.sum(F.length("rendered")).over(before), F.lit(0)).cast("long").alias("start"), "rendered", "lead",
        (F.col("role") == ASSISTANT).alias("target"), F.lead(F.lit(True)).over(order).isNull().alias("last"))


def write(conversations: DataFrame, folder: str) -> None:
    """Format all conversations into `folder`/turns and `folder`/records."""
    placed = f"{folder}/placed"
    rendered_turns(conversations).write.parquet(placed)
    rows = conversations.sparkSession.read.parquet(placed)
    # Half of the output is rows as they are; the other half a row for each record.
    rows.select("conv_id", "position", "start", "rendered").write.parquet(f"{folder}/turns")
    end = F.col("start") + F.length("rendered")
    loss = F.col("start") + F.col("lead")
    none = F.lit(None).cast("long")
    rows.where("target or last").select(
        "conv_id", F.col("position").alias("record"), (F.col("position") + 1).alias("n_turns"), "start", end.alias("chars"),
        F.when(F.col("target"), loss).otherwise(none).alias("loss_start"),
        F.when(F.col("target"), end - len(CLOSE)).otherwise(none).alias("loss_end"), F.col("last").alias("final"),
    ).write.parquet(f"{folder}/records")


def expand(spark: SparkSession, folder: str, piece_chars: int = PIECE_CHARS) -> None:
    """Write the examples of a formatted folder into `folder`/examples, a row for each piece of a record.

    `loss_start` and `loss_end` are places in the record's last piece, NULL elsewhere and where nothing
    is trainable; `final` marks the record that reaches to the end of its conversation. A piece
    begins where a turn does, so a turn is never cut. The rows are quadratic in a conversation's length, as examples are.
    """
    piece = F.floor(F.col("start") / piece_chars)
    ordered = F.sort_array(F.collect_list(F.struct("position", "rendered")))
    pieces = spark.read.schema(TURNS).parquet(f"{folder}/turns").groupBy(F.col("conv_id").alias("p_conv"), piece.alias("p_piece")).agg(
        F.min("start").alias("p_start"), F.array_join(F.transform(ordered, lambda t: t["rendered"]), "").alias("p_text"))
    # A record's last piece is the one its last turn is in; numbers between hold no piece where a turn is longer than one.
    records = spark.read.schema(RECORDS).parquet(f"{folder}/records").withColumn("last_piece", piece)
    wanted = records.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), "last_piece")))
    same = wanted["conv_id"].eqNullSafe(F.col("p_conv")) & (wanted["piece"] == F.col("p_piece"))
    is_last = F.col("piece") == F.col("last_piece")
    length = F.least(F.col("chars") - F.col("p_start"), F.length("p_text")).cast("int")
    place = lambda c: F.when(is_last, F.col(c) - F.col("p_start")).cast("int")
    wanted.join(pieces, same).select(
        "conv_id", "record", "n_turns", "piece", F.col("p_text").substr(F.lit(1), length).alias("text"),
        place("loss_start").alias("loss_start"), place("loss_end").alias("loss_end"), "final",
    ).write.parquet(f"{folder}/examples")


def examples(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of all examples that `expand` wrote."""
    return spark.read.schema(EXAMPLES).parquet(f"{folder}/examples")


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """What the written examples say of each conversation, read back: turns, their hash, the trainable text and its hash.

    All examples are read; of those that end before their conversation does, only the trainable text is moved.
    """
    rows = examples(spark, folder)
    return _hashed(rows.select(
        "conv_id", F.col("record").alias("first"), F.col("piece").alias("second"), F.when(F.col("final"), F.col("text")).alias("rendered"),
        _span("text", F.col("loss_start"), F.col("loss_end")).alias("loss"), F.length("text").cast("long").alias("chars")))


def prefix_digests(spark: SparkSession, folder: str) -> DataFrame:
    """The same from the turns and the records' spans alone, without examples; for conversations of any length."""
    turns = spark.read.schema(TURNS).parquet(f"{folder}/turns")
    records = spark.read.schema(RECORDS).parquet(f"{folder}/records").drop("start").withColumnRenamed("conv_id", "r_conv")
    same = turns["conv_id"].eqNullSafe(records["r_conv"]) & (turns["position"] == records["record"])
    return _hashed(turns.join(records, same, "left").select(
        "conv_id", F.col("position").alias("first"), F.lit(0).cast("long").alias("second"), "rendered",
        _span("rendered", F.col("loss_start") - F.col("start"), F.col("loss_end") - F.col("start")).alias("loss"),
        F.coalesce("chars", F.lit(0)).alias("chars")))


def _span(text: str, start: Column, end: Column) -> Column:
    return F.col(text).substr((start + 1).cast("int"), (end - start).cast("int"))


def _hashed(rows: DataFrame) -> DataFrame:
    """A row per conversation, of rows in order of `first` and `second`: `rendered` turns, `loss` text, `chars`.

    Rows stream through; nothing but two running hashes is held of a conversation.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        done: list[tuple] = []
        now = None

        def close():
            conv_id, n, turn_hash, loss, loss_hash, chars = now
            done.append((conv_id, n, turn_hash.hexdigest(), loss, loss_hash.hexdigest(), chars))

        def flushed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=names)
            done.clear()
            return out

        for batch in batches:
            for row in batch.to_pylist():
                if now is None or now[0] != row["conv_id"]:
                    if now is not None:
                        close()
                    now = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parsed(row["rendered"] or ""):
                    now[1] += 1
                    now[2].update(f"{role}\n{text}\n".encode())
                if row["loss"]:
                    loss = unescaped(row["loss"])
                    now[3] += len(loss)
                    now[4].update(loss.encode())
                now[5] += row["chars"]
            if len(done) >= 1000:
                yield flushed()
        if now is not None:
            close()
        if done:
            yield flushed()

    in_order = rows.repartition(shuffle_partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "first", "second")
    return in_order.mapInArrow(
        read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
