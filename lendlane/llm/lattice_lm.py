"""Language-model scores by subword lattice likelihood.

A text is its words, lower-cased A-Z, and one end. The strings of an existing subword
vocabulary have unigram scores; the probability of a word is the sum, over all its
segmentations into these strings, of the product of their probabilities, found by
a forward recursion in log space. A character that no string covers is spelled by
the vocabulary's 256 byte pieces, so every word has a probability.

The scores are log10((c + 0.5) / (n + 0.5 v)): c counts a string in the library's own segmentation of
all training words, n all strings and ends there, v is the number of scored strings.

Beside it stands a word unigram score. Both need the count of every word in the
training rows. A word's probabilities are worked out once, in the table of distinct words. Words
that make up at least a `HEAD`-th of all training words (so at most `HEAD` of
them) go to all tasks; occurrences of the others, added up per document, are joined with the table.

NULL and empty texts are one end. Repeated rows are scored each. Without training rows every count is 0.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lendlane.llm.common import held_out, kept_by_worker, stored, tokenizer_file

HEAD = 100_000
# Bytes of distinct words, or of words with their counts, that a task holds before it hands them on: for each an entry and
# a text of that length, and whatever longer words have beyond.
BYTES_AT_ONCE = 96 << 20
ENTRY, USUAL = 150, 64
# Fixed value: how the library writes a blank.
BLANK = "▁"
END = "</s>"


class Vocabulary:
    """The strings of a SentencePiece vocabulary that segment words, and the library's own segmentation."""

    def __init__(self, name: str = "piece_bpe_32k.model"):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=tokenizer_file(name))
        size = range(self.library.get_piece_size())
        self.pieces = [self.library.id_to_piece(i) for i in size]
        self.usable = [not (self.library.is_control(i) or self.library.is_unknown(i)) for i in size]
        self.byte_id = {int(self.pieces[i][3:5], 16): i for i in size if self.library.is_byte(i)}

    def segment(self, words: list[str]) -> list[list[int]]:
        return self.library.encode(words, num_threads=1)


class Lattice:
    """Log10 probabilities of words under given piece scores."""

    def __init__(self, vocabulary: Vocabulary, scores: np.ndarray):
        natural = scores * math.log(10)
        self.score = {p: float(natural[i]) for i, (p, ok) in enumerate(zip(vocabulary.pieces, vocabulary.usable))
                      if ok and i not in vocabulary.byte_id.values()}
        self.byte = [float(natural[vocabulary.byte_id[b]]) for b in range(256)]
        self.longest = max(map(len, self.score))

    def word(self, word: str) -> float:
        """The forward recursion: at each place the log probability of all ways to get there."""
        text, score = BLANK + word, self.score
        n, log, exp = len(text), math.log, math.exp
        reach = [0.0] + [None] * n
        for i in range(n):
            here = reach[i]  # never None: each character can be spelled
            top = min(n, i + self.longest)
            spelled = score.get(text[i])
            if spelled is None:
                spelled = 0.0
                for b in text[i].encode():
                    spelled += self.byte[b]
            step = here + spelled
            for j in range(i + 1, top + 1):
                if j > i + 1:
                    s = score.get(text[i:j])
                    if s is None:
                        continue
                    step = here + s
                known = reach[j]
                if known is None:
                    reach[j] = step
                elif known > step:
                    reach[j] = known + log(1.0 + exp(step - known))
                else:
                    reach[j] = step + log(1.0 + exp(known - step))
        return reach[n] / math.log(10)


def tokens(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text: A-Z lowered, cut at the six ASCII blanks and nowhere else."""
    return (text or b"").lower().split()


def _rows(docs: DataFrame, folds: int) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"),
        held_out(F.col("doc_id"), folds).alias("held_out"))


def word_counts(rows: DataFrame) -> DataFrame:
    """Every distinct word of all rows and its count in the training rows."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        train: Counter = Counter()
        other: set[bytes] = set()
        beyond = 0

        def handed_on() -> pa.RecordBatch:
            words = list(train) + list(other.difference(train))
            n = list(train.values()) + [0] * (len(words) - len(train))
            train.clear()
            other.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(n, pa.int64())], names=["word", "n"])

        for batch in batches:
            for text, out in zip(batch.column("text"), batch.column("held_out").to_pylist()):
                raw = text.as_py() or b""
                found = tokens(raw)
                (other if out else train).update(found)
                beyond += max(0, len(raw) - USUAL * len(found))
                if (ENTRY + USUAL) * (len(train) + len(other)) + beyond > BYTES_AT_ONCE:
                    yield handed_on()
                    beyond = 0
        yield handed_on()

    found = rows.select("text", "held_out").mapInArrow(counted, "word binary, n long")
    return found.groupBy("word").agg(F.sum("n").alias("c"))


def piece_scores(words: DataFrame, ends: int, vocabulary: str) -> np.ndarray:
    """Log10 probability of every piece, from the library's segmentation of the counted words. As long as the vocabulary."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = kept_by_worker(f"pieces {vocabulary}", lambda: Vocabulary(vocabulary))
        total = np.zeros(len(pieces.pieces), dtype=np.int64)
        for batch in batches:
            ids = pieces.segment([w.decode(errors="replace") for w in batch.column("word").to_pylist()])
            each = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter((i for s in ids for i in s), np.int64, int(each.sum()))
            np.add.at(total, flat, np.repeat(batch.column("c").to_numpy(), each))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["piece", "n"])

    found = words.where("c > 0").mapInArrow(counted, "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    pieces = Vocabulary(vocabulary)
    total = np.zeros(len(pieces.pieces), dtype=np.float64)
    for r in found.collect():  # at most one row for each string of the vocabulary
        total[r.piece] = r.n
    end = pieces.pieces.index(END)
    total[end] = ends
    scored = np.array(pieces.usable)
    scored[end] = True
    return np.log10((total + 0.5) / (total[scored].sum() + 0.5 * scored.sum()))


def scored_words(words: DataFrame, scores: np.ndarray, vocabulary: str, n_train: int, n_distinct: int) -> DataFrame:
    """`word`, `c`, and the word's log10 probability as a word (`base`) and from its lattice (`lattice`)."""
    shared = words.sparkSession.sparkContext.broadcast(scores)
    below = math.log10(n_train + 0.5 * (n_distinct + 1))

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = kept_by_worker(f"pieces {vocabulary}", lambda: Vocabulary(vocabulary))
        lattice = Lattice(pieces, shared.value)
        for batch in batches:
            found = [lattice.word(w.decode(errors="replace")) for w in batch.column("word").to_pylist()]
            base = np.log10(batch.column("c").to_numpy() + 0.5) - below
            yield pa.RecordBatch.from_arrays(
                [batch.column("word"), batch.column("c"), pa.array(base), pa.array(found, pa.float64())],
                names=["word", "c", "base", "lattice"])

    return words.select("word", "c").mapInArrow(weighed, "word binary, c long, base double, lattice double")


def score(docs: DataFrame, vocabulary: str = "piece_bpe_32k.model", folds: int = 5, head: int = HEAD) -> DataFrame:
    """For each row of `docs` (`doc_id`, `text`) its `n_tokens`, `n_known`, `train_tokens`, `base_score` and `score`.

    Rows are told apart by their place in the input, so `docs` is a scan or a stored table: run again, it must give the same
    rows in the same places.
    """
    spark = docs.sparkSession
    rows = _rows(docs, folds)
    words = stored(word_counts(rows), "words")
    ends = rows.where(~F.col("held_out")).count()
    sums = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum((F.col("c") > 0).cast("long")), F.lit(0))).first()
    n_train, n_distinct = sums[0] + ends, sums[1] + (ends > 0)
    scores = piece_scores(words, ends, vocabulary)
    scored = lambda w: scored_words(w, scores, vocabulary, n_train, n_distinct)
    # Each has at least a `head`-th of all training words, so there are at most `head`.
    common = words.where((F.col("c") > 0) & (F.col("c") * F.lit(head) >= F.lit(n_train)))
    known = {bytes(r.word): (r.base, r.lattice) for r in scored(common).collect()}
    shared = spark.sparkContext.broadcast(known)
    end_base = math.log10((ends + 0.5) / (n_train + 0.5 * (n_distinct + 1)))
    end_lattice = float(scores[Vocabulary(vocabulary).pieces.index(END)])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value.get
        for batch in batches:
            keys, others, times, info = [], [], [], []
            beyond = 0

            def handed_on() -> pa.RecordBatch:
                out = [pa.array(keys, pa.int64()), pa.array(others, pa.binary()), pa.array(times, pa.int64()), pa.array(info, shape)]
                for column in (keys, others, times, info):
                    column.clear()
                return pa.RecordBatch.from_arrays(out, names=["key", "word", "n", "doc"])

            for key, doc_id, text, out in zip(*(batch.column(c) for c in ("key", "doc_id", "text", "held_out"))):
                key, raw = key.as_py(), text.as_py() or b""
                found = Counter(tokens(raw))
                beyond += max(0, len(raw) - USUAL * len(found))
                base, lattice, n_tokens, n_known = end_base, end_lattice, 1, int(ends > 0)
                for word, n in found.items():
                    n_tokens += n
                    both = of(word)
                    if both is None:
                        keys.append(key)
                        others.append(word)
                        times.append(n)
                        info.append(None)
                    else:
                        base += n * both[0]
                        lattice += n * both[1]
                        n_known += n
                # The document's own row. No word has a blank, so it meets none in the join, and no two meet in a task.
                keys.append(key)
                others.append(b" %d" % key)
                times.append(0)
                info.append({"doc_id": doc_id.as_py(), "held_out": int(out.as_py()), "n_tokens": n_tokens,
                             "n_known": n_known, "base": base, "lattice": lattice})
                if (ENTRY + USUAL) * len(keys) + beyond > BYTES_AT_ONCE // 2:
                    yield handed_on()
                    beyond = 0
            yield handed_on()

    shape = pa.struct([("doc_id", pa.int64()), ("held_out", pa.int32()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                       ("base", pa.float64()), ("lattice", pa.float64())])
    kind = "struct<doc_id: long, held_out: int, n_tokens: long, n_known: long, base: double, lattice: double>"
    cut = rows.withColumn("key", F.monotonically_increasing_id()).mapInArrow(split, f"key long, word binary, n long, doc {kind}")
    met = cut.join(scored(words), "word", "left")
    times = lambda c: F.col("n") * F.col(c)
    parts = met.select(
        "key", "doc.doc_id", "doc.held_out", "doc.n_tokens",
        F.coalesce("doc.n_known", F.when(F.col("c") > 0, F.col("n")).otherwise(F.lit(0))).alias("n_known"),
        F.coalesce("doc.base", times("base")).alias("base"), F.coalesce("doc.lattice", times("lattice")).alias("lattice"))
    whole = parts.groupBy("key").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"),
        F.sum("n_known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("lattice").alias("score"))
    return whole.select(
        "doc_id", (F.col("held_out") == 1).alias("held_out"), "n_tokens", "n_known",
        F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score")
