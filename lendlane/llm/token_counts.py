"""Token counts for a SentencePiece BPE vocabulary, by the whole-token shortcut.

Offline, from the vocabulary alone, it is shown which characters never stand
next to each other inside a piece; between such characters nothing can merge,
so a text falls into pre-tokens there, and the counts of pre-tokens add up. It is
also shown which vocabulary strings encode alone as one token, by encoding each
of them. A pre-token among these counts one without any merging; the rest is
merged by the library, once per worker and distinct string.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lendlane.llm.common import kept_by_worker, tokenizer_file

# Fixed value: how the library writes a blank.
BLANK = "▁"
# Bytes of strings remembered by a worker (each its text, an entry and a number); with more, it begins anew. A pre-token of a
# text without blanks may be a whole line: longer ones are not remembered.
MOST_BYTES = 256 << 20
LONGEST = 64
LIMIT = 4096
# A run of blanks and what follows it, or a line feed and what follows it.
PRE_TOKENS = re.compile(r" +[^ \n]*|\n[^ \n]*")


class TokenCounter:
    """Counts the library's tokens of whole texts."""

    def __init__(self, vocabulary: str = "piece_bpe_32k.model", most_bytes: int = MOST_BYTES):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=tokenizer_file(vocabulary))
        self.most_bytes = most_bytes
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())
                  if not (self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i))]
        #: Whether pre-tokens may be cut before a run of blanks, and around a line feed.
        self.separable = self._separable(pieces)
        #: Strings that, after a blank, are proven to encode as one token.
        self.whole = self._whole(pieces)
        self._forget()

    def _forget(self) -> None:
        self.counts = dict.fromkeys(self.whole, 1)
        #: An estimate of the bytes held beside the vocabulary's strings.
        self.held = 0

    def _separable(self, pieces: list[str]) -> bool:
        """No piece goes on with a blank after another character, none holds a line feed, and texts are not altered."""
        apart = not any(b == BLANK != a for piece in pieces for a, b in zip(piece, piece[1:]))
        unaltered = self.library.normalize("ﬁ \n  a ") == f"{BLANK}ﬁ{BLANK}\n{BLANK * 2}a{BLANK}"
        return apart and unaltered and not any("\n" in piece for piece in pieces)

    def _whole(self, pieces: list[str]) -> set[str]:
        strings = [p[1:] for p in pieces if p.startswith(BLANK) and BLANK not in p[1:] and len(p) > 1]
        return {s for s, ids in zip(strings, self.library.encode(strings, num_threads=1)) if len(ids) == 1}

    def _pre_tokens(self, text: str) -> list[str]:
        """What stands after each single blank; other pre-tokens with their line feed or all their blanks."""
        blanks = " " + text
        if "  " in blanks or BLANK in text:
            found = PRE_TOKENS.findall(blanks.replace(BLANK, " "))
            return [t[1:] if t[0] == " " != t[1:2] else t for t in found]
        # A text that begins with a line feed has the library's blank before it, here the empty string.
        return text.replace("\n", " \n").split(" ")

    def _merge(self, strings: list[str]) -> dict[str, int]:
        """Count by the library; it puts a blank before each string, which is one token where a line feed follows."""
        plain = [s[1:] if s[:1] == " " else s for s in strings]
        found = {s: len(ids) - (s[:1] == "\n") for s, ids in zip(strings, self.library.encode(plain, num_threads=1))}
        if "" in found:
            found[""] = 1  # a lone blank
        short = {s: n for s, n in found.items() if len(s) <= LONGEST}
        self.counts.update(short)
        self.held += sum(150 + (1 if s.isascii() else 4) * len(s) for s in short)
        return found

    def count(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text; NULL is an empty text, which has none."""
        if not self.separable:
            return [len(ids) for ids in self.library.encode([t or "" for t in texts], num_threads=1)]
        if self.held > self.most_bytes:
            self._forget()
        cut = [self._pre_tokens(t) if t else [] for t in texts]
        known = self.counts
        here = list(set().union(*cut))
        local = {s: known[s] for s in here if s in known}
        local |= self._merge([s for s in here if s not in local])
        return [sum(map(local.__getitem__, tokens)) for tokens in cut]


COUNTS = "doc_id long, n_bytes long, n_tokens long"


def count_tokens(docs: DataFrame, vocabulary: str = "piece_bpe_32k.model", limit: int = LIMIT) -> DataFrame:
    """`doc_id`, `n_bytes` (UTF-8), `n_tokens` and `over_limit` for each row of `docs` (`doc_id`, `text`).

    NULL and empty texts have no bytes and no tokens; repeated rows are counted each.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = kept_by_worker(f"counter {vocabulary}", lambda: TokenCounter(vocabulary))
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                some = batch.slice(start, 1000)
                n = counter.count(some.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id"), some.column("n_bytes"), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    return rows.mapInArrow(counted, COUNTS).withColumn("over_limit", F.col("n_tokens") > limit)
