"""Fill-in-middle transformation, cutting texts by a learned rank index over their token boundaries.

A token is a word with the blanks before it; blanks at the end of a text are one more. The
offsets of all boundaries of many texts, laid end to end, ascend almost in a line. `RankIndex`
fits line segments to them, each as long as no offset is further than a set error from it, and
keeps what is missing to each offset as a residual of one byte. The offset of any boundary is
the segment's prediction plus that residual, exactly; the offsets themselves are not kept.

Where a text is cut depends on its id and a seed only, so a lost task cuts again in the same places.

NULL is an empty text; empty texts and texts that hold one of the marks stay plain. A NULL id is
written as an empty string where cuts are drawn. Repeated rows are cut alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

# The marks before prefix, suffix and middle, the seed, and the shares in percent.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
FIM_PERCENT = 50
SPM_PERCENT = 80
# The furthest an offset may be from its segment; residuals have a byte.
ERROR = 100
# Offsets tried at first when a segment is drawn out.
TRIED_AT_ONCE = 256
# Characters and texts of one index; a longer text has an index of its own.
CHARACTERS_AT_ONCE = 2_000_000
TEXTS_AT_ONCE = 4096


class RankIndex:
    """Ascending offsets by rank, as line segments and one signed byte each."""

    def __init__(self, offsets: np.ndarray, error: int = ERROR):
        if not 0 < error < 127:
            raise ValueError("residuals must fit a signed byte")
        first, slope = [], []
        begin = 0
        while begin < len(offsets):
            stop, tilt = self._drawn_out(offsets, begin, error)
            first.append(begin)
            slope.append(tilt)
            begin = stop
        self.first = np.array(first, dtype=np.int64)
        self.base = offsets[self.first] if first else np.empty(0, dtype=np.int64)
        self.slope = np.array(slope, dtype=np.float64)
        self.residual = (offsets - self.predict(np.arange(len(offsets)))).astype(np.int8)

    @staticmethod
    def _drawn_out(offsets: np.ndarray, begin: int, error: int) -> tuple[int, float]:
        """Where the longest segment from `begin` stops, and its slope: the cone of slopes that miss no offset narrows."""
        low, high = 0.0, np.inf
        at, width = begin + 1, TRIED_AT_ONCE
        while at < len(offsets):
            some = offsets[at : at + width] - offsets[begin]
            run = np.arange(at - begin, at - begin + len(some))
            lows = np.maximum(np.maximum.accumulate((some - error) / run), low)
            highs = np.minimum(np.minimum.accumulate((some + error) / run), high)
            missed = lows > highs
            if missed.any():
                k = int(missed.argmax())
                if k:
                    low, high = lows[k - 1], highs[k - 1]
                at += k
                break
            low, high = lows[-1], highs[-1]
            at, width = at + len(some), 2 * width
        return at, 0.0 if high == np.inf else (low + high) / 2

    def predict(self, ranks: np.ndarray) -> np.ndarray:
        """Offsets by the segments alone."""
        s = np.searchsorted(self.first, ranks, side="right") - 1
        return self.base[s] + np.rint(self.slope[s] * (ranks - self.first[s])).astype(np.int64)

    def offsets(self, ranks: np.ndarray) -> np.ndarray:
        """Exact offsets."""
        return self.predict(ranks) + self.residual[ranks]


def boundaries(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Offsets in code points of all token boundaries of the texts laid end to end, and the number of tokens of each.

    A text with n tokens has n + 1 boundaries, its beginning among them.
    """
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    stop = np.cumsum(length)
    blank = (codes == 0x20) | ((codes >= 0x09) & (codes <= 0x0D))
    ends_token = np.zeros(len(codes), dtype=bool)
    ends_token[:-1] = ~blank[:-1] & blank[1:]
    ends_token[stop[length > 0] - 1] = True
    ends = np.flatnonzero(ends_token) + 1
    n = np.searchsorted(ends, stop, side="right")
    n = np.diff(n, prepend=0)
    first = np.cumsum(n + 1) - (n + 1)
    offsets = np.empty(len(ends) + len(texts), dtype=np.int64)
    is_start = np.zeros(len(offsets), dtype=bool)
    is_start[first] = True
    offsets[is_start] = stop - length
    offsets[~is_start] = ends
    return offsets, n


def cuts(texts: list[str], draws: list[np.ndarray], error: int = ERROR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of each text, and how many code points its prefix, and prefix and middle, have; by two draws each."""
    offsets, n = boundaries(texts)
    index = RankIndex(offsets, error)
    first = np.cumsum(n + 1) - (n + 1)
    one, two = (np.asarray(d, dtype=np.int64) % (n + 1) for d in draws)
    begin = index.offsets(first)
    a, b = (index.offsets(first + rank) - begin for rank in (np.minimum(one, two), np.maximum(one, two)))
    return n, a, b


def drawn(doc_id: Column, seed: int, number: int) -> Column:
    """The `number`-th group of eight hexadecimal digits of sha256 over seed and id, as a number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(digest, 8 * number + 1, 8), 16, 10).cast("long")


SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def fill_in_middle(docs: DataFrame, seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT,
                   error: int = ERROR) -> DataFrame:
    """`doc_id`, `n` (tokens), `form`, `prefix_chars`, `middle_chars` (NULL if plain) and `output` for each row of `docs`.

    `docs` has `doc_id` and `text`. Form is `plain`, `psm` (prefix, suffix, middle) or `spm` (suffix first).
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.asarray(batch.column("n_chars"))
            begin = 0
            while begin < batch.num_rows:
                upto = np.cumsum(lengths[begin : begin + TEXTS_AT_ONCE])
                some = batch.slice(begin, max(1, int(np.searchsorted(upto, CHARACTERS_AT_ONCE))))
                begin += some.num_rows
                texts, forms = some.column("text").to_pylist(), some.column("form").to_pylist()
                n, a, b = cuts(texts, [np.asarray(some.column(c)) for c in ("h1", "h2")], error)
                output = []
                for text, form, i, j in zip(texts, forms, a.tolist(), b.tolist()):
                    if form == "psm":
                        text = f"{PREFIX}{text[:i]}{SUFFIX}{text[j:]}{MIDDLE}{text[i:j]}"
                    elif form == "spm":
                        text = f"{SUFFIX}{text[j:]}{PREFIX}{text[:i]}{MIDDLE}{text[i:j]}"
                    output.append(text)
                plain = np.array([f == "plain" for f in forms], dtype=bool)
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id"), pa.array(n), some.column("form"), pa.array(a, mask=plain), pa.array(b - a, mask=plain),
                     pa.array(output, pa.string())],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    doc_id, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    plain = (text == "") | marked | (drawn(doc_id, seed, 2) % 100 >= fim_percent)
    form = F.when(plain, "plain").when(drawn(doc_id, seed, 3) % 100 < spm_percent, "spm").otherwise("psm")
    rows = docs.select(
        doc_id.alias("doc_id"), text.alias("text"), F.length(text).alias("n_chars"), form.alias("form"),
        drawn(doc_id, seed, 0).alias("h1"), drawn(doc_id, seed, 1).alias("h2"))
    return rows.mapInArrow(cut, SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from. Outputs that are not plain hold each mark once."""
    before = lambda mark: F.substring_index(output, mark, 1)
    after = lambda mark: F.substring_index(output, mark, -1)
    skip = lambda text, mark: F.substr(text, F.lit(len(mark) + 1))
    psm = F.concat(skip(before(SUFFIX), PREFIX), after(MIDDLE), F.substring_index(after(SUFFIX), MIDDLE, 1))
    spm = F.concat(F.substring_index(after(PREFIX), MIDDLE, 1), after(MIDDLE), skip(before(PREFIX), SUFFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
