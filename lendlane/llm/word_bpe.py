"""The word-end BPE of the `tokenizers` library over many texts: what a piece of a word becomes is asked once and remembered.

Texts are cut into pieces by numpy and numbered by Arrow, some megabytes at a time, together with the pieces that are known, so that no
piece becomes a Python object; the ids of all texts are then gathered from the distinct pieces' ids.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lendlane.llm.common import tokenizer_file

# Texts without any of these are cut into words here. No other character changes
# under NFC, each has one lower-case form, and their letters are Latin-1.
NOT_PLAIN = "[^\t\n\r -~À-ÖØ-öø-ÿ]"
# What a byte of a plain text in lower case is, as in the vocabulary's own pattern: 's|'t|'re|'ve|'m|'ll|'d|letters|one digit|others.
# All bytes of characters that take two are letters.
BLANK, LETTER, DIGIT, OTHER = range(4)
KIND = np.full(256, OTHER, dtype=np.uint8)
KIND[list(b"\t\n\r ")], KIND[list(b"0123456789")] = BLANK, DIGIT
KIND[ord("a") : ord("z") + 1] = KIND[0x80:] = LETTER
CONTRACTED = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")
# Begins each special token of the vocabulary, which the library cuts out of the raw text.
SPECIAL = "<|"
# Bytes of pieces and ids that a worker remembers; with more, it forgets those used least, down to half. All of them are numbered anew
# with each few megabytes of texts. Longer pieces, in bytes, are not remembered.
MOST_BYTES = 32 << 20
LONGEST_WORD = 64
TEXTS_AT_ONCE = 2000
BYTES_AT_ONCE = 3_000_000


def gathered(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Some runs of `values`, one after the other."""
    places = np.cumsum(lengths, dtype=np.int64)
    total = int(places[-1]) if len(places) else 0
    # How far each run moves, in place of where it ends.
    np.subtract(starts, places, out=places)
    places += lengths
    places = np.repeat(places, lengths)
    places += np.arange(total)
    return values[places]


def cut(data: np.ndarray, bounds: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The pieces of plain texts in lower case, one after the other, and how many come before each text and after the last."""
    kind = KIND[data]
    begins = np.ones(len(data), dtype=bool)
    np.not_equal(kind[1:], kind[:-1], out=begins[1:])
    begins |= kind == DIGIT
    begins[bounds[bounds < len(data)]] = True
    # An apostrophe alone takes what is contracted after it, in its own text.
    marks = np.flatnonzero(data == ord("'"))
    marks = marks[begins[marks]]
    ends = bounds[np.searchsorted(bounds, marks, side="right")]
    for letters in CONTRACTED:
        at = marks[marks + len(letters) < ends]
        for k, letter in enumerate(letters, 1):
            at = at[data[at + k] == letter]
        begins[at + 1] = False
        after = at + len(letters) + 1
        begins[after[after < len(data)]] = True
    is_kept = kind != BLANK
    begins &= is_kept
    upto = np.searchsorted(np.flatnonzero(begins), bounds)
    kept = data[is_kept]
    offsets = np.full(upto[-1] + 1, len(kept), dtype=np.int32)
    offsets[:-1] = np.flatnonzero(begins[is_kept])
    return pa.Array.from_buffers(pa.string(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(kept)]), upto


class WordBpe:
    """Ids of whole texts, exactly as the library gives them."""

    def __init__(self, vocabulary: str = "word_bpe_49k.json", most_bytes: int = MOST_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        path = tokenizer_file(vocabulary)
        self.whole = Tokenizer.from_file(path)
        # The same model for words that are cut, lower-cased and spelled in the library's letters for bytes, with blanks between them.
        self.words = Tokenizer.from_file(path)
        self.words.normalizer = normalizers.Sequence([])
        self.words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        letters = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        #: The letter that stands for each byte of the characters that occur; a blank stays one.
        self.spelled = np.arange(256, dtype="<u4")
        for c in range(0xC0, 0x100):
            self.spelled[list(chr(c).encode())] = [ord(x) for x in letters.pre_tokenize_str(chr(c))[0][0]]
        # Only the last token of a word carries the word-end mark.
        ids = self.words.get_vocab()
        self.is_last = np.zeros(max(ids.values()) + 1, dtype=bool)
        self.is_last[[i for token, i in ids.items() if token.endswith(self.words.model.end_of_word_suffix)]] = True
        self.most_bytes = most_bytes
        self._forget()

    def _forget(self) -> None:
        #: Distinct pieces; of each, where its ids begin, how many they are, and how often it was used.
        self.pieces = pa.array([], pa.string())
        self.values = np.empty(0, dtype="<u4")
        self.starts, self.lengths, self.uses = (np.empty(0, dtype=t) for t in (np.int64, np.int32, np.int64))
        #: An estimate of the bytes held: a string, its place while it is numbered, its ids.
        self.held = 0

    @property
    def known(self) -> list[str]:
        return self.pieces.to_pylist()

    def _library(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces by the library, one after the other, and how many each has."""
        if not len(pieces):
            return np.empty(0, dtype="<u4"), np.empty(0, dtype=np.int32)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(pieces)], pa.int32()), pieces), " ")[0].as_py()
        if not joined.isascii():
            joined = self.spelled[np.frombuffer(joined.encode(), dtype=np.uint8)].tobytes().decode("utf-32-le")
        ids = np.array(self.words.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = np.flatnonzero(self.is_last[ids]) + 1
        if len(ends) != len(pieces):
            raise ValueError("the vocabulary does not mark the ends of words")
        return ids, np.diff(ends, prepend=0).astype(np.int32)

    def _remember(self, pieces: pa.Array, values: np.ndarray, starts: np.ndarray, lengths: np.ndarray, uses: np.ndarray) -> None:
        """Keep these pieces and their ids instead of those known; if they are too many, the most used ones."""
        size = pc.binary_length(pieces).to_numpy(zero_copy_only=False).astype(np.int64)
        rows = np.flatnonzero(size <= LONGEST_WORD)
        size += 60 + 4 * lengths.astype(np.int64)
        if size[rows].sum() > self.most_bytes:
            rows = rows[np.argsort(-uses[rows], kind="stable")]
            rows = np.sort(rows[np.cumsum(size[rows]) <= self.most_bytes // 2])
            uses = uses // 2
        if len(rows) < len(pieces):
            pieces, values, lengths, uses = pieces.take(pa.array(rows)), gathered(values, starts[rows], lengths[rows]), lengths[rows], uses[rows]
            starts = np.cumsum(lengths, dtype=np.int64) - lengths
        self.pieces, self.values, self.starts, self.lengths, self.uses = pieces, values, starts, lengths, uses
        self.held = int(size[rows].sum())

    def _ids_of(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of pieces: a pool of ids, and where each piece's begin and how many they are."""
        n_known = len(self.pieces)
        # The pieces that are known come first, so that they keep their numbers.
        encoded = pa.concat_arrays([self.pieces, pieces]).dictionary_encode()
        at, distinct = np.asarray(encoded.indices)[n_known:], encoded.dictionary
        fresh, n_fresh = self._library(distinct.slice(n_known))
        pool = np.concatenate([self.values, fresh])
        starts = np.concatenate([self.starts, len(self.values) + np.cumsum(n_fresh, dtype=np.int64) - n_fresh])
        lengths = np.concatenate([self.lengths, n_fresh])
        uses = np.bincount(at, minlength=len(distinct))
        uses[:n_known] += self.uses
        self._remember(distinct, pool, starts, lengths, uses)
        return pool, starts[at], lengths[at]

    def _some(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        odd = pc.or_(pc.match_substring_regex(texts, NOT_PLAIN), pc.match_substring(texts, SPECIAL)).to_numpy(zero_copy_only=False)
        plain = pc.utf8_lower(pc.if_else(pa.array(odd), "", texts) if odd.any() else texts).cast(pa.string())
        bounds = np.frombuffer(plain.buffers()[1], dtype=np.int32, count=len(plain) + 1, offset=4 * plain.offset).astype(np.int64)
        data = np.frombuffer(plain.buffers()[2] or b"", dtype=np.uint8)[bounds[0] : bounds[-1]]
        pieces, upto_text = cut(data, bounds - bounds[0])
        pool, start, length = self._ids_of(pieces)
        del pieces
        counts = np.diff(np.concatenate([[0], np.cumsum(length)])[upto_text])
        ids = gathered(pool, start, length)
        if odd.any():
            found = [np.array(e.ids, dtype="<u4") for e in self.whole.encode_batch(texts.filter(pa.array(odd)).to_pylist(), add_special_tokens=False)]
            counts[odd] = [len(f) for f in found]
            together = np.empty(int(counts.sum()), dtype="<u4")
            is_odd = np.repeat(odd, counts)
            together[~is_odd] = ids
            together[is_odd] = np.concatenate(found)
            ids = together
        return ids, counts

    def encode_arrays(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each text has; NULL is an empty text."""
        texts = pc.fill_null(texts, "")
        size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        ids, counts, begin = [np.empty(0, dtype="<u4")], [np.empty(0, dtype=np.int64)], 0
        while begin < len(texts):
            before = size[begin - 1] if begin else 0
            end = int(np.searchsorted(size, before + BYTES_AT_ONCE, side="left"))
            end = min(max(end, begin + 1), begin + TEXTS_AT_ONCE, len(texts))
            some = self._some(texts.slice(begin, end - begin))
            ids.append(some[0])
            counts.append(some[1])
            begin = end
        return np.concatenate(ids), np.concatenate(counts)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        ids, counts = self.encode_arrays(pa.array(texts, pa.string()))
        raw, ends = ids.tobytes(), (4 * np.cumsum(counts)).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same ids with an end id after each text."""
    counts = counts + 1
    out = np.empty(int(counts.sum()), dtype="<u4")
    ends = np.cumsum(counts) - 1
    is_end = np.zeros(len(out), dtype=bool)
    is_end[ends] = True
    out[is_end], out[~is_end] = end_id, ids
    return out, counts
