"""Language identification by a linear-chain conditional random field over words.

Each word of a text gets a label. A word's scores come from its affixes, its
letter n-grams, the word itself, and a lexicon that says which language used a
word how clearly; learned transitions tie neighbouring words, so a few ambiguous
words take the language around them while a real switch within a text is
followed. Forward-backward gives each word's probability of each label; a
document's score for a language is the mean over its words.

Every label is learned. Learning uses a bounded sample: at most `DOCS_PER_LABEL` documents of each label, drawn for each
label by a hash of id and text (rows that are equal in both count once), fewer where there are more than `FULL_LABELS` labels, which also get fewer slots
(`sample_size`, `slot_bits`), so that the field and its fitting stay bounded; and from each at most `SEGMENTS` runs of `SEGMENT_WORDS` words. Half of the runs
make the lexicon; the others are strung together across languages, as in
code-switched text, and the field is fitted to them by full-batch gradient steps.

A text that is NULL, empty or without letters has label `und` and score 0, and so
has every text if there is nothing to learn from. Words are runs of letters, in
lower case; other characters play no part. Repeated rows are judged each.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from lendlane.llm.common import held_out, kept_by_worker

UNDETERMINED = "und"
# The bound of the sample.
DOCS_PER_LABEL = 300
SEGMENTS = 6
SEGMENT_WORDS = 20
# Up to this many labels have all slots and documents.
FULL_LABELS = 32
LEAST_DOCS = 4
# Weights are kept in 2 to this power slots by hash.
SLOT_BITS = 17
LEAST_SLOT_BITS = 12
LEXICON_BINS = 4
STEPS = 40
RATE = 0.3
PENALTY = 1e-4
SEED = 11
DRAWS = 1 << 40
# Words a worker remembers, none longer than that; tokens it works on at once.
MOST_WORDS = 300_000
LONGEST_WORD = 64
TOKENS_AT_ONCE = 250_000
# Pairs of labels worked on at once.
PAIRS_AT_ONCE = 1 << 24
BLOCK = 32
# With more labels than this a block's product costs more than it saves, and texts are gone through word by word, side by side.
BLOCKED_LABELS = 24
# Numbers gathered at once while the scores of words are added up.
GATHERED_AT_ONCE = 1 << 24

LETTERS = re.compile(r"[^\W\d_]+")
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


def slot_bits(n_labels: int) -> int:
    """Slots are halved with each doubling of the labels beyond `FULL_LABELS`."""
    return max(LEAST_SLOT_BITS, SLOT_BITS - max(0, (n_labels - 1) // FULL_LABELS).bit_length())


def sample_size(n_labels: int, docs_per_label: int) -> int:
    """Documents a label: words times labels stay bounded, down to `LEAST_DOCS` documents."""
    return min(docs_per_label, max(LEAST_DOCS, docs_per_label * FULL_LABELS**2 // n_labels**2))


def features(words: list[str], bits: int = SLOT_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all features of each word, one after the other, and where each word's begin.

    n-grams of one to four letters with the word's ends marked, prefixes and
    suffixes of one to four, and the whole word, each hashed with its kind.
    """
    marked = "".join([f"^{w}$" for w in words])
    codes = np.frombuffer(marked.encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    length = np.fromiter(map(len, words), np.int64, len(words)) + 2
    start = np.cumsum(length) - length
    owner = np.repeat(np.arange(len(words)), length)
    place = np.arange(len(codes)) - start[owner]
    left = length[owner] - place  # characters from here to the word's end
    slots, owners = [], []

    def add(kind: int, values: np.ndarray, of: np.ndarray) -> None:
        mixed = (values + np.uint64(kind)) * _PRIME
        slots.append(((mixed ^ (mixed >> np.uint64(29))) * _PRIME >> np.uint64(64 - bits)).astype(np.int64))
        owners.append(of)

    gram = np.zeros(len(codes), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, 5):
            shifted = np.zeros_like(codes)
            shifted[: len(codes) - n + 1] = codes[n - 1 :]
            gram = gram * np.uint64(0x100000001B3) + shifted
            inside = left >= n
            add(n, gram[inside], owner[inside])
            head = inside & (place == 1) & (left > n)
            add(10 + n, gram[head], owner[head])
            tail = (left == n + 1) & (place >= 1)
            add(20 + n, gram[tail], owner[tail])
        powers = np.cumprod(np.full(int(length.max(initial=1)), 0x100000001B3, dtype=np.uint64))
        whole = np.add.reduceat(codes * powers[place], start) if len(words) else gram
        add(30, whole, np.arange(len(words)))
    slot, of = np.concatenate(slots), np.concatenate(owners)
    order = np.argsort(of, kind="stable")
    return slot[order], np.searchsorted(of[order], np.arange(len(words)))


@dataclass
class Field:
    """A fitted field. `emission` has a row of scores per slot, then one per lexicon class; scores are per label."""

    labels: list[str]
    emission: np.ndarray
    transition: np.ndarray
    begin: np.ndarray
    lexicon: dict[str, int] = field(default_factory=dict)

    def scores(self, words: list[str]) -> np.ndarray:
        slot, start = features(words, slot_bits(len(self.labels)))
        out = _added(self.emission, slot, start)
        slots = 1 << slot_bits(len(self.labels))
        return out + self.emission[slots + np.fromiter((self.lexicon.get(w, 0) for w in words), np.int64, len(words))]

    def marginals(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Label probabilities of all words of several texts, whose words follow one another in `scores`.

        Texts are cut into blocks. A block's product of potentials carries the
        forward and backward vectors across it, so all blocks are worked on side
        by side and only the block ends of a text are visited one by one. With
        many labels the texts are taken in parts, since a block has a square of labels.
        """
        n_labels = len(self.labels)
        if n_labels > BLOCKED_LABELS:
            _, forward, backward, _ = self.side_by_side(scores, lengths)
            p = forward * backward
            return p / p.sum(axis=1, keepdims=True)
        per_text = -(-lengths // BLOCK)
        if len(lengths) > 1 and per_text.sum() * n_labels**2 > PAIRS_AT_ONCE:
            half = len(lengths) // 2
            cut = lengths[:half].sum()
            return np.concatenate([self.marginals(scores[:cut], lengths[:half]), self.marginals(scores[cut:], lengths[half:])])
        step = np.exp(self.transition - self.transition.max())
        first = np.cumsum(per_text) - per_text
        text_of = np.repeat(np.arange(len(lengths)), per_text)
        number = np.arange(len(text_of)) - first[text_of]
        size = np.minimum(BLOCK, lengths[text_of] - number * BLOCK)
        begins = (np.cumsum(lengths) - lengths)[text_of] + number * BLOCK
        at = begins[:, None] + np.arange(BLOCK)
        filled = np.arange(BLOCK) < size[:, None]
        potential = np.ones((len(text_of), BLOCK, n_labels))
        potential[filled] = np.exp(scores - scores.max(axis=1, keepdims=True))[at[filled]]
        start = np.exp(self.begin - self.begin.max())
        unit = lambda v: v / v.sum(axis=-1, keepdims=True)

        # How the block turns a vector before it into one after its last word.
        carry = np.broadcast_to(np.eye(n_labels), (len(text_of), n_labels, n_labels)).copy()
        for t in range(BLOCK):
            live = filled[:, t]
            moved = (carry[live].reshape(-1, n_labels) @ step).reshape(-1, n_labels, n_labels) * potential[live, t, None, :]
            carry[live] = moved / moved.sum(axis=(1, 2), keepdims=True)
        # The vectors at block ends, one block of each text at a time. The first
        # word has begin scores where the others have a transition.
        before = np.ones((len(text_of), n_labels))
        after = np.ones((len(text_of), n_labels))
        lead = np.linalg.lstsq(step.T, start, rcond=None)[0]  # lead @ step = start
        before[first] = lead
        for k in range(1, int(per_text.max(initial=0))):
            here = first[per_text > k] + k
            moved = np.einsum("bi,bij->bj", before[here - 1], carry[here - 1])
            before[here] = moved / np.abs(moved).sum(axis=1, keepdims=True)
        for k in range(int(per_text.max(initial=0)) - 2, -1, -1):
            here = first[per_text > k + 1] + k
            after[here] = unit(np.einsum("bij,bj->bi", carry[here + 1], after[here + 1]))
        forward = np.empty((len(text_of), BLOCK, n_labels))
        now = before
        for t in range(BLOCK):
            moved = (now @ step) * potential[:, t]
            now = np.where(filled[:, t, None], moved / np.abs(moved).sum(axis=1, keepdims=True), now)
            forward[:, t] = now
        out = np.empty((len(text_of), BLOCK, n_labels))
        now = after
        for t in range(BLOCK - 1, -1, -1):
            out[:, t] = forward[:, t] * now
            moved = (now * potential[:, t]) @ step.T
            now = np.where(filled[:, t, None], unit(moved), now)
        return unit(np.maximum(out[filled], 0) + 1e-300)


    def side_by_side(self, scores: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
        """Potentials, forward and backward vectors (each of sum 1), and the transitions' potentials; a word of every text at a time."""
        step, begin = np.exp(self.transition - self.transition.max()), np.exp(self.begin - self.begin.max())
        potential = np.exp(scores - scores.max(axis=1, keepdims=True))
        starts = np.cumsum(lengths) - lengths
        longest_first = np.argsort(-lengths, kind="stable")
        starts, sizes = starts[longest_first], lengths[longest_first]
        live = [int(np.searchsorted(-sizes, -t, side="left")) for t in range(int(sizes[0]) + 1 if len(sizes) else 0)]
        unit = lambda v: v / v.sum(axis=1, keepdims=True)
        forward, backward = np.empty_like(potential), np.ones_like(potential)
        at = starts[: live[0]] if live else starts
        forward[at] = unit(begin * potential[at])
        for t in range(1, len(live) - 1):
            at = starts[: live[t]] + t
            forward[at] = unit((forward[at - 1] @ step) * potential[at])
        for t in range(len(live) - 2, 0, -1):
            at = starts[: live[t]] + t
            backward[at - 1] = unit((backward[at] * potential[at]) @ step.T)
        return potential, forward, backward, step


def _added(rows: np.ndarray, slot: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Sums of `rows` by runs of slots, some runs at a time."""
    out = np.empty((len(start), rows.shape[1]), dtype=rows.dtype)
    ends = [*start[1:].tolist(), len(slot)]
    at_once = max(1, GATHERED_AT_ONCE // rows.shape[1])
    begin = 0
    while begin < len(start):
        first = int(start[begin])
        end = max(begin + 1, int(np.searchsorted(start, first + at_once)))
        out[begin:end] = np.add.reduceat(rows[slot[first : ends[end - 1]]], start[begin:end] - first, axis=0)
        begin = end
    return out


def fit(runs: list[tuple[str, list[str]]]) -> Field:
    """A field from runs of words with their language, in a fixed order."""
    labels = sorted({lang for lang, _ in runs})
    number = {lang: k for k, lang in enumerate(labels)}
    n_labels = len(labels)
    random = np.random.default_rng(SEED)
    order = random.permutation(len(runs))
    half = len(runs) // 2 if len(runs) > 1 else len(runs)
    for_lexicon, for_field = order[:half], order[half:] if len(runs) > 1 else order
    used = [Counter() for _ in labels]
    for r in for_lexicon:
        used[number[runs[r][0]]].update(runs[r][1])
    lexicon = {}
    for word in set().union(*used):
        n = np.array([c[word] for c in used], dtype=float)
        if n.sum() >= 2:  # a class is the likeliest language and how clearly it is that
            share = (n.max() + 0.2) / (n.sum() + 0.2 * n_labels)
            lexicon[word] = 1 + int(n.argmax()) * LEXICON_BINS + min(LEXICON_BINS - 1, int(share * LEXICON_BINS))

    # Strings of one to four runs, cut at random, of whatever languages come.
    words, label, first = [], [], []
    k = 0
    while k < len(for_field):
        first.append(len(words))
        for r in for_field[k : k + int(random.integers(1, 5))]:
            lang, run = runs[r]
            part = run[: int(random.integers(3, SEGMENT_WORDS + 1))]
            words += part
            label += [number[lang]] * len(part)
            k += 1
    known = sorted(set(words))
    index = {w: i for i, w in enumerate(known)}
    token = np.array([index[w] for w in words])
    gold, first = np.array(label), np.array(first)
    first = first[np.diff([*first, len(words)]) > 0]
    lengths = np.diff([*first, len(words)])
    bits = slot_bits(n_labels)
    slot, start = features(known, bits)
    slot_owner = np.repeat(np.arange(len(known)), np.diff([*start, len(slot)]))
    extra = (1 << bits) + np.array([lexicon.get(w, 0) for w in known])
    n_rows = (1 << bits) + 1 + n_labels * LEXICON_BINS
    model = Field(labels, np.zeros((n_rows, n_labels)), np.zeros((n_labels, n_labels)), np.zeros(n_labels), lexicon)
    seen = [np.full_like(a, 1e-8) for a in (model.emission, model.transition, model.begin)]
    is_first = np.zeros(len(words), dtype=bool)
    is_first[first] = True
    follows = np.flatnonzero(~is_first)
    for _ in range(STEPS):
        per_word = _added(model.emission, slot, start) + model.emission[extra]
        potential, forward, backward, step = model.side_by_side(per_word[token], lengths)
        p = forward * backward
        error = -p / p.sum(axis=1, keepdims=True)
        error[np.arange(len(words)), gold] += 1
        by_word = np.zeros_like(per_word)
        np.add.at(by_word, token, error)
        g_emission = np.stack([np.bincount(slot, by_word[slot_owner, c], n_rows) + np.bincount(extra, by_word[:, c], n_rows)
                               for c in range(n_labels)], axis=1) - PENALTY * len(words) * model.emission
        # Expected transitions: of each word's pairs with the one before it, in proportion, added up as one product.
        onward = potential[follows] * backward[follows]
        weight = 1 / ((forward[follows - 1] @ step) * onward).sum(axis=1, keepdims=True)
        pair = step * ((forward[follows - 1] * weight).T @ onward)
        g_transition = np.zeros_like(model.transition)
        np.add.at(g_transition, (gold[follows - 1], gold[follows]), 1)
        g_transition -= pair + PENALTY * len(words) * model.transition
        g_begin = error[first].sum(axis=0)
        for weight, gradient, total in zip((model.emission, model.transition, model.begin), (g_emission, g_transition, g_begin), seen):
            total += gradient**2
            weight += RATE * gradient / np.sqrt(total)
    model.emission = model.emission.astype(np.float32)
    return model


def learn(docs: DataFrame, docs_per_label: int = DOCS_PER_LABEL) -> Field | None:
    """Fit a field to the labelled rows of `docs` (`doc_id`, `text`, `lang`). None if there is no label with words."""
    draw = F.pmod(F.xxhash64(F.lit(SEED), F.col("doc_id"), F.col("text")), F.lit(DRAWS))
    labelled = docs.where("lang is not null and text is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).withColumn("draw", draw)
    # One row for each label. Different rows, near enough: a sketch of a few kilobytes a label.
    counts = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.approx_count_distinct("draw").alias("n")).collect()}
    if not counts:
        return None
    docs_per_label = sample_size(len(counts), docs_per_label)
    # So many more than wanted that too few are as good as impossible; exactly as many as wanted are used.
    drawn = 2 * docs_per_label + 40
    bounds = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(DRAWS, drawn * DRAWS // max(1, n) + 1))])
    some = labelled.where(F.col("draw") < bounds[F.col("lang")])
    # Equal rows are one, reduced in each task before they meet; what is left of a label is bounded, so it may be ordered.
    once = some.groupBy("lang", "draw").agg(F.min("doc_id").alias("doc_id"), F.min("text").alias("text"))
    lowest = Window.partitionBy("lang").orderBy("draw")
    chosen = once.withColumn("place", F.row_number().over(lowest)).where(F.col("place") <= docs_per_label).drop("place")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                words = words_of(r["text"])
                runs = range(0, len(words), SEGMENT_WORDS)
                chosen = [runs[k] for k in np.linspace(0, len(runs) - 1, min(SEGMENTS, len(runs))).astype(int)] if runs else []
                rows.append((r["draw"], r["doc_id"], r["lang"], [" ".join(words[a : a + SEGMENT_WORDS]) for a in chosen]))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else
                                             [pa.array([], k) for k in kinds], names=["draw", "doc_id", "lang", "runs"])

    sample = chosen.select("draw", "doc_id", "lang", "text").mapInArrow(cut, "draw long, doc_id long, lang string, runs array<string>")
    runs: list[tuple[str, list[str]]] = []
    for r in sample.orderBy("lang", "draw").collect():
        runs += [(r.lang, run.split(" ")) for run in r.runs]
    return fit(runs) if runs else None


class Labeller:
    """Applies a field to texts, remembering the scores of words."""

    def __init__(self, model: Field):
        self.model = model
        self.known: dict[str, int] = {}
        # With many labels fewer words at once.
        self.share = max(1, -(-len(model.labels) // FULL_LABELS))
        self.scores = np.empty((1024, len(model.labels)), dtype=np.float32)

    def _rows(self, texts: list[list[str]]) -> np.ndarray:
        if len(self.known) > MOST_WORDS // self.share:
            self.known.clear()
        known, here = self.known, set().union(*texts)
        unknown = [w for w in here if w not in known]
        # Long ones come last; their rows are used once and written over.
        unknown.sort(key=lambda w: len(w) > LONGEST_WORD)
        long = {}
        if unknown:
            have = len(known)
            if have + len(unknown) > len(self.scores):
                grown = np.empty((2 * (have + len(unknown)), self.scores.shape[1]), dtype=np.float32)
                grown[:have] = self.scores[:have]
                self.scores = grown
            self.scores[have : have + len(unknown)] = self.model.scores(unknown)
            numbered = list(zip(unknown, range(have, have + len(unknown))))
            n_short = sum(len(w) <= LONGEST_WORD for w in unknown)
            known.update(numbered[:n_short])
            long = dict(numbered[n_short:])
        row = known.__getitem__ if not long else lambda w: long[w] if w in long else known[w]
        return np.concatenate([np.fromiter(map(row, t), np.int64, len(t)) for t in texts])

    def word_probabilities(self, texts: list[list[str]]) -> list[np.ndarray]:
        """For each text (a list of at least one word) the label probabilities of its words."""
        rows = self._rows(texts)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        p = self.model.marginals(self.scores[rows].astype(np.float64), lengths)
        return np.split(p, np.cumsum(lengths)[:-1])

    def judge(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """Label and score of each text, and how clear its words are: the mean of each word's best probability."""
        out: list[tuple[str, float, float]] = [(UNDETERMINED, 0.0, 0.0)] * len(texts)
        group: list[tuple[int, list[str]]] = []
        size = 0

        def close() -> None:
            for (i, _), p in zip(group, self.word_probabilities([w for _, w in group])):
                row = p.mean(axis=0)
                best = int(row.argmax())
                out[i] = (self.model.labels[best], float(min(1.0, row[best])), float(min(1.0, p.max(axis=1).mean())))

        for i, text in enumerate(texts):
            words = words_of(text) if text else []
            if any(not w.isalpha() for w in words):  # runs of numerals that are no digits
                words = [w for w in words if any(c.isalpha() for c in w)]
            if words:
                group.append((i, words))
                size += len(words)
                if size >= TOKENS_AT_ONCE // self.share:
                    close()
                    group, size = [], 0
        if group:
            close()
        return out


def _labeller(model: Field, name: str) -> Labeller:
    return kept_by_worker(f"langid {name}", lambda: Labeller(model))


def with_language(docs: DataFrame, model: Field | None, label: str = "lang_pred", score: str = "score",
                  clear: str | None = None, within: str | None = None) -> DataFrame:
    """All columns of `docs`, which has `text`, and two or three more. Names that `docs` has already must not be asked for.

    `within` names a struct column that holds `text` instead, so that whole rows are carried and their text is sent once.

    `clear` is the mean over a text's words of each word's best probability, whatever label that is.
    """
    added = [(label, StringType(), pa.string()), (score, DoubleType(), pa.float64()), (clear, DoubleType(), pa.float64())]
    added = added if clear else added[:2]
    if model is None:
        return docs.withColumns({name: F.lit(UNDETERMINED if name == label else 0.0) for name, _, _ in added})
    name = uuid.uuid4().hex
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = _labeller(shared.value, name)
        for batch in batches:
            texts = batch.column(within).field("text") if within else batch.column("text")
            found = labeller.judge([None if t is None else str(t) for t in texts.to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *[pa.array([f[k] for f in found], kind) for k, (_, _, kind) in enumerate(added)]],
                names=[*batch.schema.names, *[name for name, _, _ in added]])

    wider = StructType([*docs.schema.fields, *[StructField(name, kind) for name, kind, _ in added]])
    return docs.mapInArrow(judged, wider)


def predict(docs: DataFrame, folds: int = 3) -> DataFrame:
    """`doc_id`, `held_out`, `lang_pred`, `score` of each row, learned from those not held out."""
    out = held_out(F.col("doc_id"), folds)
    model = learn(docs.where(~out))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), out.alias("held_out"), F.col("text").cast("string").alias("text"))
    return with_language(rows, model).select("doc_id", "held_out", "lang_pred", "score")
