"""Quality classifier: histogram gradient-boosted trees over statistics of documents.

The statistics come from the bytes and words of whole texts, in numpy over Arrow batches. The trees are
fitted on the driver, over histograms of binned statistics, from a bounded sample of labelled rows
(SAMPLE_ROWS, those of the smallest hashes of their ids); the fitted trees are flattened into arrays that
all documents of a batch descend at once. Scoring is one pass without a shuffle.

Defined results: null counts as an empty text and gets a score like any other; a null id is never held
out; labels that are null count as none, of several labels of a document the largest counts; without
labels of both kinds every score is the share of label 1 (0.5 without any label). Inputs of a score are
the text's statistics alone; of several texts under a labelled id the one with the smallest digest is learnt from. Repeated rows get
equal scores; equal gains of splits go to the first statistic and the lowest edge; texts of any length are taken whole, about 150
bytes of memory for each of their bytes while they are; an empty table gives an empty result; other columns aren't looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _shared as sh

#: Labelled rows that a model is fitted on, at most.
SAMPLE_ROWS = 20_000
#: A document is predicted to be good from this score on.
THRESHOLD = 0.3

FEATURES = (
    "log_bytes", "log_words", "log_lines", "word_length", "word_length_spread", "longest_word", "upper", "digits", "punctuation", "symbols", "exclamation", "pipes", "wide", "blanks",
    "distinct_words", "top_word", "same_as_previous", "distinct_pairs", "distinct_fives", "shouted_words", "short_words", "words_ending_in_symbol", "repeated_lines", "line_bytes", "lines_ended", "sentence_ends",
)


def _class(text: str) -> np.ndarray:
    found = np.zeros(256, bool)
    found[list(text.encode())] = True
    return found


_UPPER, _DIGIT = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("0123456789")
_PUNCTUATION, _SYMBOL = _class(".,;:!?\"'()-"), _class("#$%&*@^~<>=+_\\/{}[]`")
_END = _class(".!?")


def _share(values: np.ndarray, ends: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Sums of values between the ends, per text, over `by`."""
    out, full = np.zeros(len(by)), ends[1:] > ends[:-1]
    if full.any():
        out[full] = np.add.reduceat(values, ends[:-1][full], dtype=np.float64 if values.dtype.kind == "f" else np.int64)
    return out / np.maximum(by, 1)


def _distinct(doc: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """How many different keys each text has, and how often its most frequent one stands in it. Takes 42 bits of a key."""
    k = np.sort((doc.astype(np.uint64) << np.uint64(42)) | (key >> np.uint64(22)))
    at = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.empty(0, np.int64)
    d, often = (k[at] >> np.uint64(42)).astype(np.int64), np.diff(np.append(at, len(k)))
    return np.bincount(d, minlength=n), _largest(often, d, n)


def _largest(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """The largest value of each text (0 where it has none); doc is sorted."""
    most = np.zeros(n, values.dtype)
    if len(doc):
        first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        most[doc[first]] = np.maximum.reduceat(values, first)
    return most


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text."""
    data, at = sh.text_buffer(texts)
    n = len(at) - 1
    w = sh.Words(data, at)
    size, words = np.diff(at), np.diff(w.first)
    of_bytes = lambda kind: _share(kind[data], at, size)
    newline = data == 0x0A
    ends_text = np.zeros(len(data) + 1, bool)
    ends_text[at[1:]] = True
    line_end = np.append(newline, False) | ends_text
    lines = np.flatnonzero(line_end[1:]) + 1 if len(data) else np.empty(0, np.int64)
    line_doc = np.searchsorted(at, lines, "left") - 1
    n_lines = np.bincount(line_doc, minlength=n)[:n] if len(lines) else np.zeros(n, np.int64)
    of_words = lambda values: _share(values, w.first, words)
    distinct, top = _distinct(w.doc, w.hash, n)
    same = np.zeros(len(w.hash), bool)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])

    def runs(k: int) -> np.ndarray:
        """The share of different ones among runs of k words."""
        if len(w.hash) < k:
            return np.ones(n)
        h = w.hash[: len(w.hash) - k + 1].copy()
        for i in range(1, k):
            h = sh.mix64(h) + w.hash[i : len(w.hash) - k + 1 + i]
        whole = w.doc[k - 1 :] == w.doc[: len(w.doc) - k + 1]
        many = np.bincount(w.doc[: len(h)][whole], minlength=n)
        return np.where(many, _distinct(w.doc[: len(h)][whole], h[whole], n)[0] / np.maximum(many, 1), 1.0)

    last = data[w.start + w.length - 1] if len(w.start) else np.empty(0, np.uint8)
    capitals = np.zeros(len(data) + 1, np.int32)
    np.cumsum(_UPPER[data], dtype=np.int32, out=capitals[1:])
    shouted = (capitals[w.start + w.length] - capitals[w.start] >= np.maximum(2, 0.5 * w.length)) if len(w.start) else np.empty(0, bool)
    # A line by the hashes of its words; an empty line is none.
    word_line = np.searchsorted(lines, w.start, "right")
    sums = np.zeros(len(lines) + 1, np.uint64)
    if len(w.start):
        order = np.arange(len(w.start), dtype=np.uint64)
        first_of_line = np.flatnonzero(np.append(True, word_line[1:] != word_line[:-1]))
        place = order - np.repeat(order[first_of_line], np.diff(np.append(first_of_line, len(order))))
        sums[word_line[first_of_line]] = np.add.reduceat(sh.mix64(w.hash ^ sh.mix64(place + np.uint64(1))), first_of_line)
        line_of, line_hash = w.doc[first_of_line], sums[word_line[first_of_line]]
        real = np.bincount(line_of, minlength=n)
        repeated = 1 - _distinct(line_of, line_hash, n)[0] / np.maximum(real, 1)
        repeated[real == 0] = 0
        ended = np.bincount(line_of, _END[last[np.append(first_of_line[1:], len(order)) - 1]], n) / np.maximum(real, 1)
    else:
        repeated, ended = np.zeros(n), np.zeros(n)
    mean = of_words(w.length)
    longest = _largest(w.length, w.doc, n)
    one = np.maximum(words, 1)
    return np.column_stack([
        np.log1p(size), np.log1p(words), np.log1p(n_lines), mean, np.sqrt(np.maximum(of_words(w.length.astype(float) ** 2) - mean**2, 0)), np.log1p(longest),
        of_bytes(_UPPER), of_bytes(_DIGIT), of_bytes(_PUNCTUATION), of_bytes(_SYMBOL), of_bytes(_class("!")), of_bytes(_class("|")), _share(data >= 0x80, at, size), of_bytes(sh._BLANK),
        distinct / one, top / one, of_words(same), runs(2), runs(5), of_words(shouted), of_words(w.length <= 3), of_words((_SYMBOL | _class("!|"))[last]), repeated, size / np.maximum(n_lines, 1), ended, of_words(_END[last]),
    ])


@dataclass(frozen=True)
class Trees:
    """Complete binary trees as arrays: feature and threshold by tree and inner node, leaf by tree and last-level node."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 for each row of x."""
        total = np.full(len(x), self.base)
        if len(self.leaf) and len(x):
            rows, trees = np.arange(len(x))[:, None], np.arange(len(self.leaf))[None, :]
            node = np.zeros((len(x), len(self.leaf)), np.int64)
            for _ in range(int(np.log2(self.leaf.shape[1]))):
                node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.threshold[trees, node])
            total = total + self.leaf[trees, node - self.feature.shape[1]].sum(1)
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 2.0, least: float = 4.0) -> Trees:
    """Boosts trees for the logistic loss. Each level of a tree takes one histogram of gradients and curvatures over all its nodes."""
    share = float(y.mean()) if len(y) else 0.5
    inner, none = 2**depth - 1, np.empty((0, 2**depth))
    base = float(np.log(max(share, 1e-3) / max(1 - share, 1e-3)))
    if share in (0.0, 1.0) or not len(y):
        return Trees(base, np.empty((0, inner), np.int64), np.empty((0, inner)), none)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)])
    n, m = x.shape
    flat = binned + np.arange(m) * bins
    total, out = np.full(n, base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        grad, curve = p - y, p * (1 - p)
        feature, threshold, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(n, np.int64)
        for level in range(depth):
            width, base_node = 2**level, 2**level - 1
            key = ((node - base_node)[:, None] * (m * bins) + flat).ravel()
            g, h = (np.bincount(key, np.repeat(v, m), width * m * bins).reshape(width, m, bins).cumsum(2) for v in (grad, curve))
            g_all, h_all = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + ridge) + (g_all - g) ** 2 / (h_all - h + ridge) - g_all**2 / (h_all + ridge)
            gain[(h < least) | (h_all - h < least)] = -1
            best = gain.reshape(width, -1).argmax(1)
            f, b = best // bins, best % bins
            for k in range(width):
                if gain[k, f[k], b[k]] > 1e-6 and b[k] < len(edges[f[k]]):
                    feature[base_node + k], threshold[base_node + k] = f[k], edges[f[k]][b[k]]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        place = node - inner
        leaf = -rate * np.bincount(place, grad, 2**depth) / (np.bincount(place, curve, 2**depth) + ridge)
        total = total + leaf[place]
        out.append((feature, threshold, leaf))
    return Trees(base, *map(np.stack, zip(*out, strict=True)))


def held_out(id_col: Column) -> Column:
    """Whether crc32 of the id as text leaves no remainder by 5."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _with_statistics(df: DataFrame, keep: list[str]) -> DataFrame:
    """Adds stats array<double> to the columns `keep`; the last column of df is the text."""
    names = [*keep, "stats"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sh.slices(batch, len(keep)):
                x = statistics(part.column(len(keep)))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), lists], names=names)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema if f.name in keep)
    return df.mapInArrow(sh.frugal(run), f"{schema}, stats array<double>")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS) -> Trees:
    """Trees from at most `rows` labelled documents that aren't held out. What reaches the driver is their statistics."""
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("__id")).agg(F.max(label).cast("double").alias("__y"))
    # The limit bounds what is broadcast.
    known = known.orderBy(F.xxhash64("__id"), "__id").limit(rows)
    found = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(known), "__id").select("__id", "__y", "__text")
    # One text an id: of several the one with the smallest digest.
    found = found.groupBy("__id", "__y").agg(F.min_by("__text", F.sha2("__text", 256)).alias("__text"))
    got = _with_statistics(found, ["__id", "__y"]).toArrow()
    if not len(got):
        return grow(np.empty((0, len(FEATURES))), np.empty(0))
    ids, y = got["__id"].to_numpy(), got["__y"].to_numpy()
    x = np.asarray(got["stats"].combine_chunks().flatten()).reshape(len(got), -1)
    order = np.lexsort((*x.T, ids))
    return grow(x[order], y[order])


def score(docs: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sh.slices(batch, 2):
                p = model(statistics(part.column(2)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, held_out(F.col(id_col)).alias("__held"), text_col).mapInArrow(sh.frugal(run), f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Trees, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, whose text scores at least `threshold`."""
    where = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sh.slices(batch, where):
                yield part.filter(pa.array(model(statistics(part.column(where))) >= threshold))

    return docs.mapInArrow(sh.frugal(run), docs.schema)
