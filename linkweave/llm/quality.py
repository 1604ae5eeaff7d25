"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics cover whole texts and are counted with numpy on Arrow buffers.
Trees are complete, of fixed depth, and flattened into three arrays, so a block of
documents goes down all trees at once by array indexing.

Fitting takes a bounded sample of labelled rows (``SAMPLE_ROWS``), drawn by a hash
of the id; everything else covers all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bytes as B
from .language_id import remainder

U = np.uint64
SAMPLE_ROWS = 12_000
BINS, DEPTH, TREES, RATE, L2 = 64, 4, 60, 0.15, 5.0
UPPER, LOWER, DIGIT, SPACE, LINE, STOP, MARK, HEAD, TAIL = range(9)
_KIND = np.full(256, MARK, np.uint8)
_KIND[65:91], _KIND[97:123], _KIND[48:58] = UPPER, LOWER, DIGIT
_KIND[[32, 9, 11, 12, 13]], _KIND[10] = SPACE, LINE
_KIND[[ord(c) for c in ".,;:?!'\"()-"]] = STOP
_KIND[128:192], _KIND[192:] = TAIL, HEAD
FEATURES = 26


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def _repeats(h: np.ndarray, of: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct, most frequent) of the hashes of each text."""
    if not len(h):
        return np.zeros(docs), np.zeros(docs)
    h, of = B.sort_within(h, of)
    cut = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (of[1:] != of[:-1])])
    runs, owner = np.diff(np.r_[cut, len(h)]), of[cut]
    most = np.zeros(docs)
    np.maximum.at(most, owner, runs)
    return np.bincount(owner, minlength=docs).astype(float), most


def statistics(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """``FEATURES`` numbers a text; an empty text has zeros."""
    docs, size = len(offsets) - 1, np.diff(offsets)
    of = np.repeat(np.arange(docs), size)
    kind = _KIND[raw]
    c = np.bincount(of * 9 + kind, minlength=docs * 9).reshape(docs, 9).astype(float)
    chars = size - c[:, TAIL]
    starts, ends, first = B.words(raw, offsets)
    n = np.diff(first).astype(float)
    owner = np.repeat(np.arange(docs), np.diff(first))
    length = (ends - starts).astype(float)
    is_mark = np.concatenate([[0], np.cumsum(kind == MARK)])
    is_up = np.concatenate([[0], np.cumsum(kind == UPPER)])
    is_low = np.concatenate([[0], np.cumsum((kind == LOWER) | (kind >= HEAD))])
    marks, ups, lows = (x[ends] - x[starts] for x in (is_mark, is_up, is_low))
    total = lambda x: np.bincount(owner, x, minlength=docs)
    mean = _ratio(total(length), n)
    h = B.word_hashes(raw, starts, ends)
    distinct, most = _repeats(h, owner, docs)
    run, run_of = B.shingles(h, first)
    phrases, most_phrase = _repeats(run, run_of, docs)
    n_run = np.bincount(run_of, minlength=docs)
    lines, line_len_sd, distinct_lines, most_line, short_lines = _lines(raw, offsets)
    return np.column_stack([
        np.log1p(chars), np.log1p(n), mean, np.sqrt(np.maximum(_ratio(total(length**2), n) - mean**2, 0)),
        _ratio(c[:, UPPER], chars), _ratio(c[:, DIGIT], chars), _ratio(c[:, SPACE], chars), _ratio(c[:, LINE], chars),
        _ratio(c[:, STOP], chars), _ratio(c[:, MARK], chars), _ratio(c[:, HEAD], chars),
        _ratio(total(marks > 0), n), _ratio(total((ups > 1) & (lows == 0)), n), _ratio(total(ups + lows == 0), n), _ratio(total(length <= 3), n), _ratio(total(length >= 16), n),
        _ratio(distinct, n), _ratio(most, n), _ratio(phrases, n_run), _ratio(most_phrase, n_run),
        np.log1p(lines), _ratio(n, lines), line_len_sd, _ratio(distinct_lines, lines), _ratio(most_line, lines), _ratio(short_lines, lines),
    ])


def _lines(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each text: lines that aren't empty, deviation of their log length, distinct ones, copies of the commonest, those under 20 bytes."""
    docs = len(offsets) - 1
    if not len(raw):
        return (np.zeros(docs),) * 5
    edge = np.zeros(len(raw) + 1, bool)
    edge[:-1] = raw == 10
    edge[offsets] = True
    cut = np.flatnonzero(edge)
    starts, ends = np.r_[0, cut[:-1]], cut
    starts = np.where((starts < len(raw)) & (raw[np.minimum(starts, len(raw) - 1)] == 10), starts + 1, starts)
    good = ends > starts
    starts, ends = starts[good], ends[good]
    owner = np.searchsorted(offsets, starts, "right") - 1
    size = np.log1p(ends - starts)
    n = np.bincount(owner, minlength=docs).astype(float)
    mean = _ratio(np.bincount(owner, size, minlength=docs), n)
    sd = np.sqrt(np.maximum(_ratio(np.bincount(owner, size**2, minlength=docs), n) - mean**2, 0))
    distinct, most = _repeats(B.span_hash(B.prefix_hash(raw), starts, ends), owner, docs)
    return n, sd, distinct, most, np.bincount(owner, ends - starts < 20, minlength=docs).astype(float)


@dataclass
class Forest:
    """Complete trees: split features and bins by node, leaf values; ``edges`` are the bins' upper bounds by feature."""

    edges: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    base: float

    def bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(self.edges)], axis=1).astype(np.uint8)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        b = self.bin(x)
        rows, margin = np.arange(len(x)), np.full(len(x), self.base)
        inner = self.feature.shape[1]
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
            margin += leaf[node - inner]
        return 1 / (1 + np.exp(-margin))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Forest:
    """Logistic boosting with second-order gains on histograms of ``BINS`` quantile bins."""
    edges = np.stack([np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1]) for k in range(x.shape[1])])
    p0 = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    inner = (1 << DEPTH) - 1
    f = Forest(edges, np.zeros((trees, inner), np.int64), np.full((trees, inner), BINS, np.int64), np.zeros((trees, inner + 1)), float(np.log(p0 / (1 - p0))))
    b = f.bin(x)
    code = b + np.arange(x.shape[1]) * BINS
    margin = np.full(len(y), f.base)
    width = x.shape[1] * BINS
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for depth in range(DEPTH):
            at = node - ((1 << depth) - 1)
            flat = (at[:, None] * width + code).ravel()
            shape = (1 << depth, x.shape[1], BINS)
            gs, hs = (np.cumsum(np.bincount(flat, np.repeat(v, x.shape[1]), minlength=(1 << depth) * width).reshape(shape), axis=2) for v in (g, h))
            gt, ht = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + L2) + (gt - gs) ** 2 / (ht - hs + L2) - gt**2 / (ht + L2)
            gain[(hs < 2) | (ht - hs < 2)] = 0
            best = gain.reshape(1 << depth, -1).argmax(axis=1)
            first = (1 << depth) - 1
            for k, cell in enumerate(best):
                if gain[k].ravel()[cell] > 1e-6:
                    f.feature[t, first + k], f.cut[t, first + k] = divmod(int(cell), BINS)
            node = 2 * node + 1 + (b[np.arange(len(y)), f.feature[t, node]] > f.cut[t, node])
        at = node - inner
        f.leaf[t] = RATE * np.bincount(at, g, minlength=inner + 1) / (np.bincount(at, h, minlength=inner + 1) + L2)
        margin += f.leaf[t, at]
    return f


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, folds: int, held: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, y) of about ``most`` labelled rows outside the held-out fold, drawn by a hash of the id.

    Labels that are null or whose id is null teach nothing; of several labels of an
    id the largest counts.  The drawn ids are at most about ``most``, which bounds
    what is broadcast.
    """
    usable = labels.filter(remainder(id_col, folds) != held).groupBy(F.col(f"`{id_col}`").alias("__id")).agg(F.max(F.col(f"`{label}`")).alias("y")).filter("y is not null")
    n = usable.count()
    share = min(1.0, most / n) if n else 0.0
    drawn = usable.filter(F.pmod(F.xxhash64("__id", F.lit(17)), F.lit(1 << 30)) < int(share * (1 << 30)))
    return docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").cast("string").alias("text")).join(F.broadcast(drawn), "__id").select("text", F.col("y").cast("double").alias("y"))


def fit(sample: DataFrame) -> Forest | None:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, off in B.blocks(batch.column(0)):
                x = statistics(raw, off)
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), batch.column(1).slice(i, j - i)], ["x", "y"])

    got = sample.mapInArrow(run, "x binary, y double").orderBy(F.xxhash64("x", "y"), "x", "y").limit(2 * SAMPLE_ROWS).collect()  # more only if ids repeat
    if not got:
        return None
    got.sort(key=lambda r: (bytes(r["x"]), r["y"]))
    return grow(np.stack([np.frombuffer(r["x"], float) for r in got]), np.array([r["y"] for r in got]))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", folds: int = 5, held: int = 0, threshold: float = 0.3) -> DataFrame:
    """One row per row of ``docs``: id_col, held_out, score (probability of label 1), predicted.

    Fitted on labelled rows whose fold (crc32 of the id modulo ``folds``) isn't
    ``held``.  Without any the score is 0.5.  Null and empty texts score like texts
    whose statistics are all zero.  A row without an id isn't held out.  Other
    columns are not read.
    """
    model = fit(labelled_sample(docs, labels, label, SAMPLE_ROWS, folds, held, id_col, text_col))
    rows = docs.select(F.col(f"`{id_col}`").alias(id_col), F.coalesce(remainder(id_col, folds) == held, F.lit(False)).alias("held_out"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, off in B.blocks(batch.column(2)):
                s = model.score(statistics(raw, off)) if model else np.full(j - i, 0.5)
                own = [batch.column(k).slice(i, j - i) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(s), pa.array((s >= threshold).astype(np.int32))], [id_col, "held_out", "score", "predicted"])

    return rows.mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, score double, predicted int")
