"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A sentence's probability is logistic in hashed words and word beginnings; a document's is the
noisy-or of its sentences, 1 - prod(1 - p), fitted to document labels only.  The
same sentence scores then locate what offends.

Fitting takes a bounded sample of labelled rows (``SAMPLE_ROWS``) and, from it, the
features of at least ``LEAST_DOCS`` documents that tell labels apart; scoring covers
all rows and whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bytes as B
from ._scratch import drop, store
from .language_id import remainder
from .quality import labelled_sample

U = np.uint64
SAMPLE_ROWS, LEAST_DOCS, BITS, MOST_FEATURES = 12_000, 4, 22, 4_096
PREFIXES = (3, 4, 5, 6)
STEPS, PENALTY = 300, 0.002
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?\n"]] = True
_EDGE = np.zeros(256, bool)
_EDGE[[ord(c) for c in ".,;:!?()[]{}\"'*|#$%&<>/\\-_=+~`^"]] = True


def sentences(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(feature buckets, feature's sentence, sentence's text, sentence's first byte) of a block.

    A sentence ends after ``.``, ``!``, ``?`` or a line break.  Words are stripped of
    signs on both sides and lower-cased; words of signs only don't count.  A word has
    a feature for itself and one for its first 3, 4, 5 and 6 bytes if it is longer.
    Features come word by word.
    """
    soft = B.LOWER[raw].copy()
    soft[_EDGE[raw]] = 32
    starts, ends, first = B.words(soft, offsets)
    docs = len(offsets) - 1
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    running = B.prefix_hash(soft)
    owner = np.repeat(np.arange(docs), np.diff(first))
    stops = np.concatenate([[0], np.cumsum(_END[raw])])[starts]
    new = np.r_[True, (stops[1:] != stops[:-1]) | (owner[1:] != owner[:-1])]
    of = np.cumsum(new) - 1
    parts = [B.span_hash(running, starts, ends)] + [B.span_hash(running, starts, np.minimum(starts + n, ends)) for n in PREFIXES]
    there = np.stack([np.ones(len(starts), bool)] + [ends - starts > n for n in PREFIXES], axis=1)
    salt = np.array([0, *(B.mix(np.array(PREFIXES, np.uint64)).tolist())], np.uint64)
    bucket = (B.mix(np.stack(parts, axis=1) ^ salt) >> U(64 - BITS)).astype(np.int64)
    return bucket[there], np.repeat(of, there.sum(axis=1)), owner[new], starts[new]


@dataclass
class Model:
    """A weight by feature bucket (16 MB) and the bias of every sentence."""

    weights: np.ndarray
    bias: float

    def margins(self, bucket: np.ndarray, sentence: np.ndarray, n: int) -> np.ndarray:
        return self.bias + np.bincount(sentence, self.weights[bucket], minlength=n)


def noisy_or(margin: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """Document probabilities, from -log(1 - p) = softplus(margin) summed over sentences."""
    return -np.expm1(-np.bincount(doc, np.logaddexp(0, margin), minlength=docs))


def train(kept: np.ndarray, feature: np.ndarray, sentence: np.ndarray, doc: np.ndarray, plain: np.ndarray, y: np.ndarray) -> Model:
    """Full-batch Adam on the noisy-or likelihood, with soft thresholding of the weights.

    ``doc`` is the document of each sentence with a kept feature; ``plain`` counts the
    other sentences of each document, which all have the bias as their margin.
    """
    n, docs = len(doc), len(y)
    p0 = np.clip(y.mean(), 1e-3, 0.999)
    bias = float(np.log(np.expm1(-np.log1p(-p0) * 0.1 * docs / max(n + plain.sum(), 1))))
    theta = np.r_[np.zeros(len(kept)), bias]
    m, v, rate = np.zeros_like(theta), np.zeros_like(theta), 0.1
    for step in range(1, STEPS + 1):
        z = theta[-1] + np.bincount(sentence, theta[feature], minlength=n)
        total = np.bincount(doc, np.logaddexp(0, z), minlength=docs) + plain * np.logaddexp(0, theta[-1])
        dtotal = ((1 - y) - y / np.maximum(np.expm1(np.minimum(total, 500)), 1e-6)) / docs
        dz = dtotal[doc] * _logistic(z)
        grad = np.r_[np.bincount(feature, dz[sentence], minlength=len(kept)), dz.sum() + (dtotal * plain).sum() * _logistic(theta[-1:])[0]]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        theta[:-1] = np.sign(theta[:-1]) * np.maximum(np.abs(theta[:-1]) - rate * PENALTY, 0)
    weights = np.zeros(1 << BITS, np.float32)
    weights[kept] = theta[:-1]
    return Model(weights, float(theta[-1]))


def _logistic(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(z / 2))


def _feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, label 1 documents, documents) by task; a document counts once a bucket."""
    docs, hits, seen = np.zeros(1 << BITS, np.int32), np.zeros(1 << BITS, np.int32), False
    for batch in batches:
        y = batch.column(1).to_numpy(zero_copy_only=False) > 0
        for i, j, raw, off in B.blocks(batch.column(0)):
            bucket, sentence, doc, _ = sentences(raw, off)
            pair = np.unique((doc[sentence] << BITS) | bucket)
            at = pair & ((1 << BITS) - 1)
            docs += np.bincount(at, minlength=1 << BITS).astype(np.int32)
            hits += np.bincount(at[y[i:j][pair >> BITS]], minlength=1 << BITS).astype(np.int32)
            seen = True
    if seen:
        at = np.flatnonzero(docs)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(hits[at].astype(np.int64)), pa.array(docs[at].astype(np.int64))], ["bucket", "hits", "docs"])


def telling_features(sample: DataFrame, n: int, positive: int, most: int = MOST_FEATURES, least: float = 10.0) -> np.ndarray:
    """The at most ``most`` buckets of at least ``LEAST_DOCS`` documents whose labels differ most from the rest's, by a chi-square over ``least``, sorted."""
    counts = sample.mapInArrow(_feature_counts, "bucket long, hits long, docs long").groupBy("bucket").agg(F.sum("hits").alias("a"), F.sum("docs").alias("d")).filter(F.col("d") >= LEAST_DOCS)
    expected = F.col("d") * F.lit(positive / n)
    chi = F.pow(F.col("a") - expected, 2) / (expected * F.lit(1 - positive / n) + F.lit(1e-9))
    rows = counts.withColumn("chi", chi).filter(F.col("chi") > least).orderBy(F.desc("chi"), "bucket").limit(most).select("bucket").collect()
    return np.array(sorted(r[0] for r in rows), np.int64)


def fit(sample: DataFrame) -> Model | None:
    sample = store(sample)  # bounded; read three times
    n, positive = sample.agg(F.count("*"), F.sum((F.col("y") > 0).cast("long"))).first()
    if not n or not 0 < positive < n:
        drop(sample)
        return None
    kept = telling_features(sample, n, positive)
    place = np.full(1 << BITS, -1, np.int32)
    place[kept] = np.arange(len(kept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, off in B.blocks(batch.column(0)):
                bucket, sentence, doc, _ = sentences(raw, off)
                known = place[bucket] >= 0
                feature, sentence = place[bucket[known]], sentence[known]
                cut = np.searchsorted(doc[sentence], np.arange(j - i + 1))
                rows = [(feature[a:b].astype(np.int32).tobytes(), sentence[a:b].astype(np.int32).tobytes()) for a, b in zip(cut[:-1], cut[1:])]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary()), pa.array(np.bincount(doc, minlength=j - i)), batch.column(1).slice(i, j - i)], ["f", "s", "n", "y"])

    got = sample.mapInArrow(run, "f binary, s binary, n long, y double").orderBy(F.xxhash64("f", "s", "n", "y"), "f", "s", "n", "y").limit(2 * SAMPLE_ROWS).collect()  # more only if ids repeat
    drop(sample)
    got.sort(key=lambda r: (bytes(r["f"]), r["n"], r["y"]))
    feature, sentence, doc, plain, base = [], [], [], [], 0
    for k, r in enumerate(got):
        s = np.unique(np.frombuffer(r["s"], np.int32), return_inverse=True)[1]
        own = int(s.max()) + 1 if len(s) else 0
        feature.append(np.frombuffer(r["f"], np.int32).astype(np.int64))
        sentence.append(s + base)
        doc.append(np.full(own, k))
        plain.append(r["n"] - own)
        base += own
    return train(kept, np.concatenate(feature), np.concatenate(sentence), np.concatenate(doc), np.array(plain, float), np.array([float(r["y"] > 0) for r in got]))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", folds: int = 5, held: int = 0, threshold: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: id_col, held_out, score, predicted, n_sentences, offending.

    ``offending`` lists the first byte and the probability of each sentence that
    alone reaches ``threshold``, in order.  Null and empty texts have no sentence
    and score 0.  Fitted on labelled rows whose fold (crc32 of the id modulo
    ``folds``) isn't ``held``; without any all score 0.  A row without an id isn't
    held out.  Other columns are not read.
    """
    model = fit(labelled_sample(docs, labels, label, SAMPLE_ROWS, folds, held, id_col, text_col)) or Model(np.zeros(1 << BITS, np.float32), -50.0)
    rows = docs.select(F.col(f"`{id_col}`").alias(id_col), F.coalesce(remainder(id_col, folds) == held, F.lit(False)).alias("held_out"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = rows.schema[id_col].dataType.simpleString()
    spot = pa.struct([("first_byte", pa.int64()), ("probability", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, off in B.blocks(batch.column(2)):
                bucket, sentence, doc, begin = sentences(raw, off)
                z = model.margins(bucket, sentence, len(doc))
                s = noisy_or(z, doc, j - i)
                alone = _logistic(z)
                bad = np.flatnonzero(alone >= threshold)
                spots = pa.StructArray.from_arrays([pa.array(begin[bad] - off[doc[bad]]), pa.array(alone[bad])], fields=list(spot))
                ends = np.searchsorted(doc[bad], np.arange(j - i + 1)).astype(np.int32)
                own = [batch.column(k).slice(i, j - i) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array(s), pa.array((s >= threshold).astype(np.int32)), pa.array(np.bincount(doc, minlength=j - i)), pa.ListArray.from_arrays(pa.array(ends), spots)],
                    [id_col, "held_out", "score", "predicted", "n_sentences", "offending"],
                )

    return rows.mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, score double, predicted int, n_sentences long, offending array<struct<first_byte:long,probability:double>>")
