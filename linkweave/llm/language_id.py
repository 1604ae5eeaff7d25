"""Language identification by error-correcting output codes.

Each language has a codeword of +1 and -1.  One linear classifier per bit, over
hashed byte trigrams of the whole text, predicts that bit; the language whose
codeword has the least weighted logistic loss against the predicted bits wins.
Bits weigh by how well they were predicted on rows kept back from fitting.  A
text whose two best codewords lie close together is flagged as ambiguous.

Fitting takes a bounded sample: at most ``SAMPLE_ROWS`` documents over all
languages, those of the least hash of id and text; the closed-form ridge solution is then
found on the driver.  Counting and prediction cover all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _bytes as B

DIM_BITS = 12
SAMPLE_ROWS, SAMPLE_PER_LANGUAGE = 4_000, 700
#: The model and its codewords go to every task: rarer languages than so many are learned as one, REST.
MAX_LANGUAGES, REST = 1_000, "other"
_CLASS = np.full(256, 32, np.uint8)
_CLASS[97:123] = np.arange(97, 123)
_CLASS[65:91] = np.arange(97, 123)
_CLASS[128:] = np.arange(128, 256)


def trigram_features(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Square roots of the shares of hashed byte trigrams, a row per text; digits and signs count as white."""
    docs, dim = len(offsets) - 1, 1 << DIM_BITS
    if len(raw) < 3:
        return np.zeros((docs, dim), np.float32)
    c = _CLASS[raw].astype(np.uint32)
    code = (c[:-2] | (c[1:-1] << np.uint32(8)) | (c[2:] << np.uint32(16))) * np.uint32(0x9E3779B1)
    of = np.repeat(np.arange(docs), np.diff(offsets))
    at = of[:-2] * dim + (code >> np.uint32(32 - DIM_BITS))
    at = at[(of[:-2] == of[2:]) & ((c[:-2] != 32) | (c[1:-1] != 32))]
    x = np.bincount(at, minlength=docs * dim).reshape(docs, dim).astype(np.float32)
    return np.sqrt(x / np.maximum(x.sum(axis=1, keepdims=True), 1))


def codewords(k: int) -> np.ndarray:
    """k codewords of +1 and -1: exhaustive up to 7, else the best of random draws by least distance."""
    if k < 2:
        return np.ones((k, 1))
    if k <= 7:
        bits = np.arange(1, 1 << (k - 1))
        return np.array([[1.0] * len(bits)] + [np.where(bits >> j & 1, -1.0, 1.0) for j in range(k - 1)])
    rng = np.random.default_rng(7)
    width, best, most = int(np.ceil(10 * np.log2(k))), None, -1
    for _ in range(30):
        code = rng.choice([-1.0, 1.0], (k, width))
        gap = (width - (code @ code.T - 2 * width * np.eye(k)).max()) / 2
        if gap > most and (np.abs(code.sum(axis=0)) < k).all():
            best, most = code, gap
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray
    sharpness: float = 1.0

    def losses(self, x: np.ndarray) -> np.ndarray:
        f = x @ self.weights + self.bias
        return np.stack([np.logaddexp(0, -3 * f * c) @ self.trust for c in self.code], axis=1)

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language number, probability, margin to the second as a probability)."""
        z = -self.sharpness * self.losses(x)
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        top = np.sort(p, axis=1)
        second = top[:, -2] if p.shape[1] > 1 else np.zeros(len(p))
        return best, top[:, -1], top[:, -1] - second


def solve(x: np.ndarray, languages: np.ndarray) -> Model:
    """Ridge regression to the bits in its dual form; a fifth of the rows sets trust and sharpness."""
    names = sorted(set(languages.tolist()))
    y = np.searchsorted(np.array(names), languages)
    code = codewords(len(names))
    targets = code[y]
    aside = np.arange(len(y)) % 5 == 4
    if not aside.any():
        aside = np.ones(len(y), bool)
    share = np.bincount(y, minlength=len(names))

    def ridge(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1.0 / share[y[rows]]) ** 0.5
        w = (w / w.mean()).astype(np.float32)[:, None]
        a = x[rows] * w
        kernel = (a @ a.T).astype(np.float64) + w @ w.T
        kernel[np.diag_indices(len(a))] += 0.01
        alpha = np.linalg.solve(kernel, targets[rows] * w).astype(np.float32)
        return a.T @ alpha, (w.T @ alpha)[0]

    fitted = ~aside if (~aside).any() else aside
    part = Model(names, code, *ridge(np.flatnonzero(fitted)), np.full(code.shape[1], 1.0 / code.shape[1]))
    right = (np.sign(x[aside] @ part.weights + part.bias) == targets[aside]).mean(axis=0)
    odds = np.clip(right, 0.51, 0.999)
    trust = np.log(odds / (1 - odds))
    part.trust = trust / trust.sum()
    z, best = part.losses(x[aside]), -np.inf
    for s in (1, 2, 4, 8, 16, 32):
        p = -s * z - np.log(np.exp(-s * (z - z.min(axis=1, keepdims=True))).sum(axis=1, keepdims=True)) + s * z.min(axis=1, keepdims=True)
        ll = p[np.arange(len(p)), y[aside]].mean() - 0.001 * s
        if ll > best:
            best, part.sharpness = ll, float(s)
    part.weights, part.bias = ridge(np.arange(len(y)))
    return part


def fit(labelled: DataFrame, id_col: str, text_col: str, lang_col: str) -> Model | None:
    """Fit on a bounded sample of the rows with an id, text and language; None without any.

    Every language has rows in the sample.  With more than ``MAX_LANGUAGES`` values the
    rarest (ties by name) are one language, ``REST``, and are predicted as that.
    """
    rows = labelled.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang")).filter("id is not null and lang is not null and text is not null")
    sizes = rows.groupBy("lang").count()
    top = sizes.orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES + 1).collect()
    if not top:
        return None
    counts = {r["lang"]: r["count"] for r in top}
    if len(top) > MAX_LANGUAGES:
        counts = {r["lang"]: r["count"] for r in top[: MAX_LANGUAGES - 1]}
        own = F.create_map(*[x for k in counts for x in (F.lit(k), F.lit(True))])
        rows = rows.withColumn("lang", F.when(own[F.col("lang")], F.col("lang")).otherwise(F.lit(REST)))
        counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    most = min(SAMPLE_PER_LANGUAGE, max(2, SAMPLE_ROWS // len(counts)))
    # a share of the hashes that surely has ``most`` rows of each language, of which the least hashes count
    limits = [x for k, n in counts.items() for x in (F.lit(k), F.lit(int(min(1.0, (2 * most + 40) / n) * (1 << 30))))]
    near = rows.withColumn("h", F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30))).filter(F.col("h") < F.create_map(*limits)[F.col("lang")])
    drawn = near.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "id", "text"))).filter(F.col("n") <= most).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, off in B.blocks(batch.column(1), most=256):
                x = trigram_features(raw, off).astype(np.float16)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([r.tobytes() for r in x], pa.binary())], ["lang", "x"])

    got = drawn.mapInArrow(run, "lang string, x binary").collect()  # ``most`` of each language
    got.sort(key=lambda r: (r["lang"], bytes(r["x"])))
    order = np.random.default_rng(3).permutation(len(got))
    if not len(got):
        return None
    x = np.stack([np.frombuffer(got[i]["x"], np.float16) for i in order]).astype(np.float32)
    return solve(x, np.array([got[i]["lang"] for i in order]))


def predict(docs: DataFrame, model: Model | None, text_col: str = "text", ambiguous_below: float = 0.1) -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1) and ambiguous, which replace columns so named.

    A text that is null or has no letter is ``und`` with score 0 and not ambiguous,
    as is any text if there is no model.
    """
    kept = docs.drop("lang_pred", "score", "ambiguous")
    schema = kept.withColumns({"lang_pred": F.lit("").cast("string"), "score": F.lit(0.0), "ambiguous": F.lit(False)}).schema
    has_letter = "__has_letter"
    marked = kept.withColumn(has_letter, F.coalesce(F.col(f"`{text_col}`").rlike(r"\p{L}"), F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            lang, score, near = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
            if model is not None:
                for i, j, raw, off in B.blocks(batch.column(batch.schema.get_field_index(text_col)), most=256):
                    lang[i:j], score[i:j], near[i:j] = model.decode(trigram_features(raw, off))
            letters = batch.column(batch.schema.get_field_index(has_letter)).to_numpy(zero_copy_only=False) & (model is not None)
            names = np.array([*(model.languages if model else ["und"]), "und"], object)
            out = [
                pa.array(names[np.where(letters, lang, len(names) - 1)], pa.string()),
                pa.array(np.where(letters, np.clip(score, 0, 1), 0.0)),
                pa.array(letters & (near < ambiguous_below)),
            ]
            own = [c for c, name in zip(batch.columns, batch.schema.names) if name != has_letter]
            yield pa.RecordBatch.from_arrays([*own, *out], schema.names)

    return marked.mapInArrow(run, schema)


def least_score(held: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang", share: float = 0.001) -> float:
    """The score that all but ``share`` of the rightly predicted rows of ``held`` reach; 0 without any.

    Fewer rows than 1 / ``share`` don't tell that score: then it's that of half the
    odds of the lowest.  Rows that the model learned from don't belong in ``held``.
    """
    right = predict(held, model, text_col).filter(F.col("lang_pred") == F.col(f"`{lang_col}`"))
    n, low, at = right.agg(F.count("*"), F.min("score"), F.percentile_approx("score", share, 100_000)).first()
    if not n:
        return 0.0
    return at if n * share >= 1 else low / (2 - low)


def remainder(id_col: str, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``."""
    return F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % by


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held: int = 2) -> DataFrame:
    """One row per row of ``docs``: id_col, held_out, lang_pred, score, ambiguous.

    Fitted on the rows with a language whose fold (crc32 of the id modulo ``folds``)
    isn't ``held``.  A row without an id isn't used to fit and isn't held out.  Beyond
    ``MAX_LANGUAGES`` values of ``lang_col`` the rarest are one language, ``REST``.
    """
    model = fit(docs.filter(remainder(id_col, folds) != held), id_col, text_col, lang_col)
    rows = docs.select(F.col(f"`{id_col}`").alias(id_col), F.coalesce(remainder(id_col, folds) == held, F.lit(False)).alias("held_out"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return predict(rows, model).drop("text")
