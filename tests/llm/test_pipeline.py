"""The corpus pipeline against plain versions of its stages."""

import hashlib
import random
import zlib

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from linkweave.llm import bpe
from tests.llm import brute
from tests.llm.test_models import said


def test_pipeline(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, "\n".join(said(rng, lang, 30) for _ in range(3)), lang, f"s{i % 4 if i % 3 else 0}") for i, lang in enumerate(rng.choice(["xx", "yy"]) for _ in range(160))]
    passage = said(rng, "xx", 60)
    for i in range(0, 60, 5):
        rows[i] = (i, rows[i][1] + "\n" + passage, *rows[i][2:])
    rows += [(200 + i, rows[i][1], *rows[i][2:]) for i in range(10)]
    rows += [(300 + i, " ".join(w if k % 90 else "other" for k, w in enumerate(rows[i + 61][1].replace("\n", " ").split(" "))), *rows[i + 61][2:]) for i in range(8)]
    rows += [(400, "123 !!", "xx", "s0"), (401, None, "yy", "s1"), (402, "", None, None)]
    docs = spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))

    kept = [(i, t) for i, t, _, _ in rows if t and any(c.isalpha() for c in t)]
    kept = [(i, t) for (i, old), (_, t) in zip(kept, brute.deduped(sorted(kept), 50)) if t]
    kept = [(i, t) for (i, t), (_, _, _, c) in zip(kept, brute.similar(kept)) if c == i]
    want = dict(kept)
    assert 160 <= len(want) <= 168

    e = bpe.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    t = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=e.ranks, special_tokens={})
    out = corpus_pipeline.run(spark, str(tmp_path))
    got = out.collect()
    assert {r["doc_id"] for r in got} <= set(want) and len(got) > 100
    assert all(r["token_ids"] == t.encode_ordinary(want[r["doc_id"]]) for r in got)

    d = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:3]:
        d = stage(spark, d, str(tmp_path))
        assert d.columns == corpus_pipeline.COLUMNS, name
    assert {(r["doc_id"], r["text"]) for r in d.collect()} == set(want.items())


def test_stages_messy(spark):
    docs = spark.createDataFrame([(None, None, None, None, None), (None, "a b c d", None, None, None), (None, "e f g h", None, None, 3), (1, "a b c d", "xx", None, 1), (1, "a b c d", "xx", None, 1), (1, "other text by one id", "xx", "s", 1), (2, "", "yy", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_copies(spark, docs, "")
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in kept.collect()) == [("1", "other text by one id"), ("2", ""), ("None", "None"), ("None", "a b c d"), ("None", "e f g h")]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() >= 0
        assert stage(spark, docs.limit(0), "").collect() == []
    assert corpus_pipeline.language(spark, docs.withColumn("x", F.lit(1)), "").columns == corpus_pipeline.COLUMNS
    e = bpe.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    coded = corpus_pipeline.tokens(spark, docs, "").collect()
    said = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["decoded_sha256"]) for r in coded) == sorted((str(r["doc_id"]), len(e.encode_many([r["text"] or ""])[0]) // 4, said(r["text"])) for r in docs.collect())
    mixed = [r["text"] for r in corpus_pipeline.mixture(spark, docs, "").collect()]
    words = sum(len((t or "").split()) for t in mixed)
    assert abs(words - 21) <= 8 and set(mixed) <= {r["text"] for r in docs.collect()}  # within half a block of each of two sources


def test_language_decides(spark):
    rng = random.Random(3)
    rows = [(i, said(rng, lang, 60), lang) for i, lang in enumerate(rng.choice(["xx", "yy", "zz"]) for _ in range(400))]
    clean = dict((i, lang) for i, _, lang in rows)
    wrong = next(i for i in range(1001, 1100) if zlib.crc32(str(i).encode()) % 4 == 2)  # not learned from
    rows += [(1000, said(rng, "xx", 60), None), (wrong, said(rng, "yy", 60), "xx")]
    foreign = [" ".join("".join(rng.choice("абвгдежзиклмнопрстуфхцчшыьэюя") for _ in range(6)) for _ in range(60)) for _ in range(10)]
    rows += [(2000 + i, t, None) for i, t in enumerate(foreign)] + [(3000, "12 34", "xx"), (3001, None, None)]
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["lang"] for r in corpus_pipeline.language(spark, docs, "").collect()}
    assert got == clean | {1000: "xx", wrong: "yy"}
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    kept = corpus_pipeline.language(spark, unlabelled, "").collect()
    assert {r["doc_id"] for r in kept} == {i for i, t, _ in rows if t and any(c.isalpha() for c in t)} and all(r["lang"] is None for r in kept)


def test_tokens_decode(spark):
    rows = [(1, "Ein Wort, 2 Wörter.\n"), (2, "\u2603 x\ty"), (3, ""), (4, None)]
    out = corpus_pipeline.tokens(spark, spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string"), "")
    assert {r["doc_id"]: r["decoded_sha256"] for r in out.collect()} == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in rows}
