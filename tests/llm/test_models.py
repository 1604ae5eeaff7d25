import math
import random
import zlib

import numpy as np
import pytest

from linkweave.llm import language_id, quality, toxicity
from tests.llm.test_text_operators import messy

PARTS = {"xx": "sha tol ner vim kat rus".split(), "yy": "lio mue sia ono rea tui".split(), "zz": "grz pfu schm bro dwa kle".split()}


def said(rng, lang, n=60):
    return " ".join("".join(rng.choice(PARTS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    return [(i, said(rng, lang), lang) for i, lang in enumerate(rng.choice(sorted(PARTS)) for _ in range(600))]


def test_codewords():
    for k in (2, 3, 5, 7, 12, 40):
        code = language_id.codewords(k)
        assert code.shape[0] == k and len({tuple(r) for r in code}) == k
        gaps = [(code[i] != code[j]).sum() for i in range(k) for j in range(i)]
        assert min(gaps) >= max(1, code.shape[1] // 4)


def test_language(spark, texts):
    docs = spark.createDataFrame([*texts, (9001, "12 34 !!", "xx"), (9002, None, "yy"), (9003, "", None)], "doc_id long, text string, lang string")
    rows = {r["doc_id"]: r for r in language_id.identify(docs).collect()}
    held = [(i, lang) for i, _, lang in texts if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(rows[i]["held_out"] for i, _ in held)
    assert np.mean([rows[i]["lang_pred"] == lang for i, lang in held]) > 0.97
    assert all(rows[i]["lang_pred"] == "und" and rows[i]["score"] == 0 for i in (9001, 9002, 9003))
    assert all(0 <= r["score"] <= 1 for r in rows.values())


def test_decoding_against_a_plain_version():
    """Bit by bit: logistic losses weighed by trust, softmax over languages, the gap to the second."""
    rng = np.random.default_rng(2)
    for k in (2, 3, 5, 9):
        code = language_id.codewords(k)
        m = language_id.Model([str(i) for i in range(k)], code, rng.normal(size=(12, code.shape[1])), rng.normal(size=code.shape[1]), rng.random(code.shape[1]), 4.0)
        x = rng.normal(size=(30, 12))
        best, top, gap = m.decode(x)
        for row in range(30):
            margins = [sum(x[row, i] * m.weights[i, j] for i in range(12)) + m.bias[j] for j in range(code.shape[1])]
            loss = [sum(t * math.log1p(math.exp(-3 * f * c)) for f, c, t in zip(margins, word, m.trust)) for word in code]
            p = [math.exp(-4 * (z - min(loss))) for z in loss]
            p = sorted(((q / sum(p), i) for i, q in enumerate(p)), reverse=True)
            assert best[row] == p[0][1] and top[row] == pytest.approx(p[0][0]) and gap[row] == pytest.approx(p[0][0] - p[1][0])


def test_many_languages(spark, texts, monkeypatch):
    monkeypatch.setattr(language_id, "MAX_LANGUAGES", 3)
    rows = [*texts, *((2000 + i, said(random.Random(i), "zz"), f"rare{i}") for i in range(20))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs, "doc_id", "text", "lang")
    first = sorted(PARTS, key=lambda k: (-sum(lang == k for _, _, lang in texts), k))[:2]
    assert model.languages == sorted([*first, language_id.REST])
    assert {r["lang_pred"] for r in language_id.identify(docs).collect()} == set(model.languages)


def test_every_language_is_drawn(spark, monkeypatch):
    monkeypatch.setattr(language_id, "SAMPLE_ROWS", 120)
    docs = spark.range(6000).selectExpr("id as doc_id", "concat('text of number ', id) as text", "concat('l', id % 60) as lang")
    assert len(language_id.fit(docs, "doc_id", "text", "lang").languages) == 60


def test_language_messy(spark):
    docs = messy(spark).withColumnRenamed("token", "lang")
    assert {r["lang_pred"] for r in language_id.identify(docs).collect()} == {"und"}
    assert language_id.identify(docs.limit(0)).collect() == []


def junk(rng, text):
    return " ".join(w.upper() + "!!" for w in text.split()) if rng.random() < 0.5 else " ".join(w + rng.choice(["$$$", "%%%"]) for w in text.split())


def test_quality(spark, texts):
    rng = random.Random(6)
    rows = [(i, junk(rng, t) if i % 5 == 1 else t, int(i % 5 != 1)) for i, t, _ in texts]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5, None)], "doc_id long, quality int")
    out = {r["doc_id"]: r for r in quality.score_quality(docs, labels).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert all(out[i]["held_out"] for i, _, _ in held)
    assert np.mean([out[i]["predicted"] == y for i, _, y in held]) > 0.97


def plain_statistics(text):
    raw, words, lines = text.encode(), text.encode().split(), [x for x in text.encode().split(b"\n") if x]
    part = lambda a, b: a / max(b, 1)
    most = lambda xs: max(map(xs.count, xs), default=0)
    count = lambda s: sum(c in s for c in raw)
    upper, lower, digit, stop = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58)), b".,;:?!'\"()-"
    head, tail = bytes(range(192, 256)), bytes(range(128, 192))
    mark = bytes(set(range(128)) - set(upper + lower + digit + stop + b" \t\x0b\x0c\r\n"))
    chars, n = len(raw) - count(tail), len(words)
    soft = [bytes(c + 32 if c in upper else c for c in w) for w in words]
    runs = [tuple(soft)] if 0 < n < 3 else [tuple(soft[i : i + 3]) for i in range(n - 2)]
    size = [len(w) for w in words]
    mean = part(sum(size), n)
    has = lambda w, s: sum(c in s for c in w)
    low = lower + head + tail
    loglen = [math.log1p(len(x)) for x in lines]
    m = part(sum(loglen), len(lines))
    return [
        math.log1p(chars), math.log1p(n), mean, math.sqrt(max(part(sum(s * s for s in size), n) - mean**2, 0)),
        part(count(upper), chars), part(count(digit), chars), part(count(b" \t\x0b\x0c\r"), chars), part(count(b"\n"), chars), part(count(stop), chars), part(count(mark), chars), part(count(head), chars),
        part(sum(has(w, mark) > 0 for w in words), n), part(sum(has(w, upper) > 1 and has(w, low) == 0 for w in words), n), part(sum(has(w, upper) + has(w, low) == 0 for w in words), n), part(sum(s <= 3 for s in size), n), part(sum(s >= 16 for s in size), n),
        part(len(set(soft)), n), part(most(soft), n), part(len(set(runs)), len(runs)), part(most(runs), len(runs)),
        math.log1p(len(lines)), part(n, len(lines)), math.sqrt(max(part(sum(x * x for x in loglen), len(lines)) - m**2, 0)), part(len(set(lines)), len(lines)), part(most(lines), len(lines)), part(sum(len(x) < 20 for x in lines), len(lines)),
    ]


def test_statistics_against_a_plain_version():
    rng = random.Random(8)
    texts = ["", "a", "\n", "Ab cD\n\nAb cD EF", "né 漢字!! 12,5 $x$", "x" * 50] + ["".join(rng.choice("abAB1 .,#\n\té") for _ in range(rng.randrange(200))) for _ in range(60)]
    raw = [t.encode() for t in texts]
    got = quality.statistics(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(x) for x in raw]))
    assert got.shape == (len(texts), quality.FEATURES)
    for row, text in zip(got, texts):
        assert row.tolist() == pytest.approx(plain_statistics(text), abs=1e-9), text


def test_quality_messy(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (5, 1), (7, 0), (9, None)], "doc_id long, quality int")
    for docs, n in ((messy(spark), 12), (messy(spark).limit(0), 0)):
        for lab in (labels, labels.limit(0)):
            rows = quality.score_quality(docs, lab).collect()
            assert len(rows) == n and all(0 <= r["score"] <= 1 for r in rows)


def test_trees_are_flat_copies_of_branches():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    f = quality.grow(x, y, trees=30)
    assert ((f.score(x) > 0.5) == y).mean() > 0.95
    b = f.bin(x)
    for row in range(20):
        margin = f.base
        for feature, cut, leaf in zip(f.feature, f.cut, f.leaf):
            node = 0
            for _ in range(quality.DEPTH):
                node = 2 * node + (2 if b[row, feature[node]] > cut[node] else 1)
            margin += leaf[node - len(feature)]
        assert f.score(x[row : row + 1])[0] == pytest.approx(1 / (1 + np.exp(-margin)))


def test_toxicity(spark, texts):
    rng = random.Random(7)
    rows = []
    for i, t, _ in texts:
        parts = [t, said(random.Random(i), "xx", 9), said(random.Random(-i), "yy", 9)]
        if i % 4 == 1:
            at = rng.randrange(3)
            w = parts[at].split()
            w[len(w) // 2] = rng.choice(["wretch", "wretched", "vermin!"])
            parts[at] = " ".join(w)
        rows.append((i, " ".join(parts), int(i % 4 == 1)))
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    out = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, labels).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert np.mean([out[i]["predicted"] == y for i, _, y in held]) > 0.97
    for i, text, y in held:
        if y and out[i]["predicted"]:
            found = out[i]["offending"]
            assert found and any("wretch" in (s := text.encode()[x["first_byte"] :].decode().split(".")[0]) or "vermin" in s for x in found)


def test_sentences_and_noisy_or_against_plain_versions():
    texts = ["One two. Three! four?\n\nfive", "", "...", "no end here", "a.b c? d"]
    raw = [t.encode() for t in texts]
    off = np.cumsum([0] + [len(x) for x in raw])
    bucket, sentence, doc, begin = toxicity.sentences(np.frombuffer(b"".join(raw), np.uint8), off)
    joined = b"".join(raw)
    assert [(int(d), joined[b : b + 4].decode()) for d, b in zip(doc, begin)] == [(0, "One "), (0, "Thre"), (0, "four"), (0, "five"), (3, "no e"), (4, "a.b "), (4, "b c?"), (4, "d")]
    assert np.bincount(sentence).tolist() == [2, 3, 2, 2, 3 + 1, 1, 2, 1]  # words, and beginnings of those over 3 bytes
    z, of = np.array([-2.0, 0.5, -30.0, 3.0]), np.array([0, 0, 1, 3])
    p = 1 / (1 + np.exp(-z))
    want = [1 - (1 - p[0]) * (1 - p[1]), p[2], 0.0, p[3]]
    assert toxicity.noisy_or(z, of, 4).tolist() == pytest.approx(want, abs=1e-12)


def test_training_climbs_the_noisy_or_likelihood():
    """One feature only in positive documents gets a positive weight; the likelihood beats the base rate's."""
    rng = np.random.default_rng(4)
    y = (np.arange(200) % 4 == 0).astype(float)
    doc = np.repeat(np.arange(200), 2)
    feature, sentence = [], []
    for s, d in enumerate(doc):
        feature.append(0 if y[d] and s % 2 == 0 else int(rng.integers(1, 6)))
        sentence.append(s)
    model = toxicity.train(np.arange(6), np.array(feature), np.array(sentence), doc, np.ones(200), y)
    z = model.bias + model.weights[np.array(feature)]
    p = np.clip(1 - np.exp(-np.bincount(doc, np.logaddexp(0, z)) - np.logaddexp(0, model.bias)), 1e-9, 1 - 1e-9)
    fit = (y * np.log(p) + (1 - y) * np.log(1 - p)).mean()
    assert model.weights[0] > 1 > model.weights[1:6].max() and fit > 0.25 * np.log(0.25) + 0.75 * np.log(0.75) + 0.3


def test_toxicity_messy(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (5, 1), (7, 0), (9, None)], "doc_id long, toxic int")
    for docs, n in ((messy(spark), 12), (messy(spark).limit(0), 0)):
        for lab in (labels, labels.limit(0)):
            rows = toxicity.score_toxicity(docs, lab).collect()
            assert len(rows) == n and all(0 <= r["score"] <= 1 for r in rows)
