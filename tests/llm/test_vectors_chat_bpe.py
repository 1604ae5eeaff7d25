import hashlib
import random
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linkweave.llm import ann, bpe, chat, exact_topk
from linkweave.llm.queries import QUERIES
from tests.llm import brute
from tests.llm.test_text_operators import messy

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
BAD = [(None, [1.0, 2.0]), (5000, None), (5010, []), (5020, [None, 1.0]), (5030, [float("nan"), 1.0]), (5040, [float("inf"), 1.0]), (5050, [1.0] * 99)]


def table(spark, rows):
    df = spark.createDataFrame([(i, v) for i, v in rows], "vec_id long, embedding array<double>")
    return df.withColumns({"v": F.lit("own"), "score": F.lit(None).cast("string"), "shard": F.lit(1), "cell": F.lit("x"), "rank": F.lit(0)})


def test_exact_topk(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=20).round(1).tolist()) for i in range(700)]
    rows[33] = (33, rows[10][1])
    rows += [(701, [0.0] * 20), (702, [1e-9] * 20)]
    got = [tuple(r) for r in exact_topk.exact_topk(table(spark, rows + BAD)).orderBy("query_id", "rank").collect()]
    ints = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows]
    assert got == brute.top(ints, {i for i, _ in rows if i % 50 == 0}, 5)


def test_exact_topk_far_numbers_and_few_rows(spark):
    rows = [(i, [float(2**22 + i), -1.0]) for i in range(0, 200, 50)]
    got = [(r["query_id"], r["vec_id"]) for r in exact_topk.exact_topk(table(spark, rows)).orderBy("query_id", "rank").collect()]
    assert got == [(q, i) for q in range(0, 200, 50) for i in range(150, -1, -50) if i != q]
    assert exact_topk.exact_topk(table(spark, rows).limit(0)).collect() == []


def test_bound_search_prunes_nothing_that_counts():
    rng = np.random.default_rng(3)
    rows = rng.integers(-40, 40, (3000, 24))
    rows[::7] = rows[0]
    shard = exact_topk.Shard(np.arange(3000), rows)
    for q in range(0, 300, 50):
        ids, score = shard.search(q, rows[q], 5)
        want = sorted((-int(s), i) for i, s in enumerate(rows @ rows[q]) if i != q)[:5]
        assert [(-int(s), int(i)) for i, s in zip(ids, score)] == want


def test_multi_index(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + 0.4 * rng.normal(size=16)).tolist()) for i in range(2000)]
    out = ann.nearest_neighbours(table(spark, rows + BAD + [(6000, [0.0] * 16)])).collect()
    true = brute.top(rows, {i for i, _ in rows if i % 20 == 0}, 20)
    want, got = {}, {}
    for q, _, i, s in true:
        want.setdefault(q, {})[i] = s
    for r in out:
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
        assert r["vec_id"] != r["query_id"] and r["score"] == pytest.approx(np.dot(rows[r["query_id"]][1], rows[r["vec_id"]][1]), abs=1e-12)
    assert set(got) == set(want) and all([x[0] for x in sorted(v)] == list(range(1, 21)) for v in got.values())
    assert np.mean([len(want[q].keys() & {x[1] for x in got[q]}) / 20 for q in want]) >= 0.9


def test_multi_index_ties(spark):
    """Equal vectors score equally wherever they lie, and the smaller ids are kept."""
    rng = np.random.default_rng(6)
    base = rng.normal(size=(40, 33))
    base /= np.linalg.norm(base, axis=1)[:, None]
    rows = [(i, base[i % 40].tolist()) for i in range(1200)]
    got = [tuple(r)[:3] for r in ann.nearest_neighbours(table(spark, rows), recall=1.0).orderBy("query_id", "rank").collect()]
    want = {(q, i) for q, _, i, _ in brute.top(rows, {i for i, _ in rows if i % 20 == 0}, 20)}
    assert {(q, i) for q, _, i in got} == want
    for q in range(0, 1200, 20):
        assert [i for p, _, i in got if p == q] == [i for i in range(q % 40, 1200, 40) if i != q][:20]
    places, score = ann.best_exact(base[[3, 7, 3, 3, 9]], np.array([5, 1, 4, 9, 2]), base[3], 2)
    assert places.tolist() == [2, 0] and score[0] == score[1] == sum(x * x for x in base[3])


def test_multi_index_few_rows_and_copies(spark):
    rows = [(i, [1.0, float(i)]) for i in (0, 20, 3)]
    got = {(r["query_id"], r["vec_id"]) for r in ann.nearest_neighbours(table(spark, rows)).collect()}
    assert got == {(0, 20), (0, 3), (20, 0), (20, 3)}
    got = ann.nearest_neighbours(table(spark, [(0, [1.0, 2.0])] * 30 + [(1, [1.0, 2.0])] * 30)).collect()
    assert len(got) == 20 and {r["vec_id"] for r in got} == {1}
    assert ann.nearest_neighbours(table(spark, rows).limit(0)).collect() == []


@given(st.text(), st.text())
def test_escape(role, text):
    assert chat.unescape(chat.escape(text)) == text
    turn = f"{chat.TURN}{chat.escape(role, True)}{chat.MIDDLE}{chat.escape(text)}{chat.END}"
    assert chat.parse(turn * 2) == [(role, text)] * 2


def test_chat(spark):
    said = [(1, 0, "user", "hi # <b>"), (1, 1, "assistant", r"\### Assistant: </turn> ok"), (1, 2, "user", None), (1, 3, "assistant", ""), (1, 4, None, "bye"), (2, 0, "system", "x"), (None, 0, "user", "y"), (3, None, "assistant", "first"), (3, 1, "user", "z"), (3, 1, "user", "a"), (4, 0, "a: b", "c\nd")]
    said += [(9, i, "user" if i % 2 == 0 else "assistant", "long " * 50) for i in range(400)]
    turns = spark.createDataFrame(said, "conv_id long, turn long, role string, text string").withColumns({"example": F.lit(1), "formatted": F.lit("no")})
    ex = chat.expand(turns)
    rows = ex.filter("conv_id = 1").orderBy("example").collect()
    assert [r["formatted"][r["loss_start"] : r["loss_end"]] for r in rows] == [chat.escape(r"\### Assistant: </turn> ok"), "", ""]
    assert chat.parse(rows[-1]["formatted"]) == [("user", "hi # <b>"), ("assistant", r"\### Assistant: </turn> ok"), ("user", ""), ("assistant", ""), ("", "bye")]
    got = {r["conv_id"]: r for r in chat.read_back(ex).collect()}
    assert set(got) == {1, 2, None, 3, 4, 9} and got[9]["n_turns"] == 400 and got[2]["loss_chars"] == 0
    order = [("assistant", "first"), ("user", "a"), ("user", "z")]
    assert got[3]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in order).encode()).hexdigest()
    assert got[9]["loss_sha256"] == hashlib.sha256(("long " * 50 * 200).encode()).hexdigest()
    assert chat.read_back(chat.expand(turns.limit(0))).collect() == []


def test_chat_without_replies_and_without_ids(spark, monkeypatch):
    """Conversations without an assistant are sent in batches too; turns without a conversation stand alone."""
    turns = [(c, t, "user", f"{c} says {t}") for c in range(300) for t in range(2)]
    batch = chat.pa.RecordBatch.from_arrays([chat.pa.array(x) for x in zip(*turns)], ["conv_id", "turn", "role", "text"])
    monkeypatch.setattr(chat, "BATCH_CHARS", 1_000)
    out = list(chat._expand(iter([batch])))
    assert len(out) > 10 and sum(b.num_rows for b in out) == 300
    assert max(sum(len(x) for x in b.column(2).to_pylist()) for b in out) < 1_200
    alone = spark.createDataFrame([(None, 1, "user", "a"), (None, 2, "assistant", "b"), (None, 2, "assistant", "b"), (None, None, None, None)], "conv_id long, turn long, role string, text string")
    got = chat.read_back(chat.expand(alone)).collect()
    assert sorted((r["n_turns"], r["loss_chars"]) for r in got) == [(1, 0), (1, 0), (1, 1), (1, 1)]


def test_chat_read_back_reads_contexts(spark):
    said = [(1, i, "user" if i % 2 == 0 else "assistant", f"turn {i}") for i in range(6)]
    ex = chat.expand(spark.createDataFrame(said, "conv_id long, turn long, role string, text string"))
    assert chat.read_back(ex).count() == 1
    broken = [("formatted", F.when(F.col("example") == 1, F.replace("formatted", F.lit("turn 0"), F.lit("turn x"))).otherwise(F.col("formatted"))), ("loss_start", F.col("loss_start") + 1)]
    for column, value in broken:
        with pytest.raises(Exception, match="another context|under its mask"):
            chat.read_back(ex.withColumn(column, value)).collect()


@lru_cache
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.load(PATH, PATTERN).ranks, special_tokens={})


@pytest.fixture(scope="module")
def tik():
    return library()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(), st.text(alphabet="abc etaoin'é.  \n12", max_size=80)), max_size=4))
def test_bpe_as_the_library(texts):
    e, t = bpe.load(PATH, PATTERN), library()
    for text, ids in zip(texts, e.encode_many(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode_ordinary(text)
        assert e.decode(ids) == text.encode()


def test_bpe_long_pre_tokens(tik):
    e, rng = bpe.load(PATH, PATTERN), random.Random(8)
    for alphabet in ("a", "ab", "etaoinshr", "né漢", "."):
        text = "".join(rng.choice(alphabet) for _ in range(20_000))
        assert e.merge(text.encode()) == tik._encode_single_piece(text.encode())
    for n in range(1, 70):
        raw = bytes(rng.randrange(256) for _ in range(n))
        assert e.merge(raw) == tik._encode_single_piece(raw)
    assert not any(e.queue.low) and set(e.queue.buckets) == {None}


def test_bpe_queue_serves_every_pre_token():
    """What isn't a vocabulary entry is merged by the queue once, and again only when the memo has let it go."""
    e = bpe.Encoder(bpe.load(PATH, PATTERN).ranks, PATTERN)
    merged = []
    own = e.merge
    e.merge = lambda piece: (merged.append(piece), own(piece))[1]
    texts = ["lorem ipsum zyxwvu zyxwvu", "qqxqj zyxwvu", "aaaaaaa" * 30]
    e.encode_many(texts)
    assert sorted(merged) == sorted({x.encode() for t in texts for x in e.find(t)} - e.ranks.keys())
    assert e.queue.pushed > len(merged) and e.queue.stale > 0


def test_bpe_memo_is_bounded(monkeypatch, tik):
    monkeypatch.setattr(bpe, "MEMO_BYTES", 5_000)
    e, rng = bpe.Encoder(bpe.load(PATH, PATTERN).ranks, PATTERN), random.Random(4)
    texts = [" ".join("".join(rng.choice("bcdfgh") for _ in range(rng.choice([3, 9, 700]))) for _ in range(20)) for _ in range(20)]
    assert [np.frombuffer(x, "<u4").tolist() for x in e.encode_many(texts)] == [tik.encode_ordinary(t) for t in texts]
    assert len(e.known) + len(e.known.older) <= 2 * 5_000 // bpe._ENTRY and max(map(len, e.known)) <= bpe.MEMO_LONGEST


def test_bpe_ranks_out_of_order():
    """A merge may make a pair of a lower rank than its own; it is next, before what else has the old rank."""
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 300, b"abc": 260, b"abcab": 259, b"ca": 301}
    e = bpe.Encoder(ranks, PATTERN)
    t = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    for text in ("abcabcab", "ababab", "cabcabca", "aabbcc"):
        assert e.merge(text.encode()) == t._encode_single_piece(text.encode())


def test_bpe_tables(spark, tik):
    docs = messy(spark)
    coded = bpe.encode(docs, PATH, PATTERN)
    assert coded.columns == [c for c in docs.columns if c != "token_ids"] + ["token_ids"]
    back = bpe.decode(coded, PATH, PATTERN).collect()
    assert len(back) == 12
    for r in back:
        assert r["token_ids"] == tik.encode_ordinary(r["text"] or "") and bytes(r["decoded"]) == (r["text"] or "").encode()
    digest = bpe.round_trip(docs, PATH, PATTERN).collect()
    assert sorted(r["n_tokens"] for r in digest) == sorted(len(r["token_ids"]) for r in back)
    assert bpe.encode(docs.limit(0), PATH, PATTERN).collect() == [] == bpe.round_trip(docs.limit(0), PATH, PATTERN).collect()


def test_queries_are_all_there():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
