"""The similarity join of specs and code: candidates by shared token or directory, then scores.

Overlaps are counted while joining, from token rows, so no array crosses a join: the
union's size is |S| + |C| - |overlap|, and S is a subset if |overlap| = |S|.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import top_dir, unfolded
from ..schema import IMPLEMENTS, INFERRED, VERIFIES, WEAK
from ..scratch import store
from .graph import ranked
from .substring import inside_pairs

LEAST_CONFIDENCE, WEAK_BELOW = 0.15, 0.4
#: Codes of one token that meet specs in one partition.
HOT = 50_000
#: Spec tokens, and specs, that are sent to every task.
SMALL = 200_000
#: Pairs of spec and code (beyond SMALL: rows of shared tokens) that one task counts, about.
PAIRS = 500_000


def _parts(df: DataFrame, pairs: int) -> int:
    """Partitions for so many pairs: ``PAIRS`` each, but no fewer than any shuffle has."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pairs // PAIRS))


def _overlaps(specs: DataFrame, codes: DataFrame, *near: tuple[DataFrame, Column]) -> DataFrame:
    """Pairs that share a token, or a name in ``near``, with their counts and first tokens.

    Each of ``near`` has (spec_id, token), the names near a spec, and a code's name; they
    are joined as tokens of their own kind, which count for nothing.

    Up to ``SMALL`` spec tokens go to every task.  Codes are dealt by id into as many
    parts as specs times codes need, so a pair's rows are made and counted in one task,
    and that holds no more pairs as the tables grow.  Beyond, both sides meet by token,
    and the rows of a pair by its ids, in parts by the number of rows; a token of more
    than ``HOT`` codes is dealt into parts by code, and the specs that have it meet each
    part by itself.  The hot tokens are few, at most a ``HOT``-th of all token rows, and
    are joined as their number tells.
    """
    mark = lambda kind, token, in_text, in_stem: F.struct(F.lit(kind).alias("kind"), token.alias("token"), in_text.alias("in_text"), in_stem.alias("in_stem"))
    no, yes, none = F.lit(False), F.lit(True), F.array().cast("array<string>")
    text, stem = F.coalesce("tokens", none), F.coalesce("stem_tokens", none)
    s = specs.select("spec_id", F.lit(0).alias("kind"), F.explode("tokens").alias("token"))
    marks = [F.transform(text, lambda t: mark(0, t, yes, F.array_contains(stem, t))), F.transform(F.array_except(stem, text), lambda t: mark(0, t, no, yes))]
    for kind, (names, name) in enumerate(near, 1):
        s = s.unionByName(names.select("spec_id", F.lit(kind).alias("kind"), "token"))
        marks.append(F.array(mark(kind, name, no, no)))
    s = store(s)
    small = s.count() <= SMALL
    columns = [x for x in ("code_id", "file", "stem", "tokens", "stem_tokens") if x in codes.columns]
    if small:
        codes = codes.select(*columns).repartition(_parts(s, specs.count() * codes.count()), "code_id")
    c = unfolded(codes, F.concat(*marks), "mark").select("code_id", "mark.*")
    if small:
        rows = c.join(F.broadcast(s), ["kind", "token"])
    else:
        n = c.groupBy("kind", "token").agg(F.count("*").alias("n_codes")).join(s.groupBy("kind", "token").agg(F.count("*").alias("n_specs")), ["kind", "token"], "left")
        n = store(n.select("kind", "token", "n_codes", (F.col("n_codes") * F.greatest(F.coalesce("n_specs", F.lit(0)), F.lit(1))).alias("n")))
        parts = _parts(s, n.agg(F.sum("n")).first()[0] or 0)
        hot = n.filter(F.col("n_codes") > HOT).select("kind", "token", F.ceil(F.col("n_codes") / HOT).alias("parts"))
        s = s.join(hot, ["kind", "token"], "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)))
        c = c.join(hot, ["kind", "token"], "left").withColumn("part", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("code_id"), "parts")))
        keys = ["kind", "token", "part"]
        rows = s.drop("parts").repartition(parts, *keys).join(c.drop("parts").repartition(parts, *keys), keys).repartition(parts, "spec_id", "code_id")
    first = lambda flag: F.slice(F.array_sort(F.collect_set(F.when(F.col(flag), F.col("token")))), 1, 5)
    return rows.groupBy("spec_id", "code_id").agg(
        F.count_if("in_text").alias("n_symbol"), F.count_if("in_stem").alias("n_stem"), first("in_text").alias("symbol_tokens"), first("in_stem").alias("stem_tokens")
    )


def token_pairs(specs: DataFrame, codes: DataFrame) -> DataFrame:
    """(spec_id, code_id, n_symbol, n_stem, symbol_tokens, stem_tokens): pairs that share a token.

    ``specs`` has (spec_id, tokens), ``codes`` (code_id, tokens, stem_tokens).
    """
    return _overlaps(specs, codes)


def dir_pairs(specs: DataFrame, codes: DataFrame, partial: bool) -> DataFrame:
    """(spec_id, code_id) with the same top directory, or (partial) with one's name inside the other's.

    Partial matches compare distinct directory names only.
    """
    s = specs.select("spec_id", top_dir(F.col("file")).alias("sdir")).filter("sdir <> ''")
    c = codes.select("code_id", top_dir(F.col("file")).alias("cdir")).filter("cdir <> ''")
    if not partial:
        return s.join(c, F.col("sdir") == F.col("cdir")).select("spec_id", "code_id")
    near = _either(s, "sdir", c, "cdir").filter("sdir <> cdir")
    return s.join(near, "sdir").join(c, "cdir").select("spec_id", "code_id")


def _either(left: DataFrame, a: str, right: DataFrame, b: str) -> DataFrame:
    """Distinct pairs of names of which one lies inside the other."""
    return inside_pairs(left, a, right, b).select(a, b).union(inside_pairs(right, b, left, a).select(a, b)).distinct()


def _near(specs: DataFrame, spec_name: Column, codes: DataFrame, code_name: Column) -> DataFrame:
    """(spec_id, token): the codes' names that are equal to a spec's, inside it or around it, by distinct names."""
    s, c = specs.select("spec_id", spec_name.alias("a")), codes.select(code_name.alias("token"))
    return s.join(_either(s, "a", c, "token"), "a").select("spec_id", "token")


def candidates(specs: DataFrame, codes: DataFrame, stems: bool = False) -> DataFrame:
    """Pairs that the graph builder scores, with what they share: those with a shared token, an equal or similar top directory, or (``stems``) file stem.

    Columns are those of ``token_pairs``; one join and one aggregation serve all.
    """
    folder = F.nullif(top_dir(F.col("file")), F.lit(""))
    near = [(_near(specs, folder, codes, folder), folder)]
    if stems:
        stem = F.lower("stem")
        near.append((_near(specs, stem, codes, stem), stem))
    return _overlaps(specs, codes, *near)


def _scaled(n: Column, size: Column, subset: Column | None = None) -> Column:
    jaccard = F.lit(3.0) * (n / (F.col("n_spec") + size - n))
    if subset is not None:
        jaccard = F.when(subset, F.greatest(jaccard, F.lit(0.85))).otherwise(jaccard)
    return F.when(n > 0, F.least(jaccard, F.lit(1.0))).otherwise(F.lit(0.0))


def score(pairs: DataFrame, specs: DataFrame, codes: DataFrame) -> DataFrame:
    """``pairs`` (``candidates``) with the signals s_dir, s_file, s_symbol, s_keyword and confidence.

    ``specs`` has (spec_id, file, stem, tokens), ``codes`` (code_id, file, stem,
    tokens, stem_tokens).  Codes are looked up by hash, and so are specs, in every task if
    up to ``SMALL``: pairs aren't sorted for it, nor all of a spec's sent to one task.
    """
    s = specs.select("spec_id", top_dir(F.col("file")).alias("sdir"), F.lower("stem").alias("ss"), F.size("tokens").alias("n_spec"))
    c = codes.select("code_id", top_dir(F.col("file")).alias("cdir"), F.lower("stem").alias("cs"), F.size("tokens").alias("n_code"), F.size("stem_tokens").alias("n_stems"))
    s = F.broadcast(s) if specs.count() <= SMALL else s.hint("shuffle_hash")
    rows = pairs.join(s, "spec_id").join(c.hint("shuffle_hash"), "code_id")
    both = (F.col("sdir") != "") & (F.col("cdir") != "")
    inside = lambda a, b: F.contains(a, F.col(b)) | F.contains(b, F.col(a))
    n, k = F.col("n_symbol"), F.col("n_stem")
    rows = rows.withColumns({
        "s_dir": F.when(both & (F.col("sdir") == F.col("cdir")), 1.0).when(both & inside("sdir", "cdir"), 0.6).otherwise(0.0),
        "s_file": F.when(F.col("ss") == F.col("cs"), 1.0).when(inside("ss", "cs"), 0.5).otherwise(0.0),
        "s_symbol": _scaled(n, F.col("n_code"), n == F.col("n_spec")),
        "s_keyword": _scaled(k, F.col("n_stems")),
    })
    total = F.lit(0.6) * F.col("s_dir") + F.lit(0.4) * F.col("s_file") + F.lit(0.3) * F.col("s_symbol") + F.lit(0.2) * F.col("s_keyword")
    return rows.withColumn("confidence", F.round(F.least(total / F.lit(1.5), F.lit(1.0)), 4))


def evidence() -> Column:
    """Evidence of a scored pair, signal by signal; needs columns spec_file and code_file too."""
    one = lambda kind, value, file, when: F.when(when, F.struct(F.lit(f"heuristic:{kind}").alias("kind"), value.alias("value"), file.alias("file"), F.lit(None).cast("int").alias("line")))
    sf, cf = F.col("spec_file"), F.col("code_file")
    mark = lambda c: F.when(c >= 1.0, F.lit("equal")).otherwise(F.lit("partial"))
    items = F.array(
        one("dirname", F.concat_ws(" ", mark(F.col("s_dir")), "sdir", "cdir"), sf, F.col("s_dir") > 0),
        one("filename", F.concat_ws(" ", mark(F.col("s_file")), "ss", "cs"), sf, F.col("s_file") > 0),
        one("symbol", F.concat(F.lit("shared: "), F.array_join("symbol_tokens", ", ")), cf, F.col("n_symbol") > 0),
        one("keyword", F.concat(F.lit("shared: "), F.array_join("stem_tokens", ", ")), sf, F.col("n_stem") > 0),
    )
    return F.filter(items, lambda x: x.isNotNull())


def relate(scored: DataFrame, least: float = LEAST_CONFIDENCE) -> DataFrame:
    """Edges of confident pairs: relation by is_test, strength weak below 0.4."""
    kept = scored.filter(F.col("confidence") >= least)
    return kept.withColumns({
        "relation": F.when(F.col("is_test"), VERIFIES).otherwise(IMPLEMENTS),
        "strength": F.when(F.col("confidence") < WEAK_BELOW, WEAK).otherwise(INFERRED),
    })


def function_scores(specs: DataFrame, functions: DataFrame) -> DataFrame:
    """(spec_id, func_id, confidence) of specs and functions that share a token.

    ``functions`` has (func_id, tokens).  Pairs without one score 0, so the join on
    tokens loses nothing of the cross product.
    """
    s = specs.select("spec_id", F.size("tokens").alias("n_spec"), F.explode("tokens").alias("token"))
    f = functions.select("func_id", F.size("tokens").alias("n_func"), F.explode("tokens").alias("token"))
    pairs = s.join(f, "token").groupBy("spec_id", "func_id", "n_spec", "n_func").agg(F.count("*").alias("n"))
    jaccard = F.lit(3.0) * (F.col("n") / (F.col("n_spec") + F.col("n_func") - F.col("n")))
    subset = (F.col("n") == F.col("n_spec")) | (F.col("n") == F.col("n_func"))
    boosted = F.when(subset, F.greatest(jaccard, F.lit(0.9))).otherwise(jaccard)
    return pairs.select("spec_id", "func_id", F.round(F.least(boosted, F.lit(1.0)), 4).alias("confidence"))


def suggest(orphans: DataFrame, codes: DataFrame, top: int = 3, least: float = 0.1) -> DataFrame:
    """(spec_id, code_id, score, rank): the best code of each spec, over all pairs that can reach ``least``.

    A score needs a shared token, a similar directory or a similar stem, so the union
    of these pairs stands for the cross product.  Of equal scores the code found first
    counts: by ``ord`` if ``codes`` has it, else by id.
    """
    rows = score(candidates(orphans, codes, stems=True), orphans, codes).filter(F.col("confidence") >= least)
    rows = rows.withColumn("score", F.round("confidence", 3))
    place = [F.asc("code_id")]
    if "ord" in codes.columns:
        rows, place = rows.join(codes.select("code_id", "ord").hint("shuffle_hash"), "code_id"), [F.asc("ord"), F.asc("code_id")]
    rows = ranked(rows, ["spec_id"], [F.desc("confidence"), *place])
    return rows.filter(F.col("rank") <= top).select("spec_id", "code_id", "score", "rank")
