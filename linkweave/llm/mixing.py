"""Temperature mixing of sources to a token budget.

Weights are token shares to the power alpha, normalised.  Alpha goes down from 1
(natural shares) towards 0 (equal weights) until the weights' entropy meets its
target, but never so far that a source would be repeated more than ``repeats`` times.
Both are monotone in alpha, which is bisected: each pass over the table of sources
tries 32 exponents at once.  The target is either ``entropy``, as a part of the largest
possible, or, if that is None, the natural shares' entropy and ``closing`` of what it
lacks to the largest: shares that aren't equal then always give an alpha below 1.

The weights are realised per source as whole passes over it and one partial pass.
A pass is a permutation of the source's blocks of documents; the partial pass takes
blocks in its order, up to the one that brings it nearest to what is due.  Blocks are a
bounded number per source, so the permutation is decided on small tables, and documents
learn from their source's row alone how often they are taken.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._scratch import drop, store

#: Exponents tried a pass, and passes.
STEPS, PASSES = 32, 5
#: Blocks a source is dealt into; sources up to which their table is broadcast (about 100 bytes each).
BLOCKS, BROADCAST_SOURCES = 1_024, 50_000
WORD = r"[^\x20\x09-\x0D]+"


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def temperature(sources: DataFrame, budget: float, entropy: float | None, closing: float, repeats: float) -> float:
    """The exponent for a table (source, tokens) of positive tokens; a multiple of 2**-25, or the least one that the limit allows."""
    total, n = sources.agg(F.sum("tokens"), F.count("*")).first()
    if not n:
        return 1.0
    shares = sources.select((F.col("tokens") / F.lit(float(total))).alias("p"), F.explode(F.sequence(F.lit(0), F.lit(STEPS))).alias("i"))

    def measures(low: float, other: float, width: float) -> list[tuple[float, float]]:
        """(entropy, most repeats) at each step of the width from ``low`` and from ``other``."""
        a, b = (F.lit(x) + F.lit(width) * F.col("i") / STEPS for x in (low, other))
        w, v = F.pow("p", a), F.pow("p", b)
        got = shares.groupBy("i").agg(F.sum(w), F.sum(w * F.log(w)), F.sum(v), F.max(F.pow("p", b - 1))).collect()
        return [(_log(w) - wlog / w, most / v * budget / total) for _, w, wlog, v, most in sorted(got)]

    ends = measures(0.0, 0.0, 1.0)
    natural, limited = ends[-1][0], ends[0][1] > repeats + 1e-12
    wanted = natural + closing * (_log(n) - natural) if entropy is None else entropy * _log(n)
    low, floor, width = 0.0, 0.0, 1.0
    for k in range(PASSES):
        got = ends if k == 0 else measures(low, floor, width)
        good = max((i for i, (h, _) in enumerate(got) if h >= wanted - 1e-12), default=0)
        over = max((i for i, (_, t) in enumerate(got) if t > repeats + 1e-12), default=0)
        low, floor, width = low + width * good / STEPS, floor + width * over / STEPS, width / STEPS
    return min(1.0, max(low, floor + 2.0**-25) if limited else low)


def _log(x: float) -> float:
    return math.log(x) if x > 0 else 0.0


def plan(
    docs: DataFrame, budget: int | None = None, epochs: float = 1.0, entropy: float | None = None, closing: float = 0.5, repeats: float = 4.0, seed: int = 11,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> tuple[DataFrame, float]:
    """Stored (source, tokens, weight, passes, rest, cut) by source, and the exponent.

    ``passes`` whole passes are due, and a partial one of the blocks whose order key
    is at most ``cut`` (none if null).  A null source is a source of its own; sources
    without a word get no weight and no pass.
    """
    block = _block(id_col, text_col)
    dealt = docs.select(F.col(f"`{source_col}`").cast("string").alias("source"), block.alias("block"), count_words(F.col(f"`{text_col}`")).alias("tokens"))
    blocks = store(dealt.groupBy("source", "block").agg(F.sum("tokens").alias("tokens")))
    sources = store(blocks.groupBy("source").agg(F.sum("tokens").alias("tokens")).filter("tokens > 0"))
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    budget = min(math.floor(epochs * total + 0.5) if budget is None else budget, math.floor(repeats * total))
    alpha = temperature(sources, float(budget), entropy, closing, repeats) if total else 1.0
    power = F.pow(F.col("tokens") / F.lit(float(max(total, 1))), F.lit(alpha))
    norm = sources.agg(F.sum(power)).first()[0] or 1.0
    due = sources.select("source", "tokens", (power / F.lit(norm)).alias("weight"))
    due = due.withColumn("due", F.floor(F.col("weight") * F.lit(float(budget)) + F.lit(0.5)))
    due = due.withColumn("passes", F.floor(F.col("due") / F.col("tokens"))).withColumn("rest", F.col("due") - F.col("passes") * F.col("tokens"))
    key = order_key("source", "block", "passes", seed)
    spread = blocks.join(due.select(F.col("source").alias("s"), "passes", "rest"), F.col("source").eqNullSafe(F.col("s"))).select("source", "rest", "tokens", key.alias("key"))
    w = Window.partitionBy("source").orderBy("key")  # at most BLOCKS rows a source
    nearer = F.col("rest") >= F.col("upto") - F.col("tokens") / 2
    cuts = spread.withColumn("upto", F.sum("tokens").over(w)).filter((F.col("rest") > 0) & nearer).groupBy(F.col("source").alias("s")).agg(F.max("key").alias("cut"))
    out = store(due.join(cuts, F.col("source").eqNullSafe(F.col("s")), "left").drop("s", "due"))
    drop(blocks)
    drop(sources)
    return out, alpha


def _hash(*parts: str | Column) -> Column:
    return F.md5(F.concat_ws("|", *[(F.col(x) if isinstance(x, str) else x).cast("string") for x in parts]).cast("binary"))


def _block(id_col: str, text_col: str) -> Column:
    """Block number of a document by its id and text."""
    digits = F.substring(_hash(F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))), 1, 8)
    return F.conv(digits, 16, 10).cast("long") % BLOCKS


def order_key(source: str, block: str, epoch: str, seed: int) -> Column:
    """Place of a block in an epoch's permutation of its source; the block's number keeps places distinct."""
    name = F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("null"))
    return F.concat(F.substring(_hash(name, block, epoch, F.lit(seed)), 1, 16), F.lpad(F.col(block).cast("string"), 4, "0"))


def mix(
    docs: DataFrame, budget: int | None = None, epochs: float = 1.0, entropy: float | None = None, closing: float = 0.5, repeats: float = 4.0, seed: int = 11,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """``docs`` mixed: a row for each time a document is taken, with mix_epoch, mix_order and mix_weight.

    ``mix_order`` orders the blocks within (source, mix_epoch).  ``budget`` counts
    words and is ``epochs`` times all words of ``docs`` if None.  A budget over
    ``repeats`` times all words can't be met within the limit: every source is then
    taken ``repeats`` times, and the mix is smaller than the budget.  Each source gets
    what is due to it within half of its largest block of documents, so a source of one
    document gets its partial pass if at least half of the document is due.

    A source without a word, and so an empty table, gives no rows; within a source,
    empty texts go with their block.  A null source is one source.  Repeated rows are
    separate documents of one block.  Columns already named mix_epoch, mix_order or
    mix_weight are replaced; other columns stay.
    """
    due, _ = plan(docs, budget, epochs, entropy, closing, repeats, seed, id_col, text_col, source_col)
    due = due.select(F.col("source").alias("__source"), F.col("weight").alias("mix_weight"), F.col("passes").alias("__passes"), F.col("cut").alias("__cut"))
    if due.count() <= BROADCAST_SOURCES:
        due = F.broadcast(due)
    rows = docs.drop("mix_epoch", "mix_order", "mix_weight").withColumn("__block", _block(id_col, text_col)).withColumn("__name", F.col(f"`{source_col}`").cast("string"))
    rows = rows.join(due, F.col("__name").eqNullSafe(F.col("__source")))
    last = order_key("__name", "__block", "__passes", seed) <= F.col("__cut")
    times = F.col("__passes") + F.coalesce(last, F.lit(False)).cast("long")
    taken = rows.withColumn("mix_epoch", F.explode(F.when(times > 0, F.sequence(F.lit(0).cast("long"), times - 1)).otherwise(F.array().cast("array<long>"))))
    return taken.withColumn("mix_order", order_key("__name", "__block", "mix_epoch", seed)).drop("__block", "__name", "__source", "__passes", "__cut")
