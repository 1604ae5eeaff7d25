r"""Line dedup with a suffix array over line-ID sequences, built by distributed prefix doubling.

Every line becomes an ID; suffixes of all documents' ID sequences are ranked by
their first line, then by their first 2, 4, 8 ... lines, each time by sorting pairs
of ranks.  Ranks keep suffix order.  Suffixes that share a rank at 2**k lines are a
longest-common-prefix interval of that depth; those alone in theirs are settled and
leave, as are lines that occur once.

A repeated run counts from ``min_words`` words on.  The shortest run of whole lines
that starts (or ends) at a line and has as many words is its unit: a unit's interval
is found from two overlapping ranks.  Every occurrence of a unit but the first in
order of (id, line) is deleted, and the union of these is exactly the union of all
later copies of maximal repeated runs of at least ``min_words`` words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _bytes as B
from ._scratch import drop, store, temporary

U = np.uint64
#: A null id is 0 and not known, so that joins find it and it sorts first.
DOC = ["known", "id", "h"]
KEY = [*DOC, "pos"]
#: Most lines or runs that are joined by broadcast.
HOT = 10_000


def _scan(min_words: int):
    names = [*KEY, "l1", "l2", "fwd", "bwd"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, off in B.blocks(batch.column(len(DOC))):
                docs = j - i
                breaks = np.flatnonzero(raw == 10)
                per = np.searchsorted(breaks, off[1:]) - np.searchsorted(breaks, off[:-1]) + 1
                first = np.concatenate([[0], np.cumsum(per)])
                starts = np.empty(first[-1], np.int64)
                head = np.zeros(first[-1], bool)
                head[first[:-1]] = True
                starts[head], starts[~head] = off[:-1], breaks + 1
                ends = np.empty(first[-1], np.int64)
                tail = np.roll(head, -1)
                ends[tail], ends[~tail] = off[1:], breaks
                word = B.words(raw, off)[0]
                cum = np.searchsorted(word, ends)
                base = np.searchsorted(word, starts)
                doc = np.repeat(np.arange(docs), per)
                # shortest runs that reach min_words, within the document; 0: none
                last = np.searchsorted(cum, base + min_words)
                fwd = np.where((last < first[doc + 1]) & (base + min_words <= np.searchsorted(word, off[doc + 1])), last - np.arange(len(doc)) + 1, 0)
                begin = np.searchsorted(base, cum - min_words, "right") - 1
                bwd = np.where(begin >= first[doc], np.arange(len(doc)) - begin + 1, 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(k).slice(i, docs).take(pa.array(doc)) for k in range(len(DOC))),
                        pa.array((np.arange(len(doc)) - first[doc]).astype(np.int32)),
                        pa.array(B.span_hash(B.prefix_hash(raw), starts, ends).view(np.int64)),
                        pa.array(B.span_hash(B.prefix_hash(raw ^ np.uint8(0xA5)), starts, ends).view(np.int64)),
                        pa.array(fwd.astype(np.int32)),
                        pa.array(bwd.astype(np.int32)),
                    ],
                    names,
                )

    return run


def _ranked(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n, r) of the pairs that occur more than once, n times; r keeps their order."""
    often = pairs.groupBy(a, b).agg(F.count("*").alias("n")).filter("n > 1")
    return store(often.repartitionByRange(a, b).sortWithinPartitions(a, b).withColumn("r", F.monotonically_increasing_id()))


def _meet(rows: DataFrame, kinds: DataFrame, keys: list[str]) -> DataFrame:
    """Join of ``rows`` with ``kinds``, which has a row a key and in n the number of its ``rows``.

    Keys of more than a ``HOT``-th of all these rows, so at most ``HOT`` of them, are
    broadcast and leave their rows where they are; the rest are joined by key.
    """
    total = kinds.agg(F.sum("n")).first()[0] or 0
    hot = kinds.filter(F.col("n") > total // HOT).withColumn("__hot", F.lit(True))
    marked = rows.join(F.broadcast(hot), keys, "left")
    cold = marked.filter("__hot is null").select(*rows.columns).join(kinds.filter(F.col("n") <= total // HOT), keys)
    return marked.filter("__hot").drop("__hot").unionByName(cold)


def _later_copies(units: DataFrame) -> DataFrame:
    """(known, id, h, start, length) of the units (r1, r2, length) that aren't their kind's first."""
    place = F.struct(*KEY)
    first = store(units.groupBy("r1", "r2", "length").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1"))
    return _meet(units, first, ["r1", "r2", "length"]).filter(~F.col("first").eqNullSafe(place)).select(*DOC, F.col("pos").alias("start"), "length")


def repeated_runs(docs: DataFrame, min_words: int, id_col: str, text_col: str) -> DataFrame:
    """(known, id, h, start, length): line runs to delete, which may overlap; h hashes the text."""
    key = F.col(f"`{id_col}`").cast("long")
    base = docs.select(key.isNotNull().alias("known"), F.coalesce(key, F.lit(0)).alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("h"), F.col(f"`{text_col}`").cast("string").alias("text")).filter("text is not null")
    lines = store(base.mapInArrow(B.lean(_scan(min_words)), "known boolean, id long, h long, pos int, l1 long, l2 long, fwd int, bwd int"))
    names = _ranked(lines, "l1", "l2")
    level = store(_meet(lines, names, ["l1", "l2"]).select(*KEY, "r", "fwd", "bwd"))
    drop(names)
    drop(lines)
    units = level.filter("fwd > 0").select(*KEY, F.col("fwd").alias("length"))
    units = store(units.union(level.filter("bwd > 1").select(*DOC, F.col("pos") - F.col("bwd") + 1, "bwd")).distinct())
    level, old = level.select(*KEY, "r").distinct(), level
    found, width = [], 1
    while True:
        now = units.filter(F.col("length") < 2 * width)
        tail = level.select(*DOC, F.col("pos").alias("end"), F.col("r").alias("r2"))
        ends = now.join(level.withColumnRenamed("r", "r1"), KEY).withColumn("end", F.col("pos") + F.col("length") - width)
        kinds = store(ends.join(tail, [*DOC, "end"]).select(*KEY, "r1", "r2", "length"))
        found.append(store(_later_copies(kinds)))
        drop(kinds)
        longer = units.filter(F.col("length") >= 2 * width)
        follow = level.select(*DOC, (F.col("pos") - width).cast("int").alias("pos"), F.col("r").alias("r2"))
        if longer.isEmpty():
            break
        # only suffixes that some longer unit needs go on
        pairs = store(level.withColumnRenamed("r", "r1").join(follow, KEY))
        names = _ranked(pairs, "r1", "r2")
        after = store(_meet(pairs, names, ["r1", "r2"]).select(*KEY, "r"))
        drop(pairs)
        drop(names)
        alive = store(longer.join(after.select(*KEY), KEY, "left_semi"))
        drop(units)
        drop(old)
        units, level, old, width = alive, after, after, 2 * width
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return out


def _cut(text_at: int, names: list[str], rows: int = 500):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):  # few texts at a time are Python strings
                yield cut(batch.slice(lo, rows))

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        runs, copy, long = (batch.column(batch.schema.get_field_index(c)) for c in ("__runs", "__copy", "__long"))
        texts, removed, total = [], [], []
        for value, mine, nth, whole in zip(batch.column(text_at), runs.to_pylist(), copy.to_pylist(), long.to_pylist()):
            text = value.as_py()
            lines = [] if text is None else text.split("\n")
            keep = np.full(len(lines), not (nth > 1 and whole))
            for r in mine or []:
                keep[r["start"] : r["start"] + r["length"]] = False
            if not keep.all():
                text = "\n".join(x for x, stays in zip(lines, keep) if stays)
            texts.append(text)
            removed.append(len(lines) - int(keep.sum()))
            total.append(len(lines))
        own = dict(zip(batch.schema.names, batch.columns))
        own[batch.schema.names[text_at]] = pa.array(texts, pa.string())
        return pa.RecordBatch.from_arrays([*(own[c] for c in names), pa.array(total, pa.int32()), pa.array(removed, pa.int32())], [*names, "n_lines", "lines_removed"])

    return run


def _row_key(key: Column) -> list[Column]:
    """Two columns that are equal for equal keys, null ones included."""
    return [F.coalesce(key, F.lit(0)).alias("__id"), key.isNull().alias("__null")]


def dedup_lines(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with later copies of repeated line runs cut out of ``text_col``, and n_lines, lines_removed (int).

    Lines end at ``\\n`` and compare byte by byte; words are runs without ASCII
    white space.  Copies are ordered by id (null first), then text hash, then line.
    Rows with equal id and text are copies of each other in an arbitrary order.  A
    null text stays null with 0 lines; an empty one has 1 line.  A text of which all
    lines go is empty.  Columns already named n_lines or lines_removed are replaced,
    other columns stay.
    """
    with temporary() as keep:
        runs = keep(store(repeated_runs(docs, min_words, id_col, text_col)))
    runs = runs.groupBy(F.col("id").alias("__id"), (~F.col("known")).alias("__null"), F.col("h").alias("__h")).agg(F.collect_list(F.struct("start", "length")).alias("__runs"))
    kept = docs.drop("n_lines", "lines_removed")
    schema = kept.withColumn(text_col, F.col(f"`{text_col}`").cast("string")).withColumns({"n_lines": F.lit(0), "lines_removed": F.lit(0)}).schema
    rows = kept.withColumn(text_col, F.col(f"`{text_col}`").cast("string")).select("*", *_row_key(F.col(f"`{id_col}`").cast("long")), F.xxhash64(F.col(f"`{text_col}`")).alias("__h"))
    rows = rows.join(runs, ["__id", "__null", "__h"], "left").select(*kept.columns, "__id", "__null", "__h", "__runs")
    # one exchange of the texts serves the join and the numbering of copies
    rows = rows.withColumn("__copy", F.row_number().over(Window.partitionBy("__id", "__null", "__h").orderBy(F.lit(0))))
    rows = rows.withColumn("__long", F.when(F.col("__copy") > 1, F.regexp_count(F.col(f"`{text_col}`"), F.lit(r"[^\x20\x09-\x0D]+")) >= min_words).otherwise(F.lit(False)))
    rows = rows.drop("__id", "__null", "__h")
    return rows.mapInArrow(B.lean(_cut(rows.columns.index(text_col), kept.columns)), schema)
