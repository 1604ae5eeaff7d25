"""Snapshots compared: specs, code files, functions and orphan states of two moments.

``before`` and ``after`` specs have (id, title, body_hash, body_hash_content, ord);
code has (file, symbols, file_hash, functions).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import unfolded
from ..scratch import store
from .graph import last_wins


def _by_id(specs: DataFrame) -> DataFrame:
    return last_wins(specs.select("id", "title", "body_hash", "body_hash_content", "ord"))


def spec_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, change, old_title, new_title, old_hash, new_hash) of ids that are removed, added, retitled or have another body."""
    b = _by_id(before).select("id", F.col("title").alias("old_title"), F.col("body_hash").alias("old_hash"), F.lit(True).alias("was"))
    a = _by_id(after).select("id", F.col("title").alias("new_title"), F.col("body_hash").alias("new_hash"), F.lit(True).alias("now"))
    change = (
        F.when(F.col("now").isNull(), "removed")
        .when(F.col("was").isNull(), "added")
        .when(~F.col("old_title").eqNullSafe(F.col("new_title")), "changed")
        .when(~F.col("old_hash").eqNullSafe(F.col("new_hash")), "body_changed")
    )
    return b.join(a, "id", "full_outer").withColumn("change", change).filter("change is not null").select("id", "change", "old_title", "new_title", "old_hash", "new_hash")


def removed(before: DataFrame, after: DataFrame) -> DataFrame:
    return _by_id(before).join(after.select("id"), "id", "left_anti")


def added(before: DataFrame, after: DataFrame) -> DataFrame:
    """Ids only in ``after``; a colliding id counts once for each row, as it was listed."""
    return after.join(before.select("id"), "id", "left_anti")


def renamed(before: DataFrame, after: DataFrame) -> DataFrame:
    """(old_id, new_id, body_hash_content): added specs whose content was removed elsewhere; the last removed with a content stands for it."""
    gone = removed(before, after).filter("body_hash_content <> ''")
    last = gone.groupBy("body_hash_content").agg(F.max_by("id", "ord").alias("old_id"))
    new = added(before, after).select(F.col("id").alias("new_id"), "body_hash_content")
    return new.join(last, "body_hash_content").select("old_id", "new_id", "body_hash_content")


def truly_added(before: DataFrame, after: DataFrame) -> DataFrame:
    return added(before, after).join(removed(before, after).filter("body_hash_content <> ''").select("body_hash_content"), "body_hash_content", "left_anti")


def code_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(file, change, added, removed, file_hash_changed): files removed, added, or with other symbols or another hash."""
    b = before.select("file", F.col("symbols").alias("old"), F.col("file_hash").alias("old_hash"), F.lit(True).alias("was"))
    a = after.select("file", F.col("symbols").alias("new"), F.col("file_hash").alias("new_hash"), F.lit(True).alias("now"))
    rows = b.join(a, "file", "full_outer")
    none = F.array().cast("array<string>")
    both = F.col("was") & F.col("now")
    plus, minus = F.array_sort(F.array_except("new", "old")), F.array_sort(F.array_except("old", "new"))
    rows = rows.withColumns({
        "added": F.when(both, plus).otherwise(none), "removed": F.when(both, minus).otherwise(none),
        "file_hash_changed": F.coalesce(both & ~F.col("old_hash").eqNullSafe(F.col("new_hash")), F.lit(False)),
    })
    change = F.when(F.col("now").isNull(), "removed").when(F.col("was").isNull(), "added").when((F.size("added") + F.size("removed") > 0) | F.col("file_hash_changed"), "symbols_changed")
    return rows.withColumn("change", change).filter("change is not null").select("file", "change", "added", "removed", "file_hash_changed")


def function_changes(before: DataFrame, after: DataFrame, by_line: bool = True) -> DataFrame:
    """(file, name, kind, line, old_hash, new_hash) of functions of one name (and line) whose bodies differ.

    Without ``by_line`` each later function is compared with the last earlier one of its
    name in its file, so a function that moved is found, and one of two of a name counts.
    """
    key = ["file", "name", "line"] if by_line else ["file", "name"]

    def flat(codes: DataFrame) -> DataFrame:
        return unfolded(codes.select("file", "functions"), F.col("functions"), "f", "at").select("file", "at", "f.name", "f.kind", "f.line", "f.body_hash")

    old = flat(before).groupBy(*key).agg(F.max_by("body_hash", "at").alias("old_hash"))
    rows = flat(after).join(old, key).filter("old_hash <> body_hash")
    return rows.select("file", "name", "kind", "line", "old_hash", F.col("body_hash").alias("new_hash"))


def orphan_transitions(before_ids: DataFrame, after_ids: DataFrame, before_orphans: DataFrame, after_orphans: DataFrame) -> DataFrame:
    """(id, change): ids in both snapshots that became orphans (new_orphan) or stopped being (resolved)."""
    common = before_ids.select("id").distinct().join(after_ids.select("id").distinct(), "id", "left_semi")
    return orphan_difference(before_orphans, after_orphans).join(common, "id", "left_semi")


def orphan_difference(before_orphans: DataFrame, after_orphans: DataFrame) -> DataFrame:
    """(id, change): orphans of only the later (new_orphan) or the earlier list (resolved), whether the ids are in both snapshots or not."""
    flag = lambda d, name: d.select("id").distinct().withColumn(name, F.lit(True))
    rows = flag(before_orphans, "was").join(flag(after_orphans, "now"), "id", "full_outer").filter("was is null or now is null")
    return rows.select("id", F.when(F.col("was").isNull(), "new_orphan").otherwise("resolved").alias("change"))


def snapshot_counts(before: tuple[DataFrame, DataFrame, DataFrame], after: tuple[DataFrame, DataFrame, DataFrame]) -> DataFrame:
    """(category, n) of two snapshots (specs, codes, orphans), a row for each of the eleven counters.

    Specs count once an id; of a file in both snapshots each function counts whose body
    isn't that of the last earlier function of its name.  Specs and orphans, which
    several counters read, are stored without their bodies.
    """
    (bs, bc, bo), (as_, ac, ao) = before, after
    bs, as_ = store(bs.select("id", "title", "body_hash", "body_hash_content", "ord")), store(_by_id(as_))
    bo, ao = store(bo.select("id")), store(ao.select("id"))
    changes = spec_changes(bs, as_).select("change")
    rows = [
        truly_added(bs, as_).select(F.lit("specs_added").alias("category")),
        changes.filter("change = 'removed'").select(F.lit("specs_removed")),
        changes.filter("change = 'changed'").select(F.lit("specs_changed")),
        renamed(bs, as_).select(F.lit("specs_renamed")),
        ac.join(bc.select("file"), "file", "left_anti").select(F.lit("code_added")),
        bc.join(ac.select("file"), "file", "left_anti").select(F.lit("code_removed")),
        function_changes(bc, ac, by_line=False).select(F.lit("funcs_changed")),
        bo.select(F.lit("orphans_before")),
        ao.select(F.lit("orphans_after")),
        orphan_difference(bo, ao).select(F.when(F.col("change") == "new_orphan", "new_orphans").otherwise("resolved_orphans")),
    ]
    names = "specs_added specs_removed specs_changed specs_renamed code_added code_removed funcs_changed orphans_before orphans_after new_orphans resolved_orphans".split()
    out = bs.sparkSession.createDataFrame([(n, 0) for n in names], "category string, n long")
    for r in rows:
        out = out.union(r.withColumn("n", F.lit(1).cast("long")))
    return out.groupBy("category").agg(F.sum("n").alias("n"))


def change_counts(*changes: DataFrame) -> DataFrame:
    """(category, n) over frames with a column ``change``."""
    rows = changes[0].select("change")
    for c in changes[1:]:
        rows = rows.union(c.select("change"))
    return rows.groupBy(F.col("change").alias("category")).agg(F.count("*").alias("n"))
