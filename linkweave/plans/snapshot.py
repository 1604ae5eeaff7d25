"""Snapshots of a project and its drift since."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config, load
from ..guard import OWN_DIR, allowed
from ..operators import coverage, drift
from ..operators.graph import TraceGraph, last_wins
from ..schema import SNAPSHOT
from ..scratch import store
from ..sources.project import code_candidates, spec_candidates
from .adapters import heuristic_graph

SPEC_FIELDS = "id file title heading_text depth line body_hash body_hash_content body_line_count body_preview".split()


@dataclass(frozen=True)
class State:
    """What a snapshot holds: specs, code, orphan spec ids and the coverage row."""

    specs: DataFrame
    codes: DataFrame
    orphans: DataFrame
    coverage: dict


def current(spark: SparkSession, root: str, cfg: Config | None = None) -> State:
    cfg = cfg or load(root)
    skipped = frozenset(cfg.exclude_dirs)
    specs = store(spec_candidates(spark, root, cfg.spec_dirs, cfg.spec_files, skipped))
    codes = store(code_candidates(spark, root, cfg.source_dirs, cfg.source_files, skipped))
    graph = heuristic_graph(specs, codes, least=cfg.min_confidence)
    rows = specs.select(F.col("auto_id").alias("id"), "file", "title", "heading_text", F.col("heading_depth").alias("depth"), "line", "body_hash", "body_hash_content", "body_line_count", "body_preview", "ord")
    code = codes.select("file", "module", "symbols", "is_test", "language", F.slice("imports", 1, 3).alias("imports"), "file_hash", F.transform("functions", lambda f: f.dropFields("body_preview")).alias("functions"), "ord")
    return State(rows, code, coverage.orphan_specs(graph).select("id"), {**_coverage(graph), "spec_count": specs.count(), "code_count": codes.count()})


def _coverage(graph: TraceGraph) -> dict:
    row = coverage.summary(graph).first()
    return row.asDict() if row else {**dict.fromkeys(("total", "covered", "orphan"), 0), "coverage_pct": 0.0}


def save(state: State, root: str, path: str | None = None, reason: str = "") -> str:
    """Write a snapshot as JSON in the project's output directory, by a rename, so readers never see half of one.

    The snapshot is a single document by format; Parquet tables are the place for
    what doesn't fit one (``save_tables``).
    """
    path = path or os.path.join(root, OWN_DIR, "snapshot.json")
    target = allowed(path, root)
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_name(f"{target.name}.{os.getpid()}-{uuid.uuid4().hex}.part")
    with open(part, "w", encoding="utf-8") as f:
        f.writelines(_document(state, reason))
    part.replace(target)
    return str(target)


def _document(state: State, reason: str) -> Iterator[str]:
    """The snapshot's text; rows come from the executors as they are written."""

    def rows(df: DataFrame, by: str) -> Iterator[str]:
        text = df.orderBy(by).select(F.to_json(F.struct(*[c for c in df.columns if c != "ord"]), {"ignoreNullFields": "false"}))
        for n, r in enumerate(text.toLocalIterator()):
            yield f",\n  {r[0]}" if n else f"\n  {r[0]}"

    say = lambda x: json.dumps(x, ensure_ascii=False)
    yield f'{{"reason": {say(reason)}, "timestamp": {say(f"{datetime.now():%Y-%m-%dT%H:%M:%S}")}, "coverage": {say(state.coverage)},\n "specs": ['
    yield from rows(state.specs, "ord")
    yield '],\n "code": ['
    yield from rows(state.codes, "ord")
    yield '],\n "orphan_spec_ids": ['
    for n, r in enumerate(state.orphans.select("id").orderBy("id").toLocalIterator()):
        yield (", " if n else "") + say(r["id"])
    yield "]}\n"


def save_tables(state: State, folder: str, snapshot_id: str) -> None:
    """Write a snapshot as Parquet, partitioned by its id."""
    for name, df in (("specs", state.specs), ("code", state.codes), ("orphans", state.orphans)):
        df.write.mode("overwrite").parquet(f"{folder}/{name}/snapshot_id={snapshot_id}")


def read(spark: SparkSession, path: str) -> State | None:
    """The snapshot at a path, None if it is missing or broken; the document is one JSON value, so one task reads it, and stores it as a table."""
    if not os.path.isfile(path):
        return None
    doc = store(spark.read.schema(f"{SNAPSHOT}, broken string").json(path, multiLine=True, columnNameOfCorruptRecord="broken"))
    row = doc.select("broken").first()
    if row is None or row[0] is not None:
        return None
    lists = lambda c: doc.select(F.posexplode(c).alias("ord", "x")).select("x.*", F.col("ord").cast("long").alias("ord"))
    row = doc.select("coverage.*").first()
    return State(lists("specs"), lists("code"), doc.select(F.explode("orphan_spec_ids").alias("id")), row.asDict() if row else {})


def _places(specs: DataFrame, side: str) -> DataFrame:
    rows = last_wins(specs.select("id", "title", "file", "body_line_count", "ord"))
    return rows.select("id", F.col("title").alias(f"{side}_title"), F.col("file").alias(f"{side}_file"), F.col("body_line_count").alias(f"{side}_lines"))


@dataclass(frozen=True)
class Report:
    """Drift between two states; each part is a DataFrame of ``operators.drift``."""

    specs: DataFrame
    renamed: DataFrame
    truly_added: DataFrame
    code: DataFrame
    functions: DataFrame
    orphans: DataFrame
    before: State
    after: State

    def counts(self) -> dict[str, int]:
        """Number of entries by category; functions count as the files they are in."""
        kinds = self.specs.filter("change <> 'added'").select(F.concat(F.lit("specs_"), "change").alias("change"))
        kinds = kinds.union(self.truly_added.select(F.lit("specs_added"))).union(self.renamed.select(F.lit("specs_renamed")))
        kinds = kinds.union(self.code.select(F.concat(F.lit("code_"), "change"))).union(self.functions.select("file").distinct().select(F.lit("code_funcs_changed")))
        kinds = kinds.union(self.orphans.select(F.concat(F.lit("orphans_"), "change")))
        return {r["category"]: r["n"] for r in drift.change_counts(kinds).collect()}  # a dozen categories

    @property
    def has_drift(self) -> bool:
        return any(not x.isEmpty() for x in (self.specs, self.renamed, self.code, self.functions, self.orphans))

    def details(self) -> DataFrame:
        """(category, key, line): a line of text for every change, in no order; ``key`` sorts a category's lines."""
        b, a = _places(self.before.specs, "b"), _places(self.after.specs, "a")
        said = lambda *x: F.concat(*[F.coalesce((F.lit(y[1:]) if y.startswith("=") else F.col(y)).cast("string"), F.lit("")) for y in x])
        specs = self.specs.join(b, "id", "left").join(a, "id", "left")
        body_too = F.when(~F.col("old_hash").eqNullSafe(F.col("new_hash")), " (body too)").otherwise("")
        names = self.renamed.join(b.withColumnRenamed("id", "old_id"), "old_id", "left").join(a.withColumnRenamed("id", "new_id"), "new_id", "left")
        files = self.after.codes.select("file", "language", F.array_join("symbols", ", ").alias("names"))
        code = self.code.join(files, "file", "left").withColumns({"plus": F.array_join("added", ", "), "minus": F.array_join("removed", ", ")})
        content = F.when(F.col("file_hash_changed"), "  (content)").otherwise("")
        rows = [
            names.select(F.lit("specs_renamed").alias("category"), F.col("new_id").alias("key"), said("b_title", "= -> ", "a_title", "=  (", "a_file", "=)").alias("line")),
            self.truly_added.select(F.lit("specs_added"), "id", said("id", "=: ", "title", "=  (", "file", "=)")),
            specs.filter("change = 'removed'").select(F.lit("specs_removed"), "id", said("id", "=: ", "b_title", "=  (", "b_file", "=)")),
            specs.filter("change = 'changed'").select(F.lit("specs_changed"), "id", F.concat(said("id", "=: ", "old_title", "= -> ", "new_title"), body_too)),
            specs.filter("change = 'body_changed'").select(F.lit("specs_body_changed"), "id", said("id", "=: ", "a_title", "=  lines ", "b_lines", "= -> ", "a_lines", "=  hash ", "old_hash", "= -> ", "new_hash")),
            code.filter("change = 'added'").select(F.lit("code_added"), "file", said("file", "=  (", "language", "=)  ", "names")),
            code.filter("change = 'removed'").select(F.lit("code_removed"), "file", "file"),
            code.filter("change = 'symbols_changed'").select(F.lit("code_symbols_changed"), "file", F.concat(said("file", "=  + ", "plus", "=  - ", "minus"), content)),
            self.functions.select(F.lit("code_funcs_changed"), said("file", "= ", "line"), said("file", "=::", "name", "=  (", "kind", "= ", "line", "=)  hash ", "old_hash", "= -> ", "new_hash")),
            self.orphans.select(F.concat(F.lit("orphans_"), "change"), "id", "id"),
        ]
        out = rows[0]
        for r in rows[1:]:
            out = out.union(r)
        return out

    def lines(self) -> Iterator[str]:
        """The report as text, category by category; rows come from the executors as they are read."""
        counts, last = self.counts(), None
        if not counts:
            yield "No drift."
            return
        for r in self.details().orderBy("category", "key", "line").toLocalIterator():
            if r["category"] != last:
                last = r["category"]
                yield f"{last} ({counts.get(last, 0)}):"
            yield f"  {r['line']}"
        b, a = self.before.coverage, self.after.coverage
        was, now = b.get("coverage_pct", 0.0) or 0.0, a.get("coverage_pct", 0.0) or 0.0
        yield f"coverage: {was} % -> {now} % ({coverage.delta(was, now):+.1f}), specs {b.get('spec_count')} -> {a.get('spec_count')}, code {b.get('code_count')} -> {a.get('code_count')}"

    def text(self) -> str:
        return "\n".join(self.lines())


def compare(before: State, after: State) -> Report:
    b, a = before.specs, after.specs
    return Report(
        drift.spec_changes(b, a), drift.renamed(b, a), drift.truly_added(b, a), drift.code_changes(before.codes, after.codes), drift.function_changes(before.codes, after.codes),
        drift.orphan_transitions(b.select("id"), a.select("id"), before.orphans, after.orphans), before, after,
    )


def difference(before: State, after: State, few: int = 5) -> dict:
    """Two snapshots compared: coverage of both, eleven counters, and the first ``few`` entries of each list (twice as many retitled specs), in snapshot order."""
    bs, as_ = last_wins(before.specs), last_wins(after.specs)
    first = lambda df, n=few: [r.asDict(True) for r in df.limit(n).collect()]
    fields = [c for c in SPEC_FIELDS if c in bs.columns and c in as_.columns]
    retitled = drift.spec_changes(bs, as_).filter("change = 'changed'").select("id", "old_title", "new_title").join(as_.select("id", "ord"), "id")
    names = drift.renamed(bs, as_).join(bs.select(F.col("id").alias("old_id"), F.col("title").alias("old_title")), "old_id").join(as_.select(F.col("id").alias("new_id"), F.col("title").alias("new_title"), "ord"), "new_id")
    added = as_.join(drift.truly_added(bs, as_).select("id"), "id", "left_semi")
    gone = bs.join(as_.select("id"), "id", "left_anti")
    codes = lambda x, y: x.join(y.select("file"), "file", "left_anti").orderBy("ord")
    counts = drift.snapshot_counts((before.specs, before.codes, before.orphans), (after.specs, after.codes, after.orphans))
    return {
        "coverage_before": before.coverage, "coverage_after": after.coverage, **{r["category"]: r["n"] for r in counts.orderBy("category").collect()},
        "added_specs_detail": first(added.orderBy("ord").select(*fields)), "removed_specs_detail": first(gone.orderBy("ord").select(*fields)),
        "changed_specs_detail": first(retitled.orderBy("ord").select("id", "old_title", "new_title"), 2 * few),
        "renamed_specs_detail": first(names.orderBy("ord").select("old_id", "new_id", "old_title", "new_title")),
        "added_code_detail": first(codes(after.codes, before.codes).select("file", F.coalesce("language", F.lit("?")).alias("language"))),
        "removed_code_detail": first(codes(before.codes, after.codes).select("file")),
    }
