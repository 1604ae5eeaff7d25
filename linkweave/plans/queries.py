"""The engine's operators as queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import boundary, cache, coverage, drift, infer, parse, structure
from ..operators import graph as G
from ..scratch import store
from ..streaming import watch
from .views import view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def _query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _graph(spark: SparkSession, d: str) -> G.TraceGraph:
    return G.TraceGraph(view(spark, d, "nodes"), view(spark, d, "edges"))


def _sure(g: G.TraceGraph, strength: str = "explicit") -> G.TraceGraph:
    """The graph with only edges of one strength left to cover anything."""
    return G.TraceGraph(g.nodes, g.edges.withColumn("relation", F.when(F.col("strength") == strength, F.col("relation")).otherwise("references")))


def _long(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


# ── graph and coverage ──


@_query
def coverage_summary(spark, d):
    return coverage.summary(_graph(spark, d))


@_query
def coverage_gate(spark, d):
    return coverage.gate(_graph(spark, d), 60.0)


@_query
def coverage_by_segment(spark, d):
    return coverage.summary(_graph(spark, d), "segment")


@_query
def orphan_specs(spark, d):
    return coverage.orphan_specs(_graph(spark, d)).select("id", "title", "file")


@_query
def orphan_code(spark, d):
    return coverage.orphan_code(_graph(spark, d)).select("id", "type", "file")


@_query
def refs_per_spec(spark, d):
    return coverage.spec_refs(_graph(spark, d)).select("id", "refs", "verified")


@_query
def spec_status_tristate(spark, d):
    return coverage.spec_refs(_graph(spark, d)).select("id", "status")


@_query
def node_type_counts(spark, d):
    return coverage.type_counts(_graph(spark, d))


@_query
def origin_histogram(spark, d):
    return coverage.origin_histogram(_graph(spark, d))


@_query
def coverage_delta(spark, d):
    """Coverage of two halves of the edges, and its change."""
    g = _graph(spark, d)
    one = coverage.summary(_sure(g)).select(F.col("coverage_pct").alias("before"), F.lit(None).cast("double").alias("after"))
    two = coverage.summary(g).select(F.lit(None).cast("double"), "coverage_pct")
    return one.union(two).agg(F.max("before").alias("before"), F.max("after").alias("after")).withColumn("delta", F.round(F.col("after") - F.col("before"), 1))


@_query
def edge_dedup_first(spark, d):
    return G.first_edges(view(spark, d, "edges_raw"))


@_query
def node_last_wins(spark, d):
    return G.last_wins(view(spark, d, "nodes_twice"))


@_query
def merge_union(spark, d):
    g, more = _graph(spark, d), view(spark, d, "nodes_again")
    a = G.TraceGraph(g.nodes.select("id", "title", "confidence", "ord"), g.edges)
    merged = G.merge(a, G.TraceGraph(more, g.edges.filter("relation = 'verifies'")))
    n = merged.nodes.groupBy("id", "title", "confidence").agg(F.count("*").alias("n_nodes")).withColumn("n_edges", F.lit(None).cast("long"))
    return n.unionByName(merged.edges.groupBy(F.col("src_id").alias("id")).agg(F.count("*").alias("n_edges")).withColumns({"title": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double"), "n_nodes": F.lit(None).cast("long")}))


@_query
def id_normalize(spark, d):
    return G.spec_aliases(view(spark, d, "spec_ids"))


@_query
def normalized_nodes(spark, d):
    g = G.normalise(G.TraceGraph(view(spark, d, "spec_ids"), view(spark, d, "spec_edges")))
    return g.nodes.select("id", "title", "confidence", F.size("aliases").cast("long").alias("n_aliases"))


@_query
def edge_redirect(spark, d):
    return G.redirect(view(spark, d, "spec_edges"), G.spec_aliases(view(spark, d, "spec_ids"))).select("src_id", "dst_id", "relation")


@_query
def edges_to_spec(spark, d):
    return G.edges_to(view(spark, d, "edges"), "spec:17").unionByName(G.edges_from(view(spark, d, "edges"), "part:9")).select("src_id", "dst_id", "relation", "strength")


@_query
def find_spec_tiered(spark, d):
    nodes, out = _graph(spark, d).nodes, None
    for q in ("spec:12", "part:5", "00000042", "building 3", "nothing at all"):
        rows = G.find_specs(nodes, q).select(F.lit(q).alias("query"), "id", F.col("tier").cast("long").alias("tier"))
        out = rows if out is None else out.union(rows)
    return out


@_query
def forward_impact(spark, d):
    return G.forward_impact(_graph(spark, d), "00001")


@_query
def reverse_impact(spark, d):
    return G.reverse_impact(_graph(spark, d), "ring_").withColumn("files", F.array_join("files", ","))


@_query
def git_drift(spark, d):
    g = _graph(spark, d)
    changed = g.nodes.filter("contains(file, 'promo')").select("file")
    return G.git_drift(g, changed)


@_query
def drawing_rows(spark, d):
    return G.display_rows(view(spark, d, "nodes").withColumn("title", F.concat("title", F.lit(" in "), "file", F.lit(" and more of it"))))


@_query
def boundary_violations(spark, d):
    g = _graph(spark, d)
    paths = F.array(F.lit("src/promo/*"), F.lit("src/[sm]*"))
    rules = g.nodes.filter("segment in ('BUILDING', 'MACHINERY')").select(F.col("id").alias("spec_id"), F.explode(F.when(F.col("segment") == "BUILDING", paths).otherwise(F.array(F.lit("src/large/")))).alias("path"))
    return boundary.violations(g, rules)


@_query
def boundary_last_spec(spark, d):
    return boundary.attach(_outline_tags(spark, d))


@_query
def boundary_preceding_spec(spark, d):
    return boundary.attach(_outline_tags(spark, d), "preceding")


def _outline_tags(spark, d):
    rows = spark.read.parquet(f"{d}/conversations.parquet")
    return rows.select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("file"), F.when(F.col("role") == "user", "spec").otherwise("boundary").alias("kind"), F.col("text").alias("value"), F.col("turn").cast("int").alias("line"), F.col("turn").cast("int").alias("ord"))


# ── similarity join ──


def _similar(spark, d):
    """Specs and codes with their tokens, stored: each side is read several times, and tokenised once."""
    s = view(spark, d, "specs").withColumn("tokens", X.tokens(F.col("text"))).drop("text")
    c = view(spark, d, "codes").withColumns({"tokens": X.tokens(F.concat_ws(" ", "file", "text")), "stem_tokens": X.tokens(F.col("stem"))}).drop("text")
    return store(s), store(c)


@_query
def tokenizer(spark, d):
    t = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", X.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.sha2(F.array_join(F.array_sort("t"), " "), 256).alias("tokens_sha256"))


@_query
def token_index_candidates(spark, d):
    return infer.token_pairs(*_similar(spark, d)).select("spec_id", "code_id", "n_symbol", "n_stem")


@_query
def evidence_tokens(spark, d):
    return infer.token_pairs(*_similar(spark, d)).select("spec_id", "code_id", F.array_join("symbol_tokens", ", ").alias("symbol_tokens"))


@_query
def same_dir_candidates(spark, d):
    return infer.dir_pairs(*_similar(spark, d), False)


@_query
def partial_dir_candidates(spark, d):
    return infer.dir_pairs(*_similar(spark, d), True)


@_query
def edge_score(spark, d):
    s, c = _similar(spark, d)
    return infer.score(infer.candidates(s, c), s, c).select("spec_id", "code_id", "s_dir", "s_file", "confidence")


@_query
def edge_strength(spark, d):
    s, c = _similar(spark, d)
    rows = infer.relate(infer.score(infer.candidates(s, c), s, c).join(c.select("code_id", "is_test"), "code_id"))
    return rows.groupBy("relation", "strength").agg(F.count("*").alias("n"), F.min("confidence").alias("low"), F.max("confidence").alias("high"))


@_query
def func_score(spark, d):
    s, c = _similar(spark, d)
    f = c.select(F.col("code_id").alias("func_id"), "tokens")  # documents stand for functions
    return infer.function_scores(s, f).filter(F.col("confidence") >= infer.LEAST_CONFIDENCE)


@_query
def suggest_topk(spark, d):
    return infer.suggest(*_similar(spark, d), 3).select("spec_id", "code_id", "score", F.col("rank").cast("long").alias("rank"))


# ── drift ──


def _moments(spark, d):
    return view(spark, d, "before"), view(spark, d, "after")


@_query
def spec_drift_full(spark, d):
    return drift.spec_changes(*_moments(spark, d))


@_query
def drift_removed(spark, d):
    return drift.removed(*_moments(spark, d)).select("id", "title")


@_query
def drift_added(spark, d):
    return drift.truly_added(*_moments(spark, d)).select("id", "title")


@_query
def drift_renamed(spark, d):
    return drift.renamed(*_moments(spark, d))


@_query
def drift_body_changed(spark, d):
    return drift.spec_changes(*_moments(spark, d)).filter("change = 'body_changed'").select("id", "old_hash", "new_hash")


def _versions(spark, d):
    """Virtual sources and a later version: some files moved, some edited."""
    old = view(spark, d, "sources")
    text = F.when(F.col("ord") % 11 == 0, F.concat("text", F.lit("\ndef added(q): return q"))).when(F.col("ord") % 13 == 0, F.replace("text", F.lit("len(x)"), F.lit("sum(x)"))).otherwise(F.col("text"))
    moved = F.when(F.col("ord") % 17 == 0, F.concat(F.lit("src/moved/"), F.col("ord").cast("string"), F.lit(".py"))).otherwise(F.col("path"))
    return parse.code_rows(old), parse.code_rows(old.select("ord", moved.alias("path"), text.alias("text")))


@_query
def code_symbol_diff(spark, d):
    return drift.code_changes(*_versions(spark, d)).withColumns({"added": F.array_join("added", ","), "removed": F.array_join("removed", ",")})


@_query
def func_drift_by_line(spark, d):
    return _long(drift.function_changes(*_versions(spark, d)), "line")


@_query
def snapshot_diff_full(spark, d):
    """The eleven counters of two snapshots: specs, code and orphan lists of two moments."""
    a, b = _sure(_graph(spark, d)), _sure(_graph(spark, d), "inferred")
    (bs, as_), (bc, ac) = _moments(spark, d), _versions(spark, d)
    return drift.snapshot_counts((bs, bc, coverage.orphan_specs(a)), (as_, ac, coverage.orphan_specs(b)))


@_query
def orphan_difference(spark, d):
    """Orphans of two lists, one of them of fewer specs."""
    a, b = _sure(_graph(spark, d)), _sure(_graph(spark, d), "inferred")
    renamed = coverage.orphan_specs(b).withColumn("id", F.when(F.col("title").endswith("7"), F.concat("id", F.lit(" new"))).otherwise(F.col("id")))
    return drift.orphan_difference(coverage.orphan_specs(a), renamed)


@_query
def func_drift_by_name(spark, d):
    return _long(drift.function_changes(*_versions(spark, d), by_line=False).select("file", "name", "line", "old_hash", "new_hash"), "line")


@_query
def snapshot_diff_counts(spark, d):
    return drift.change_counts(drift.spec_changes(*_moments(spark, d)), drift.code_changes(*_versions(spark, d)))


@_query
def orphan_transitions(spark, d):
    a, b = _sure(_graph(spark, d)), _sure(_graph(spark, d), "inferred")
    spec = lambda g: g.nodes.filter("type = 'spec'")
    return drift.orphan_transitions(spec(a), spec(b), coverage.orphan_specs(a), coverage.orphan_specs(b))


# ── parsing ──


@_query
def section_split(spark, d):
    return _long(parse.sections(view(spark, d, "markdown")), "line", "depth")


@_query
def spec_candidates(spark, d):
    rows = parse.spec_rows(view(spark, d, "markdown"))
    return _long(rows.select("file", "line", "auto_id", "title", "heading_depth", F.array_join("parent_chain", " > ").alias("chain"), "body_hash", "body_hash_content", "body_line_count", "body_preview"), "line", "heading_depth", "body_line_count")


@_query
def hierarchical_id(spark, d):
    return parse.numbered(view(spark, d, "outline")).select("path", "line", "number")


@_query
def parent_chain(spark, d):
    return parse.numbered(view(spark, d, "outline")).select("path", "line", F.array_join("parent_chain", " > ").alias("chain"))


@_query
def title_clean(spark, d):
    return parse.sections(view(spark, d, "markdown")).select("path", F.col("line").cast("long").alias("line"), X.clean_title(F.col("heading")).alias("title"))


@_query
def text_preview(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", X.preview(F.col("text")).alias("preview"), X.hash16(F.col("text")).alias("hash"), X.hash16(X.without_first_line(F.col("text"))).alias("content_hash"), X.line_breaks(F.col("text")).cast("long").alias("breaks"))


@_query
def symbols(spark, d):
    return view(spark, d, "sources").select("path", F.array_join(parse.symbols(F.col("text")), ",").alias("symbols"))


@_query
def func_blocks(spark, d):
    rows = parse.function_blocks(view(spark, d, "sources"))
    return _long(rows.select("path", "name", "kind", "line", X.hash16(F.col("body")).alias("hash"), X.preview(F.col("body")).alias("preview")), "line")


@_query
def imports_list(spark, d):
    return view(spark, d, "sources").select("path", F.array_join(parse.imports(F.col("path"), F.col("text")), ",").alias("imports"))


@_query
def path_facts(spark, d):
    """Test detection, language, module, stem and top directory by path."""
    p = F.col("file")
    return view(spark, d, "nodes").select("id", X.is_test(p).alias("is_test"), X.language(p).alias("language"), X.module_name(p).alias("module"), X.package_stem(p).alias("stem"), X.top_dir(p).alias("top"))


@_query
def call_sites(spark, d):
    return view(spark, d, "sources").select("path", F.array_join(F.array_sort(parse.calls(F.col("text"))), ",").alias("calls"))


@_query
def html_tag_extract(spark, d):
    return _long(parse.html_tags(view(spark, d, "pages_text")), "n")


@_query
def python_comment_tags(spark, d):
    from ..sources import tags

    files = view(spark, d, "sources").select("path", F.lit(".py").alias("ext"), "text")
    return _long(tags.extract_tags(files).select("file", "kind", "value", "line"), "line")


@_query
def ast_blocks(spark, d):
    from ..sources import python_ast

    rows = python_ast.ast_blocks(view(spark, d, "sources"))
    return _long(rows.select("path", "name", "kind", "line"), "line")


@_query
def tag_split(spark, d):
    tags = parse.html_tags(view(spark, d, "markdown")).filter("kind = 'satisfies'")
    return X.unfolded(tags, X.split_values(F.col("value")), "spec").select("path", "spec")


@_query
def yaml_hierarchy(spark, d):
    rows = parse.hierarchy(view(spark, d, "yaml_items").drop("file").withColumn("file", F.lit("specs.yaml")))
    return rows.select("id", F.col("depth").cast("long").alias("depth"), F.array_join("parent_chain", " > ").alias("chain"))


# ── imports and calls ──


def _sources(spark, d):
    rows = view(spark, d, "sources")
    return rows.select(F.col("path").alias("file"), parse.imports(F.col("path"), F.col("text")).alias("imports"), "ord")


@_query
def import_resolution(spark, d):
    return structure.resolve_imports(_sources(spark, d))


@_query
def import_edges(spark, d):
    f = _sources(spark, d)
    old = structure.resolve_imports(f).filter("contains(file, 'promo')").select(F.col("file").alias("src_id"), F.col("target").alias("dst_id"), F.lit("depends").alias("relation"))
    return structure.import_edges(f, old)


def _called(spark, d):
    """Called names and functions of the sources, stored: they are read several times, and parsed once."""
    rows = view(spark, d, "sources")
    called = X.unfolded(rows, parse.calls(F.col("text")), "name").select(F.col("path").alias("file"), "name")
    functions = parse.function_blocks(rows, "ord").select(F.col("path").alias("file"), "name", (F.col("ord") * 100 + F.col("line")).alias("ord"))
    return store(called), store(functions)


@_query
def callee_resolution(spark, d):
    return structure.resolve_callees(*_called(spark, d))


@_query
def call_edges(spark, d):
    return structure.call_edges(*_called(spark, d))


@_query
def callees_callers(spark, d):
    return structure.degrees(view(spark, d, "calls"))


def _changed(spark, d, calls):
    """Callers among the functions of changed files: the parts of one kind."""
    changed = spark.read.parquet(f"{d}/part.parquet").filter("lower(p_type) = 'promo'").select(F.col("p_partkey").cast("string").alias("key"))
    return changed.join(calls.select(F.col("caller").alias("key")), "key", "left_semi")


@_query
def bfs_depth(spark, d):
    calls = view(spark, d, "calls")
    return _long(structure.reach(_changed(spark, d, calls), calls, 3), "depth")


@_query
def transitive_impact(spark, d):
    calls = view(spark, d, "calls")
    functions = calls.select(F.col("caller").alias("key")).union(calls.select("callee")).distinct().withColumn("file", F.concat(F.lit("f"), (F.col("key").cast("long") % 20).cast("string")))
    return _long(structure.transitive_impact(_changed(spark, d, calls), calls, functions, 3), "depth")


@_query
def traversed_calls(spark, d):
    """Calls that a search of depth 2 goes along or stops at."""
    calls = view(spark, d, "calls")
    return structure.traversed(structure.reach(_changed(spark, d, calls), calls, 2), calls)


@_query
def direct_neighbours(spark, d):
    return structure.neighbours(view(spark, d, "calls"), "17")


@_query
def impact_seeds(spark, d):
    """Functions that edges tie to one spec: the parts' files, each with three functions."""
    g = _graph(spark, d)
    names = F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("c")))
    functions = g.nodes.filter("type = 'code'").select("file", names.alias("name")).select("file", F.concat("file", F.lit("::"), "name").alias("key"))
    return structure.impact_seeds(g, functions, "spec:17")


@_query
def symbol_resolution(spark, d):
    calls = view(spark, d, "calls").groupBy(F.col("caller").alias("symbol")).agg(F.collect_set("callee").alias("callees"))
    rows = calls.select(F.col("symbol").cast("long").alias("ord"), "symbol", F.concat(F.lit("f"), F.col("symbol").cast("long") % 20).alias("file"), "callees")
    return structure.resolve_symbols(rows)


# ── cache, other sources, watch ──


@_query
def cache_filter(spark, d):
    return cache.filter_cached(view(spark, d, "files_now"), view(spark, d, "files_then")).select("path", "state")


@_query
def graph_json_rows(spark, d):
    from ..sources.graph_json import edge_rows

    links = view(spark, d, "edges").select("src_id", "dst_id", F.element_at(F.array(*[F.lit(x) for x in ("calls", "imports", "extends", "imports_from", "implements", "odd")]), (F.col("ord") % 6 + 1).cast("int")).alias("kind"), (F.col("ord") % 4 == 0).alias("sure"))
    return edge_rows(links.select(F.col("src_id").alias("source"), F.col("dst_id").alias("target"), F.col("kind").alias("relation"), F.when(F.col("sure"), "EXTRACTED").otherwise("GUESSED").alias("confidence")))


@_query
def watch_throttle(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", "ts")
    return watch.throttled(events, "user_id", "ts", 36_000.0, "event_id").select("event_id", "user_id")
