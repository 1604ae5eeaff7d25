"""Graph producers: how likely each fits a project, and the graph it makes."""

from __future__ import annotations

import importlib.metadata
import os
from abc import ABC, abstractmethod

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config, load
from ..functions import text as X
from ..operators import infer
from ..operators.graph import TraceGraph, first_edges, last_wins, merge, normalise
from ..schema import CODE, SPEC, TEST
from ..scratch import store
from ..sources import graph_json, mapping, tags
from ..sources.project import code_candidates, spec_candidates
from ..sources.projfiles import SOURCE_DIRS, SPEC_DIRS, source_endings, walk

PLUGINS = "linkweave.adapters"


class Adapter(ABC):
    """A user-defined source of a trace graph."""

    name = ""

    @abstractmethod
    def detect(self, root: str) -> float:
        """0 to 1: how well the adapter fits the project."""

    @abstractmethod
    def analyze(self, spark: SparkSession, root: str) -> TraceGraph: ...


_REGISTRY: dict[str, type[Adapter]] = {}
_LOADED = False


def register(cls: type[Adapter]) -> type[Adapter]:
    """Class decorator; registering a name again replaces it."""
    _REGISTRY[cls.name or cls.__name__] = cls
    return cls


def adapters() -> dict[str, type[Adapter]]:
    """Registered classes by name, after loading plugins once; a plugin that fails is left out."""
    global _LOADED
    if not _LOADED:
        _LOADED = True
        for point in importlib.metadata.entry_points(group=PLUGINS):
            try:
                found = point.load()
            except Exception:  # a plugin may fail in any way
                continue
            if isinstance(found, type) and issubclass(found, Adapter):
                register(found)
    return dict(_REGISTRY)


def detected(root: str) -> list[tuple[float, Adapter]]:
    """Adapters with a score above 0, best first."""
    scored = [(cls().detect(root), cls()) for cls in adapters().values()]
    return sorted([x for x in scored if x[0] > 0], key=lambda x: -x[0])


def best(root: str) -> Adapter | None:
    found = detected(root)
    return found[0][1] if found else None


def merged(spark: SparkSession, root: str) -> TraceGraph:
    """All detected adapters' graphs united, spec ids folded."""
    graphs = [a.analyze(spark, root) for _, a in detected(root)]
    return stored(normalise(stored(merge(*graphs)))) if graphs else empty(spark)


def empty(spark: SparkSession) -> TraceGraph:
    from ..schema import EDGES, NODES

    return TraceGraph(spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES))


def spec_nodes(specs: DataFrame) -> DataFrame:
    sure = F.when(F.coalesce("auto_id", F.lit("")) == "", 0.5).otherwise(0.8)
    title = F.coalesce(F.nullif("title", F.lit("")), F.col("heading_text"))
    return specs.select(F.col("auto_id").alias("id"), F.lit(SPEC).alias("type"), title.alias("title"), "file", "line", F.lit("heuristic").alias("framework_origin"), sure.alias("confidence"), "heading_text", F.array().cast("array<string>").alias("imports"), "ord")


def code_nodes(codes: DataFrame, after: int = 1 << 44) -> DataFrame:
    some = F.array_join(F.slice("symbols", 1, 3), ", ")
    title = F.when(F.size("symbols") > 0, F.concat("file", F.lit(" ("), some, F.lit(")"))).otherwise(F.col("file"))
    kind = F.when(F.col("is_test"), TEST).otherwise(CODE)
    return codes.select(F.col("file").alias("id"), kind.alias("type"), title.alias("title"), "file", F.lit(1).alias("line"), F.lit("heuristic").alias("framework_origin"), F.lit(0.9).alias("confidence"), F.lit("").alias("heading_text"), "imports", (F.col("ord") + after).alias("ord"))


def match_inputs(specs: DataFrame, codes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The join's sides: specs by their place in scan order, code by file."""
    said = F.concat_ws(" ", "title", "heading_text", F.array_join("parent_chain", " "), F.substring("body_text", 1, 300))
    s = specs.select(F.col("ord").alias("spec_id"), "auto_id", "file", X.stem(F.col("file")).alias("stem"), X.tokens(said).alias("tokens"))
    shown = F.concat_ws(" ", "file", F.array_join("symbols", " "), F.array_join(F.transform("functions", lambda f: f["body_preview"]), " "))
    c = codes.select(F.col("file").alias("code_id"), "file", X.package_stem(F.col("file")).alias("stem"), X.tokens(shown).alias("tokens"), X.tokens(X.package_stem(F.col("file"))).alias("stem_tokens"), "is_test", "ord")
    return s, c


def heuristic_graph(specs: DataFrame, codes: DataFrame, functions: bool = False, least: float = infer.LEAST_CONFIDENCE) -> TraceGraph:
    """Specs and code as nodes, confident matches as edges; with ``functions``, matched functions too."""
    s, c = (store(x) for x in match_inputs(specs, codes))
    scored = infer.score(infer.candidates(s, c), s, c)
    facts = scored.join(s.select("spec_id", "auto_id", F.col("file").alias("spec_file")), "spec_id").join(c.select("code_id", "is_test", F.col("file").alias("code_file")), "code_id")
    place = F.col("spec_id")
    edges = infer.relate(facts, least).select(F.col("code_id").alias("src_id"), F.col("auto_id").alias("dst_id"), "relation", "strength", infer.evidence().alias("evidence"), place.alias("ord"))
    nodes = spec_nodes(specs).unionByName(code_nodes(codes))
    if functions:
        f = codes.select("file", "is_test", F.explode("functions").alias("f"))
        f = f.select(F.concat("file", F.lit("::"), "f.name").alias("func_id"), "file", "is_test", F.col("f.name").alias("name"), F.col("f.line").alias("line"), X.tokens(F.concat_ws(" ", "f.name", "f.body_preview")).alias("tokens"))
        hits = infer.function_scores(s, f.select("func_id", "tokens")).filter(F.col("confidence") >= least).join(f.drop("tokens"), "func_id").join(s.select("spec_id", "auto_id"), "spec_id")
        why = F.array(F.struct(F.lit("heuristic:funcname").alias("kind"), F.col("name").alias("value"), F.col("file").alias("file"), F.col("line").alias("line")))
        edges = edges.unionByName(infer.relate(hits, least).select(F.col("func_id").alias("src_id"), F.col("auto_id").alias("dst_id"), "relation", "strength", why.alias("evidence"), (F.col("spec_id") + (1 << 45)).alias("ord")))
        first = hits.groupBy("func_id").agg(F.min_by(F.struct("name", "file", "line", "confidence"), F.struct("spec_id", "line")).alias("x"), F.min("spec_id").alias("ord"))
        nodes = nodes.unionByName(
            first.select(F.col("func_id").alias("id"), F.lit(CODE).alias("type"), F.concat("x.name", F.lit("()")).alias("title"), "x.file", "x.line", F.lit("heuristic").alias("framework_origin"), "x.confidence", F.lit("").alias("heading_text"), F.array().cast("array<string>").alias("imports"), (F.col("ord") + (1 << 46)).alias("ord"))
        )
    return stored(TraceGraph(last_wins(nodes), first_edges(edges)))


def stored(graph: TraceGraph) -> TraceGraph:
    """The graph as tables, so plans over it don't repeat the scan and the join."""
    return TraceGraph(store(graph.nodes), store(graph.edges))


def _has(root: str, dirs) -> bool:
    return any(os.path.isdir(os.path.join(root, d)) for d in dirs)


@register
class HeuristicAdapter(Adapter):
    """Names and words alone."""

    name = "heuristic"

    def __init__(self, functions: bool = False):
        self.functions = functions

    def detect(self, root: str) -> float:
        cfg = load(root)
        specs, code = _has(root, {*SPEC_DIRS, *cfg.spec_dirs}), _has(root, {*SOURCE_DIRS, *cfg.source_dirs})
        return 0.8 if specs and code else 0.4 if specs or code else 0.0

    def analyze(self, spark: SparkSession, root: str, cfg: Config | None = None) -> TraceGraph:
        cfg = cfg or load(root)
        skipped = frozenset(cfg.exclude_dirs)
        specs = store(spec_candidates(spark, root, cfg.spec_dirs, cfg.spec_files, skipped))
        codes = store(code_candidates(spark, root, cfg.source_dirs, cfg.source_files, skipped))
        return heuristic_graph(specs, codes, self.functions, cfg.min_confidence)


@register
class TagAdapter(Adapter):
    """Annotations in comments, and a mapping file."""

    name = "tags"

    def detect(self, root: str) -> float:
        file = load(root).mapping_file
        if os.path.exists(os.path.join(root, file)):
            return 0.95
        for path in walk(root, (*source_endings(), *tags.DATA_ENDINGS)):
            with open(path, "rb") as f:
                if b"@impl" in f.read():
                    return 0.7
        return 0.5 if os.path.isdir(os.path.join(root, os.path.dirname(file))) else 0.0

    def analyze(self, spark: SparkSession, root: str) -> TraceGraph:
        mapped = mapping.read_mapping(spark, root, load(root).mapping_file)
        tagged, marks = tags.tag_graph(store(tags.extract_tags(tags.tagged_files(spark, root))))
        own = marks.groupBy(F.col("spec_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("path", "file", "line"))).alias("boundaries"))
        g = merge(mapped, tagged)
        return stored(TraceGraph(g.nodes.join(own, "id", "left"), first_edges(g.edges)))


@register
class AstGraphAdapter(Adapter):
    """A graph file that an AST tool left in the project."""

    name = "ast-graph"

    def detect(self, root: str) -> float:
        if not os.path.exists(os.path.join(root, load(root).graph_file)):
            return 0.0
        return 0.25 if next(walk(root, tuple(".c .cpp .go .java .js .py .rb .rs .ts".split())), None) else 0.0

    def analyze(self, spark: SparkSession, root: str) -> TraceGraph:
        return TraceGraph(*graph_json.read(spark, os.path.join(root, load(root).graph_file)))
