"""Import graph, call graph and what a change reaches through it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..schema import DEPENDS, INFERRED, SPEC
from ..scratch import store
from .graph import TraceGraph
from .parse import LIBRARY

ROOTS, ENDINGS = tuple("src lib app".split()), tuple(".py .ts .js .go .rs .java".split())


def resolve_imports(files: DataFrame) -> DataFrame:
    """(file, import, target) of files with their ``imports`` (file, imports, ord).

    In order: below the source roots, as a module or a package; beside the importing
    file by ending; by the last name alone, where the only file of that stem, one in
    the same directory, or the first counts.  Relative imports of dots only aren't
    resolved, and a file doesn't depend on itself.
    """
    wants = X.unfolded(files.select("file", "imports"), F.col("imports"), "import").select("file", "import").distinct().filter("import rlike '[^.]'")
    slashed = F.replace("import", F.lit("."), F.lit("/"))
    tries = []
    for root in ROOTS:
        direct = F.startswith("import", F.lit(root))
        tries += [F.when(direct, F.concat(slashed, F.lit(e))) for e in (".py", "/__init__.py")]
        tries += [F.concat(F.lit(f"{root}/"), slashed, F.lit(e)) for e in (".py", "/__init__.py")]
    here = F.when(X.parent(F.col("file")) == ".", slashed).otherwise(F.concat(X.parent(F.col("file")), F.lit("/"), slashed))
    tries += [F.concat(F.regexp_replace(here, r"(?<=[^/])\.[^./]*$", ""), F.lit(e)) for e in ENDINGS]
    guesses = wants.select("file", "import", F.posexplode(F.array(*tries)).alias("place", "target")).filter("target is not null")
    known = files.select(F.col("file").alias("target"), "ord").distinct()
    by_path = guesses.join(known.select("target"), "target").select("file", "import", "target", "place", F.lit(0).alias("apart"), F.lit(0).cast("long").alias("ord"))
    last = F.element_at(F.split("import", r"\."), -1)
    stems = known.select(F.col("target"), "ord", X.stem(F.col("target")).alias("stem"))
    # chosen once a stem, and once a stem and directory, so hot stems don't multiply
    first = stems.groupBy("stem").agg(F.min(F.struct("ord", "target")).alias("any"))
    near = stems.groupBy("stem", X.parent(F.col("target")).alias("dir")).agg(F.min(F.struct("ord", "target")).alias("near"))
    by_stem = wants.select("file", "import", last.alias("stem"), X.parent(F.col("file")).alias("dir")).join(first, "stem").join(near, ["stem", "dir"], "left")
    best_of = F.coalesce("near", "any")
    by_stem = by_stem.select("file", "import", best_of["target"].alias("target"), F.lit(len(tries)).alias("place"), F.col("near").isNull().cast("int").alias("apart"), best_of["ord"].alias("ord"))
    best = by_path.unionByName(by_stem).groupBy("file", "import").agg(F.min_by("target", F.struct("place", "apart", "ord")).alias("target"))
    return best.filter("file <> target")


def import_edges(files: DataFrame, edges: DataFrame) -> DataFrame:
    """depends edges (src_id, dst_id, relation, strength) of resolved imports that ``edges`` doesn't have."""
    new = resolve_imports(files).select(F.col("file").alias("src_id"), F.col("target").alias("dst_id")).distinct()
    old = edges.filter(F.col("relation") == DEPENDS).select("src_id", "dst_id")
    return new.join(old, ["src_id", "dst_id"], "left_anti").withColumns({"relation": F.lit(DEPENDS), "strength": F.lit(INFERRED)})


def resolve_callees(called: DataFrame, functions: DataFrame) -> DataFrame:
    """(file, name, callee): for each called name (file, name) the function meant, as ``file::name``.

    The same file's, else the only other file's, else one in the same directory, else
    the first; ``functions`` has (file, name, ord).  The choice among others is made
    once a name and once a name and directory, so hot names don't multiply.
    """
    wants = called.filter(~F.col("name").isin(*LIBRARY, "__init__")).select("file", "name").distinct()
    defs = functions.groupBy("file", "name").agg(F.min("ord").alias("ord"))
    own = wants.join(defs.select("file", "name"), ["file", "name"], "left_semi").select("file", "name", F.concat("file", F.lit("::"), "name").alias("callee"))
    others = wants.join(own, ["file", "name"], "left_anti").withColumn("dir", X.parent(F.col("file")))
    first = defs.groupBy("name").agg(F.min_by("file", "ord").alias("any_file"))
    near = defs.groupBy("name", X.parent(F.col("file")).alias("dir")).agg(F.min_by("file", "ord").alias("near_file"))
    picked = others.join(first, "name").join(near, ["name", "dir"], "left")
    return own.union(picked.select("file", "name", F.concat(F.coalesce("near_file", "any_file"), F.lit("::"), "name")))


def call_edges(called: DataFrame, functions: DataFrame) -> DataFrame:
    """(caller, callee): every function of a file calls what is called anywhere in the file."""
    found = resolve_callees(called, functions).select("file", "callee")
    callers = functions.select("file", F.concat("file", F.lit("::"), "name").alias("caller")).distinct()
    return callers.join(found, "file").select("caller", "callee").distinct()


def neighbours(calls: DataFrame, key: str) -> DataFrame:
    """(direction, key) of direct callees and callers of a function."""
    down = calls.filter(F.col("caller") == key).select(F.lit("callee").alias("direction"), F.col("callee").alias("key"))
    return down.union(calls.filter(F.col("callee") == key).select(F.lit("caller"), "caller")).distinct()


def degrees(calls: DataFrame) -> DataFrame:
    """(key, n_callees, n_callers) of every function in a call."""
    both = calls.select(F.col("caller").alias("key"), F.lit(1).alias("d"), F.lit(0).alias("u")).union(calls.select("callee", F.lit(0), F.lit(1)))
    return both.groupBy("key").agg(F.sum("d").alias("n_callees"), F.sum("u").alias("n_callers"))


def reach(seeds: DataFrame, calls: DataFrame, max_depth: int = 3) -> DataFrame:
    """(key, depth): functions reached from ``seeds`` (key) by at most ``max_depth`` calls, at least depth.

    Each level joins only the last level's new functions, without those seen; levels
    are stored, so a deep search neither recomputes nor grows its plan.
    """
    seen = store(seeds.select("key").distinct().withColumn("depth", F.lit(0)))
    level = seen
    for depth in range(1, max_depth + 1):
        step = level.join(calls, F.col("key") == F.col("caller")).select(F.col("callee").alias("key")).distinct()
        level = store(step.join(seen.select("key"), "key", "left_anti").withColumn("depth", F.lit(depth)))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen


def impact_seeds(graph: TraceGraph, functions: DataFrame, spec: str) -> DataFrame:
    """Functions that any edge ties to a spec: function nodes themselves, and all functions (file, key) of file nodes.

    What the edges hit is stored, so its size is known and the smaller side of each join
    is sent, not all nodes or functions because their compressed columns are small.
    """
    specs = graph.nodes.filter((F.col("type") == SPEC) & ((F.col("id") == spec) | F.endswith("id", F.lit(f".{spec}")))).select(F.col("id").alias("dst_id"))
    hits = store(graph.edges.join(specs, "dst_id", "left_semi").select("src_id").distinct())
    src = store(hits.join(graph.nodes.select(F.col("id").alias("src_id"), "file"), "src_id").filter("file <> ''").select("src_id", "file"))
    own = src.filter(F.contains("src_id", F.lit("::"))).select(F.col("src_id").alias("key"))
    whole = src.filter(~F.contains("src_id", F.lit("::"))).join(functions, "file").select("key")
    return own.union(whole).distinct()


def transitive_impact(seeds: DataFrame, calls: DataFrame, functions: DataFrame, max_depth: int = 3) -> DataFrame:
    """(file, kind, depth): files hit directly (seeds) and transitively (other functions reached); a file may be both."""
    hit = reach(seeds, calls, max_depth).join(functions.select("key", "file"), "key")
    kind = F.when(F.col("depth") == 0, "direct").otherwise("transitive")
    return hit.groupBy("file", kind.alias("kind")).agg(F.min("depth").alias("depth"))


def traversed(seen: DataFrame, calls: DataFrame) -> DataFrame:
    """(caller, callee) of calls from functions reached to deeper ones or beyond the limit."""
    a = seen.select(F.col("key").alias("caller"), F.col("depth").alias("d1"))
    b = seen.select(F.col("key").alias("callee"), F.col("depth").alias("d2"))
    rows = calls.join(a, "caller").join(b, "callee", "left")
    return rows.filter("d2 is null or d2 > d1").select("caller", "callee")


def resolve_symbols(rows: DataFrame) -> DataFrame:
    """Call edges of imported symbols (ord, symbol, file, callees): a reference means a symbol read before or with it, exactly or as the end of ``file::symbol``."""
    named = rows.select("ord", F.concat("file", F.lit("::"), "symbol").alias("key"), "symbol")
    refs = X.unfolded(rows, F.col("callees"), "ref").select("ord", F.concat("file", F.lit("::"), "symbol").alias("caller"), "ref").distinct()
    # the first symbol of a key, and of a name, is the one meant wherever any is read before the reference
    exact = named.groupBy(F.col("key").alias("ref")).agg(F.min("ord").alias("eord"))
    ending = named.groupBy(F.col("symbol").alias("ref")).agg(F.min(F.struct("ord", "key")).alias("near"))
    found = refs.join(exact, "ref", "left").join(ending, "ref", "left")
    callee = F.when(F.col("eord") <= F.col("ord"), F.col("ref")).when(F.col("near.ord") <= F.col("ord"), F.col("near.key"))
    return found.select("caller", callee.alias("callee")).filter("callee is not null").distinct()
