"""Parsing operators: documents and sources to rows, in Spark's own expressions.

Line-based operators work on (path, text) with ``\\n`` line ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..scratch import store

HEADING = r"(?d)^(#{1,6})(?U:\s+)(.+)$"
MODIFIERS = "abstract async export internal open override private protected pub public sealed static virtual".split()
DEFINERS = "class def enum extension fn function impl interface mixin record struct trait typedef".split()
DEFINITION = rf"(?U)^\s*(?:\s*(?:{'|'.join(MODIFIERS)})\s+)*(?:{'|'.join(DEFINERS)})\s+([A-Za-z_]\w*).*?(?:=>|: |[(:={{])"
CLASS_LIKE = ("class ", "enum ", "interface ", "record ", "struct ", "trait ")
CALL = r"(?U)(?:^|[\s.,;:!?&|~={(])([A-Za-z_]\w*)\s*\("
KEYWORDS = sorted("throw del assert yield raise return else elif catch switch with while for if".split())
#: Names of standard libraries that are no callees of a project.
LIBRARY = sorted(
    (
        "print println printf sprintf open close input append copy clone collect fold iter into_iter into from as_ref to_string to_owned unwrap and_then or_else"
        " enumerate filter float getattr setattr hasattr isinstance int len list map range reversed set sorted str dict tuple type zip"
        " assert expect describe it require console process module exports error fmt log make new delete panic recover"
        " Arc Box Buffer Err HashMap Mutex None Ok Option Rc Result Some String Vec"
    ).split()
)


def _split(files: DataFrame, pattern: str) -> DataFrame:
    """``files`` with ``__parts``: (line, head, body) of each line of ``text`` that fits, with the lines up to the next that does.

    Lines are marked and joined again, and the marks cut the text in one pass, so a
    file's work grows with its length; every line begins with a mark, so no text is
    taken for one.
    """
    mark = F.transform(F.split("text", "\n"), lambda x: F.concat(F.when(x.rlike(pattern), F.lit("=")).otherwise(F.lit("+")), x))
    heads = F.filter(F.transform("__marked", lambda x, i: F.when(F.startswith(x, F.lit("=")), F.struct((i + 1).alias("line"), F.substring(x, 2, 1 << 30).alias("head")))), lambda h: h.isNotNull())
    pieces = F.split(F.concat(F.lit("\n"), F.array_join("__marked", "\n")), "\n=")  # the first is what is above the first head
    rows = files.withColumn("__marked", mark).withColumns({"__heads": heads, "__pieces": pieces}).withColumn("__bodies", F.slice("__pieces", 2, F.size("__pieces")))
    parts = F.transform(F.arrays_zip("__heads", "__bodies"), lambda p: F.struct(p["__heads"]["line"].alias("line"), p["__heads"]["head"].alias("head"), F.replace(p["__bodies"], F.lit("\n+"), F.lit("\n")).alias("body")))
    return rows.withColumn("__parts", parts).drop("__marked", "__heads", "__pieces", "__bodies")


def _parts(files: DataFrame, pattern: str, *more: str) -> DataFrame:
    """(path, line, head, body) and columns ``more``: ``_split`` as rows; a file's own row is all that is looked at."""
    return X.unfolded(_split(files.select("path", "text", *more), pattern), F.col("__parts"), "part").select("path", *more, "part.*")


def sections(files: DataFrame, *more: str) -> DataFrame:
    """(path, line, depth, heading, body) and columns ``more``: a section goes from its heading to the line before the next; text above the first heading is no section."""
    depth, heading = F.length(F.regexp_extract("head", HEADING, 1)), X.strip(F.regexp_extract("head", HEADING, 2))
    return _parts(files, HEADING, *more).select("path", *more, "line", depth.alias("depth"), heading.alias("heading"), "body")


def numbered(headings: DataFrame) -> DataFrame:
    """``headings`` (path, line, depth, heading, ...) with number (``1.2``) and parent_chain.

    A counter a depth, deeper ones reset by each heading; a number joins the counters
    in use up to its depth, and its chain holds the nearest shallower headings.  Both
    are running values over one order of a path's lines, less what they were at the
    last shallower heading, so a path is sorted once.
    """
    w = Window.partitionBy("path").orderBy("line")
    above, at = w.rangeBetween(Window.unboundedPreceding, -1), F.col("depth")
    depths = range(1, 7)
    out = headings.withColumns({
        **{f"__b{k}": F.coalesce(F.max(F.when(at < k, F.col("line"))).over(w), F.lit(0)) for k in depths},
        **{f"__n{k}": F.count_if(at == k).over(w) for k in depths},
        **{f"__a{k}": F.count_if(at == k).over(above) for k in depths},
        **{f"__t{k}": F.last(F.when((at == k) & F.col("heading").isNotNull(), F.struct("line", "heading")), True).over(w) for k in depths},
    })
    out = out.withColumns({f"__c{k}": F.col(f"__n{k}") - F.coalesce(F.max(F.when(at < k, F.col(f"__a{k}"))).over(w), F.lit(0)) for k in depths})
    counts = F.array(*[F.when((at >= k) & (F.col(f"__c{k}") > 0), F.col(f"__c{k}").cast("string")) for k in depths])
    chain = F.array(*[F.when((at > k) & (F.col(f"__t{k}.line") >= F.col(f"__b{k}")), F.col(f"__t{k}.heading")) for k in depths])
    out = out.withColumn("number", F.array_join(F.array_compact(counts), ".")).withColumn("parent_chain", F.array_compact(chain))
    return out.drop(*[f"__{x}{k}" for x in "bnatc" for k in depths])


def id_prefix(path: Column) -> Column:
    """Directories and stem joined by dots; ``root.`` in front for files at the root."""
    dotted = F.replace(X.parent(path), F.lit("/"), F.lit("."))
    return F.concat(F.when(F.contains(path, F.lit("/")), dotted).otherwise(F.lit("root")), F.lit("."), X.stem(path), F.lit("."))


def spec_rows(files: DataFrame) -> DataFrame:
    """Spec candidates of Markdown files (path, text, ord), in the layout ``schema.SPECS``."""
    rows = numbered(sections(files, "ord"))
    return rows.select(
        (F.col("ord") * F.lit(1 << 24) + F.col("line")).alias("ord"), F.col("path").alias("file"), F.col("depth").alias("heading_depth"), F.col("heading").alias("heading_text"),
        F.concat(id_prefix(F.col("path")), "number").alias("auto_id"), X.clean_title(F.col("heading")).alias("title"), F.col("line").cast("int").alias("line"), "parent_chain",
        F.col("body").alias("body_text"), X.hash16(F.col("body")).alias("body_hash"), X.hash16(X.without_first_line(F.col("body"))).alias("body_hash_content"),
        X.line_breaks(F.col("body")).alias("body_line_count"), X.preview(F.col("body")).alias("body_preview"),
    )


def symbols(text: Column) -> Column:
    """Sorted distinct names defined anywhere in a source."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit("(?md)" + DEFINITION), F.lit(1))))


def imports(path: Column, text: Column, most: int = 8) -> Column:
    """Imported modules of Python, JavaScript/TypeScript and Rust sources, the first ``most``."""
    both = lambda pattern: F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.coalesce(F.nullif(F.regexp_extract(m, pattern, 1), F.lit("")), F.regexp_extract(m, pattern, 2)))
    python = both(r"(?mdU)^(?:import\s+([\w.]+)|from\s+([\w.]+)\s+import)")
    script = both(r"""(?dU)(?:require\(["'](.+?)["']\)|import\s+.*?from\s+["'](.+?)["'])""")
    rust = F.regexp_extract_all(text, F.lit(r"(?mdU)^use\s+([\w:]+)"), F.lit(1))
    ext = F.lower(X.extension(path))
    found = F.when(ext == ".py", python).when(ext.isin(".js", ".jsx", ".ts", ".tsx"), script).when(ext == ".rs", rust).otherwise(F.array().cast("array<string>"))
    return F.slice(found, 1, most)


def _name_kind(head: Column) -> tuple[Column, Column]:
    left, kind = F.regexp_replace(head, r"(?U)^\s+", ""), F.lit(False)
    for start in CLASS_LIKE:
        kind = kind | F.startswith(left, F.lit(start))
    return F.regexp_extract(head, "(?d)" + DEFINITION, 1).alias("name"), F.when(kind, "class").otherwise("function").alias("kind")


def function_blocks(files: DataFrame, *more: str) -> DataFrame:
    """(path, name, kind, line, body) and columns ``more``: from each definition's line to the line before the next."""
    return _parts(files, "(?d)" + DEFINITION, *more).select("path", *more, *_name_kind(F.col("head")), "line", "body")


def code_rows(files: DataFrame) -> DataFrame:
    """Code candidates of source files (path, text, ord), in the layout ``schema.CODES``; each file's row makes its own."""
    block = lambda p: F.struct(*_name_kind(p["head"]), p["line"].alias("line"), X.hash16(p["body"]).alias("body_hash"), (X.line_breaks(p["body"]) + 1).alias("body_lines"), X.preview(p["body"]).alias("body_preview"))
    empty = F.array().cast("array<struct<name:string,kind:string,line:int,body_hash:string,body_lines:int,body_preview:string>>")
    path, text = F.col("path"), F.col("text")
    return _split(files, "(?d)" + DEFINITION).select(
        F.col("ord").cast("long").alias("ord"), path.alias("file"), X.module_name(path).alias("module"), symbols(text).alias("symbols"), X.is_test(path).alias("is_test"), X.language(path).alias("language"),
        imports(path, text).alias("imports"), (X.line_breaks(text) + 1).alias("line_count"), F.coalesce(F.transform("__parts", block), empty).alias("functions"), X.hash16(text).alias("file_hash"),
    )


def calls(text: Column) -> Column:
    """Distinct names called in a source: no keywords, no capitalised names but single letters."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(CALL), F.lit(1)))
    keep = lambda x: ~(x.isin(*KEYWORDS) | ((F.length(x) > 1) & x.rlike("^[A-Z]")))
    return F.filter(found, keep)


def html_tags(files: DataFrame) -> DataFrame:
    """(path, kind, value, n) of ``<!-- @kind value -->`` comments, numbered within kind by position."""
    kinds = F.array(*[F.lit(k) for k in ("spec", "design", "satisfies")])
    rows = files.select("path", "text", F.explode(kinds).alias("kind"))
    found = F.expr("regexp_extract_all(text, '<!--\\\\s*@' || kind || '\\\\s+(.+?)\\\\s*-->', 1)")
    return X.unfolded(rows, found, "value", "n").select("path", "kind", "n", X.strip(F.col("value")).alias("value"))


def hierarchy(items: DataFrame) -> DataFrame:
    """``items`` (file, id, title, parent) with depth and parent_chain of titles.

    An unknown parent gives depth 1 and its own id as the chain; a cycle ends where it
    closes.  Depth grows by joins, as many as the deepest chain is long; each level is
    stored, so a deep hierarchy computes none twice.
    """
    known = items.select(F.col("file").alias("pf"), F.col("id").alias("pid"))
    rows = items.join(known, (F.col("file") == F.col("pf")) & (F.col("parent") == F.col("pid")), "left")
    top = rows.filter("pid is null").select("file", "id", "title", F.when(F.coalesce("parent", F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array("parent")).alias("parent_chain"), F.lit(1).alias("depth"))
    below = rows.filter("pid is not null").select("file", "id", "title", "parent")
    level = store(top)
    done, n = level, 1
    while True:
        up = level.select(F.col("file").alias("uf"), F.col("id").alias("uid"), F.col("title").alias("utitle"), F.col("parent_chain").alias("uchain"))
        level = store(below.join(up, (F.col("file") == F.col("uf")) & (F.col("parent") == F.col("uid"))).select("file", "id", "title", F.array_append("uchain", F.col("utitle")).alias("parent_chain"), F.lit(n + 1).alias("depth")))
        if level.isEmpty():
            break
        n += 1
        done = done.unionByName(level)
    rest = below.join(done.select("file", "id"), ["file", "id"], "left_anti")
    return done.unionByName(rest.select("file", "id", "title", F.array("parent").alias("parent_chain"), F.lit(1).alias("depth")))
