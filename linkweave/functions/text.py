"""Column builders for text, paths and hashes, and rows of lists; all stay inside Spark's own expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words too common to link anything.
STOP_WORDS = tuple(sorted("with will was to this the that should or on of its it is in has have from for does do by be at as are and an a".split()))

#: File ending -> (language, comment sign).
LANGUAGES = {
    **{e: (n, "//") for e, n in [(".c", "C"), (".cpp", "C++"), (".cs", "C#"), (".dart", "Dart"), (".go", "Go"), (".h", "C Header"), (".hpp", "C++ Header"), (".java", "Java")]},
    **{e: (n, "//") for e, n in [(".js", "JavaScript"), (".jsx", "JSX"), (".kt", "Kotlin"), (".php", "PHP"), (".phtml", "PHP (HTML)"), (".rs", "Rust")]},
    **{e: (n, "//") for e, n in [(".scala", "Scala"), (".swift", "Swift"), (".ts", "TypeScript"), (".tsx", "TSX")]},
    **{e: (n, "#") for e, n in [(".bash", "Bash"), (".py", "Python"), (".rb", "Ruby"), (".sh", "Shell"), (".zsh", "Zsh")]},
}
TEST_MARKS = ("test_", "_test")


def strip(c: Column) -> Column:
    """Unicode white space off both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def tokens(c: Column) -> Column:
    """Set of lower-case identifiers of three letters or more, camel case and underscores split, without stop words."""
    parts = F.translate(F.regexp_replace(c, "([a-z])([A-Z])", "$1 $2"), "_", " ")
    found = F.regexp_extract_all(F.lower(parts), F.lit("[a-zA-Z_][a-zA-Z0-9_]{2,}"), F.lit(0))
    return F.array_except(F.array_distinct(found), F.array(*[F.lit(w) for w in STOP_WORDS]))


def top_dir(path: Column) -> Column:
    """First component of a path with directories, else empty."""
    return F.when(F.contains(path, F.lit("/")), F.split_part(path, F.lit("/"), F.lit(1))).otherwise(F.lit(""))


def parent(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    return F.regexp_extract(name(path), r".(\.[^.]+)$", 1)


def stem(path: Column) -> Column:
    """File name without its last ending."""
    return F.regexp_replace(name(path), r"(?<=.)\.[^.]*$", "")


def package_stem(path: Column) -> Column:
    """Stem, or the directory's name for a package's init file."""
    up = F.when(F.size(F.split(path, "/")) > 1, F.element_at(F.split(path, "/"), -2)).otherwise(F.lit(""))
    return F.when(stem(path) == "__init__", up).otherwise(stem(path))


def module_name(path: Column) -> Column:
    """Name of the directory that holds a file, or the stem at the root."""
    return F.when(F.contains(path, F.lit("/")), F.element_at(F.split(path, "/"), -2)).otherwise(stem(path))


def is_test(path: Column) -> Column:
    low = F.lower(stem(path))
    return F.contains(low, F.lit(TEST_MARKS[0])) | F.contains(low, F.lit(TEST_MARKS[1]))


def language(path: Column) -> Column:
    table = F.create_map(*[x for e, (n, _) in sorted(LANGUAGES.items()) for x in (F.lit(e), F.lit(n))])
    return table[F.lower(extension(path))]


def hash16(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 16)


def without_first_line(c: Column) -> Column:
    return F.regexp_replace(c, "^[^\n]*\n?", "")


def preview(c: Column) -> Column:
    """First 80 characters of the stripped text, on one line."""
    return F.translate(F.substring(strip(c), 1, 80), "\n", " ")


def line_breaks(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))


def clean_title(c: Column) -> Column:
    """Heading without a leading number, unless nothing else is left."""
    numbered = F.regexp_extract(c, r"(?d)^[\d.]+[.\s]\s*(.*)$", 1)
    return F.when(c.rlike(r"(?d)^[\d.]+[.\s]\s*(.*)$") & (strip(numbered) != ""), strip(numbered)).otherwise(c)


def split_values(c: Column, wide_comma: bool = False) -> Column:
    """Trimmed non-empty parts between commas."""
    return F.filter(F.transform(F.split(c, "[,，]" if wide_comma else ","), strip), lambda x: x != "")


def glob_regex(pattern: Column) -> Column:
    """Regex of a path pattern: with ``* ? [`` shell-style (``*`` crosses ``/``), else a plain prefix."""
    plain = F.regexp_replace(pattern, r"([.+^$(){}|\\])", r"\\$1")
    sets = F.regexp_replace(F.regexp_replace(plain, r"\[(?![^\]]+\])", r"\\["), r"\[!", "[^")
    shell = F.regexp_replace(F.regexp_replace(sets, r"\*", ".*"), r"\?", ".")
    return F.when(pattern.rlike(r"[*?\[]"), F.concat(F.lit("(?s)^"), shell, F.lit("$"))).otherwise(F.concat(F.lit("^"), F.regexp_replace(plain, r"([\]?*])", r"\\$1")))


def unfolded(rows: DataFrame, items: Column, name: str, at: str = "__at") -> DataFrame:
    """``rows`` with a row for each of ``items``, as ``name``, and its place ``at``; rows without any go.

    From an explode Spark infers a filter on the size of the whole expression and moves
    it to the scan, below exchanges: parsing would run again, and in the scan's few
    tasks.  It infers none from an outer one.
    """
    return rows.select("*", F.posexplode_outer(items).alias(at, name)).filter(F.col(at).isNotNull())
