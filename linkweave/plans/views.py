"""The trace model over the driver's tables: views in SQL that Spark and DuckDB both run.

A view names tables in braces; Spark reads their Parquet files, DuckDB the tables
registered under these names.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

_PART_FILE = "concat('src/', lower(p.p_type), '/', replace(p.p_name, ' ', '_'), '_', cast(p.p_partkey as string), '.py')"

#: Views of small tables whose texts are long to parse: dealt out by path, as their bytes alone would make a task or two.
SPREAD = ("markdown", "sources")


def _joined(spark: bool, part: str, key: str, by: str) -> str:
    """Rows' ``part`` joined by line breaks in order of ``key`` within a group."""
    if spark:
        return f"array_join(transform(array_sort(collect_list(struct({key} as k, {part} as l))), x -> x.l), chr(10))"
    return f"string_agg({part}, chr(10) order by {key})"


def _hash(spark: bool, expr: str) -> str:
    return f"substring(sha2({expr}, 256), 1, 16)" if spark else f"substring(sha256({expr}), 1, 16)"


def view_sql(name: str, spark: bool) -> str:
    views = {
        "nodes": f"""
select concat('spec:', cast(c_custkey as string)) as id, 'spec' as type, c_name as title, concat('docs/', c_mktsegment, '/', c_name, '.md') as file,
  case when c_custkey % 3 = 0 then 'tags' else 'heuristic' end as framework_origin, cast(0.8 as double) as confidence, concat(c_mktsegment, ' ', cast(c_nationkey as string)) as heading_text, c_mktsegment as segment, c_custkey as ord from {{customer}}
union all
select concat('part:', cast(p.p_partkey as string)), 'code', p.p_name, {_PART_FILE}, 'heuristic', cast(0.9 as double), '', '', 1000000000 + p.p_partkey from {{part}} p
union all
select concat('supp:', cast(s_suppkey as string)), 'test', s_name, concat('tests/test_', cast(s_suppkey as string), '.py'), 'heuristic', cast(0.9 as double), '', '', 2000000000 + s_suppkey from {{supplier}}""",
        "edges_raw": """
select src_id, dst_id, relation, min(strength) as strength, ord from (select concat('part:', cast(l_partkey as string)) as src_id, concat('spec:', cast(o_custkey as string)) as dst_id,
  case when l_quantity < 49 then 'references' when l_returnflag = 'A' then 'implements' when l_returnflag = 'R' then 'verifies' else 'depends' end as relation,
  case when l_linestatus = 'O' then 'explicit' when l_linenumber < 3 then 'inferred' else 'weak' end as strength,
  ((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey % 1000000) * 1000 + l_suppkey % 1000 as ord
from {lineitem} join {orders} on l_orderkey = o_orderkey) group by src_id, dst_id, relation, ord""",
        "edges": "select src_id, dst_id, relation, min(strength) as strength, min(ord) as ord from ({edges_raw}) group by src_id, dst_id, relation",
        "nodes_again": "select case when segment = 'BUILDING' then concat(id, ' new') else id end as id, concat(title, ' (again)') as title, cast(0.5 as double) as confidence, ord + 5000000000 as ord from ({nodes})",
        "nodes_twice": "select id, title, confidence, ord from ({nodes}) union all select * from ({nodes_again})",
        "spec_ids": """
select concat('docs.', lower(c_mktsegment), '.', cast(c_nationkey as string), '.', cast(c_custkey as string)) as id, 'spec' as type, c_name as title, cast(0.8 as double) as confidence, c_custkey as ord from {customer}
union all select concat('spec::', cast(c_nationkey as string), '.', cast(c_custkey as string)), 'spec', '', cast(0.95 as double), 1000000000 + c_custkey from {customer} where c_mktsegment = 'BUILDING'
union all select concat('spec::', cast(c_custkey + 7 as string), '.', cast(c_nationkey as string)), 'spec', 'x', cast(0.7 as double), 2000000000 + c_custkey from {customer} where c_mktsegment = 'MACHINERY'
union all select concat('spec::', cast(c_nationkey as string), '.', cast(c_custkey as string), '9'), 'spec', 'y', cast(0.7 as double), 3000000000 + c_custkey from {customer} where c_mktsegment = 'FURNITURE'""",
        "spec_edges": "select concat('part:', cast(p_partkey as string)) as src_id, case when c_custkey is null then 'spec::none' else concat('spec::', cast(c_nationkey as string), '.', cast(c_custkey as string)) end as dst_id, 'implements' as relation, 'explicit' as strength, p_partkey as ord from {part} left join {customer} on p_partkey = c_custkey",
        "specs": """
select item_id as spec_id, concat(case item_id % 4 when 0 then 'en' when 1 then 'de' when 2 then 'fr' else 'esx' end, '/src', cast(item_id % 20 as string), '.md') as file, concat('src', cast(item_id % 20 as string)) as stem, text from {benchmark}""",
        "codes": "select doc_id as code_id, concat(lang, '/', source, '.py') as file, source as stem, text, doc_id % 5 = 0 as is_test from {documents}",
        "before": f"""
select concat('d', cast(doc_id as string)) as id, concat('Doc ', source) as title, text as body, {_hash(spark, "text")} as body_hash, case when n_chars < 200 then '' else {_hash(spark, "substring(text, 20)")} end as body_hash_content, doc_id as ord from {{documents}}""",
        "after": f"""
select concat('d', cast(case when doc_id % 7 = 0 then doc_id + 1000000 else doc_id end as string)) as id, concat('Doc ', source, case when doc_id % 13 = 0 then ' two' else '' end) as title,
  case when doc_id % 11 = 0 then concat(text, ' more') else text end as body, {_hash(spark, "case when doc_id % 11 = 0 then concat(text, ' more') else text end")} as body_hash,
  case when n_chars < 200 then '' else {_hash(spark, "substring(case when doc_id % 11 = 0 then concat(text, ' more') else text end, 20)")} end as body_hash_content, doc_id as ord from {{documents}}""",
        "markdown": f"""
select concat('docs/', n_name, '.md') as path, concat('# ', n_name, chr(10), {_joined(spark, "line", "c_custkey", "path")}) as text, n_nationkey as ord from (
  select n_name, n_nationkey, c_custkey, concat(repeat('#', cast(2 + c_custkey % 3 as int)), ' ', case when c_custkey % 4 = 0 then concat(cast(c_custkey % 7 as string), '.', cast(c_custkey % 3 as string), '. ') else '' end, c_mktsegment, ' ', cast(c_custkey as string), chr(10),
    '<!-- @spec ', cast(c_custkey % 9 as string), '.', cast(c_custkey % 5 as string), ' -->', chr(10), case when c_custkey % 6 = 0 then concat('<!-- @satisfies ', cast(c_custkey as string), ', ', cast(c_custkey + 1 as string), ' -->', chr(10)) else '' end, '  Body of ', c_name, case when c_custkey % 2 = 0 then chr(10) else '' end) as line
  from {{customer}} join {{nation}} on c_nationkey = n_nationkey) group by n_name, n_nationkey""",
        "sources": f"""
select {_PART_FILE} as path, p.p_partkey as ord, concat('# @impl ', cast(p.p_partkey as string), ', ', cast(p.p_partkey + 1 as string), chr(10),
  'import ', case when p.p_partkey % 3 = 0 then concat('src.', lower(coalesce(q.p_type, 'none')), '.') when p.p_partkey % 3 = 1 then concat(lower(coalesce(q.p_type, 'none')), '.') else '' end, replace(coalesce(q.p_name, 'os'), ' ', '_'), '_', cast(p.p_partkey + 1 as string), chr(10),
  'def ', replace(p.p_name, ' ', '_'), '(x):', chr(10), '    return ', replace(coalesce(q.p_name, 'len'), ' ', '_'), '(x) + len(x)', chr(10),
  case when p.p_partkey % 2 = 0 then 'class ' else 'async def ' end, 'Part', cast(p.p_partkey % 17 as string), case when p.p_partkey % 2 = 0 then ':' else '(y):' end, chr(10), '    if (x): helper_', cast(p.p_partkey % 5 as string), '(x)', chr(10), 'def helper_', cast(p.p_partkey % 5 as string), '(z): pass') as text
from {{part}} p left join {{part}} q on q.p_partkey = p.p_partkey + 1""",
        "calls": """
select distinct cast(l_partkey as string) as caller, cast(callee as string) as callee from (
  select l_partkey, lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as callee from {lineitem}) where callee is not null""",
        "outline": "select cast(conv_id as string) as path, turn + 1 as line, case role when 'user' then 1 when 'assistant' then 2 else 3 end as depth, text as heading from {conversations}",
        "yaml_items": "select cast(n_regionkey as string) as file, cast(n_nationkey as string) as id, n_name as title, case when n_nationkey < 5 then '' when n_nationkey = 20 then 'gone' when n_nationkey = 21 then '22' when n_nationkey = 22 then '21' else cast((n_nationkey - 5) as string) end as parent, 1 as one from {nation}",
        "pages_text": "select concat('p', cast(page_id as string)) as path, concat(html, ' <!-- @spec ', cast(page_id as string), ' --> <!--  @design  d', cast(page_id % 7 as string), '  -->') as text from {pages}",
        "files_now": f"select concat('d', cast(doc_id as string)) as path, {_hash(spark, 'text')} as hash, doc_id % 100 as mtime from {{documents}}",
        "files_then": f"select concat(case when lang = 'fr' then 'gone' else 'd' end, cast(doc_id as string)) as path, case when doc_id % 5 = 0 then 'old' else {_hash(spark, 'text')} end as hash, case when doc_id % 3 = 0 then 7 else doc_id % 100 end as mtime from {{documents}}",
    }
    return re.sub(r"\{(\w+)\}", lambda m: m[0] if m[1] in TABLES else view_sql(m[1], spark), views[name])


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = re.sub(r"\{(\w+)\}", lambda m: f"parquet.`{sf_dir}/{m[1]}.parquet`", view_sql(name, True))
    rows = spark.sql(sql)
    if name in SPREAD:
        return rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    return rows


def with_views(*names: str) -> str:
    """``with`` clause that defines views for DuckDB."""
    return "with recursive " + ", ".join(f"{n} as ({re.sub(r'[{](\w+)[}]', r'\1', view_sql(n, False))})" for n in names) + " "
