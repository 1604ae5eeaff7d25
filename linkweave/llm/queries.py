"""The registered queries of this subpackage: thin, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_duplicates import similar_documents

    return similar_documents(_table(spark, sf_dir, "documents")).drop("class_id", "component_class", "text_hash")


def op2_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    mixed = mix(_table(spark, sf_dir, "documents"), epochs=1.5)
    return mixed.select("doc_id", "source", F.col("mix_epoch").cast("int").alias("mix_epoch"), "mix_order", F.round("mix_weight", 9).alias("mix_weight"))


def op3_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest_neighbours

    return nearest_neighbours(_table(spark, sf_dir, "embeddings"))


def op4_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify

    return identify(_table(spark, sf_dir, "documents"))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_topk import exact_topk

    return exact_topk(_table(spark, sf_dir, "embeddings"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import expand, read_back

    said = r"\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return read_back(expand(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score_quality

    return score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity

    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    cut = dedup_lines(_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_lines", "lines_removed", F.sha2("text", 256).alias("text_sha256"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import round_trip

    return round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_temperature_mixing": op2_temperature_mixing,
    "op3_multi_index": op3_multi_index,
    "op4_language_codes": op4_language_codes,
    "op5_exact_topk": op5_exact_topk,
    "op6_chat_format": op6_chat_format,
    "op7_quality": op7_quality,
    "op8_toxicity": op8_toxicity,
    "op9_line_dedup": op9_line_dedup,
    "op10_byte_bpe": op10_byte_bpe,
}

SQL: dict[str, str] = {
    "op1_ngram_jaccard": r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), s as (
  select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) as s from w
), t as (select doc_id, len(s) as n, unnest(s) as t from s
), l as (
  select a.doc_id as a, b.doc_id as b from t a join t b on a.t = b.t and a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id having 100 * count(*) >= 70 * (max(a.n) + max(b.n) - count(*))
), r(a, b) as (select a, b from l union select r.a, l.b from r join l on r.b = l.a)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles,
  cast((select count(*) from l where l.a = s.doc_id) as bigint) as n_similar,
  least(s.doc_id, coalesce((select min(b) from r where r.a = s.doc_id), s.doc_id)) as component_id
from s""",
    "op2_temperature_mixing": r"""
with recursive d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as tokens,
    cast('0x' || substring(md5(concat_ws('|', cast(doc_id as varchar), coalesce(text, ''))), 1, 8) as bigint) % 1024 as block from documents
), b as (select source, block, cast(sum(tokens) as bigint) as tokens from d group by source, block
), s as (select source, cast(sum(tokens) as bigint) as tokens from b group by source having sum(tokens) > 0
), p as (select list(tokens / total) as p, any_value(total) as total, floor(1.5 * any_value(total) + 0.5) as budget, count(*) as n from s, (select cast(sum(tokens) as double) as total from s)
), g as (
  select *, ln(n) as most, -list_sum(list_transform(p, lambda x: x * ln(x))) as h1 from p
), h as (
  select 0 as step, 0.0::double as lo, 1.0::double as width, 0.0::double as floor_lo, p, total, budget, n, h1 + 0.5 * (most - h1) - 1e-12 as wanted from g
  union all
  select step + 1,
    lo + width * coalesce((select max(i) from range(33) t(i) where
      ln(list_sum(list_transform(p, lambda x: pow(x, lo + width * i / 32)))) - list_sum(list_transform(p, lambda x: pow(x, lo + width * i / 32) * ln(pow(x, lo + width * i / 32)))) / list_sum(list_transform(p, lambda x: pow(x, lo + width * i / 32))) >= wanted), 0) / 32,
    width / 32,
    floor_lo + width * coalesce((select max(i) from range(33) t(i) where
      list_max(list_transform(p, lambda x: pow(x, floor_lo + width * i / 32 - 1))) / list_sum(list_transform(p, lambda x: pow(x, floor_lo + width * i / 32))) * budget / total > 4 + 1e-12), 0) / 32,
    p, total, budget, n, wanted from h where step < 5
), a as (
  select *, case when total / (n * list_min(p) * total) * budget / total > 4 + 1e-12 then greatest(lo, least(1.0, floor_lo + pow(2.0, -25))) else lo end as alpha from h where step = 5
), q as (
  select source, tokens, pow(tokens / total, alpha) / list_sum(list_transform(p, lambda x: pow(x, alpha))) as weight, budget from s, a
), e as (
  select *, cast(floor(floor(weight * budget + 0.5) / tokens) as bigint) as passes, floor(weight * budget + 0.5) as due from q
), k as (
  select b.source, b.tokens, e.due - e.passes * e.tokens as rest,
    substring(md5(concat_ws('|', coalesce('=' || b.source, 'null'), b.block, e.passes, 11)), 1, 16) || lpad(cast(b.block as varchar), 4, '0') as key
  from b join e on b.source is not distinct from e.source
), c as (
  select source, max(key) as cut from (select *, sum(tokens) over (partition by source order by key) as upto from k) where rest > 0 and rest >= upto - tokens / 2 group by source
), t as (
  select d.doc_id, d.source, d.block, e.weight, e.passes + case when substring(md5(concat_ws('|', coalesce('=' || d.source, 'null'), d.block, e.passes, 11)), 1, 16) || lpad(cast(d.block as varchar), 4, '0') <= c.cut then 1 else 0 end as times
  from d join e on d.source is not distinct from e.source left join c on d.source is not distinct from c.source
), x as (select *, unnest(range(times)) as epoch from t)
select doc_id, source, cast(epoch as integer) as mix_epoch,
  substring(md5(concat_ws('|', coalesce('=' || source, 'null'), block, epoch, 11)), 1, 16) || lpad(cast(block as varchar), 4, '0') as mix_order, round(weight, 9) as mix_weight from x""",
    "op5_exact_topk": """
with r as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) as bigint) as score
  from r q join r c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0
), t as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from t where rank <= 5""",
    "op6_chat_format": r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text, case when conv_id is null then row_number() over () end as alone from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok', null union all select -7, 1, 'assistant', '\### Assistant: </turn> ok', null
), f as (
  select *, 4 + 2 + 8 + length(replace(replace(replace(replace(role, '\', '\\'), '#', '\h'), '<', '\l'), ':', '\c'))
    + length(replace(replace(replace(text, '\', '\\'), '#', '\h'), '<', '\l')) as size from c
), g as (
  select *, sum(size) over (partition by conv_id, alone order by turn, role, text rows unbounded preceding) as upto,
    row_number() over (partition by conv_id, alone order by turn desc, role desc, text desc) as back from f
)
select conv_id, cast(count(*) as bigint) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(coalesce(sum(upto) filter (role = 'assistant' or back = 1), 0) as bigint) as formatted_chars
from g group by conv_id, alone""",
    "op9_line_dedup": r"""
with l as (
  select doc_id, text, string_split(text, chr(10)) as lines from documents
), w as (
  select doc_id, lines, unnest(lines) as line, generate_subscripts(lines, 1) as i from l
), c as (
  select *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as words from w
), d as (
  select *, sum(words) over (partition by doc_id order by i) as cum from c
), u as (
  select a.doc_id, a.i as s, min(b.i) as e, any_value(a.lines) as lines from d a join d b on a.doc_id = b.doc_id and b.i >= a.i and b.cum >= a.cum - a.words + 50 group by a.doc_id, a.i
  union
  select a.doc_id, max(b.i) as s, a.i as e, any_value(a.lines) as lines from d a join d b on a.doc_id = b.doc_id and b.i <= a.i and a.cum - b.cum + b.words >= 50 group by a.doc_id, a.i
), v as (
  select doc_id, s, e, row_number() over (partition by array_to_string(lines[s:e], chr(10)) order by doc_id, s) as nth from u
), x as (select distinct doc_id, unnest(range(s, e + 1)) as i from v where nth > 1
), y as (select doc_id, list(i) as gone from x group by doc_id)
select l.doc_id, cast(coalesce(len(lines), 0) as integer) as n_lines, cast(coalesce(len(gone), 0) as integer) as lines_removed,
  case when gone is null then sha256(text) else sha256(coalesce(array_to_string(list_transform(list_filter(range(1, len(lines) + 1), lambda i: not list_contains(gone, i)), lambda i: lines[i]), chr(10)), '')) end as text_sha256
from l left join y on l.doc_id = y.doc_id""",
}
