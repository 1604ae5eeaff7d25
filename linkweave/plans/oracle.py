"""The queries' results as SQL for DuckDB, written against the views alone."""

from __future__ import annotations

from ..functions.text import LANGUAGES, STOP_WORDS
from ..operators.parse import CLASS_LIKE, DEFINERS, KEYWORDS, LIBRARY, MODIFIERS
from .views import with_views

COVER = "relation in ('implements', 'satisfies', 'verifies')"


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _tokens(x: str) -> str:
    split = f"replace(regexp_replace({x}, '([a-z])([A-Z])', '\\1 \\2', 'g'), '_', ' ')"
    return f"list_filter(list_distinct(regexp_extract_all(lower({split}), '[a-zA-Z_][a-zA-Z0-9_]{{2,}}')), lambda t: not list_contains({_list(STOP_WORDS)}, t))"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _preview(x: str) -> str:
    return f"replace(substring({_strip(x)}, 1, 80), chr(10), ' ')"


def _hash(x: str) -> str:
    return f"substring(sha256({x}), 1, 16)"


def _top(x: str) -> str:
    return f"case when contains({x}, '/') then split_part({x}, '/', 1) else '' end"


def _name(x: str) -> str:
    return f"regexp_replace({x}, '^.*/', '')"


def _stem(x: str) -> str:
    return f"regexp_replace({_name(x)}, '\\.[^.]*$', '')"


def _round(x: str, places: int) -> str:
    """Rounding of the shortest decimal that names the double, half up."""
    return f"cast(round(cast(cast({x} as varchar) as decimal(38, 20)), {places}) as double)"


DEF = rf"^\s*(?:\s*(?:{'|'.join(MODIFIERS)})\s+)*(?:{'|'.join(DEFINERS)})\s+([A-Za-z_]\w*).*?(?:=>|: |[(:={{])"
_COVERED = with_views("nodes", "edges") + f""", hits as (select dst_id, count(*) as refs, count(*) filter (relation = 'verifies') as verified from edges where {COVER} group by dst_id),
s as (select n.*, coalesce(refs, 0) as refs, coalesce(verified, 0) as verified from nodes n left join hits on id = dst_id where type = 'spec') """
_PCT = "case when count(*) = 0 then 0.0 else round(100.0::double * count(*) filter (refs > 0) / count(*), 1) end"
_SUMMARY = f"count(*) as total, count(*) filter (refs > 0) as covered, count(*) - count(*) filter (refs > 0) as orphan, {_PCT} as coverage_pct"

_SIM = with_views("specs", "codes") + f""", s as (select *, {_tokens("text")} as tokens from specs),
c as (select *, {_tokens("concat_ws(' ', file, text)")} as tokens, {_tokens("stem")} as stem_tokens from codes),
p as (select spec_id, code_id, {_top("s.file")} as sdir, {_top("c.file")} as cdir, lower(s.stem) as ss, lower(c.stem) as cs, len(s.tokens) as n_spec, len(c.tokens) as n_code, len(c.stem_tokens) as n_stems,
  list_intersect(s.tokens, c.tokens) as both_text, len(list_intersect(s.tokens, c.stem_tokens)) as n_stem, is_test from s, c),
q as (select *, len(both_text) as n_symbol,
  case when sdir = cdir and sdir <> '' then 1.0::double when sdir <> '' and cdir <> '' and (contains(sdir, cdir) or contains(cdir, sdir)) then 0.6::double else 0.0::double end as s_dir,
  case when ss = cs then 1.0::double when contains(ss, cs) or contains(cs, ss) then 0.5::double else 0.0::double end as s_file from p),
r as (select *, case when n_symbol = 0 then 0.0::double when n_symbol = n_spec then least(greatest(3.0::double * (n_symbol::double / (n_spec + n_code - n_symbol)), 0.85::double), 1.0::double) else least(3.0::double * (n_symbol::double / (n_spec + n_code - n_symbol)), 1.0::double) end as s_symbol,
  case when n_stem = 0 then 0.0::double else least(3.0::double * (n_stem::double / (n_spec + n_stems - n_stem)), 1.0::double) end as s_keyword from q),
sc as (select *, {_round("least((0.6::double * s_dir + 0.4::double * s_file + 0.3::double * s_symbol + 0.2::double * s_keyword) / 1.5::double, 1.0::double)", 4)} as confidence from r),
cand as (select * from sc where n_symbol > 0 or n_stem > 0 or s_dir > 0) """

_CHANGES = """ch as (select coalesce(b.id, a.id) as id, case when a.id is null then 'removed' when b.id is null then 'added' when b.title <> a.title then 'changed' when b.body_hash <> a.body_hash then 'body_changed' end as change,
  b.title as old_title, a.title as new_title, b.body_hash as old_hash, a.body_hash as new_hash from before b full outer join after a on a.id = b.id)"""
_RENAMES = """gone as (select * from before where id not in (select id from after)), new as (select * from after where id not in (select id from before)),
lastgone as (select body_hash_content, arg_max(id, ord) as old_id from gone where body_hash_content <> '' group by body_hash_content)"""

_LINES = ", lines as (select path, ord, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from {0})"
_SECTIONS = with_views("markdown") + _LINES.format("markdown") + f""",
marked as (select *, regexp_extract(line, '^(#{{1,6}})\\s+(.+)$', 1) as mark, {_strip("regexp_extract(line, '^(#{1,6})\\s+(.+)$', 2)")} as heading from lines),
numbered as (select *, sum(case when mark <> '' then 1 else 0 end) over (partition by path order by pos) as sec from marked),
sections as (select path, min(pos) + 1 as line, len(arg_min(mark, pos)) as depth, arg_min(heading, pos) as heading, string_agg(line, chr(10) order by pos) as body from numbered where sec > 0 group by path, sec) """


def _counters(rows: str) -> str:
    """CTEs that number (path, line, depth, heading) rows: for each, its counters and chain, by looking back."""
    cols, chain = [], []
    for k in range(1, 7):
        base = f"coalesce((select max(b.line) from {rows} b where b.path = a.path and b.line <= a.line and b.depth < {k}), 0)"
        cols.append(f"case when a.depth >= {k} then (select nullif(count(*), 0) from {rows} b where b.path = a.path and b.line <= a.line and b.line >= {base} and b.depth = {k}) end")
        chain.append(f"case when a.depth > {k} then (select arg_max(b.heading, b.line) from {rows} b where b.path = a.path and b.line <= a.line and b.line >= {base} and b.depth = {k}) end")
    return f"select a.*, array_to_string(list_filter([{', '.join(cols)}], lambda x: x is not null), '.') as number, array_to_string(list_filter([{', '.join(chain)}], lambda x: x is not null), ' > ') as chain from {rows} a"


def _window_counters(rows: str) -> str:
    inner = ", ".join(f"coalesce(max(case when depth < {k} then line end) over w, 0) as b{k}" for k in range(1, 7))
    counts = ", ".join(f"sum(case when depth = {k} then 1 else 0 end) over (partition by path, b{k} order by line) as c{k}, last_value(case when depth = {k} then heading end ignore nulls) over (partition by path, b{k} order by line) as t{k}" for k in range(1, 7))
    number = ", ".join(f"case when depth >= {k} and c{k} > 0 then c{k}::varchar end" for k in range(1, 7))
    chain = ", ".join(f"case when depth > {k} then t{k} end" for k in range(1, 7))
    return f"""select *, array_to_string(list_filter([{number}], lambda x: x is not null), '.') as number, array_to_string(list_filter([{chain}], lambda x: x is not null), ' > ') as chain
from (select *, {counts} from (select *, {inner} from {rows} window w as (partition by path order by line)))"""


_CLEAN = f"case when regexp_matches(heading, '^[\\d.]+[.\\s]\\s*(.*)$') and {_strip("regexp_extract(heading, '^[\\d.]+[.\\s]\\s*(.*)$', 1)")} <> '' then {_strip("regexp_extract(heading, '^[\\d.]+[.\\s]\\s*(.*)$', 1)")} else heading end"


def _blocks(source: str, out: str) -> str:
    kinds = " or ".join(f"starts_with(ltrim(head), '{c}')" for c in CLASS_LIKE)
    return f"""{out}_l as (select path, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from {source}),
{out}_m as (select *, regexp_extract(line, '{DEF}', 1) as name from {out}_l),
{out}_n as (select *, sum(case when name <> '' then 1 else 0 end) over (partition by path order by pos) as block from {out}_m),
{out}_g as (select path, min(pos) as line, arg_min(name, pos) as name, arg_min(line, pos) as head, string_agg(line, chr(10) order by pos) as body from {out}_n where block > 0 group by path, block),
{out} as (select path, line, name, body, case when {kinds} then 'class' else 'function' end as kind from {out}_g)"""


_SYM = f"list_sort(list_distinct(regexp_extract_all(text, '(?m){DEF}', 1)))"
_IMP = "list_transform(regexp_extract_all(text, '(?m)^(?:import\\s+[\\w.]+|from\\s+[\\w.]+\\s+import)'), lambda m: regexp_extract(m, '^(?:import|from)\\s+([\\w.]+)', 1))[1:8]"
_CALLS = f"list_filter(list_distinct(regexp_extract_all(text, '(?:^|[\\s.,;:!?&|~={{(])([A-Za-z_]\\w*)\\s*\\(', 1)), lambda x: not list_contains({_list(KEYWORDS)}, x) and not (len(x) > 1 and regexp_matches(x, '^[A-Z]')))"
_VERSIONS = with_views("sources") + f""", olds as (select path, ord, text from sources),
news as (select case when ord % 17 = 0 then 'src/moved/' || ord || '.py' else path end as path, ord, case when ord % 11 = 0 then text || chr(10) || 'def added(q): return q' when ord % 13 = 0 then replace(text, 'len(x)', 'sum(x)') else text end as text from sources),
o as (select path, {_SYM} as sy, {_hash("text")} as h from olds), w as (select path, {_SYM} as sy, {_hash("text")} as h from news),
cc as (select coalesce(o.path, w.path) as file, case when w.path is null then 'removed' when o.path is null then 'added' when o.sy <> w.sy or o.h <> w.h then 'symbols_changed' end as change,
  case when o.path is not null and w.path is not null then array_to_string(list_sort(list_filter(w.sy, lambda x: not list_contains(o.sy, x))), ',') else '' end as added,
  case when o.path is not null and w.path is not null then array_to_string(list_sort(list_filter(o.sy, lambda x: not list_contains(w.sy, x))), ',') else '' end as removed,
  coalesce(o.h <> w.h, false) as file_hash_changed from o full outer join w on o.path = w.path),
{_blocks("olds", "ob")}, {_blocks("news", "nb")} """

_IMPORTS = with_views("sources") + f""", f as (select path as file, ord, unnest({_IMP}) as import from sources),
ff as (select distinct file, import from f where regexp_matches(import, '[^.]')),
t as (select file, import, replace(import, '.', '/') as sl, case when contains(file, '/') then regexp_replace(file, '/[^/]*$', '') || '/' else '' end as dir from ff),
g as (select file, import, unnest([case when starts_with(import, 'src') then sl || '.py' end, case when starts_with(import, 'src') then sl || '/__init__.py' end, 'src/' || sl || '.py', 'src/' || sl || '/__init__.py',
  case when starts_with(import, 'lib') then sl || '.py' end, case when starts_with(import, 'lib') then sl || '/__init__.py' end, 'lib/' || sl || '.py', 'lib/' || sl || '/__init__.py',
  case when starts_with(import, 'app') then sl || '.py' end, case when starts_with(import, 'app') then sl || '/__init__.py' end, 'app/' || sl || '.py', 'app/' || sl || '/__init__.py',
  dir || sl || '.py', dir || sl || '.ts', dir || sl || '.js', dir || sl || '.go', dir || sl || '.rs', dir || sl || '.java']) as target, unnest(range(18)) as place from t),
h as (select file, import, target, place, 0 as apart, 0 as ord from g where target in (select path from sources)
  union all select t.file, t.import, s.path, 18, case when regexp_replace(t.file, '/[^/]*$', '') = regexp_replace(s.path, '/[^/]*$', '') then 0 else 1 end, s.ord from t join sources s on {_stem("s.path")} = regexp_replace(t.import, '^.*\\.', '')),
res as (select file, import, target from (select *, row_number() over (partition by file, import order by place, apart, ord) as n from h) where n = 1 and file <> target) """

_CALLED = with_views("sources") + f""", {_blocks("sources", "fb")},
called as (select distinct path as file, unnest({_CALLS}) as name from sources), wants as (select * from called where not list_contains({_list([*LIBRARY, "__init__"])}, name)),
defs as (select fb.path as file, name, min(s.ord * 100 + fb.line) as ord from fb join sources s on s.path = fb.path group by fb.path, name),
cand as (select w.file, w.name, d.file || '::' || d.name as callee, case when d.file = w.file then 0 when regexp_replace(d.file, '/[^/]*$', '') = regexp_replace(w.file, '/[^/]*$', '') then 1 else 2 end as far, d.ord from wants w join defs d on d.name = w.name),
res as (select file, name, callee from (select *, row_number() over (partition by file, name order by far, ord) as n from cand) where n = 1) """

_REACH = with_views("calls") + """, walk(key, depth) as (select caller, 0 from calls where caller in (select cast(p_partkey as varchar) from part where lower(p_type) = 'promo') union select callee, depth + 1 from walk join calls on caller = key where depth < 3),
seen as (select key, min(depth) as depth from walk group by key) """

ALIASES = with_views("spec_ids", "spec_edges") + """, h as (select id, ord, regexp_extract(id, '\\.(\\d[\\d.]*)$', 1) as hnum from spec_ids where not starts_with(id, 'spec::')),
tg as (select id as alias_id, id[7:] as num from spec_ids where starts_with(id, 'spec::')),
ex as (select alias_id, arg_min(h.id, h.ord) as id from tg join h on hnum = num group by alias_id),
firsts as (select hnum, arg_min(id, ord) as id, min(ord) as ord from h where hnum <> '' group by hnum),
lo as (select alias_id, arg_min(f.id, f.ord) as id from tg join firsts f on contains(f.hnum, num) or contains(num, f.hnum) where alias_id not in (select alias_id from ex) group by alias_id),
al as (select distinct alias_id, id from (select * from ex union all select * from lo)) """

_LANG = "case " + " ".join(f"when e = '{e}' then '{n}'" for e, (n, _) in LANGUAGES.items()) + " end"

SQL: dict[str, str] = {
    "coverage_summary": _COVERED + f"select {_SUMMARY} from s",
    "coverage_gate": _COVERED + f"select *, coverage_pct >= 60 as passed, 60.0::double as min_pct, 'coverage ' || case when coverage_pct >= 60 then 'passed' else 'failed' end || ': ' || covered || '/' || total as message from (select {_SUMMARY} from s)",
    "coverage_by_segment": _COVERED + f"select segment, {_SUMMARY} from s group by segment",
    "orphan_specs": _COVERED + "select id, title, file from s where refs = 0",
    "orphan_code": with_views("nodes", "edges") + f"select id, type, file from nodes where type in ('code', 'test') and id not in (select dst_id from edges where {COVER}) and id not in (select src_id from edges)",
    "refs_per_spec": _COVERED + "select id, refs, verified from s",
    "spec_status_tristate": _COVERED + "select id, case when verified > 0 then 'covered' when refs > 0 then 'partial' else 'orphan' end as status from s",
    "node_type_counts": with_views("nodes") + "select type, count(*) as n from nodes group by type",
    "origin_histogram": with_views("nodes", "edges") + f"select framework_origin, count(*) as n_nodes, count(*) filter (type = 'spec') as n_specs, count(*) filter (type = 'spec' and id not in (select dst_id from edges where {COVER})) as n_orphans from nodes group by framework_origin",
    "coverage_delta": with_views("nodes", "edges") + f""", x as (select id, exists(select 1 from edges where dst_id = id and {COVER} and strength = 'explicit') as a, exists(select 1 from edges where dst_id = id and {COVER}) as b from nodes where type = 'spec'),
y as (select round(100.0::double * count(*) filter (a) / count(*), 1) as before, round(100.0::double * count(*) filter (b) / count(*), 1) as after from x) select before, after, round(after - before, 1) as delta from y""",
    "edge_dedup_first": with_views("edges_raw") + "select src_id, dst_id, relation, strength, ord from (select *, row_number() over (partition by src_id, dst_id, relation order by ord) as n from edges_raw) where n = 1",
    "node_last_wins": with_views("nodes_twice") + "select id, title, confidence, first as ord from (select *, row_number() over (partition by id order by ord desc) as n, min(ord) over (partition by id) as first from nodes_twice) where n = 1",
    "merge_union": with_views("nodes", "edges", "nodes_again") + """, m as (select id, title, confidence, 0 as g, ord from nodes union all select id, title, confidence, 1, ord from nodes_again),
l as (select id, title, confidence from (select *, row_number() over (partition by id order by g desc, ord desc) as n from m) where n = 1), e as (select * from edges union all select * from edges where relation = 'verifies')
select id, title, confidence, 1::bigint as n_nodes, null::bigint as n_edges from l union all select src_id, null, null, null, count(*) from e group by src_id""",
    "id_normalize": ALIASES + "select * from al",
    "normalized_nodes": ALIASES + """, fo as (select al.id, count(*) as n, max(s.confidence) as best, arg_min(s.title, s.ord) as spare from al join spec_ids s on s.id = al.alias_id group by al.id)
select s.id, case when s.title = '' then coalesce(spare, '') else s.title end as title, greatest(s.confidence, coalesce(best, 0)) as confidence, coalesce(n, 0) as n_aliases from spec_ids s left join fo on fo.id = s.id where s.id not in (select alias_id from al)""",
    "edge_redirect": ALIASES + "select coalesce(a.id, src_id) as src_id, coalesce(b.id, dst_id) as dst_id, relation from spec_edges left join al a on a.alias_id = src_id left join al b on b.alias_id = dst_id",
    "edges_to_spec": with_views("edges") + "select src_id, dst_id, relation, strength from edges where dst_id = 'spec:17' union all select src_id, dst_id, relation, strength from edges where src_id = 'part:9'",
    "find_spec_tiered": with_views("nodes") + """, qs as (select unnest(['spec:12', 'part:5', '00000042', 'building 3', 'nothing at all']) as query),
hit as (select query, id, case when id = query then 1 when id = 'spec::' || query then 2 when type = 'spec' and ends_with(id, '.' || query) then 3 when type = 'spec' and contains(lower(title), lower(query)) then 4 when type = 'spec' and contains(lower(heading_text), lower(query)) then 5 end as tier from qs, nodes)
select query, id, tier::bigint as tier from hit h where tier = (select min(tier) from hit i where i.query = h.query)""",
    "forward_impact": with_views("nodes", "edges") + "select s.id as spec_id, e.src_id, n.file, e.relation, e.strength from nodes s join edges e on e.dst_id = s.id left join nodes n on n.id = e.src_id where s.type = 'spec' and contains(s.title, '00001')",
    "reverse_impact": with_views("nodes", "edges") + f"select e.dst_id as spec_id, t.title, count(*) as n_edges, array_to_string(list_sort(list_distinct(list(n.file))), ',') as files from edges e join nodes n on n.id = e.src_id left join nodes t on t.id = e.dst_id where {COVER} and n.type not in ('spec', 'task') and contains(n.file, 'ring_') group by e.dst_id, t.title",
    "git_drift": with_views("nodes", "edges") + f"select n.file, e.dst_id as spec_id, e.relation from nodes n join edges e on e.src_id = n.id where n.type in ('code', 'test') and {COVER} and n.file in (select file from nodes where contains(file, 'promo'))",
    "drawing_rows": with_views("nodes") + "select id, type, case when length(l) > 60 then substring(l, 1, 57) || '...' else l end as label from (select id, type, title || ' in ' || file || ' and more of it' as l from nodes)",
    "boundary_violations": with_views("nodes", "edges") + """, b as (select id, segment from nodes where segment in ('BUILDING', 'MACHINERY'))
select b.id as spec_id, e.src_id, n.file as code_file from b join edges e on e.dst_id = b.id and e.relation in ('implements', 'verifies') join nodes n on n.id = e.src_id
where case when b.segment = 'BUILDING' then not (n.file glob 'src/promo/*' or regexp_matches(n.file, '^src/[sm].*$')) else not starts_with(n.file, 'src/large/') end""",
    "boundary_last_spec": """with o as (select 'c' || conv_id as file, role, text as value, turn::integer as line from conversations)
select 'spec::' || l.spec as spec_id, o.value as path, o.file, o.line from o join (select file, arg_max(value, line) as spec from o where role = 'user' group by file) l on l.file = o.file where o.role <> 'user'""",
    "boundary_preceding_spec": """with o as (select 'c' || conv_id as file, role, text as value, turn::integer as line from conversations)
select 'spec::' || (select arg_max(p.value, p.line) from o p where p.file = o.file and p.role = 'user' and p.line < o.line) as spec_id, value as path, file, line from o where role <> 'user' and exists(select 1 from o p where p.file = o.file and p.role = 'user' and p.line < o.line)""",
    "tokenizer": f"select doc_id, len(t)::bigint as n, sha256(array_to_string(list_sort(t), ' ')) as tokens_sha256 from (select doc_id, {_tokens('text')} as t from documents)",
    "token_index_candidates": _SIM + "select spec_id, code_id, n_symbol, n_stem from sc where n_symbol > 0 or n_stem > 0",
    "evidence_tokens": _SIM + "select spec_id, code_id, array_to_string(list_sort(both_text)[1:5], ', ') as symbol_tokens from sc where n_symbol > 0 or n_stem > 0",
    "same_dir_candidates": _SIM + "select spec_id, code_id from sc where s_dir = 1.0",
    "partial_dir_candidates": _SIM + "select spec_id, code_id from sc where s_dir = 0.6",
    "edge_score": _SIM + "select spec_id, code_id, s_dir, s_file, confidence from cand",
    "edge_strength": _SIM + "select case when is_test then 'verifies' else 'implements' end as relation, case when confidence < 0.4 then 'weak' else 'inferred' end as strength, count(*) as n, min(confidence) as low, max(confidence) as high from cand where confidence >= 0.15 group by 1, 2",
    "func_score": with_views("specs", "codes") + f""", s as (select spec_id, {_tokens("text")} as a from specs), f as (select code_id as func_id, {_tokens("concat_ws(' ', file, text)")} as b from codes),
p as (select spec_id, func_id, len(list_intersect(a, b)) as n, len(a) as x, len(b) as y from s, f)
select spec_id, func_id, confidence from (select *, {_round("least(case when n = x or n = y then greatest(3.0::double * (n::double / (x + y - n)), 0.9::double) else 3.0::double * (n::double / (x + y - n)) end, 1.0::double)", 4)} as confidence from p where n > 0) where confidence >= 0.15""",
    "suggest_topk": _SIM + f"select spec_id, code_id, {_round('confidence', 3)} as score, rank from (select *, row_number() over (partition by spec_id order by confidence desc, code_id) as rank from sc where confidence >= 0.1) where rank <= 3",
    "spec_drift_full": with_views("before", "after") + ", " + _CHANGES + " select * from ch where change is not null",
    "drift_removed": with_views("before", "after") + "select id, title from before where id not in (select id from after)",
    "drift_added": with_views("before", "after") + ", " + _RENAMES + " select id, title from new where body_hash_content not in (select body_hash_content from lastgone)",
    "drift_renamed": with_views("before", "after") + ", " + _RENAMES + " select old_id, new.id as new_id, body_hash_content from new join lastgone using (body_hash_content)",
    "drift_body_changed": with_views("before", "after") + ", " + _CHANGES + " select id, old_hash, new_hash from ch where change = 'body_changed'",
    "code_symbol_diff": _VERSIONS + "select * from cc where change is not null",
    "func_drift_by_line": _VERSIONS + f"select o.path as file, o.name, o.line, {_hash('o.body')} as old_hash, {_hash('n.body')} as new_hash, n.kind from ob o join nb n on o.path = n.path and o.name = n.name and o.line = n.line where o.body <> n.body",
    "func_drift_by_name": _VERSIONS + f"select file, name, line, {_hash('a')} as old_hash, {_hash('body')} as new_hash from (select path as file, name, arg_max(body, line) as a from ob group by path, name) x join (select path as file, name, line, body from nb) y using (file, name) where a <> body",
    "snapshot_diff_full": _VERSIONS + ", before as (" + with_views("before", "after", "nodes", "edges").split("before as (", 1)[1].rstrip() + ", " + _CHANGES + ", " + _RENAMES + f""", x as (select id, exists(select 1 from edges where dst_id = id and {COVER} and strength = 'explicit') as was, exists(select 1 from edges where dst_id = id and {COVER} and strength = 'inferred') as now from nodes where type = 'spec')
select 'specs_added' as category, count(*) as n from new where body_hash_content not in (select body_hash_content from lastgone)
union all select 'specs_removed', count(*) from gone union all select 'specs_changed', count(*) from ch where change = 'changed' union all select 'specs_renamed', count(*) from new join lastgone using (body_hash_content)
union all select 'code_added', count(*) from cc where change = 'added' union all select 'code_removed', count(*) from cc where change = 'removed'
union all select 'funcs_changed', count(*) from (select path, name, arg_max(body, line) as a from ob group by path, name) o join nb n on n.path = o.path and n.name = o.name and n.body <> o.a
union all select 'orphans_before', count(*) from x where not was union all select 'orphans_after', count(*) from x where not now
union all select 'new_orphans', count(*) from x where was and not now union all select 'resolved_orphans', count(*) from x where now and not was""",
    "orphan_difference": with_views("nodes", "edges") + f""", x as (select id, title, exists(select 1 from edges where dst_id = id and {COVER} and strength = 'explicit') as was, exists(select 1 from edges where dst_id = id and {COVER} and strength = 'inferred') as now from nodes where type = 'spec'),
a as (select id from x where not was), b as (select case when ends_with(title, '7') then id || ' new' else id end as id from x where not now)
select id, 'new_orphan' as change from b where id not in (select id from a) union all select id, 'resolved' from a where id not in (select id from b)""",
    "snapshot_diff_counts": _VERSIONS + ", before as (" + with_views("before", "after").split("before as (", 1)[1].rstrip() + ", " + _CHANGES + " select change as category, count(*) as n from (select change from ch union all select change from cc) where change is not null group by change",
    "orphan_transitions": with_views("nodes", "edges") + f""", x as (select id, exists(select 1 from edges where dst_id = id and {COVER} and strength = 'explicit') as was, exists(select 1 from edges where dst_id = id and {COVER} and strength = 'inferred') as now from nodes where type = 'spec')
select id, case when was then 'new_orphan' else 'resolved' end as change from x where was <> now""",
    "section_split": _SECTIONS + "select path, line, depth, heading, body from sections",
    "spec_candidates": _SECTIONS + f""", numd as ({_window_counters("sections")}) select path as file, line, 'docs.' || regexp_replace(regexp_replace(path, '^docs/', ''), '\\.md$', '') || '.' || number as auto_id, {_CLEAN} as title, depth as heading_depth, chain,
{_hash("body")} as body_hash, {_hash("case when contains(body, chr(10)) then substring(body, instr(body, chr(10)) + 1) else '' end")} as body_hash_content, (length(body) - length(replace(body, chr(10), '')))::bigint as body_line_count, {_preview("body")} as body_preview from numd""",
    "hierarchical_id": with_views("outline") + f", numd as ({_counters('outline')}) select path, line, number from numd",
    "parent_chain": with_views("outline") + f", numd as ({_counters('outline')}) select path, line, chain from numd",
    "title_clean": _SECTIONS + f"select path, line, {_CLEAN} as title from sections",
    "text_preview": f"select doc_id, {_preview('text')} as preview, {_hash('text')} as hash, {_hash("case when contains(text, chr(10)) then substring(text, instr(text, chr(10)) + 1) else '' end")} as content_hash, (length(text) - length(replace(text, chr(10), '')))::bigint as breaks from documents",
    "symbols": with_views("sources") + f"select path, array_to_string({_SYM}, ',') as symbols from sources",
    "func_blocks": with_views("sources") + f", {_blocks('sources', 'fb')} select path, name, kind, line, {_hash('body')} as hash, {_preview('body')} as preview from fb",
    "imports_list": with_views("sources") + f"select path, array_to_string({_IMP}, ',') as imports from sources",
    "path_facts": with_views("nodes") + f", x as (select id, file, regexp_extract({_name('file')}, '.(\\.[^.]+)$', 1) as e, {_stem('file')} as stem from nodes) select id, contains(lower(stem), 'test_') or contains(lower(stem), '_test') as is_test, {_LANG} as language, regexp_extract(file, '([^/]*)/[^/]*$', 1) as module, stem, {_top('file')} as top from x",
    "call_sites": with_views("sources") + f"select path, array_to_string(list_sort({_CALLS}), ',') as calls from sources",
    "html_tag_extract": with_views("pages_text") + """, k as (select path, kind, regexp_extract_all(text, '<!--\\s*@' || kind || '\\s+(.+?)\\s*-->', 1) as v from pages_text, (select unnest(['spec', 'design', 'satisfies']) as kind))
select path, kind, (unnest(range(len(v))))::bigint as n, trim(unnest(v)) as value from k""",
    "python_comment_tags": with_views("sources") + "select path as file, 'impl' as kind, regexp_extract(text, '^# @impl (.*)', 1) as value, 1::bigint as line from sources",
    "ast_blocks": with_views("sources") + f", {_blocks('sources', 'fb')} select path, name, case when kind = 'class' then 'class' else 'function' end as kind, line from fb",
    "tag_split": with_views("markdown") + ", k as (select path, unnest(regexp_extract_all(text, '<!--\\s*@satisfies\\s+(.+?)\\s*-->', 1)) as v from markdown) select path, trim(unnest(string_split(v, ','))) as spec from k",
    "yaml_hierarchy": with_views("yaml_items") + """, walk(id, title, depth, chain) as (
  select id, title, 1, case when parent = '' then '' else parent end from yaml_items where parent = '' or parent not in (select id from yaml_items)
  union all select y.id, y.title, w.depth + 1, case when w.chain = '' then w.title else w.chain || ' > ' || w.title end from yaml_items y join walk w on y.parent = w.id)
select id, depth::bigint as depth, chain from walk union all select id, 1, parent from yaml_items where id not in (select id from walk)""",
    "import_resolution": _IMPORTS + "select * from res",
    "import_edges": _IMPORTS + "select distinct file as src_id, target as dst_id, 'depends' as relation, 'inferred' as strength from res where not contains(file, 'promo')",
    "callee_resolution": _CALLED + "select * from res",
    "call_edges": _CALLED + "select distinct fb.path || '::' || fb.name as caller, callee from fb join res on res.file = fb.path",
    "callees_callers": with_views("calls") + "select key, sum(d)::bigint as n_callees, sum(u)::bigint as n_callers from (select caller as key, 1 as d, 0 as u from calls union all select callee, 0, 1 from calls) group by key",
    "bfs_depth": _REACH + "select key, depth::bigint as depth from seen",
    "transitive_impact": _REACH + "select 'f' || (key::bigint % 20) as file, case when depth = 0 then 'direct' else 'transitive' end as kind, min(depth)::bigint as depth from seen group by 1, 2",
    "traversed_calls": _REACH.replace("depth < 3", "depth < 2") + "select caller, callee from calls join seen a on a.key = caller left join seen b on b.key = callee where b.depth is null or b.depth > a.depth",
    "direct_neighbours": with_views("calls") + "select distinct 'callee' as direction, callee as key from calls where caller = '17' union all select distinct 'caller', caller from calls where callee = '17'",
    "impact_seeds": with_views("nodes", "edges") + "select distinct f.file || '::' || k.k as key from edges e join nodes n on n.id = e.src_id join nodes f on f.file = n.file and f.type = 'code', (select unnest(['a', 'b', 'c']) as k) k where e.dst_id = 'spec:17' and n.file <> '' and not contains(e.src_id, '::')",
    "symbol_resolution": with_views("calls") + """, k as (select distinct caller as s from calls) select distinct 'f' || (c.caller::bigint % 20) || '::' || c.caller as caller, 'f' || (c.callee::bigint % 20) || '::' || c.callee as callee from calls c join k on k.s = c.callee where c.callee::bigint <= c.caller::bigint""",
    "cache_filter": with_views("files_now", "files_then") + "select n.path, case when t.path is null then 'new' when t.mtime = n.mtime then 'unchanged' when t.hash = n.hash then 'touched' else 'changed' end as state from files_now n left join files_then t on t.path = n.path",
    "graph_json_rows": with_views("edges") + "select src_id, dst_id, case (ord % 6)::integer when 1 then 'depends' when 3 then 'depends' when 4 then 'implements' else 'references' end as relation, case when ord % 4 = 0 then 'explicit' else 'inferred' end as strength from edges",
    "watch_throttle": """with recursive f as (select user_id, min(ts) as ts from events group by user_id union all select f.user_id, (select min(e.ts) from events e where e.user_id = f.user_id and e.ts >= f.ts + interval 10 hour) from f where f.ts is not null)
select min(e.event_id) as event_id, f.user_id from f join events e on e.user_id = f.user_id and e.ts = f.ts group by f.user_id, f.ts""",
}
