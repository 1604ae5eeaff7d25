"""Table layouts and the vocabulary of the trace model."""

from __future__ import annotations

SPEC, DESIGN, CODE, TEST, TASK = "spec", "design", "code", "test", "task"
SATISFIES, IMPLEMENTS, VERIFIES, DEPENDS, REFERENCES = "satisfies", "implements", "verifies", "depends", "references"
EXPLICIT, INFERRED, WEAK = "explicit", "inferred", "weak"
#: Relations that cover a spec, and those that a boundary restricts.
COVERING, BOUND = (IMPLEMENTS, SATISFIES, VERIFIES), (IMPLEMENTS, VERIFIES)

SOURCE_REF = "struct<file:string,line:int>"
EVIDENCE = "array<struct<kind:string,value:string,file:string,line:int>>"
FILES = "path string, name string, ext string, content binary, mtime long, ord long"
SPECS = (
    "ord long, file string, heading_depth int, heading_text string, auto_id string, title string, line int, parent_chain array<string>,"
    " body_text string, body_hash string, body_hash_content string, body_line_count int, body_preview string"
)
FUNCTIONS = "array<struct<name:string,kind:string,line:int,body_hash:string,body_lines:int,body_preview:string>>"
CODES = (
    "ord long, file string, module string, symbols array<string>, is_test boolean, language string, imports array<string>,"
    f" line_count int, functions {FUNCTIONS}, file_hash string"
)
TAGS = "file string, kind string, value string, line int, ord int"
NODES = (
    "id string, type string, title string, file string, line int, framework_origin string, confidence double, heading_text string,"
    " imports array<string>, boundaries array<struct<path:string,file:string,line:int>>, aliases array<string>, metadata string, ord long"
)
EDGES = f"src_id string, dst_id string, relation string, strength string, evidence {EVIDENCE}, ord long"
CALLS = "caller string, callee string"
SNAPSHOT = (
    "timestamp string, reason string,"
    " specs array<struct<id:string,file:string,title:string,heading_text:string,depth:int,line:int,body_hash:string,body_hash_content:string,body_line_count:int,body_preview:string>>,"
    " code array<struct<file:string,module:string,symbols:array<string>,is_test:boolean,language:string,imports:array<string>,file_hash:string,"
    "functions:array<struct<name:string,kind:string,line:int,body_hash:string,body_lines:int>>>>,"
    " orphan_spec_ids array<string>,"
    " coverage struct<total:int,covered:int,orphan:int,coverage_pct:double,spec_count:int,code_count:int>"
)
