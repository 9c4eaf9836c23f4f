"""Record types.  A page's blocks are kept one row per block, keyed by (page_id, block_id); block_id is the place in the page and the last sort key everywhere."""

from __future__ import annotations

from pyspark.sql import types as T

POINT = "struct<x:double,y:double>"
BBOX = f"array<{POINT}>"

BLOCK = f"block_id long, type string, text string, confidence double, bbox {BBOX}, corrected boolean"
TABLE = "html string, cells array<string>, bbox array<int>, confidence double, engine string, color_map array<array<string>>"
REGION = "bbox array<int>, quality double, n_cols int"
ENHANCED = "html string, region struct<bbox:array<int>,quality:double,n_cols:int>, engine string, backend string, score_enhanced double, score_base double, verdict string"
REBUILD = "adopt boolean, hit double, fabricate double, struct double, n_ocr long, n_vlm long, reasons array<string>, markdown string, n_regions int"
LINK = "page_id long, n int, pos int, text string, target string, confidence double, match_type string"
TASK = "id long, file_path string, file_hash string, status string, attempts int, last_error string, created_at timestamp, updated_at timestamp"
TASK_EVENT = "seq long, task_id long, status string, error string, at timestamp"
PROGRESS_EVENT = "seq long, task_id long, file_path string, status string, error string, at timestamp"
NOTE = "page_id long, file_name string, markdown string"
ITEM = "snapshot string, image string, chars long, lines long, table_rows long, external_tables long, ocr_blocks long, confidence double, cached boolean, error string"
LOG = "timestamp string, level string, module string, message string, file string, exception string, extra map<string,string>"
RAW_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def _struct(ddl: str) -> str:
    return "struct<" + ", ".join(f.split(" ", 1)[0] + ":" + f.split(" ", 1)[1] for f in _fields(ddl)) + ">"


def _fields(ddl: str) -> list[str]:
    out, depth, held = [], 0, ""
    for c in ddl:
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            out.append(held.strip())
            held = ""
        else:
            held += c
    return [*out, held.strip()]


PAGE = f"page_id long, source_path string, confidence double, engine_used string, content_type string, blocks array<{_struct(BLOCK)}>, tables array<{_struct(TABLE)}>, enhanced_tables array<{_struct(ENHANCED)}>, region_rebuild {_struct(REBUILD)}"

CONTENT_TYPES = ("pure_text", "simple_table", "complex_table", "mixed", "math_special")


def of(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
