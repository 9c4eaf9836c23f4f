"""Recognisers and language models as pluggable functions inside mapInPandas; none is bundled.

A recogniser is a picklable factory () -> function; it is called once a Python
worker, lazily.  A failure keeps the row and says so in a status column.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import text as X
from pagemill.operators.geometry import DEFAULT_ENGINE, ENGINES

Recognizer = Callable[[bytes], list[dict]]

#: A backend gets (crop, region, blocks of the region, offset) and returns table HTML or None.
Backend = Callable[[object, dict, list[dict], tuple[int, int]], str | None]
BACKENDS = ("ppstructure", "gridboost", "ppstructurev3", "vision", "manual")

# Requests for text correction.
PROMPT_TABLE = "Correct any OCR errors in this table cell text. \nPreserve numbers exactly. Fix only obvious character recognition errors.\nText: {}\nCorrected:"
PROMPT_TEXT = "Correct any OCR errors in this text. \nFix common confusions like 0/O, 1/l, 5/S. Preserve proper nouns and technical terms.\nText: {}\nCorrected:"


@dataclass(frozen=True)
class FakeRecognizer:
    """Reads text lines of UTF-8 bytes as blocks, one under the other: for tests and dry runs."""

    confidence: float = 0.9

    def __call__(self) -> Recognizer:
        def read(content: bytes) -> list[dict]:
            out = []
            for k, line in enumerate(content.decode("utf-8", "replace").splitlines()):
                box = [{"x": 0.0, "y": 20.0 * k}, {"x": 8.0 * len(line), "y": 20.0 * k}, {"x": 8.0 * len(line), "y": 20.0 * k + 16}, {"x": 0.0, "y": 20.0 * k + 16}]
                out.append({"block_id": k, "type": "text", "text": line, "confidence": self.confidence, "bbox": box})
            return out

        return read


#: To be named in settings for dry runs: pagemill.operators.recognize:line_reader.
line_reader = FakeRecognizer()


def identity_model() -> Callable[[list[str]], list[str]]:
    return lambda prompts: [p.rsplit("Text: ", 1)[-1].removesuffix("\nCorrected:") for p in prompts]


RECOGNIZED = "path string, blocks array<struct<block_id:long,type:string,text:string,confidence:double,bbox:array<struct<x:double,y:double>>>>, confidence double, engine_used string, error string"


def recognize(files: DataFrame, engines: dict[str, Callable[[], Recognizer]], engine: str = "engine") -> DataFrame:
    """RECOGNIZED of files (path, content, engine): one fall-back to the default engine on failure; confidence is the blocks' mean, 0 without any."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made: dict[str, Recognizer] = {}

        def read(name: str, content: bytes) -> list[dict]:
            if name not in made:
                made[name] = engines.get(name, engines[DEFAULT_ENGINE])()
            return made[name](content)

        for b in batches:
            rows = []
            for path, content, name in zip(b["path"], b["content"], b["engine"], strict=True):
                blocks, used, error = [], None, None
                for used in dict.fromkeys([name, DEFAULT_ENGINE]):
                    try:
                        blocks, error = read(used, content), None
                        break
                    except Exception as e:  # noqa: BLE001 a model may fail in any way
                        error = f"{type(e).__name__}: {e}"
                scores = [x["confidence"] for x in blocks]
                rows.append((path, blocks, sum(scores) / len(scores) if scores else 0.0, used, error))
            yield pd.DataFrame(rows, columns=["path", "blocks", "confidence", "engine_used", "error"])

    return files.select("path", "content", F.coalesce(F.col(engine), F.lit(DEFAULT_ENGINE)).alias("engine")).mapInPandas(run, RECOGNIZED)


def correction_prompt(text, content_type):
    kind = F.coalesce(content_type, F.lit(""))
    a, b = PROMPT_TABLE.split("{}"), PROMPT_TEXT.split("{}")
    return F.when(kind.contains("table"), F.concat(F.lit(a[0]), text, F.lit(a[1]))).otherwise(F.concat(F.lit(b[0]), text, F.lit(b[1])))


def correct(candidates: DataFrame, model: Callable[[], Callable[[list[str]], list[str]]] = identity_model) -> DataFrame:
    """(page_id, block_id, text, corrected, confidence) of correction_candidates(): a changed text gains 0.1 of confidence, 1 at most; a failing model changes nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = None
        for b in batches:
            try:
                ask = ask or model()
                said = ask(b["prompt"].tolist())
            except Exception:  # noqa: BLE001
                said = b["text"].tolist()
            new = pd.Series([a or t for a, t in zip(said, b["text"], strict=True)], index=b.index, dtype=object)
            changed = new != b["text"]
            yield pd.DataFrame({"page_id": b["page_id"], "block_id": b["block_id"], "text": new, "corrected": changed, "confidence": (b["confidence"] + 0.1 * changed).clip(upper=1.0)})

    kind = F.col("content_type") if "content_type" in candidates.columns else F.lit(None).cast("string")
    own = candidates.select("page_id", "block_id", "text", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), correction_prompt(F.col("text"), kind).alias("prompt"))
    return own.mapInPandas(run, "page_id long, block_id long, text string, corrected boolean, confidence double")


def apply_corrections(blocks: DataFrame, corrected: DataFrame) -> DataFrame:
    c = corrected.select("page_id", "block_id", F.col("text").alias("__t"), F.col("corrected").alias("__c"), F.col("confidence").alias("__f"))
    j = blocks.drop("corrected").join(c, ["page_id", "block_id"], "left")
    hit = F.coalesce("__c", F.lit(False))
    return j.withColumns({"text": F.when(hit, F.col("__t")).otherwise(F.col("text")), "confidence": F.when(hit, F.col("__f")).otherwise(F.col("confidence")), "corrected": hit}).drop("__t", "__c", "__f")


def recognized_tables(raw: DataFrame) -> DataFrame:
    """(page_id, table_id, html, cells, bbox, confidence, engine) of recogniser items (page_id, items): tables with HTML only."""
    items = raw.select("page_id", F.posexplode("items").alias("table_id", "i")).where(F.lower("i.type") == "table")
    html = F.coalesce(F.when(F.col("i.res.html") != "", F.col("i.res.html")), F.col("i.html"))
    confidence = F.coalesce(F.nullif("i.confidence", F.lit(0.0)), F.nullif("i.res.confidence", F.lit(0.0)), F.lit(1.0))
    return items.select("page_id", "table_id", html.alias("html"), F.coalesce("i.res.cell_bbox", F.array().cast("array<string>")).alias("cells"), "i.bbox", confidence.alias("confidence"), F.lit("ppstructure").alias("engine")).where(F.coalesce("html", F.lit("")) != "")


TRANSCRIBED = "page_id long, region_id int, markdown string"


def rebuild_pages(crops: DataFrame, transcribe: Callable[[], Callable[[bytes], str | None]]) -> DataFrame:
    """(page_id, markdown, n_regions) of region crops (page_id, region_id, content): stitched in order; a page with a failed region is left out."""
    from pagemill.operators.render import stitch_regions

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tell = None
        for b in batches:
            tell = tell or transcribe()
            out = []
            for c in b["content"]:
                try:
                    out.append(tell(c))
                except Exception:  # noqa: BLE001
                    out.append(None)
            yield pd.DataFrame({"page_id": b["page_id"], "region_id": b["region_id"], "markdown": pd.Series(out, dtype=object, index=b.index)})

    said = crops.select("page_id", "region_id", "content").mapInPandas(run, TRANSCRIBED)
    # A page's regions are counted where they stand, and the count goes with them: what the model said is read once.
    page = Window.partitionBy("page_id")
    whole = said.select("*", F.bool_and(F.col("markdown").isNotNull()).over(page).alias("ok"), F.count("*").over(page).cast("int").alias("n_regions")).where("ok")
    parts = whole.select(F.struct("page_id", "n_regions").alias("doc_id"), F.col("region_id").alias("part"), X.without_fences(F.col("markdown")).alias("text"))
    return stitch_regions(parts).where("text <> ''").select("doc_id.page_id", F.col("text").alias("markdown"), "doc_id.n_regions")


def enhance_regions(crops: DataFrame, backend: Callable[[], Backend], tier: str, enabled: bool = False, base_max: float = 0.55, margin: float = 0.30, least: float = 0.90) -> DataFrame:
    """(page_id, item_id, html, region, engine, backend, score_enhanced, score_base, verdict) of poor regions' crops (page_id, region_id, content, bbox, quality, n_cols, blocks, x0, y0).

    Regions for which the backend finds no table, or fails, are left out; for
    the slow table model, drop those that geometry.applicability() refuses before.
    """
    from pagemill.operators import gates

    if tier == "manual":
        crops = crops.where(F.lit(False))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = None
        for b in batches:
            read = read or backend()
            out = []
            for r in b.itertuples():
                try:
                    out.append(read(r.content, {"bbox": list(r.bbox), "quality": r.quality, "n_cols": r.n_cols}, r.blocks, (r.x0, r.y0)))
                except Exception:  # noqa: BLE001
                    out.append(None)
            yield pd.DataFrame({"page_id": b["page_id"], "region_id": b["region_id"], "html": pd.Series(out, dtype=object, index=b.index)})

    found = crops.select("page_id", "region_id", "content", "bbox", "quality", "n_cols", "blocks", "x0", "y0").mapInPandas(run, "page_id long, region_id int, html string").where("html <> ''")
    scored = found.withColumn("__rows", X.html_rows(F.col("html"), tidy=False)).withColumn("score_enhanced", gates.table_structure(F.col("__rows")))
    region = F.struct("bbox", "quality", "n_cols")
    j = scored.join(crops.select("page_id", "region_id", region.alias("region"), F.col("quality").alias("score_base")), ["page_id", "region_id"])
    verdict = gates.adopt_verdict(F.col("score_base"), F.col("score_enhanced"), enabled, base_max, margin, least)
    return j.select("page_id", F.col("region_id").alias("item_id"), "html", "region", F.lit(tier).alias("engine"), F.lit(tier).alias("backend"), F.round("score_enhanced", 3).alias("score_enhanced"), F.round("score_base", 3).alias("score_base"), verdict.alias("verdict"))


def engines_of(config: dict) -> dict[str, str]:
    e = (config.get("ocr") or {}).get("engines") or {}
    text = e.get("text_default", DEFAULT_ENGINE)
    return {"pure_text": text, "simple_table": text, "mixed": text, "complex_table": e.get("table_complex", ENGINES["complex_table"]), "math_special": e.get("math_special", ENGINES["math_special"])}
