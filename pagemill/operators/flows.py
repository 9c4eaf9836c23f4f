"""Enhancement of poor tables and rebuilding of scrambled pages, end to end: regions, crops, readers, verdicts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.operators import gates, geometry, images, layout, recognize
from pagemill.operators.backends import Registry

ENHANCE_REGIONS, REBUILD_REGIONS = 4, 6
OVERLAP = 0.08


def poor_regions(rendered: DataFrame) -> DataFrame:
    """(page_id, region_id, x0, y0, x1, y1, quality, n_cols) of render_pages()'s poor tables, in their order."""
    p = rendered.select("page_id", F.posexplode("poor").alias("region_id", "p")).where("size(p.bbox) = 4")
    return p.select("page_id", "region_id", *(F.get("p.bbox", F.lit(k)).alias(c) for k, c in enumerate(("x0", "y0", "x1", "y1"))), "p.quality", "p.n_cols")


def page_regions(blocks: DataFrame) -> DataFrame:
    """(page_id, region_id, x0, y0, x1, y1): the reading regions of pages' text, in reading order; whole pixels, cut toward zero."""
    r = layout.reading_regions(layout.content(blocks))
    box = r.groupBy("page_id", "band_no", "side").agg(*(f(c).cast("int").alias(k) for f, c, k in ((F.min, "min_x", "x0"), (F.min, "min_y", "y0"), (F.max, "max_x", "x1"), (F.max, "max_y", "y1"))))
    return box.withColumn("region_id", F.row_number().over(layout.over(["page_id"], "band_no", "side")) - 1).drop("band_no", "side")


def region_crops(regions: DataFrame, pictures: DataFrame, most: int, overlap: float = 0.0) -> DataFrame:
    """The first `most` regions of a page, padded and clipped, and content: their PNG.  pictures: (page_id, image), image as Spark's image source has it."""
    sized = regions.join(pictures, "page_id")
    more_x, more_y = (F.floor(F.col(f"image.{c}") * overlap).cast("int") for c in ("width", "height"))
    wider = sized.withColumns({"x0": F.col("x0") - more_x, "x1": F.col("x1") + more_x, "y0": F.col("y0") - more_y, "y1": F.col("y1") + more_y})
    cut = geometry.padded_boxes(wider, F.col("image.width"), F.col("image.height"), most=most)
    return cut.withColumn("content", images.crops(F.col("image"), *(F.col(c) for c in ("x0", "y0", "x1", "y1")))).drop("image")


def with_blocks(crops: DataFrame, blocks: DataFrame) -> DataFrame:
    """adds blocks: the text blocks whose centre lies in the crop."""
    inside = geometry.blocks_in_regions(blocks, crops.select("page_id", "region_id", "x0", "y0", "x1", "y1"))
    held = inside.groupBy("page_id", "region_id").agg(F.array_sort(F.collect_list(F.struct("block_id", "text", "bbox"))).alias("blocks"))
    return crops.join(held, ["page_id", "region_id"], "left")


def applicable(crops: DataFrame, blocks: DataFrame) -> DataFrame:
    """Crops that look like regular ruled tables: worth a slow reader."""
    inside = geometry.blocks_in_regions(blocks, crops.select("page_id", "region_id", "x0", "y0", "x1", "y1"))
    fit = geometry.applicability(inside, ["page_id", "region_id"]).where("applicable").select("page_id", "region_id")
    return crops.join(fit, ["page_id", "region_id"], "left_semi")


def enhance(rendered: DataFrame, blocks: DataFrame, pictures: DataFrame, registry: Registry, override: str | None = None, tier: str | None = None, enabled: bool = False, base_max: float = 0.55, margin: float = 0.30, least: float = 0.90, most: int = ENHANCE_REGIONS) -> DataFrame:
    """Enhanced tables of the pages' first poor regions, as layout.render_pages() takes them: none for the tier "manual"."""
    name, backend = registry.choose(override, tier)
    crops = region_crops(poor_regions(rendered), pictures, most)
    if name == "ppstructurev3":
        crops = applicable(crops, blocks)
    own = poor_regions(rendered).select("page_id", "region_id", F.array("x0", "y0", "x1", "y1").alias("bbox"))
    crops = with_blocks(crops, blocks).join(own, ["page_id", "region_id"])
    return recognize.enhance_regions(crops, backend, name if backend is not None else "manual", enabled, base_max, margin, least)


def rebuild(rendered: DataFrame, blocks: DataFrame, pictures: DataFrame, transcribe: Callable, allow: bool = True, hit_min: float = 0.9, fabricate_max: float = 0.05, struct_min: float = 0.5, most: int = REBUILD_REGIONS) -> DataFrame:
    """(page_id, markdown, n_regions, n_ocr, n_vlm, hit, fabricate, struct, reasons, adopt) of pages that need it and whose first regions were all read."""
    scrambled = rendered.where("needs_rebuild").select("page_id")
    regions = page_regions(blocks.join(scrambled, "page_id", "left_semi"))
    made = recognize.rebuild_pages(region_crops(regions, pictures, most, OVERLAP), transcribe)
    text = blocks.where("type = 'text'").join(made.select("page_id"), "page_id", "left_semi").groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_id", "text"))), lambda b: b["text"]), " ").alias("source"))
    said = made.join(text, "page_id", "left")
    metrics = gates.consistency(said, said, "page_id", "source", "markdown")
    judged = made.withColumn("struct", gates.markdown_structure(F.col("markdown"))).join(metrics, "page_id")
    return gates.rebuild_verdict(judged, allow=allow, hit_min=hit_min, fabricate_max=fabricate_max, struct_min=struct_min)


def with_rebuilt(notes: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Rendered pages whose body is the rebuilt one where that is adopted."""
    r = rebuilt.where("adopt").select("page_id", F.col("markdown").alias("again"))
    return notes.join(r, "page_id", "left").withColumn("body", F.coalesce("again", "body")).drop("again")
