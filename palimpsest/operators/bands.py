"""Rows into bands: runs, merged gaps, tall bands cut. All are gaps and islands."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def runs(rows: DataFrame, group: list[str], position: str, active: str) -> DataFrame:
    """Maximal runs of consecutive active positions: group, start, end (exclusive)."""
    order = Window.partitionBy(*group).orderBy(position)
    fresh = (F.col(position) - F.lag(position).over(order) != 1) | F.lag(position).over(order).isNull()
    on = rows.filter(F.col(active)).withColumn("_run", F.sum(fresh.cast("int")).over(order))
    return on.groupBy(*group, "_run").agg(F.min(position).alias("start"), (F.max(position) + 1).alias("end")).drop("_run")


def merged(bands: DataFrame, group: list[str], gap, start: str = "start", end: str = "end") -> DataFrame:
    """Bands (disjoint, any order) with gaps of at most ``gap`` joined; ``gap`` may be an interval."""
    order = Window.partitionBy(*group).orderBy(start)
    fresh = F.coalesce(F.col(start) - F.lag(end).over(order) > gap, F.lit(True))
    parts = bands.withColumn("_part", F.sum(fresh.cast("int")).over(order))
    return parts.groupBy(*group, "_part").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n_parts")).drop("_part")


def long_enough(bands: DataFrame, least: int) -> DataFrame:
    return bands.filter(F.col("end") - F.col("start") >= least)


def line_bands(rows: DataFrame, group: list[str], share: float = 0.02, gap: int = 12, least: int = 20) -> DataFrame:
    """Text bands of images given as rows (group, row, ink, width): active rows, merged, then long enough."""
    active = rows.withColumn("_active", F.col("ink") > share * F.col("width"))
    return long_enough(merged(runs(active, group, "row", "_active"), group, gap).drop("n_parts"), least)


def bounded(bands: DataFrame, most: int, least: int, overlap: int = 40) -> DataFrame:
    """Bands over ``most`` long cut into overlapping pieces of that length; short last pieces go."""
    step = max(least, most - overlap)
    tall = F.col("end") - F.col("start") > most
    last = F.ceil((F.col("end") - F.col("start") - most) / step).cast("long")
    cuts = F.when(tall, F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(last, F.lit(0).cast("long"))), lambda i: F.col("start") + i * step)).otherwise(F.array(F.col("start").cast("long")))
    parts = bands.withColumn("_from", F.explode(cuts)).withColumn("_to", F.when(tall, F.least(F.col("end"), F.col("_from") + most)).otherwise(F.col("end")))
    parts = parts.filter(~tall | (F.col("_to") - F.col("_from") >= least))
    return parts.withColumns({"start": F.col("_from"), "end": F.col("_to").cast("long")}).drop("_from", "_to")


def split_tall(rows: DataFrame, bands: DataFrame, group: list[str], most: int = 600, least: int = 20, gap_rows: int = 15) -> DataFrame:
    """Bands over ``most`` rows cut in the middle of their gaps.

    A gap is a run of at least ``gap_rows`` rows with no more ink than the band's tenth
    percentile. A piece shorter than ``least`` is dropped and the next starts after it.
    """
    key = [*group, "_start", "_end"]
    all_bands = bands.select(*group, F.col("start").alias("_start"), F.col("end").alias("_end"))
    tall = all_bands.filter(F.col("_end") - F.col("_start") > most)
    inside = tall.join(rows.select(*group, "row", "ink"), group).filter((F.col("row") >= F.col("_start")) & (F.col("row") < F.col("_end")))
    low = inside.groupBy(*key).agg(F.percentile("ink", F.lit(0.1)).alias("_low"))
    gaps = long_enough(runs(inside.join(low, key).withColumn("_on", F.col("ink") <= F.col("_low")), key, "row", "_on"), gap_rows)
    middles = gaps.select(*key, (F.col("_start") + F.floor((F.col("start") + F.col("end") - 2 * F.col("_start")) / 2)).alias("_cut"))
    cuts = middles.groupBy(*key).agg(F.array_sort(F.collect_list("_cut")).alias("_cuts"))
    whole = all_bands.join(cuts, key, "left").withColumn("_cuts", F.coalesce("_cuts", F.array().cast("array<bigint>")))
    edges = F.concat(F.array(F.col("_start").cast("long")), "_cuts", F.array(F.col("_end").cast("long")))
    pieces = whole.withColumn("_p", F.explode(F.arrays_zip(F.slice(edges, 1, F.size(edges) - 1).alias("start"), F.slice(edges, 2, F.size(edges) - 1).alias("end"))))
    pieces = pieces.filter((F.size("_cuts") == 0) | (F.col("_p.end") - F.col("_p.start") >= least))
    return bounded(pieces.select(*group, F.col("_p.start").alias("start"), F.col("_p.end").alias("end")), most, least)


def column_extent(columns: DataFrame, group: list[str], height: str = "height", width: str = "width") -> DataFrame:
    """First and last column (column, ink) with more ink than 0.3 % of the height; all of the width if none has."""
    inked = F.col("ink") > F.greatest(F.lit(1), F.floor(0.003 * F.col(height)))
    return columns.groupBy(*group).agg(F.coalesce(F.min(F.when(inked, F.col("column"))), F.lit(0)).alias("x1"), F.coalesce(F.max(F.when(inked, F.col("column"))) + 1, F.max(width)).alias("x2"))


def padded(bands: DataFrame, pad_y: int = 8, pad_x: int = 12) -> DataFrame:
    """Crops of bands (start, end, x1, x2, width, height) with margins, within the image."""
    return bands.withColumns({
        "start": F.greatest(F.lit(0), F.col("start") - pad_y), "end": F.least(F.col("height"), F.col("end") + pad_y),
        "x1": F.greatest(F.lit(0), F.col("x1") - pad_x), "x2": F.least(F.col("width"), F.col("x2") + pad_x),
    })
