"""Boxes on pages: crops, the two conventions of their origin, words with geometry, regions of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def crop(x: Column, y: Column, w: Column, h: Column) -> Column:
    """(left, top, right, bottom) of a rectangle, each of its numbers cut to a whole one first."""
    left, top, width, height = (v.cast("int") for v in (x, y, w, h))
    return F.struct(left.alias("left"), top.alias("top"), (left + width).alias("right"), (top + height).alias("bottom"))


def from_bottom(x: Column, y: Column, w: Column, h: Column, page_height: Column) -> Column:
    """(x1, y1, x2, y2) with the origin at the bottom left."""
    return F.struct(
        x.cast("int").alias("x1"),
        (page_height - (y + h).cast("int")).alias("y1"),
        (x + w).cast("int").alias("x2"),
        (page_height - y.cast("int")).alias("y2"),
    )


def words_with_boxes(words: DataFrame) -> DataFrame:
    """Recognised words (word, left, top, width, height) that have text and a place."""
    placed = F.lit(True)
    for c in ("left", "top", "width", "height"):
        placed = placed & F.col(c).isNotNull()
    return words.filter(F.coalesce(F.trim("word"), F.lit("")) != "").filter(placed)


def pages_with_regions(pages: DataFrame, regions: DataFrame) -> DataFrame:
    """Pages (doc, page_index, ...) with their region; pages without one drop, of several the last given counts."""
    last = regions.groupBy("doc", "page_index").agg(F.max_by("rect", "place").alias("rect"))
    return pages.join(last, ["doc", "page_index"])
