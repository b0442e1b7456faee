"""Rows that a person reviews: default roles, and whether anything was edited."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the review rows.
MASK_TYPE = "_manual_lyric_mask"
NUMBER_TYPES = ("measure_number", "page_number")


def default_role() -> Column:
    """Items without a role are lyrics; ``unknown`` stays where a user has chosen it."""
    chosen = (F.col("item_type") == "unknown") & F.coalesce("user_set", F.lit(False))
    return F.when(F.coalesce("item_type", F.lit("")).isin("", "unknown") & ~F.coalesce(chosen, F.lit(False)), "lyrics").otherwise(F.col("item_type"))


def is_edit() -> Column:
    """Whether a row shows a user's hand: a mask, a chosen unknown, a role other than lyrics and numbers, or a place that is not the default one. Of numbers only their role counts."""
    kind = F.coalesce("item_type", F.lit(""))
    placed = (F.col("part_index") > 1) | (F.col("verse_index") > 1) | (F.col("skip_notes") > 0) | ~F.coalesce(F.trim("voice"), F.lit("")).isin("", "1") | (F.size("rects") > 0)
    return (
        F.when(kind == MASK_TYPE, True)
        .when((kind == "unknown") & F.coalesce("user_set", F.lit(False)), True)
        .when(kind.isin(*NUMBER_TYPES), False)
        .when(~kind.isin("", "lyrics"), True)
        .otherwise(F.coalesce(placed, F.lit(False)))
    )


def edited(rows: DataFrame) -> DataFrame:
    """doc_id and edited (any row is an edit)."""
    return rows.groupBy("doc_id").agg(F.bool_or(is_edit()).alias("edited"))
