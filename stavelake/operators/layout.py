"""Layout operators on glyphs and text items: lines, ranges, matching of two sources, overlap filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stavelake.functions import text as T

PAGE = ("doc_id", "page")


def islands(rows: DataFrame, keys: tuple[str, ...], low: str, high: str, gap: float) -> DataFrame:
    """Adds ``island``: intervals of one group merge when they begin within ``gap`` of what came before."""
    w = Window.partitionBy(*keys).orderBy(low, high)
    reach = F.max(high).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("_new", F.coalesce((F.col(low) > reach + gap), F.lit(True)).cast("int")).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def merged_ranges(rows: DataFrame, keys: tuple[str, ...], low: str, high: str, gap: float = 0.05) -> DataFrame:
    return islands(rows.select(*keys, low, high).distinct(), keys, low, high, gap).groupBy(*keys, "island").agg(F.min(low).alias("lo"), F.max(high).alias("hi"))


def line_clusters_by_gap(glyphs: DataFrame, tolerance: float = 4.0) -> DataFrame:
    """Adds ``line_no``: a glyph starts a line when it is more than the tolerance below the glyph before it."""
    w = Window.partitionBy(*PAGE).orderBy("y0", "x0", "glyph_no")
    new = F.coalesce(F.col("y0") - F.lag("y0").over(w) > tolerance, F.lit(True)).cast("int")
    return glyphs.withColumn("_new", new).withColumn("line_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def line_clusters(glyphs: DataFrame, tolerance: float = 4.0) -> DataFrame:
    """(doc_id, page, line_no, n, x0, y0, x1, y1, mean_size): lines by the running mean of their own glyphs.

    The running mean depends on what the line took before, so the page's glyphs are folded in order; a page bounds the fold.
    """
    glyph = F.struct("y0", "x0", "glyph_no", "size_pt")
    pages = glyphs.groupBy(*PAGE).agg(F.array_sort(F.collect_list(glyph)).alias("g"))
    lines = "array<struct<n:bigint,sum:double,x0:bigint,x1:bigint,y0:bigint,y1:double,size:double>>"

    def start(g: Column) -> Column:
        return F.struct(
            F.lit(1).cast("long").alias("n"), g["y0"].cast("double").alias("sum"), g["x0"].alias("x0"), (g["x0"] + 6).alias("x1"), g["y0"].alias("y0"), (g["y0"] + g["size_pt"]).alias("y1"), g["size_pt"].alias("size")
        )

    def step(acc: Column, g: Column) -> Column:
        last = F.element_at(acc, -1)
        joins = (F.size(acc) > 0) & (F.abs(g["y0"] - last["sum"] / last["n"]) <= tolerance)
        grown = F.struct(
            (last["n"] + 1).alias("n"), (last["sum"] + g["y0"]).alias("sum"), F.least(last["x0"], g["x0"]).alias("x0"), F.greatest(last["x1"], g["x0"] + 6).alias("x1"), F.least(last["y0"], g["y0"]).alias("y0"), F.greatest(last["y1"], g["y0"] + g["size_pt"]).alias("y1"), (last["size"] + g["size_pt"]).alias("size")
        )
        return F.when(joins, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(grown))).otherwise(F.concat(acc, F.array(start(g))))

    folded = pages.select(*PAGE, F.aggregate("g", F.array().cast(lines), step).alias("lines"))
    return folded.select(*PAGE, F.posexplode("lines").alias("line_no", "l")).select(*PAGE, "line_no", "l.n", "l.x0", "l.y0", "l.x1", F.round("l.y1", 4).alias("y1"), F.round(F.col("l.size") / F.col("l.n"), 6).alias("mean_size"))


def pair_score() -> Column:
    """IoU of two items, plus 0.35 if one text holds the other. norm and bnorm: their texts, normalised once for each item."""
    box = lambda p: tuple(F.col(p + c) for c in ("x0", "y0", "x1", "y1"))
    held = F.contains("norm", "bnorm") | F.contains("bnorm", "norm")
    return F.round(T.iou(box(""), box("b")) + F.when(held, 0.35).otherwise(0.0), 9)


def best_matches(pairs: DataFrame, least: float = 0.25) -> DataFrame:
    """Each left line with its best right line; of left lines with one right line, the last stays."""
    scored = pairs.withColumn("score", pair_score()).filter(F.col("score") >= least)
    best = F.row_number().over(Window.partitionBy("doc_id", "line_no").orderBy(F.col("score").desc(), "bline_no"))
    last = F.row_number().over(Window.partitionBy("doc_id", "bline_no").orderBy(F.col("line_no").desc()))
    return scored.withColumn("_b", best).filter("_b = 1").withColumn("_l", last).filter("_l = 1").drop("_b", "_l")


def greedy_matches(pairs: DataFrame, least: float = 0.25) -> DataFrame:
    """One-to-one: left lines in order take the best right line that is still free. A page bounds the fold."""
    scored = pairs.withColumn("score", pair_score()).filter(F.col("score") >= least)
    per = scored.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("line_no", (-F.col("score")).alias("cost"), "bline_no"))).alias("p"))
    taken = "array<struct<line_no:bigint,bline_no:bigint,score:double>>"

    def step(acc: Column, p: Column) -> Column:
        free = ~F.exists(acc, lambda t: (t["line_no"] == p["line_no"]) | (t["bline_no"] == p["bline_no"]))
        return F.when(free, F.concat(acc, F.array(F.struct(p["line_no"].alias("line_no"), p["bline_no"].alias("bline_no"), (-p["cost"]).alias("score"))))).otherwise(acc)

    return per.select("doc_id", "page", F.inline(F.aggregate("p", F.array().cast(taken), step)))


def near_any(glyphs: DataFrame, bands: DataFrame, distance: float = 30.0) -> DataFrame:
    """Glyphs with no protected y within the distance: bands are put in bins of that size, so the anti-join has an equal key."""
    bins = bands.select("doc_id", "page", "py", F.explode(F.array(*[F.floor(F.col("py") / distance) + d for d in (-1, 0, 1)])).alias("bin"))
    cut = glyphs.withColumn("bin", F.floor(F.col("y0") / distance))
    on = (cut["doc_id"] == bins["doc_id"]) & (cut["page"] == bins["page"]) & (cut["bin"] == bins["bin"]) & (F.abs(cut["y0"] - bins["py"]) < distance)
    return cut.join(bins, on, "left_anti").drop("bin")


def staff_bands(ink: DataFrame, systems: DataFrame, expected: int = 6, least: int = 8) -> DataFrame:
    """(page, band, y0, y1): the staves of a system image from the ink of its rows. ink: page, y, ink; systems: page, height.

    Rows with 8 % of the darkest row's ink (at least 2) form bands; those of fewer than ``least`` rows go. While there are more than ``expected`` + 2, the
    narrowest gap is closed, which is to say the narrowest ones together; of what is left, ``expected`` are picked evenly. Too few bands
    or none: the height is cut evenly. An image lower than two bands is one.
    """
    dark = ink.join(systems, "page").filter("y >= 0 and y < height and ink > 0").withColumn("_top", F.max("ink").over(Window.partitionBy("page")))
    dark = dark.filter(F.col("ink") >= F.greatest(F.lit(2), F.floor(F.col("_top") * 0.08))).withColumn("_end", F.col("y") + 1)
    runs = islands(dark, ("page",), "y", "_end", 0).groupBy("page", "island").agg(F.min("y").alias("y0"), F.max("_end").alias("y1")).filter(F.col("y1") - F.col("y0") >= least)
    order = Window.partitionBy("page").orderBy("y0")
    runs = runs.withColumns({"_gap": F.col("y0") - F.lag("y1").over(order), "_n": F.count("*").over(Window.partitionBy("page"))})
    narrow = F.row_number().over(Window.partitionBy("page").orderBy(F.col("_gap").asc_nulls_last(), "y0"))
    closed = F.col("_gap").isNotNull() & (narrow <= F.col("_n") - (expected + 2))
    runs = runs.withColumn("_new", (~closed).cast("int")).withColumn("_band", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    bands = runs.groupBy("page", "_band").agg(F.min("y0").alias("y0"), F.max("y1").alias("y1"))
    found = bands.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("y0", "y1"))).alias("_bands")).filter(F.size("_bands") >= expected)
    low = F.floor(F.greatest(F.lit(least), F.floor(F.col("height") / expected)))
    picks = F.posexplode(F.sequence(F.lit(0), F.lit(expected - 1))).alias("band", "_i")
    both = systems.join(found, "page", "left").select("page", "height", "_bands", picks).withColumn("_low", low)
    n = F.size("_bands")
    both = both.withColumn("_found", F.get("_bands", F.least(n - 1, F.floor(F.col("band") * (n / expected))).cast("int")))
    y0 = F.coalesce("_found.y0", F.col("band") * F.col("_low"))
    y1 = F.coalesce("_found.y1", F.least("height", (F.col("band") + 1) * F.col("_low")))
    small = F.col("height") < 2 * least
    out = both.filter(~small | (F.col("band") == 0)).select("page", F.col("band").cast("long").alias("band"), F.when(small, 0).otherwise(y0).alias("y0"), F.when(small, F.col("height")).otherwise(y1).alias("y1"))
    return out.select("page", "band", F.col("y0").cast("long").alias("y0"), F.col("y1").cast("long").alias("y1"))


BOX = ("x0", "y0", "x1", "y1")


def titled(items: DataFrame, titles: DataFrame) -> DataFrame:
    """The items with each document's title in its place. items: doc_id, line_no, page, item_type, text, user_set and a box that may be null; titles: one of doc_id, page, text and box.

    A title replaces the first item of its page that it meets: with boxes on both sides by an overlap of 0.2, else as a title or by text that
    holds the other's. A title with a box that meets none is put before the document's items (line 0). Where a user has set a title, nothing changes.
    """
    bare = lambda c: F.replace(T.strip_pua(F.coalesce(c, F.lit(""))), F.lit(" "), F.lit(""))
    own = titles.select("doc_id", "page", F.col("text").alias("_text"), *[F.col(c).alias(f"_{c}") for c in BOX]).filter(F.trim("_text") != "")
    settled = items.filter("item_type = 'title' and user_set").select("doc_id").distinct()
    own = own.join(settled, "doc_id", "left_anti").withColumn("_text", F.trim("_text"))
    pairs = items.join(own, ["doc_id", "page"])
    boxed = F.col("_x0").isNotNull() & F.col("x0").isNotNull()
    near = T.iou(tuple(F.col(f"_{c}") for c in BOX), tuple(F.col(c) for c in BOX)) >= 0.2
    a, t = bare(F.col("text")), F.replace(F.col("_text"), F.lit(" "), F.lit(""))
    holds = (F.length(a) > 0) & (F.length(t) > 0) & (F.contains(t, a) | F.contains(a, t))
    hit = F.when(boxed, near).otherwise(F.coalesce(F.col("item_type") == "title", F.lit(False)) | holds)
    first = pairs.filter(hit).groupBy("doc_id").agg(F.min("line_no").alias("line_no")).join(own.drop("page"), "doc_id")
    joined = items.join(first, ["doc_id", "line_no"], "left").withColumn("_hit", F.col("_text").isNotNull())
    new = {"text": F.coalesce("_text", "text"), "item_type": F.when(F.col("_hit"), "title").otherwise(F.col("item_type"))} | {c: F.when(F.col("_hit") & F.col("_x0").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)) for c in BOX}
    columns = ["doc_id", "line_no", "page", "item_type", "text", *BOX]
    kept = joined.withColumns(new).select(*columns, F.when(F.col("_hit"), "scoreTitle").alias("provenance"))
    missing = own.filter("_x0 is not null").join(first.select("doc_id"), "doc_id", "left_anti")
    put = missing.select("doc_id", F.lit(0).cast("long").alias("line_no"), "page", F.lit("title").alias("item_type"), F.col("_text").alias("text"), *[F.col(f"_{c}").alias(c) for c in BOX], F.lit("scoreTitle").alias("provenance"))
    return kept.unionByName(put)


def line_summaries(glyphs: DataFrame) -> DataFrame:
    """doc_id, page, line_no, box, mean_size and font of each line of glyphs: fonts are counted first, so no line's glyphs are gathered."""
    line = (*PAGE, "line_no")
    fonts = glyphs.groupBy(*line, "fontname").agg(
        F.count("*").alias("n"), F.sum("size_pt").alias("size"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max(F.col("x0") + 6).alias("x1"), F.max(F.col("y0") + F.col("size_pt")).alias("y1")
    )
    out = fonts.groupBy(*line).agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.round(F.sum("size") / F.sum("n"), 6).alias("mean_size"), F.min_by("fontname", F.struct(-F.col("n"), F.col("fontname"))).alias("font")
    )
    return out.withColumn("line_no", F.col("line_no").cast("long"))
