"""Operator 6: k-d tree sharding with DataFrame functions only.

The space of the metadata dimensions is split again and again: a node that is worth k shards is cut along its
widest dimension at the weighted quantile that gives each side its part of the k, until every leaf is one shard of
about the target bytes. A cut is found by histograms: each pass sums the weight in ``BINS`` equal parts of every
node's open interval and keeps the part with the quantile, until that part weighs next to nothing. All nodes of a level
share each pass, so a level costs a few scans of a narrow table, and the driver holds a few numbers per shard.

Dimensions must be functions of what makes a group (here the text), so equal texts fall into one leaf without a
join. Ties of a dimension are broken by the hash of the text, hence only a group itself is indivisible.

Defined cases: a null text has size 8 and is a group with the other null texts; an empty table gives no rows; equal
rows get slots of their own; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stavelake.llm.common import Scratch, table, values_table, written

BINS = 65_536
#: A cut may miss its quantile by this part of a shard's target.
TOLERANCE = 0.004
TIE_BITS = 31
SLOT_BUCKETS = 64
ROW_OVERHEAD = 8


def text_dimensions() -> dict[str, Column]:
    """Metadata of a document that its text alone decides: bytes, bytes per 1000 characters, lines."""
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    chars = F.coalesce(F.length("text"), F.lit(0))
    lines = chars - F.length(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("")))
    return {"size_dim": size, "script_dim": F.floor(1000 * size / F.greatest(chars, F.lit(1))), "lines_dim": lines}


def measured(docs: DataFrame, dims: dict[str, Column]) -> DataFrame:
    """doc_id, size, text_crc32, tie and one long per dimension: (value, tie) as one number."""
    tie = F.shiftright(F.xxhash64("text"), 64 - TIE_BITS) + F.lit(1 << (TIE_BITS - 1))
    keys = [(F.least(v.cast("long"), F.lit((1 << 31) - 1)) * F.lit(1 << TIE_BITS) + F.col("tie")).alias(n) for n, v in dims.items()]
    return docs.select("doc_id", "text").withColumn("tie", tie).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_OVERHEAD).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        *keys,
    )


def _assign(points: DataFrame, splits: list[tuple]) -> DataFrame:
    """Moves the points of split nodes to their children. splits: (node, dimension, cut, left, right)."""
    rows = values_table(points.sparkSession, splits, "node int, dim int, cut long, left int, right int")
    value = F.element_at("keys", F.col("dim"))
    child = F.when(value <= F.col("cut"), F.col("left")).otherwise(F.col("right"))
    return points.join(rows, "node", "left").withColumn("node", F.coalesce(child, F.col("node"))).select(points.columns)


def _width(x: dict) -> int:
    return max(1, -(-(x["hi"] - x["lo"] + 1) // BINS))


def _cuts(points: DataFrame, open_nodes: dict[int, dict], slack: float) -> None:
    """Sets ``cut`` of each open node: the greatest key of its left side."""
    spark = points.sparkSession
    todo = open_nodes
    while todo:
        bounds = values_table(
            spark, [(n, x["dim"], x["lo"], _width(x), float(x["goal"] - x["below"])) for n, x in todo.items()], "node int, dim int, lo long, width long, goal double"
        )
        part = F.expr("(element_at(keys, dim) - lo) div width")
        hist = (
            points.join(bounds, "node")
            .filter((F.element_at("keys", F.col("dim")) >= F.col("lo")) & (part < BINS))
            .groupBy("node", "goal", part.alias("part"))
            .agg(F.sum("size").alias("w"))
        )
        # The part in which the running weight passes the goal: one row per node comes to the driver.
        upto = F.sum("w").over(Window.partitionBy("node").orderBy("part"))
        hit = hist.withColumn("upto", upto).filter("upto >= goal").groupBy("node").agg(F.min_by(F.struct("part", "w", "upto"), "part").alias("x")).select("node", "x.*").collect()
        found = {r["node"]: r for r in hit}
        left = {}
        for n, x in todo.items():
            width, r = _width(x), found[n]
            low, high = x["lo"] + r["part"] * width, x["lo"] + (r["part"] + 1) * width - 1
            under, over = x["below"] + r["upto"] - r["w"], x["below"] + r["upto"]
            if width == 1 or r["w"] <= slack:
                # Cut before or after this part, whichever is nearer to the goal, and leave no side empty.
                nearer_low = x["goal"] - under < over - x["goal"]
                x["cut"] = low - 1 if (nearer_low and under > 0) or over >= x["weight"] else high
                x["left_weight"] = under if x["cut"] == low - 1 else over
            else:
                x["lo"], x["hi"], x["below"] = low, high, under
                left[n] = x
        todo = left


def kd_leaves(points: DataFrame, shards: int, n_dims: int, scratch: Scratch) -> DataFrame:
    """``points`` (keys, size, ...) with ``node``: the number of its leaf, 0 to shards - 1. A level's table goes when the next is written."""
    points = points.withColumn("node", F.lit(0).cast("int"))
    worth = {0: (0, shards)}  # node -> first leaf, leaves
    open_nodes = {0} if shards > 1 else set()
    while open_nodes:
        stats = points.groupBy("node").agg(
            F.sum("size").alias("weight"),
            *[F.min(F.element_at("keys", d + 1)).alias(f"lo{d}") for d in range(n_dims)],
            *[F.max(F.element_at("keys", d + 1)).alias(f"hi{d}") for d in range(n_dims)],
        )
        rows = {r["node"]: r for r in stats.collect()}
        if not rows:
            return points
        if 0 in open_nodes and len(worth) == 1:
            full = [max(1, (rows[0][f"hi{d}"] >> TIE_BITS) - (rows[0][f"lo{d}"] >> TIE_BITS)) for d in range(n_dims)]
            target = rows[0]["weight"] / shards
        cuts, still = {}, set()
        for n in open_nodes:
            r, (first, k) = rows.get(n), worth[n]
            if r is None or all(r[f"lo{d}"] == r[f"hi{d}"] for d in range(n_dims)):
                continue  # nothing, or one group: it cannot be cut
            wide = [((r[f"hi{d}"] >> TIE_BITS) - (r[f"lo{d}"] >> TIE_BITS)) / full[d] for d in range(n_dims)]
            d = max(range(n_dims), key=lambda i: (wide[i], -i))
            cuts[n] = {"dim": d + 1, "lo": r[f"lo{d}"], "hi": r[f"hi{d}"], "below": 0, "goal": r["weight"] * (k // 2) / k, "weight": r["weight"]}
        if not cuts:
            break
        _cuts(points, cuts, TOLERANCE * target)
        splits = []
        for n, x in cuts.items():
            first, k = worth.pop(n)
            # A group heavier than its share takes fewer shards beside it: each side is worth what it weighs.
            k_left = min(k - 1, max(1, round(k * x["left_weight"] / x["weight"])))
            children = (first, first + k_left)
            for child, size in zip(children, (k_left, k - k_left)):
                worth[child] = (child, size)
                if size > 1:
                    still.add(child)
            splits.append((n, x["dim"], x["cut"], *children))
        before, points = points, scratch.written(_assign(points, splits), "level")
        scratch.drop(before)
        open_nodes = still
    return points


def shard_by_bytes(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, dims: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard: shards of near equal bytes; equal texts share a shard.

    Give the number of shards, or the bytes a shard should hold.
    """
    dims = dims or text_dimensions()
    with Scratch(docs.sparkSession) as scratch:
        points = scratch.written(measured(docs, dims).select("doc_id", "size", "text_crc32", F.array(*dims).alias("keys")), "points")
        if shards is None:
            total = points.agg(F.sum("size")).first()[0] or 0
            shards = max(1, round(total / target_bytes))
        leaves = kd_leaves(points, shards, len(dims), scratch)
        return written(leaves.select("doc_id", "size", "text_crc32", F.col("keys").alias("_keys"), F.col("node").alias("shard")), "shards")


def with_slots(sharded: DataFrame) -> DataFrame:
    """``slot``: 0, 1, 2, ... within each shard. A shard is numbered in buckets, so no task sorts a whole shard."""
    bucketed = sharded.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(SLOT_BUCKETS)).cast("int"))
    counts = bucketed.groupBy("shard", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy("shard", "_bucket").orderBy("doc_id", "text_crc32")
    numbered = bucketed.withColumn("_i", F.row_number().over(inside) - 1)
    return numbered.join(offsets, ["shard", "_bucket"]).withColumn("slot", (F.col("_before") + F.col("_i")).cast("long")).drop("_bucket", "_i", "_before")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = shard_by_bytes(table(spark, sf_dir, "documents"), shards=24)
    return with_slots(sharded).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"), "slot", F.lit(None).cast("int").alias("grown_shard")
    )
