"""What the operators of this subpackage share: reading a table, shared-folder tables, small column helpers."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="stavelake-")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Where the setting is unset, a local run gets a folder of its own; a cluster run is refused.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _own_folder()


#: Spark's setting for removing the shuffle files of a query as soon as it has ended.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _write(df: DataFrame, path: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Writes ``df`` and reads it again. Shuffle files go once a query has ended, so a job needs the disk of its largest step, not of all steps.

    The setting stays on for the session, so queries that run side by side do not take it from each other.
    """
    spark = df.sparkSession
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    df.write.partitionBy(*by).option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage, and a lost executor costs no recomputation.

    For what an operator returns; what it needs on the way goes into a ``Scratch``.
    """
    return _write(df, f"{shared_folder(df.sparkSession)}/stavelake/{name}-{uuid.uuid4().hex}")


class Scratch:
    """Tables in the shared folder that last as long as the ``with`` block; what leaves the block must be ``written`` inside it."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/stavelake/scratch-{uuid.uuid4().hex}"
        self._paths: list[tuple[DataFrame, str]] = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self._delete(self.folder)

    def written(self, df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
        path = f"{self.folder}/{name}-{len(self._paths)}"
        out = _write(df, path, by)
        self._paths.append((out, path))
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables of this block that nothing reads any more."""
        for df, path in self._paths:
            if any(df is t for t in tables):
                self._delete(path)

    def _delete(self, path: str) -> None:
        context = self.spark.sparkContext
        place = context._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased; every other character stays."""
    return F.translate(text, UPPER, LOWER)


def with_text_key(docs: DataFrame) -> DataFrame:
    """Adds ``_th``, a hash of the text; with doc_id it tells rows apart, and equal rows share it."""
    return docs.withColumn("_th", F.xxhash64("text"))


def shuffled(rows: DataFrame) -> DataFrame:
    """``rows`` as a side of a join that is never broadcast: what grows with the input does not pass through the driver, however small its compressed files are."""
    return rows.hint("merge")


def values_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few numbers of the driver as a relation that Spark sizes and broadcasts by itself. schema: 'name type, ...'."""
    fields = [x.split() for x in schema.split(",")]
    cells = ", ".join("(" + ", ".join(f"CAST({value!r} AS {kind})" for value, (_, kind) in zip(row, fields)) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {cells} AS t({', '.join(name for name, _ in fields)})")


def id_of(doc_id: Column) -> Column:
    """doc_id as a join key that null is part of, so a join and a window on it share one shuffle."""
    return F.coalesce(doc_id.cast("long"), F.lit(-(1 << 63)))


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, text, _th and ``_row``: the other columns as one struct, so no name of the input can clash."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select("doc_id", "text", F.xxhash64("text").alias("_th"), F.struct(*rest).alias("_row"))


def unpacked(df: DataFrame, columns: list[str], changed: dict[str, Column]) -> DataFrame:
    """The input's columns again, with those in ``changed`` replaced."""
    return df.select(*[changed.get(c, F.col("text") if c == "text" else F.col(f"_row.`{c}`")).alias(c) for c in columns])
