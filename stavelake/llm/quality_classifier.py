"""Operator 2: a quality classifier on random Fourier features.

Each document becomes some thirty statistics of its text. Cosines of random projections approximate a Gaussian
kernel over them; every partition of the labelled rows sums its part of the normal equations, the parts are added by matrix row,
and the driver solves one ridge system of fixed size. Scores are calibrated by isotonic regression on bins of
out-of-fold predictions: the two folds' equations are kept apart, so each fold is scored by the other's model, and
the final model solves their sum.

Defined cases: a null text is empty and is scored like any other; a null doc_id is not held out and has no label; of rows that repeat a
labelled doc_id the one with the least statistics is learned from; repeated label rows are averaged; labels without a
document and null labels are ignored; without labelled rows every score is 0.5; an empty table gives no rows; other columns
are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stavelake.llm import tokens
from stavelake.llm.common import Scratch, table, written


@dataclass(frozen=True)
class ClassifierConfig:
    features: int = 256
    bandwidth: float = 1.0
    ridge: float = 1.0
    bins: int = 512
    seed: int = 20240501


CONFIG = ClassifierConfig()


def _byte_class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_UPPER = _byte_class(bytes(range(65, 91)))
_LOWER = _byte_class(bytes(range(97, 123)))
_DIGIT = _byte_class(b"0123456789")
_CLASSES = [_UPPER, _LOWER, _DIGIT, tokens.SPACE, _byte_class(b".,;:?"), _byte_class(b"!"), _byte_class(b"|"), _byte_class(b"#*$%&<>@^~"), _byte_class(b"\"'()[]{}-_/\\+="), _byte_class(bytes(range(128, 256)))]
_STOP, _LOUD = _byte_class(b".?!:;"), _byte_class(b"!#*$%&|<>@")


def statistics(t: tokens.Text) -> np.ndarray:
    """(rows, statistics) of each text."""
    rows = len(t.row_at) - 1
    size = np.maximum(np.diff(t.row_at), 1).astype(float)
    n = np.diff(t.word_at)
    words = np.maximum(n, 1).astype(float)
    per_word = lambda x: np.bincount(t.row, weights=x, minlength=rows) / words
    columns = [np.log1p(np.diff(t.row_at)), np.log1p(n)]
    columns += [t.per_row(c[t.data]) / size for c in _CLASSES]

    chars = np.concatenate([[0], np.cumsum((t.data & 0xC0) != 0x80)])
    length = (chars[t.ends] - chars[t.starts]).astype(float)
    mean = per_word(length)
    columns += [mean, np.sqrt(np.maximum(per_word(length**2) - mean**2, 0)), per_word(length <= 3), per_word(length > 14)]
    if len(t.row):
        first, last = t.data[t.starts], t.data[t.ends - 1]
        columns += [per_word(_UPPER[first]), per_word(_STOP[last]), per_word(_LOUD[last]), per_word(~(_UPPER | _LOWER | _DIGIT)[last] & (last < 128))]
        loud_first = per_word(_LOUD[first])
    else:
        columns += [np.zeros(rows)] * 4
        loud_first = np.zeros(rows)
    columns.append(loud_first)

    salt = tokens.mix(t.row.astype(tokens.U) + tokens.U(1))
    folded = t.folded ^ salt
    distinct = np.bincount(t.row[np.unique(folded, return_index=True)[1]], minlength=rows)
    columns.append(distinct / words)
    columns.append(np.bincount(t.row[1:], weights=(t.row[1:] == t.row[:-1]) & (t.folded[1:] == t.folded[:-1]), minlength=rows) / words if len(t.row) > 1 else np.zeros(rows))
    at, found = tokens.windows(t.words, t.row, 5)
    again = tokens.repeated(found ^ salt[at])
    columns.append(np.bincount(t.row[at], weights=again, minlength=rows) / words)

    row, _, begin, end = t.lines()
    has = np.searchsorted(t.starts, end) > np.searchsorted(t.starts, begin)
    row, begin, end = row[has], begin[has], end[has]
    lines = np.maximum(np.bincount(row, minlength=rows), 1)
    exact = tokens.hashes_of(t.data, begin, end) ^ tokens.mix(row.astype(tokens.U) + tokens.U(1))
    columns.append(1 - np.bincount(row[np.unique(exact, return_index=True)[1]], minlength=rows) / lines)
    columns += [np.log1p(lines), np.log1p(words / lines)]
    closed = _STOP[t.data[np.maximum(end - 1, 0)]] if len(end) else np.zeros(0)
    columns.append(np.bincount(row, weights=closed, minlength=rows) / lines)
    return np.column_stack(columns)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, column in tokens.slices(batches):
        x = statistics(tokens.text_of(column))
        yield pa.RecordBatch.from_arrays(
            [part.column(part.schema.get_field_index("doc_id")), tokens.lists(np.full(len(x), x.shape[1]), x.reshape(-1), pa.float64())], names=["doc_id", "x"]
        )


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


@dataclass(frozen=True)
class Scaler:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    phase: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features with a constant; statistics far outside the training range are clipped."""
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        f = np.cos(z @ self.weights + self.phase) * np.sqrt(2.0 / len(self.phase))
        return np.column_stack([f, z, np.ones(len(x))])


def _matrix(batch: pa.RecordBatch, name: str = "x") -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _floats(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


#: The partitions' sums are added in so many groups first, so no task meets one from every partition.
SUMS_AT_ONCE = 64


def normal_equations(training: DataFrame, scaler: Scaler) -> dict[int, np.ndarray]:
    """Per fold the rows [X'X | X'y], added over partitions; the driver gets two matrices of fixed size."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            if b.num_rows:
                z, y, fold = scaler.features(_matrix(b)), _floats(b, "y"), _floats(b, "fold")
                for k in np.unique(fold):
                    zk = z[fold == k]
                    s = zk.T @ np.column_stack([zk, y[fold == k]])
                    sums[int(k)] = sums.get(int(k), 0) + s
        for k, s in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(s), k), pa.int32()), pa.array(np.arange(len(s)), pa.int32()), tokens.lists(np.full(len(s), s.shape[1]), s.reshape(-1), pa.float64())], names=["fold", "i", "row"]
            )

    def add(group: pa.Table) -> pa.Table:
        total = group.column("row").combine_chunks().flatten().to_numpy().reshape(group.num_rows, -1).sum(axis=0)
        return pa.table({"fold": group.column("fold")[:1], "i": group.column("i")[:1], "row": pa.array([total], pa.list_(pa.float64()))})

    schema = "fold int, i int, row array<double>"
    parts = training.mapInArrow(part, schema).withColumn("some", F.spark_partition_id() % SUMS_AT_ONCE)
    rows = parts.groupBy("fold", "i", "some").applyInArrow(add, schema).groupBy("fold", "i").applyInArrow(add, schema).collect()
    out: dict[int, np.ndarray] = {}
    for fold in {r["fold"] for r in rows}:
        mine = sorted((r for r in rows if r["fold"] == fold), key=lambda r: r["i"])
        out[fold] = np.array([r["row"] for r in mine])
    return out


def solve(equations: np.ndarray, ridge: float) -> np.ndarray:
    left = equations[:, :-1] + ridge * np.diag([1.0] * (len(equations) - 1) + [1e-9])
    return np.linalg.solve(left, equations[:, -1])


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins in the order of ``x``: the blocks' mean x and mean y."""
    blocks: list[list[float]] = []
    for a, b, w in zip(x, y, weight):
        blocks.append([a, b, w])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            a2, b2, w2 = blocks.pop()
            a1, b1, w1 = blocks.pop()
            w = w1 + w2
            blocks.append([(a1 * w1 + a2 * w2) / w, (b1 * w1 + b2 * w2) / w, w])
    return np.array([b[0] for b in blocks]), np.array([b[1] for b in blocks])


def _raw_scores(training: DataFrame, scaler: Scaler, models: dict[int, np.ndarray]) -> DataFrame:
    """raw, y: each training row by the model of the other fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                z, fold = scaler.features(_matrix(b)), _floats(b, "fold")
                raw = np.where(fold == 0, z @ models[0], z @ models[1])
                yield pa.RecordBatch.from_arrays([pa.array(raw), pa.array(_floats(b, "y"))], names=["raw", "y"])

    return training.mapInArrow(run, "raw double, y double")


def scored(docs: DataFrame, labels: DataFrame, config: ClassifierConfig = CONFIG) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; labels of held-out rows are never read."""
    x = written(docs.select("doc_id", "text").mapInArrow(_measure, "doc_id long, x array<double>"), "statistics")
    given = labels.filter("quality is not null and doc_id is not null").filter(~held_out(F.col("doc_id")))
    given = given.groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("y"))
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("fold")
    out = [F.col("doc_id"), held_out(F.col("doc_id")).alias("held_out")]
    with Scratch(docs.sparkSession) as scratch:
        training = scratch.written(x.join(given, "doc_id").groupBy("doc_id", "y").agg(F.min("x").alias("x")).select("x", "y", fold), "training")
        at = training.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).orderBy("i").collect()
        if not at:
            return x.select(*out, F.lit(0.5).alias("score"), F.lit(1).alias("predicted"))
        rng = np.random.default_rng(config.seed)
        d = len(at)
        scaler = Scaler(
            np.array([r["m"] for r in at]),
            np.array([max(r["s"], 1e-6) for r in at]),
            rng.normal(size=(d, config.features)) / (config.bandwidth * np.sqrt(d)),
            rng.uniform(0, 2 * np.pi, config.features),
        )
        sums = normal_equations(training, scaler)
        whole = solve(sum(sums.values()), config.ridge)
        folds = {k: solve(sums[1 - k], config.ridge) if 1 - k in sums else whole for k in (0, 1)}
        # The calibration reads no more than the bins.
        bin_of = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(config.bins - 1.0), (F.col("raw") + 0.5) * config.bins / 2)))
        bins = _raw_scores(training, scaler, folds).groupBy(bin_of.alias("bin")).agg(F.avg("raw").alias("raw"), F.avg("y").alias("y"), F.count("*").alias("n")).orderBy("bin").collect()
        xs, ys = isotonic(*(np.array([r[c] for r in bins], float) for c in ("raw", "y", "n")))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s = np.clip(np.interp(scaler.features(_matrix(b)) @ whole, xs, ys), 0, 1)
                yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("doc_id")), pa.array(s)], names=["doc_id", "score"])

    predicted = F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    return x.mapInArrow(score, "doc_id long, score double").select(*out, "score", predicted)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
