"""Operator 9: near-duplicate documents by ProbMinHash, banding and verification.

A document is the set of its distinct five-word shingles, each of weight one: the sketch and the verification judge
the same similarity, however often a text repeats a passage. Every shingle runs a Poisson process seeded by its hash;
each arrival falls on one of the registers and a register keeps the earliest. A document's processes stop once their
next arrival is later than every register, so most shingles draw one or two numbers. With equal weights two
registers agree with the Jaccard similarity. Rows of registers form bands.

Equal shingle sets are collapsed first, so a group of copies is one node. Within a band's bucket each node is paired with the
bucket's centre only, by one order of the nodes for all bands, so a group meets few centres; pairs are verified by the exact Jaccard
similarity of their shingle sets, and verified links give components. Bands are worked in blocks: what a block has joined is one
label afterwards, later pairs within a label are left out, and components are made of the labels that are still apart.

What that leaves apart is looked at again: nodes that share a bucket but not a component get a longer sketch, whose buckets
hold few pairs below the similarity (a pair of similarity 0.8 shares one with probability 0.998, one of 0.5 with 0.01). There
they are compared with the buckets' centres and then with all that is still apart and whose sketches agree in enough single
bits (a pair of similarity 0.8 fails that with probability 3e-6); pairs within a component are never compared.

Defined cases: texts of one to four words are one shingle; texts without words are classes of their own; repeated rows
fall into one class; an empty table gives no rows; other columns are kept by the filter and ignored by the report.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stavelake.llm import tokens
from stavelake.llm.common import Scratch, id_of, packed, shuffled, table, unpacked, with_text_key, written
from stavelake.llm.tokens import U, mix


@dataclass(frozen=True)
class NearConfig:
    shingle: int = 5
    similarity: float = 0.8
    bands: int = 20
    rows: int = 4

    @property
    def registers(self) -> int:
        return self.bands * self.rows


CONFIG = NearConfig()
#: Bands of the first block, in which a pair of the similarity shares a bucket with probability 0.88.
FIRST_BANDS = 4
#: For what the bands leave in one bucket but apart: far fewer pairs below the similarity share a bucket.
FINE = NearConfig(bands=140, rows=14)


def shingles(t: tokens.Text, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every shingle; a row of fewer words than ``size`` has one."""
    at, found = tokens.windows(t.words, t.row, size)
    n = np.diff(t.word_at)
    short = np.flatnonzero((n > 0) & (n < size))
    whole = mix(tokens.hashes_of(t.words, t.word_at[short], t.word_at[short + 1]) ^ U(size))
    return np.concatenate([t.row[at], short]), np.concatenate([found, whole])


def distinct(row: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle) of each distinct shingle of a row, by row and shingle."""
    order = np.lexsort((found, row))
    row, found = row[order], found[order]
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (found[1:] != found[:-1])
    return row[first], found[first]


def probminhash(row: np.ndarray, element: np.ndarray, weight: np.ndarray, rows: int, registers: int) -> np.ndarray:
    """The element that each register of each row keeps, as a (rows, registers) array."""
    time = np.full(rows * registers, np.inf)
    kept = np.zeros(rows * registers, U)
    state, x = mix(element ^ U(0x5851F42D4C957F2D)), np.zeros(len(element))
    step = 0
    while len(row):
        draw = mix(state + U(step * 0x9E3779B97F4A7C15 % (1 << 64)))
        x = x - np.log(((draw >> U(12)).astype(np.float64) + 0.5) * 2.0**-52) / weight
        place = ((mix(draw ^ U(0xDA942042E4DD58B5)) >> U(32)) * U(registers) >> U(32)).astype(np.int64)
        at = row * registers + place
        np.minimum.at(time, at, x)
        won = time[at] == x
        kept[at[won]] = element[won]
        step += 1
        if step < 4 or step % 4 == 0:
            latest = time.reshape(rows, registers).max(axis=1)
            go = x < latest[row]
            row, element, weight, state, x = row[go], element[go], weight[go], state[go], x[go]
    return kept.reshape(rows, registers)


def _sketches(config: NearConfig, with_bits: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, column in tokens.slices(batches, limit=1 << 21):
            t = tokens.text_of(column)
            rows = len(column)
            row, element = distinct(*shingles(t, config.shingle))
            counts = np.bincount(row, minlength=rows)
            first = np.concatenate([[0], np.cumsum(counts)])
            kept = probminhash(row, element, np.ones(len(row)), rows, config.registers)
            bands = np.zeros((rows, config.bands), U)
            grouped = kept.reshape(rows, config.bands, config.rows)
            for i in range(config.rows):
                bands = mix(bands * U(0x2545F4914F6CDD1D) + grouped[:, :, i])
            bands = mix(bands ^ mix(np.arange(config.bands, dtype=U) + U(77)))
            f1 = tokens.hashes_of(element, first[:-1], first[1:])
            f2 = tokens.hashes_of(mix(element ^ U(0x1B873593CC9E2D51)), first[:-1], first[1:])
            per = np.where(counts > 0, config.bands, 0)
            ids = [part.column(part.schema.get_field_index(x)) for x in ("doc_id", "_th")]
            longs = [pa.array(x.view(np.int64), pa.int64()) for x in (f1, f2)]
            # One bit of each register (of whole longs of them): they differ in (1 - similarity) / 2 of all places.
            places = config.registers // 64 * 64 if with_bits else 0
            bits = np.packbits((mix(kept[:, :places]) & U(1)).astype(np.uint8), axis=1).reshape(-1).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    *ids, pa.array(counts, pa.int64()), *longs, tokens.lists(per, bands[counts > 0].reshape(-1).view(np.int64), pa.int64()),
                    tokens.lists(np.full(rows, places // 64), bits, pa.int64()),
                ],
                names=["doc_id", "_th", "n", "f1", "f2", "bands", "bits"],
            )

    return run


def _sets(config: NearConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, column in tokens.slices(batches):
            row, element = distinct(*shingles(tokens.text_of(column), config.shingle))
            counts = np.bincount(row, minlength=len(column))
            node = part.column(part.schema.get_field_index("node"))
            yield pa.RecordBatch.from_arrays([node, tokens.lists(counts, element.view(np.int64), pa.int64())], names=["node", "elements"])

    return run


SKETCH = "doc_id long, _th long, n long, f1 long, f2 long, bands array<long>, bits array<long>"


def sketches(docs: DataFrame, scratch: Scratch, config: NearConfig = CONFIG) -> DataFrame:
    keyed = with_text_key(docs).select("doc_id", "_th", "text")
    return scratch.written(keyed.mapInArrow(_sketches(config), SKETCH).drop("bits"), "sketches")


def nodes_of(sketch: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per distinct shingle set: node, f1, f2, its size, its bands and one document (d, t) that holds it."""
    groups = sketch.filter("n > 0").groupBy("f1", "f2").agg(F.min(F.struct("doc_id", "_th")).alias("x"), F.any_value("n").alias("n"), F.any_value("bands").alias("bands"))
    return scratch.written(groups.select(F.monotonically_increasing_id().alias("node"), "f1", "f2", F.col("x.doc_id").alias("d"), F.col("x._th").alias("t"), "n", "bands"), "nodes")


def _alike(n1: Column, n2: Column, least: float) -> Column:
    return F.least(n1, n2) >= least * F.greatest(n1, n2)


#: Standard deviations below the similarity at which the bits of a pair let it pass to the exact verification.
SLACK = 4.5


def _bits_allow(a: Column, b: Column, registers: int, least: float) -> Column:
    """Whether the bits of two sketches are near enough for the similarity: one such pair in 300,000 is not."""
    places = registers // 64 * 64
    differ = sum((F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(places // 64)), F.lit(0))
    p = (1 - least) / 2
    return differ <= places * p + SLACK * (places * p * (1 - p)) ** 0.5


def labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``rows`` (node, ...) with the label of each node's component; a node without links is its own."""
    if labels is None:
        return rows.withColumn("label", F.col("node"))
    return rows.join(shuffled(labels), "node", "left").withColumn("label", F.coalesce("label", "node"))


def centre_pairs(buckets: DataFrame, least: float) -> DataFrame:
    """(a, b): the centre of each bucket with each member of another label whose size allows the similarity.

    buckets: key, node, f1, n, label. The centre is the first member in the order of f1, the same for all buckets.
    """
    centre = buckets.groupBy("key").agg(F.min(F.struct("f1", "node", "n", "label")).alias("c"), F.count("*").alias("members")).filter("members > 1")
    pairs = buckets.join(centre.select("key", F.col("c.node").alias("a"), F.col("c.n").alias("an"), F.col("c.label").alias("alabel")), "key")
    return pairs.filter((F.col("label") != F.col("alabel")) & _alike(F.col("n"), F.col("an"), least)).select("a", F.col("node").alias("b")).distinct()


def split_buckets(buckets: DataFrame) -> DataFrame:
    """The rows of the buckets with more than one label."""
    split = buckets.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("key")
    return buckets.join(split, "key", "left_semi")


def rest_pairs(buckets: DataFrame, config: NearConfig, fine: NearConfig, scratch: Scratch) -> DataFrame:
    """(a, b) of one bucket and different labels, where sizes and bits allow the similarity. buckets: key, node, n, bits, label."""
    placed = scratch.written(split_buckets(buckets), "split-buckets")
    other = placed.select("key", *[F.col(c).alias(f"_{c}") for c in ("node", "n", "label", "bits")])
    near = _alike(F.col("n"), F.col("_n"), config.similarity) & _bits_allow(F.col("bits"), F.col("_bits"), fine.registers, config.similarity)
    met = placed.join(other, "key").filter((F.col("node") < F.col("_node")) & (F.col("label") != F.col("_label")) & near)
    return met.select(F.col("node").alias("a"), F.col("_node").alias("b")).distinct()


def texts_of(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text) of the wanted nodes."""
    involved = wanted.join(nodes.select("node", "d", "t"), "node")
    keyed = with_text_key(docs).select("doc_id", "_th", "text")
    return keyed.join(involved, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("_th").eqNullSafe(F.col("t"))).select("node", "text")


def fine_sketches(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, scratch: Scratch, fine: NearConfig = FINE) -> DataFrame:
    """node, f1, n, bands and bits of the wanted nodes."""
    texts = texts_of(docs, nodes, wanted).select(F.col("node").alias("doc_id"), F.lit(0).cast("long").alias("_th"), "text")
    sketch = texts.mapInArrow(_sketches(fine, with_bits=True), SKETCH).select(F.col("doc_id").alias("node"), "f1", "n", "bands", "bits")
    return scratch.written(sketch.dropDuplicates(["node"]), "fine-sketches")


#: Partners of one node that are compared in one task.
PARTNERS_A_TASK = 256


def verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, scratch: Scratch, config: NearConfig = CONFIG) -> DataFrame:
    """The pairs (a, b) whose shingle sets have at least the similarity; a node with many partners is spread by a salt."""
    pairs = scratch.written(pairs, "pairs")
    if pairs.isEmpty():
        return pairs
    texts = texts_of(docs, nodes, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    sets = scratch.written(texts.mapInArrow(_sets(config), "node long, elements array<long>").dropDuplicates(["node"]), "sets")
    salts = pairs.groupBy("a").agg((F.count("*") / PARTNERS_A_TASK).cast("int").alias("most"))
    salted = pairs.join(salts, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("most") + 1).cast("int")).drop("most")
    left = sets.join(salts, F.col("node") == F.col("a")).select("a", F.explode(F.sequence(F.lit(0), "most")).alias("salt"), F.col("elements").alias("a_set"))
    right = sets.select(F.col("node").alias("b"), F.col("elements").alias("b_set"))
    both = salted.join(left, ["a", "salt"]).join(right, "b")
    common = F.size(F.array_intersect("a_set", "b_set"))
    links = scratch.written(both.filter(common >= config.similarity * (F.size("a_set") + F.size("b_set") - common)).select("a", "b"), "links")
    scratch.drop(sets, pairs)
    return links


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label): the least node of each component, by alternating large-star and small-star rounds.

    Rounds are cut by written tables; only a count and a checksum of the edges come to the driver.
    """
    edges = scratch.written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        found = both.join(shuffled(low), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = found.groupBy("u").agg(F.min("v").alias("m"))
        linked = found.join(shuffled(low), "u")
        found = scratch.written(linked.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        scratch.drop(edges)
        edges = found
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(edges.select("v", "v").distinct())


def merged(labels: DataFrame | None, links: DataFrame, scratch: Scratch) -> DataFrame | None:
    """The labels after more links: components are made of the old labels, so a large component is one node."""
    if links.isEmpty():
        return labels
    at = lambda x: labelled(links.select(F.col(x).alias("node"), "a", "b"), labels)
    edges = at("a").select("a", "b", F.col("label").alias("x")).join(shuffled(at("b").select("a", "b", F.col("label").alias("y"))), ["a", "b"])
    new = components(edges.select(F.col("x").alias("a"), F.col("y").alias("b")).filter("a != b"), scratch)
    if labels is None:
        return scratch.written(new, "labels")
    moved = labels.join(shuffled(new.select(F.col("node").alias("label"), F.col("label").alias("to"))), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return scratch.written(moved.union(new.join(shuffled(labels), "node", "left_anti")), "labels")


def classes(docs: DataFrame, config: NearConfig = CONFIG) -> DataFrame:
    """doc_id, _th, class_id (least doc_id), class_size and keep (the class's first row) for every document."""
    with Scratch(docs.sparkSession) as scratch:
        sketch = sketches(docs, scratch, config)
        nodes = nodes_of(sketch, scratch)
        labels = None
        for first, n in ((0, FIRST_BANDS), (FIRST_BANDS, config.bands - FIRST_BANDS)):
            bands = nodes.select("node", "f1", "n", F.explode(F.slice("bands", first + 1, n)).alias("key"))
            links = verified(docs, nodes, centre_pairs(labelled(bands, labels), config.similarity), scratch, config)
            labels = merged(labels, links, scratch)
        bands = nodes.select("node", F.explode("bands").alias("key"))
        fine = fine_sketches(docs, nodes, split_buckets(labelled(bands, labels)).select("node").distinct(), scratch)
        buckets = lambda *columns: labelled(fine.select("node", *columns, F.explode("bands").alias("key")), labels)
        for pairs_of in (lambda: centre_pairs(buckets("f1", "n"), config.similarity), lambda: rest_pairs(buckets("n", "bits"), config, FINE, scratch)):
            labels = merged(labels, verified(docs, nodes, pairs_of(), scratch, config), scratch)
        of_node = labelled(nodes.select("node", "f1", "f2"), labels).select("f1", "f2", "label")
        members = scratch.written(sketch.select("doc_id", "_th", "f1", "f2").join(of_node, ["f1", "f2"], "left").select("doc_id", "_th", "label"), "members")
        sizes = members.filter("label is not null").groupBy("label").agg(F.min(F.struct("doc_id", "_th")).alias("first"), F.count("*").alias("class_size"))
        out = members.join(sizes, "label", "left").select(
            "doc_id",
            "_th",
            F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"),
            F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
            (F.col("label").isNull() | F.struct("doc_id", "_th").eqNullSafe(F.col("first"))).alias("keep"),
        )
        return written(out, "classes")


def one_of_each(docs: DataFrame, config: NearConfig = CONFIG) -> DataFrame:
    """The first document of each class, with its own columns; documents without words all stay."""
    gone = classes(docs, config).filter("not keep").select(id_of(F.col("doc_id")).alias("_id"), "_th").distinct()
    left = packed(docs).withColumn("_id", id_of(F.col("doc_id"))).join(gone, ["_id", "_th"], "left_anti")
    has_word = F.rlike(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]"))
    copy = F.row_number().over(Window.partitionBy("_id", "_th").orderBy("_id"))
    return unpacked(left.withColumn("_copy", copy).filter((F.col("_copy") == 1) | ~has_word), docs.columns, {})


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")
