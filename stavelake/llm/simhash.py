r"""Operator 13: SimHash near-dedup, its links found by Golay-code fuzzy hashing.

A text's fingerprint has one bit for each of the 64 bits of its shingles' XXH64 (three words, A-Z lower-cased, repeats
included): set if over half of the hashes have it. Fingerprints link at ``max_bits`` = 3 or fewer differing bits and components follow.

A fingerprint is three segments of 22, 21 and 21 bits. The perfect Golay code of 23 bits gives each segment its own codeword index and the
nearby ones (of all segments one bit away; one or about six indices). Three errors over three segments leave either one
segment equal and another with one error at most, or exactly one error in each. So there are two kinds of keys: an equal segment with an
index of another one, and the indices of two segments with the parities of all three (flipped on the other side). One side of a link
emits its own index, the other its nearby ones; equal keys are a bucket and every candidate is verified by counting the bits.

Equal fingerprints are one node, so a group of copies is one row. Members of a bucket are compared with its centre first and links
become labels; then members of different labels in a bucket are compared, as long as the bucket has ``max_bucket`` rows. What a larger
bucket still leaves apart is linked exactly and in linear size: every fingerprint emits all that lie within two bits of it, and
one that lies within one bit of the value links with all others that emitted it, which needs no pairs.

Defined cases: null and empty texts have the fingerprint zero and link with one another; texts of one or two words are one
shingle; repeated rows fall together; a null doc_id is never a component's id unless it has no other; an empty table gives no rows;
other columns are ignored, whatever their names; a very long text is worked in slices of its own and only its counts are kept.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stavelake.llm import tokens
from stavelake.llm.common import Scratch, shuffled, table, written
from stavelake.llm.near_dedup import labelled, merged
from stavelake.llm.tokens import U

SEED = 42
SHINGLE = 3
MAX_BITS = 3
MAX_BUCKET = 128
#: First bit and length of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the Golay code of 23 bits: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
#: Rows of one fingerprint that one task joins.
ROWS_A_TASK = 1 << 14


def _syndrome(v: np.ndarray) -> np.ndarray:
    for bit in range(22, 10, -1):
        v = v ^ ((v >> bit) & 1) * (GENERATOR << (bit - 11))
    return v


@functools.cache
def _errors() -> np.ndarray:
    """The error pattern (three bits at most) of each syndrome; the code is perfect, so each has one."""
    patterns = np.array([sum(1 << b for b in bits) for n in range(4) for bits in combinations(range(23), n)])
    out = np.zeros(1 << 11, np.int64)
    out[_syndrome(patterns)] = patterns
    return out


def codeword_index(v: np.ndarray) -> np.ndarray:
    """The index (12 bits) of the one codeword within three bits."""
    return (v ^ _errors()[_syndrome(v)]) >> 11


def nearby(v: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, index): the distinct indices of v and of all that are one bit away, by row."""
    found = np.sort(np.stack([codeword_index(v)] + [codeword_index(v ^ (1 << b)) for b in range(bits)], axis=1), axis=1)
    new = np.ones(found.shape, bool)
    new[:, 1:] = found[:, 1:] != found[:, :-1]
    row, at = np.nonzero(new)
    return row, found[row, at]


def _counts(t: tokens.Text) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, set bits by place) of each row. Words stand in one buffer with one space between, so a shingle is a stretch of it."""
    length = t.ends - t.starts
    at = np.concatenate([[0], np.cumsum(length + 1)])
    joined = np.full(at[-1], 32, np.uint8)
    source = np.flatnonzero(~tokens.SPACE[t.data])
    joined[source + np.repeat(at[:-1] - t.starts, length)] = tokens.FOLD[t.data[source]]
    joined = joined.tobytes()
    n = np.diff(t.word_at)
    per = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    first_of = np.concatenate([[0], np.cumsum(per)])
    word = np.repeat(t.word_at[:-1], per) + np.arange(first_of[-1]) - np.repeat(first_of[:-1], per)
    last = word + np.repeat(np.minimum(n, SHINGLE), per)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[i:j], SEED) for i, j in zip(at[word].tolist(), (at[last] - 1).tolist())), U, len(word))
    set_bits = np.zeros((len(n), 64), np.int64)
    for row in np.flatnonzero(per):
        own = h[first_of[row] : first_of[row + 1]]
        for low in range(0, len(own), 1 << 14):
            set_bits[row] += np.unpackbits(own[low : low + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return per, set_bits


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, column in tokens.slices(batches):
        per, set_bits = _counts(tokens.text_of(column))
        bits = np.packbits((2 * set_bits > per[:, None]).astype(np.uint8), axis=1, bitorder="little").view("<i8").reshape(-1)
        yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("doc_id")), pa.array(bits, pa.int64())], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row; fp as a signed long."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long")


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, node, own) of each fingerprint: keys of its own indices and of nearby ones."""
    for b in batches:
        node = b.column(0).to_numpy()
        fp = node.view(U)
        segment = [((fp >> U(at)) & U((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
        own = [codeword_index(s) for s in segment]
        near = [nearby(s, n) for s, (_, n) in zip(segment, SEGMENTS)]
        keys, rows, is_own = [], [], []
        kinds = [(i, j) for i in range(3) for j in range(3) if i != j]
        for kind, (i, j) in enumerate(kinds):
            row, index = near[j]
            keys.append(kind << 60 | segment[i][row] << 12 | index)
            rows.append(row)
            is_own.append(index == own[j][row])
        parity = sum((np.bitwise_count(s) & 1).astype(np.int64) << i for i, s in enumerate(segment))
        (row, index), (other, index2) = near[0], near[1]
        n2 = np.bincount(other, minlength=len(fp))
        first2 = np.cumsum(n2) - n2
        times = n2[row]
        pick = np.repeat(first2[row] - np.cumsum(times) + times, times) + np.arange(times.sum())
        row, index, index2 = np.repeat(row, times), np.repeat(index, times), index2[pick]
        everyone = np.arange(len(fp))
        for r, x, y, p, mine in ((everyone, own[0], own[1], parity, True), (row, index, index2, parity[row] ^ 7, False)):
            keys.append(len(kinds) << 60 | x << 15 | y << 3 | p)
            rows.append(r)
            is_own.append(np.full(len(r), mine))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(node[np.concatenate(rows)]), pa.array(np.concatenate(is_own))], names=["key", "node", "own"])


def _within(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= MAX_BITS


def _ball(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(value, node, label, inner) for all values within two bits of each fingerprint; inner within one."""
    masks = np.array([sum(1 << b for b in bits) for n in range(3) for bits in combinations(range(64), n)], U)
    for b in batches:
        for low in range(0, b.num_rows, 256):
            part = b.slice(low, 256)
            value = (part.column(0).to_numpy().view(U)[:, None] ^ masks).view(np.int64).reshape(-1)
            row = pa.array(np.repeat(np.arange(part.num_rows), len(masks)))
            inner = np.tile(np.arange(len(masks)) <= 64, part.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(value), part.column(0).take(row), part.column(1).take(row), pa.array(inner)], names=["value", "node", "label", "inner"])


def ball_links(rows: DataFrame) -> DataFrame:
    """(a, b): links that join all linked (node, label) of different labels, without pairs. A value's first inner member is linked to all others."""
    spread = rows.repartition(F.col("node")).mapInArrow(_ball, "value long, node long, label long, inner boolean")
    centres = spread.filter("inner").groupBy("value").agg(F.min(F.struct("node", "label")).alias("c")).select("value", F.col("c.node").alias("a"), F.col("c.label").alias("alabel"))
    return spread.join(shuffled(centres), "value").filter("label != alabel").select("a", F.col("node").alias("b")).distinct()


def linked(nodes: DataFrame, scratch: Scratch, max_bucket: int = MAX_BUCKET) -> DataFrame | None:
    """(node, label): the component of each fingerprint that has a link; None without any. nodes: node, the distinct fingerprints."""
    keys = nodes.mapInArrow(_keys, "key long, node long, own boolean")
    of_key = Window.partitionBy("key")
    counted = keys.withColumns({"members": F.count("*").over(of_key), "centre": F.min(F.when(F.col("own"), F.col("node"))).over(of_key)})
    members = scratch.written(counted.filter("members > 1 and centre is not null"), "members")
    links = members.filter("node != centre").filter(_within("node", "centre")).select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    labels = merged(None, scratch.written(links, "links"), scratch)
    for exact in (False, True):
        placed = labelled(members, labels)
        split = placed.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("h")).filter("l < h").select("key")
        placed = placed.filter(F.col("members") > max_bucket if exact else F.col("members") <= max_bucket)
        placed = placed.join(shuffled(split), "key", "left_semi")
        if exact:
            links = ball_links(scratch.written(placed.select("node", "label").distinct(), "apart"))
        else:
            other = placed.filter("own").select("key", F.col("node").alias("other"), F.col("label").alias("olabel"))
            links = placed.join(shuffled(other), "key").filter("label != olabel").filter(_within("node", "other")).select(F.col("node").alias("a"), F.col("other").alias("b")).distinct()
        labels = merged(labels, scratch.written(links, "links"), scratch)
    return labels


def near_copies(docs: DataFrame, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """doc_id, fp and component_id (the least doc_id of the component) of every row."""
    with Scratch(docs.sparkSession) as scratch:
        rows = scratch.written(fingerprints(docs), "fingerprints")
        nodes = scratch.written(rows.groupBy(F.col("fp").alias("node")).agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "nodes")
        labels = linked(nodes.select("node"), scratch, max_bucket)
        of_node = labelled(nodes, labels)
        least = of_node.groupBy("label").agg(F.min("least").alias("component_id"))
        # A fingerprint of very many rows is dealt to several tasks; there are 65,536 such fingerprints at most.
        salts = (F.col("n") / max(ROWS_A_TASK, rows.count() >> 16)).cast("int")
        ids = scratch.written(of_node.join(shuffled(least), "label").select(F.col("node").alias("fp"), "component_id", salts.alias("most")), "components")
        hot = rows.join(F.broadcast(ids.filter("most > 0").select("fp", "most")), "fp", "left").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.coalesce("most", F.lit(0)) + 1).cast("int"))
        spread = ids.select("fp", "component_id", F.explode(F.sequence(F.lit(0), "most")).alias("salt"))
        return written(hot.join(shuffled(spread), ["fp", "salt"]).select("doc_id", "fp", "component_id"), "near-copies")


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
