r"""Operator 5: line dedup by a deletion-neighbourhood join.

A line is the words between two \n, A-Z lower-cased. Lines with equal words are copies; lines of ``min_near_words`` = 5 or
more are also copies when one word is changed, added or left out (edit bound 1 in words): of fewer words, one is more than a fifth, so
the lines are not similar by 0.8. Of each occurrence of a line, one
stays only if no earlier line (by doc_id, then line number) is within the bound.

Variants of a line are itself with one word deleted (hole at place i), hashed in constant time each from running sums of
a number for each word at its place. Equal variants with the hole at the same place point to lines that differ in that word
only; a variant that equals a whole line, to one that is one word longer. A bucket of equal variants gives its earliest member, never
its pairs, and the words of each line and of the earlier lines that its buckets name are then compared: only a true
edit distance of one word takes a line away. Only lines that share half of their words with another line (pigeonhole: one
edit leaves one half whole) emit variants, so unique lines stay out of the large join.

Defined cases: a null text has no lines; lines without words stay, unless nothing else does; a document that loses its
last line is empty in the report and gone from the filter; repeated rows of one doc_id and text: the first keeps its
lines; empty texts stay as they are; an empty table gives no rows; other columns are kept by the filter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stavelake.llm import tokens
from stavelake.llm.common import Scratch, id_of, packed, table, unpacked, with_text_key, written
from stavelake.llm.tokens import U, mix

#: One word of five is a similarity of 0.8.
MIN_NEAR_WORDS = 5
SECOND = U(0xA0761D6478BD642F)
PREFIX, SUFFIX, HOLE, WHOLE = (U(x << 40) for x in (1, 2, 3, 4))

LINES = "doc_id long, _th long, line_no int, h1 long, h2 long, k0 long, k1 long, k2 long"
WORD_BREAK = re.compile(rb"[\x20\x09-\x0D]+")
VARIANTS = "rank long, v long, u int, role int"


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def _tagged(raw: np.ndarray, tag: np.ndarray | U) -> np.ndarray:
    return mix(raw ^ mix(tag + np.zeros(len(raw), U)))


def _lines(min_near: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, column in tokens.slices(batches):
            t = tokens.text_of(column)
            row, number, begin, end = t.lines()
            first, last = np.searchsorted(t.starts, begin), np.searchsorted(t.starts, end)
            has = last > first
            row, number, first, last = (x[has] for x in (row, number, first, last))
            n = last - first
            h1 = tokens.hashes_of(t.folded, first, last)
            h2 = tokens.hashes_of(mix(t.folded ^ SECOND), first, last)
            half, other = n // 2, (n - 1) // 2
            prefix = lambda k: _tagged(tokens.hashes_of(t.folded, first, first + k), PREFIX + k.astype(U))
            suffix = lambda k: _tagged(tokens.hashes_of(t.folded, last - k, last), SUFFIX + k.astype(U))
            even = n % 2 == 0
            third = np.where(even, prefix(other), suffix(n - 1 - other))
            short = n < min_near
            keys = [pa.array(k.view(np.int64), pa.int64(), mask=short) for k in (prefix(half), suffix(n - half), third)]
            rows = pa.array(row)
            ids = [part.column(part.schema.get_field_index(x)).take(rows) for x in ("doc_id", "_th")]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(number, pa.int32()), _long(h1), _long(h2), *keys], names=["doc_id", "_th", "line_no", "h1", "h2", "k0", "k1", "k2"])

    return run


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of lines (rank, line, halves): each with a hole at every place, each without the word there, and each whole."""
    for part, column in tokens.slices(batches, "line", limit=1 << 18):
        t = tokens.text_of(column)
        n, at = np.diff(t.word_at), t.word_at[:-1]
        rank, shared = (part.column(part.schema.get_field_index(x)).to_numpy() for x in ("rank", "shared"))
        even = n % 2 == 0
        # A shared first half leaves the edit to the second, and the other way round.
        prefix = (shared & 1 > 0) | ((shared & 4 > 0) & even)
        suffix = (shared & 2 > 0) | ((shared & 4 > 0) & ~even)
        low, high = np.where(suffix, 0, (n - 1) // 2), np.where(prefix, n, n // 2 + 1)
        m = high - low
        line = np.repeat(np.arange(len(n)), m)
        place = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m - low, m)
        word, begin, end = at[line] + place, at[line], at[line] + n[line]
        of_word = np.arange(len(t.row)) - at[t.row]
        v = []
        for words in (t.folded, mix(t.folded ^ SECOND)):
            own, moved = tokens.placed(words, of_word), tokens.placed(words, of_word - 1)
            sums, moved_sums = (np.concatenate([np.zeros(1, U), np.cumsum(x)]) for x in (own, moved))
            whole = sums[at + n] - sums[at]
            blank = whole[line] - own[word]
            taken = sums[word] - sums[begin] + moved_sums[end] - moved_sums[word + 1]
            length, holes = n.astype(U), HOLE + (n[line].astype(U) << U(20)) + place.astype(U)
            v.append(np.concatenate([_tagged(blank, holes), _tagged(taken, WHOLE + length[line] - U(1)), _tagged(whole, WHOLE + length)]))
        role = np.repeat(np.array([0, 1, 2], np.int32), [len(line), len(line), len(n)])
        half = (v[1] >> U(32)).astype(np.uint32).view(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([rank[line], rank[line], rank])), _long(v[0]), pa.array(half), pa.array(role)], names=["rank", "v", "u", "role"])


def within_one_edit(a: list, b: list) -> bool:
    """Whether one word changed, added or left out, or none, makes the lists equal."""
    if abs(len(a) - len(b)) > 1:
        return False
    short = min(len(a), len(b))
    i = next((i for i in range(short) if a[i] != b[i]), short)
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rank, line, other = (b.column(b.schema.get_field_index(x)).to_pylist() for x in ("rank", "line", "other"))
        words = lambda x: [w for w in WORD_BREAK.split(x.encode().lower()) if w]  # noqa: E731  bytes fold A-Z only
        near = [r for r, x, y in zip(rank, line, other) if within_one_edit(words(x), words(y))]
        yield pa.RecordBatch.from_arrays([pa.array(near, pa.int64())], names=["rank"])


def distinct_lines(docs: DataFrame, scratch: Scratch, min_near_words: int = MIN_NEAR_WORDS) -> DataFrame:
    """One row per distinct line: h1, h2, first (doc_id, _th, line_no), and the keys of its halves."""
    keyed = with_text_key(docs).select("doc_id", "_th", "text")
    lines = keyed.mapInArrow(_lines(min_near_words), LINES)
    first = F.min(F.struct("doc_id", "_th", "line_no")).alias("first")
    return scratch.written(lines.groupBy("h1", "h2").agg(first, *[F.min(k).alias(k) for k in ("k0", "k1", "k2")]), "lines")


def near_lines(docs: DataFrame, distinct: DataFrame, scratch: Scratch) -> DataFrame:
    """(h1, h2) of the distinct lines that have an earlier line within the edit bound."""
    keys = distinct.filter("k0 is not null").select("h1", "h2", F.posexplode(F.array("k0", "k1", "k2")).alias("half", "k"))
    shared = keys.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1").select("k")
    halves = keys.join(shared, "k", "left_semi").groupBy("h1", "h2").agg(F.bit_or(F.expr("shiftleft(1, half)")).alias("shared"))
    # Sorted by first occurrence, so the number of a line tells which is earlier.
    found = distinct.select("h1", "h2", "first").join(halves, ["h1", "h2"]).orderBy("first")
    ranked = scratch.written(found.withColumn("rank", F.monotonically_increasing_id()), "ranked")
    live = ranked.groupBy(F.col("first.doc_id").alias("_d"), F.col("first._th").alias("_t")).agg(
        F.collect_list(F.struct(F.col("first.line_no").alias("line_no"), "rank", "shared")).alias("live")
    )
    keyed = with_text_key(docs).select("doc_id", "_th", F.split("text", "\n").alias("parts"))
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("_th").eqNullSafe(F.col("_t"))
    of_line = F.transform("live", lambda x: F.struct(x["rank"].alias("rank"), x["shared"].alias("shared"), F.get("parts", x["line_no"]).alias("line")))
    texts = scratch.written(keyed.join(live, same).select(F.inline(of_line)).dropDuplicates(["rank"]), "live-lines")
    variants = scratch.written(texts.mapInArrow(_variants, VARIANTS), "variants")
    by_role = [F.min(F.when(F.col("role") == r, F.col("rank"))).alias(name) for r, name in ((0, "hole"), (1, "taken"), (2, "whole"))]
    buckets = variants.groupBy("v", "u").agg(F.count("*").alias("n"), *by_role).filter("n > 1").drop("n")
    met = variants.join(buckets, ["v", "u"])
    earliest = F.when(F.col("role") == 0, F.col("hole")).when(F.col("role") == 1, F.col("whole")).otherwise(F.col("taken"))
    pairs = scratch.written(met.select("rank", earliest.alias("earlier")).filter("earlier < rank").distinct(), "pairs")
    other = texts.select(F.col("rank").alias("earlier"), F.col("line").alias("other"))
    both = pairs.join(texts.select("rank", "line"), "rank").join(other, "earlier")
    near = both.select("rank", "line", "other").mapInArrow(_verified, "rank long").distinct()
    return ranked.join(near, "rank", "left_semi").select("h1", "h2")


def kept_lines(docs: DataFrame, min_near_words: int = MIN_NEAR_WORDS) -> DataFrame:
    """(_d, _t, keep): the line numbers that stay, for each document with any."""
    with Scratch(docs.sparkSession) as scratch:
        distinct = distinct_lines(docs, scratch, min_near_words)
        stay = distinct.join(near_lines(docs, distinct, scratch), ["h1", "h2"], "left_anti")
        return written(stay.groupBy(F.col("first.doc_id").alias("_d"), F.col("first._th").alias("_t")).agg(F.collect_list("first.line_no").alias("keep")), "kept-lines")


def deduplicated(docs: DataFrame, min_near_words: int = MIN_NEAR_WORDS) -> DataFrame:
    """doc_id, text and ``_row`` (the other columns) with ``_clean`` (their text without repeated lines), ``_lines`` and ``_kept`` (lines with words)."""
    once = Window.partitionBy("_id", "_th").orderBy("_id")
    kept = kept_lines(docs, min_near_words).select(id_of(F.col("_d")).alias("_id"), F.col("_t").alias("_th"), "keep")
    joined = packed(docs).withColumn("_id", id_of(F.col("doc_id"))).join(kept, ["_id", "_th"], "left").withColumn("_copy", F.row_number().over(once))
    keep = F.when(F.col("_copy") == 1, F.coalesce("keep", F.array().cast("array<int>"))).otherwise(F.array().cast("array<int>"))
    joined = joined.withColumn("_keep", keep)
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    has_word = lambda line: F.rlike(line, F.lit(r"[^\x20\x09-\x0D]"))
    left = F.filter(lines, lambda line, i: ~has_word(line) | F.array_contains("_keep", i))
    n_lines = F.size(F.filter(lines, has_word))
    clean = F.when((n_lines == 0) | (F.size("_keep") == n_lines), F.col("text")).when(F.size("_keep") == 0, "").otherwise(F.array_join(left, "\n"))
    return joined.withColumns({"_clean": clean, "_lines": n_lines.cast("long"), "_kept": F.size("_keep").cast("long")})


def without_repeated_lines(docs: DataFrame, min_near_words: int = MIN_NEAR_WORDS) -> DataFrame:
    """The documents with their own columns; those whose every line was a copy are gone."""
    changed = {"text": F.col("_clean")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("_lines") == F.col("_kept"), F.col("_row.n_chars")).otherwise(F.length("_clean").cast("long"))
    return unpacked(deduplicated(docs, min_near_words).filter("_lines = 0 or _kept > 0"), docs.columns, changed)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents")).select(
        "doc_id", F.col("_lines").alias("n_lines"), F.col("_kept").alias("n_kept"), F.length(F.coalesce("_clean", F.lit(""))).cast("long").alias("n_chars_kept"), F.sha2(F.coalesce("_clean", F.lit("")), 256).alias("text_sha256")
    )


OP5_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
l AS (SELECT doc_id, i, parts[i] AS line, regexp_extract_all(translate(parts[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
      FROM d, unnest(range(1, len(parts) + 1)) AS t(i)),
u AS (SELECT array_to_string(ws, ' ') AS norm, any_value(ws) AS ws, min(doc_id * 1000000 + i) AS pos FROM l WHERE len(ws) > 0 GROUP BY 1),
v AS (SELECT pos, j, len(ws) AS n, array_to_string(list_concat(ws[:j - 1], ['_' || chr(1)], ws[j + 1:]), ' ') AS hole,
             array_to_string(list_concat(ws[:j - 1], ws[j + 1:]), ' ') AS taken
      FROM u, unnest(range(1, len(ws) + 1)) AS t(j) WHERE len(ws) >= 5),
holes AS (SELECT hole, n, j, min(pos) AS pos FROM v GROUP BY ALL),
near AS (SELECT v.pos FROM v JOIN holes h ON v.hole = h.hole AND v.n = h.n AND v.j = h.j WHERE h.pos < v.pos
         UNION SELECT v.pos FROM v JOIN u ON v.taken = u.norm WHERE len(u.ws) >= 5 AND u.pos < v.pos
         UNION SELECT u.pos FROM v JOIN u ON v.taken = u.norm WHERE len(u.ws) >= 5 AND v.pos < u.pos),
stay AS (SELECT pos FROM u WHERE pos NOT IN (SELECT pos FROM near)),
m AS (SELECT l.doc_id, i, line, len(ws) > 0 AS word, stay.pos IS NOT NULL AS keep FROM l LEFT JOIN stay ON stay.pos = l.doc_id * 1000000 + i),
g AS (SELECT doc_id, count(*) FILTER (word) AS n_lines, count(*) FILTER (keep) AS n_kept, string_agg(line, chr(10) ORDER BY i) FILTER (keep OR NOT word) AS left_text FROM m GROUP BY doc_id),
c AS (SELECT d.doc_id, n_lines, n_kept, CASE WHEN n_lines = n_kept THEN text WHEN n_kept = 0 THEN '' ELSE left_text END AS clean FROM d JOIN g USING (doc_id))
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_kept AS BIGINT) AS n_kept, CAST(length(clean) AS BIGINT) AS n_chars_kept, sha256(clean) AS text_sha256 FROM c
"""
