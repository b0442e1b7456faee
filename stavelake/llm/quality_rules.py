r"""Operator 1: quality rules from line frequencies across documents.

Lines are hashed after normalising (A-Z lower-cased, white space as one space); for each host (the document's source)
the distinct texts that hold a line are counted. A line in more texts than the host's limit is boilerplate and is
removed; a document that this depletes is rejected. The base rules reject very short texts and texts that repeat
themselves.

The limit is a share of the host's texts, no less than ``least`` and no more than ``most`` of them, so that it acts on small hosts and on
very large ones; exact copies of a document count once, so copies do not turn their own lines into boilerplate. Texts are made distinct as
narrow rows of line hashes, counting combines before the shuffle, and the lines above a limit are joined back; one that very many
documents hold has a salted key, by how many they are, so a line in a third of all documents is spread over many tasks at every size.

Defined cases: a null text has no words and fails; a null host is a host; empty lines are never counted or
removed; repeated rows get equal results; an empty table gives no rows; other columns are kept by the filter and
ignored by the report.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stavelake.llm import tokens
from stavelake.llm.common import packed, table, unpacked, with_text_key, written

#: A line is boilerplate in more than SHARE of its host's texts, at least LEAST_TEXTS and at most MOST_TEXTS.
LEAST_TEXTS = 10
SHARE = 0.1
MOST_TEXTS = 1000
MIN_WORDS_LEFT = 10
MIN_SHARE_LEFT = 0.3
#: Documents of one line that one task joins.
DOCS_A_TASK = 1 << 14
WINDOW = 5
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

PROFILE = (
    "doc_id long, host string, _th long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "line_no array<int>, line_hash array<long>, line_words array<int>"
)


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, column in tokens.slices(batches):
        t = tokens.text_of(column)
        n = len(column)
        n_words = np.diff(t.word_at)
        in_word = ~tokens.SPACE[t.data]
        chars = t.per_row(in_word & ((t.data & 0xC0) != 0x80))
        symbols = t.per_row(SYMBOLS[t.data])

        row, number, begin, end = t.lines()
        first, last = np.searchsorted(t.starts, begin), np.searchsorted(t.starts, end)
        has = last > first
        row, number, begin, end, first, last = (x[has] for x in (row, number, begin, end, first, last))
        exact = tokens.hashes_of(t.data, begin, end) ^ tokens.mix(row.astype(tokens.U) + tokens.U(1))
        distinct = np.unique(exact, return_index=True)[1]
        dup_lines = np.bincount(row, minlength=n) - np.bincount(row[distinct], minlength=n)
        line_hash = tokens.hashes_of(t.folded, first, last)

        at, found = tokens.windows(t.words, t.row, WINDOW)
        at = at[tokens.repeated(found ^ tokens.mix(t.row[at].astype(tokens.U) + tokens.U(1)))]
        cover = np.zeros(len(t.row) + WINDOW + 1, np.int64)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + WINDOW, -1)
        repeat = np.bincount(t.row[np.cumsum(cover)[: len(t.row)] > 0], minlength=n)

        per_line = np.bincount(row, minlength=n)
        names = ["doc_id", "host", "_th"]
        yield pa.RecordBatch.from_arrays(
            [part.column(part.schema.get_field_index(x)) for x in names]
            + [pa.array(x, pa.int64()) for x in (n_words, chars, symbols, dup_lines, repeat)]
            + [tokens.lists(per_line, number, pa.int32()), tokens.lists(per_line, line_hash.view(np.int64), pa.int64()), tokens.lists(per_line, last - first, pa.int32())],
            names=[*names, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "line_no", "line_hash", "line_words"],
        )


def profiles(docs: DataFrame) -> DataFrame:
    """Counts and line hashes of every document: one narrow row each, written once."""
    keyed = with_text_key(docs).select("doc_id", F.col("source").alias("host"), "_th", "text")
    return written(keyed.mapInArrow(_profiles, PROFILE), "profiles")


def frequent_lines(profile: DataFrame, least: int = LEAST_TEXTS, share: float = SHARE, most: int = MOST_TEXTS) -> DataFrame:
    """(host, line, docs): the lines above their host's limit and the documents that hold them."""
    distinct = profile.groupBy("host", "_th").agg(F.first("line_hash").alias("line_hash"), F.count("*").alias("docs"))  # equal texts have equal lines
    texts = profile.select("host", "_th").distinct().groupBy("host").agg(F.count("*").alias("texts"))
    holds = distinct.select("host", "docs", F.explode(F.array_distinct("line_hash")).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n"), F.sum("docs").alias("docs"))
    holds = holds.filter(F.col("n") > min(least, most))
    same = holds["host"].eqNullSafe(texts["host"])
    limit = F.least(F.lit(float(most)), F.greatest(F.lit(float(least)), share * F.col("texts")))
    return holds.join(texts, same).filter(F.col("n") > limit).select(holds["host"], "line", "docs")


def _marked(profile: DataFrame, frequent: DataFrame) -> DataFrame:
    """(doc_id, host, _th, line_no, words) of every line to remove; the key of a line of very many documents is salted by the text."""
    lines = profile.select("doc_id", "host", "_th", F.explode(F.arrays_zip("line_no", "line_hash", "line_words")).alias("x"))
    lines = lines.select("doc_id", "host", "_th", F.col("x.line_no").alias("line_no"), F.col("x.line_hash").alias("line"), F.col("x.line_words").alias("words"))
    # Of lines in one of 4,096 documents, there are 4,096 times the lines of a document at most.
    step = max(DOCS_A_TASK, profile.count() >> 12)
    found = frequent.select(F.col("host").alias("_host"), F.col("line").alias("_line"), (F.col("docs") / step).cast("int").alias("salts"))
    same = (F.col("line") == F.col("_line")) & F.col("host").eqNullSafe(F.col("_host"))
    lines = lines.join(F.broadcast(found.filter("salts > 0")), same, "left").drop("_host", "_line")
    lines = lines.withColumn("salt", F.pmod(F.xxhash64("doc_id", "_th"), F.coalesce("salts", F.lit(0)) + 1).cast("int")).drop("salts")
    spread = found.select("_host", F.col("_line").alias("line"), F.explode(F.sequence(F.lit(0), "salts")).alias("salt"))
    return lines.join(spread, ["line", "salt"]).filter(F.col("host").eqNullSafe(F.col("_host"))).drop("_host", "salt", "line")


def verdicts(docs: DataFrame, least: int = LEAST_TEXTS, share: float = SHARE, most: int = MOST_TEXTS) -> DataFrame:
    """Per document: the base counts, base_failed, removed_words, removed_lines (their numbers) and kept."""
    profile = profiles(docs)
    frequent = written(frequent_lines(profile, least, share, most), "frequent-lines")
    removed = (
        _marked(profile, frequent)
        .distinct()
        .groupBy("doc_id", "host", "_th")
        .agg(F.sum("words").alias("removed_words"), F.collect_list("line_no").alias("removed_lines"))
        .select(F.col("doc_id").alias("_d"), F.col("host").alias("_h"), F.col("_th").alias("_t"), "removed_words", "removed_lines")
    )
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("host").eqNullSafe(F.col("_h")) & F.col("_th").eqNullSafe(F.col("_t"))
    n, gone = F.col("n_words"), F.coalesce("removed_words", F.lit(0))
    failed = (n < 10) | (100 * F.col("n_repeat_words") > 20 * n)
    depleted = (gone > 0) & ((n - gone < MIN_WORDS_LEFT) | (n - gone < MIN_SHARE_LEFT * n))
    return profile.drop("line_no", "line_hash", "line_words").join(removed, same, "left").select(
        "doc_id", "host", "_th", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), gone.alias("removed_words"), "removed_lines"
    )


def clean(docs: DataFrame, least: int = LEAST_TEXTS, share: float = SHARE, most: int = MOST_TEXTS) -> DataFrame:
    """The kept documents with their own columns, without the boilerplate lines; n_chars follows the text."""
    found = verdicts(docs, least, share, most).filter("kept").select(F.col("doc_id").alias("_d"), F.col("host").alias("_h"), F.col("_th").alias("_t"), "removed_lines").dropDuplicates(["_d", "_h", "_t"])
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("_row.source").eqNullSafe(F.col("_h")) & F.col("_th").eqNullSafe(F.col("_t"))
    left = F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains("removed_lines", i))
    changed = {"text": F.when(F.col("removed_lines").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("removed_lines").isNull(), F.col("_row.n_chars")).otherwise(F.length(changed["text"]).cast("long"))
    return unpacked(packed(docs).join(found, same), docs.columns, changed)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("removed_words").cast("long").alias("removed_words")
    )


OP1_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source AS host, coalesce(text, '') AS text,
             regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
l AS (SELECT rid, doc_id, host, text, i, parts[i] AS line FROM (SELECT *, string_split(text, chr(10)) AS parts FROM d), unnest(range(1, len(parts) + 1)) AS t(i)),
n AS (SELECT *, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS lw FROM l),
k AS (SELECT rid, host, text, line, array_to_string(lw, ' ') AS norm, len(lw) AS words FROM n WHERE len(lw) > 0),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM k GROUP BY rid),
w AS (SELECT rid, s, array_to_string(ws[s:s + 4], chr(10)) AS win FROM d, unnest(range(1, len(ws) - 3)) AS t(s) WHERE len(ws) >= 5),
rep AS (SELECT rid, win FROM w GROUP BY rid, win HAVING count(*) > 1),
cov AS (SELECT rid, count(DISTINCT i) AS n_repeat_words FROM (SELECT w.rid, unnest(range(s, s + 5)) AS i FROM w JOIN rep ON w.rid = rep.rid AND w.win = rep.win) GROUP BY rid),
texts AS (SELECT host, count(DISTINCT text) AS texts FROM d GROUP BY host),
freq AS (SELECT k.host, norm FROM k GROUP BY k.host, norm
         HAVING count(DISTINCT text) > least(1000, greatest(10, 0.1 * (SELECT texts FROM texts WHERE texts.host IS NOT DISTINCT FROM k.host)))),
gone AS (SELECT rid, sum(words) AS removed FROM k JOIN freq ON k.norm = freq.norm AND k.host IS NOT DISTINCT FROM freq.host GROUP BY rid),
j AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(removed, 0) AS BIGINT) AS removed_words
      FROM d LEFT JOIN dup USING (rid) LEFT JOIN cov USING (rid) LEFT JOIN gone USING (rid)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM j)
SELECT *, NOT base_failed AND NOT (removed_words > 0 AND (n_words - removed_words < 10 OR n_words - removed_words < 0.3 * n_words)) AS kept FROM b
"""
