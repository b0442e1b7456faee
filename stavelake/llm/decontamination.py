"""Operator 10: benchmark decontamination with DataFrame functions only.

A document word is hit when it lies in an occurrence of a benchmark window (``ngram`` consecutive words; a
shorter item is one window). The windows are a broadcast set of hashes of their normalised words, with the words: every word
position of a document is hashed with the words after it and looked up once for each length of window that the benchmark
has, and a hit is verified word by word where it was found. Only verified positions leave the scan, so a shuffle carries
hits, never the words of the corpus; the items of a window are joined to the hits afterwards, however many they are.

Defined cases: null and empty texts have no words; an empty benchmark hits nothing; equal items are all
reported; repeated documents get equal results; other columns of the input are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stavelake.llm.common import ascii_lower, packed, table, unpacked, with_text_key, written

NGRAM = 10
#: Bytes of windows (their words and a hash each) up to which they are broadcast; beyond it, Spark shuffles the positions.
MAX_BROADCAST_BYTES = 64_000_000
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD_AND_REST = r"([0-9A-Za-z[^\x00-\x7F]]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*)"


def words_of(text: Column) -> Column:
    """The words of a text with their case as it is."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def word_hashes(words: Column) -> Column:
    """Hashes of the words by lower(), which is coarser than A-Z folding; the verification is exact."""
    return F.transform(words, lambda w: F.xxhash64(F.lower(w)))


def window_key(hashes: Column, at: Column, span: int) -> Column:
    return F.xxhash64(F.lit(span), *[F.get(hashes, at + i) for i in range(span)])


def benchmark_windows(benchmark: DataFrame, ngram: int = NGRAM) -> DataFrame:
    """(win, span, item): the windows of each item, as their words joined by spaces."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(ascii_lower(F.col("text"))).alias("words")).filter(F.size("words") > 0)
    span = F.least(F.size("words"), F.lit(ngram))
    starts = F.explode(F.sequence(F.lit(0), F.size("words") - span))
    placed = items.select("item", "words", span.alias("span"), starts.alias("start"))
    return placed.select(F.expr("array_join(slice(words, start + 1, span), ' ')").alias("win"), "span", "item").distinct()


def window_hits(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(doc_id, _th, start, span, win): the verified occurrences of windows in the documents."""
    keys = windows.select("win", "span").distinct()
    about = keys.groupBy("span").agg(F.sum(F.octet_length("win") + 16).alias("bytes")).collect()  # a row for each length
    spans = sorted(r["span"] for r in about) or [1]
    one_of = lambda hashes, at: reduce(lambda rest, n: F.when(F.col("span") == n, window_key(hashes, at, n)).otherwise(rest), spans, F.lit(None).cast("long"))
    keys = keys.withColumn("key", one_of(word_hashes(F.split("win", " ")), F.lit(0)))
    words = with_text_key(docs).select("doc_id", "_th", words_of(F.col("text")).alias("words"))
    # Explode, join and verification are one generated loop: the words of a document are never copied per word.
    placed = words.withColumn("hashes", word_hashes(F.col("words"))).select("doc_id", "_th", "words", "hashes", F.posexplode("hashes").alias("start", "_h"))
    if len(spans) == 1:
        at = placed.withColumn("at_span", F.lit(spans[0])).withColumn("key", window_key(F.col("hashes"), F.col("start"), spans[0]))
    else:
        each = F.array(*[F.struct(F.lit(n).alias("at_span"), window_key(F.col("hashes"), F.col("start"), n).alias("key")) for n in spans])
        at = placed.withColumn("x", F.explode(each)).select("doc_id", "_th", "words", "start", "x.at_span", "x.key")
    at = at.filter(F.col("start") + F.col("at_span") <= F.size("words"))
    text_window = ascii_lower(F.array_join(F.expr("slice(words, start + 1, at_span)"), " "))
    # Equality, but not as a key of the join: that would spell out the window at every position, not only where the hash is met.
    equal = F.startswith(text_window, F.col("win")) & (F.octet_length(text_window) <= F.octet_length("win"))
    if sum(r["bytes"] for r in about) <= MAX_BROADCAST_BYTES:
        found = at.select("doc_id", "_th", "words", "start", "at_span", "key").join(F.broadcast(keys), "key").filter(equal)
    else:
        candidates = at.select("doc_id", "_th", "start", "at_span", "key").join(keys, "key")
        keyed = words.withColumnsRenamed({"doc_id": "_d", "_th": "_t"}).dropDuplicates(["_d", "_t"])
        same = F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("_th").eqNullSafe(F.col("_t"))
        found = candidates.join(keyed, same).filter(equal)
    return found.select("doc_id", "_th", "start", "span", "win")


def hits_by_document(docs: DataFrame, benchmark: DataFrame, ngram: int = NGRAM) -> DataFrame:
    """(doc_id, _th, hit_positions, items): one row per document with a hit; a document's own words bound it."""
    windows = written(benchmark_windows(benchmark, ngram), "windows")
    places = F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["span"] - 1))
    return (
        window_hits(docs, windows)
        .join(windows.select("win", "item"), "win")
        .groupBy("doc_id", "_th")
        .agg(F.collect_set(F.struct("start", "span")).alias("spans"), F.collect_set("item").alias("items"))
        .select(
            F.col("doc_id").alias("_hit_doc"),
            F.col("_th").alias("_hit_th"),
            F.array_distinct(F.flatten(places)).alias("hit_positions"),
            F.array_sort("items").alias("items"),
        )
    )


def _with_hits(docs: DataFrame, hits: DataFrame, how: str) -> DataFrame:
    same = F.col("doc_id").eqNullSafe(F.col("_hit_doc")) & F.col("_th").eqNullSafe(F.col("_hit_th"))
    return docs.join(hits, same, how)


def contamination_report(docs: DataFrame, benchmark: DataFrame, ngram: int = NGRAM) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every document."""
    base = with_text_key(docs).select("doc_id", "_th", F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce(F.size("hit_positions"), F.lit(0))
    n_hit = F.when(F.col("hit_positions").isNull(), 0).otherwise(n_hit)
    return _with_hits(base, hits_by_document(docs, benchmark, ngram), "left").select(
        "doc_id",
        "n_words",
        n_hit.cast("long").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", ngram: int = NGRAM) -> DataFrame:
    """The documents without benchmark text, with their own columns.

    ``remove='documents'`` drops every document with a hit; ``'spans'`` cuts the hit words with what
    separates them from the next word and keeps the rest.
    """
    keyed = packed(docs)
    hits = hits_by_document(docs, benchmark, ngram)
    if remove == "documents":
        return unpacked(_with_hits(keyed, hits, "left_anti"), docs.columns, {})
    if remove != "spans":
        raise ValueError("remove is 'documents' or 'spans'")
    joined = _with_hits(keyed, hits, "left")
    pieces = F.regexp_extract_all("text", F.lit(WORD_AND_REST), F.lit(1))
    left = F.filter(pieces, lambda piece, i: ~F.array_contains("hit_positions", i))
    head = F.regexp_extract("text", f"^{SEPARATORS}", 0)
    cut = F.when(F.col("hit_positions").isNull(), F.col("text")).otherwise(F.concat(head, F.array_join(left, "")))
    return unpacked(joined, docs.columns, {"text": cut})


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid,
             list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[s:s + least(len(ws), 10) - 1], ' ') AS win
       FROM b, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS t(s) WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT rid, s, n, array_to_string(ws[s:s + n - 1], ' ') AS win FROM d, sizes, unnest(range(1, len(ws) - n + 2)) AS t(s) WHERE len(ws) >= n),
h AS (SELECT dw.rid, dw.s, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
p AS (SELECT rid, count(DISTINCT i) AS n_hit FROM h, unnest(range(s, s + n)) AS t(i) GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS i FROM h) GROUP BY rid)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (rid) LEFT JOIN it USING (rid)
"""
