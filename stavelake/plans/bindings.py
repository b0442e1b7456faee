"""The score tables as views over the driver's tables, for Spark and as SQL for the oracle.

se: score elements (orders are measures, line items their elements); me: measures; sl: slur marks; wd: wedges; be: beams; ti: text items (document lines); gl: glyphs;
it, tt: items with boxes that may lack, and titles; rv: review rows; ink, sy: rows of system images; fx: the correction log; je: job events; ss: sessions; doc, conv: documents and conversations.
"""

from __future__ import annotations

import functools
import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stavelake.operators.timeline import MEASURE, PART

MEASURES = """
SELECT o_orderkey, CAST(floor(o_custkey / 10) AS BIGINT) AS score_id, CAST(1 + o_orderkey % 5 AS BIGINT) AS part_no,
  CAST(row_number() OVER (PARTITION BY CAST(floor(o_custkey / 10) AS BIGINT), 1 + o_orderkey % 5 ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS measure_no,
  CASE o_orderpriority WHEN '1-URGENT' THEN 2 WHEN '2-HIGH' THEN 3 ELSE 4 END AS beats,
  CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 7 - 3 WHEN o_orderkey % 4 = 1 THEN 0 END AS fifths,
  CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS new_page, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS new_system,
  CASE WHEN o_orderkey % 6 = 0 THEN 'F' WHEN o_orderkey % 6 = 1 THEN 'G' END AS clef,
  CASE WHEN o_orderkey % 9 = 0 THEN 60 + o_orderkey % 90 END AS bpm, CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE 0 END AS implicit
FROM orders"""

ELEMENTS = """
SELECT m.score_id, m.part_no, m.measure_no, CAST(e.seq AS BIGINT) AS seq,
  CASE WHEN e.seq > 1 AND e.l_linenumber = 7 THEN 'backup' WHEN e.l_linenumber = 6 THEN 'forward' ELSE 'note' END AS kind,
  CAST(1 + e.l_linenumber % 2 AS BIGINT) AS voice, CAST(1 + e.l_suppkey % 2 AS BIGINT) AS staff,
  CAST(e.l_quantity AS BIGINT) % 8 + 1 AS duration,
  CASE WHEN e.l_returnflag = 'R' THEN 1 ELSE 0 END AS is_rest,
  CASE WHEN e.seq > 1 AND e.l_linestatus = 'O' AND e.l_returnflag <> 'R' THEN 1 ELSE 0 END AS is_chord,
  CASE WHEN e.l_partkey % 17 = 0 THEN 1 ELSE 0 END AS is_grace,
  36 + e.l_partkey % 48 AS midi, m.beats, m.implicit,
  CAST(round(e.l_tax * 100) AS BIGINT) % 4 AS beam, e.l_partkey % 5 AS slur, e.l_suppkey % 3 AS wedge, e.l_partkey % 400 AS x,
  CASE CAST(e.l_quantity AS BIGINT) % 8 + 1 WHEN 1 THEN '16th' WHEN 2 THEN 'eighth' WHEN 4 THEN 'quarter' WHEN 8 THEN 'half' ELSE CASE e.l_partkey % 4 WHEN 0 THEN 'quarter' WHEN 1 THEN 'eighth' ELSE 'whole' END END AS type,
  CASE WHEN e.l_orderkey % 3 = 0 AND e.l_suppkey % 4 < 3 THEN 3 END AS tuplet,
  CASE WHEN e.l_suppkey % 5 = 0 THEN e.l_partkey % 6 + 1 END AS play_order
FROM (SELECT l.*, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate, l_partkey, l_suppkey,
             l_quantity, l_extendedprice, l_discount, l_tax) AS seq FROM lineitem l) e JOIN me m ON e.l_orderkey = m.o_orderkey"""

LINES_SPARK = "SELECT doc_id, CAST(p + 1 AS BIGINT) AS line_no, text FROM (SELECT doc_id, posexplode(split(text, '\\n')) AS (p, text) FROM documents)"
LINES_DUCK = "SELECT doc_id, CAST(i AS BIGINT) AS line_no, parts[i] AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents) d, unnest(range(1, len(parts) + 1)) AS t(i)"

TEXT_ITEMS = """
SELECT doc_id, line_no, 1 + line_no % 8 AS page, text,
  (doc_id * 37 + line_no * 101) % 540 AS x0, (doc_id * 53 + line_no * 67) % 780 AS y0,
  (doc_id * 37 + line_no * 101) % 540 + least(5 * CAST(length(text) AS BIGINT), 500) AS x1, (doc_id * 53 + line_no * 67) % 780 + 10 AS y1,
  CASE (doc_id + line_no) % 6 WHEN 0 THEN 'unknown' WHEN 1 THEN 'lyrics' WHEN 2 THEN 'title' WHEN 3 THEN 'tempo'
       WHEN 4 THEN 'page_number' ELSE 'lyrics' END AS item_type
FROM lines_v WHERE length(trim(text)) > 0"""

GLYPHS = """
SELECT l_suppkey AS doc_id, 1 + l_orderkey % 8 AS page,
  CAST(row_number() OVER (PARTITION BY l_suppkey, 1 + l_orderkey % 8 ORDER BY l_orderkey, l_linenumber, l_partkey, l_shipdate,
                     l_quantity, l_extendedprice, l_discount, l_tax) AS BIGINT) AS glyph_no,
  l_partkey % 560 AS x0, (l_orderkey * 7 + l_partkey) % 800 AS y0, CAST(4.0 + l_quantity / 2 AS DOUBLE) AS size_pt, p_brand AS fontname,
  substring(p_name, 1 + CAST(l_linenumber AS INT) % 4, 1) AS ch
FROM lineitem JOIN part ON l_partkey = p_partkey"""
DRAWN = "lineitem JOIN part ON l_partkey = p_partkey"

FIXES = """
SELECT fix_id, ts, score_id, part_no, measure_no, seq, seq + v % 4 AS to_seq, kind,
  CASE kind WHEN 'setNoteVoice' THEN v % 4 + 1 WHEN 'setNoteStaff' THEN v % 2 + 1 WHEN 'setNotePitch' THEN 36 + v % 48 WHEN 'setPlayOrder' THEN v % 9 + 1
       WHEN 'setNoteType' THEN CASE v % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 8 END ELSE v END AS arg
FROM (SELECT event_id AS fix_id, ts, CAST(floor(user_id / 10) AS BIGINT) AS score_id, 1 + user_id % 5 AS part_no,
  1 + CAST(floor(value) AS BIGINT) % 20 AS measure_no, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 6 + 1 AS seq, CAST(floor(value) AS BIGINT) AS v,
  CASE event_type WHEN 'click' THEN CASE event_id % 3 WHEN 0 THEN 'setNoteVoice' WHEN 1 THEN 'setPlayOrder' ELSE 'setNoteStaff' END
       WHEN 'view' THEN 'setNotePitch' WHEN 'error' THEN CASE event_id % 2 WHEN 0 THEN 'removeNote' ELSE 'removeBeam' END
       WHEN 'signup' THEN CASE event_id % 2 WHEN 0 THEN 'insertEmptyMeasureBefore' ELSE 'insertEmptyMeasureAfter' END
       ELSE CASE event_id % 5 WHEN 0 THEN 'setNoteType' WHEN 1 THEN 'insertRest' WHEN 2 THEN 'applyBeam' WHEN 3 THEN 'insertNote' ELSE 'insertChordMember' END END AS kind FROM events)"""

JOBS = """
SELECT event_id, ts, user_id AS job_id, CASE event_type WHEN 'click' THEN 'processing' WHEN 'view' THEN 'waiting' WHEN 'error' THEN 'failed'
       WHEN 'signup' THEN 'queued' ELSE 'completed' END AS status, CAST(floor(value) AS BIGINT) AS progress,
  concat('sheet #', CAST(user_id % 9 + 1 AS STRING), ' ', CAST(event_id % 40 AS STRING), '/', CAST(40 AS STRING)) AS line FROM events"""

#: Slur marks of notes: up to three each, with the number that they ask for and their layout attributes.
SLURS = """
SELECT score_id, part_no, measure_no, seq, k AS mark_no, staff, CASE (x * 7 + midi * 3 + seq * 5 + k * 11) % 4 WHEN 0 THEN 'start' ELSE 'stop' END AS type,
  CASE WHEN (x + midi + k) % 7 < 6 THEN 1 + (x + seq * k) % 3 END AS number, (x + midi * k) % 5 AS noise
FROM (SELECT *, CAST(1 AS BIGINT) AS k FROM se UNION ALL SELECT *, 2 FROM se WHERE midi % 2 = 0 UNION ALL SELECT *, 3 FROM se WHERE midi % 6 = 0) e
WHERE kind = 'note' AND (x * 7 + midi * 3 + seq * 5 + k * 11) % 4 < 2"""

#: Beams of the pitched leaders: the first number follows the note's beam, a second one is there for short notes.
BEAMS = """
SELECT score_id, part_no, measure_no, seq, 1 AS beam_no, CASE WHEN x % 5 > 0 THEN 1 END AS number,
  CASE beam WHEN 1 THEN 'begin' WHEN 3 THEN 'end' ELSE CASE x % 7 WHEN 0 THEN 'forward hook' WHEN 1 THEN 'backward hook' ELSE 'continue' END END AS value FROM se WHERE kind = 'note' AND is_chord = 0 AND is_rest = 0 AND beam > 0
UNION ALL SELECT score_id, part_no, measure_no, seq, 2, 2, CASE midi % 4 WHEN 0 THEN 'begin' WHEN 1 THEN 'end' WHEN 2 THEN 'continue' ELSE 'backward hook' END FROM se WHERE kind = 'note' AND is_chord = 0 AND is_rest = 0 AND duration < 6"""

#: Wedges as directions before an element; place orders them among the measure's elements.
WEDGES = """
SELECT score_id, part_no, measure_no, staff, seq, CASE wedge WHEN 1 THEN 'stop' ELSE CASE midi % 2 WHEN 0 THEN 'crescendo' ELSE 'diminuendo' END END AS type,
  1 + x % 2 AS number, CASE x % 5 WHEN 0 THEN 'above' WHEN 1 THEN 'below' END AS placement, CAST(seq AS DOUBLE) - 0.5 AS place
FROM se WHERE wedge IN (0, 1) AND (x + midi) % 3 = 0"""

INK_ROWS = 10
#: Ink of the rows of system images: every line item draws ten rows; some pages are blank, some hardly higher than a row.
INK = """
SELECT page, y + k AS y, CAST(sum(l_quantity) AS DOUBLE) AS ink
FROM (SELECT CAST(floor(l_orderkey / 32) AS BIGINT) AS page, (l_partkey * 7 + l_suppkey * 13) % 780 AS y, l_quantity FROM lineitem) l CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9)) AS t(k)
WHERE page % 19 > 0 GROUP BY page, y + k"""

SYSTEMS = """
SELECT page, CASE WHEN page % 17 = 0 THEN 12 ELSE 700 + page % 90 END AS height FROM (SELECT DISTINCT CAST(floor(o_orderkey / 32) AS BIGINT) AS page FROM orders) o"""

#: Text items of which some have no box and some were set by a user, and the title found for each document.
ITEMS = """
SELECT doc_id, line_no, page, item_type, text, doc_id % 13 = 0 AND line_no % 7 = 0 AS user_set, CASE WHEN line_no % 4 > 0 THEN x0 END AS x0, CASE WHEN line_no % 4 > 0 THEN y0 END AS y0,
  CASE WHEN line_no % 4 > 0 THEN x1 END AS x1, CASE WHEN line_no % 4 > 0 THEN y1 END AS y1 FROM ti"""

#: Review rows: of most documents only lyrics and numbers as they were found, of some with roles, places and masks of a user.
REVIEW = """
SELECT doc_id, line_no, CASE WHEN line_no % 9 = 1 THEN 'page_number' WHEN doc_id % 7 = 0 AND line_no % 31 = 5 THEN '_manual_lyric_mask' WHEN doc_id % 5 = 0 AND line_no % 17 = 3 THEN 'unknown' WHEN doc_id % 11 = 0 AND line_no % 13 = 2 THEN item_type
    WHEN line_no % 23 = 0 THEN NULL ELSE 'lyrics' END AS item_type,
  doc_id % 2 = 0 AND line_no % 17 = 3 AS user_set, CASE WHEN doc_id % 13 = 0 THEN 1 + line_no % 3 END AS part_index, CASE WHEN doc_id % 17 = 0 THEN 1 + line_no % 2 ELSE 1 END AS verse_index, CASE WHEN doc_id % 19 = 0 AND line_no % 7 = 6 THEN 2 END AS skip_notes,
  CASE WHEN doc_id % 23 = 0 AND line_no % 5 = 4 THEN ' 2 ' WHEN line_no % 3 = 0 THEN '1' END AS voice, CASE WHEN doc_id % 29 = 0 AND line_no % 8 = 7 THEN array(line_no) ELSE array() END AS rects FROM ti"""

TITLES = """
SELECT doc_id, 2 AS page, text, CASE WHEN doc_id % 3 > 0 THEN x0 + doc_id % 5 * 30 END AS x0, CASE WHEN doc_id % 3 > 0 THEN y0 + doc_id % 4 END AS y0, CASE WHEN doc_id % 3 > 0 THEN x1 + doc_id % 5 * 30 END AS x1, CASE WHEN doc_id % 3 > 0 THEN y1 + doc_id % 4 END AS y1
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS n FROM ti WHERE page = 2) t WHERE n = 1"""

#: Sessions: the last completed job of a score is its checkpoint; corrections before it are applied, later ones pending.
SESSIONS = """
SELECT s.score_id, s.score_id % 3 > 0 AS has_raw, c.at IS NOT NULL AS has_baseline, coalesce(f.pending, 0) AS pending, CASE WHEN s.score_id % 4 = 0 THEN 0 ELSE coalesce(f.before, 0) END AS total_applied,
  s.score_id % 5 = 1 AND coalesce(f.before, 0) > 0 AS owns_edits
FROM (SELECT DISTINCT score_id FROM me) s LEFT JOIN (SELECT CAST(floor(job_id / 10) AS BIGINT) AS score_id, max(ts) AS at FROM je WHERE status = 'completed' GROUP BY floor(job_id / 10)) c ON c.score_id = s.score_id
LEFT JOIN (SELECT x.score_id, count(CASE WHEN y.at IS NULL OR x.ts > y.at THEN 1 END) AS pending, count(CASE WHEN x.ts <= y.at THEN 1 END) AS before
  FROM fx x LEFT JOIN (SELECT CAST(floor(job_id / 10) AS BIGINT) AS score_id, max(ts) AS at FROM je WHERE status = 'completed' GROUP BY floor(job_id / 10)) y ON y.score_id = x.score_id GROUP BY x.score_id) f ON f.score_id = s.score_id"""

VIEWS = {"me": MEASURES, "se": ELEMENTS, "lines_v": LINES_DUCK, "ti": TEXT_ITEMS, "gl": GLYPHS, "fx": FIXES, "je": JOBS, "sl": SLURS, "wd": WEDGES, "be": BEAMS, "ink": INK, "sy": SYSTEMS, "it": ITEMS, "rv": REVIEW.replace("array(line_no)", "[line_no]").replace("array()", "[]"), "tt": TITLES, "ss": SESSIONS}
NEEDS = {"se": ["me"], "sl": ["se"], "wd": ["se"], "be": ["se"], "it": ["ti"], "rv": ["ti"], "tt": ["ti"], "ss": ["me", "je", "fx"], "ti": ["lines_v"]}


def with_bindings(sql: str) -> str:
    """``sql`` (SELECT ..., or WITH a AS ...) behind the definitions of the views that it names."""
    names: list[str] = []

    def add(name: str) -> None:
        for other in NEEDS.get(name, []):
            add(other)
        if name not in names:
            names.append(name)

    for name in VIEWS:
        if re.search(rf"\b(FROM|JOIN)\s+{name}\b", sql):
            add(name)
    body = sql.strip()
    own = [f"{n} AS ({VIEWS[n].replace('AS STRING', 'AS VARCHAR')})" for n in names]
    if not own:
        return body
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(start):
            return start + ", ".join(own) + ", " + body[len(start) :]
    return "WITH " + ", ".join(own) + " " + body


#: Rows of a large table that one task sorts or gathers. Partitions by bytes hold many times their size as sorted rows, since these columns compress well.
ROWS_A_TASK = 250_000
#: Up to so many tasks, Spark's own number of partitions does.
FEW_TASKS = 8


class Bindings:
    """The views as DataFrames. What is sorted or gathered by measures, pages or parts is dealt to as many tasks as the tables' rows ask for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @functools.cache
    def tasks(self, name: str) -> int:
        """How many tasks a table's rows ask for, by the counts that its files state."""
        return math.ceil(self.table(name).count() / ROWS_A_TASK)

    def dealt(self, rows: DataFrame, name: str, *keys: str | Column, each: int = 1) -> DataFrame:
        """``rows``, which grow with the named table (``each`` for one of its rows), by ``keys``; where a few tasks do, as they are."""
        tasks = self.tasks(name) * each
        return rows.repartition(tasks, *keys) if tasks > FEW_TASKS else rows

    def sql(self, text: str, **frames: DataFrame) -> DataFrame:
        """Spark SQL over the given frames by name."""
        for name in frames:
            text = re.sub(rf"\b(FROM|JOIN)\s+{name}\b", rf"\1 {{{name}}}", text)
        return self.spark.sql(text, **frames)

    @functools.cached_property
    def me(self) -> DataFrame:
        part = (F.expr("CAST(floor(o_custkey / 10) AS BIGINT)"), F.expr("1 + o_orderkey % 5"))
        return self.sql(MEASURES, orders=self.dealt(self.table("orders"), "orders", *part))

    @functools.cached_property
    def se(self) -> DataFrame:
        return self.sql(ELEMENTS, lineitem=self.dealt(self.table("lineitem"), "lineitem", "l_orderkey"), me=self.me)

    @functools.cached_property
    def by_measure(self) -> DataFrame:
        """The elements dealt by their measures: windows, groups and joins by measure that follow need no other shuffle."""
        return self.dealt(self.se, "lineitem", *MEASURE)

    @functools.cached_property
    def by_score(self) -> DataFrame:
        """The elements dealt by their scores, for what moves the measures of a whole score."""
        return self.dealt(self.se, "lineitem", "score_id")

    @functools.cached_property
    def by_part(self) -> DataFrame:
        """The elements dealt by their parts, for what follows a part from measure to measure."""
        return self.dealt(self.se, "lineitem", *PART)

    @functools.cached_property
    def sl(self) -> DataFrame:
        return self.sql(SLURS, se=self.se)

    @functools.cached_property
    def wd(self) -> DataFrame:
        return self.sql(WEDGES, se=self.se)

    @functools.cached_property
    def be(self) -> DataFrame:
        return self.sql(BEAMS, se=self.se)

    @functools.cached_property
    def ink(self) -> DataFrame:
        return self.sql(INK, lineitem=self.dealt(self.table("lineitem"), "lineitem", F.expr("CAST(floor(l_orderkey / 32) AS BIGINT)"), each=INK_ROWS))

    @functools.cached_property
    def sy(self) -> DataFrame:
        return self.sql(SYSTEMS, orders=self.table("orders"))

    @functools.cached_property
    def it(self) -> DataFrame:
        return self.sql(ITEMS, ti=self.ti)

    @functools.cached_property
    def rv(self) -> DataFrame:
        return self.sql(REVIEW, ti=self.ti)

    @functools.cached_property
    def tt(self) -> DataFrame:
        return self.sql(TITLES, ti=self.ti)

    @functools.cached_property
    def ss(self) -> DataFrame:
        return self.sql(SESSIONS, me=self.me, je=self.je, fx=self.fx)

    @functools.cached_property
    def ti(self) -> DataFrame:
        return self.sql(TEXT_ITEMS, lines_v=self.sql(LINES_SPARK, documents=self.table("documents")))

    @functools.cached_property
    def gl(self) -> DataFrame:
        drawn = self.table("lineitem").join(self.table("part"), F.expr("l_partkey = p_partkey"))
        return self.sql(GLYPHS.replace(DRAWN, "drawn"), drawn=self.dealt(drawn, "lineitem", "l_suppkey", F.expr("1 + l_orderkey % 8")))

    @functools.cached_property
    def fx(self) -> DataFrame:
        return self.sql(FIXES, events=self.table("events"))

    @functools.cached_property
    def je(self) -> DataFrame:
        return self.sql(JOBS, events=self.table("events"))
