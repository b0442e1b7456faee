"""Queries on whole measures: labels, lengths, active parts, registers, key changes, tuplets, gaps and splits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stavelake.functions import notes as N
from stavelake.operators import folds, repair
from stavelake.operators import timeline as L
from stavelake.plans.registry import query
from stavelake.plans.score_queries import ALTER_SQL, PARTS, STEP_SQL, parts
from stavelake.plans.timeline_queries import CAP, DELTA, GROUPS, ONSET, M

LEADERS = "(SELECT * FROM se WHERE kind = 'note' AND is_chord = 0 AND is_grace = 0)"


@query("staff_label_by_place", f"SELECT score_id, part_no, CASE part_no WHEN 1 THEN 'S' WHEN 2 THEN 'A' WHEN 3 THEN 'P' WHEN 4 THEN 'PL' ELSE concat('P', part_no) END AS label FROM {PARTS}")
def staff_label_by_place(b):
    n = F.count("*").over(Window.partitionBy("score_id"))
    return parts(b).select("score_id", "part_no", N.staff_label_by_place(F.col("part_no"), n, F.col("name")).alias("label"))


@query("undot_in_measure", f"SELECT {M}, seq, CAST(CASE WHEN d IN (cap, 16, 8, 4, 2, 1) THEN NULL WHEN 2 * d = 3 * cap OR 4 * d = 7 * cap THEN cap WHEN d IN (24, 28) THEN 16 WHEN d IN (12, 14) THEN 8 WHEN d IN (6, 7) THEN 4 WHEN d = 3 THEN 2 WHEN d > cap THEN cap END AS BIGINT) AS base FROM (SELECT {M}, seq, CAST({CAP} AS BIGINT) AS cap, duration + x % 11 AS d FROM se WHERE kind = 'note')")
def undot_in_measure(b):
    rows = b.se.filter("kind = 'note'").withColumn("d", F.col("duration") + F.col("x") % 11)
    return rows.select(*L.MEASURE, "seq", N.undot_in_measure(F.col("d"), L.measure_length(F.col("beats"))).alias("base"))


@query("type_with_dots", f"SELECT {M}, seq, CASE WHEN abs(q - 4) < 0.02 THEN 'whole' WHEN abs(q - 2) < 0.02 THEN 'half' WHEN abs(q - 1) < 0.02 THEN 'quarter' WHEN abs(q - 0.5) < 0.02 THEN 'eighth' WHEN abs(q - 0.25) < 0.02 THEN '16th' WHEN abs(q - 0.125) < 0.02 THEN '32nd' WHEN abs(q - 0.0625) < 0.02 THEN '64th' END AS type_now FROM (SELECT {M}, seq, duration / 4 / CASE x % 4 WHEN 0 THEN CAST(1.0 AS DOUBLE) WHEN 1 THEN 1.5 WHEN 2 THEN 1.75 ELSE 1.875 END AS q FROM se WHERE kind = 'note')")
def type_with_dots(b):
    return b.se.filter("kind = 'note'").select(*L.MEASURE, "seq", N.type_of(F.col("duration"), F.col("x") % 4).alias("type_now"))


@query("rest_step", f"SELECT {M}, seq, CASE WHEN c = 'F' THEN 'D' ELSE 'B' END AS step, CASE WHEN c = 'F' THEN 3 ELSE 4 END AS octave FROM se JOIN (SELECT {M}, coalesce(last_value(clef IGNORE NULLS) OVER (PARTITION BY score_id, part_no ORDER BY measure_no), 'G') AS c FROM me) USING ({M}) WHERE kind = 'note' AND is_rest = 1")
def rest_step(b):
    clefs = b.me.select(*L.MEASURE, L.carried("clef", *L.PART, default="G").alias("clef_now"))
    step, octave = N.middle_line(F.col("clef_now"), F.lit(None).cast("int"))
    return b.se.filter("kind = 'note' and is_rest = 1").join(clefs, list(L.MEASURE)).select(*L.MEASURE, "seq", step.alias("step"), octave.alias("octave"))


@query("active_cases", "SELECT score_id, measure_no, coalesce(parts, 0) AS parts, ['silent', 'one staff', 'two staves', 'three staves', 'one to one'][least(4, coalesce(parts, 0)) + 1] AS \"case\" FROM (SELECT DISTINCT score_id, measure_no FROM me) LEFT JOIN (SELECT score_id, measure_no, count(DISTINCT part_no) AS parts FROM se WHERE kind = 'note' AND is_rest = 0 GROUP BY ALL) USING (score_id, measure_no)")
def active_cases(b):
    return repair.active_cases(b.se, b.me)


@query(
    "register_blocks",
    f"""WITH h AS (SELECT {M}, 10 * ((midi // 12 - 1) * 7 + strpos('CDEFGAB', {STEP_SQL}) - 1) + {ALTER_SQL} AS h FROM se WHERE kind = 'note' AND is_rest = 0),
p AS (SELECT {M}, min(h) AS low, sum(h) AS total, count(*) AS n FROM h GROUP BY {M}),
m AS (SELECT score_id, measure_no, count(p.n) AS parts, bool_or(p.n IS NOT NULL AND me.clef IS NOT DISTINCT FROM 'F') AS f, min(low) AS low, sum(total) AS total, sum(p.n) AS n FROM me LEFT JOIN p USING ({M}) GROUP BY score_id, measure_no),
o AS (SELECT *, row_number() OVER (PARTITION BY score_id ORDER BY measure_no) AS place FROM m),
g AS (SELECT *, place - row_number() OVER (PARTITION BY score_id ORDER BY measure_no) AS block FROM o WHERE parts = 1)
SELECT score_id, min(measure_no) AS first_measure, max(measure_no) AS last_measure, CASE WHEN bool_or(f) OR min(low) <= 220 OR sum(total) < 275 * sum(n) THEN 'men' ELSE 'women' END AS register FROM g GROUP BY score_id, block""",
)
def register_blocks(b):
    return repair.registers(b.se, b.me)


@query(
    "key_change_vote",
    """WITH b AS (SELECT *, coalesce(last_value(fifths IGNORE NULLS) OVER (PARTITION BY score_id, part_no ORDER BY measure_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM me),
c AS (SELECT score_id, measure_no, fifths, count(*) AS n FROM b WHERE fifths <> before GROUP BY ALL),
f AS (SELECT DISTINCT score_id, measure_no FROM me WHERE clef = 'F' AND fifths IS NULL),
r AS (SELECT *, row_number() OVER w AS k, lead(n) OVER w AS second FROM c WINDOW w AS (PARTITION BY score_id, measure_no ORDER BY n DESC, fifths))
SELECT score_id, measure_no, fifths, n FROM r JOIN f USING (score_id, measure_no) WHERE k = 1 AND (second IS NULL OR n > second)""",
)
def key_change_vote(b):
    return repair.key_change_votes(b.me)


@query(
    "tuplet_spans",
    f"""WITH t AS (SELECT *, count(*) FILTER (beam = 3) OVER (PARTITION BY {M} ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stops FROM {LEADERS} WHERE tuplet IS NOT NULL)
SELECT {M}, max(CASE WHEN beam = 1 THEN seq END) AS first_seq, max(CASE WHEN beam = 3 THEN seq END) AS last_seq FROM t GROUP BY {M}, stops HAVING count(*) FILTER (beam = 3) > 0 AND count(*) FILTER (beam = 1) > 0""",
)
def tuplet_spans(b):
    """The marks of this query: a tuplet note that begins a beam starts, one that ends a beam stops."""
    inside = b.se.filter(L.leader() & F.col("tuplet").isNotNull())
    return repair.tuplet_spans(inside, F.col("beam") == 1, F.col("beam") == 3)


@query(
    "apportion_rounded",
    f"""WITH s AS (SELECT *, {CAP} AS target, ({CAP} * duration) / sum(duration) OVER (PARTITION BY {M}, voice) AS raw FROM {LEADERS}),
o AS (SELECT *, greatest(1, CAST(round_even(raw, 0) AS BIGINT)) AS share0 FROM s),
d AS (SELECT *, target - sum(share0) OVER (PARTITION BY {M}, voice) AS diff, row_number() OVER (PARTITION BY {M}, voice ORDER BY raw - share0 DESC, seq) AS up,
  row_number() OVER (PARTITION BY {M}, voice ORDER BY CASE WHEN share0 < 2 THEN 1 ELSE 0 END, raw - share0, seq) AS down FROM o)
SELECT {M}, seq, CAST(share0 + CASE WHEN up <= diff THEN 1 WHEN share0 >= 2 AND down <= -diff THEN -1 ELSE 0 END AS BIGINT) AS share FROM d""",
)
def apportion_rounded(b):
    return repair.apportioned(b.se.filter(L.leader()))


@query(
    "end_gaps",
    f"""WITH e AS (SELECT {M}, beats, arg_max(greatest(0, onset + {DELTA}), seq) AS reached, bool_or(kind = 'backup') AS back, bool_or(kind = 'note' AND is_chord = 0 AND is_grace = 0) AS voiced FROM {ONSET} WHERE implicit = 0 GROUP BY {M}, beats)
SELECT {M}, CAST({CAP} - reached AS BIGINT) AS gap FROM e WHERE (back OR NOT voiced) AND {CAP} - reached > 0""",
)
def end_gaps(b):
    return repair.end_gaps(b.se)


@query(
    "split_voices",
    f"""WITH s AS (SELECT *, dense_rank() OVER (PARTITION BY {M}, staff, is_rest ORDER BY CAST(voice AS VARCHAR)) AS r, count(DISTINCT CASE WHEN is_rest = 0 THEN voice END) OVER (PARTITION BY {M}, staff) AS voices FROM se WHERE kind = 'note')
SELECT {M}, staff, seq, t AS target FROM s, unnest([1, 2]) AS u(t) WHERE voices > 1 AND (is_rest = 1 OR t = least(r, 2))""",
)
def split_voices(b):
    return repair.split_voices(b.se)


@query(
    "cap_chords",
    f"""WITH RECURSIVE s AS MATERIALIZED (SELECT {M}, seq, greatest(1, beats * 4) AS cap, {DELTA} AS d FROM se),
f AS (SELECT {M}, seq, cap, CAST(greatest(0, least(cap, d)) AS BIGINT) AS pos, CAST(greatest(0, least(cap, d)) AS BIGINT) AS moved FROM s WHERE seq = 1
  UNION ALL SELECT s.score_id, s.part_no, s.measure_no, s.seq, s.cap, CAST(greatest(0, least(s.cap, f.pos + s.d)) AS BIGINT), CAST(greatest(0, least(s.cap, f.pos + s.d)) - f.pos AS BIGINT)
  FROM f JOIN s ON s.score_id = f.score_id AND s.part_no = f.part_no AND s.measure_no = f.measure_no AND s.seq = f.seq + 1)
SELECT {M}, seq, first_value(moved) OVER (PARTITION BY {M}, g ORDER BY seq) AS moved FROM (SELECT {M}, seq, g FROM {GROUPS}) JOIN f USING ({M}, seq)""",
)
def cap_chords(b):
    return repair.capped_chords(b.se, folds.capped(b.se))
