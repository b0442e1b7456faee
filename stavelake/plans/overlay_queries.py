"""Queries on the correction log, job events and folds."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stavelake.operators import folds, overlay, replay, restore
from stavelake.operators import timeline as L
from stavelake.plans.registry import query
from stavelake.plans.timeline_queries import DELTA, ONSET, M
from stavelake.streaming import jobs

KEY = "concat_ws('|', kind, CAST(score_id AS VARCHAR), CAST(part_no AS VARCHAR), CAST(measure_no AS VARCHAR), CAST(seq AS VARCHAR), CAST(arg AS VARCHAR))"


@query("fix_key", f"SELECT {KEY} AS key, min(fix_id) AS fix_id FROM fx GROUP BY 1")
def fix_key(b):
    return b.fx.groupBy(overlay.fix_key().alias("key")).agg(F.min("fix_id").alias("fix_id"))


MERGED = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY CASE WHEN kind IN ('setPlayOrder', 'setSlurPlacement') THEN concat_ws('|', kind, score_id, part_no, measure_no, seq) ELSE {KEY} END ORDER BY CASE WHEN kind IN ('setPlayOrder', 'setSlurPlacement') THEN -fix_id ELSE fix_id END) AS n FROM fx) WHERE n = 1)"


@query("fix_merge", f"SELECT fix_id, kind, {M}, seq, arg FROM {MERGED}")
def fix_merge(b):
    return overlay.merged_log(b.fx).select("fix_id", "kind", *L.MEASURE, "seq", "arg")


LAST = ", ".join(f"arg_max(arg, fix_id) FILTER (kind = '{k}') AS {c}" for k, c in (("setNoteVoice", "v"), ("setNoteStaff", "s"), ("setNotePitch", "p"), ("setPlayOrder", "o")))
TARGETS = f"SELECT {M}, seq, {LAST}, bool_or(kind = 'removeBeam') AS u, bool_or(kind = 'removeNote') AS gone, bool_or(kind = 'insertRest') AS rest"
SET_COLUMNS = "coalesce(v, voice) AS voice, coalesce(s, staff) AS staff, coalesce(p, midi) AS midi, coalesce(o, play_order) AS play_order, CASE WHEN u THEN 0 ELSE beam END AS beam"


@query("fix_set", f"SELECT {M}, seq, {SET_COLUMNS} FROM se LEFT JOIN (SELECT 'note' AS kind, * FROM ({TARGETS} FROM fx GROUP BY {M}, seq)) t USING ({M}, seq, kind)")
def fix_set(b):
    return overlay.apply_sets(b.se, b.fx).select(*L.MEASURE, "seq", "voice", "staff", "midi", "play_order", "beam")


LEAD = f"CASE WHEN kind = 'note' THEN max(CASE WHEN kind = 'note' AND is_chord = 0 THEN seq END) OVER (PARTITION BY {M} ORDER BY seq) END"
TYPE_COLUMNS = "coalesce(n, duration) AS duration, coalesce(CASE n WHEN 1 THEN '16th' WHEN 2 THEN 'eighth' WHEN 4 THEN 'quarter' WHEN 8 THEN 'half' END, type) AS type"


@query("fix_type", f"SELECT {M}, e.seq, {TYPE_COLUMNS} FROM (SELECT *, {LEAD} AS lead_seq FROM se) e LEFT JOIN (SELECT {M}, seq AS lead_seq, arg_max(arg, fix_id) AS n FROM fx WHERE kind = 'setNoteType' GROUP BY {M}, seq) t USING ({M}, lead_seq)")
def fix_type(b):
    return overlay.apply_types(b.se, b.fx).select(*L.MEASURE, "seq", "duration", "type")


FULL = f"SELECT score_id, count(*) FILTER (total <> cap) AS bad FROM (SELECT {M}, voice, greatest(1, any_value(beats) * 4) AS cap, sum(duration) AS total FROM {{}} WHERE kind = 'note' AND is_chord = 0 AND is_grace = 0 AND implicit = 0 GROUP BY {M}, voice) GROUP BY score_id"


@query(
    "regression_flag",
    f"""WITH e AS (SELECT *, {LEAD} AS lead_seq FROM se), a AS (SELECT e.* REPLACE (coalesce(n, duration) AS duration) FROM e LEFT JOIN (SELECT {M}, seq AS lead_seq, arg_max(arg, fix_id) AS n FROM fx WHERE kind = 'setNoteType' GROUP BY {M}, seq) t USING ({M}, lead_seq))
    SELECT score_id, b.bad AS bad_before, c.bad AS bad_after, c.bad > b.bad AS worse FROM ({FULL.format("se")}) b JOIN ({FULL.format("a")}) c USING (score_id)""",
)
def regression_flag(b):
    """Voices that do not fill their measure before and after the corrections of note types; a score that has more of them afterwards is flagged."""
    bad = lambda rows, name: L.measure_fullness(rows).groupBy("score_id").agg(F.count_if(F.col("state") != "full").alias(name))
    both = bad(b.se, "bad_before").join(bad(overlay.apply_types(b.se, b.fx), "bad_after"), "score_id")
    return both.select("score_id", "bad_before", "bad_after", (F.col("bad_after") > F.col("bad_before")).alias("worse"))


@query("fix_delete", f"SELECT {M}, seq, kind FROM se e WHERE NOT (kind = 'note' AND EXISTS (SELECT 1 FROM fx f WHERE f.kind = 'removeNote' AND f.score_id = e.score_id AND f.part_no = e.part_no AND f.measure_no = e.measure_no AND f.seq = e.seq))")
def fix_delete(b):
    return overlay.apply_deletes(b.se, b.fx).select(*L.MEASURE, "seq", "kind")


# An insert is applied if its measure lies at one place in all parts of the score; at is the first number that it moves.
STRUCTURE = f"""l AS (SELECT fix_id, kind, {M}, seq, arg FROM {MERGED}),
g AS (SELECT score_id, measure_no FROM (SELECT *, row_number() OVER (PARTITION BY score_id, part_no ORDER BY measure_no) AS place FROM me) JOIN (SELECT score_id, count(DISTINCT part_no) AS parts FROM me GROUP BY score_id) USING (score_id)
      GROUP BY score_id, measure_no, parts HAVING count(*) = parts AND min(place) = max(place)),
i AS (SELECT fix_id, score_id, measure_no AS anchor, kind = 'insertEmptyMeasureBefore' AS before, measure_no + CASE kind WHEN 'insertEmptyMeasureBefore' THEN 0 ELSE 1 END AS first_moved
      FROM l JOIN g USING (score_id, measure_no) WHERE kind IN ('insertEmptyMeasureBefore', 'insertEmptyMeasureAfter'))"""


@query("insert_measure", f"WITH {STRUCTURE} SELECT {M}, measure_no + (SELECT count(*) FROM i WHERE i.score_id = m.score_id AND first_moved <= measure_no) AS new_no FROM me m")
def insert_measure(b):
    log = overlay.merged_log(b.fx)
    return replay.renumbered(b.me, replay.structure_plan(b.me, log)).select(*L.MEASURE, "new_no")


@query(
    "insert_measure_rests",
    f"""WITH {STRUCTURE}, n AS (SELECT *, anchor + (SELECT count(*) FROM i o WHERE o.score_id = i.score_id AND o.first_moved <= i.anchor) AS anchor_now,
  count(*) OVER (PARTITION BY score_id, anchor, before ORDER BY fix_id DESC) AS back FROM i),
v AS (SELECT score_id, part_no, max(staff) AS staves FROM se GROUP BY score_id, part_no)
SELECT n.score_id, m.part_no, CASE WHEN before THEN anchor_now - back ELSE anchor_now + back END AS measure_no, CAST(CASE WHEN s = 1 THEN 1 ELSE 2 * s - k END AS BIGINT) AS seq, CASE k WHEN 2 THEN 'backup' ELSE 'note' END AS kind,
  CAST(CASE WHEN s = 1 THEN 1 ELSE 5 END AS BIGINT) AS voice, CAST(s AS BIGINT) AS staff, CAST(greatest(1, beats * 4) AS BIGINT) AS duration, CASE k WHEN 2 THEN 0 ELSE 1 END AS is_rest, CASE k WHEN 2 THEN NULL ELSE 'whole' END AS type
FROM n JOIN me m ON m.score_id = n.score_id AND m.measure_no = n.anchor LEFT JOIN v ON v.score_id = m.score_id AND v.part_no = m.part_no, unnest(range(1, greatest(1, coalesce(staves, 1)) + 1)) AS t(s), unnest([1, 2]) AS q(k) WHERE s > 1 OR k = 1""",
)
def insert_measure_rests(b):
    """The elements of inserted measures: default rests, a staff each."""
    return replay.default_rests(b.me, b.se, replay.structure_plan(b.me, overlay.merged_log(b.fx)))


def whole_log(b):
    stem = F.when(F.col("x") % 3 == 0, "up").when(F.col("x") % 3 == 1, "down")
    return replay.apply_all(b.me, b.by_score.withColumn("stem", stem), overlay.merged_log(b.fx))


# A replay has no SQL form: a correction may move the places that the next one names. The tests hold both against a plain program.
@query("fix_replay")
def fix_replay(b):
    """The elements after the whole log, taken in its own order."""
    return whole_log(b)[0]


@query("fix_report")
def fix_report(b):
    """Corrections that took effect or found no target, by score and kind."""
    done = whole_log(b)[1].join(b.fx.select("fix_id", "score_id", "kind"), "fix_id")
    return done.groupBy("score_id", "kind").agg(F.count_if("applied").alias("applied"), F.count_if(~F.col("applied")).alias("skipped"))


SPAN = "CASE WHEN count(place) OVER w < 2 THEN NULL WHEN place = min(place) OVER w THEN 1 WHEN place = max(place) OVER w THEN 3 WHEN place IS NOT NULL THEN 2 END"


@query("fix_span", f"SELECT {M}, seq, {SPAN} AS span FROM (SELECT e.*, CASE WHEN kind = 'note' AND seq BETWEEN lo AND lo + 2 THEN seq END AS place FROM se e LEFT JOIN (SELECT {M}, min(seq) AS lo FROM fx WHERE kind = 'applyBeam' GROUP BY {M}) s USING ({M})) WINDOW w AS (PARTITION BY {M})")
def fix_span(b):
    return overlay.beam_spans(b.se, b.fx).select(*L.MEASURE, "seq", "span")


@query("fix_insert", f"SELECT {M}, CAST(row_number() OVER (PARTITION BY {M} ORDER BY place) AS BIGINT) AS seq, is_rest, voice FROM (SELECT {M}, CAST(seq AS DOUBLE) AS place, is_rest, voice FROM se UNION ALL SELECT {M}, seq + 0.5, 1, voice FROM se e WHERE kind = 'note' AND EXISTS (SELECT 1 FROM fx f WHERE f.kind = 'insertRest' AND f.score_id = e.score_id AND f.part_no = e.part_no AND f.measure_no = e.measure_no AND f.seq = e.seq))")
def fix_insert(b):
    return overlay.apply_inserts(b.se, b.fx).select(*L.MEASURE, "seq", "is_rest", "voice")


#: As in insert_measure_rests: the default rests of the inserted measures.
NEW_RESTS = f"""n AS (SELECT *, anchor + (SELECT count(*) FROM i o WHERE o.score_id = i.score_id AND o.first_moved <= i.anchor) AS anchor_now,
  count(*) OVER (PARTITION BY score_id, anchor, before ORDER BY fix_id DESC) AS back FROM i),
v AS (SELECT score_id, part_no, max(staff) AS staves FROM se GROUP BY score_id, part_no),
r AS (SELECT n.score_id, m.part_no, CASE WHEN before THEN anchor_now - back ELSE anchor_now + back END AS measure_no, CAST(CASE WHEN s = 1 THEN 1 ELSE 2 * s - k END AS BIGINT) AS seq, CASE k WHEN 2 THEN 'backup' ELSE 'note' END AS kind,
  CAST(CASE WHEN s = 1 THEN 1 ELSE 5 END AS BIGINT) AS voice, CAST(s AS BIGINT) AS staff, CAST(greatest(1, beats * 4) AS BIGINT) AS duration, CASE k WHEN 2 THEN 0 ELSE 1 END AS is_rest, CASE k WHEN 2 THEN NULL ELSE 'whole' END AS type
FROM n JOIN me m ON m.score_id = n.score_id AND m.measure_no = n.anchor LEFT JOIN v ON v.score_id = m.score_id AND v.part_no = m.part_no, unnest(range(1, greatest(1, coalesce(staves, 1)) + 1)) AS t(s), unnest([1, 2]) AS q(k) WHERE s > 1 OR k = 1)"""
NEW_NO = "measure_no + (SELECT count(*) FROM i WHERE i.score_id = x.score_id AND i.first_moved <= x.measure_no) AS measure_no"
APPLIED = f"""WITH {STRUCTURE},
e AS (SELECT x.* REPLACE ({NEW_NO}) FROM se x), f AS (SELECT x.* REPLACE ({NEW_NO}) FROM l x WHERE kind NOT IN ('insertEmptyMeasureBefore', 'insertEmptyMeasureAfter')),
t AS (SELECT 'note' AS kind, * FROM ({TARGETS} FROM f GROUP BY {M}, seq)),
y AS (SELECT {M}, seq AS lead_seq, arg_max(arg, fix_id) AS n FROM f WHERE kind = 'setNoteType' GROUP BY {M}, seq),
a AS (SELECT {M}, e.seq, e.kind, is_rest, {SET_COLUMNS}, {TYPE_COLUMNS} FROM (SELECT *, {LEAD} AS lead_seq FROM e) e LEFT JOIN t USING ({M}, seq, kind) LEFT JOIN y USING ({M}, lead_seq) WHERE NOT coalesce(gone, false)),
h AS (SELECT {M}, seq, 36 + arg % 48 AS pitch, min(fix_id) AS fix_id FROM f WHERE kind = 'insertChordMember' GROUP BY {M}, seq, 36 + arg % 48),
j AS (SELECT {M}, seq, fix_id, arg, kind = 'insertRest' AS rest FROM f WHERE kind IN ('insertRest', 'insertNote')),
b AS (SELECT {M}, seq AS was, seq AS at_seq, 0 AS step, 0 AS nth, kind, is_rest, voice, staff, midi, play_order, beam, duration, type FROM a
      UNION ALL SELECT {M}, NULL, seq, 1, fix_id, kind, 0, voice, staff, pitch, play_order, 0, duration, type FROM a JOIN h USING ({M}, seq) WHERE kind = 'note' AND is_rest = 0 AND pitch <> midi
      UNION ALL SELECT {M}, NULL, seq, 2, fix_id, kind, CASE WHEN rest THEN 1 ELSE 0 END, voice, staff, CASE WHEN rest THEN midi ELSE 36 + arg % 48 END, play_order, 0, CASE WHEN rest THEN 1 ELSE 4 END, CASE WHEN rest THEN '16th' ELSE 'quarter' END
      FROM a JOIN j USING ({M}, seq) WHERE kind = 'note'),
c AS (SELECT b.*, row_number() OVER (PARTITION BY {M} ORDER BY at_seq, step, nth) AS seq, CASE WHEN kind = 'note' AND was BETWEEN lo AND lo + 2 THEN was END AS place FROM b LEFT JOIN (SELECT {M}, min(seq) AS lo FROM f WHERE kind = 'applyBeam' GROUP BY {M}) s USING ({M})),
{NEW_RESTS}
SELECT {M}, seq, kind, is_rest, voice, staff, midi, play_order, coalesce({SPAN}, beam) AS beam, duration, type FROM c WINDOW w AS (PARTITION BY {M})
UNION ALL SELECT {M}, seq, kind, is_rest, voice, staff, NULL, NULL, 0, duration, type FROM r"""


@query("fix_apply", APPLIED)
def fix_apply(b):
    columns = ("kind", "is_rest", "voice", "staff", "midi", "play_order", "beam", "duration", "type")
    return overlay.apply_log(b.me, b.se, b.fx, lambda rows: b.dealt(rows, "lineitem", "score_id")).select(*L.MEASURE, "seq", *columns)


@query("fix_stats", f"SELECT f.kind, count(*) FILTER (e.seq IS NOT NULL) AS applied, count(*) FILTER (e.seq IS NULL) AS skipped, count(DISTINCT CASE WHEN e.seq IS NOT NULL THEN concat_ws('|', score_id, part_no, measure_no) END) AS measures FROM fx f LEFT JOIN (SELECT {M}, seq FROM se WHERE kind = 'note') e USING ({M}, seq) GROUP BY f.kind")
def fix_stats(b):
    hits = b.se.filter("kind = 'note'").select(*L.MEASURE, "seq", F.lit(True).alias("hit"))
    rows = b.fx.join(hits, [*L.MEASURE, "seq"], "left")
    measure = F.when(F.col("hit"), F.struct(*L.MEASURE))
    return rows.groupBy("kind").agg(F.count_if("hit").alias("applied"), F.count_if(F.col("hit").isNull()).alias("skipped"), F.count_distinct(measure).alias("measures"))


@query("copy_measures", f"SELECT {M}, seq, midi FROM se WHERE NOT (part_no = 2 AND measure_no BETWEEN 3 AND 4) UNION ALL SELECT score_id, 2, measure_no, seq, midi FROM se WHERE part_no = 1 AND measure_no BETWEEN 3 AND 4")
def copy_measures(b):
    rows = b.se.select(*L.MEASURE, "seq", "midi")
    between = F.col("measure_no").between(3, 4)
    kept = rows.filter(~((F.col("part_no") == 2) & between))
    return kept.unionByName(rows.filter((F.col("part_no") == 1) & between).withColumn("part_no", F.lit(2).cast("long")))


ENDPOINT = f"(SELECT f.fix_id, f.score_id, f.part_no, f.measure_no, coalesce(min(CASE WHEN e.midi = f.arg THEN e.seq END), min(CASE WHEN e.seq = f.seq THEN e.seq END)) AS end_seq FROM fx f JOIN (SELECT * FROM se WHERE kind = 'note') e USING ({M}) WHERE f.kind = 'setNotePitch' GROUP BY ALL)"


def endpoints(b, *shifts):
    """By pitch if the measure has it, else by index; for each shift, in the measure so many later."""
    notes = b.by_measure.filter("kind = 'note'").select(*L.MEASURE, F.col("seq").alias("e"), "midi")
    fixes = b.fx.filter("kind = 'setNotePitch'").withColumn("shift", F.explode(F.array(*map(F.lit, shifts))))
    fixes = fixes.withColumn("measure_no", F.col("measure_no") + F.col("shift"))
    joined = fixes.join(notes, list(L.MEASURE))
    by_pitch = F.min(F.when(F.col("midi") == F.col("arg"), F.col("e")))
    return joined.groupBy("fix_id", *L.MEASURE, "shift").agg(F.coalesce(by_pitch, F.min(F.when(F.col("e") == F.col("seq"), F.col("e")))).alias("end_seq"))


@query("tie_endpoint", f"SELECT * FROM {ENDPOINT}")
def tie_endpoint(b):
    return endpoints(b, 0).drop("shift")


def ends(shift: int, kind: str) -> str:
    return f"SELECT *, '{kind}' AS type FROM {ENDPOINT.replace('FROM fx f', f'FROM (SELECT * REPLACE (measure_no + {shift} AS measure_no) FROM fx) f')} WHERE end_seq IS NOT NULL"


@query("tie_add", f"SELECT * FROM ({ends(0, 'start')} UNION ALL {ends(1, 'stop')}) QUALIFY count(*) OVER (PARTITION BY fix_id) = 2")
def tie_add(b):
    """A tie into the next measure: start here and stop there, where both ends are found."""
    both = endpoints(b, 0, 1).filter("end_seq is not null").withColumn("type", F.when(F.col("shift") == 0, "start").otherwise("stop")).drop("shift")
    return both.withColumn("n", F.count("*").over(Window.partitionBy("fix_id"))).filter("n = 2").drop("n")


@query("sync_mode", "SELECT user_id, CASE WHEN count(*) FILTER (event_type = 'signup') = 0 THEN 'init' WHEN count(*) FILTER (event_type = 'error') > 3 THEN 'restore' WHEN count(*) FILTER (event_type = 'click') > 20 THEN 'full' ELSE 'incremental' END AS mode FROM events GROUP BY user_id")
def sync_mode(b):
    n = lambda kind: F.count_if(F.col("event_type") == kind)
    mode = F.when(n("signup") == 0, "init").when(n("error") > 3, "restore").when(n("click") > 20, "full").otherwise("incremental")
    return b.table("events").groupBy("user_id").agg(mode.alias("mode"))


@query("is_stale", "SELECT user_id, max(CASE WHEN event_type = 'click' THEN ts END) > max(CASE WHEN event_type = 'view' THEN ts END) AS stale FROM events GROUP BY user_id")
def is_stale(b):
    last = lambda kind: F.max(F.when(F.col("event_type") == kind, F.col("ts")))
    return b.table("events").groupBy("user_id").agg((last("click") > last("view")).alias("stale"))


@query("progress_parse", "SELECT event_id, CAST(user_id % 9 + 1 AS INTEGER) AS sheet, CAST(event_id % 40 AS INTEGER) AS current, 40 AS total FROM events")
def progress_parse(b):
    return jobs.parsed_progress(b.je).select("event_id", "sheet", "current", "total")


LATEST = "WITH e AS (SELECT * FROM je), f AS (SELECT job_id, min(event_id) AS done FROM e WHERE status IN ('completed', 'failed') GROUP BY job_id) SELECT e.job_id, arg_max(e.status, e.event_id) AS status, arg_max(e.progress, e.event_id) AS progress FROM e LEFT JOIN f USING (job_id) WHERE done IS NULL OR event_id <= done GROUP BY e.job_id"


@query("job_latest", LATEST)
def job_latest(b):
    return jobs.latest_progress(b.je)


@query("job_retention", "SELECT job_id FROM je GROUP BY job_id HAVING NOT (bool_or(status IN ('completed', 'failed')) AND max(ts) < (SELECT max(ts) FROM je) - INTERVAL 24 HOUR)")
def job_retention(b):
    return jobs.retained(b.je)


@query("job_progress", "SELECT job_id, max(event_id % 40) AS furthest, count(*) AS lines FROM je GROUP BY job_id")
def job_progress(b):
    p = jobs.parsed_progress(b.je)
    return p.groupBy("job_id").agg(F.max("current").cast("long").alias("furthest"), F.count("*").alias("lines"))


@query("bundle_prefer_member", "SELECT job_id, status AS member FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY CASE status WHEN 'completed' THEN 1 WHEN 'processing' THEN 2 WHEN 'queued' THEN 3 ELSE 4 END, event_id) AS n FROM je) WHERE n = 1")
def bundle_prefer_member(b):
    rank = F.when(F.col("status") == "completed", 1).when(F.col("status") == "processing", 2).when(F.col("status") == "queued", 3).otherwise(4)
    return b.je.groupBy("job_id").agg(F.min_by("status", F.struct(rank, F.col("event_id"))).alias("member"))


@query(
    "x_clusters",
    f"""WITH RECURSIVE s AS MATERIALIZED (SELECT {M}, staff, x, seq, row_number() OVER (PARTITION BY {M}, staff ORDER BY x, seq) AS n FROM se WHERE kind = 'note'),
f AS (SELECT {M}, staff, seq, n, CAST(1 AS INTEGER) AS cluster, x AS anchor FROM s WHERE n = 1
  UNION ALL SELECT s.score_id, s.part_no, s.measure_no, s.staff, s.seq, s.n, CASE WHEN s.x - f.anchor <= 12 THEN f.cluster ELSE f.cluster + 1 END, CASE WHEN s.x - f.anchor <= 12 THEN f.anchor ELSE s.x END
  FROM f JOIN s ON s.score_id = f.score_id AND s.part_no = f.part_no AND s.measure_no = f.measure_no AND s.staff = f.staff AND s.n = f.n + 1)
SELECT {M}, staff, seq, cluster, anchor FROM f""",
)
def x_clusters(b):
    return folds.x_clusters(b.se.filter("kind = 'note'"))


STEM = "CASE x % 3 WHEN 0 THEN 'up' WHEN 1 THEN 'down' END"


@query(
    "onset_clusters",
    f"""WITH RECURSIVE n AS (SELECT *, min(seq) OVER (PARTITION BY {M}, staff) = seq AS first_note, {STEM} AS stem, CASE WHEN x % 50 = 0 THEN 1000000.0 ELSE CAST(round(x / 6) AS DOUBLE) END AS px FROM se WHERE kind = 'note' AND is_grace = 0),
v AS (SELECT {M}, staff, count(DISTINCT voice) AS voices FROM n GROUP BY {M}, staff),
s AS MATERIALIZED (SELECT {M}, staff, seq, px, stem, beam, row_number() OVER (PARTITION BY {M}, staff ORDER BY seq) AS i FROM n WHERE is_chord = 0 OR first_note),
f AS (SELECT {M}, staff, seq, i, CAST(1 AS INTEGER) AS cluster, px AS anchor, stem, beam FROM s WHERE i = 1
  UNION ALL SELECT {M}, staff, seq, i, CASE WHEN joins THEN cluster ELSE cluster + 1 END, CASE WHEN joins THEN anchor ELSE px END, stem, beam
  FROM (SELECT s.*, f.cluster, f.anchor, f.anchor < 999000 AND s.px < 999000 AND abs(s.px - f.anchor) <= CASE WHEN (f.beam = 3 AND s.beam = 0) OR (f.beam <> 0 AND s.beam IN (2, 3)) THEN 2 WHEN f.stem <> s.stem THEN 16 ELSE 2 END AS joins
        FROM f JOIN s ON s.score_id = f.score_id AND s.part_no = f.part_no AND s.measure_no = f.measure_no AND s.staff = f.staff AND s.i = f.i + 1))
SELECT {M}, staff, seq, cluster, anchor, count(*) OVER (PARTITION BY {M}, staff, cluster) AS size, count(*) OVER (PARTITION BY {M}, staff, cluster) > 1 AND voices = 1 AS repair FROM f JOIN v USING ({M}, staff)""",
)
def onset_clusters(b):
    x = F.when(F.col("x") % 50 > 0, F.round(F.col("x") / 6))
    return folds.onset_clusters(b.by_measure.withColumns({"stem": F.when(F.col("x") % 3 == 0, "up").when(F.col("x") % 3 == 1, "down"), "x": x}))


MODE = "CASE WHEN pending > 0 AND NOT has_baseline THEN 'full' WHEN pending > 0 THEN 'incremental' WHEN has_baseline AND has_raw AND total_applied = 0 AND NOT owns_edits THEN 'restore-from-raw' WHEN has_baseline THEN 'restore' ELSE 'init' END"


@query("sync_plan", f"SELECT score_id, mode, CASE WHEN mode IN ('incremental', 'restore') THEN 'baseline' WHEN has_raw THEN 'raw' END AS source, pending FROM (SELECT *, {MODE} AS mode FROM ss)")
def sync_plan(b):
    return restore.sync_plan(b.ss).select("score_id", "mode", "source", "pending")


UNDOT_CAP = "CASE WHEN duration IN (cap, 16, 8, 4, 2, 1) THEN NULL WHEN 2 * duration = 3 * cap OR 4 * duration = 7 * cap THEN cap WHEN duration = 24 OR duration = 28 THEN 16 WHEN duration = 12 OR duration = 14 THEN 8 WHEN duration = 6 OR duration = 7 THEN 4 WHEN duration = 3 THEN 2 WHEN duration > cap THEN cap END"


@query(
    "rest_trim",
    f"""WITH RECURSIVE a AS (SELECT *, CAST(greatest(1, beats * 4) AS BIGINT) AS cap FROM se WHERE kind = 'note' AND is_chord = 0 AND is_grace = 0),
t AS (SELECT *, CASE WHEN type = 'whole' THEN {UNDOT_CAP} WHEN type = 'half' THEN 8 WHEN type = 'quarter' THEN 4 WHEN type = 'eighth' THEN 2 ELSE 1 END AS target FROM a),
s AS MATERIALIZED (SELECT {M}, voice, seq, duration, CAST(CASE WHEN is_rest = 1 AND target < duration THEN duration - target ELSE 0 END AS BIGINT) AS cut, row_number() OVER (PARTITION BY {M}, voice ORDER BY seq) AS n,
  CAST(sum(duration) OVER (PARTITION BY {M}, voice) AS BIGINT) - cap AS excess FROM t),
f AS (SELECT {M}, voice, seq, n, duration - CASE WHEN cut <= excess THEN cut ELSE 0 END AS duration, excess - CASE WHEN cut <= excess THEN cut ELSE 0 END AS spare FROM s WHERE n = 1 AND excess > 0
  UNION ALL SELECT s.score_id, s.part_no, s.measure_no, s.voice, s.seq, s.n, s.duration - CASE WHEN s.cut <= f.spare THEN s.cut ELSE 0 END, f.spare - CASE WHEN s.cut <= f.spare THEN s.cut ELSE 0 END
  FROM f JOIN s ON s.score_id = f.score_id AND s.part_no = f.part_no AND s.measure_no = f.measure_no AND s.voice = f.voice AND s.n = f.n + 1)
SELECT {M}, voice, seq, duration FROM f""",
)
def rest_trim(b):
    return folds.rest_trim(b.se)


# A cursor held between two walls is the composition of clamps; the oracle composes them as (low, high, shift) with a recursion.
@query(
    "cap_full",
    f"""WITH RECURSIVE s AS MATERIALIZED (SELECT {M}, seq, greatest(1, beats * 4) AS cap, {DELTA} AS d FROM se),
f AS (SELECT {M}, seq, cap, CAST(greatest(0, least(cap, d)) AS BIGINT) AS pos, CAST(greatest(0, least(cap, d)) AS BIGINT) AS moved FROM s WHERE seq = 1
  UNION ALL SELECT s.score_id, s.part_no, s.measure_no, s.seq, s.cap, CAST(greatest(0, least(s.cap, f.pos + s.d)) AS BIGINT), CAST(greatest(0, least(s.cap, f.pos + s.d)) - f.pos AS BIGINT)
  FROM f JOIN s ON s.score_id = f.score_id AND s.part_no = f.part_no AND s.measure_no = f.measure_no AND s.seq = f.seq + 1)
SELECT {M}, seq, moved FROM f""",
)
def cap_full(b):
    return folds.capped(b.se)


# Voices of their own for this query: the view has two, the rule asks for three.
@query(
    "voice_coalesce",
    f"""WITH RECURSIVE v AS (SELECT {M}, staff, 1 + x % 4 AS voice, CAST(min(onset) AS BIGINT) AS start, CAST(sum(duration) AS BIGINT) AS total, CAST(greatest(1, any_value(beats) * 4) AS BIGINT) AS cap
  FROM {ONSET} WHERE kind = 'note' AND is_chord = 0 AND is_grace = 0 GROUP BY {M}, staff, 1 + x % 4),
r AS (SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY {M}, staff) AS n FROM v WINDOW w AS (PARTITION BY {M}, staff ORDER BY voice)),
c AS (SELECT {M}, staff, r.voice, r.start, r.total, p.voice AS pv, p.start AS ps, p.total AS pt, p.cap, r.total >= greatest(1, floor(p.cap * 0.66 + 0.5)) AS par
  FROM r JOIN (SELECT * FROM r WHERE r = 1 AND n >= 3 AND total > 0 AND total < cap) p USING ({M}, staff) WHERE r.r > 1),
k AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {M}, staff ORDER BY start, voice) AS k FROM (SELECT *, bool_or(par) OVER (PARTITION BY {M}, staff) AS any_full FROM c)
  WHERE any_full AND NOT par AND total > 0 AND pt + total <= cap + 3 AND (start <= ps + 3 OR start >= ps + pt // 2 OR start >= ps + pt - 3)),
f AS (SELECT {M}, staff, k, total <= cap - pt + 3 AS taken, CASE WHEN total <= cap - pt + 3 THEN total ELSE 0 END AS used FROM k WHERE k = 1
  UNION ALL SELECT k.score_id, k.part_no, k.measure_no, k.staff, k.k, k.total <= k.cap - k.pt - f.used + 3, f.used + CASE WHEN k.total <= k.cap - k.pt - f.used + 3 THEN k.total ELSE 0 END
  FROM f JOIN k ON k.score_id = f.score_id AND k.part_no = f.part_no AND k.measure_no = f.measure_no AND k.staff = f.staff AND k.k = f.k + 1),
t AS (SELECT k.*, sum(total) OVER w AS used, min(start) OVER w AS first_at FROM k JOIN f USING ({M}, staff, k) WHERE taken WINDOW w AS (PARTITION BY {M}, staff))
SELECT {M}, staff, voice, pv AS target, CAST(CASE WHEN first_at <= ps + 3 THEN greatest(0, cap - pt - used) WHEN first_at - ps - pt > 3 THEN first_at - ps - pt ELSE 0 END AS BIGINT) AS gap FROM t""",
)
def voice_coalesce(b):
    four = b.se.withColumn("voice", 1 + F.col("x") % 4)
    return folds.coalesced_voices(L.voice_layers(L.cursor_onset(four)), b.me.select(*L.MEASURE, "beats"))


@query("dynamics_migrate", f"SELECT {M}, seq, 'note' AS kind FROM se WHERE kind = 'note' UNION ALL SELECT {M}, seq, 'direction' FROM se WHERE kind = 'note' AND slur = 3")
def dynamics_migrate(b):
    """Dynamics on notes become directions of their own before the note."""
    notes = b.se.filter("kind = 'note'").select(*L.MEASURE, "seq", "slur")
    kinds = F.when(F.col("slur") == 3, F.array(F.lit("note"), F.lit("direction"))).otherwise(F.array(F.lit("note")))
    return notes.select(*L.MEASURE, "seq", F.explode(kinds).alias("kind"))


@query(
    "lyric_sync",
    """WITH r AS (SELECT score_id, measure_no, sum(n) OVER (PARTITION BY score_id ORDER BY measure_no) AS hi, n FROM (SELECT score_id, measure_no, count(*) AS n FROM se WHERE part_no = 1 AND kind = 'note' GROUP BY ALL)),
t AS (SELECT score_id, seq, measure_no AS old, row_number() OVER (PARTITION BY score_id ORDER BY measure_no, seq) AS k FROM se WHERE part_no = 2 AND kind = 'note'),
e AS (SELECT score_id, max(measure_no) AS last FROM r GROUP BY score_id)
SELECT t.score_id, t.k, coalesce(r.measure_no, e.last) AS measure_no FROM t JOIN e USING (score_id) LEFT JOIN r ON r.score_id = t.score_id AND t.k > r.hi - r.n AND t.k <= r.hi""",
)
def lyric_sync(b):
    """The target's syllables take the reference part's count in each measure; what is left over goes to its last measure."""
    notes = b.se.filter("kind = 'note'")
    ref = notes.filter("part_no = 1").groupBy("score_id", "measure_no").agg(F.count("*").alias("n"))
    places = ref.select("score_id", "measure_no", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("i"))
    places = places.withColumn("k", F.row_number().over(Window.partitionBy("score_id").orderBy("measure_no", "i"))).drop("i")
    last = ref.groupBy("score_id").agg(F.max("measure_no").alias("last"))
    target = notes.filter("part_no = 2").select("score_id", F.row_number().over(Window.partitionBy("score_id").orderBy("measure_no", "seq")).alias("k"))
    return target.join(last, "score_id").join(places, ["score_id", "k"], "left").select("score_id", F.col("k").cast("long").alias("k"), F.coalesce("measure_no", "last").alias("measure_no"))
