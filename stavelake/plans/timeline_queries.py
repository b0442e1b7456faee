"""Queries on score timelines and their lint."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stavelake.operators import lint
from stavelake.operators import timeline as L
from stavelake.plans.registry import query

M = "score_id, part_no, measure_no"
DELTA = "CASE WHEN kind = 'backup' THEN -duration WHEN kind = 'forward' OR (kind = 'note' AND is_chord = 0 AND is_grace = 0) THEN duration ELSE 0 END"
# The oracle computes the clamped cursor from its reflection: position minus the least prefix sum before it.
ONSET = f"""(SELECT *, sum(d) OVER w - d - least(0, coalesce(min(s) OVER (PARTITION BY {M} ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS onset
  FROM (SELECT *, {DELTA} AS d, sum({DELTA}) OVER (PARTITION BY {M} ORDER BY seq) AS s FROM se) WINDOW w AS (PARTITION BY {M} ORDER BY seq))"""
CAP = "greatest(1, beats * 4)"
FULL = f"(SELECT {M}, voice, beats, sum(duration) AS total, {CAP} AS capacity FROM se WHERE kind = 'note' AND is_chord = 0 AND is_grace = 0 AND implicit = 0 GROUP BY {M}, voice, beats)"


@query("measure_fullness", f"SELECT {M}, voice, CAST(total AS BIGINT) AS total, CAST(capacity AS BIGINT) AS capacity, CASE WHEN total < capacity THEN 'measureUnderfull' WHEN total > capacity THEN 'measureOverfull' ELSE 'full' END AS state FROM {FULL}")
def measure_fullness(b):
    return L.measure_fullness(b.se)


@query("cursor_onset", f"SELECT {M}, seq, CAST(onset AS BIGINT) AS onset FROM {ONSET}")
def cursor_onset(b):
    return L.cursor_onset(b.se).select(*L.MEASURE, "seq", "onset")


VOICE = f"(SELECT *, coalesce(last_value(CASE WHEN kind = 'note' THEN voice END IGNORE NULLS) OVER (PARTITION BY {M} ORDER BY seq), 1) AS cv, {DELTA} AS d FROM se)"


@query(
    "voice_onset",
    f"""WITH v AS (SELECT *, sum(d) OVER (PARTITION BY {M}, cv ORDER BY seq) AS s FROM {VOICE})
SELECT {M}, seq, cv AS cursor_voice, CAST(s - d - least(0, coalesce(min(s) OVER (PARTITION BY {M}, cv ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS BIGINT) AS onset FROM v""",
)
def voice_onset(b):
    return L.voice_onset(b.se).select(*L.MEASURE, "seq", "cursor_voice", "onset")


ORDERED = f"""(SELECT *, sum(c) OVER (PARTITION BY {M}, staff ORDER BY onset, is_grace DESC, seq ROWS UNBOUNDED PRECEDING) AS default_order FROM
 (SELECT *, CASE WHEN is_grace = 1 OR lag(onset) OVER w IS NULL OR lag(onset) OVER w <> onset OR lag(is_grace) OVER w <> is_grace THEN 1 ELSE 0 END AS c FROM {ONSET} WHERE kind = 'note'
  WINDOW w AS (PARTITION BY {M}, staff ORDER BY onset, is_grace DESC, seq)))"""


def ordered(b):
    return L.play_order(L.cursor_onset(b.se).filter("kind = 'note'"))


@query("play_order", f"SELECT {M}, seq, CAST(default_order AS BIGINT) AS default_order FROM {ORDERED}")
def play_order(b):
    return ordered(b).select(*L.MEASURE, "seq", "default_order")


@query("doc_order", f"SELECT {M}, seq, CAST(coalesce(play_order, row_number() OVER (PARTITION BY {M}, staff ORDER BY seq)) AS BIGINT) AS effective FROM se WHERE kind = 'note'")
def doc_order(b):
    n = F.row_number().over(L.in_measure("staff"))
    return b.se.filter("kind = 'note'").select(*L.MEASURE, "seq", F.coalesce("play_order", n).cast("long").alias("effective"))


@query("rest_order_rebuild", f"SELECT {M}, seq, CASE WHEN bool_or(play_order IS NOT NULL AND is_rest = 0) OVER w AND bool_or(play_order IS NULL AND is_rest = 1) OVER w THEN CAST(default_order AS BIGINT) ELSE CAST(play_order AS BIGINT) END AS new_order FROM {ORDERED} WINDOW w AS (PARTITION BY {M}, staff)")
def rest_order_rebuild(b):
    w = Window.partitionBy(*L.MEASURE, "staff")
    some = F.bool_or(F.col("play_order").isNotNull() & (F.col("is_rest") == 0)).over(w) & F.bool_or(F.col("play_order").isNull() & (F.col("is_rest") == 1)).over(w)
    return ordered(b).select(*L.MEASURE, "seq", F.when(some, F.col("default_order")).otherwise(F.col("play_order")).cast("long").alias("new_order"))


GROUPS = f"""(SELECT *, sum(CASE WHEN is_chord = 1 AND pstaff = staff AND pvoice = voice THEN 0 ELSE 1 END) OVER (PARTITION BY {M} ORDER BY seq) AS g
 FROM (SELECT *, lag(staff) OVER w AS pstaff, lag(voice) OVER w AS pvoice FROM se WHERE kind = 'note' AND is_grace = 0 WINDOW w AS (PARTITION BY {M} ORDER BY seq)))"""


@query("chord_groups", f"SELECT {M}, seq, CAST(g AS BIGINT) AS group_no FROM {GROUPS}")
def chord_groups(b):
    return L.chord_groups(L.sounding(b.se)).select(*L.MEASURE, "seq", "group_no")


@query("voice_layers", f"SELECT {M}, staff, voice, CAST(min(onset) AS BIGINT) AS first_onset, CAST(sum(duration) AS BIGINT) AS total, count(*) AS leaders FROM {ONSET} WHERE kind = 'note' AND is_chord = 0 AND is_grace = 0 GROUP BY {M}, staff, voice")
def voice_layers(b):
    return L.voice_layers(L.cursor_onset(b.se))


CONFLICT = f"(SELECT {M}, staff, play_order FROM {ONSET} WHERE kind = 'note' AND play_order IS NOT NULL GROUP BY {M}, staff, play_order HAVING count(DISTINCT onset) > 1)"


@query("order_conflicts", f"SELECT o.score_id, o.part_no, o.measure_no, o.seq, CASE WHEN c.play_order IS NULL THEN CAST(o.play_order AS BIGINT) END AS kept FROM {ONSET} o LEFT JOIN {CONFLICT} c ON o.score_id = c.score_id AND o.part_no = c.part_no AND o.measure_no = c.measure_no AND o.staff = c.staff AND o.play_order = c.play_order WHERE o.kind = 'note'")
def order_conflicts(b):
    notes = L.cursor_onset(b.se).filter("kind = 'note'")
    w = Window.partitionBy(*L.MEASURE, "staff", "play_order")
    clash = F.col("play_order").isNotNull() & (F.min("onset").over(w) != F.max("onset").over(w))
    return notes.withColumn("_c", clash).select(*L.MEASURE, "seq", F.when(~F.col("_c"), F.col("play_order")).cast("long").alias("kept"))


@query("order_columns", f"SELECT {M}, play_order, min(x) AS x, string_agg(CAST(midi AS VARCHAR), ',' ORDER BY s) AS pitches FROM (SELECT {M}, play_order, midi, min(seq) AS s, min(x) AS x FROM se WHERE kind = 'note' AND play_order IS NOT NULL GROUP BY {M}, play_order, midi) GROUP BY {M}, play_order")
def order_columns(b):
    pitches = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.col("midi").cast("string").alias("p")))), lambda s: s["p"]))
    return b.se.filter("kind = 'note' and play_order is not null").groupBy(*L.MEASURE, "play_order").agg(F.min("x").alias("x"), F.array_join(pitches, ",").alias("pitches"))


@query("align_groups", f"SELECT {M}, staff, play_order, count(DISTINCT midi) AS pitches FROM se WHERE kind = 'note' AND play_order IS NOT NULL AND is_rest = 0 GROUP BY {M}, staff, play_order HAVING count(DISTINCT midi) >= 2")
def align_groups(b):
    g = b.se.filter("kind = 'note' and play_order is not null and is_rest = 0").groupBy(*L.MEASURE, "staff", "play_order").agg(F.count_distinct("midi").alias("pitches"))
    return g.filter("pitches >= 2")


@query("onset_groups", f"SELECT {M}, CAST(onset AS BIGINT) AS onset, count(DISTINCT voice) AS voices, min(x) AS anchor_x, max(duration) AS longest FROM {ONSET} WHERE kind = 'note' AND is_chord = 0 AND is_grace = 0 GROUP BY {M}, onset HAVING count(DISTINCT voice) >= 2")
def onset_groups(b):
    g = L.cursor_onset(b.by_measure).filter(L.leader()).groupBy(*L.MEASURE, "onset").agg(F.count_distinct("voice").alias("voices"), F.min("x").alias("anchor_x"), F.max("duration").alias("longest"))
    return g.filter("voices >= 2")


@query("asof_meter", "SELECT score_id, part_no, measure_no, coalesce(last_value(CASE WHEN o_orderkey % 5 = 0 THEN beats END IGNORE NULLS) OVER (PARTITION BY score_id, part_no ORDER BY measure_no), 4) AS meter FROM me")
def asof_meter(b):
    declared = b.me.withColumn("declared", F.when(F.col("o_orderkey") % 5 == 0, F.col("beats")))
    return declared.select(*L.MEASURE, L.carried("declared", *L.PART, default=4).alias("meter"))


@query("asof_clef", "SELECT score_id, part_no, measure_no, coalesce(last_value(clef IGNORE NULLS) OVER (PARTITION BY score_id, part_no ORDER BY measure_no), 'G') AS clef_now FROM me")
def asof_clef(b):
    return b.me.select(*L.MEASURE, L.carried("clef", *L.PART, default="G").alias("clef_now"))


@query("asof_tempo", "SELECT score_id, part_no, measure_no, last_value(bpm IGNORE NULLS) OVER (PARTITION BY score_id, part_no ORDER BY measure_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bpm_before FROM me")
def asof_tempo(b):
    return b.me.select(*L.MEASURE, L.carried("bpm", *L.PART, strict=True).alias("bpm_before"))


@query("page_first_measure", "SELECT score_id, part_no, page, min(measure_no) AS first_measure, count(*) AS measures FROM (SELECT *, CAST(1 + sum(new_page) OVER (PARTITION BY score_id, part_no ORDER BY measure_no) AS BIGINT) AS page FROM me) GROUP BY ALL")
def page_first_measure(b):
    page = 1 + F.sum("new_page").over(Window.partitionBy(*L.PART).orderBy("measure_no"))
    return b.me.withColumn("page", page).groupBy(*L.PART, "page").agg(F.min("measure_no").alias("first_measure"), F.count("*").alias("measures"))


@query("key_repair", "SELECT score_id, part_no, measure_no, CASE WHEN new_system = 1 AND fifths = 0 AND cur <> 0 THEN cur ELSE fifths END AS fixed FROM (SELECT *, coalesce(last_value(CASE WHEN fifths IS NOT NULL AND NOT (new_system = 1 AND fifths = 0) THEN fifths END IGNORE NULLS) OVER (PARTITION BY score_id, part_no ORDER BY measure_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cur FROM me)")
def key_repair(b):
    return L.key_repair(b.me).select(*L.MEASURE, F.col("key").alias("fixed"))


@query("dir_anchor", f"SELECT {M}, seq, coalesce(min(CASE WHEN kind = 'note' AND voice = 1 THEN seq END) OVER w, min(CASE WHEN kind = 'note' THEN seq END) OVER w) AS anchor FROM se WINDOW w AS (PARTITION BY {M} ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)")
def dir_anchor(b):
    w = L.following(L.in_measure())
    near = lambda c: F.first(F.when(c, F.col("seq")), ignorenulls=True).over(w)
    note = F.col("kind") == "note"
    return b.se.select(*L.MEASURE, "seq", F.coalesce(near(note & (F.col("voice") == 1)), near(note)).alias("anchor"))


@query("dir_attach", f"SELECT {M}, seq, max(CASE WHEN kind = 'note' THEN seq END) OVER (PARTITION BY {M} ORDER BY seq) AS leading_note, min(CASE WHEN kind = 'note' THEN seq END) OVER (PARTITION BY {M} ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS trailing_note FROM se")
def dir_attach(b):
    w = L.in_measure()
    note = F.when(F.col("kind") == "note", F.col("seq"))
    return b.se.select(*L.MEASURE, "seq", F.last(note, True).over(L.upto(w)).alias("leading_note"), F.first(note, True).over(w.rowsBetween(0, Window.unboundedFollowing)).alias("trailing_note"))


@query("attachable", f"SELECT {M}, seq FROM (SELECT *, lag(voice) OVER (PARTITION BY {M} ORDER BY seq) AS pv FROM se WHERE kind = 'note' AND is_rest = 0 AND is_grace = 0) WHERE NOT (is_chord = 1 AND coalesce(pv = voice, false))")
def attachable(b):
    return L.attachable(b.se).select(*L.MEASURE, "seq")


@query("note_counts", f"SELECT score_id, part_no, voice, count(*) AS n FROM (SELECT *, lag(voice) OVER (PARTITION BY {M} ORDER BY seq) AS pv FROM se WHERE kind = 'note' AND is_rest = 0 AND is_grace = 0) WHERE NOT (is_chord = 1 AND coalesce(pv = voice, false)) GROUP BY GROUPING SETS ((score_id, part_no, voice), (score_id, part_no), (score_id))")
def note_counts(b):
    keys = ["score_id", "part_no", "voice"]
    return L.attachable(b.se).groupingSets([keys, keys[:2], keys[:1]], *keys).agg(F.count("*").alias("n"))


@query("dangling", f"""SELECT {M}, seq, kind FROM (SELECT *, coalesce(max(CASE WHEN kind = 'note' THEN 1 END) OVER (PARTITION BY {M} ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS a,
 coalesce(max(CASE WHEN kind = 'note' THEN 1 END) OVER (PARTITION BY {M} ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM se) WHERE (kind = 'forward' AND a = 0) OR (kind = 'backup' AND (a = 0 OR b = 0))""")
def dangling(b):
    return L.dangling(b.se).select(*L.MEASURE, "seq", "kind")


@query("chord_beams", f"SELECT {M}, seq, CASE WHEN is_chord = 1 THEN 0 ELSE beam END AS kept FROM se WHERE kind = 'note'")
def chord_beams(b):
    return b.se.filter("kind = 'note'").select(*L.MEASURE, "seq", F.when(F.col("is_chord") == 1, 0).otherwise(F.col("beam")).cast("long").alias("kept"))


@query("score_extents", "SELECT score_id, part_no, max(measure_no) AS measures, max(staff) AS staves, max(voice) AS voices FROM se GROUP BY ALL")
def score_extents(b):
    return b.se.groupBy(*L.PART).agg(F.max("measure_no").alias("measures"), F.max("staff").alias("staves"), F.max("voice").alias("voices"))


@query("measure_stats", f"SELECT {M}, count(*) FILTER (kind = 'note' AND is_rest = 0) AS pitches, count(*) FILTER (tuplet IS NOT NULL) AS tuplets, count(*) FILTER (type = 'quarter') AS quarters, count(*) FILTER (type = 'eighth') AS eighths, count(*) FILTER (slur = 0) AS starts, count(*) FILTER (slur = 1) AS stops FROM se GROUP BY {M}")
def measure_stats(b):
    c = F.count_if
    return b.se.groupBy(*L.MEASURE).agg(
        c((F.col("kind") == "note") & (F.col("is_rest") == 0)).alias("pitches"), c(F.col("tuplet").isNotNull()).alias("tuplets"), c(F.col("type") == "quarter").alias("quarters"), c(F.col("type") == "eighth").alias("eighths"), c(F.col("slur") == 0).alias("starts"), c(F.col("slur") == 1).alias("stops")
    )


@query("median_pitch", f"SELECT {M}, staff, median(midi) AS median_midi FROM se WHERE kind = 'note' AND is_rest = 0 GROUP BY {M}, staff")
def median_pitch(b):
    return b.se.filter("kind = 'note' and is_rest = 0").groupBy(*L.MEASURE, "staff").agg(F.median("midi").alias("median_midi"))


@query("key_majority", "WITH c AS (SELECT score_id, measure_no, fifths, count(*) AS n FROM me WHERE fifths IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER w AS k, lead(n) OVER w AS second FROM c WINDOW w AS (PARTITION BY score_id, measure_no ORDER BY n DESC, fifths)) SELECT score_id, measure_no, fifths, n FROM r WHERE k = 1 AND (second IS NULL OR n > second)")
def key_majority(b):
    c = b.me.filter("fifths is not null").groupBy("score_id", "measure_no", "fifths").agg(F.count("*").alias("n"))
    w = Window.partitionBy("score_id", "measure_no").orderBy(F.col("n").desc(), "fifths")
    return c.withColumns({"k": F.row_number().over(w), "second": F.lead("n").over(w)}).filter("k = 1 and (second is null or n > second)").select("score_id", "measure_no", "fifths", "n")


EVENTS = f"""ev0 AS (SELECT *, coalesce(last_value(CASE WHEN kind IN ('backup', 'forward') THEN kind END IGNORE NULLS) OVER (PARTITION BY {M} ORDER BY seq) = 'backup', false) AS glued,
   CASE WHEN is_rest = 1 THEN concat('rest:', type) ELSE CAST(midi AS VARCHAR) END AS p FROM se),
 ev1 AS (SELECT *, greatest(1, sum(CASE WHEN glued THEN 0 ELSE 1 END) OVER (PARTITION BY {M} ORDER BY seq)) AS event_no FROM ev0 WHERE kind = 'note'),
 ev AS (SELECT {M}, event_no, string_agg(p, '+' ORDER BY seq) AS event FROM ev1 GROUP BY {M}, event_no)"""
TRAILING = f"""tr AS (SELECT t.*, r.note_seq FROM (SELECT {M}, regexp_extract(last, '^rest:(.*)$', 1) AS rest_type FROM (SELECT {M}, arg_max(event, event_no) AS last, count(*) AS n, count(*) FILTER (NOT starts_with(event, 'rest:')) AS s FROM ev GROUP BY {M})
   WHERE n >= 2 AND s >= 1 AND regexp_extract(last, '^rest:(.*)$', 1) IN ('eighth', '16th')) t
   LEFT JOIN (SELECT {M}, type AS rest_type, max(seq) AS note_seq FROM se WHERE kind = 'note' AND is_rest = 1 GROUP BY {M}, type) r USING ({M}, rest_type))"""
SWAPS = f"""lst AS (SELECT b.score_id, b.part_no, b.measure_no, coalesce(e, []) AS e FROM (SELECT DISTINCT {M} FROM se) b LEFT JOIN (SELECT {M}, list(event ORDER BY event_no) AS e FROM ev WHERE NOT starts_with(event, 'rest:') GROUP BY {M}) x USING ({M})),
 ht AS (SELECT {M}, e[-4:] AS t, lead(e) OVER (PARTITION BY score_id, part_no ORDER BY measure_no)[1:4] AS h FROM lst),
 sw AS (SELECT {M}, concat(t[-1], '>', h[1]) AS detail FROM ht WHERE len(t) >= 2 AND len(h) >= 2 AND ((t[-1] = h[1] AND t[1] = h[-1]) OR (t[-2] = h[2] AND t[-1] = h[1])))"""
RHYTHM = f"""gr AS (SELECT {M}, g, min(seq) AS seq, arg_min(staff, seq) AS staff, arg_min(voice, seq) AS voice, arg_min(type, seq) AS type, arg_min(beam, seq) AS beam, arg_min(is_rest, seq) AS is_rest, list(DISTINCT midi) FILTER (is_rest = 0) AS ps FROM {GROUPS} GROUP BY {M}, g),
 ld AS (SELECT *, lead(staff) OVER w AS s1, lead(voice) OVER w AS v1, lead(type) OVER w AS t1, lead(beam) OVER w AS b1, lead(is_rest) OVER w AS r1, lead(ps) OVER w AS p1,
   lead(staff, 2) OVER w AS s2, lead(voice, 2) OVER w AS v2, lead(type, 2) OVER w AS t2, lead(beam, 2) OVER w AS b2, lead(is_rest, 2) OVER w AS r2,
   lead(staff, 3) OVER w AS s3, lead(voice, 3) OVER w AS v3, lead(type, 3) OVER w AS t3, lead(beam, 3) OVER w AS b3, lead(is_rest, 3) OVER w AS r3 FROM gr WINDOW w AS (PARTITION BY {M} ORDER BY g)),
 rh AS (SELECT {M}, 'rhythmQuarterBeforeBeamedEighth' AS code, CAST(staff AS VARCHAR) AS detail, seq AS note_seq FROM ld WHERE is_rest = 0 AND type = 'quarter' AND beam = 0 AND s1 = staff AND v1 = voice AND r1 = 0 AND b1 <> 0 AND list_has_any(ps, p1)
   UNION ALL SELECT {M}, 'rhythmPlainQuarterPairBeforeBeams', CAST(staff AS VARCHAR), seq FROM ld WHERE is_rest = 0 AND type = 'quarter' AND beam = 0 AND s1 = staff AND s2 = staff AND s3 = staff AND v1 = voice AND v2 = voice AND v3 = voice
     AND r1 = 0 AND r2 = 0 AND r3 = 0 AND t1 = 'quarter' AND b1 = 0 AND b2 = 1 AND b3 = 3 AND t2 = 'eighth' AND t3 = 'eighth')"""
ALL_ISSUES = f"""{EVENTS}, {TRAILING}, {SWAPS}, {RHYTHM}, iss AS (SELECT * FROM rh
  UNION ALL SELECT {M}, CASE WHEN total < capacity THEN 'measureUnderfull' ELSE 'measureOverfull' END, concat_ws('/', CAST(voice AS VARCHAR), CAST(total AS VARCHAR), CAST(capacity AS VARCHAR)), NULL FROM {FULL} WHERE total <> capacity
  UNION ALL SELECT {M}, 'trailingPhantomRest', rest_type, note_seq FROM tr UNION ALL SELECT {M}, 'measureBoundaryOrderSuspect', detail, NULL FROM sw)"""


@query("rhythm_suspects", f"WITH {RHYTHM} SELECT * FROM rh")
def rhythm_suspects(b):
    return lint.rhythm_suspects(b.by_measure)


@query("trailing_rest", f"WITH {EVENTS}, {TRAILING} SELECT {M}, 'trailingPhantomRest' AS code, rest_type AS detail, note_seq FROM tr")
def trailing_rest(b):
    return lint.trailing_rests(b.se)


@query("boundary_swap", f"WITH {EVENTS}, {SWAPS} SELECT {M}, 'measureBoundaryOrderSuspect' AS code, detail, CAST(NULL AS BIGINT) AS note_seq FROM sw")
def boundary_swap(b):
    return lint.boundary_swaps(b.se)


@query("lint_issues", f"WITH {ALL_ISSUES} SELECT {M}, code, detail, note_seq FROM iss")
def lint_issues(b):
    return lint.lint_issues(b.se)


@query("lint_rollup", f"WITH {ALL_ISSUES} SELECT code, score_id, part_no, count(*) AS n FROM iss GROUP BY GROUPING SETS ((code), (score_id, part_no), ())")
def lint_rollup(b):
    return lint.rollup(lint.lint_issues(b.se))


@query("lint_filter", f"WITH {ALL_ISSUES} SELECT {M}, code, count(*) OVER () AS total FROM iss WHERE measure_no BETWEEN 3 AND 5 AND part_no = 2")
def lint_filter(b):
    """The filter is put on the elements' keys too: rules of one measure see the same rows, adjacent ones one more measure."""
    near = b.se.filter("part_no = 2 and measure_no between 3 and 6")
    rows = lint.lint_issues(near).filter("measure_no between 3 and 5")
    return rows.select(*L.MEASURE, "code", rows.agg(F.count("*")).scalar().alias("total"))


ROW_JSON = """concat('{"part_no":', part_no, ',"measure_no":', measure_no, ',"code":"', code, '"', coalesce(concat(',"detail":', nullif(to_json(detail), 'null')), ''), CASE WHEN note_seq IS NULL THEN '' ELSE concat(',"note_seq":', note_seq) END, '}')"""


@query("lint_report_json", f"""WITH {ALL_ISSUES} SELECT score_id, concat('{{"issues":[', string_agg({ROW_JSON}, ',' ORDER BY part_no, measure_no, code, detail NULLS FIRST, note_seq NULLS FIRST), '],"total":', count(*), '}}') AS report FROM iss GROUP BY score_id""")
def lint_report_json(b):
    issues = lint.lint_issues(b.se).withColumn("row", F.struct("part_no", "measure_no", "code", "detail", "note_seq"))
    return issues.groupBy("score_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list("row")).alias("issues"), F.count("*").alias("total"))).alias("report"))


@query("issue_to_fix", f"WITH {ALL_ISSUES} SELECT {M}, CASE WHEN code = 'trailingPhantomRest' THEN 'removeTrailingPhantomRest' ELSE 'setNoteType' END AS kind, note_seq FROM iss WHERE code IN ('trailingPhantomRest', 'rhythmQuarterBeforeBeamedEighth', 'rhythmPlainQuarterPairBeforeBeams')")
def issue_to_fix(b):
    return lint.suggested_fixes(lint.lint_issues(b.se))


@query("relabel_issues", f"WITH {ALL_ISSUES} SELECT {M}, code, CASE part_no WHEN 1 THEN 'S' WHEN 2 THEN 'A' WHEN 3 THEN 'T' WHEN 4 THEN 'B' ELSE concat('P', CAST(part_no AS VARCHAR)) END AS staff FROM iss")
def relabel_issues(b):
    labels = b.spark.sql("SELECT * FROM VALUES (1L, 'S'), (2L, 'A'), (3L, 'T'), (4L, 'B') AS t(part_no, label)")
    rows = lint.lint_issues(b.se).join(labels, "part_no", "left")
    return rows.select(*L.MEASURE, "code", F.coalesce("label", F.concat(F.lit("P"), F.col("part_no").cast("string"))).alias("staff"))


@query("sample_first_n", f"WITH {ALL_ISSUES} SELECT {M}, code, detail FROM (SELECT *, row_number() OVER (PARTITION BY score_id ORDER BY part_no, measure_no, code, detail, note_seq) AS n FROM iss) WHERE n <= 20")
def sample_first_n(b):
    """The first issues of each score: the limit is the feature of a report."""
    n = F.row_number().over(Window.partitionBy("score_id").orderBy("part_no", "measure_no", "code", "detail", F.col("note_seq").asc_nulls_last()))
    return lint.lint_issues(b.se).withColumn("n", n).filter("n <= 20").select(*L.MEASURE, "code", "detail")


@query("rest_missing_staff", f"SELECT {M}, 'restMissingStaff' AS code, CAST(top AS VARCHAR) AS detail, seq AS note_seq FROM (SELECT *, max(CASE WHEN x % 7 = 0 THEN NULL ELSE staff END) OVER (PARTITION BY {M}) AS top FROM se) WHERE kind = 'note' AND is_rest = 1 AND x % 7 = 0 AND top >= 2")
def rest_missing_staff(b):
    return lint.rests_without_staff(b.se.withColumn("staff", F.when(F.col("x") % 7 != 0, F.col("staff"))))


@query("rest_display_high", f"SELECT {M}, seq, midi - 2 AS suggested FROM se WHERE kind = 'note' AND is_rest = 1 AND type IN ('whole', 'half') AND midi % 12 IN (0, 2, 4)")
def rest_display_high(b):
    return b.se.filter((F.col("kind") == "note") & (F.col("is_rest") == 1) & F.col("type").isin("whole", "half") & (F.col("midi") % 12).isin(0, 2, 4)).select(*L.MEASURE, "seq", (F.col("midi") - 2).alias("suggested"))


@query("rest_display", f"SELECT r.score_id, r.part_no, r.measure_no, r.seq, v.voices >= 2 AND r.type NOT IN ('whole', 'half') AS pinned FROM se r JOIN (SELECT {M}, staff, count(DISTINCT voice) AS voices FROM se WHERE kind = 'note' GROUP BY {M}, staff) v USING ({M}, staff) WHERE r.kind = 'note' AND r.is_rest = 1")
def rest_display(b):
    voices = F.size(F.collect_set("voice").over(Window.partitionBy(*L.MEASURE, "staff")))
    notes = b.se.filter("kind = 'note'").withColumn("voices", voices)
    return notes.filter("is_rest = 1").select(*L.MEASURE, "seq", ((F.col("voices") >= 2) & ~F.col("type").isin("whole", "half")).alias("pinned"))


@query("spurious_dir", "SELECT doc_id, line_no, word FROM (SELECT doc_id, line_no, CASE line_no % 5 WHEN 0 THEN ' 2 P' WHEN 1 THEN CAST(line_no AS VARCHAR) WHEN 2 THEN 'pp p' ELSE text END AS word FROM ti) WHERE regexp_replace(word, '\\s+', '', 'g') IN ('P', 'p', '2P', '2p', 'PR', 'PL', 'R', 'L', '9') OR regexp_full_match(regexp_replace(word, '\\s+', '', 'g'), '\\d{1,3}|[Pp]{1,3}')")
def spurious_dir(b):
    n = F.col("line_no") % 5
    word = F.when(n == 0, " 2 P").when(n == 1, F.col("line_no").cast("string")).when(n == 2, "pp p").otherwise(F.col("text"))
    return b.ti.select("doc_id", "line_no", word.alias("word")).filter(lint.spurious(F.col("word")))
