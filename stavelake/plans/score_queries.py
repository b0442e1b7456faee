"""Queries on notes, parts, lyrics and repairs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stavelake.functions import notes as N
from stavelake.operators import timeline as L
from stavelake.plans.registry import query
from stavelake.plans.timeline_queries import CAP, GROUPS, ONSET, M

STEP_SQL = "['C','C','D','D','E','F','F','G','G','A','A','B'][midi % 12 + 1]"
ALTER_SQL = "CASE WHEN midi % 12 IN (1, 3, 6, 8, 10) THEN 1 ELSE 0 END"


def notes(b):
    return b.se.filter("kind = 'note'")


@query("transpose", f"SELECT {M}, seq, greatest(0, least(127, midi + greatest(-24, least(24, part_no * 12 - 36)))) AS new_midi FROM se WHERE kind = 'note' AND is_rest = 0")
def transpose(b):
    return notes(b).filter("is_rest = 0").select(*L.MEASURE, "seq", N.transpose(F.col("midi"), F.col("part_no") * 12 - 36).alias("new_midi"))


@query("diatonic", f"SELECT {M}, seq, CAST((midi // 12 - 1) * 7 + strpos('CDEFGAB', {STEP_SQL}) - 1 AS BIGINT) AS idx, round(CAST((midi // 12 - 1) * 7 AS DOUBLE) + strpos('CDEFGAB', {STEP_SQL}) - 1 + 0.1 * {ALTER_SQL}, 4) AS height FROM se WHERE kind = 'note'")
def diatonic(b):
    step, alter, octave = N.spelling(F.col("midi"))
    i = N.diatonic_index(step, octave)
    return notes(b).select(*L.MEASURE, "seq", i.cast("long").alias("idx"), F.round(i + 0.1 * alter, 4).alias("height"))


@query("pitch_id", f"SELECT {M}, seq, CASE WHEN is_rest = 1 THEN concat('rest:', type) ELSE concat({STEP_SQL}, CAST({ALTER_SQL} AS VARCHAR), ':', CAST(midi // 12 - 1 AS VARCHAR)) END AS pitch FROM se WHERE kind = 'note'")
def pitch_id(b):
    step, alter, octave = N.spelling(F.col("midi"))
    sounding = F.concat(step, alter.cast("string"), F.lit(":"), octave.cast("string"))
    return notes(b).select(*L.MEASURE, "seq", F.when(F.col("is_rest") == 1, F.concat(F.lit("rest:"), "type")).otherwise(sounding).alias("pitch"))


@query("note_units", f"SELECT {M}, seq, CAST({CAP} AS BIGINT) AS capacity, round(CAST(CASE type WHEN 'whole' THEN 16 WHEN 'half' THEN 8 WHEN 'quarter' THEN 4 WHEN 'eighth' THEN 2 ELSE 1 END * [1.0, 1.5, 1.75][x % 3 + 1] AS DOUBLE), 4) AS units FROM se WHERE kind = 'note'")
def note_units(b):
    dots = F.element_at(F.array(*map(F.lit, N.DOTS)), (F.col("x") % 3 + 1).cast("int"))
    return notes(b).select(*L.MEASURE, "seq", L.measure_length(F.col("beats")).alias("capacity"), F.round(N.type_units(F.col("type")) * dots, 4).alias("units"))


_TYPES = ", ".join(f"({i}, '{k}', {d}, {u * f})" for i, (k, u, d, f) in enumerate((k, u, d, f) for k, u in N.TYPE_UNITS for d, f in enumerate(N.DOTS)))


@query("closest_type", f"SELECT {M}, seq, type_found, dots FROM (SELECT s.*, t.k AS type_found, t.d AS dots, row_number() OVER (PARTITION BY {M}, seq ORDER BY abs(duration - t.u), t.i) AS n FROM se s, (VALUES {_TYPES}) AS t(i, k, d, u) WHERE kind = 'note') WHERE n = 1")
def closest_type(b):
    found = N.closest_type(F.col("duration"))
    return notes(b).select(*L.MEASURE, "seq", found["type"].alias("type_found"), found["dots"].alias("dots"))


@query("infer_type", f"SELECT {M}, seq, CASE WHEN x % 4 = 0 THEN CASE duration WHEN 1 THEN '16th' WHEN 2 THEN 'eighth' WHEN 3 THEN 'eighth' WHEN 4 THEN 'quarter' WHEN 5 THEN 'quarter' WHEN 6 THEN 'quarter' WHEN 7 THEN 'quarter' ELSE 'half' END ELSE type END AS type_now FROM se WHERE kind = 'note'")
def infer_type(b):
    given = F.when(F.col("x") % 4 != 0, F.col("type"))
    return notes(b).select(*L.MEASURE, "seq", F.coalesce(given, N.closest_type(F.col("duration"))["type"]).alias("type_now"))


@query("undot", f"SELECT {M}, seq, CAST(CASE duration WHEN 3 THEN 2.0 WHEN 6 THEN 4.0 WHEN 7 THEN 4.0 END AS DOUBLE) AS base FROM se WHERE kind = 'note'")
def undot(b):
    return notes(b).select(*L.MEASURE, "seq", N.undot(F.col("duration")).alias("base"))


@query("voice_norm", "SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '*' WHEN 1 THEN CAST(turn AS VARCHAR) WHEN 2 THEN 'x' ELSE '*' END AS voice FROM conversations")
def voice_norm(b):
    t = F.col("turn")
    raw = F.when(t % 4 == 0, "All").when(t % 4 == 1, F.concat(F.lit("0"), t.cast("string"))).when(t % 4 == 2, " x ").otherwise("*")
    return b.table("conversations").select("conv_id", "turn", N.voice_norm(raw).alias("voice"))


@query("page_estimate", "SELECT score_id, part_no, measure_no, measure_no + 4 AS printed, CAST(least(6, floor((measure_no - 1) * 6 / top) + 1) AS BIGINT) AS page FROM (SELECT *, max(measure_no) OVER (PARTITION BY score_id) AS top FROM me)")
def page_estimate(b):
    top = F.max("measure_no").over(Window.partitionBy("score_id"))
    page = F.least(F.lit(6), F.floor((F.col("measure_no") - 1) * 6 / top) + 1)
    return b.me.select(*L.MEASURE, (F.col("measure_no") + 4).alias("printed"), page.cast("long").alias("page"))


PART_NAME_SQL = "CASE part_no WHEN 1 THEN 'Soprano' WHEN 2 THEN 'Alto voice' WHEN 3 THEN 'Piano' WHEN 4 THEN 'Piano Left' ELSE 'Strings' END"
PARTS = f"(SELECT DISTINCT score_id, part_no, {PART_NAME_SQL} AS name FROM me)"


def parts(b):
    p = F.col("part_no")
    name = F.when(p == 1, "Soprano").when(p == 2, "Alto voice").when(p == 3, "Piano").when(p == 4, "Piano Left").otherwise("Strings")
    return b.me.select("score_id", "part_no").distinct().withColumn("name", name)


@query("staff_label", f"SELECT score_id, part_no, CASE part_no WHEN 1 THEN 'S' WHEN 2 THEN 'A' WHEN 3 THEN 'P' WHEN 4 THEN 'PL' ELSE concat('P', CAST(part_no AS VARCHAR)) END AS label FROM {PARTS}")
def staff_label(b):
    n = F.count("*").over(Window.partitionBy("score_id"))
    return parts(b).select("score_id", "part_no", N.staff_label(F.col("part_no"), n, F.col("name")).alias("label"))


@query("label_names", f"SELECT score_id, part_no, CASE part_no WHEN 1 THEN 'Soprano' WHEN 2 THEN 'Alto' WHEN 3 THEN 'Piano' WHEN 4 THEN 'Piano' ELSE name END AS full_name, substr(CASE part_no WHEN 1 THEN 'Soprano' WHEN 2 THEN 'Alto' WHEN 3 THEN 'Piano' WHEN 4 THEN 'Piano' ELSE name END, 1, 3) AS short_name FROM {PARTS}")
def label_names(b):
    names = F.create_map(*[F.lit(x) for p in {"S": "Soprano", "A": "Alto", "T": "Tenor", "B": "Bass", "P": "Piano", "PL": "Piano", "PR": "Piano"}.items() for x in p])
    n = F.count("*").over(Window.partitionBy("score_id"))
    full = F.coalesce(F.element_at(names, N.staff_label(F.col("part_no"), n, F.col("name"))), "name")
    return parts(b).select("score_id", "part_no", full.alias("full_name"), F.substring(full, 1, 3).alias("short_name"))


@query("labels_fallback", f"SELECT score_id, part_no, CASE WHEN score_id % 3 = 0 THEN concat('X', CAST(part_no AS VARCHAR)) WHEN score_id % 3 = 1 THEN concat('V', CAST(part_no AS VARCHAR)) ELSE name END AS label FROM {PARTS}")
def labels_fallback(b):
    """Explicit labels, then saved ones, then the preset; a source counts only if none of its labels is blank."""
    p = parts(b)
    source = lambda rows, rank, label: rows.select("score_id", "part_no", F.lit(rank).alias("rank"), label.alias("label"))
    mark = lambda c: F.concat(F.lit(c), F.col("part_no").cast("string"))
    explicit = source(p.filter("score_id % 3 <= 1"), 1, F.when(F.col("score_id") % 3 == 1, F.when(F.col("part_no") > 1, mark("X")).otherwise("")).otherwise(mark("X")))
    both = explicit.unionByName(source(p.filter("score_id % 3 = 1"), 2, mark("V"))).unionByName(source(p, 3, F.col("name")))
    whole = F.min(F.length("label")).over(Window.partitionBy("score_id", "rank")) > 0
    usable = both.withColumn("whole", whole).filter("whole")
    return usable.groupBy("score_id", "part_no").agg(F.min_by("label", "rank").alias("label"))


@query("staff_map", "SELECT score_id, staff_no, CASE WHEN staff_no <= 4 THEN staff_no ELSE 5 END AS part_no, CASE WHEN staff_no <= 4 THEN 1 ELSE staff_no - 4 END AS staff_in_part, CAST(CASE WHEN staff_no = 6 THEN 5 ELSE 1 END AS BIGINT) AS voice FROM (SELECT DISTINCT score_id FROM me), (SELECT unnest(range(1, 7)) AS staff_no)")
def staff_map(b):
    """Global staff numbers to parts by running staff counts (four of one staff, a piano of two)."""
    scores = b.me.select("score_id").distinct()
    counts = scores.select("score_id", F.posexplode(F.array(*map(F.lit, (1, 1, 1, 1, 2)))).alias("p", "staves"))
    end = F.sum("staves").over(Window.partitionBy("score_id").orderBy("p"))
    ranges = counts.select("score_id", (F.col("p") + 1).cast("long").alias("part_no"), (end - F.col("staves")).alias("before"), "staves")
    rows = ranges.select("*", F.explode(F.sequence(F.lit(1), F.col("staves"))).alias("k"))
    voice = F.when((F.col("staves") == 2) & (F.col("k") == 2), 5).otherwise(1)
    return rows.select("score_id", (F.col("before") + F.col("k")).cast("long").alias("staff_no"), "part_no", F.col("k").cast("long").alias("staff_in_part"), voice.cast("long").alias("voice"))


@query("clef_by_label", "SELECT score_id, part_no, measure_no, CASE WHEN part_no IN (1, 2) THEN CASE WHEN measure_no = 1 THEN 'G' WHEN clef = 'F' THEN NULL ELSE clef END WHEN part_no = 4 AND measure_no = 1 THEN 'F' ELSE clef END AS clef FROM me")
def clef_by_label(b):
    p, m, clef = F.col("part_no"), F.col("measure_no"), F.col("clef")
    high = F.when(m == 1, "G").when(F.coalesce(clef, F.lit("")) != "F", clef)
    return b.me.select(*L.MEASURE, F.when(p.isin(1, 2), high).when((p == 4) & (m == 1), "F").otherwise(clef).alias("clef"))


TIE_SQL = "CASE WHEN midi >= CASE WHEN clef_now = 'G' THEN 71 ELSE 50 END THEN 'above' ELSE 'below' END"


@query("tie_placement", f"SELECT {M}, seq, {TIE_SQL} AS side, CASE WHEN midi >= CASE WHEN clef_now = 'G' THEN 71 ELSE 50 END THEN 'down' ELSE 'up' END AS stem FROM se JOIN (SELECT score_id, part_no, measure_no, coalesce(last_value(clef IGNORE NULLS) OVER (PARTITION BY score_id, part_no ORDER BY measure_no), 'G') AS clef_now FROM me) USING ({M}) WHERE kind = 'note' AND is_rest = 0")
def tie_placement(b):
    clefs = b.me.select(*L.MEASURE, L.carried("clef", *L.PART, default="G").alias("clef_now"))
    middle = F.when(F.col("clef_now") == "G", 71).otherwise(50)
    high = F.col("midi") >= middle
    return notes(b).filter("is_rest = 0").join(clefs, list(L.MEASURE)).select(*L.MEASURE, "seq", F.when(high, "above").otherwise("below").alias("side"), F.when(high, "down").otherwise("up").alias("stem"))


@query("onset_x", f"SELECT {M}, seq, round(40 + least(1.0, onset / CAST({CAP} AS DOUBLE)) * 200, 2) AS px FROM {ONSET} WHERE kind = 'note'")
def onset_x(b):
    cap = L.measure_length(F.col("beats"))
    return L.cursor_onset(b.se).filter("kind = 'note'").select(*L.MEASURE, "seq", F.round(40 + F.least(F.lit(1.0), F.col("onset") / cap) * 200, 2).alias("px"))


@query("tuplet_staccato", f"SELECT {M}, seq, CASE WHEN tuplet IS NOT NULL AND beam <> 0 THEN 0 ELSE CASE WHEN x % 6 = 0 THEN 1 ELSE 0 END END AS staccato FROM se WHERE kind = 'note'")
def tuplet_staccato(b):
    given = F.when(F.col("x") % 6 == 0, 1).otherwise(0)
    return notes(b).select(*L.MEASURE, "seq", F.when(F.col("tuplet").isNotNull() & (F.col("beam") != 0), 0).otherwise(given).alias("staccato"))


@query("strip_attrs", f"SELECT {M}, seq, 2 + CASE WHEN x % 2 = 0 THEN 1 ELSE 0 END AS kept FROM se")
def strip_attrs(b):
    drawn = ("default-x", "default-y", "width")
    attrs = F.create_map(F.lit("default-x"), F.col("x").cast("string"), F.lit("width"), F.lit("9"), F.lit("voice"), F.col("voice").cast("string"), F.lit("staff"), F.col("staff").cast("string"), F.when(F.col("x") % 2 == 0, "color").otherwise("default-y"), F.lit("1"))
    return b.se.select(*L.MEASURE, "seq", F.size(F.map_filter(attrs, lambda k, v: ~k.isin(*drawn))).alias("kept"))


@query("lyric_slots", f"SELECT {M}, seq, CAST(row_number() OVER (PARTITION BY score_id, part_no ORDER BY measure_no, seq) AS BIGINT) AS slot FROM (SELECT *, lag(voice) OVER (PARTITION BY {M} ORDER BY seq) AS pv FROM se WHERE kind = 'note' AND is_rest = 0 AND is_grace = 0) WHERE NOT (is_chord = 1 AND coalesce(pv = voice, false))")
def lyric_slots(b):
    slot = F.row_number().over(Window.partitionBy(*L.PART).orderBy("measure_no", "seq"))
    return L.attachable(b.se).select(*L.MEASURE, "seq", slot.cast("long").alias("slot"))


SLOTS = f"(SELECT {M}, seq, duration, voice, row_number() OVER (PARTITION BY score_id, part_no ORDER BY measure_no, seq) AS slot FROM (SELECT *, lag(voice) OVER (PARTITION BY {M} ORDER BY seq) AS pv FROM se WHERE kind = 'note' AND is_rest = 0 AND is_grace = 0) WHERE NOT (is_chord = 1 AND coalesce(pv = voice, false)))"
SYLL = "(SELECT score_id, part_no, word, row_number() OVER (PARTITION BY score_id, part_no ORDER BY doc_id, i) AS slot FROM (SELECT doc_id, doc_id % (SELECT max(score_id) + 1 FROM me) AS score_id, 1 + doc_id % 5 AS part_no, i, string_split(text, ' ')[i] AS word FROM documents, unnest(range(1, len(string_split(text, ' ')) + 1)) AS t(i)))"


def syllables(b):
    words = b.table("documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("i", "word"))
    scores = b.me.agg(F.max("score_id") + 1).scalar()
    rows = words.select((F.col("doc_id") % scores).alias("score_id"), (1 + F.col("doc_id") % 5).alias("part_no"), "doc_id", "i", "word")
    return rows.withColumn("slot", F.row_number().over(Window.partitionBy("score_id", "part_no").orderBy("doc_id", "i")))


def slots(b):
    return L.attachable(b.by_part).withColumn("slot", F.row_number().over(Window.partitionBy(*L.PART).orderBy("measure_no", "seq")))


def placed(b, notes):
    """The syllables on the notes of the same slot."""
    key = (*L.PART, "slot")
    notes = b.dealt(notes.select(*L.MEASURE, "seq", "slot"), "lineitem", *key)
    return notes.join(syllables(b).select(*key, "word"), list(key)).select(*L.MEASURE, "seq", "word")


@query("lyric_zip", f"SELECT n.score_id, n.part_no, n.measure_no, n.seq, y.word FROM {SLOTS} n JOIN {SYLL} y ON n.score_id = y.score_id AND n.part_no = y.part_no AND n.slot = y.slot")
def lyric_zip(b):
    """The k-th syllable of a part goes on its k-th attachable note."""
    return placed(b, slots(b))


@query("lyric_zip_voice", f"SELECT n.score_id, n.part_no, n.measure_no, n.seq, y.word FROM (SELECT *, row_number() OVER (PARTITION BY score_id, part_no ORDER BY measure_no, seq) AS k FROM (SELECT *, max(CASE WHEN voice = 1 THEN seq END) OVER (PARTITION BY {M}) AS last_own FROM {SLOTS}) WHERE voice = 1 OR last_own IS NULL OR seq > last_own) n JOIN {SYLL} y ON n.score_id = y.score_id AND n.part_no = y.part_no AND n.k = y.slot")
def lyric_zip_voice(b):
    """The k-th syllable of a part goes on the k-th note that voice 1 sings; in the rest of a measure without that voice, those are the notes of any voice."""
    one = L.sung_by(slots(b), 1).withColumn("slot", F.row_number().over(Window.partitionBy(*L.PART).orderBy("measure_no", "seq")))
    return placed(b, one)


@query(
    "lyric_proportional",
    f"""WITH s AS (SELECT *, sum(duration) OVER (PARTITION BY {M} ORDER BY seq) AS hi, sum(duration) OVER (PARTITION BY {M}) AS total FROM {SLOTS}),
y AS (SELECT {M}, unnest(range(0, CAST(n AS BIGINT))) AS i, n FROM (SELECT {M}, count(*) % 4 + 1 AS n FROM {SLOTS} GROUP BY {M}))
SELECT s.score_id, s.part_no, s.measure_no, s.seq, y.i AS syllable FROM s JOIN y USING ({M}) WHERE 2 * y.n * (hi - duration) <= (2 * y.i + 1) * total AND (2 * y.i + 1) * total < 2 * y.n * hi""",
)
def lyric_proportional(b):
    """Syllable i of n falls on the note whose share of the measure holds (i + 1/2) / n; whole numbers keep the ends exact."""
    w = Window.partitionBy(*L.MEASURE)
    s = slots(b).withColumns({"hi": F.sum("duration").over(w.orderBy("seq")), "total": F.sum("duration").over(w), "n": F.count("*").over(w) % 4 + 1})
    rows = s.withColumn("syllable", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    mid = (2 * F.col("syllable") + 1) * F.col("total")
    return rows.filter((2 * F.col("n") * (F.col("hi") - F.col("duration")) <= mid) & (mid < 2 * F.col("n") * F.col("hi"))).select(*L.MEASURE, "seq", "syllable")


@query("section_map", "SELECT score_id, part_no, measure_no, CASE WHEN measure_no BETWEEN 1 AND 4 THEN 'S' WHEN measure_no BETWEEN 3 AND 8 THEN 'A' END AS target FROM me")
def section_map(b):
    """Measure ranges to targets; the first listed range wins, and a measure in none has no target."""
    spec = b.spark.sql("SELECT * FROM VALUES (1, 1L, 4L, 'S'), (2, 3L, 8L, 'A') AS t(ord, lo, hi, target)")
    wide = spec.select("ord", "target", F.explode(F.sequence("lo", "hi")).alias("measure_no"))
    first = wide.groupBy("measure_no").agg(F.min_by("target", "ord").alias("target"))
    return b.me.join(first, "measure_no", "left").select(*L.MEASURE, "target")


@query("active_parts", "SELECT score_id, measure_no, count(DISTINCT part_no) AS parts, string_agg(DISTINCT CAST(part_no AS VARCHAR), ',' ORDER BY CAST(part_no AS VARCHAR)) AS listed FROM se WHERE kind = 'note' AND is_rest = 0 GROUP BY score_id, measure_no")
def active_parts(b):
    g = notes(b).filter("is_rest = 0").groupBy("score_id", "measure_no").agg(F.array_sort(F.collect_set(F.col("part_no").cast("string"))).alias("p"))
    return g.select("score_id", "measure_no", F.size("p").cast("long").alias("parts"), F.array_join("p", ",").alias("listed"))


@query("piano_part", "SELECT score_id, coalesce(max(CASE WHEN staff = 2 AND part_no < 5 THEN part_no END), CASE WHEN count(DISTINCT part_no) >= 5 THEN max(part_no) END) AS piano FROM se GROUP BY score_id")
def piano_part(b):
    two = F.max(F.when((F.col("staff") == 2) & (F.col("part_no") < 5), F.col("part_no")))
    return b.se.groupBy("score_id").agg(F.coalesce(two, F.when(F.count_distinct("part_no") >= 5, F.max("part_no"))).alias("piano"))


SOLO = "(SELECT score_id, measure_no, min(part_no) AS part_no FROM (SELECT DISTINCT score_id, measure_no, part_no FROM se WHERE kind = 'note' AND is_rest = 0) GROUP BY score_id, measure_no HAVING count(*) = 1)"
BLOCKS = f"(SELECT score_id, part_no, measure_no, measure_no - row_number() OVER (PARTITION BY score_id, part_no ORDER BY measure_no) AS grp FROM {SOLO})"


def solo_blocks(b):
    active = notes(b).filter("is_rest = 0").groupBy("score_id", "measure_no").agg(F.collect_set("part_no").alias("p")).filter(F.size("p") == 1)
    rows = active.select("score_id", "measure_no", F.element_at("p", 1).alias("part_no"))
    return rows.withColumn("grp", F.col("measure_no") - F.row_number().over(Window.partitionBy("score_id", "part_no").orderBy("measure_no")))


@query("solo_blocks", f"SELECT score_id, part_no, min(measure_no) AS first_measure, max(measure_no) AS last_measure FROM {BLOCKS} GROUP BY score_id, part_no, grp")
def solo_blocks_query(b):
    return solo_blocks(b).groupBy("score_id", "part_no", "grp").agg(F.min("measure_no").alias("first_measure"), F.max("measure_no").alias("last_measure")).drop("grp")


@query("register_class", f"SELECT score_id, part_no, min(measure_no) AS first_measure, CASE WHEN min(midi) <= 40 OR avg(midi) < 57.5 THEN 'men' ELSE 'women' END AS register FROM {BLOCKS} JOIN (SELECT score_id, part_no, measure_no, midi FROM se WHERE kind = 'note' AND is_rest = 0) USING (score_id, part_no, measure_no) GROUP BY score_id, part_no, grp")
def register_class(b):
    pitches = notes(b).filter("is_rest = 0").select(*L.MEASURE, "midi")
    g = solo_blocks(b).join(pitches, list(L.MEASURE)).groupBy("score_id", "part_no", "grp").agg(F.min("measure_no").alias("first_measure"), F.min("midi").alias("low"), F.avg("midi").alias("mean"))
    return g.select("score_id", "part_no", "first_measure", F.when((F.col("low") <= 40) | (F.col("mean") < 57.5), "men").otherwise("women").alias("register"))


@query("densify_rests", "SELECT s.score_id, p.part_no, s.measure_no, 'rest' AS content, s.beats * 4 AS duration FROM (SELECT score_id, measure_no, max(beats) AS beats FROM me GROUP BY score_id, measure_no) s JOIN (SELECT DISTINCT score_id, part_no FROM me) p ON p.score_id = s.score_id LEFT JOIN me m ON m.score_id = s.score_id AND m.part_no = p.part_no AND m.measure_no = s.measure_no WHERE m.measure_no IS NULL")
def densify_rests(b):
    """A whole-measure rest wherever a part of the score lacks a measure that another part has."""
    measures = b.me.groupBy("score_id", "measure_no").agg(F.max("beats").alias("beats"))
    grid = measures.join(b.me.select(*L.PART).distinct(), "score_id")
    return grid.join(b.me, list(L.MEASURE), "left_anti").select(*L.MEASURE, F.lit("rest").alias("content"), (F.col("beats") * 4).alias("duration"))


@query("renumber", "SELECT score_id, part_no, measure_no, CAST(measure_no + CASE WHEN measure_no > 5 THEN 2 ELSE 0 END AS BIGINT) AS shifted, CAST(row_number() OVER (PARTITION BY score_id ORDER BY part_no, measure_no) AS BIGINT) AS joined FROM me")
def renumber(b):
    m = F.col("measure_no")
    return b.me.select(*L.MEASURE, (m + F.when(m > 5, 2).otherwise(0)).cast("long").alias("shifted"), F.row_number().over(Window.partitionBy("score_id").orderBy("part_no", "measure_no")).cast("long").alias("joined"))


@query("page_union", "SELECT score_id, part_no, measure_no, page, CAST(row_number() OVER (PARTITION BY score_id, part_no ORDER BY page, measure_no) AS BIGINT) AS number FROM (SELECT *, CAST(1 + sum(new_page) OVER (PARTITION BY score_id, part_no ORDER BY measure_no) AS BIGINT) AS page FROM me)")
def page_union(b):
    """Pages are numbered from 1 each; their union numbers on, by the measures of the pages before."""
    page = 1 + F.sum("new_page").over(Window.partitionBy(*L.PART).orderBy("measure_no"))
    pages = b.me.withColumn("page", page.cast("long"))
    pages = pages.withColumn("own", F.row_number().over(Window.partitionBy(*L.PART, "page").orderBy("measure_no")))
    before = F.sum("n").over(Window.partitionBy(*L.PART).orderBy("page").rowsBetween(Window.unboundedPreceding, -1))
    offsets = pages.groupBy(*L.PART, "page").agg(F.count("*").alias("n")).withColumn("offset", F.coalesce(before, F.lit(0)))
    joined = pages.join(offsets, [*L.PART, "page"])
    return joined.select(*L.MEASURE, "page", (F.col("own") + F.col("offset")).cast("long").alias("number"))


@query("beam_runs", f"""WITH b AS (SELECT *, sum(CASE WHEN beam IN (0, 1) THEN 1 ELSE 0 END) OVER (PARTITION BY {M}, staff, voice ORDER BY seq) AS run FROM se WHERE kind = 'note' AND is_chord = 0),
r AS (SELECT *, count(*) OVER w AS n, first_value(beam) OVER (PARTITION BY {M}, staff, voice, run ORDER BY seq) AS f, last_value(beam) OVER (PARTITION BY {M}, staff, voice, run ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l,
  count(*) FILTER (beam = 3) OVER w AS ends FROM b WINDOW w AS (PARTITION BY {M}, staff, voice, run))
SELECT {M}, seq, CASE WHEN f = 1 AND l = 3 AND ends = 1 AND n >= 2 THEN beam ELSE 0 END AS kept FROM r""")
def beam_runs(b):
    """Beams of runs that do not go from one begin to one end over two notes or more are taken off."""
    keys = (*L.MEASURE, "staff", "voice")
    w = Window.partitionBy(*keys).orderBy("seq")
    runs = notes(b).filter("is_chord = 0").withColumn("run", F.sum(F.col("beam").isin(0, 1).cast("int")).over(w))
    r = Window.partitionBy(*keys, "run")
    good = (F.first("beam").over(r.orderBy("seq")) == 1) & (F.max_by("beam", "seq").over(r) == 3) & (F.count_if(F.col("beam") == 3).over(r) == 1) & (F.count("*").over(r) >= 2)
    return runs.withColumn("_g", good).select(*L.MEASURE, "seq", F.when(F.col("_g"), F.col("beam")).otherwise(0).alias("kept"))


@query("tuplet_runs", f"SELECT {M}, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY {M} ORDER BY seq) - row_number() OVER (PARTITION BY {M}, tuplet ORDER BY seq) AS grp FROM se WHERE kind = 'note') WHERE tuplet IS NOT NULL GROUP BY {M}, grp")
def tuplet_runs(b):
    w = Window.partitionBy(*L.MEASURE)
    runs = notes(b).withColumn("grp", F.row_number().over(w.orderBy("seq")) - F.row_number().over(Window.partitionBy(*L.MEASURE, "tuplet").orderBy("seq")))
    return runs.filter("tuplet is not null").groupBy(*L.MEASURE, "grp").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("n")).drop("grp")


@query("slur_orphans", "SELECT score_id, part_no, measure_no, seq, CASE WHEN slur = 1 AND coalesce(before, 1) = 1 THEN 'orphan stop' WHEN slur = 0 AND coalesce(after, 0) = 0 THEN 'open start' ELSE 'paired' END AS state FROM (SELECT *, lag(slur) OVER w AS before, lead(slur) OVER w AS after FROM se WHERE kind = 'note' AND slur IN (0, 1) WINDOW w AS (PARTITION BY score_id, part_no, staff ORDER BY measure_no, seq))")
def slur_orphans(b):
    w = Window.partitionBy(*L.PART, "staff").orderBy("measure_no", "seq")
    rows = notes(b).filter("slur in (0, 1)").withColumns({"before": F.lag("slur").over(w), "after": F.lead("slur").over(w)})
    state = F.when((F.col("slur") == 1) & (F.coalesce("before", F.lit(1)) == 1), "orphan stop").when((F.col("slur") == 0) & (F.coalesce("after", F.lit(0)) == 0), "open start").otherwise("paired")
    return rows.select(*L.MEASURE, "seq", state.alias("state"))


@query("chord_dedupe", f"SELECT {M}, seq FROM (SELECT *, row_number() OVER (PARTITION BY {M}, g, midi ORDER BY seq) AS n FROM {GROUPS}) WHERE n = 1 OR is_rest = 1")
def chord_dedupe(b):
    g = L.chord_groups(L.sounding(b.se))
    n = F.row_number().over(Window.partitionBy(*L.MEASURE, "group_no", "midi").orderBy("seq"))
    return g.withColumn("n", n).filter("n = 1 or is_rest = 1").select(*L.MEASURE, "seq")


@query("chord_sync", f"SELECT {M}, seq, first_value(type) OVER w AS type_now, first_value(duration) OVER w AS duration_now FROM {GROUPS} WINDOW w AS (PARTITION BY {M}, g ORDER BY seq)")
def chord_sync(b):
    w = Window.partitionBy(*L.MEASURE, "group_no").orderBy("seq")
    return L.chord_groups(L.sounding(b.se)).select(*L.MEASURE, "seq", F.first("type").over(w).alias("type_now"), F.first("duration").over(w).alias("duration_now"))


@query("order_propagate", f"SELECT {M}, seq, coalesce(play_order, min(play_order) OVER (PARTITION BY {M}, staff, midi, onset)) AS new_order FROM {ONSET} WHERE kind = 'note' AND is_chord = 0 AND is_grace = 0")
def order_propagate(b):
    same = F.min("play_order").over(Window.partitionBy(*L.MEASURE, "staff", "midi", "onset"))
    return L.cursor_onset(b.se).filter(L.leader()).select(*L.MEASURE, "seq", F.coalesce("play_order", same).alias("new_order"))


@query("layout_targets", f"SELECT n.score_id, n.part_no, n.measure_no, n.seq, l.px FROM (SELECT {M}, seq, g FROM {GROUPS}) n JOIN (SELECT {M}, g, arg_min(x, seq) AS px FROM {GROUPS} GROUP BY {M}, g) l USING ({M}, g)")
def layout_targets(b):
    w = Window.partitionBy(*L.MEASURE, "group_no").orderBy("seq")
    return L.chord_groups(L.sounding(b.se)).select(*L.MEASURE, "seq", F.first("x").over(w).alias("px"))


@query("neighbour_fill", f"SELECT {M}, seq, coalesce(CASE WHEN x % 3 > 0 THEN duration END, last_value(CASE WHEN x % 3 > 0 THEN duration END IGNORE NULLS) OVER (PARTITION BY {M}, staff ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 4) AS filled FROM se WHERE kind = 'note'")
def neighbour_fill(b):
    known = F.when(F.col("x") % 3 > 0, F.col("duration"))
    return notes(b).withColumn("known", known).select(*L.MEASURE, "seq", F.coalesce("known", F.last("known", True).over(L.preceding(L.in_measure("staff"))), F.lit(4)).alias("filled"))


@query("pad_underfull", f"SELECT {M}, voice, CAST({CAP} - sum(duration) AS BIGINT) AS gap FROM se WHERE kind = 'note' AND is_chord = 0 AND is_grace = 0 AND (score_id, part_no, measure_no) NOT IN (SELECT (score_id, part_no, measure_no) FROM se WHERE kind = 'backup') GROUP BY {M}, voice, beats HAVING sum(duration) < {CAP}")
def pad_underfull(b):
    """A forward for what each voice lacks; measures with a backup are left alone."""
    has_backup = b.se.filter("kind = 'backup'").select(*L.MEASURE).distinct()
    rows = b.se.filter(L.leader()).join(has_backup, list(L.MEASURE), "left_anti").groupBy(*L.MEASURE, "voice", "beats").agg(F.sum("duration").alias("total"))
    return rows.select(*L.MEASURE, "voice", (L.measure_length(F.col("beats")) - F.col("total")).alias("gap")).filter("gap > 0")


@query("cap_simple", f"SELECT {M}, seq, CAST(greatest(1, least(duration, {CAP} - (sum(duration) OVER (PARTITION BY {M}, voice ORDER BY seq) - duration))) AS BIGINT) AS capped FROM se WHERE kind = 'note' AND is_chord = 0 AND is_grace = 0")
def cap_simple(b):
    before = F.sum("duration").over(L.in_measure("voice")) - F.col("duration")
    return b.se.filter(L.leader()).select(*L.MEASURE, "seq", F.greatest(F.lit(1), F.least(F.col("duration"), L.measure_length(F.col("beats")) - before)).cast("long").alias("capped"))


@query("apportion", f"""WITH s AS (SELECT *, sum(duration) OVER (PARTITION BY {M}, voice) AS total, {CAP} AS target FROM se WHERE kind = 'note' AND is_chord = 0 AND is_grace = 0),
f AS (SELECT *, (duration * target) // total AS base, (duration * target) % total AS rest FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY {M}, voice ORDER BY rest DESC, seq) AS n, target - sum(base) OVER (PARTITION BY {M}, voice) AS spare FROM f)
SELECT {M}, seq, CAST(base + CASE WHEN n <= spare THEN 1 ELSE 0 END AS BIGINT) AS share FROM k""")
def apportion(b):
    """Durations scaled to the measure: whole shares, and what is over by the largest remainder."""
    w = Window.partitionBy(*L.MEASURE, "voice")
    s = b.se.filter(L.leader()).withColumns({"total": F.sum("duration").over(w), "target": L.measure_length(F.col("beats"))})
    s = s.withColumns({"base": F.expr("(duration * target) div total"), "rest": F.expr("(duration * target) % total")})
    s = s.withColumns({"n": F.row_number().over(w.orderBy(F.col("rest").desc(), "seq")), "spare": F.col("target") - F.sum("base").over(w)})
    return s.select(*L.MEASURE, "seq", (F.col("base") + (F.col("n") <= F.col("spare")).cast("int")).cast("long").alias("share"))


@query("split_parts", f"WITH r AS (SELECT {M}, g, seq, midi, row_number() OVER (PARTITION BY {M}, g ORDER BY midi DESC, seq) AS k, count(*) OVER (PARTITION BY {M}, g) AS n FROM {GROUPS} WHERE is_rest = 0) SELECT {M}, CAST(g AS BIGINT) AS group_no, t AS target, midi FROM r, unnest([1, 2]) AS u(t) WHERE k = least(t, n)")
def split_parts(b):
    """Two target parts: the k-th note from the top for the k-th part; the last note repeats."""
    w = Window.partitionBy(*L.MEASURE, "group_no")
    g = L.chord_groups(L.sounding(b.se)).filter("is_rest = 0").withColumns({"k": F.row_number().over(w.orderBy(F.col("midi").desc(), "seq")), "n": F.count("*").over(w)})
    return g.withColumn("target", F.explode(F.array(F.lit(1), F.lit(2)))).filter("k = least(target, n)").select(*L.MEASURE, "group_no", "target", "midi")


@query("timeline_rebuild", f"SELECT {M}, seq, CAST(row_number() OVER (PARTITION BY {M} ORDER BY staff, voice, onset, seq) AS BIGINT) AS new_seq, CAST(onset - coalesce(lag(onset + CASE WHEN is_chord = 0 AND is_grace = 0 THEN duration ELSE 0 END) OVER (PARTITION BY {M} ORDER BY staff, voice, onset, seq), 0) AS BIGINT) AS shift_before FROM {ONSET} WHERE kind = 'note'")
def timeline_rebuild(b):
    """Notes layer by layer; ``shift_before`` is the forward (positive) or backup (negative) that must come before each."""
    w = Window.partitionBy(*L.MEASURE).orderBy("staff", "voice", "onset", "seq")
    rows = L.cursor_onset(b.se).filter("kind = 'note'")
    end = F.col("onset") + F.when(L.leader(), F.col("duration")).otherwise(0)
    return rows.withColumn("_end", end).select(*L.MEASURE, "seq", F.row_number().over(w).cast("long").alias("new_seq"), (F.col("onset") - F.coalesce(F.lag("_end").over(w), F.lit(0))).alias("shift_before"))


@query("backup_repair", f"WITH l AS (SELECT {M}, sum(CASE WHEN staff = 1 AND kind = 'note' AND is_chord = 0 AND is_grace = 0 THEN duration ELSE 0 END) AS first_staff FROM se GROUP BY {M}) SELECT {M}, seq, CAST(least(first_staff, {CAP}) AS BIGINT) AS repaired FROM se JOIN l USING ({M}) WHERE kind = 'backup'")
def backup_repair(b):
    one = F.sum(F.when((F.col("staff") == 1) & L.leader(), F.col("duration")).otherwise(0)).over(Window.partitionBy(*L.MEASURE))
    rows = b.se.withColumn("first_staff", one).filter("kind = 'backup'")
    return rows.select(*L.MEASURE, "seq", F.least(F.col("first_staff"), L.measure_length(F.col("beats"))).cast("long").alias("repaired"))


@query("score_diff", "SELECT score_id, measure_no, midi, count(*) FILTER (part_no = 1) - count(*) FILTER (part_no = 2) AS difference FROM se WHERE kind = 'note' AND part_no IN (1, 2) GROUP BY score_id, measure_no, midi HAVING count(*) FILTER (part_no = 1) <> count(*) FILTER (part_no = 2)")
def score_diff(b):
    """Pitches that two versions of a measure do not share, as multisets."""
    side = lambda p: notes(b).filter(f"part_no = {p}").groupBy("score_id", "measure_no", "midi").agg(F.count("*").alias(f"n{p}"))
    both = side(1).join(side(2), ["score_id", "measure_no", "midi"], "full")
    return both.select("score_id", "measure_no", "midi", (F.coalesce("n1", F.lit(0)) - F.coalesce("n2", F.lit(0))).alias("difference")).filter("difference <> 0")


@query("spot_check", "SELECT e.measure_no, e.part_no, s.score_id, concat_ws(',', CASE WHEN s.tuplets = 0 THEN 'noTuplet' END, CASE WHEN s.quarters > 2 THEN 'manyQuarters' END) AS codes FROM (VALUES (1, 1), (2, 3), (4, 2)) AS e(measure_no, part_no) LEFT JOIN (SELECT score_id, part_no, measure_no, count(*) FILTER (tuplet IS NOT NULL) AS tuplets, count(*) FILTER (type = 'quarter') AS quarters FROM se GROUP BY ALL) s ON s.measure_no = e.measure_no AND s.part_no = e.part_no")
def spot_check(b):
    spots = b.spark.sql("SELECT * FROM VALUES (1, 1), (2, 3), (4, 2) AS t(measure_no, part_no)")
    stats = b.se.groupBy(*L.MEASURE).agg(F.count_if(F.col("tuplet").isNotNull()).alias("tuplets"), F.count_if(F.col("type") == "quarter").alias("quarters"))
    codes = F.filter(F.array(F.when(F.col("tuplets") == 0, "noTuplet"), F.when(F.col("quarters") > 2, "manyQuarters")), lambda x: x.isNotNull())
    return F.broadcast(spots).join(stats, ["measure_no", "part_no"], "left").select("measure_no", "part_no", "score_id", F.array_join(codes, ",").alias("codes"))


@query("symbol_sort", f"SELECT {M}, seq, CAST(row_number() OVER (PARTITION BY score_id ORDER BY measure_no, staff, x, part_no, seq) AS BIGINT) AS place FROM se")
def symbol_sort(b):
    return b.se.select(*L.MEASURE, "seq", F.row_number().over(Window.partitionBy("score_id").orderBy("measure_no", "staff", "x", "part_no", "seq")).cast("long").alias("place"))


@query("symbol_buckets", f"SELECT {M}, staff, count(*) AS n, string_agg(CAST(midi AS VARCHAR), ' ' ORDER BY x, seq) AS pitches FROM se WHERE kind = 'note' GROUP BY {M}, staff")
def symbol_buckets(b):
    listed = F.transform(F.array_sort(F.collect_list(F.struct("x", "seq", "midi"))), lambda s: s["midi"].cast("string"))
    return notes(b).groupBy(*L.MEASURE, "staff").agg(F.count("*").alias("n"), F.array_join(listed, " ").alias("pitches"))


@query("measure_snapshot", f"SELECT {M}, seq, kind, midi, CAST(onset AS BIGINT) AS onset FROM {ONSET} JOIN (SELECT DISTINCT {M} FROM fx) wanted USING ({M})")
def measure_snapshot(b):
    """The measures that the correction log names, with onsets; the others are left out before any window."""
    rows = b.se.join(b.fx.select(*L.MEASURE).distinct(), list(L.MEASURE), "left_semi")
    return L.cursor_onset(rows).select(*L.MEASURE, "seq", "kind", "midi", "onset")


@query("x_order", f"SELECT {M}, seq, CAST(row_number() OVER (PARTITION BY {M} ORDER BY CASE WHEN x % 9 = 0 THEN 10000 ELSE x END, seq) AS BIGINT) AS place FROM se WHERE kind = 'note' AND is_chord = 0")
def x_order(b):
    key = F.coalesce(F.when(F.col("x") % 9 != 0, F.col("x")), F.lit(10000))
    return notes(b).filter("is_chord = 0").select(*L.MEASURE, "seq", F.row_number().over(Window.partitionBy(*L.MEASURE).orderBy(key, "seq")).cast("long").alias("place"))


@query("measure_sort", "SELECT score_id, part_no, number, CAST(row_number() OVER (PARTITION BY score_id, part_no ORDER BY CASE WHEN TRY_CAST(number AS INTEGER) IS NULL THEN 1 ELSE 0 END, TRY_CAST(number AS INTEGER), number) AS BIGINT) AS place FROM (SELECT *, CASE WHEN measure_no % 4 = 0 THEN concat('X', CAST(measure_no AS VARCHAR)) ELSE CAST(measure_no AS VARCHAR) END AS number FROM me)")
def measure_sort(b):
    """Numbers first and by value, then the others as text."""
    number = F.when(F.col("measure_no") % 4 == 0, F.concat(F.lit("X"), F.col("measure_no").cast("string"))).otherwise(F.col("measure_no").cast("string"))
    value = F.col("number").try_cast("int")
    w = Window.partitionBy(*L.PART).orderBy(value.isNull(), value, "number")
    return b.me.withColumn("number", number).select(*L.PART, "number", F.row_number().over(w).cast("long").alias("place"))
