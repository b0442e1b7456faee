"""Quality lint of scores: rules give issue rows of one shape, then roll-ups and suggested fixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stavelake.operators.marks import let
from stavelake.operators.timeline import MEASURE, PART, chord_groups, in_measure, leader, measure_length, sounding, upto

# Fixed values of the lint rules.
SPURIOUS_WORDS = ("P", "p", "2P", "2p", "PR", "PL", "R", "L", "9")
TRAILING_REST_TYPES = ("eighth", "16th")

ISSUE = ("score_id", "part_no", "measure_no", "code", "detail", "note_seq")


def issues_of(rows: DataFrame, code, detail, note_seq=None) -> DataFrame:
    seq = F.lit(None).cast("long") if note_seq is None else note_seq
    return rows.select(*MEASURE, (F.lit(code) if isinstance(code, str) else code).alias("code"), detail.cast("string").alias("detail"), seq.alias("note_seq"))


def pitch_id() -> Column:
    return F.when(F.col("is_rest") == 1, F.concat(F.lit("rest:"), F.coalesce("type", F.lit("?")))).otherwise(F.col("midi").cast("string"))


def measure_events(elements: DataFrame) -> DataFrame:
    """(measure, event_no, event, last_seq): after a backup all notes join the event before them, until a forward."""
    w = in_measure()
    flag = F.when(F.col("kind").isin("backup", "forward"), F.col("kind"))
    glued = F.coalesce(F.last(flag, ignorenulls=True).over(upto(w)) == "backup", F.lit(False))
    notes = elements.withColumn("_g", glued).filter("kind = 'note'").withColumn("_p", pitch_id())
    event = F.sum((~F.col("_g")).cast("int")).over(upto(w))
    numbered = notes.withColumn("event_no", F.greatest(event, F.lit(1)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "_p"))), lambda s: s["_p"]), "+")
    return numbered.groupBy(*MEASURE, "event_no").agg(joined.alias("event"))


def trailing_rests(elements: DataFrame) -> DataFrame:
    """A measure that ends with a short rest after sounding events; the issue points at the last rest of that type."""
    per = measure_events(elements).groupBy(*MEASURE).agg(
        F.max_by("event", "event_no").alias("last"), F.count("*").alias("n"), F.count_if(~F.startswith("event", F.lit("rest:"))).alias("sounding")
    )
    rest_type = F.regexp_extract("last", r"^rest:(.*)$", 1)
    hit = per.filter((F.col("n") >= 2) & rest_type.isin(*TRAILING_REST_TYPES) & (F.col("sounding") >= 1)).withColumn("rest_type", rest_type)
    rests = elements.filter("kind = 'note' and is_rest = 1").groupBy(*MEASURE, F.col("type").alias("rest_type")).agg(F.max("seq").alias("note_seq"))
    return issues_of(hit.join(rests, [*MEASURE, "rest_type"], "left"), "trailingPhantomRest", F.col("rest_type"), F.col("note_seq"))


def boundary_swaps(elements: DataFrame) -> DataFrame:
    """Adjacent measures where the last events of one are the first of the next, reversed."""
    events = measure_events(elements).filter(~F.startswith("event", F.lit("rest:")))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("event_no", "event"))), lambda s: s["event"])
    per = events.groupBy(*MEASURE).agg(listed.alias("e"))
    everywhere = elements.select(*MEASURE).distinct().join(per, list(MEASURE), "left").withColumn("e", F.coalesce("e", F.array().cast("array<string>")))
    nxt = Window.partitionBy(*PART).orderBy("measure_no")
    tail = F.reverse(F.slice(F.reverse("e"), 1, 4))
    pairs = everywhere.select(*MEASURE, tail.alias("tail"), F.slice(F.lead("e").over(nxt), 1, 4).alias("head"))
    at = lambda c, i: F.element_at(c, i)
    crossed = (at("tail", -1) == at("head", 1)) & (at("tail", 1) == at("head", -1))
    reversed_pair = (at("tail", -2) == at("head", 2)) & (at("tail", -1) == at("head", 1))
    rows = pairs.filter((F.size("tail") >= 2) & (F.size("head") >= 2)).filter(crossed | reversed_pair)
    return issues_of(rows, "measureBoundaryOrderSuspect", F.concat(at("tail", -1), F.lit(">"), at("head", 1)))


def rhythm_suspects(elements: DataFrame) -> DataFrame:
    """A plain quarter before a beamed note of the same pitch, and two plain quarters before a beamed pair of eighths."""
    grouped = chord_groups(sounding(elements))
    pitch = F.when(F.col("is_rest") == 0, F.col("midi"))
    groups = grouped.groupBy(*MEASURE, "group_no").agg(
        *[F.min_by(c, "seq").alias(c) for c in ("staff", "voice", "type", "beam", "is_rest")], F.collect_set(pitch).alias("pitches"), F.min("seq").alias("seq")
    )
    w = Window.partitionBy(*MEASURE).orderBy("group_no")
    for i in (1, 2, 3):
        groups = groups.withColumn(f"g{i}", F.lead(F.struct("staff", "voice", "type", "beam", "is_rest", "pitches")).over(w) if i == 1 else F.lead(F.struct("staff", "voice", "type", "beam", "is_rest", "pitches"), i).over(w))
    same = lambda i: (F.col(f"g{i}.staff") == F.col("staff")) & (F.col(f"g{i}.voice") == F.col("voice")) & (F.col(f"g{i}.is_rest") == 0)
    plain = (F.col("is_rest") == 0) & (F.col("type") == "quarter") & (F.col("beam") == 0)
    first = groups.filter(plain & same(1) & (F.col("g1.beam") != 0) & F.arrays_overlap("pitches", "g1.pitches"))
    second = groups.filter(
        plain & same(1) & same(2) & same(3) & (F.col("g1.type") == "quarter") & (F.col("g1.beam") == 0) & (F.col("g2.beam") == 1) & (F.col("g3.beam") == 3) & (F.col("g2.type") == "eighth") & (F.col("g3.type") == "eighth")
    )
    return issues_of(first, "rhythmQuarterBeforeBeamedEighth", F.col("staff"), F.col("seq")).unionByName(issues_of(second, "rhythmPlainQuarterPairBeforeBeams", F.col("staff"), F.col("seq")))


def fullness_issues(elements: DataFrame) -> DataFrame:
    rows = elements.filter(leader() & (F.col("implicit") == 0)).groupBy(*MEASURE, "voice", "beats").agg(F.sum("duration").alias("total"))
    cap = measure_length(F.col("beats"))
    code = F.when(F.col("total") < cap, "measureUnderfull").when(F.col("total") > cap, "measureOverfull")
    return issues_of(rows.filter(F.col("total") != cap), code, F.concat_ws("/", F.col("voice").cast("string"), F.col("total").cast("string"), cap.cast("string")))


def rests_without_staff(elements: DataFrame) -> DataFrame:
    """Rests without a staff number in measures of two staves or more; the last staff is suggested."""
    top = F.max("staff").over(Window.partitionBy(*MEASURE))
    rows = elements.withColumn("_top", top).filter("kind = 'note' and is_rest = 1 and staff is null and _top >= 2")
    return issues_of(rows, "restMissingStaff", F.col("_top"), F.col("seq"))


def spurious(text) -> Column:
    compact = F.regexp_replace(text, r"\s+", "")
    return compact.isin(*SPURIOUS_WORDS) | compact.rlike(r"^\d{1,3}$") | compact.rlike("^[Pp]{1,3}$")


ISSUES = "array<struct<code:string,detail:string,note_seq:bigint>>"


def _issue(code: Column | str, detail: Column, seq: Column | None = None) -> Column:
    named = F.lit(code) if isinstance(code, str) else code
    return F.struct(named.alias("code"), detail.cast("string").alias("detail"), (F.lit(None).cast("long") if seq is None else seq).alias("note_seq"))


def _when(condition: Column, issue: Column) -> Column:
    return F.when(condition, F.array(issue)).otherwise(F.array().cast(ISSUES))


def _fullness(g: Column) -> Column:
    """Of a measure's elements: an issue for each voice that is not full."""
    moves = F.filter(g, lambda x: (x["kind"] == "note") & (x["is_chord"] == 0) & (x["is_grace"] == 0))
    cap = measure_length(F.col("beats"))

    def of_voice(rows: Column, v: Column) -> Column:
        total = F.aggregate(rows, F.lit(0).cast("long"), lambda acc, x: acc + F.when(x["voice"] == v, x["duration"]).otherwise(0))
        code = lambda t: F.when(t < cap, "measureUnderfull").when(t > cap, "measureOverfull")
        return let(total, lambda t: _issue(code(t), F.concat_ws("/", v.cast("string"), t.cast("string"), cap.cast("string"))))

    found = let(moves, lambda rows: F.transform(F.array_distinct(F.transform(rows, lambda x: x["voice"])), lambda v: of_voice(rows, v)))
    return F.when(F.col("implicit") == 0, F.filter(found, lambda i: i["code"].isNotNull())).otherwise(F.array().cast(ISSUES))


def _events(g: Column) -> Column:
    """The measure's events: after a backup notes join the event before them, until a forward."""
    pitch = lambda x: F.when(x["is_rest"] == 1, F.concat(F.lit("rest:"), F.coalesce(x["type"], F.lit("?")))).otherwise(x["midi"].cast("string"))
    start = F.struct(F.lit(False).alias("glued"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("out"))

    def note(acc: Column, x: Column) -> Column:
        n = acc["n"] + F.when(acc["glued"], 0).otherwise(1)
        last = F.size(acc["out"])
        joined = F.concat(F.slice(acc["out"], F.lit(1), last - 1), F.array(F.concat(F.get(acc["out"], last - 1), F.lit("+"), pitch(x))))
        out = F.when(last < F.greatest(n, F.lit(1)), F.concat(acc["out"], F.array(pitch(x)))).otherwise(joined)
        return F.struct(acc["glued"].alias("glued"), n.alias("n"), out.alias("out"))

    step = lambda acc, x: F.when(x["kind"] == "note", note(acc, x)).otherwise(F.struct((x["kind"] == "backup").alias("glued"), acc["n"].alias("n"), acc["out"].alias("out")))
    return F.aggregate(g, start, step, lambda acc: acc["out"])


def _groups(g: Column) -> Column:
    """Chord groups of the sounding notes, each with its first note's columns and all its pitches."""
    fields = "staff:bigint,voice:bigint,type:string,beam:bigint,is_rest:int,seq:bigint,pitches:array<bigint>"
    pitches = lambda x: F.when(x["is_rest"] == 0, F.array(x["midi"])).otherwise(F.array().cast("array<bigint>"))
    start = F.struct(F.lit(None).cast("long").alias("staff"), F.lit(None).cast("long").alias("voice"), F.array().cast(f"array<struct<{fields}>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        joins = F.coalesce((x["is_chord"] == 1) & (acc["staff"] == x["staff"]) & (acc["voice"] == x["voice"]), F.lit(False))
        n = F.size(acc["out"])
        last = F.get(acc["out"], n - 1)
        new = F.struct(*[x[c].alias(c) for c in ("staff", "voice", "type", "beam", "is_rest", "seq")], pitches(x).alias("pitches"))
        grown = F.concat(F.slice(acc["out"], F.lit(1), n - 1), F.array(last.withField("pitches", F.concat(last["pitches"], pitches(x)))))
        return F.struct(x["staff"].alias("staff"), x["voice"].alias("voice"), F.when(joins, grown).otherwise(F.concat(acc["out"], F.array(new))).alias("out"))

    return F.aggregate(F.filter(g, lambda x: (x["kind"] == "note") & (x["is_grace"] == 0)), start, step, lambda acc: acc["out"])


def _rhythm(groups: Column) -> Column:
    """Plain quarters before beams, by windows of four groups."""

    def at(g: Column, i: Column) -> Column:
        after = [F.get(groups, i + k) for k in (1, 2, 3)]
        same = [F.coalesce((o["staff"] == g["staff"]) & (o["voice"] == g["voice"]) & (o["is_rest"] == 0), F.lit(False)) for o in after]
        plain = (g["is_rest"] == 0) & (g["type"] == "quarter") & (g["beam"] == 0)
        one, two, three = after
        first = plain & same[0] & (one["beam"] != 0) & F.arrays_overlap(g["pitches"], one["pitches"])
        second = plain & same[0] & same[1] & same[2] & (one["type"] == "quarter") & (one["beam"] == 0) & (two["beam"] == 1) & (three["beam"] == 3) & (two["type"] == "eighth") & (three["type"] == "eighth")
        of = lambda code, hit: _when(F.coalesce(hit, F.lit(False)), _issue(code, g["staff"], g["seq"]))
        return F.concat(of("rhythmQuarterBeforeBeamedEighth", first), of("rhythmPlainQuarterPairBeforeBeams", second))

    return F.flatten(F.transform(groups, at))


def _trailing(g: Column, events: Column) -> Column:
    rest_type = F.regexp_extract(F.try_element_at(events, F.lit(-1)), r"^rest:(.*)$", 1)
    sounding = F.exists(events, lambda e: ~F.startswith(e, F.lit("rest:")))
    seq = F.array_max(F.transform(g, lambda x: F.when((x["kind"] == "note") & (x["is_rest"] == 1) & (x["type"] == rest_type), x["seq"])))
    return _when((F.size(events) >= 2) & F.coalesce(rest_type.isin(*TRAILING_REST_TYPES), F.lit(False)) & sounding, _issue("trailingPhantomRest", rest_type, seq))


def _swapped(tail: Column, head: Column) -> Column:
    at = lambda c, i: F.try_element_at(c, F.lit(i))
    crossed = (at(tail, -1) == at(head, 1)) & (at(tail, 1) == at(head, -1))
    reversed_pair = (at(tail, -2) == at(head, 2)) & (at(tail, -1) == at(head, 1))
    hit = (F.size(tail) >= 2) & (F.size(head) >= 2) & (crossed | reversed_pair)
    return _when(F.coalesce(hit, F.lit(False)), _issue("measureBoundaryOrderSuspect", F.concat(at(tail, -1), F.lit(">"), at(head, 1))))


def lint_issues(elements: DataFrame) -> DataFrame:
    """All rules on a corpus: one row per issue. A measure is gathered once and every rule reads its elements; measures then meet their successor in the part."""
    columns = ("seq", "kind", "voice", "staff", "duration", "is_rest", "is_chord", "is_grace", "midi", "type", "beam")
    per = elements.groupBy(*MEASURE).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("g"), F.first("beats").alias("beats"), F.first("implicit").alias("implicit"))
    per = per.withColumn("events", _events(F.col("g")))
    own = F.concat(_fullness(F.col("g")), let(_groups(F.col("g")), _rhythm), _trailing(F.col("g"), F.col("events")))
    per = per.select(*MEASURE, own.alias("own"), F.filter("events", lambda e: ~F.startswith(e, F.lit("rest:"))).alias("e"))
    per = per.select(*MEASURE, "own", F.slice("e", 1, 4).alias("head"), F.reverse(F.slice(F.reverse("e"), 1, 4)).alias("tail"))
    head = F.lead("head").over(Window.partitionBy(*PART).orderBy("measure_no"))
    return per.withColumn("issues", F.concat("own", _swapped(F.col("tail"), head))).select(*MEASURE, F.inline("issues"))


def rollup(issues: DataFrame) -> DataFrame:
    """Counts per code, per score and part, and in all."""
    by = issues.groupingSets([["code"], ["score_id", "part_no"], []], "code", "score_id", "part_no").agg(F.count("*").alias("n"))
    return by.select("code", "score_id", "part_no", "n")


def suggested_fixes(issues: DataFrame) -> DataFrame:
    """The fix that an issue's code suggests; codes without one give no row."""
    kinds = {"trailingPhantomRest": "removeTrailingPhantomRest", "rhythmQuarterBeforeBeamedEighth": "setNoteType", "rhythmPlainQuarterPairBeforeBeams": "setNoteType"}
    kind = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    return issues.withColumn("kind", F.element_at(kind, F.col("code"))).filter("kind is not null").select(*MEASURE, "kind", "note_seq")
