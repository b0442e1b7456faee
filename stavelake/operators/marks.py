"""Marks that span notes: slurs and wedges, paired over whole parts.

Slurs are a fold over one part's marks, since the least free number depends on all that are open. Wedges need none: whether a wedge is open
after a measure follows from the last measure that settles it, so windows over a staff's measures with wedges do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stavelake.operators.timeline import MEASURE, PART, preceding

NOTE = (*MEASURE, "seq")
#: Height of a wedge above its staff.
ABOVE_Y = 25


def one_of_each_type(slurs: DataFrame) -> DataFrame:
    """Of each note one start and one stop: the one with the fewest layout attributes, then the first."""
    best = F.min_by(F.struct("mark_no", "staff", "number", "noise"), F.struct("noise", "mark_no"))
    return slurs.groupBy(*NOTE, "type").agg(best.alias("s")).select(*NOTE, "type", "s.*")


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


_STATE = "struct<measure:bigint,open:array<struct<number:bigint,staff:bigint>>,used:array<bigint>,renamed:array<struct<staff:bigint,asked:bigint,given:bigint>>,out:array<struct<m:struct<measure_no:bigint,seq:bigint,starts:int,mark_no:bigint,staff:bigint,asked:bigint,number:bigint,noise:bigint>,given:bigint>>>"


def _state(measure, open_, used, renamed, out) -> Column:
    return F.struct(measure.alias("measure"), open_.alias("open"), used.alias("used"), renamed.alias("renamed"), out.alias("out"))


def _entered(s: Column, n: Column) -> Column:
    """What is open when a measure begins counts as used in it; renamed starts are known to this measure's stops only."""
    fresh = _state(n["measure_no"], s["open"], F.transform(s["open"], lambda o: o["number"]), F.slice(s["renamed"], 1, 0), s["out"])
    return F.when(s["measure"] == n["measure_no"], s).otherwise(fresh)


def _stopped(s: Column, n: Column) -> Column:
    """The open number that a stop ends, or null."""
    renamed = F.try_element_at(F.filter(s["renamed"], lambda r: (r["staff"] == n["staff"]) & (r["asked"] == n["asked"])), F.lit(-1))["given"]
    is_open = lambda number: F.exists(s["open"], lambda o: (o["number"] == number) & (o["staff"] == n["staff"]))
    return let(F.coalesce(renamed, n["asked"]), lambda first: F.when(is_open(first), first).when(is_open(n["asked"]), n["asked"]))


def _started(s: Column, n: Column) -> Column:
    """The number of a start: its own, or the least that is neither open nor used."""
    taken = F.concat(F.transform(s["open"], lambda o: o["number"]), s["used"])
    least = F.array_min(F.array_except(F.sequence(F.lit(1).cast("long"), F.size(taken).cast("long") + 1), taken))
    return F.when(F.array_contains(taken, n["asked"]), least).otherwise(n["asked"])


def _after(s: Column, n: Column, k: Column) -> Column:
    out = F.concat(s["out"], F.array(F.struct(n.alias("m"), k.alias("given"))))
    opened = F.concat(s["open"], F.array(F.struct(k.alias("number"), n["staff"].alias("staff"))))
    renamed = F.concat(s["renamed"], F.array(F.struct(n["staff"].alias("staff"), n["asked"].alias("asked"), k.alias("given"))))
    start = _state(s["measure"], opened, s["used"], F.when(k == n["asked"], s["renamed"]).otherwise(renamed), out)
    stop = _state(s["measure"], F.filter(s["open"], lambda o: o["number"] != k), F.concat(s["used"], F.array(k)), s["renamed"], out)
    return F.when(n["starts"] == 1, start).when(k.isNotNull(), stop).otherwise(s)


def paired_slurs(slurs: DataFrame) -> DataFrame:
    """score_id, part_no, measure_no, seq, mark_no, type, staff, number and changed of the slur marks that stay.

    slurs: a row per mark with its note, mark_no, type (start, stop), staff, number (null: 1) and noise (its layout attributes, which go). A stop ends the open
    slur of its own staff and number, or goes; the number that its start was given in this measure counts first. A start keeps its number
    unless that is open in the part or was freed in this measure; then it takes the least that is neither.
    """
    rows = one_of_each_type(slurs).withColumn("asked", F.coalesce("number", F.lit(1)).cast("long"))
    mark = F.struct("measure_no", "seq", F.when(F.col("type") == "start", 1).otherwise(0).alias("starts"), "mark_no", "staff", "asked", F.col("number").cast("long").alias("number"), F.col("noise").cast("long").alias("noise"))
    per = rows.groupBy(*PART).agg(F.array_sort(F.collect_list(mark)).alias("g"))
    start = F.from_json(F.lit('{"measure":-1,"open":[],"used":[],"renamed":[],"out":[]}'), _STATE)
    step = lambda acc, n: let(_entered(acc, n), lambda s: let(F.when(n["starts"] == 1, _started(s, n)).otherwise(_stopped(s, n)), lambda k: _after(s, n, k)))
    out = per.select(*PART, F.inline(F.aggregate("g", start, step, lambda s: s["out"])))
    changed = (F.coalesce("m.number", F.lit(0)) != F.col("given")) | (F.col("m.noise") > 0)
    kind = F.when(F.col("m.starts") == 1, "start").otherwise("stop")
    return out.select(*PART, "m.measure_no", "m.seq", "m.mark_no", kind.alias("type"), "m.staff", F.col("given").alias("number"), changed.alias("changed"))


def slur_report(slurs: DataFrame) -> DataFrame:
    """Marks, marks that go and measures with a change, for each part."""
    kept = paired_slurs(slurs).select(*NOTE, "mark_no", "changed")
    rows = slurs.join(kept, [*NOTE, "mark_no"], "left")
    per = rows.groupBy(*MEASURE).agg(F.count("*").alias("marks"), F.count_if(F.col("changed").isNull()).alias("removed"), F.bool_or(F.coalesce("changed", F.lit(True))).alias("changed"))
    return per.groupBy(*PART).agg(F.sum("marks").alias("marks"), F.sum("removed").alias("removed"), F.count_if("changed").alias("changed_measures"))


def paired_wedges(wedges: DataFrame, notes: DataFrame) -> DataFrame:
    """score_id, part_no, measure_no, staff, seq (null: inserted), type, number, placement, y and place of the wedges after pairing.

    wedges: a row per wedge with staff, place (its order in the measure), type (crescendo, diminuendo, stop), number and placement (null: below). A stop before the first start of
    its staff, with none open, goes to the end of the measure. An open wedge is closed at the end of its measure when another starts in a later one. Stops of
    a measure without a start go when none is open. On a staff of several voices, wedges above move to the notes of its first voice. ``place`` orders them
    among the notes: before seq n lies between n - 1 and n; the end of a measure is infinite.
    """
    staff = (*MEASURE, "staff")
    rows = wedges.withColumns({"starts": (F.col("type") != "stop").cast("int"), "placement": F.coalesce("placement", F.lit("below")), "number": F.coalesce("number", F.lit(1)).cast("long")})
    at = F.struct("place", "seq")
    when = lambda flag, value: F.when(F.col("starts") == flag, value)
    per = rows.groupBy(*staff).agg(
        F.sum("starts").alias("n_starts"), F.count_if(F.col("starts") == 0).alias("n_stops"), F.min(when(1, at)).alias("first_start"), F.min(when(0, at)).alias("first_stop"),
        F.max_by("starts", at).alias("last_starts"), F.bool_or(F.col("placement") == "above").alias("above"),
        F.max_by(when(1, F.struct("number", "placement")), F.when(F.col("starts") == 1, at)).alias("last_start"),
    )
    both = (F.col("n_starts") > 0) & (F.col("n_stops") > 0)
    inverted = both & (F.col("first_stop") < F.col("first_start"))
    # Whether it leaves a wedge open, whatever came before; null where that stays as it was.
    settled = F.when(F.col("n_starts") == 0, False).when(F.col("n_stops") == 0, True).when(inverted & (F.col("last_starts") == 1), F.lit(None)).otherwise(F.col("last_starts") == 1)
    along = Window.partitionBy(*PART, "staff").orderBy("measure_no")
    per = per.withColumn("settled", settled)
    per = per.withColumns(
        {
            "open": F.coalesce(F.last("settled", ignorenulls=True).over(preceding(along)), F.lit(False)),
            "before": F.lag(F.struct("measure_no", "last_start.number", "last_start.placement")).over(along),
            "inverted": inverted,
        }
    )
    voices = notes.groupBy(*staff, "voice").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"))
    voices = voices.groupBy(*staff).agg(F.count("*").alias("voices"), F.min_by("lo", "lo").alias("first_note"), F.min_by("hi", "lo").alias("last_note"))
    flags = per.join(voices, list(staff), "left")
    joined = rows.join(flags.select(*staff, "open", "inverted", "n_starts", "first_stop", "above", "voices", "first_note", "last_note"), list(staff))
    joined = joined.filter((F.col("starts") == 1) | (F.col("n_starts") > 0) | F.col("open"))
    lift = (F.col("placement") == "above") & (F.col("voices") > 1)
    turn = F.col("inverted") & ~F.col("open") & (at == F.col("first_stop")) & (F.col("starts") == 0)
    end = F.lit(float("inf"))
    place = F.when(lift & (F.col("starts") == 1), F.col("first_note") - 0.5).when(lift, F.col("last_note") + 0.5).when(turn, end).otherwise(F.col("place"))
    y = F.when(F.col("placement") == "above", ABOVE_Y)
    kept = joined.select(*staff, "seq", "type", "number", "placement", y.alias("y"), place.alias("place"))
    closing = per.filter((F.col("n_starts") > 0) & F.col("open"))
    closers = closing.select(
        *PART, F.col("before.measure_no").alias("measure_no"), "staff", F.lit(None).cast("long").alias("seq"), F.lit("stop").alias("type"), F.col("before.number").alias("number"), F.col("before.placement").alias("placement"),
        F.when(F.col("before.placement") == "above", ABOVE_Y).alias("y"), end.alias("place"),
    )
    return kept.unionByName(closers)


def valid_beams(beams: DataFrame, notes: DataFrame) -> DataFrame:
    """The beams that stay: those of runs from a begin to an end over the notes of one layer, for each beam number by itself.

    beams: a row per beam with its note, number (null: 1) and value (begin, continue, end, forward hook, backward hook); notes: the pitched leaders with staff and voice. A
    note without a beam of the number ends a run, a begin starts another, and an end closes it; a hook needs a run as a continue does.
    """
    layer = (*MEASURE, "staff", "voice")
    own = beams.withColumn("number", F.coalesce("number", F.lit(1)).cast("long")).groupBy(*NOTE, "number").agg(F.min_by("value", "beam_no").alias("value"))
    placed = notes.select(*NOTE, "staff", "voice")
    numbers = own.join(placed, list(NOTE)).select(*layer, "number").distinct()
    rows = placed.join(numbers, list(layer)).join(own, [*NOTE, "number"], "left")
    w = Window.partitionBy(*layer, "number").orderBy("seq")
    new = F.col("value").isNull() | (F.col("value") == "begin") | F.coalesce(F.lag("value").over(w) == "end", F.lit(False))
    rows = rows.withColumn("_run", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(*layer, "number", "_run").orderBy("seq")
    whole = (F.first("value").over(run) == "begin") & (F.last("value").over(run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) == "end")
    return rows.withColumn("_whole", whole).filter("value is not null and _whole").select(*NOTE, "number", "value")
