"""A measure's timeline built anew from its notes: layers one after another with backups between them, directions beside their notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stavelake.operators.marks import let
from stavelake.operators.timeline import MEASURE, following, leader, preceding, upto, whole

#: Order of groups without a play order in a layer that has some.
LAST = 999_999
ROW = "kind string, staff long, voice long, duration long, was long, mark string"


def _ordered_notes(elements: DataFrame) -> DataFrame:
    """Notes with the keys of their new order: layer, chord group by its leader's play order (else x, where others have one), then as they were."""
    layer = Window.partitionBy(*MEASURE, "staff", "voice").orderBy("seq")
    notes = elements.filter("kind = 'note'")
    starts = (F.col("is_chord") == 0) | (F.row_number().over(layer) == 1)
    notes = notes.withColumn("_g", F.sum(starts.cast("int")).over(upto(layer)))
    first = Window.partitionBy(*MEASURE, "staff", "voice", "_g").orderBy("seq")
    for c in ("play_order", "x", "seq"):
        notes = notes.withColumn(f"_{c}", F.first(c).over(first))
    some = F.max("_play_order").over(whole(*MEASURE, "staff", "voice")).isNotNull()
    has = F.col("_play_order").isNotNull()
    order = F.when(~some, 0).when(has, F.col("_play_order")).otherwise(LAST).cast("long")
    x = F.when(some & ~has, F.coalesce("_x", F.lit(LAST))).otherwise(0).cast("double")
    return notes.withColumns({"_order": order, "_ox": x})


def _layers(notes: DataFrame) -> DataFrame:
    """staff, voice and back: the backup before each layer, null before the first."""
    per = notes.groupBy(*MEASURE, "staff", "voice").agg(F.coalesce(F.sum(F.when(leader(), F.col("duration"))), F.lit(0)).alias("total"))
    w = Window.partitionBy(*MEASURE).orderBy("staff", "voice")
    per = per.withColumn("staff_total", F.max("total").over(whole(*MEASURE, "staff")))
    same = F.lag("staff").over(w) == F.col("staff")
    return per.withColumn("back", F.when(same, F.lag("total").over(w)).otherwise(F.lag("staff_total").over(w))).select(*MEASURE, "staff", "voice", "back")


def _anchored(elements: DataFrame, directions: DataFrame) -> DataFrame:
    """Directions with ``anchor`` (the note's seq) and ``side``: -1 before it, 1 behind it; without an anchor they open their staff.

    All but ends of wedges stand before the next note, if there is one; the others behind the note before, if it is of their staff and no backup or forward lies between.
    """
    rows = elements.select(*MEASURE, F.col("seq").cast("double").alias("place"), F.col("seq").alias("own"), "kind", "staff").unionByName(
        directions.select(*MEASURE, "place", F.lit(None).cast("long").alias("own"), F.lit("direction").alias("kind"), "staff", "mark"), allowMissingColumns=True
    )
    w = Window.partitionBy(*MEASURE).orderBy("place", "own")
    note = F.when(F.col("kind") == "note", F.struct("own", "staff"))
    moved = F.sum(F.col("kind").isin("backup", "forward").cast("int")).over(upto(w))
    rows = rows.withColumns({"_n": note, "_moves": moved})
    rows = rows.withColumns({"_next": F.first("_n", ignorenulls=True).over(following(w)), "_last": F.last(F.when(F.col("kind") == "note", F.struct("own", "staff", "_moves")), ignorenulls=True).over(preceding(w))})
    before = (F.col("mark") != "stop") & F.col("_next").isNotNull()
    behind = (F.col("_last._moves") == F.col("_moves")) & (F.col("_last.staff") == F.col("staff"))
    anchor = F.when(before, F.col("_next.own")).when(behind, F.col("_last.own"))
    return rows.filter("kind = 'direction'").select(*MEASURE, "place", "staff", "mark", anchor.alias("anchor"), F.when(before, -1).otherwise(1).alias("side"))


def rebuilt(elements: DataFrame, directions: DataFrame) -> DataFrame:
    """score_id, part_no, measure_no, seq, kind, staff, voice, duration, was (the note's seq before) and mark of the measures that have notes.

    directions: staff, place among the elements and mark (a wedge's type or any other name). Staves and voices follow in their order, each layer from the start
    of the measure: before a further voice the backup is what the voice before lasts, before a further staff what the longest of the staff before lasts. Old
    backups and forwards go. A direction without an anchor comes before its staff's first layer, or goes if the staff has no note.
    """
    notes = _ordered_notes(elements)
    keys = ["_order", "_ox", "_seq", "_own"]
    of_note = notes.select(*MEASURE, F.col("seq").alias("_own"), "staff", "voice", "_order", "_ox", "_seq")
    as_row = lambda df, kind, part, side, place, **columns: df.select(
        *MEASURE, "staff", "voice", *keys, F.lit(kind).alias("kind"), F.lit(part).alias("_part"), side.alias("_side"), place.alias("_place"),
        *[columns.get(c, F.lit(None)).cast(t).alias(c) for c, t in (("duration", "long"), ("was", "long"), ("mark", "string"))],
    )
    zero, none = F.lit(0), {k: F.lit(None).cast(t) for k, t in zip(keys, ("long", "double", "long", "long"))}
    out = as_row(notes.withColumn("_own", F.col("seq")), "note", 2, zero, zero.cast("double"), duration=F.col("duration"), was=F.col("seq"))
    layers = _layers(notes)
    out = out.unionByName(as_row(layers.filter("back is not null").withColumns(none), "backup", 1, zero, zero.cast("double"), duration=F.col("back")))
    found = _anchored(elements, directions)
    beside = found.filter("anchor is not null").drop("staff").join(of_note.withColumnRenamed("_own", "anchor"), [*MEASURE, "anchor"]).withColumn("_own", F.col("anchor"))
    out = out.unionByName(as_row(beside, "direction", 2, F.col("side"), F.col("place"), mark=F.col("mark")))
    first = layers.groupBy(*MEASURE, "staff").agg(F.min("voice").alias("voice"))
    opening = found.filter("anchor is null").join(first, [*MEASURE, "staff"]).withColumns(none)
    out = out.unionByName(as_row(opening, "direction", 0, zero, F.col("place"), mark=F.col("mark")))
    w = Window.partitionBy(*MEASURE).orderBy("staff", "voice", "_part", *keys, "_side", "_place", "mark")
    return out.withColumn("seq", F.row_number().over(w).cast("long")).select(*MEASURE, "seq", "kind", "staff", "voice", "duration", "was", "mark")


def repaired_backups(elements: DataFrame) -> DataFrame:
    """(measure, seq, duration) of every backup after two repairs.

    One that is followed by a forward goes back by what the notes right before it last, those of one layer. Then, where all notes of staff 1 come before those of
    staff 2, the first backup between them goes back to the start of the measure: by how far a cursor for each voice gets on staff 1, where a
    backup moves all of them and a forward the one that it names.
    """
    w = Window.partitionBy(*MEASURE).orderBy("seq")
    note = F.col("kind") == "note"
    same = note & (F.lag("kind").over(w) == "note") & (F.lag("staff").over(w) == F.col("staff")) & (F.lag("voice").over(w) == F.col("voice"))
    rows = elements.withColumn("_run", F.sum((~F.coalesce(same, F.lit(False))).cast("int")).over(upto(w)))
    run = Window.partitionBy(*MEASURE, "_run").orderBy("seq")
    starts = note & (F.col("is_grace") == 0) & ((F.col("is_chord") == 0) | (F.row_number().over(run) == 1))
    rows = rows.withColumn("_d", F.when(starts, F.col("duration")).otherwise(0)).withColumn("_sum", F.sum("_d").over(upto(run)))
    before = F.when(F.lag("kind").over(w) == "note", F.lag("_sum").over(w))
    after = F.first(F.when(F.col("kind").isin("note", "forward"), F.col("kind")), ignorenulls=True).over(following(w))
    stale = (F.col("kind") == "backup") & (after == "forward") & (before > 0)
    rows = rows.withColumn("_fixed", F.when(stale, before).otherwise(F.col("duration")))
    per = rows.groupBy(*MEASURE).agg(F.array_sort(F.collect_list(F.struct("seq", "kind", "staff", "voice", F.col("_fixed").alias("duration"), "is_chord", "is_grace"))).alias("g"))
    start = F.struct(F.array().cast("array<struct<voice:bigint,staff:bigint,at:bigint>>").alias("cursors"), F.lit(0).cast("long").alias("reach"))

    def step(acc: Column, x: Column) -> Column:
        own = F.filter(acc["cursors"], lambda c: (c["voice"] == x["voice"]) & (c["staff"] == x["staff"]))
        others = F.filter(acc["cursors"], lambda c: ~((c["voice"] == x["voice"]) & (c["staff"] == x["staff"])))
        at = F.coalesce(F.get(own, F.lit(0))["at"], F.lit(0)) + x["duration"]
        moved = let(at, lambda t: F.struct(F.concat(others, F.array(F.struct(x["voice"].alias("voice"), x["staff"].alias("staff"), t.alias("at")))).alias("cursors"), F.when(x["staff"] == 1, F.greatest(acc["reach"], t)).otherwise(acc["reach"]).alias("reach")))
        back = F.struct(F.transform(acc["cursors"], lambda c: F.struct(c["voice"].alias("voice"), c["staff"].alias("staff"), F.greatest(F.lit(0), c["at"] - x["duration"]).cast("long").alias("at"))).alias("cursors"), acc["reach"].alias("reach"))
        moves = (x["kind"] == "forward") | ((x["kind"] == "note") & (x["is_chord"] == 0) & (x["is_grace"] == 0))
        return F.when(x["kind"] == "backup", back).when(moves, moved).otherwise(acc)

    timed = lambda staff: F.transform(F.filter("g", lambda x: (x["kind"] == "note") & (x["is_grace"] == 0) & (x["staff"] == staff)), lambda x: x["seq"])
    per = per.select(*MEASURE, "g", F.aggregate("g", start, step, lambda acc: acc["reach"]).alias("reach"), F.array_max(timed(1)).alias("lo"), F.array_min(timed(2)).alias("hi"))
    first = F.array_min(F.transform(F.filter("g", lambda x: (x["kind"] == "backup") & (x["seq"] > F.col("lo"))), lambda x: x["seq"]))
    out = per.select(*MEASURE, "reach", "hi", first.alias("first"), F.inline(F.filter("g", lambda x: x["kind"] == "backup")))
    aligned = F.coalesce((F.col("reach") > 0) & (F.col("seq") == F.col("first")) & (F.col("seq") < F.col("hi")), F.lit(False))
    return out.select(*MEASURE, "seq", F.when(aligned, F.col("reach")).otherwise(F.col("duration")).alias("duration"))


def synced_syllables(target: DataFrame, reference: DataFrame) -> DataFrame:
    """score_id, place, measure_no, source, from_measure and from_seq of the syllables that the target part gets.

    Both: a syllable per row with measure_no and seq. The target's take the places of the reference's, one for one; places beyond them keep the reference's own,
    and what has no place goes to the last measure.
    """
    w = Window.partitionBy("score_id").orderBy("measure_no", "seq")
    numbered = lambda df, p: df.select("score_id", F.row_number().over(w).cast("long").alias("place"), F.col("measure_no").alias(f"{p}_measure"), F.col("seq").alias(f"{p}_seq"))
    own, ref = numbered(target, "t"), numbered(reference, "r")
    last = ref.groupBy("score_id").agg(F.max("r_measure").alias("last"))
    both = ref.join(own, ["score_id", "place"], "full").join(last, "score_id")
    source = F.when(F.col("t_seq").isNull(), "reference").otherwise("target")
    return both.select("score_id", "place", F.coalesce("r_measure", "last").alias("measure_no"), source.alias("source"), F.coalesce("t_measure", "r_measure").alias("from_measure"), F.coalesce("t_seq", "r_seq").alias("from_seq"))
