"""Repairs and decisions on whole measures: active parts, registers, key changes, tuplets, gaps, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stavelake.functions import notes as N
from stavelake.operators.timeline import MEASURE, PART, chord_groups, cursor_onset, in_measure, leader, measure_length, preceding, sounding, upto

ACTIVE_CASES = ("silent", "one staff", "two staves", "three staves", "one to one")


def pitched(elements: DataFrame) -> DataFrame:
    return elements.filter("kind = 'note' and is_rest = 0")


def active_cases(elements: DataFrame, measures: DataFrame) -> DataFrame:
    """(score, measure, parts, case): how many parts sound, for every measure of the score; four or more are mapped one to one."""
    everywhere = measures.select("score_id", "measure_no", F.lit(None).cast("long").alias("part_no")).distinct()
    rows = everywhere.unionByName(pitched(elements).select("score_id", "measure_no", "part_no"))
    counted = rows.groupBy("score_id", "measure_no").agg(F.count_distinct("part_no").alias("parts"))
    case = F.element_at(F.array(*map(F.lit, ACTIVE_CASES)), (F.least("parts", F.lit(4)) + 1).cast("int"))
    return counted.select("score_id", "measure_no", "parts", case.alias("case"))


def registers(elements: DataFrame, measures: DataFrame) -> DataFrame:
    """(score, first and last measure, register) of each run of measures in which one part sounds.

    An F clef there, a pitch down to D3 or a mean below the middle of B3 and C4 make it men's; heights are staff steps in tenths.
    """
    step, alter, octave = N.spelling(F.col("midi"))
    height = 10 * N.diatonic_index(step, octave) + alter
    sung = pitched(elements).groupBy(*MEASURE).agg(F.min(height).alias("low"), F.sum(height).alias("sum"), F.count("*").alias("n"))
    rows = measures.select(*MEASURE, "clef").join(sung, list(MEASURE), "left")
    active = F.col("n").isNotNull()
    per = rows.groupBy("score_id", "measure_no").agg(
        F.count_if(active).alias("parts"), F.bool_or(active & F.coalesce(F.col("clef") == "F", F.lit(False))).alias("f"), F.min("low").alias("low"), F.sum("sum").alias("sum"), F.sum("n").alias("n")
    )
    w = Window.partitionBy("score_id").orderBy("measure_no")
    placed = per.withColumn("place", F.row_number().over(w)).filter("parts = 1").withColumn("block", F.col("place") - F.row_number().over(w))
    blocks = placed.groupBy("score_id", "block").agg(
        F.min("measure_no").alias("first_measure"), F.max("measure_no").alias("last_measure"), F.bool_or("f").alias("f"), F.min("low").alias("low"), F.sum("sum").alias("sum"), F.sum("n").alias("n")
    )
    men = F.col("f") | (F.col("low") <= 220) | (F.col("sum") < 275 * F.col("n"))
    return blocks.select("score_id", "first_measure", "last_measure", F.when(men, "men").otherwise("women").alias("register"))


def key_change_votes(measures: DataFrame) -> DataFrame:
    """(score, measure, fifths, n): the key that most parts change to, where another part has an F clef and no key; ties give none."""
    before = F.coalesce(F.last("fifths", ignorenulls=True).over(preceding(Window.partitionBy(*PART).orderBy("measure_no"))), F.lit(0))
    changed = F.when(F.col("fifths") != before, F.col("fifths"))
    bare = F.coalesce(F.col("clef") == "F", F.lit(False)) & F.col("fifths").isNull()
    votes = measures.select("score_id", "measure_no", changed.alias("to"), bare.alias("bare")).groupBy("score_id", "measure_no", "to").agg(F.count("*").alias("n"), F.bool_or("bare").alias("bare"))
    ranked = F.reverse(F.array_sort(F.collect_list(F.when(F.col("to").isNotNull(), F.struct("n", "to")))))
    per = votes.groupBy("score_id", "measure_no").agg(F.bool_or("bare").alias("bare"), ranked.alias("v"))
    top, second = F.get("v", F.lit(0)), F.get("v", F.lit(1))
    won = F.col("bare") & (F.size("v") > 0) & (second.isNull() | (top["n"] > second["n"]))
    return per.filter(won).select("score_id", "measure_no", top["to"].alias("fifths"), top["n"].alias("n"))


def tuplet_spans(notes: DataFrame, start: Column, stop: Column) -> DataFrame:
    """(measure, first_seq, last_seq): each stop closes the latest start since the stop before it; other marks are ignored."""
    rows = notes.select(*MEASURE, "seq", F.when(start, F.col("seq")).alias("begin"), F.when(stop, F.col("seq")).alias("end"))
    begun = F.last("begin", ignorenulls=True).over(upto(in_measure()))
    ended = F.last("end", ignorenulls=True).over(preceding(in_measure()))
    rows = rows.withColumns({"begun": begun, "ended": ended}).filter("end is not null and begun > coalesce(ended, -1)")
    return rows.select(*MEASURE, F.col("begun").alias("first_seq"), F.col("end").alias("last_seq"))


def apportioned(leaders: DataFrame) -> DataFrame:
    """(measure, seq, share): durations of a voice scaled to its measure, rounded to 1 or more; the largest residuals even out what is over, one each."""
    keys = (*MEASURE, "voice")
    w = Window.partitionBy(*keys)
    s = leaders.withColumn("target", measure_length(F.col("beats"))).withColumn("raw", F.col("target") * F.col("duration") / F.sum("duration").over(w))
    s = s.withColumn("out", F.greatest(F.lit(1), F.bround("raw").cast("long"))).withColumn("rest", F.col("raw") - F.col("out"))
    s = s.withColumns({
        "diff": F.col("target") - F.sum("out").over(w),
        "up": F.row_number().over(w.orderBy(F.col("rest").desc(), "seq")),
        "down": F.row_number().over(w.orderBy(F.col("out") < 2, "rest", "seq")),
    })
    more = F.when(F.col("up") <= F.col("diff"), 1).when((F.col("out") >= 2) & (F.col("down") <= -F.col("diff")), -1).otherwise(0)
    return s.select(*MEASURE, "seq", (F.col("out") + more).alias("share"))


def end_gaps(elements: DataFrame) -> DataFrame:
    """(measure, gap): what the cursor lacks at the end of measures that no voice may be padded in: those with a backup or without notes."""
    delta = F.when(F.col("kind") == "backup", -F.col("duration")).when((F.col("kind") == "forward") | leader(), F.col("duration")).otherwise(0)
    rows = cursor_onset(elements.filter("implicit = 0")).withColumn("at", F.greatest(F.lit(0), F.col("onset") + delta))
    per = rows.groupBy(*MEASURE, "beats").agg(F.max_by("at", "seq").alias("end"), F.bool_or(F.col("kind") == "backup").alias("back"), F.bool_or(leader()).alias("voiced"))
    return per.filter("back or not voiced").select(*MEASURE, (measure_length(F.col("beats")) - F.col("end")).alias("gap")).filter("gap > 0")


def split_voices(elements: DataFrame, targets: int = 2) -> DataFrame:
    """(measure, staff, seq, target) of staves with several pitched voices: the k-th voice is the k-th target's, the last takes the rest; rests are everyone's."""
    staff = (*MEASURE, "staff")
    sung = F.when(F.col("is_rest") == 0, F.col("voice").cast("string"))
    rows = elements.filter("kind = 'note'").withColumn("sung", sung)
    rows = rows.withColumns({"voices": F.size(F.collect_set("sung").over(Window.partitionBy(*staff))), "rank": F.dense_rank().over(Window.partitionBy(*staff).orderBy(F.col("sung").asc_nulls_last()))})
    everyone = F.array(*[F.lit(t) for t in range(1, targets + 1)])
    mine = F.when(F.col("is_rest") == 1, everyone).otherwise(F.array(F.least("rank", F.lit(targets))))
    return rows.filter("voices > 1").select(*staff, "seq", F.explode(mine).alias("target"))


def capped_chords(elements: DataFrame, moved: DataFrame) -> DataFrame:
    """(measure, seq, moved) of all notes but graces: members of a chord follow the capped duration of its first note."""
    groups = chord_groups(sounding(elements)).select(*MEASURE, "seq", "group_no").join(moved, [*MEASURE, "seq"])
    first = F.first("moved").over(Window.partitionBy(*MEASURE, "group_no").orderBy("seq"))
    return groups.select(*MEASURE, "seq", first.alias("moved"))
