"""Operators whose state depends on what they took before: folds over the rows of one measure, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stavelake.functions import notes as N
from stavelake.operators.timeline import DIVISIONS, MEASURE, leader, measure_length


def gathered(rows: DataFrame, keys: tuple[str, ...], *columns: str) -> DataFrame:
    """``g``: the rows of each group in order; a group is a voice or staff of one measure."""
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("g"))


def x_clusters(notes: DataFrame, tolerance: int = 12) -> DataFrame:
    """(measure, staff, seq, cluster, anchor): a note joins while it is within the tolerance of the cluster's first x."""
    per = gathered(notes, (*MEASURE, "staff"), "x", "seq")
    folded = per.selectExpr(
        *MEASURE, "staff",
        f"""aggregate(g, cast(array() as array<struct<seq:bigint,cluster:int,anchor:bigint>>), (acc, n) -> concat(acc, array(
              if(size(acc) > 0 and n.x - element_at(acc, -1).anchor <= {tolerance},
                 named_struct('seq', n.seq, 'cluster', element_at(acc, -1).cluster, 'anchor', element_at(acc, -1).anchor),
                 named_struct('seq', n.seq, 'cluster', if(size(acc) > 0, element_at(acc, -1).cluster + 1, 1), 'anchor', n.x))))) AS c""",
    )
    return folded.select(*MEASURE, "staff", F.inline("c"))


def rest_trim(elements: DataFrame) -> DataFrame:
    """(measure, voice, seq, duration) of overfull voices: from the first on, rests shrink to the undotted length of their type while the excess allows it.

    A whole rest has the undotted length that its duration suggests, at most the measure.
    """
    rows = elements.filter(leader()).withColumn("cap", measure_length(F.col("beats")))
    written = F.lit(None).cast("long")
    for kind, units in N.TYPE_UNITS[1:]:
        written = F.when(F.col("type") == kind, max(1, int(units))).otherwise(written)
    target = F.when(F.coalesce(F.col("type"), F.lit("")).isin("whole", ""), N.undot_in_measure(F.col("duration"), F.col("cap"))).otherwise(written)
    cut = F.when((F.col("is_rest") == 1) & (target < F.col("duration")), F.col("duration") - target).otherwise(0)
    per = rows.withColumn("cut", cut).groupBy(*MEASURE, "voice", "cap").agg(F.array_sort(F.collect_list(F.struct("seq", "duration", "cut"))).alias("g"), F.sum("duration").alias("total")).filter("total > cap")
    folded = per.selectExpr(
        *MEASURE, "voice",
        """aggregate(g, named_struct('left', total - cap, 'out', cast(array() as array<struct<seq:bigint,duration:bigint>>)), (acc, n) ->
             named_struct('left', acc.left - if(n.cut <= acc.left, n.cut, 0), 'out', concat(acc.out, array(named_struct('seq', n.seq, 'duration', n.duration - if(n.cut <= acc.left, n.cut, 0)))))).out AS c""",
    )
    return folded.select(*MEASURE, "voice", F.inline("c"))


def capped(elements: DataFrame) -> DataFrame:
    """(measure, seq, moved): each element moves the cursor, which stays between 0 and the measure's length."""
    rows = elements.withColumn("cap", measure_length(F.col("beats"))).withColumn("d", F.when(F.col("kind") == "backup", -F.col("duration")).when((F.col("kind") == "forward") | leader(), F.col("duration")).otherwise(0))
    per = gathered(rows, (*MEASURE, "cap"), "seq", "d")
    folded = per.selectExpr(
        *MEASURE,
        """aggregate(g, named_struct('at', 0L, 'out', cast(array() as array<struct<seq:bigint,moved:bigint>>)), (acc, n) ->
             named_struct('at', greatest(0L, least(cap, acc.at + n.d)), 'out', concat(acc.out, array(named_struct('seq', n.seq, 'moved', greatest(0L, least(cap, acc.at + n.d)) - acc.at))))).out AS c""",
    )
    return folded.select(*MEASURE, F.inline("c"))


def coalesced_voices(layers: DataFrame, beats: DataFrame, divisions: int = DIVISIONS) -> DataFrame:
    """(measure, staff, voice, target, gap): voices that the first one of their staff takes in, on staves of three voices or more.

    The first voice must be short of its measure and another fill it to 66 %; that one stays. Short voices are taken by onset and voice while there is
    room, if they start with the first voice, in its second half or at its end. ``gap`` is the rest that must come before the earliest of them.
    """
    tol = max(3, divisions // 4)
    rows = layers.join(beats, list(MEASURE)).withColumn("cap", measure_length(F.col("beats")))
    per = gathered(rows, (*MEASURE, "staff", "cap"), "voice", "first_onset", "total").selectExpr(*MEASURE, "staff", "cap", "g[0] AS p", "slice(g, 2, size(g)) AS others", "cast(floor(cap * 0.66D + 0.5D) AS BIGINT) AS near")
    per = per.filter("size(others) >= 2 and p.total > 0 and p.total < cap and exists(others, v -> v.total >= greatest(1, near))").selectExpr(
        "*",
        f"""array_sort(transform(filter(others, v -> v.total > 0 and v.total < greatest(1, near) and p.total + v.total <= cap + {tol} and
              (v.first_onset <= p.first_onset + {tol} or v.first_onset >= p.first_onset + p.total div 2 or v.first_onset >= p.first_onset + p.total - {tol})),
              v -> named_struct('at', v.first_onset, 'voice', v.voice, 'total', v.total))) AS c""",
    )
    taken = per.selectExpr(
        "*",
        f"""aggregate(c, named_struct('used', 0L, 'out', cast(array() as array<struct<at:bigint,voice:bigint>>)), (acc, v) ->
              if(v.total <= cap - p.total - acc.used + {tol}, named_struct('used', acc.used + v.total, 'out', concat(acc.out, array(named_struct('at', v.at, 'voice', v.voice)))), acc)) AS t""",
    )
    late = "t.out[0].at - p.first_onset - p.total"
    gap = f"if(t.out[0].at <= p.first_onset + {tol}, greatest(0L, cap - p.total - t.used), if({late} > {tol}, {late}, 0L))"
    out = taken.filter("size(t.out) > 0").selectExpr(*MEASURE, "staff", "p.voice AS target", f"{gap} AS gap", "explode(t.out) AS v")
    return out.select(*MEASURE, "staff", F.col("v.voice").alias("voice"), "target", "gap")


#: x of a note without one; it never stands for a common onset.
NO_X = 999_000.0
SAME_X, OPPOSITE_STEMS_X = 2.0, 16.0


def onset_clusters(notes: DataFrame) -> DataFrame:
    """(measure, staff, seq, cluster, anchor, size, repair): chord groups of a staff that sound together by their x.

    notes: with x (null: none), stem (null: none) and beam. A group joins the cluster of the one before it within 2 of the cluster's first x, or within 16 if their
    stems differ; one that follows the end of a beam without a beam of its own, or goes on with a beam, only within 2. ``repair``: a
    cluster of several groups on a staff of one voice, which can not hold them. Grace notes are left out.
    """
    sounding = notes.filter("kind = 'note' and is_grace = 0")
    staff = Window.partitionBy(*MEASURE, "staff")
    first = F.row_number().over(staff.orderBy("seq")) == 1
    leaders = sounding.withColumns({"voices": F.size(F.collect_set("voice").over(staff)), "first": first}).filter("is_chord = 0 or first")
    rows = leaders.withColumn("x", F.coalesce(F.col("x").cast("double"), F.lit(1_000_000.0)))
    per = gathered(rows, (*MEASURE, "staff", "voices"), "seq", "x", "stem", "beam")
    out = "array<struct<seq:bigint,cluster:int,anchor:double,stem:string,beam:bigint>>"

    def step(acc: Column, n: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        gap = F.abs(n["x"] - last["anchor"])
        apart = F.when(last["stem"].isNotNull() & n["stem"].isNotNull() & (last["stem"] != n["stem"]), OPPOSITE_STEMS_X).otherwise(SAME_X)
        in_turn = ((last["beam"] == 3) & (n["beam"] == 0)) | ((last["beam"] != 0) & n["beam"].isin(2, 3))
        joins = F.coalesce((last["anchor"] < NO_X) & (n["x"] < NO_X) & (gap <= F.when(in_turn, SAME_X).otherwise(apart)), F.lit(False))
        row = F.struct(n["seq"].alias("seq"), F.when(joins, last["cluster"]).otherwise(F.coalesce(last["cluster"], F.lit(0)) + 1).alias("cluster"), F.when(joins, last["anchor"]).otherwise(n["x"]).alias("anchor"), n["stem"].alias("stem"), n["beam"].alias("beam"))
        return F.concat(acc, F.array(row))

    folded = per.select(*MEASURE, "staff", "voices", F.inline(F.aggregate("g", F.array().cast(out), step)))
    size = F.count("*").over(Window.partitionBy(*MEASURE, "staff", "cluster"))
    return folded.withColumn("size", size).select(*MEASURE, "staff", "seq", "cluster", "anchor", "size", ((F.col("size") > 1) & (F.col("voices") == 1)).alias("repair"))
