"""Ordered-sequence operators on score elements: meters, onsets, play order, chords, voices.

Every operator keys by (score_id, part_no, measure_no) and orders by seq, so a window never spans more than one part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART = ("score_id", "part_no")
MEASURE = (*PART, "measure_no")
DIVISIONS = 4


def in_measure(*more: str):
    return Window.partitionBy(*MEASURE, *more).orderBy("seq")


def whole(*keys: str):
    return Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def following(w):
    return w.rowsBetween(1, Window.unboundedFollowing)


def preceding(w):
    return w.rowsBetween(Window.unboundedPreceding, -1)


def upto(w):
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def measure_length(beats: Column, beat_type: Column | int = 4, divisions: Column | int = DIVISIONS) -> Column:
    """Length of a measure in divisions; halves round to even."""
    return F.greatest(F.lit(1), F.bround(divisions * beats * 4 / beat_type).cast("long"))


def leader() -> Column:
    """A note that moves the cursor: neither a chord member nor a grace note."""
    return (F.col("kind") == "note") & (F.col("is_chord") == 0) & (F.col("is_grace") == 0)


def carried(value: str, *keys: str, default: int | str | None = None, strict: bool = False, order: str = "measure_no") -> Column:
    """The last declared value up to (or, if strict, before) the row."""
    w = Window.partitionBy(*keys).orderBy(order)
    found = F.last(value, ignorenulls=True).over(preceding(w) if strict else upto(w))
    return F.coalesce(found, F.lit(default)) if default is not None else found




def cursor_onset(elements: DataFrame) -> DataFrame:
    """Adds ``onset``: notes and forwards advance, backups go back, never below 0."""
    d = F.col("duration")
    delta = F.when(F.col("kind") == "backup", -d).when((F.col("kind") == "forward") | leader(), d).otherwise(0)
    w = in_measure()
    out = elements.withColumn("_d", delta).withColumn("_s", F.sum("_d").over(upto(w)))
    reach = F.col("_s") - F.least(F.lit(0), F.min("_s").over(upto(w)))
    before = F.coalesce(F.lag("_w").over(w), F.lit(0))
    return out.withColumn("_w", reach).withColumn("onset", before).drop("_d", "_s", "_w")


def voice_onset(elements: DataFrame) -> DataFrame:
    """Adds ``onset`` of a cursor per voice; a backup or forward moves the voice of the note before it."""
    w = in_measure()
    note_voice = F.when(F.col("kind") == "note", F.col("voice"))
    voice = F.coalesce(F.last(note_voice, ignorenulls=True).over(upto(w)), F.lit(1))
    d = F.col("duration")
    delta = F.when(F.col("kind") == "backup", -d).when((F.col("kind") == "forward") | leader(), d).otherwise(0)
    out = elements.withColumn("_v", voice).withColumn("_d", delta)
    v = Window.partitionBy(*MEASURE, "_v").orderBy("seq")
    out = out.withColumn("_s", F.sum("_d").over(upto(v))).withColumn("_w", F.col("_s") - F.least(F.lit(0), F.min("_s").over(upto(v))))
    return out.withColumn("onset", F.coalesce(F.lag("_w").over(v), F.lit(0))).withColumnRenamed("_v", "cursor_voice").drop("_d", "_s", "_w")


def play_order(onsets: DataFrame) -> DataFrame:
    """Adds ``default_order``: dense rank of onset per staff; a grace note has a rank of its own and comes first."""
    keys = (*MEASURE, "staff")
    w = Window.partitionBy(*keys).orderBy("onset", F.col("is_grace").desc(), "seq")
    changed = F.coalesce(F.lag("onset").over(w) != F.col("onset"), F.lit(True)) | (F.col("is_grace") == 1) | (F.coalesce(F.lag("is_grace").over(w), F.lit(0)) != F.col("is_grace"))
    return onsets.withColumn("_c", changed.cast("int")).withColumn("default_order", F.sum("_c").over(upto(w))).drop("_c")


def chord_groups(notes: DataFrame) -> DataFrame:
    """Adds ``group_no``: a chord member joins the note before it if staff and voice agree, else it starts a group."""
    w = in_measure()
    joins = (F.col("is_chord") == 1) & (F.lag("staff").over(w) == F.col("staff")) & (F.lag("voice").over(w) == F.col("voice"))
    return notes.withColumn("_start", (~F.coalesce(joins, F.lit(False))).cast("int")).withColumn("group_no", F.sum("_start").over(upto(w))).drop("_start")


def sounding(elements: DataFrame) -> DataFrame:
    return elements.filter((F.col("kind") == "note") & (F.col("is_grace") == 0))


def measure_fullness(elements: DataFrame) -> DataFrame:
    """Total duration of each voice against the measure: underfull, overfull or full. Implicit measures are left out."""
    rows = elements.filter(leader() & (F.col("implicit") == 0))
    sums = rows.groupBy(*MEASURE, "voice", "beats").agg(F.sum("duration").alias("total"))
    cap = measure_length(F.col("beats"))
    state = F.when(F.col("total") < cap, "measureUnderfull").when(F.col("total") > cap, "measureOverfull").otherwise("full")
    return sums.select(*MEASURE, "voice", "total", cap.alias("capacity"), state.alias("state"))


def voice_layers(onsets: DataFrame) -> DataFrame:
    """First onset, total duration and number of leaders of each voice on a staff."""
    return onsets.filter(leader()).groupBy(*MEASURE, "staff", "voice").agg(F.min("onset").alias("first_onset"), F.sum("duration").alias("total"), F.count("*").alias("leaders"))


def attachable(elements: DataFrame) -> DataFrame:
    """Notes that take a syllable: no rests or graces; of a chord in one voice only the first."""
    base = elements.filter((F.col("kind") == "note") & (F.col("is_rest") == 0) & (F.col("is_grace") == 0))
    follows = (F.col("is_chord") == 1) & (F.lag("voice").over(in_measure()) == F.col("voice"))
    return base.withColumn("_f", F.coalesce(follows, F.lit(False))).filter("not _f").drop("_f")


def sung_by(attachables: DataFrame, voice: int) -> DataFrame:
    """The notes that a voice's syllables go on, one after another: its own, and where it is absent from the rest of a measure, the notes that are there."""
    last = F.max(F.when(F.col("voice") == voice, F.col("seq"))).over(Window.partitionBy(*MEASURE))
    return attachables.withColumn("_last", last).filter((F.col("voice") == voice) | F.col("_last").isNull() | (F.col("seq") > F.col("_last"))).drop("_last")


def dangling(elements: DataFrame) -> DataFrame:
    """Backups and forwards without notes on the sides that they need."""
    note = (F.col("kind") == "note").cast("int")
    after = F.coalesce(F.max(note).over(following(in_measure())), F.lit(0))
    before = F.coalesce(F.max(note).over(preceding(in_measure())), F.lit(0))
    rows = elements.withColumns({"_a": after, "_b": before})
    return rows.filter(((F.col("kind") == "forward") & (F.col("_a") == 0)) | ((F.col("kind") == "backup") & ((F.col("_a") == 0) | (F.col("_b") == 0)))).drop("_a", "_b")


def key_repair(measures: DataFrame) -> DataFrame:
    """Adds ``key``: at a new system a declared key of 0 against a current one is taken for a misreading.

    A repaired value never becomes current, so the current key is the last one that is no suspect.
    """
    w = Window.partitionBy(*PART).orderBy("measure_no")
    suspect = (F.col("new_system") == 1) & (F.col("fifths") == 0)
    kept = F.when(F.col("fifths").isNotNull() & ~suspect, F.col("fifths"))
    current = F.coalesce(F.last(kept, ignorenulls=True).over(preceding(w)), F.lit(0))
    return measures.withColumn("key", F.when(suspect & (current != 0), current).otherwise(F.col("fifths")))
