"""The whole correction log in its own order: inserted measures, then each measure's corrections one after another.

Inserted measures need no sequence: a later insert moves numbers as it moves the measures that bear them, so every insert keeps pointing at
the measure that it was made for, and new numbers follow from counts. Within a measure a correction names a note by its place at that moment, which earlier ones
may have moved. A measure's elements and corrections are gathered by one group and replayed by a fold over the corrections in the JVM, spans last, with the
elements as its state; it says which corrections took effect. ``set_at_once`` does the same as sets, for logs that only set columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stavelake.operators.marks import let
from stavelake.operators.overlay import BEGIN, CONTINUE, END, TYPES, gathered
from stavelake.operators.timeline import MEASURE, PART, measure_length

STRUCTURE = ("insertEmptyMeasureBefore", "insertEmptyMeasureAfter")
#: Kinds that set a column and leave all places as they are.
SETS = ("setNoteVoice", "setNoteStaff", "setNotePitch", "setNoteType")
#: Kinds that come after all others of the log.
DEFERRED = ("applyBeam", "removeBeam")
SHORT_TYPES = ("eighth", "16th", "32nd", "64th")
ELEMENT = "kind string, voice long, staff long, duration long, is_rest int, is_chord int, is_grace int, midi long, type string, beam long, play_order long, stem string, x double, was long"
NAMES = [c.split()[0] for c in ELEMENT.split(", ")]


# Inserted measures


def structure_plan(measures: DataFrame, log: DataFrame) -> DataFrame:
    """fix_id, score_id, at, before and applied of every insert. One is applied if all parts of the score have its measure at the same place."""
    placed = measures.withColumn("place", F.row_number().over(Window.partitionBy(*PART).orderBy("measure_no")))
    parts = measures.groupBy("score_id").agg(F.count_distinct("part_no").alias("parts"))
    agreed = placed.groupBy("score_id", "measure_no").agg(F.count("*").alias("n"), F.min("place").alias("low"), F.max("place").alias("high")).join(parts, "score_id")
    agreed = agreed.filter("n = parts and low = high").select("score_id", F.col("measure_no").alias("at"), F.lit(True).alias("applied"))
    inserts = log.filter(F.col("kind").isin(*STRUCTURE)).select("fix_id", "score_id", F.col("measure_no").alias("at"), (F.col("kind") == STRUCTURE[0]).alias("before"))
    return inserts.join(agreed, ["score_id", "at"], "left").withColumn("applied", F.coalesce("applied", F.lit(False)))


def _points(plan: DataFrame) -> DataFrame:
    """score_id and points: the number from which each applied insert moves measures."""
    moved = F.when(F.col("before"), F.col("at")).otherwise(F.col("at") + 1)
    return plan.filter("applied").groupBy("score_id").agg(F.array_sort(F.collect_list(moved)).alias("points"))


def renumbered(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds ``new_no`` to rows with score_id and measure_no."""
    moved = F.size(F.filter("points", lambda p: p <= F.col("measure_no")))
    return rows.join(_points(plan), "score_id", "left").withColumn("new_no", F.col("measure_no") + F.when(F.col("points").isNull(), 0).otherwise(moved)).drop("points")


def new_measures(plan: DataFrame) -> DataFrame:
    """fix_id, score_id, at and new_no of each inserted measure: the earliest insert before a measure is the farthest from it, as is the earliest after it."""
    nth = F.row_number().over(Window.partitionBy("score_id", "at", "before").orderBy("fix_id"))
    n = F.count("*").over(Window.partitionBy("score_id", "at", "before"))
    ranked = plan.filter("applied").withColumns({"back": n - nth + 1, "measure_no": F.col("at")})
    return renumbered(ranked, plan).select("fix_id", "score_id", "at", F.when(F.col("before"), F.col("new_no") - F.col("back")).otherwise(F.col("new_no") + F.col("back")).alias("new_no"))


def default_rests(measures: DataFrame, elements: DataFrame, plan: DataFrame) -> DataFrame:
    """The elements of the inserted measures: in every part a whole rest a staff, a backup before each but the first; length from the meter at the measure of the insert."""
    staves = elements.groupBy(*PART).agg(F.max("staff").alias("staves"))
    meter = measures.select(*PART, F.col("measure_no").alias("at"), measure_length(F.col("beats")).alias("length"))
    rows = new_measures(plan).join(meter, ["score_id", "at"]).join(staves, list(PART), "left")
    staff = F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(F.coalesce("staves", F.lit(1)), F.lit(1)).cast("long")))
    kinds = F.when(F.col("staff") > 1, F.array(F.lit("backup"), F.lit("note"))).otherwise(F.array(F.lit("note")))
    out = rows.withColumn("staff", staff).withColumn("kind", F.explode(kinds))
    seq = F.when(F.col("staff") == 1, 1).otherwise(2 * F.col("staff") - F.when(F.col("kind") == "backup", 2).otherwise(1))
    note = F.col("kind") == "note"
    return out.select(
        *PART, F.col("new_no").alias("measure_no"), seq.cast("long").alias("seq"), "kind", F.when(F.col("staff") == 1, 1).otherwise(5).cast("long").alias("voice"), "staff",
        F.col("length").alias("duration"), note.cast("int").alias("is_rest"), F.when(note, "whole").alias("type"),
    )


# Corrections of one measure


def _notes(els: Column) -> Column:
    """The places of the notes among the elements."""
    return F.filter(F.transform(els, lambda x, i: F.when(x["kind"] == "note", i + 1)), lambda i: i.isNotNull())


class _At:
    """What a correction sees: the elements, the places of the notes, and the chord that note i is in (first to last)."""

    def __init__(self, els: Column, at: Column, f: Column) -> None:
        self.els, self.at, self.f, self.n, self.i = els, at, f, F.size(at), f["seq"].cast("int")
        self.valid = (self.i >= 1) & (self.i <= self.n)

    def note(self, i: Column) -> Column:
        return F.get(self.els, F.get(self.at, i - 1) - 1)

    def _indices(self, holds) -> Column:
        chord = lambda p: F.get(self.els, p - 1)["is_chord"] == 1
        return F.filter(F.transform(self.at, lambda p, k: F.when(holds(k + 1, chord(p)), k + 1)), lambda k: k.isNotNull())

    def first(self, i: Column) -> Column:
        return F.coalesce(F.array_max(self._indices(lambda k, chord: (k <= i) & ~chord)), F.lit(1))

    def last(self, i: Column) -> Column:
        """The last of the members behind note i."""
        return F.coalesce(F.array_min(self._indices(lambda k, chord: (k > i) & ~chord)) - 1, self.n)

    def changed(self, low: Column, high: Column, change) -> Column:
        """The elements with ``change`` on the notes low to high."""
        lo, hi = F.get(self.at, low - 1), F.get(self.at, high - 1)
        return F.transform(self.els, lambda x, k: F.when((x["kind"] == "note") & (k + 1 >= lo) & (k + 1 <= hi), change(x)).otherwise(x))


def _with(x: Column, **fields: Column) -> Column:
    for name, value in fields.items():
        x = x.withField(name, value)
    return x


def _set_group(s: _At, **fields: Column) -> Column:
    return let(s.first(s.i), lambda low: s.changed(low, s.last(low), lambda x: _with(x, **fields)))


def _type(s: _At) -> Column:
    name = F.element_at(F.create_map(*[v for n, t in TYPES.items() for v in (F.lit(n).cast("long"), F.lit(t))]), s.f["arg"])
    last = F.when(s.note(s.i)["is_chord"] == 1, s.i).otherwise(s.last(s.i))
    return s.changed(s.i, last, lambda x: _with(x, type=F.coalesce(name, x["type"]), duration=s.f["arg"]))


def _removed(s: _At) -> Column:
    """Without note i; if it led a chord, the next member leads it."""
    heir = F.when((s.note(s.i)["is_chord"] == 0) & (s.note(s.i + 1)["is_chord"] == 1), F.get(s.at, s.i))
    gone = F.get(s.at, s.i - 1)
    led = F.transform(s.els, lambda x, k: F.when(k + 1 == heir, x.withField("is_chord", F.lit(0))).otherwise(x))
    return F.filter(led, lambda x, k: k + 1 != gone)


def _raised(els: Column, staff: Column, least: Column) -> Column:
    """Play orders of the staff from ``least`` on, one higher; a chord follows its leader."""
    start = F.struct(F.slice(els, 1, 0).alias("out"), F.lit(None).cast("long").alias("order"))

    def step(acc: Column, x: Column) -> Column:
        own = F.when((x["kind"] != "note") | (x["is_chord"] == 1), acc["order"]).when((x["staff"] == staff) & (x["play_order"] >= least), x["play_order"] + 1)
        put = let(own, lambda o: F.struct(F.when((x["kind"] == "note") & o.isNotNull(), x.withField("play_order", o)).otherwise(x).alias("x"), o.alias("o")))
        return let(put, lambda p: F.struct(F.concat(acc["out"], F.array(p["x"])).alias("out"), p["o"].alias("order")))

    return F.aggregate(els, start, step, lambda acc: acc["out"])


def _neighbours(s: _At, i: Column, staff: Column) -> Column:
    """(voice, stem) from note i, the next and the one before, of one staff: the latest seen, until a voice other than 1 and a stem are known."""
    seen = F.filter(F.array(s.note(i), s.note(i + 1), F.when(i > 1, s.note(i - 1))), lambda x: x.isNotNull() & (x["staff"] == staff))
    start = F.struct(F.lit(1).cast("long").alias("voice"), F.lit(None).cast("string").alias("stem"))
    known = lambda a: (a["voice"] != 1) & a["stem"].isNotNull()
    return F.aggregate(seen, start, lambda a, x: F.when(known(a), a).otherwise(F.struct(F.coalesce(x["voice"], a["voice"]).alias("voice"), F.coalesce(x["stem"], a["stem"]).alias("stem"))))


def _between(ax: Column, fx: Column) -> Column:
    """An x behind the anchor: shortly before what follows, halfway if that is near, else a little on."""
    return F.round(F.when(fx > ax + 0.5, F.when(fx - ax > 20, fx - 15).otherwise((ax + fx) / 2)).otherwise(ax + 15), 2)


def _inserted(s: _At, rest: bool) -> Column:
    """A rest, or a note of the pitch that the correction names, behind the chord of note i, on its staff."""

    def placed(end: Column) -> Column:
        anchor = s.note(end)
        later = F.filter(F.transform(s.at, lambda p, k: F.when(k + 1 > end, F.get(s.els, p - 1))), lambda x: x.isNotNull() & (x["staff"] == anchor["staff"]))
        order = anchor["play_order"] + 1
        pos = F.get(s.at, end - 1)
        new = lambda near: F.struct(
            *[
                value.alias(name)
                for name, value in zip(
                    NAMES,
                    [
                        F.lit("note"), near["voice"], anchor["staff"], F.lit(4).cast("long"), F.lit(int(rest)), F.lit(0), F.lit(0), F.lit(None).cast("long") if rest else 36 + F.pmod(s.f["arg"], F.lit(48)), F.lit("quarter"),
                        F.lit(0).cast("long"), order, F.lit(None).cast("string") if rest else near["stem"], _between(anchor["x"], F.get(later, F.lit(0))["x"]), F.lit(None).cast("long"),
                    ],
                )
            ]
        )
        raised = F.when(order.isNotNull(), _raised(s.els, anchor["staff"], order)).otherwise(s.els)
        return let(raised, lambda els: let(_neighbours(s, end, anchor["staff"]), lambda near: F.concat(F.slice(els, F.lit(1), pos), F.array(new(near)), F.slice(els, pos + 1, F.size(els)))))

    return let(s.last(s.first(s.i)), placed)


def _member(s: _At) -> Column:
    """A chord member behind the chord of note i, null if that is a rest or has the pitch."""
    pitch = 36 + F.pmod(s.f["arg"], F.lit(48))

    def placed(c: Column) -> Column:
        low, end = c["low"], c["end"]
        lead, pos = s.note(low), F.get(s.at, end - 1)
        held = F.exists(F.transform(s.at, lambda p, k: (k + 1 >= low) & (k + 1 <= end) & (F.get(s.els, p - 1)["is_rest"] == 0) & (F.get(s.els, p - 1)["midi"] == pitch)), lambda x: x)
        new = _with(lead, is_chord=F.lit(1), midi=pitch, beam=F.lit(0).cast("long"), was=F.lit(None).cast("long"))
        return F.when((lead["is_rest"] == 0) & ~held, F.concat(F.slice(s.els, F.lit(1), pos), F.array(new), F.slice(s.els, pos + 1, F.size(s.els))))

    return let(let(s.first(s.i), lambda low: F.struct(low.alias("low"), s.last(low).alias("end"))), placed)


def _unbeamed(s: _At) -> Column:
    """Without the beams of notes i to ``to_seq`` and of the members behind the last; null if there are none."""
    to = s.f["to_seq"].cast("int")
    end = F.when(s.note(to + 1)["is_chord"] == 1, s.last(to)).otherwise(to)
    lo, hi = F.get(s.at, s.i - 1), F.get(s.at, end - 1)
    some = F.exists(F.transform(s.els, lambda x, k: (x["kind"] == "note") & (k + 1 >= lo) & (k + 1 <= hi) & (x["beam"] != 0)), lambda x: x)
    return F.when((to >= s.i) & (to <= s.n) & some, s.changed(s.i, end, lambda x: x.withField("beam", F.lit(0).cast("long"))))


def _beamed(s: _At) -> Column:
    """One beam over the pitched leaders from the chord of note i to ``to_seq``, all of short types and all or none grace notes; what it spans takes the first one's voice, staff and stem. Else null."""
    to = s.f["to_seq"].cast("int")

    def over(low: Column) -> Column:
        inside = F.filter(F.transform(s.at, lambda p, k: F.when((k + 1 >= low) & (k + 1 <= to), F.struct((k + 1).alias("i"), p.alias("p"), F.get(s.els, p - 1).alias("x")))), lambda c: c.isNotNull())
        return let(F.filter(inside, lambda c: (c["x"]["is_rest"] == 0) & (c["x"]["is_chord"] == 0)), spanned)

    def spanned(leaders: Column) -> Column:
        first, last = F.get(leaders, F.lit(0)), F.get(leaders, F.size(leaders) - 1)
        fine = (F.size(leaders) >= 2) & F.forall(leaders, lambda c: c["x"]["type"].isin(*SHORT_TYPES) & (c["x"]["is_grace"] == first["x"]["is_grace"]))
        end = F.get(s.at, s.last(last["i"]) - 1)
        led = F.transform(leaders, lambda c: c["p"])
        value = lambda place: F.when(place == first["p"], BEGIN).when(place == last["p"], END).when(F.array_contains(led, place), CONTINUE).otherwise(0).cast("long")
        own = lambda x: F.when((x["is_rest"] == 0) & (first["x"]["is_grace"] == 0), _with(x, voice=first["x"]["voice"], staff=first["x"]["staff"], stem=F.coalesce(first["x"]["stem"], x["stem"]))).otherwise(x)
        new = F.transform(s.els, lambda x, k: F.when((x["kind"] == "note") & (k + 1 >= first["p"]) & (k + 1 <= end), own(x).withField("beam", value(k + 1))).otherwise(x))
        return F.when(fine, new)

    return F.when(to <= s.n, let(s.first(s.i), over))


def _applied(els: Column, at: Column, f: Column) -> Column:
    """The elements after one correction, null if it finds no target."""
    s = _At(els, at, f)
    kind, arg = f["kind"], f["arg"]
    only = lambda **fields: s.changed(s.i, s.i, lambda x: _with(x, **fields))
    done = (
        F.when(kind == "setNoteVoice", _set_group(s, voice=arg)).when(kind == "setNoteStaff", only(staff=arg)).when(kind == "setNotePitch", F.when(s.note(s.i)["is_rest"] == 0, only(midi=arg)))
        .when(kind == "setNoteType", _type(s)).when(kind == "setPlayOrder", _set_group(s, play_order=arg)).when(kind == "removeNote", _removed(s)).when(kind == "insertRest", _inserted(s, True))
        .when(kind == "insertNote", _inserted(s, False)).when(kind == "insertChordMember", _member(s)).when(kind == "removeBeam", _unbeamed(s)).when(kind == "applyBeam", _beamed(s))
    )
    return F.when(s.valid, done)


def _fix() -> Column:
    return F.struct(F.col("kind").isin(*DEFERRED).alias("deferred"), "fix_id", "kind", F.col("seq").cast("long").alias("seq"), F.col("to_seq").cast("long").alias("to_seq"), F.col("arg").cast("long").alias("arg"))


def replayed(elements: DataFrame, fixes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(elements, fix_id and applied): the measures that have corrections, these taken one after another."""
    return _folded(_gathered(elements, fixes).filter(F.size("fixes") > 0))


def _gathered(elements: DataFrame, fixes: DataFrame) -> DataFrame:
    # Notes that the fold inserts have no ``was``, so its type has to allow null.
    rows = elements.withColumn("was", F.nullif("was", F.lit(-1)))
    per = gathered(rows, fixes, F.struct("seq", F.struct(*NAMES).alias("e")), _fix())
    return per.select(*MEASURE, F.transform("els", lambda x: x["e"]).alias("els"), "fixes")


def _folded(per: DataFrame) -> tuple[DataFrame, DataFrame]:
    start = F.struct(F.col("els").alias("els"), F.array().cast("array<long>").alias("done"))

    def step(acc: Column, f: Column) -> Column:
        after = let(_notes(acc["els"]), lambda at: _applied(acc["els"], at, f))
        return let(after, lambda els: F.when(els.isNull(), acc).otherwise(F.struct(els.alias("els"), F.concat(acc["done"], F.array(f["fix_id"])).alias("done"))))

    out = per.select(*MEASURE, F.aggregate("fixes", start, step).alias("r"))
    rows = out.select(*MEASURE, F.posexplode("r.els").alias("seq", "e")).select(*MEASURE, (F.col("seq") + 1).cast("long").alias("seq"), "e.*")
    return rows, out.select(F.explode("r.done").alias("fix_id"), F.lit(True).alias("applied"))


def set_at_once(elements: DataFrame, fixes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same for corrections that only set columns: the last one for each note holds, whatever lies between."""
    w = Window.partitionBy(*MEASURE).orderBy("seq")
    note = F.col("kind") == "note"
    placed = elements.withColumn("place", F.when(note, F.sum(note.cast("int")).over(w)))
    placed = placed.withColumn("lead", F.when(note, F.coalesce(F.max(F.when(F.col("is_chord") == 0, F.col("place"))).over(w), F.lit(1))))
    notes = placed.filter(note).select(*MEASURE, "place", "lead", "is_rest")
    hits = fixes.join(notes, [fixes[c] == notes[c] for c in MEASURE] + [fixes["seq"] == notes["place"]]).select(fixes["*"], "place", "lead", "is_rest").filter("kind != 'setNotePitch' or is_rest = 0")
    # A voice is its chord's; a type that a leader is given is its members' too.
    last = lambda kind, key: hits.filter(F.col("kind") == kind).groupBy(*MEASURE, F.col(key)).agg(F.max(F.struct("fix_id", "arg")).alias(kind))
    of_leader = hits.filter("kind = 'setNoteType' and place = lead").groupBy(*MEASURE, "lead").agg(F.max(F.struct("fix_id", "arg")).alias("of_leader"))
    out = placed.join(last("setNoteVoice", "lead"), [*MEASURE, "lead"], "left").join(of_leader, [*MEASURE, "lead"], "left")
    for kind in ("setNoteStaff", "setNotePitch", "setNoteType"):
        out = out.join(last(kind, "place"), [*MEASURE, "place"], "left")
    length = F.greatest("setNoteType", "of_leader")["arg"]
    name = F.element_at(F.create_map(*[v for n, t in TYPES.items() for v in (F.lit(n).cast("long"), F.lit(t))]), length)
    new = {"voice": F.coalesce("setNoteVoice.arg", "voice"), "staff": F.coalesce("setNoteStaff.arg", "staff"), "midi": F.coalesce("setNotePitch.arg", "midi"), "type": F.coalesce(name, "type"), "duration": F.coalesce(length, "duration")}
    return out.withColumns(new).select(*MEASURE, "seq", *NAMES), hits.select("fix_id", F.lit(True).alias("applied"))


def apply_all(measures: DataFrame, elements: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(elements after the whole log, fix_id and applied of every correction). elements: a score's elements with stem; log: merged, with to_seq."""
    plan = structure_plan(measures, log)
    rests = default_rests(measures, elements, plan)
    moved, pending = (renumbered(x, plan).withColumn("measure_no", F.col("new_no")).drop("new_no") for x in (elements, log.filter(~F.col("kind").isin(*STRUCTURE))))
    filled = {"is_chord": F.lit(0), "is_grace": F.lit(0), "midi": F.lit(None).cast("long"), "beam": F.lit(0).cast("long"), "play_order": F.lit(None).cast("long"), "stem": F.lit(None).cast("string"), "x": F.lit(None).cast("double"), "was": F.lit(None).cast("long")}
    typed = [F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in ELEMENT.split(", ")]
    rows, fold_done = _folded(_gathered(moved.withColumn("was", F.col("seq")).select(*MEASURE, "seq", *typed), pending))
    done = fold_done.unionByName(plan.filter("applied").select("fix_id", "applied"))
    report = log.select("fix_id").join(done, "fix_id", "left").withColumn("applied", F.coalesce("applied", F.lit(False)))
    return rows.unionByName(rests.withColumns(filled).select(*MEASURE, "seq", *typed)), report
