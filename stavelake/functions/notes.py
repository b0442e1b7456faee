"""Column functions on notes: pitch, length, type, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STEPS = "CDEFGAB"
SEMITONES = (0, 2, 4, 5, 7, 9, 11)
TYPE_UNITS = (("whole", 16), ("half", 8), ("quarter", 4), ("eighth", 2), ("16th", 1), ("32nd", 0.5), ("64th", 0.25))
DOTS = (1.0, 1.5, 1.75)


def spelling(midi: Column) -> tuple[Column, Column, Column]:
    """(step, alter, octave) with sharps."""
    names = ["C", "C", "D", "D", "E", "F", "F", "G", "G", "A", "A", "B"]
    pc = F.pmod(midi, F.lit(12)).cast("int")
    step = F.element_at(F.array(*map(F.lit, names)), pc + 1)
    alter = F.when(pc.isin(1, 3, 6, 8, 10), 1).otherwise(0)
    return step, alter, (F.floor(midi / 12) - 1).cast("long")


def transpose(midi: Column, semitones: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(127), midi + F.greatest(F.lit(-24), F.least(F.lit(24), semitones))))


def diatonic_index(step: Column, octave: Column) -> Column:
    """Steps above C0."""
    return octave * 7 + F.position(step, F.lit(STEPS)) - 1


def type_units(name: Column) -> Column:
    out = F.lit(None).cast("double")
    for kind, units in TYPE_UNITS:
        out = F.when(name == kind, float(units)).otherwise(out)
    return out


def closest_type(duration: Column) -> Column:
    """(type, dots) nearest to a duration; of equal errors the first of the table (longest type, fewest dots)."""
    rows = [(abs_order, kind, dots, units * factor) for abs_order, (kind, units, dots, factor) in enumerate((k, u, d, f) for k, u in TYPE_UNITS for d, f in enumerate(DOTS))]
    table = F.array(*[F.struct(F.abs(duration - units).alias("err"), F.lit(order).alias("ord"), F.lit(kind).alias("type"), F.lit(dots).alias("dots")) for order, kind, dots, units in rows])
    return F.array_min(table)


def undot(duration: Column) -> Column:
    """The base of a dotted standard length; null for a standard one."""
    bases = F.array(*[F.lit(float(u)) for _, u in TYPE_UNITS])
    hit = F.filter(bases, lambda u: (duration == u * 1.5) | (duration == u * 1.75))
    return F.when(F.array_contains(bases, duration.cast("double")), None).otherwise(F.get(hit, F.lit(0)))


def undot_in_measure(duration: Column, measure: Column) -> Column:
    """As ``undot`` in whole divisions, with the measure's length as the first base; what is longer than the measure becomes the measure."""
    whole = [F.lit(int(u)) for _, u in TYPE_UNITS if u >= 1]
    bases = F.array(measure.cast("long"), *[u.cast("long") for u in whole])
    hit = F.filter(bases, lambda u: (duration * 2 == u * 3) | (duration * 4 == u * 7))
    return F.when((duration > 0) & ~F.array_contains(bases, duration), F.coalesce(F.get(hit, F.lit(0)), F.when(duration > measure, measure)))


def type_of(duration: Column, dots: Column, divisions: int = 4) -> Column:
    """Name of a written length with its dots; null where none fits within 0.02 of a quarter."""
    factor = F.when(dots == 0, 1.0).when(dots == 1, 1.5).when(dots == 2, 1.75).otherwise(1.875)
    quarters = duration / divisions / factor
    out = F.lit(None).cast("string")
    for kind, units in reversed(TYPE_UNITS):
        out = F.when(F.abs(quarters - units / 4) < 0.02, kind).otherwise(out)
    return F.when(duration > 0, out)


def middle_line(clef: Column, line: Column) -> tuple[Column, Column]:
    """(step, octave) of the middle of a staff, where its rests are shown."""
    f, c, high = clef == "F", clef == "C", line == 4
    step = F.when(f, "D").when(c & high, "A").when(c, "C").otherwise("B")
    return step, F.when(f | (c & high), 3).otherwise(4)


def voice_norm(voice: Column) -> Column:
    v = F.trim(voice)
    return F.when(F.lower(v).isin("*", "all", "any"), "*").otherwise(F.coalesce(v.try_cast("int").cast("string"), v))


def staff_label(part_no: Column, parts: Column, name: Column) -> Column:
    """Label of a staff from its part's name, then its place."""
    n = F.upper(name)
    has = lambda x: F.contains(n, F.lit(x))
    six = F.element_at(F.array(*map(F.lit, ("S", "A", "T", "B", "PR", "PL"))), F.least(part_no, F.lit(6)).cast("int"))
    return (
        F.when(has("LEFT") | has(" LH"), "PL")
        .when(has("RIGHT") | has(" RH"), "PR")
        .when(has("PIANO") | has("PNO"), "P")
        .when((parts == 6) & part_no.between(1, 6), six)
        .when(has("SOPRANO"), "S")
        .when(has("ALTO"), "A")
        .when(has("TENOR"), "T")
        .when(has("BASS"), "B")
        .otherwise(F.concat(F.lit("P"), part_no.cast("string")))
    )


def staff_label_by_place(part_no: Column, parts: Column, name: Column) -> Column:
    """As ``staff_label``, but the place among six parts decides before the name."""
    six = F.element_at(F.array(*map(F.lit, ("S", "A", "T", "B", "PR", "PL"))), F.least(part_no, F.lit(6)).cast("int"))
    out = F.concat(F.lit("P"), part_no.cast("string"))
    for token, label in reversed((("SOPRANO", "S"), ("ALTO", "A"), ("TENOR", "T"), ("BASS", "B"), ("RIGHT", "PR"), ("LEFT", "PL"), ("PIANO", "P"))):
        out = F.when(F.contains(F.upper(name), F.lit(token)), label).otherwise(out)
    return F.when((parts == 6) & part_no.between(1, 6), six).otherwise(out)
