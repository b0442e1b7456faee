"""Slurs and wedges against plain folds over whole parts."""

import random
from collections import defaultdict

import pytest

from stavelake.operators import marks

SLURS = "score_id long, part_no long, measure_no long, seq long, mark_no long, type string, staff long, number long, noise long"
WEDGES = "score_id long, part_no long, measure_no long, staff long, seq long, place double, type string, number long, placement string"
NOTES = "score_id long, part_no long, measure_no long, staff long, seq long, voice long"


def plain_slurs(rows):
    """{(measure, seq, mark_no): number} of one part's marks."""
    notes = defaultdict(list)
    for r in rows:
        notes[r[2], r[3]].append(r)
    open_, out, measure, used, renamed = {}, {}, None, set(), {}
    for (m, seq), own in sorted(notes.items()):
        if m != measure:
            measure, used, renamed = m, set(open_), {}
        for kind in ("stop", "start"):
            same = [r for r in own if r[5] == kind]
            if not same:
                continue
            r = min(same, key=lambda r: (r[8], r[4]))
            staff, asked = r[6], 1 if r[7] is None else r[7]
            if kind == "stop":
                found = next((k for k in (renamed.get((staff, asked), asked), asked) if open_.get(k) == staff), None)
                if found is None:
                    continue
                del open_[found]
                used.add(found)
            else:
                found = asked
                if found in open_ or found in used:
                    found = next(k for k in range(1, 99) if k not in open_ and k not in used)
                    renamed[staff, asked] = found
                open_[found] = staff
            out[m, seq, r[4]] = found
    return out


@pytest.mark.parametrize("seed", range(4))
def test_slurs_equal_a_fold_over_the_part(spark, seed):
    rng = random.Random(seed)
    rows = []
    for part in (1, 2, 3):
        for m in range(1, 9):
            for seq in range(1, rng.randint(2, 9)):
                for k in range(1, rng.choice([1, 1, 2, 3, 4])):
                    rows.append((7, part, m, seq, k, rng.choice(["start", "start", "stop"]), rng.randint(1, 2), rng.choice([None, 1, 1, 2, 3]), rng.randint(0, 2)))
    got = defaultdict(dict)
    for r in marks.paired_slurs(spark.createDataFrame(rows, SLURS).repartition(3)).collect():
        got[r["part_no"]][r["measure_no"], r["seq"], r["mark_no"]] = r["number"]
        source = next(s for s in rows if (s[1], s[2], s[3], s[4]) == (r["part_no"], r["measure_no"], r["seq"], r["mark_no"]))
        assert r["changed"] == ((source[7] or 0) != r["number"] or source[8] > 0)
    for part in (1, 2, 3):
        assert got[part] == plain_slurs([r for r in rows if r[1] == part])


def slurs(spark, *rows):
    """Marks of one part, a note each: (measure, type, staff, number)."""
    table = spark.createDataFrame([(1, 1, m, i + 1, 1, kind, staff, number, 0) for i, (m, kind, staff, number) in enumerate(rows)], SLURS)
    return {r["seq"]: r["number"] for r in marks.paired_slurs(table).collect()}


def test_slur_cases(spark):
    # Two staves that ask for the same number get two, and their stops follow.
    assert slurs(spark, (1, "start", 1, 1), (1, "start", 2, 1), (1, "stop", 1, 1), (1, "stop", 2, 1)) == {1: 1, 2: 2, 3: 1, 4: 2}
    # A number freed in a measure is not used again there, but in the next one.
    assert slurs(spark, (1, "start", 1, 1), (1, "stop", 1, 1), (1, "start", 1, 1), (2, "stop", 1, 2), (2, "start", 1, 1)) == {1: 1, 2: 1, 3: 2, 4: 2, 5: 1}
    # A stop without a start of its number goes; it does not end another slur.
    assert slurs(spark, (1, "start", 1, 2), (1, "stop", 1, 1), (3, "stop", 1, 2)) == {1: 2, 3: 2}
    # Overlapping slurs with numbers of their own keep them.
    assert slurs(spark, (1, "start", 1, 1), (1, "start", 1, 2), (2, "stop", 1, 2), (2, "stop", 1, 1)) == {1: 1, 2: 2, 3: 2, 4: 1}
    assert slurs(spark) == {}


def plain_wedges(rows, notes):
    """Kept and inserted wedges of one part, measure by measure with the staves' open wedges."""
    open_, out = {}, []
    for m in sorted({r[2] for r in rows}):
        for staff in sorted({r[3] for r in rows if r[2] == m}):
            own = sorted((r for r in rows if (r[2], r[3]) == (m, staff)), key=lambda r: (r[5], r[4]))
            place = {r[4]: r[5] for r in own}
            is_start = lambda r: r[6] != "stop"
            has_start, has_stop = any(map(is_start, own)), not all(map(is_start, own))
            if has_start and has_stop and staff not in open_ and not is_start(own[0]):
                place[own[0][4]] = float("inf")
                own = own[1:] + own[:1]
            voices = []
            for n in sorted((n for n in notes if (n[2], n[3]) == (m, staff)), key=lambda n: n[4]):
                if n[5] not in voices:
                    voices.append(n[5])
            if len(voices) > 1:
                first = [n[4] for n in notes if (n[2], n[3], n[5]) == (m, staff, voices[0])]
                place |= {r[4]: min(first) - 0.5 if is_start(r) else max(first) + 0.5 for r in own if r[8] == "above"}
            if has_start and staff in open_:
                om, number, placement = open_.pop(staff)
                out.append((om, staff, None, "stop", number, placement, float("inf")))
            gone = has_stop and not has_start and staff not in open_
            out += [] if gone else [(m, staff, r[4], r[6], r[7] or 1, r[8] or "below", place[r[4]]) for r in own]
            if is_start(own[-1]):
                open_[staff] = (m, own[-1][7] or 1, own[-1][8] or "below")
            else:
                open_.pop(staff, None)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_wedges_equal_a_fold_over_the_part(spark, seed):
    rng = random.Random(100 + seed)
    rows, notes = [], []
    for m in range(1, 40):
        for seq in range(1, 6):
            notes.append((1, 1, m, rng.randint(1, 2), seq, rng.choice([1, 1, 1, 2])))
            if rng.random() < 0.25:
                rows.append((1, 1, m, rng.randint(1, 2), seq, seq - 0.5, rng.choice(["crescendo", "diminuendo", "stop", "stop"]), rng.choice([None, 1, 2]), rng.choice([None, "above", "below"])))
    got = marks.paired_wedges(spark.createDataFrame(rows, WEDGES).repartition(3), spark.createDataFrame(notes, NOTES)).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r["measure_no"], r["staff"], r["seq"], r["type"], r["number"], r["placement"], r["place"]) for r in got), key=key) == sorted(plain_wedges(rows, notes), key=key)
    assert all(r["y"] == (25 if r["placement"] == "above" else None) for r in got)


def plain_beams(notes, beams):
    """{(measure, seq, number)} of the beams that stay: runs are followed and taken off when they break."""
    own = {}
    for _, _, m, seq, no, number, value in sorted(beams, key=lambda b: b[4]):
        own.setdefault((m, seq, number or 1), value)
    kept = set(own)
    for layer in {(n[2], n[4], n[5]) for n in notes}:
        line = sorted(n[3] for n in notes if (n[2], n[4], n[5]) == layer)
        for number in {k[2] for k in own if k[0] == layer[0] and k[1] in line}:
            run = []
            drop = lambda seqs: kept.difference_update({(layer[0], s, number) for s in seqs})
            for seq in line:
                value = own.get((layer[0], seq, number))
                if value is None or value == "begin":
                    drop(run)
                    run = [seq] if value else []
                elif not run:
                    drop([seq])
                else:
                    run = run + [seq] if value != "end" else []
            drop(run)
    return kept


def test_beams_by_number_equal_runs_that_are_followed(spark):
    rng = random.Random(6)
    notes, beams = [], []
    for m in range(1, 30):
        for seq in range(1, rng.randint(2, 10)):
            notes.append((1, 1, m, seq, rng.choice([1, 1, 1, 2]), 1))
            for no, number in enumerate(rng.sample([None, 2, 3], rng.randint(1, 3))):
                beams.append((1, 1, m, seq, no, number, rng.choice(["begin", "begin", "continue", "end", "end", "backward hook"])))
    got = marks.valid_beams(
        spark.createDataFrame(beams, "score_id long, part_no long, measure_no long, seq long, beam_no int, number long, value string").repartition(3),
        spark.createDataFrame(notes, "score_id long, part_no long, measure_no long, seq long, staff long, voice long"),
    ).collect()
    assert len(got) == len({(r["measure_no"], r["seq"], r["number"]) for r in got}) > 20
    assert {(r["measure_no"], r["seq"], r["number"]) for r in got} == plain_beams(notes, beams)
