"""Timelines built anew against a plain program, and against the cursor."""

import random
from collections import defaultdict

import pytest

from stavelake.operators import rebuild
from stavelake.operators import timeline as L

ELEMENTS = "score_id long, part_no long, measure_no long, seq long, kind string, voice long, staff long, duration long, is_rest int, is_chord int, is_grace int, play_order long, x long"
DIRECTIONS = "score_id long, part_no long, measure_no long, staff long, place double, mark string"


def random_measures(seed):
    rng = random.Random(seed)
    rows, marks = [], []
    for m in range(1, 15):
        for seq in range(1, rng.randint(2, 12)):
            kind = rng.choice(["note"] * 6 + ["backup", "forward"])
            order = rng.choice([None, None, 1, 2, 3]) if m % 2 else None
            rows.append((1, 1, m, seq, kind, rng.randint(1, 2), rng.randint(1, 2), rng.randint(1, 8), 0, int(seq > 1 and rng.random() < 0.3), int(rng.random() < 0.1), order, rng.randint(0, 300)))
            if rng.random() < 0.3:
                marks.append((1, 1, m, rng.randint(1, 3), seq + rng.choice([-0.5, 0.5]), rng.choice(["stop", "crescendo", "words"])))
    return rows, list({(r[2], r[4]): r for r in marks}.values())


def plain(rows, marks):
    """[(kind, staff, voice, duration, was, mark)] of one measure."""
    items = sorted([(float(r[3]), r) for r in rows] + [(d[4], d) for d in marks], key=lambda p: p[0])
    notes = [r for _, r in items if len(r) > 6 and r[4] == "note"]
    before, behind, opening = defaultdict(list), defaultdict(list), defaultdict(list)
    last = None
    for i, (_, r) in enumerate(items):
        if len(r) > 6:
            last = r if r[4] == "note" else None
            continue
        after = next((n for _, n in items[i + 1 :] if len(n) > 6 and n[4] == "note"), None)
        if r[5] != "stop" and after:
            before[after[3]].append(r)
        elif last and last[6] == r[3]:
            behind[last[3]].append(r)
        else:
            opening[r[3]].append(r)
    out, staff_total = [], None
    for staff in sorted({n[6] for n in notes}):
        voices = sorted({n[5] for n in notes if n[6] == staff})
        out += [("direction", staff, voices[0], None, None, d[5]) for d in opening[staff]]
        totals = []
        for voice in voices:
            own = [n for n in notes if (n[6], n[5]) == (staff, voice)]
            groups = []
            for n in own:
                if n[9] and groups:
                    groups[-1].append(n)
                else:
                    groups.append([n])
            if any(g[0][11] is not None for g in groups):
                groups.sort(key=lambda g: (g[0][11], 0, g[0][3]) if g[0][11] is not None else (rebuild.LAST, g[0][12], g[0][3]))
            if totals or staff_total is not None:
                out.append(("backup", staff, voice, totals[-1] if totals else staff_total, None, None))
            for n in (n for g in groups for n in g):
                mark = lambda d: ("direction", staff, voice, None, None, d[5])
                out += [*map(mark, before[n[3]]), ("note", staff, voice, n[7], n[3], None), *map(mark, behind[n[3]])]
            totals.append(sum(n[7] for n in own if not n[9] and not n[10]))
        staff_total = max(totals)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_rebuilt_rows_equal_a_plain_program(spark, seed):
    rows, marks = random_measures(seed)
    elements, directions = spark.createDataFrame(rows, ELEMENTS).repartition(3), spark.createDataFrame(marks, DIRECTIONS)
    got = defaultdict(list)
    for r in sorted(rebuild.rebuilt(elements, directions).collect(), key=lambda r: r["seq"]):
        got[r["measure_no"]].append((r["kind"], r["staff"], r["voice"], r["duration"], r["was"], r["mark"]))
    want = {m: plain([r for r in rows if r[2] == m], [d for d in marks if d[2] == m]) for m in {r[2] for r in rows}}
    assert dict(got) == {m: v for m, v in want.items() if v}


def test_the_cursor_finds_every_layer_from_the_start_and_a_second_run_changes_nothing(spark):
    rows, _ = random_measures(8)
    elements, none = spark.createDataFrame(rows, ELEMENTS), spark.createDataFrame([], DIRECTIONS)
    once = rebuild.rebuilt(elements, none)
    old = elements.drop("kind", "voice", "staff", "duration").withColumnRenamed("seq", "was")
    full = once.drop("mark").join(old, [*L.MEASURE, "was"], "left").fillna({"is_rest": 0, "is_chord": 0, "is_grace": 0})
    at = defaultdict(int)
    onset = {(r["measure_no"], r["was"]): r["onset"] for r in L.cursor_onset(full).filter("kind = 'note'").collect()}
    for r in sorted(full.filter("kind = 'note'").collect(), key=lambda r: (r["measure_no"], r["seq"])):
        layer = (r["measure_no"], r["staff"], r["voice"])
        assert onset[r["measure_no"], r["was"]] == at[layer]
        at[layer] += 0 if r["is_chord"] or r["is_grace"] else r["duration"]
    twice = rebuild.rebuilt(full.drop("was"), none)
    shape = lambda df: sorted((r["measure_no"], r["seq"], r["kind"], r["staff"], r["voice"], r["duration"]) for r in df.collect())
    assert shape(twice) == shape(once) and all(r["was"] in (None, r["seq"]) for r in twice.collect())
