"""The whole correction log against a plain program that takes one correction after another."""

import random
from collections import defaultdict

import pytest

from stavelake.operators import replay
from stavelake.operators.overlay import TYPES

MEASURES = "score_id long, part_no long, measure_no long, beats int"
ELEMENTS = "score_id long, part_no long, measure_no long, seq long, " + replay.ELEMENT
LOG = "fix_id long, score_id long, part_no long, measure_no long, kind string, seq long, to_seq long, arg long"
KINDS = (*replay.SETS, "setPlayOrder", "removeNote", "insertRest", "insertNote", "insertChordMember", "applyBeam", "removeBeam")


def plain_fix(els, f):
    """Applies one correction to a measure's elements (dicts); says whether it took effect."""
    kind, i, arg = f["kind"], f["seq"] - 1, f["arg"]
    notes = [e for e in els if e["kind"] == "note"]
    if not 0 <= i < len(notes):
        return False

    def leader(k):
        while k > 0 and notes[k]["is_chord"]:
            k -= 1
        return k

    def members(k):
        out = []
        for n in notes[k + 1 :]:
            if not n["is_chord"]:
                break
            out.append(n)
        return out

    chord = [notes[leader(i)], *members(leader(i))]
    if kind in ("setNoteVoice", "setPlayOrder"):
        for n in chord:
            n["voice" if kind == "setNoteVoice" else "play_order"] = arg
    elif kind == "setNoteStaff":
        notes[i]["staff"] = arg
    elif kind == "setNotePitch":
        if notes[i]["is_rest"]:
            return False
        notes[i]["midi"] = arg
    elif kind == "setNoteType":
        for n in [notes[i]] + ([] if notes[i]["is_chord"] else members(i)):
            n["duration"], n["type"] = arg, TYPES.get(arg, n["type"])
    elif kind == "removeNote":
        if not notes[i]["is_chord"] and members(i):
            members(i)[0]["is_chord"] = 0
        els.remove(notes[i])
    elif kind in ("insertRest", "insertNote"):
        rest, end = kind == "insertRest", leader(i) + len(chord) - 1
        anchor = notes[end]
        voice, stem = 1, None
        for k in (end, end + 1, end - 1):
            if 0 <= k < len(notes) and notes[k]["staff"] == anchor["staff"]:
                if not (voice != 1 and stem):
                    voice, stem = notes[k]["voice"], notes[k]["stem"] or stem
        after = next((n for n in notes[end + 1 :] if n["staff"] == anchor["staff"]), None)
        ax, fx = anchor["x"], after and after["x"]
        x = ax + 15 if fx is None or fx <= ax + 0.5 else fx - 15 if fx - ax > 20 else (ax + fx) / 2
        order = None
        if anchor["play_order"] is not None:
            order = anchor["play_order"] + 1
            for k, n in enumerate(notes):
                if not n["is_chord"] and n["staff"] == anchor["staff"] and n["play_order"] is not None and n["play_order"] >= order:
                    for m in [n, *members(k)]:
                        m["play_order"] = n["play_order"] + (m is n)
        new = dict(kind="note", voice=voice, staff=anchor["staff"], duration=4, is_rest=int(rest), is_chord=0, is_grace=0, midi=None if rest else 36 + arg % 48, type="quarter", beam=0, play_order=order, stem=None if rest else stem, x=round(x, 2), was=None)
        els.insert(next(k for k, e in enumerate(els) if e is anchor) + 1, new)
    elif kind == "insertChordMember":
        pitch = 36 + arg % 48
        if chord[0]["is_rest"] or any(not n["is_rest"] and n["midi"] == pitch for n in chord):
            return False
        els.insert(next(k for k, e in enumerate(els) if e is chord[-1]) + 1, {**chord[0], "is_chord": 1, "midi": pitch, "beam": 0, "was": None})
    elif kind == "removeBeam":
        to = f["to_seq"] - 1
        if to < i or to >= len(notes):
            return False
        span = notes[i : to + 1] + (members(to))
        some = any(n["beam"] for n in span)
        for n in span:
            n["beam"] = 0
        return some
    else:
        to, low = f["to_seq"] - 1, leader(i)
        if to >= len(notes):
            return False
        led = [k for k in range(low, to + 1) if not notes[k]["is_rest"] and not notes[k]["is_chord"]]
        if len(led) < 2 or any(notes[k]["type"] not in replay.SHORT_TYPES for k in led) or len({notes[k]["is_grace"] for k in led}) > 1:
            return False
        first = dict(notes[led[0]])
        for k in range(led[0], led[-1] + 1 + len(members(led[-1]))):
            n = notes[k]
            if not n["is_rest"] and not first["is_grace"]:
                n["voice"], n["staff"], n["stem"] = first["voice"], first["staff"], first["stem"] or n["stem"]
            n["beam"] = 0 if k not in led else 1 if k == led[0] else 3 if k == led[-1] else 2
    return True


def plain_log(measures, elements, log):
    """One score: ({(part, number): elements}, applied fix ids), by lists of measures that are inserted into."""
    parts = {p: [dict(no=m, beats=b, els=[]) for _, p2, m, b in sorted(measures) if p2 == p] for p in sorted({r[1] for r in measures})}
    for e in sorted(elements, key=lambda e: e["seq"]):
        next(m for m in parts[e["part_no"]] if m["no"] == e["measure_no"])["els"].append({**{k: e[k] for k in replay.NAMES}, "was": e["seq"]})
    staves = {p: max([1, *(e["staff"] for m in ms for e in m["els"])]) for p, ms in parts.items()}
    done, log = set(), [dict(f) for f in log]
    for f in [f for f in log if f["kind"] in replay.STRUCTURE]:
        anchor, before = f["measure_no"], f["kind"].endswith("Before")
        places = [[m["no"] for m in ms].index(anchor) if anchor in [m["no"] for m in ms] else -1 for ms in parts.values()]
        if len(set(places)) > 1 or places[0] < 0:
            continue
        done.add(f["fix_id"])
        moves = lambda n: n >= anchor if before else n > anchor
        for p, ms in parts.items():
            length, els = 4 * ms[places[0]]["beats"], []
            blank = dict(is_chord=0, is_grace=0, midi=None, beam=0, play_order=None, stem=None, x=None, was=None, duration=length)
            for staff in range(1, staves[p] + 1):
                voice = 1 if staff == 1 else 5
                els += [] if staff == 1 else [dict(blank, kind="backup", voice=voice, staff=staff, is_rest=0, type=None)]
                els.append(dict(blank, kind="note", voice=voice, staff=staff, is_rest=1, type="whole"))
            for m in ms:
                m["no"] += moves(m["no"])
            ms.insert(places[0] + (not before), dict(no=anchor + (not before), beats=None, els=els))
        for other in log:
            if other is not f:
                other["measure_no"] += moves(other["measure_no"])
    rest = [f for f in log if f["kind"] not in replay.STRUCTURE]
    for f in [f for f in rest if f["kind"] not in replay.DEFERRED] + [f for f in rest if f["kind"] in replay.DEFERRED]:
        m = next((m for m in parts.get(f["part_no"], []) if m["no"] == f["measure_no"]), None)
        if m and plain_fix(m["els"], f):
            done.add(f["fix_id"])
    return {(p, m["no"]): m["els"] for p, ms in parts.items() for m in ms}, done


def random_score(rng, kinds, n_fixes, inserts):
    measures, elements, log = [], [], []
    for part in (1, 2):
        for m in range(1, 7 if part == 1 else 6):
            measures.append((1, part, m, rng.choice([2, 3, 4])))
            for seq in range(1, rng.randint(3, 10)):
                rest = int(rng.random() < 0.2)
                kind = "note" if seq == 1 or rng.random() < 0.9 else rng.choice(["backup", "forward"])
                elements.append(
                    dict(score_id=1, part_no=part, measure_no=m, seq=seq, kind=kind, voice=rng.randint(1, 2), staff=rng.randint(1, 2), duration=rng.randint(1, 8), is_rest=rest, is_chord=int(seq > 1 and not rest and rng.random() < 0.3),
                         is_grace=int(rng.random() < 0.05), midi=None if rest else rng.randint(36, 83), type=rng.choice(["eighth", "eighth", "eighth", "16th", "quarter"]), beam=rng.randint(0, 3),
                         play_order=rng.choice([None, 1, 2, 3]), stem=rng.choice([None, "up", "down"]), x=float(rng.randint(0, 90)), was=None)
                )
    for i in range(n_fixes):
        kind = rng.choice(replay.STRUCTURE) if rng.random() < inserts else rng.choice(kinds)
        arg = rng.choice([1, 2, 4, 8]) if kind == "setNoteType" else rng.randint(1, 40)
        seq = rng.randint(1, 8)
        log.append(dict(fix_id=i, score_id=1, part_no=rng.randint(1, 2), measure_no=rng.randint(1, 8), kind=kind, seq=seq, to_seq=seq + rng.randint(0, 4), arg=arg))
    return measures, elements, log


def frames(spark, measures, elements, log):
    names = [c.strip().split()[0] for c in ELEMENTS.split(",")]
    fields = [c.strip().split()[0] for c in LOG.split(",")]
    return (
        spark.createDataFrame(measures, MEASURES), spark.createDataFrame([tuple(e[n] for n in names) for e in elements], ELEMENTS).drop("was").repartition(3), spark.createDataFrame([tuple(f[n] for n in fields) for f in log], LOG).repartition(2)
    )


def result(rows):
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: r["seq"]):
        out[r["part_no"], r["measure_no"]].append({n: r[n] for n in replay.NAMES})
    return dict(out)


@pytest.mark.parametrize("seed", range(5))
def test_log_equals_one_correction_after_another(spark, seed):
    rng = random.Random(seed)
    score = random_score(rng, KINDS, 90, 0.1)
    rows, report = replay.apply_all(*frames(spark, *score))
    want, done = plain_log(*score)
    assert result(rows.collect()) == {k: v for k, v in want.items() if v}
    assert {r["fix_id"]: r["applied"] for r in report.collect()} == {f["fix_id"]: f["fix_id"] in done for f in score[2]}


def test_sets_at_once_equal_the_fold(spark):
    measures, elements, log = random_score(random.Random(9), replay.SETS, 120, 0)
    _, els, fixes = frames(spark, measures, elements, log)
    touched = {(f["part_no"], f["measure_no"]) for f in log}
    els = els.withColumn("was", els["seq"])
    (at_once, done), (folded, fold_done) = replay.set_at_once(els, fixes), replay.replayed(els, fixes)
    assert {k: v for k, v in result(at_once.collect()).items() if k in touched} == result(folded.collect())
    assert {r["fix_id"] for r in done.collect()} == {r["fix_id"] for r in fold_done.collect()}


@pytest.mark.parametrize("seed", range(3))
def test_inserted_measures_equal_a_sequence_of_inserts(spark, seed):
    rng = random.Random(50 + seed)
    measures, elements, log = random_score(rng, ["setNoteVoice"], 14, 0.9)
    frame, els, fixes = frames(spark, measures, elements, log)
    plan = replay.structure_plan(frame, fixes)
    want, done = plain_log(measures, elements, [f for f in log if f["kind"] in replay.STRUCTURE])
    assert {r["fix_id"] for r in plan.collect() if r["applied"]} == done
    old = {(r["part_no"], r["new_no"]) for r in replay.renumbered(frame, plan).collect()}
    new = {r["new_no"] for r in replay.new_measures(plan).collect()}
    assert {n for _, n in want} == {n for _, n in old} | new and not {(p, n) for p in (1, 2) for n in new} & old
    assert len(new) == len(done)


def test_queries_equal_a_plain_program_on_the_tables(spark, small):
    from stavelake.operators import overlay
    from stavelake.plans.bindings import Bindings
    from stavelake.plans.overlay_queries import fix_replay, fix_report

    b = Bindings(spark, small)
    by_score = [defaultdict(list) for _ in range(3)]
    for r in b.me.collect():
        by_score[0][r["score_id"]].append((r["score_id"], r["part_no"], r["measure_no"], r["beats"]))
    for r in b.se.collect():
        by_score[1][r["score_id"]].append({**r.asDict(), "x": float(r["x"]), "was": None, "stem": ["up", "down", None][r["x"] % 3]})
    for r in sorted(overlay.merged_log(b.fx).collect(), key=lambda r: r["fix_id"]):
        by_score[2][r["score_id"]].append(r.asDict())
    want, done = {}, set()
    for score, log in by_score[2].items():
        if score in by_score[0]:
            found, ids = plain_log(by_score[0][score], by_score[1][score], log)
            want |= {(score, *k): v for k, v in found.items() if v}
            done |= ids
    got = defaultdict(list)
    for r in sorted(fix_replay(b).collect(), key=lambda r: r["seq"]):
        if r["score_id"] in by_score[2]:
            got[r["score_id"], r["part_no"], r["measure_no"]].append({n: r[n] for n in replay.NAMES})
    assert got == want
    report = fix_report(b).collect()
    assert sum(r["applied"] for r in report) == len(done) and sum(r["skipped"] for r in report) == sum(map(len, by_score[2].values())) - len(done) > 0
