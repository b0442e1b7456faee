"""Staff bands against a program that merges one gap at a time, onset clusters against a fold, versions of scores over several syncs."""

import random
from collections import defaultdict

import pytest

from stavelake.operators import folds, layout, replay, restore
from tests.test_replay import ELEMENTS, LOG, plain_log, random_score


def plain_bands(ink, height, expected=6, least=8):
    if height < 2 * least:
        return [(0, height)]
    even = max(least, height // expected)
    cut = [(i * even, min(height, (i + 1) * even)) for i in range(expected)]
    rows = [ink.get(y, 0) for y in range(height)]
    if max(rows) == 0:
        return cut
    limit, bands, y = max(2, int(max(rows) * 0.08)), [], 0
    while y < height:
        y0 = y
        while y < height and rows[y] >= limit:
            y += 1
        if y - y0 >= least:
            bands.append((y0, y))
        y += y == y0
    while len(bands) > expected + 2:
        gaps = [b[0] - a[1] for a, b in zip(bands, bands[1:])]
        i = gaps.index(min(gaps))
        bands[i : i + 2] = [(bands[i][0], bands[i + 1][1])]
    if len(bands) < expected:
        return cut
    return [bands[min(len(bands) - 1, int(i * (len(bands) / expected)))] for i in range(expected)]


def test_staff_bands_equal_merging_one_gap_at_a_time(spark):
    rng = random.Random(2)
    ink, systems = {}, {}
    for page in range(40):
        systems[page] = rng.choice([0, 12, 40, 300, 500])
        ink[page] = {}
        y = 0
        while page % 7 and y < systems[page] + 20:
            n = rng.choice([3, 8, 9, 15])
            ink[page] |= {y + k: rng.choice([1.0, 5.0, 100.0]) if rng.random() < 0.1 else 60.0 for k in range(n)}
            y += n + rng.choice([1, 1, 2, 3, 9])
    rows = spark.createDataFrame([(p, y, v) for p, own in ink.items() for y, v in own.items()], "page long, y long, ink double").repartition(4)
    got = defaultdict(list)
    for r in sorted(layout.staff_bands(rows, spark.createDataFrame(list(systems.items()), "page long, height long")).collect()):
        assert r["band"] == len(got[r["page"]])
        got[r["page"]].append((r["y0"], r["y1"]))
    assert got == {p: plain_bands(ink[p], h) for p, h in systems.items()}


@pytest.mark.parametrize("case, clusters", [
    ([(10, "up", 0), (11, "up", 0), (13, "up", 0)], [1, 1, 2]),  # within 2 of the first x, not of the one before
    ([(10, "up", 0), (24, "down", 0)], [1, 1]),  # stems apart: within 16
    ([(10, "up", 1), (24, "down", 3)], [1, 2]),  # a beam that goes on is a sequence
    ([(10, "up", 3), (24, "down", 0)], [1, 2]),  # so is what follows its end
    ([(10, "up", 3), (12, "down", 0)], [1, 1]),  # unless at the same x
    ([(None, "up", 0), (None, "down", 0)], [1, 2]),  # no x is no evidence
    ([(10, None, 0), (24, "down", 0)], [1, 2]),
])
def test_onset_clusters(spark, case, clusters):
    rows = [(1, 1, 1, i + 1, "note", 1, 1, 0, 0, x, stem, beam) for i, (x, stem, beam) in enumerate(case)]
    notes = spark.createDataFrame(rows, "score_id long, part_no long, measure_no long, seq long, kind string, voice long, staff long, is_chord int, is_grace int, x long, stem string, beam long")
    got = sorted(folds.onset_clusters(notes).collect(), key=lambda r: r["seq"])
    assert [r["cluster"] for r in got] == clusters and [r["repair"] for r in got] == [clusters.count(c) > 1 for c in clusters]


SESSION = "score_id long, has_raw boolean, has_baseline boolean, pending long, total_applied long, owns_edits boolean"


@pytest.mark.parametrize("state, mode, source", [
    ((True, False, 0, 0, False), "init", "raw"), ((False, False, 0, 0, False), "init", None), ((True, False, 2, 0, False), "full", "raw"), ((True, True, 2, 5, True), "incremental", "baseline"),
    ((True, True, 0, 0, False), "restore-from-raw", "raw"), ((True, True, 0, 0, True), "restore", "baseline"), ((True, True, 0, 3, False), "restore", "baseline"), ((False, True, 0, 0, False), "restore", "baseline"),
])
def test_sync_mode(spark, state, mode, source):
    row = restore.sync_plan(spark.createDataFrame([(1, *state)], SESSION)).first()
    assert (row["mode"], row["source"]) == (mode, source)


def test_syncs_of_scores(spark):
    measures, elements, log = random_score(random.Random(4), (*replay.SETS, "removeNote"), 24, 0)
    fields, names = ([c.strip().split()[0] for c in x.split(",")] for x in (ELEMENTS, LOG))
    raw = spark.createDataFrame([tuple(e[f] for f in fields) for e in elements], ELEMENTS).drop("was")
    table = spark.createDataFrame(measures, "score_id long, part_no long, measure_no long, beats int")
    fixes = lambda rows: spark.createDataFrame([tuple(f[n] for n in names) for f in rows], LOG)
    of = lambda rows, score=1: sorted((r["part_no"], r["measure_no"], r["seq"], r["voice"], r["staff"], r["midi"] or 0, r["duration"], r["is_chord"]) for r in rows if r["score_id"] == score)
    named = lambda rows, version, score=1: rows.selectExpr("*", f"'{version}' as version").withColumn("score_id", restore.F.lit(score).cast("long"))

    # Corrections onto the baseline; what they did is in the new one.
    rows, checkpoint = restore.synced(spark.createDataFrame([(1, True, True, len(log), 0, False)], SESSION), named(raw, "raw").unionByName(named(raw, "baseline")), table, fixes(log))
    once = spark.createDataFrame(rows.drop("was").collect(), rows.drop("was").schema)
    want, done = plain_log(measures, elements, log)
    plain = of([{**e, "score_id": 1, "part_no": p, "measure_no": m, "seq": i + 1} for (p, m), els in want.items() for i, e in enumerate(els)])
    after = checkpoint.first()
    assert (after["mode"], after["applied"], after["cleared"], after["total_applied"], after["owns_edits"]) == ("incremental", len(done), len(log), len(done), True)
    assert of(once.collect()) == plain != of(raw.collect())

    # The next sync restores it; a score without a correction ever applied comes back from its raw version, a new one starts from it.
    states = [(1, True, True, 0, after["total_applied"], after["owns_edits"]), (2, True, True, 0, 0, False), (3, True, False, 0, 0, False)]
    versions = named(raw, "raw").unionByName(named(raw, "raw", 2)).unionByName(named(raw, "raw", 3)).unionByName(named(once, "baseline")).unionByName(named(once, "baseline", 2))
    rows, checkpoint = restore.synced(spark.createDataFrame(states, SESSION), versions, table, fixes(log).limit(0))
    found = rows.collect()
    assert of(found) == plain and of(found, 2) == of(found, 3) == of(raw.collect())
    assert {(r["score_id"], r["mode"], r["total_applied"], r["has_baseline"]) for r in checkpoint.collect()} == {(1, "restore", len(done), True), (2, "restore-from-raw", 0, True), (3, "init", 0, True)}
