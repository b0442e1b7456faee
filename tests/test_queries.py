"""Every registered query of the score engine against its SQL, and the folds against plain Python."""

import random
from collections import defaultdict

import pytest

from stavelake.operators import folds, layout
from stavelake.operators import timeline as L
from stavelake.plans import catalog
from stavelake.plans.bindings import Bindings
from stavelake.streaming import jobs
from tests.harness import compare


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_equals_sql(spark, small, con, name):
    assert compare(catalog.QUERIES[name](spark, small), catalog.ORACLE_SQL[name], con) == ""


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_gives_rows(spark, small, name):
    assert not catalog.QUERIES[name](spark, small).isEmpty()


def test_entry(spark):
    import __spark_entry__ as e

    assert not e.entry(spark).isEmpty() and set(e.oracle_sql()) <= set(e.queries())


def random_elements(spark, seed):
    rng = random.Random(seed)
    rows = []
    for m in range(40):
        for s in range(1, rng.randint(2, 12)):
            kind = rng.choice(["note", "note", "note", "backup", "forward"])
            rows.append((1, 1, m, s, kind, rng.randint(1, 2), rng.randint(1, 2), rng.randint(1, 8), rng.randint(0, 1), rng.randint(0, 1), rng.randint(0, 1), rng.randint(40, 60), rng.randint(2, 4), 0, rng.randint(0, 60), rng.randint(0, 2)))
    columns = "score_id long, part_no long, measure_no long, seq long, kind string, voice long, staff long, duration long, is_rest int, is_chord int, is_grace int, midi long, beats int, implicit int, x long, slur long"
    return spark.createDataFrame(rows, columns), [dict(zip((c.split()[0] for c in columns.split(", ")), r)) for r in rows]


def by_measure(rows, *more):
    out = defaultdict(list)
    for r in rows:
        out[(r["measure_no"], *[r[c] for c in more])].append(r)
    return out


def moves(r):
    if r["kind"] == "backup":
        return -r["duration"]
    return r["duration"] if r["kind"] == "forward" or not (r["is_chord"] or r["is_grace"]) else 0


def test_cursor_equals_fold(spark):
    df, rows = random_elements(spark, 1)
    want = {}
    for key, group in by_measure(rows).items():
        at = 0
        for r in group:
            want[r["measure_no"], r["seq"]] = at
            at = max(0, at + moves(r))
    assert {(r["measure_no"], r["seq"]): r["onset"] for r in L.cursor_onset(df).collect()} == want


def test_capped_equals_fold(spark):
    df, rows = random_elements(spark, 2)
    want = {}
    for group in by_measure(rows).values():
        at, cap = 0, group[0]["beats"] * 4
        rows_of = [r for r in group if r["beats"] == group[0]["beats"]]
        if len(rows_of) != len(group):
            continue
        for r in group:
            new = max(0, min(cap, at + moves(r)))
            want[r["measure_no"], r["seq"]] = new - at
            at = new
    got = {(r["measure_no"], r["seq"]): r["moved"] for r in folds.capped(df).collect()}
    assert want.items() <= got.items()


def test_x_clusters_equal_fold(spark):
    df, rows = random_elements(spark, 3)
    got = {(r["measure_no"], r["seq"]): r["anchor"] for r in folds.x_clusters(df).collect()}
    for group in by_measure(rows, "staff").values():
        anchor = None
        for r in sorted(group, key=lambda r: (r["x"], r["seq"])):
            if anchor is None or r["x"] - anchor > 12:
                anchor = r["x"]
            assert got[r["measure_no"], r["seq"]] == anchor


def test_attachable_equals_fold(spark):
    df, rows = random_elements(spark, 4)
    want = set()
    for group in by_measure(rows).values():
        last = None
        for r in group:
            if r["kind"] != "note" or r["is_rest"] or r["is_grace"]:
                continue
            if r["is_chord"] and last == r["voice"]:
                continue
            want.add((r["measure_no"], r["seq"]))
            last = r["voice"]
    assert {(r["measure_no"], r["seq"]) for r in L.attachable(df).collect()} == want


def test_a_query_name_is_registered_once():
    from stavelake.plans.registry import QUERIES, query

    with pytest.raises(ValueError):
        query(next(iter(QUERIES)))(lambda b: None)


def test_line_clusters_equal_fold(spark):
    rng = random.Random(6)
    glyphs = [(1, 1, i, rng.randint(0, 500), rng.randint(0, 60), float(rng.randint(7, 17))) for i in range(80)]
    df = spark.createDataFrame(glyphs, "doc_id long, page long, glyph_no long, x0 long, y0 long, size_pt double")
    lines = []
    for _, _, _, x, y, _ in sorted(glyphs, key=lambda g: (g[4], g[3], g[2])):
        if lines and abs(y - sum(lines[-1]) / len(lines[-1])) <= 4:
            lines[-1].append(y)
        else:
            lines.append([y])
    assert [r["n"] for r in layout.line_clusters(df).orderBy("line_no").collect()] == [len(x) for x in lines]


def test_greedy_matches_use_each_line_once(spark, small):
    from stavelake.plans.text_queries import page_pairs

    rows = layout.greedy_matches(page_pairs(Bindings(spark, small).ti)).collect()
    for side in ("line_no", "bline_no"):
        seen = [(r["doc_id"], r[side]) for r in rows]
        assert len(seen) == len(set(seen))


def test_streams(spark, small, tmp_path):
    events = Bindings(spark, small).je
    events.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    query = jobs.latest_progress(stream).writeStream.outputMode("complete").format("memory").queryName("latest").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("latest").collect())) == sorted(map(tuple, jobs.latest_progress(events).collect()))
    query = jobs.finished_per_window(stream).writeStream.outputMode("append").format("memory").queryName("windows").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("windows").count() > 0
    query = jobs.parsed_progress(stream).writeStream.format("memory").queryName("lines").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("lines").filter("total = 40").count() == events.count()


def test_expiring_stream_equals_batch(spark, small, tmp_path):
    events = Bindings(spark, small).je.select("job_id", "event_id", "status", "progress", "ts")
    middle = events.approxQuantile("event_id", [0.5], 0.0)[0]
    events.filter("event_id > %d" % middle).coalesce(1).write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    query = jobs.latest_progress_expiring(stream, hours=24 * 3650).writeStream.outputMode("update").foreachBatch(lambda df, n: df.write.mode("append").parquet(f"{tmp_path}/out/n={n}")).start()
    query.processAllAvailable()
    events.filter("event_id <= %d" % middle).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
    query.processAllAvailable()
    query.stop()
    got = {}
    for r in spark.read.parquet(str(tmp_path / "out")).orderBy("n").collect():
        got[r["job_id"]] = (r["status"], r["progress"])
    assert got == {r["job_id"]: (r["status"], r["progress"]) for r in jobs.latest_progress(events).collect()}


def test_expiring_stream_forgets(spark, tmp_path):
    rows = [(1, 1, "queued", 0, "2024-01-01 00:00:00"), (2, 2, "queued", 0, "2024-01-11 00:00:00"), (2, 3, "processing", 5, "2024-01-11 01:00:00")]
    events = spark.createDataFrame(rows, "job_id long, event_id long, status string, progress long, ts string").selectExpr("job_id", "event_id", "status", "progress", "timestamp(ts) AS ts")
    events.filter("job_id = 1").coalesce(1).write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    query = jobs.latest_progress_expiring(stream).writeStream.outputMode("update").foreachBatch(lambda df, n: df.collect() and None).start()
    query.processAllAvailable()
    events.filter("job_id = 2").coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
    query.processAllAvailable()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    query.stop()
    assert held[-1] == 1
