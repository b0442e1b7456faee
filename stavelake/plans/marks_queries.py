"""Queries on slurs and wedges."""

from __future__ import annotations

from stavelake.operators import marks
from stavelake.plans.registry import query
from stavelake.plans.timeline_queries import M

P = "score_id, part_no"

# A stop before the start of its note; n counts a part's marks. open, used and renamed are the state that the mark meets.
SLUR_FOLD = f"""WITH RECURSIVE best AS (SELECT *, coalesce(number, 1) AS asked FROM sl QUALIFY row_number() OVER (PARTITION BY {M}, seq, type ORDER BY noise, mark_no) = 1),
s AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {P} ORDER BY measure_no, seq, type DESC, mark_no) AS n FROM best),
f AS (
  SELECT {P}, CAST(0 AS BIGINT) AS n, CAST(-1 AS BIGINT) AS measure_no, CAST([] AS STRUCT(number BIGINT, staff BIGINT)[]) AS open, CAST([] AS BIGINT[]) AS used, CAST([] AS STRUCT(staff BIGINT, asked BIGINT, given BIGINT)[]) AS renamed, CAST(NULL AS BIGINT) AS k
  FROM s WHERE n = 1
  UNION ALL
  SELECT {P}, n, measure_no,
    CASE WHEN type = 'start' THEN list_append(open, {{'number': k, 'staff': staff}}) ELSE list_filter(open, lambda o: o.number IS DISTINCT FROM k) END,
    CASE WHEN type = 'stop' AND k IS NOT NULL THEN list_append(used, k) ELSE used END,
    CASE WHEN type = 'start' AND k != asked THEN list_append(renamed, {{'staff': staff, 'asked': asked, 'given': k}}) ELSE renamed END, k
  FROM (SELECT *, CASE WHEN type = 'start' THEN CASE WHEN NOT list_contains(taken, asked) THEN asked ELSE list_min(list_filter(range(1, len(taken) + 2), lambda i: NOT list_contains(taken, i))) END
      WHEN list_contains(open, {{'number': lookup, 'staff': staff}}) THEN lookup WHEN list_contains(open, {{'number': asked, 'staff': staff}}) THEN asked END AS k
    FROM (SELECT *, list_concat(list_transform(open, lambda o: o.number), used) AS taken, coalesce(list_filter(renamed, lambda r: r.staff = staff AND r.asked = asked)[-1].given, asked) AS lookup
      FROM (SELECT s.score_id, s.part_no, s.n, s.measure_no, s.type, s.staff, s.asked, f.open,
              CASE WHEN s.measure_no = f.measure_no THEN f.used ELSE list_transform(f.open, lambda o: o.number) END AS used, CASE WHEN s.measure_no = f.measure_no THEN f.renamed ELSE f.renamed[1:0] END AS renamed
            FROM f JOIN s ON s.score_id = f.score_id AND s.part_no = f.part_no AND s.n = f.n + 1)))),
kept AS (SELECT s.score_id, s.part_no, s.measure_no, s.seq, s.mark_no, s.type, s.staff, k AS number, coalesce(s.number, 0) != k OR s.noise > 0 AS changed FROM f JOIN s USING ({P}, n) WHERE k IS NOT NULL)
"""


@query("slur_normalize", f"{SLUR_FOLD} SELECT * FROM kept")
def slur_normalize(b):
    return marks.paired_slurs(b.sl)


@query(
    "slur_report",
    f"""{SLUR_FOLD} SELECT {P}, CAST(sum(n) AS BIGINT) AS marks, CAST(sum(gone) AS BIGINT) AS removed, count(*) FILTER (touched) AS changed_measures
    FROM (SELECT {M}, count(*) AS n, count(*) FILTER (changed IS NULL) AS gone, bool_or(coalesce(changed, true)) AS touched FROM sl LEFT JOIN (SELECT {M}, seq, mark_no, changed FROM kept) USING ({M}, seq, mark_no) GROUP BY {M}) GROUP BY {P}""",
)
def slur_report(b):
    return marks.slur_report(b.sl)


# Each measure's wedges as one list; the state of a staff is followed measure by measure.
@query(
    "wedge_pairs",
    f"""WITH RECURSIVE w AS (SELECT {M}, staff, seq, type, number, coalesce(placement, 'below') AS placement, place, CASE type WHEN 'stop' THEN 0 ELSE 1 END AS st FROM wd),
g AS MATERIALIZED (SELECT {M}, staff, array_agg({{'st': st, 'number': number, 'placement': placement}} ORDER BY place, seq) AS l, row_number() OVER (PARTITION BY {P}, staff ORDER BY measure_no) AS n FROM w GROUP BY {M}, staff),
i AS MATERIALIZED (SELECT *, list_sum(list_transform(l, lambda x: x.st)) AS starts, len(l) - list_sum(list_transform(l, lambda x: x.st)) AS stops, list_filter(l, lambda x: x.st = 1)[-1] AS last_start, l[1].st = 0 AS stop_first, l[-1].st = 1 AS start_last FROM g),
f AS (SELECT {M}, staff, n, CAST(false AS BOOLEAN) AS was_open, CAST(NULL AS BIGINT) AS open_measure, CAST(NULL AS BIGINT) AS open_number, CAST(NULL AS VARCHAR) AS open_placement,
        CASE WHEN starts > 0 AND stops = 0 THEN true WHEN starts = 0 THEN false WHEN stop_first THEN false ELSE start_last END AS is_open FROM i WHERE n = 1
  UNION ALL SELECT i.score_id, i.part_no, i.measure_no, i.staff, i.n, f.is_open, p.measure_no, p.last_start.number, p.last_start.placement,
        CASE WHEN i.starts > 0 AND i.stops = 0 THEN true WHEN i.starts = 0 THEN false WHEN i.stop_first AND NOT f.is_open THEN false ELSE i.start_last END
  FROM f JOIN i ON i.score_id = f.score_id AND i.part_no = f.part_no AND i.staff = f.staff AND i.n = f.n + 1 JOIN i p ON p.score_id = f.score_id AND p.part_no = f.part_no AND p.staff = f.staff AND p.n = f.n),
v AS (SELECT {M}, staff, count(*) AS voices, min(lo) AS first_note, arg_min(hi, lo) AS last_note FROM (SELECT {M}, staff, voice, min(seq) AS lo, max(seq) AS hi FROM se WHERE kind = 'note' GROUP BY {M}, staff, voice) GROUP BY {M}, staff),
k AS (SELECT w.*, was_open, starts, stop_first, row_number() OVER (PARTITION BY {M}, staff, st ORDER BY place, w.seq) AS nth, voices > 1 AND placement = 'above' AS lift, first_note, last_note
      FROM w JOIN i USING ({M}, staff) JOIN f USING ({M}, staff) LEFT JOIN v USING ({M}, staff) WHERE st = 1 OR starts > 0 OR was_open)
SELECT {M}, staff, seq, type, number, placement, CASE placement WHEN 'above' THEN 25 END AS y,
  CASE WHEN lift AND st = 1 THEN first_note - 0.5 WHEN lift THEN last_note + 0.5 WHEN st = 0 AND nth = 1 AND stop_first AND starts > 0 AND NOT was_open THEN CAST('inf' AS DOUBLE) ELSE place END AS place FROM k
UNION ALL SELECT {P}, open_measure, staff, NULL, 'stop', open_number, open_placement, CASE open_placement WHEN 'above' THEN 25 END, CAST('inf' AS DOUBLE) FROM f JOIN i USING ({M}, staff) WHERE was_open AND starts > 0""",
)
def wedge_pairs(b):
    return marks.paired_wedges(b.wd, b.se.filter("kind = 'note'"))


# Each layer and number is followed note by note; a run's beams stay if it ends.
@query(
    "beam_numbers",
    f"""WITH RECURSIVE n AS (SELECT {M}, seq, staff, voice FROM se WHERE kind = 'note' AND is_chord = 0 AND is_rest = 0),
o AS (SELECT {M}, seq, coalesce(number, 1) AS number, arg_min(value, beam_no) AS value FROM be GROUP BY {M}, seq, coalesce(number, 1)),
k AS (SELECT DISTINCT {M}, staff, voice, number FROM o JOIN n USING ({M}, seq)),
s AS MATERIALIZED (SELECT {M}, n.seq, staff, voice, number, value, row_number() OVER (PARTITION BY {M}, staff, voice, number ORDER BY seq) AS i FROM n JOIN k USING ({M}, staff, voice) LEFT JOIN o USING ({M}, seq, number)),
f AS (SELECT {M}, staff, voice, number, i, CASE WHEN value = 'begin' THEN [seq] ELSE CAST([] AS BIGINT[]) END AS open, CAST([] AS BIGINT[]) AS done FROM s WHERE i = 1
  UNION ALL SELECT s.score_id, s.part_no, s.measure_no, s.staff, s.voice, s.number, s.i,
    CASE WHEN s.value = 'begin' THEN [s.seq] WHEN s.value IS NULL OR s.value = 'end' OR len(f.open) = 0 THEN CAST([] AS BIGINT[]) ELSE list_append(f.open, s.seq) END,
    CASE WHEN s.value = 'end' AND len(f.open) > 0 THEN list_concat(f.done, list_append(f.open, s.seq)) ELSE f.done END
  FROM f JOIN s ON s.score_id = f.score_id AND s.part_no = f.part_no AND s.measure_no = f.measure_no AND s.staff = f.staff AND s.voice = f.voice AND s.number = f.number AND s.i = f.i + 1),
l AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY {M}, staff, voice, number ORDER BY i DESC) = 1)
SELECT {M}, seq, number, value FROM s JOIN l USING ({M}, staff, voice, number) WHERE list_contains(done, seq)""",
)
def beam_numbers(b):
    return marks.valid_beams(b.be, b.se.filter("kind = 'note' and is_chord = 0 and is_rest = 0"))
