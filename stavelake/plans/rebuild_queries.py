"""Queries on timelines that are built anew."""

from __future__ import annotations

from pyspark.sql import functions as F

from stavelake.operators import rebuild
from stavelake.plans.registry import query
from stavelake.plans.timeline_queries import M

OWN = f"PARTITION BY {M}"


@query(
    "timeline_rows",
    f"""WITH n AS (SELECT *, sum(CASE WHEN is_chord = 0 OR first_of_layer THEN 1 ELSE 0 END) OVER (PARTITION BY {M}, staff, voice ORDER BY seq) AS g
  FROM (SELECT *, row_number() OVER (PARTITION BY {M}, staff, voice ORDER BY seq) = 1 AS first_of_layer FROM se WHERE kind = 'note')),
o AS (SELECT *, first_value(play_order) OVER w AS gpo, first_value(x) OVER w AS gx, first_value(seq) OVER w AS gseq FROM n WINDOW w AS (PARTITION BY {M}, staff, voice, g ORDER BY seq)),
k AS (SELECT *, CASE WHEN max(gpo) OVER l IS NULL THEN 0 ELSE coalesce(gpo, 999999) END AS ko, CASE WHEN max(gpo) OVER l IS NOT NULL AND gpo IS NULL THEN gx ELSE 0 END AS kx FROM o WINDOW l AS (PARTITION BY {M}, staff, voice)),
t AS (SELECT {M}, staff, voice, sum(CASE WHEN is_chord = 0 AND is_grace = 0 THEN duration ELSE 0 END) AS total FROM k GROUP BY {M}, staff, voice),
b AS (SELECT *, CASE WHEN lag(staff) OVER w = staff THEN lag(total) OVER w ELSE lag(top) OVER w END AS back, min(voice) OVER (PARTITION BY {M}, staff) AS first_voice
      FROM (SELECT *, max(total) OVER (PARTITION BY {M}, staff) AS top FROM t) WINDOW w AS ({OWN} ORDER BY staff, voice)),
r AS (SELECT {M}, CAST(seq AS DOUBLE) AS place, seq AS own, kind, staff, NULL AS mark FROM se UNION ALL SELECT {M}, place, NULL, 'direction', staff, type FROM wd),
m AS (SELECT *, sum(CASE WHEN kind IN ('backup', 'forward') THEN 1 ELSE 0 END) OVER ({OWN} ORDER BY place, own) AS moves FROM r),
a AS (SELECT *, min(CASE WHEN kind = 'note' THEN own END) OVER ({OWN} ORDER BY place, own ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_own,
        max(CASE WHEN kind = 'note' THEN own END) OVER ({OWN} ORDER BY place, own ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_own FROM m),
d AS (SELECT {M}, a.place, a.staff, a.mark, CASE WHEN a.mark <> 'stop' AND next_own IS NOT NULL THEN next_own WHEN l.moves = a.moves AND l.staff = a.staff THEN last_own END AS anchor, CASE WHEN a.mark <> 'stop' AND next_own IS NOT NULL THEN -1 ELSE 1 END AS side
      FROM a LEFT JOIN (SELECT {M}, own AS last_own, moves, staff FROM m WHERE kind = 'note') l USING ({M}, last_own) WHERE a.kind = 'direction'),
u AS (SELECT {M}, staff, voice, 2 AS piece, ko, kx, gseq, seq AS own, 0 AS side, CAST(0 AS DOUBLE) AS place, 'note' AS kind, duration, seq AS was, NULL AS mark FROM k
  UNION ALL SELECT {M}, staff, voice, 1, NULL, NULL, NULL, NULL, 0, 0, 'backup', back, NULL, NULL FROM b WHERE back IS NOT NULL
  UNION ALL SELECT {M}, k.staff, voice, 2, ko, kx, gseq, seq, side, place, 'direction', NULL, NULL, mark FROM d JOIN (SELECT *, seq AS anchor FROM k) k USING ({M}, anchor)
  UNION ALL SELECT {M}, staff, voice, 0, NULL, NULL, NULL, NULL, 0, place, 'direction', NULL, NULL, mark FROM d JOIN (SELECT * FROM b WHERE voice = first_voice) USING ({M}, staff) WHERE anchor IS NULL)
SELECT {M}, row_number() OVER ({OWN} ORDER BY staff, voice, piece, ko, kx, gseq, own, side, place, mark) AS seq, kind, staff, voice, CAST(duration AS BIGINT) AS duration, was, mark FROM u""",
)
def timeline_rows(b):
    """The rebuilt measures as rows, wedges as their directions."""
    return rebuild.rebuilt(b.by_measure, b.wd.select("score_id", "part_no", "measure_no", "staff", "place", F.col("type").alias("mark")))


# One staff and one voice at a time is followed for the reach of staff 1; a recursion carries a list of cursors.
@query(
    "backup_align",
    f"""WITH RECURSIVE r AS (SELECT *, sum(CASE WHEN kind = 'note' AND pk = 'note' AND ps = staff AND pv = voice THEN 0 ELSE 1 END) OVER ({OWN} ORDER BY seq) AS run
  FROM (SELECT *, lag(kind) OVER w AS pk, lag(staff) OVER w AS ps, lag(voice) OVER w AS pv, lag(seq) OVER w AS pseq FROM se WINDOW w AS ({OWN} ORDER BY seq))),
t AS (SELECT {M}, run, max(seq) AS pseq, sum(CASE WHEN is_grace = 0 AND (is_chord = 0 OR first_one) THEN duration ELSE 0 END) AS total FROM (SELECT *, row_number() OVER (PARTITION BY {M}, run ORDER BY seq) = 1 AS first_one FROM r WHERE kind = 'note') GROUP BY {M}, run),
x AS (SELECT r.*, t.total, (SELECT arg_min(o.kind, o.seq) FROM se o WHERE o.score_id = r.score_id AND o.part_no = r.part_no AND o.measure_no = r.measure_no AND o.seq > r.seq AND o.kind IN ('note', 'forward')) AS next_kind FROM r LEFT JOIN t USING ({M}, pseq)),
s AS MATERIALIZED (SELECT {M}, seq, kind, staff, voice, is_chord, is_grace, CAST(CASE WHEN kind = 'backup' AND next_kind = 'forward' AND total > 0 THEN total ELSE duration END AS BIGINT) AS duration FROM x),
f AS (SELECT {M}, CAST(0 AS BIGINT) AS seq, CAST([] AS STRUCT(voice BIGINT, staff BIGINT, pos BIGINT)[]) AS cursors, CAST(0 AS BIGINT) AS reach FROM s WHERE seq = 1
  UNION ALL SELECT score_id, part_no, measure_no, seq,
    CASE WHEN kind = 'backup' THEN list_transform(cursors, lambda c: {{'voice': c.voice, 'staff': c.staff, 'pos': greatest(0, c.pos - duration)}})
         WHEN moves THEN list_append(list_filter(cursors, lambda c: NOT (c.voice = voice AND c.staff = staff)), {{'voice': voice, 'staff': staff, 'pos': now}}) ELSE cursors END,
    CASE WHEN moves AND staff = 1 THEN greatest(reach, now) ELSE reach END
  FROM (SELECT s.*, f.cursors, f.reach, s.kind = 'forward' OR (s.kind = 'note' AND s.is_chord = 0 AND s.is_grace = 0) AS moves,
          coalesce(list_filter(f.cursors, lambda c: c.voice = s.voice AND c.staff = s.staff)[1].pos, 0) + s.duration AS now
        FROM f JOIN s ON s.score_id = f.score_id AND s.part_no = f.part_no AND s.measure_no = f.measure_no AND s.seq = f.seq + 1)),
m AS (SELECT {M}, max(seq) FILTER (kind = 'note' AND is_grace = 0 AND staff = 1) AS lo, min(seq) FILTER (kind = 'note' AND is_grace = 0 AND staff = 2) AS hi FROM s GROUP BY {M}),
e AS (SELECT {M}, arg_max(reach, seq) AS reach FROM f GROUP BY {M}),
b AS (SELECT {M}, min(seq) AS seq, true AS first_one FROM s JOIN m USING ({M}) WHERE kind = 'backup' AND seq > lo GROUP BY {M})
SELECT {M}, seq, CASE WHEN reach > 0 AND first_one AND seq < hi THEN reach ELSE duration END AS duration FROM s JOIN m USING ({M}) JOIN e USING ({M}) LEFT JOIN b USING ({M}, seq) WHERE kind = 'backup'""",
)
def backup_align(b):
    return rebuild.repaired_backups(b.by_measure)


PLACED = "SELECT score_id, measure_no, seq, row_number() OVER (PARTITION BY score_id ORDER BY measure_no, seq) AS k FROM se WHERE kind = 'note' AND is_rest = 0 AND is_grace = 0 AND is_chord = 0 AND part_no = {}"


@query(
    "lyric_sync_fill",
    f"""WITH r AS ({PLACED.format(1)}), t AS ({PLACED.format(2)}), e AS (SELECT score_id, max(measure_no) AS last, max(k) AS n FROM r GROUP BY score_id)
SELECT r.score_id, r.k AS place, r.measure_no, CASE WHEN t.k IS NULL THEN 'reference' ELSE 'target' END AS source, coalesce(t.measure_no, r.measure_no) AS from_measure, coalesce(t.seq, r.seq) AS from_seq FROM r LEFT JOIN t USING (score_id, k)
UNION ALL SELECT t.score_id, t.k, last, 'target', t.measure_no, t.seq FROM t JOIN e USING (score_id) WHERE t.k > e.n""",
)
def lyric_sync_fill(b):
    """Part 2's syllables in the measures of part 1's: what is short is filled from part 1, what is left over goes to its last measure."""
    notes = b.se.filter("kind = 'note' and is_rest = 0 and is_grace = 0 and is_chord = 0")
    return rebuild.synced_syllables(notes.filter("part_no = 2"), notes.filter("part_no = 1"))
