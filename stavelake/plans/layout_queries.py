"""Queries on glyph layout and on matching two text sources."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stavelake.functions import text as T
from stavelake.operators import layout as Y
from stavelake.plans.registry import query
from stavelake.plans.text_queries import page_pairs

MUSIC_FONT = "fontname IN ('Brand#11', 'Brand#22')"


@query("strip_decision", f"SELECT doc_id, page, glyph_no, (size_pt BETWEEN 7 AND 17 AND NOT ({MUSIC_FONT}) AND size_pt < 16 AND NOT (y0 BETWEEN 100 AND 140)) AS strip FROM gl")
def strip_decision(b):
    ranges = F.array(F.struct(F.lit(7.0).alias("lo"), F.lit(17.0).alias("hi")))
    inside = F.exists(ranges, lambda r: F.col("size_pt").between(r["lo"], r["hi"]))
    strip = inside & ~F.expr(MUSIC_FONT) & (F.col("size_pt") < 16) & ~F.col("y0").between(100, 140)
    return b.gl.select("doc_id", "page", "glyph_no", strip.alias("strip"))


@query("eff_font", "SELECT doc_id, page, glyph_no, round(size_pt * sqrt(abs(1.5 * 2.0 - 0.25 * x0 / 560.0)) * sqrt(abs(0.0 * 0.0 + y0 / 800.0)), 6) AS eff FROM gl")
def eff_font(b):
    """Font size times the scale of the page matrix (its determinant) and of the text matrix."""
    page = F.sqrt(F.abs(F.lit(1.5) * 2.0 - 0.25 * F.col("x0") / 560.0))
    text = F.sqrt(F.abs(F.lit(0.0) * 0.0 + F.col("y0") / 800.0))
    return b.gl.select("doc_id", "page", "glyph_no", F.round(F.col("size_pt") * page * text, 6).alias("eff"))


@query("font_histogram", """WITH s AS (SELECT *, round(size_pt, 2) AS size FROM gl),
f AS (SELECT doc_id, size, fontname, row_number() OVER (PARTITION BY doc_id, size ORDER BY count(*) DESC, min(page * 100000 + glyph_no)) AS n FROM s GROUP BY doc_id, size, fontname),
t AS (SELECT doc_id, size, string_agg(fontname, ',' ORDER BY n) AS fonts FROM f WHERE n <= 3 GROUP BY doc_id, size),
c AS (SELECT doc_id, size, string_agg(ch, '' ORDER BY page, glyph_no) AS sample FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, size ORDER BY page, glyph_no) AS k FROM s) WHERE k <= 48 GROUP BY doc_id, size)
SELECT doc_id, size, count(*) AS chars, count(DISTINCT page) AS pages, bool_or(regexp_matches(ch, '[A-Za-z]')) AS latin, any_value(fonts) AS fonts, any_value(sample) AS sample FROM s JOIN t USING (doc_id, size) JOIN c USING (doc_id, size) GROUP BY doc_id, size""")
def font_histogram(b):
    """Per size: counts, the three most used fonts and a sample of the first characters (limits of the report)."""
    s = b.gl.withColumn("size", F.round("size_pt", 2))
    key = ["doc_id", "size"]
    fonts = s.groupBy(*key, "fontname").agg(F.count("*").alias("n"), F.min(F.struct("page", "glyph_no")).alias("first"))
    top = fonts.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy(F.col("n").desc(), "first"))).filter("k <= 3")
    top = top.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "fontname"))), lambda x: x["fontname"]), ",").alias("fonts"))
    first = s.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy("page", "glyph_no"))).filter("k <= 48")
    sample = first.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "ch"))), lambda x: x["ch"]), "").alias("sample"))
    counts = s.groupBy(*key).agg(F.count("*").alias("chars"), F.count_distinct("page").alias("pages"), F.bool_or(F.col("ch").rlike("[A-Za-z]")).alias("latin"))
    return counts.join(top, key).join(sample, key)


@query("merge_ranges", "WITH s AS (SELECT DISTINCT doc_id, size_pt - 0.3 AS lo, size_pt + 0.3 AS hi FROM gl), w AS (SELECT *, CASE WHEN lo > max(hi) OVER (PARTITION BY doc_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 0.05 THEN 1 ELSE 0 END AS new FROM s), i AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY lo, hi) AS island FROM w) SELECT doc_id, round(min(lo), 4) AS lo, round(max(hi), 4) AS hi FROM i GROUP BY doc_id, island")
def merge_ranges(b):
    sizes = b.gl.select("doc_id", (F.col("size_pt") - 0.3).alias("l"), (F.col("size_pt") + 0.3).alias("h"))
    return Y.merged_ranges(sizes, ("doc_id",), "l", "h").select("doc_id", F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"))


@query("cluster_lines_gap", "SELECT doc_id, page, CAST(line_no AS BIGINT) AS line_no, count(*) AS n, min(x0) AS x0, max(x0 + 6) AS x1, round(avg(size_pt), 6) AS mean_size FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id, page ORDER BY y0, x0, glyph_no) AS line_no FROM (SELECT *, CASE WHEN y0 - lag(y0) OVER (PARTITION BY doc_id, page ORDER BY y0, x0, glyph_no) <= 4 THEN 0 ELSE 1 END AS new FROM gl WHERE size_pt BETWEEN 7 AND 17)) GROUP BY doc_id, page, line_no")
def cluster_lines_gap(b):
    lines = Y.line_clusters_by_gap(b.gl.filter(F.col("size_pt").between(7, 17)))
    return lines.groupBy("doc_id", "page", "line_no").agg(F.count("*").alias("n"), F.min("x0").alias("x0"), F.max(F.col("x0") + 6).alias("x1"), F.round(F.avg("size_pt"), 6).alias("mean_size"))


# One glyph a round: a line's running mean is known only once the glyph before has been placed.
@query(
    "cluster_lines",
    """WITH RECURSIVE s AS MATERIALIZED (SELECT doc_id, page, x0, y0, size_pt, row_number() OVER (PARTITION BY doc_id, page ORDER BY y0, x0, glyph_no, size_pt) AS k FROM gl WHERE size_pt BETWEEN 7 AND 17 AND trim(ch) <> ''),
f AS (SELECT doc_id, page, k, CAST(0 AS INTEGER) AS line_no, CAST(1 AS BIGINT) AS n, CAST(y0 AS DOUBLE) AS total, x0, y0, size_pt FROM s WHERE k = 1
  UNION ALL SELECT s.doc_id, s.page, s.k, CASE WHEN abs(s.y0 - f.total / f.n) <= 4 THEN f.line_no ELSE f.line_no + 1 END, CASE WHEN abs(s.y0 - f.total / f.n) <= 4 THEN f.n + 1 ELSE 1 END,
    CASE WHEN abs(s.y0 - f.total / f.n) <= 4 THEN f.total + s.y0 ELSE s.y0 END, s.x0, s.y0, s.size_pt FROM f JOIN s ON s.doc_id = f.doc_id AND s.page = f.page AND s.k = f.k + 1)
SELECT doc_id, page, line_no, count(*) AS n, min(x0) AS x0, min(y0) AS y0, max(x0 + 6) AS x1, round(max(y0 + size_pt), 4) AS y1, round(sum(size_pt) / count(*), 6) AS mean_size FROM f GROUP BY doc_id, page, line_no""",
)
def cluster_lines(b):
    return Y.line_clusters(b.gl.filter(F.col("size_pt").between(7, 17) & (F.trim("ch") != "")))


@query("line_text", "WITH l AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, page ORDER BY y0, x0, glyph_no) AS line_no FROM (SELECT *, CASE WHEN y0 - lag(y0) OVER (PARTITION BY doc_id, page ORDER BY y0, x0, glyph_no) <= 4 THEN 0 ELSE 1 END AS new FROM gl)), g AS (SELECT *, CASE WHEN x0 - lag(x0 + 6) OVER (PARTITION BY doc_id, page, line_no ORDER BY x0, glyph_no) > 3 THEN ' ' ELSE '' END AS sep FROM l) SELECT doc_id, page, CAST(line_no AS BIGINT) AS line_no, string_agg(concat(sep, ch), '' ORDER BY x0, glyph_no) AS text FROM g GROUP BY doc_id, page, line_no")
def line_text(b):
    w = Window.partitionBy("doc_id", "page", "line_no").orderBy("x0", "glyph_no")
    sep = F.when(F.col("x0") - F.lag(F.col("x0") + 6).over(w) > 3, " ").otherwise("")
    spaced = Y.line_clusters_by_gap(b.gl).withColumn("piece", F.concat(sep, "ch"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "glyph_no", "piece"))), lambda s: s["piece"]), "")
    return spaced.groupBy("doc_id", "page", "line_no").agg(joined.alias("text"))


@query("ocr_union", "SELECT doc_id, page, glyph_no, round(x0 * 72 / 300.0, 4) AS left_pt, round((x0 + 6) * 72 / 300.0, 4) AS right_pt, 'first' AS source FROM gl WHERE glyph_no % 2 = 0 UNION ALL SELECT doc_id, page, glyph_no, round(x0 * 72 / 300.0, 4), round((x0 + 6) * 72 / 300.0, 4), 'second' FROM gl WHERE glyph_no % 2 = 1 AND x0 % 100 >= 30 AND size_pt <= 0.2 * 100")
def ocr_union(b):
    poly = F.array(F.col("x0"), F.col("x0") + 6, F.col("x0") + 6, F.col("x0"))
    pt = lambda c: F.round(c * 72 / 300.0, 4)
    boxes = b.gl.withColumns({"left_pt": pt(F.array_min(poly)), "right_pt": pt(F.array_max(poly))})
    out = lambda rows, name: rows.select("doc_id", "page", "glyph_no", "left_pt", "right_pt", F.lit(name).alias("source"))
    second = boxes.filter((F.col("glyph_no") % 2 == 1) & (F.col("x0") % 100 >= 30) & (F.col("size_pt") <= 0.2 * 100))
    return out(boxes.filter("glyph_no % 2 = 0"), "first").unionByName(out(second, "second"))


BANDS = "(SELECT DISTINCT doc_id, page, y0 AS py FROM gl WHERE glyph_no % 50 = 1)"


@query("protected_band", f"SELECT doc_id, page, glyph_no FROM gl g WHERE NOT EXISTS (SELECT 1 FROM {BANDS} p WHERE p.doc_id = g.doc_id AND p.page = g.page AND abs(g.y0 - p.py) < 30)")
def protected_band(b):
    bands = b.gl.filter("glyph_no % 50 = 1").select("doc_id", "page", F.col("y0").alias("py")).distinct()
    return Y.near_any(b.gl, bands).select("doc_id", "page", "glyph_no")


@query("overlap_anti", f"SELECT g.doc_id, g.page, g.glyph_no FROM gl g WHERE NOT ({MUSIC_FONT}) AND NOT EXISTS (SELECT 1 FROM (SELECT * FROM gl WHERE {MUSIC_FONT}) m WHERE m.doc_id = g.doc_id AND m.page = g.page AND greatest(0, least(g.x0 + 6, m.x0 + 6) - greatest(g.x0, m.x0)) * greatest(0, least(g.y0 + g.size_pt, m.y0 + m.size_pt) - greatest(g.y0, m.y0)) >= 0.25 * 6 * g.size_pt)")
def overlap_anti(b):
    """Text glyphs that no music glyph covers: both sides are put in bins of y, so the join has an equal key."""
    step = 40.0
    lo, hi = F.floor(F.col("y0") / step), F.floor((F.col("y0") + F.col("size_pt")) / step)
    binned = b.gl.withColumn("bin", F.explode(F.sequence(lo, hi)))
    music = binned.filter(MUSIC_FONT).select("doc_id", "page", "bin", F.col("x0").alias("mx"), F.col("y0").alias("my"), F.col("size_pt").alias("ms"))
    inter = T.overlap(F.col("x0"), F.col("x0") + 6, F.col("mx"), F.col("mx") + 6) * T.overlap(F.col("y0"), F.col("y0") + F.col("size_pt"), F.col("my"), F.col("my") + F.col("ms"))
    hit = binned.filter(f"not ({MUSIC_FONT})").join(music, ["doc_id", "page", "bin"]).filter(inter >= 0.25 * 6 * F.col("size_pt")).select("doc_id", "page", "glyph_no").distinct()
    return b.gl.filter(f"not ({MUSIC_FONT})").join(hit, ["doc_id", "page", "glyph_no"], "left_anti").select("doc_id", "page", "glyph_no")


SCORE = """pr AS (SELECT a.doc_id, a.page, a.line_no, b.line_no AS bline_no, lower(regexp_replace(a.text, '\\s+', '', 'g')) AS ta, lower(regexp_replace(b.text, '\\s+', '', 'g')) AS tb,
  greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS inter, (a.x1 - a.x0) * (a.y1 - a.y0) AS aa, (b.x1 - b.x0) * (b.y1 - b.y0) AS ab
  FROM ti a JOIN ti b ON a.doc_id = b.doc_id AND a.page = b.page AND a.line_no < b.line_no),
sc AS (SELECT doc_id, page, line_no, bline_no, round(CASE WHEN inter <= 0 THEN 0.0 ELSE inter / (aa + ab - inter) END + CASE WHEN contains(ta, tb) OR contains(tb, ta) THEN 0.35 ELSE 0.0 END, 9) AS score FROM pr),
bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY score DESC, bline_no) AS k FROM sc WHERE score >= 0.25) WHERE k = 1),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, bline_no ORDER BY line_no DESC) AS l FROM bm) WHERE l = 1)"""


@query("match_best", f"WITH {SCORE} SELECT doc_id, line_no, bline_no, round(score, 6) AS score FROM best")
def match_best(b):
    return Y.best_matches(page_pairs(b.ti)).select("doc_id", "line_no", "bline_no", F.round("score", 6).alias("score"))


@query(
    "match_greedy",
    f"""WITH RECURSIVE {SCORE},
s AS MATERIALIZED (SELECT doc_id, page, line_no, bline_no, score, row_number() OVER (PARTITION BY doc_id, page ORDER BY line_no, score DESC, bline_no) AS k FROM sc WHERE score >= 0.25),
f AS (SELECT doc_id, page, line_no, bline_no, score, k, true AS taken, line_no AS at, [bline_no] AS used FROM s WHERE k = 1
  UNION ALL SELECT s.doc_id, s.page, s.line_no, s.bline_no, s.score, s.k, s.line_no <> f.at AND NOT list_contains(f.used, s.bline_no),
    CASE WHEN list_contains(f.used, s.bline_no) THEN f.at ELSE s.line_no END, CASE WHEN s.line_no <> f.at AND NOT list_contains(f.used, s.bline_no) THEN list_append(f.used, s.bline_no) ELSE f.used END
  FROM f JOIN s ON s.doc_id = f.doc_id AND s.page = f.page AND s.k = f.k + 1)
SELECT doc_id, page, line_no, bline_no, score FROM f WHERE taken""",
)
def match_greedy(b):
    return Y.greedy_matches(page_pairs(b.ti))


@query(
    "match_stats",
    f"""WITH {SCORE} SELECT t.doc_id, count(m.line_no) AS matched, count(*) FILTER (m.line_no IS NULL AND u.bline_no IS NULL) AS left_only, count(*) FILTER (m.line_no IS NULL AND u.bline_no IS NOT NULL) AS taken
    FROM ti t LEFT JOIN best m ON m.doc_id = t.doc_id AND m.line_no = t.line_no LEFT JOIN best u ON u.doc_id = t.doc_id AND u.bline_no = t.line_no GROUP BY t.doc_id""",
)
def match_stats(b):
    """Lines with a match, lines that are only another's match, and lines that stand alone, by the matching itself."""
    best = Y.best_matches(page_pairs(b.ti)).select("doc_id", "line_no", "bline_no")
    lines = b.ti.select("doc_id", "line_no").join(best.select("doc_id", "line_no", F.lit(True).alias("own")), ["doc_id", "line_no"], "left")
    lines = lines.join(best.select("doc_id", F.col("bline_no").alias("line_no"), F.lit(True).alias("used")), ["doc_id", "line_no"], "left")
    alone = F.col("own").isNull() & F.col("used").isNull()
    return lines.groupBy("doc_id").agg(F.count("own").alias("matched"), F.count_if(alone).alias("left_only"), F.count_if(F.col("own").isNull() & F.col("used").isNotNull()).alias("taken"))


@query("match_unmatched", f"WITH {SCORE} SELECT t.doc_id, t.line_no, 'right_only' AS provenance FROM ti t WHERE item_type <> 'page_number' AND NOT EXISTS (SELECT 1 FROM best m WHERE m.doc_id = t.doc_id AND m.bline_no = t.line_no)")
def match_unmatched(b):
    used = Y.best_matches(page_pairs(b.ti)).select("doc_id", F.col("bline_no").alias("line_no"))
    return b.ti.filter("item_type <> 'page_number'").join(used, ["doc_id", "line_no"], "left_anti").select("doc_id", "line_no", F.lit("right_only").alias("provenance"))


@query("overlay_fields", f"WITH {SCORE} SELECT l.doc_id, l.line_no, coalesce(nullif(trim(r.text), ''), l.text) AS text, coalesce(r.item_type, l.item_type) AS item_type, coalesce(r.x0, l.x0) AS x0 FROM ti l LEFT JOIN best m ON m.doc_id = l.doc_id AND m.line_no = l.line_no LEFT JOIN ti r ON r.doc_id = m.doc_id AND r.line_no = m.bline_no")
def overlay_fields(b):
    m = Y.best_matches(page_pairs(b.ti)).select("doc_id", "line_no", "btext", "bitem_type", "bx0")
    joined = b.ti.join(m, ["doc_id", "line_no"], "left")
    return joined.select("doc_id", "line_no", F.coalesce(F.nullif(F.trim("btext"), F.lit("")), "text").alias("text"), F.coalesce("bitem_type", "item_type").alias("item_type"), F.coalesce("bx0", "x0").alias("x0"))


@query("title_match", "SELECT doc_id, line_no FROM (SELECT t.doc_id, t.line_no, row_number() OVER (PARTITION BY t.doc_id ORDER BY t.line_no) AS n FROM ti t JOIN (SELECT doc_id, page, min(line_no) AS first_line, arg_min(text, line_no) AS title FROM ti WHERE page = 2 GROUP BY doc_id, page) s ON t.doc_id = s.doc_id AND t.page = s.page WHERE t.item_type = 'title' OR contains(replace(t.text, ' ', ''), replace(s.title, ' ', ''))) WHERE n = 1")
def title_match(b):
    title = b.ti.filter("page = 2").groupBy("doc_id", "page").agg(F.min_by("text", "line_no").alias("title"))
    bare = lambda c: F.replace(F.col(c), F.lit(" "), F.lit(""))
    hit = b.ti.join(title, ["doc_id", "page"]).filter((F.col("item_type") == "title") | F.contains(bare("text"), bare("title")))
    return hit.groupBy("doc_id").agg(F.min("line_no").alias("line_no"))


@query("spurious_numbers", "SELECT n.doc_id, n.line_no FROM (SELECT doc_id, line_no, page, CASE WHEN line_no % 4 = 0 THEN CAST(line_no % 30 AS VARCHAR) END AS word FROM ti WHERE item_type <> 'tempo') n WHERE word IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ti m WHERE m.doc_id = n.doc_id AND m.page = n.page AND m.item_type = 'page_number' AND CAST(m.line_no % 30 AS VARCHAR) = n.word)")
def spurious_numbers(b):
    number = (F.col("line_no") % 30).cast("string")
    words = b.ti.filter("item_type <> 'tempo' and line_no % 4 = 0").select("doc_id", "line_no", "page", number.alias("word"))
    markers = b.ti.filter("item_type = 'page_number'").select("doc_id", "page", number.alias("word")).distinct()
    return words.join(markers, ["doc_id", "page", "word"], "left_anti").select("doc_id", "line_no")


@query("sweep_argmax", "SELECT page, round(-max_angle, 2) AS angle FROM (SELECT page, arg_max(angle, v * 1000 - angle / 1e6) AS max_angle FROM (SELECT l_orderkey % 50 AS page, CAST(l_linenumber AS DOUBLE) AS angle, round(var_pop(l_quantity), 6) AS v FROM lineitem GROUP BY 1, 2) GROUP BY page)")
def sweep_argmax(b):
    """Per page the angle whose profile varies most; the first of equal angles."""
    v = b.table("lineitem").groupBy((F.col("l_orderkey") % 50).alias("page"), F.col("l_linenumber").cast("double").alias("angle")).agg(F.round(F.var_pop("l_quantity"), 6).alias("v"))
    return v.groupBy("page").agg(F.round(-F.max_by("angle", F.struct("v", -F.col("angle"))), 2).alias("angle"))


@query("bands", "WITH r AS (SELECT l_suppkey AS page, l_partkey % 800 AS y, sum(l_quantity) AS ink FROM lineitem GROUP BY ALL), k AS (SELECT page, y FROM (SELECT *, max(ink) OVER (PARTITION BY page) AS top FROM r) WHERE ink >= 0.3 * top), i AS (SELECT *, sum(new) OVER (PARTITION BY page ORDER BY y) AS band FROM (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY page ORDER BY y) <= 12 THEN 0 ELSE 1 END AS new FROM k)) SELECT page, CAST(band AS BIGINT) AS band, min(y) AS y0, max(y) AS y1 FROM i GROUP BY page, band")
def bands(b):
    """Rows with enough ink, joined over gaps of up to 12."""
    ink = b.table("lineitem").groupBy(F.col("l_suppkey").alias("page"), (F.col("l_partkey") % 800).alias("y")).agg(F.sum("l_quantity").alias("ink"))
    dark = ink.withColumn("top", F.max("ink").over(Window.partitionBy("page"))).filter("ink >= 0.3 * top").withColumn("end", F.col("y"))
    return Y.islands(dark, ("page",), "y", "end", 12).groupBy("page", F.col("island").alias("band")).agg(F.min("y").alias("y0"), F.max("y").alias("y1"))


@query("range_spec", "SELECT DISTINCT doc_id, CAST(m AS BIGINT) AS measure FROM (SELECT doc_id, unnest(range(doc_id % 20 + 1, doc_id % 20 + 4)) AS m FROM documents UNION ALL SELECT doc_id, doc_id % 7 + 40 FROM documents)")
def range_spec(b):
    """``5-7, 42`` as its measures."""
    d = F.col("doc_id")
    spec = F.concat((d % 20 + 1).cast("string"), F.lit("-"), (d % 20 + 3).cast("string"), F.lit(", "), (d % 7 + 40).cast("string"))
    part = b.table("documents").select("doc_id", F.explode(F.split(spec, r",\s*")).alias("part"))
    lo = F.regexp_extract("part", r"^(\d+)", 1).cast("long")
    hi = F.coalesce(F.nullif(F.regexp_extract("part", r"-(\d+)$", 1), F.lit("")).cast("long"), lo)
    return part.select("doc_id", F.explode(F.sequence(lo, hi)).alias("measure")).distinct()


@query("decode_tokens", "WITH w AS (SELECT doc_id, i, string_split(text, ' ')[i] AS w FROM documents, unnest(range(1, len(string_split(text, ' ')) + 1)) AS t(i)), t AS (SELECT doc_id, i, CASE WHEN length(w) % 3 = 0 THEN concat('note-C', CAST(length(w) % 8 AS VARCHAR), '-quarter') WHEN length(w) % 5 = 0 THEN 'rest-half' WHEN length(w) % 7 = 0 THEN 'barline' END AS token FROM w) SELECT doc_id, i - 1 AS token_no, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS BIGINT) AS x, CASE WHEN starts_with(token, 'note') THEN 'note' ELSE 'rest' END AS kind, CASE WHEN starts_with(token, 'note') THEN string_split(token, '-')[2] END AS pitch, CASE WHEN starts_with(token, 'note') THEN 'quarter' ELSE 'half' END AS type FROM t WHERE token IS NOT NULL AND token <> 'barline'")
def decode_tokens(b):
    """Tokens such as ``note-C5-quarter``; bar lines and unknown tokens give nothing, and x counts what is emitted."""
    n = F.length("w")
    token = F.when(n % 3 == 0, F.concat(F.lit("note-C"), (n % 8).cast("string"), F.lit("-quarter"))).when(n % 5 == 0, "rest-half").when(n % 7 == 0, "barline")
    words = b.table("documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("token_no", "w")).withColumn("token", token)
    pitch = F.nullif(F.regexp_extract("token", r"^note-([A-G]\d+)-", 1), F.lit(""))
    kind = F.when(pitch.isNotNull(), "note").when(F.col("token").rlike("^rest-"), "rest")
    x = F.row_number().over(Window.partitionBy("doc_id").orderBy("token_no")) - 1
    rows = words.withColumns({"kind": kind, "pitch": pitch, "type": F.regexp_extract("token", r"-([a-z0-9]+)$", 1)}).filter("kind is not null")
    return rows.select("doc_id", F.col("token_no").cast("long").alias("token_no"), x.cast("long").alias("x"), "kind", "pitch", "type")


@query(
    "staff_bands",
    """WITH d AS (SELECT page, y, max(ink) OVER (PARTITION BY page) AS top, ink, height FROM ink JOIN sy USING (page) WHERE y < height AND ink > 0),
r AS (SELECT page, y, y - row_number() OVER (PARTITION BY page ORDER BY y) AS run FROM d WHERE ink >= greatest(2, floor(top * 0.08))),
b AS (SELECT page, min(y) AS y0, max(y) + 1 AS y1 FROM r GROUP BY page, run HAVING count(*) >= 8),
g AS (SELECT *, y0 - lag(y1) OVER (PARTITION BY page ORDER BY y0) AS gap, count(*) OVER (PARTITION BY page) AS n FROM b),
c AS (SELECT *, CASE WHEN gap IS NOT NULL AND row_number() OVER (PARTITION BY page ORDER BY gap NULLS LAST, y0) <= n - 8 THEN 0 ELSE 1 END AS opens FROM g),
m AS (SELECT page, min(y0) AS y0, max(y1) AS y1 FROM (SELECT *, sum(opens) OVER (PARTITION BY page ORDER BY y0) AS band FROM c) GROUP BY page, band),
l AS (SELECT page, array_agg({'y0': y0, 'y1': y1} ORDER BY y0) AS bands FROM m GROUP BY page HAVING count(*) >= 6)
SELECT page, CAST(i AS BIGINT) AS band,
  CAST(CASE WHEN height < 16 THEN 0 WHEN bands IS NOT NULL THEN bands[CAST(least(len(bands) - 1, floor(i * (len(bands) / 6.0))) AS INTEGER) + 1].y0 ELSE i * greatest(8, height // 6) END AS BIGINT) AS y0,
  CAST(CASE WHEN height < 16 THEN height WHEN bands IS NOT NULL THEN bands[CAST(least(len(bands) - 1, floor(i * (len(bands) / 6.0))) AS INTEGER) + 1].y1 ELSE least(height, (i + 1) * greatest(8, height // 6)) END AS BIGINT) AS y1
FROM sy LEFT JOIN l USING (page), unnest(range(6)) AS t(i) WHERE height >= 16 OR i = 0""",
)
def staff_bands(b):
    return Y.staff_bands(b.ink, b.sy)


BARE = "replace(regexp_replace(coalesce({}, ''), '[\\x{{E000}}-\\x{{F8FF}}\\x{{F0000}}-\\x{{FFFFD}}\\x{{100000}}-\\x{{10FFFD}}]', '', 'g'), ' ', '')"


@query(
    "title_apply",
    f"""WITH o AS (SELECT doc_id, page, trim(text) AS title, x0 AS tx0, y0 AS ty0, x1 AS tx1, y1 AS ty1 FROM tt WHERE trim(text) <> '' AND doc_id NOT IN (SELECT doc_id FROM it WHERE item_type = 'title' AND user_set)),
p AS (SELECT *, greatest(0, least(x1, tx1) - greatest(x0, tx0)) * greatest(0, least(y1, ty1) - greatest(y0, ty0)) AS inter, {BARE.format("text")} AS a, replace(title, ' ', '') AS t FROM it JOIN o USING (doc_id, page)),
h AS (SELECT doc_id, min(line_no) AS line_no FROM p WHERE CASE WHEN tx0 IS NOT NULL AND x0 IS NOT NULL THEN inter > 0 AND inter / ((x1 - x0) * (y1 - y0) + (tx1 - tx0) * (ty1 - ty0) - inter) >= 0.2
      ELSE item_type = 'title' OR (a <> '' AND t <> '' AND (contains(t, a) OR contains(a, t))) END GROUP BY doc_id),
w AS (SELECT it.*, title, tx0, ty0, tx1, ty1 FROM it LEFT JOIN (SELECT h.doc_id, h.line_no, title, tx0, ty0, tx1, ty1 FROM h JOIN o USING (doc_id)) USING (doc_id, line_no))
SELECT doc_id, line_no, page, CASE WHEN title IS NOT NULL THEN 'title' ELSE item_type END AS item_type, coalesce(title, text) AS text, CASE WHEN title IS NOT NULL THEN coalesce(tx0, x0) ELSE x0 END AS x0, CASE WHEN title IS NOT NULL THEN coalesce(ty0, y0) ELSE y0 END AS y0,
  CASE WHEN title IS NOT NULL THEN coalesce(tx1, x1) ELSE x1 END AS x1, CASE WHEN title IS NOT NULL THEN coalesce(ty1, y1) ELSE y1 END AS y1, CASE WHEN title IS NOT NULL THEN 'scoreTitle' END AS provenance FROM w
UNION ALL SELECT doc_id, 0, page, 'title', title, tx0, ty0, tx1, ty1, 'scoreTitle' FROM o WHERE tx0 IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM h)""",
)
def title_apply(b):
    return Y.titled(b.it, b.tt)


@query(
    "line_fonts",
    """WITH l AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, page ORDER BY y0, x0, glyph_no) AS line_no FROM (SELECT *, CASE WHEN y0 - lag(y0) OVER (PARTITION BY doc_id, page ORDER BY y0, x0, glyph_no) <= 4 THEN 0 ELSE 1 END AS new FROM gl)),
c AS (SELECT doc_id, page, line_no, fontname, count(*) AS n FROM l GROUP BY ALL)
SELECT l.doc_id, l.page, CAST(l.line_no AS BIGINT) AS line_no, min(x0) AS x0, min(y0) AS y0, max(x0 + 6) AS x1, max(y0 + size_pt) AS y1, round(avg(size_pt), 6) AS mean_size, any_value(f.fontname) AS font
FROM l JOIN (SELECT doc_id, page, line_no, fontname FROM c QUALIFY row_number() OVER (PARTITION BY doc_id, page, line_no ORDER BY n DESC, fontname) = 1) f USING (doc_id, page, line_no) GROUP BY l.doc_id, l.page, l.line_no""",
)
def line_fonts(b):
    """Box, mean size and most frequent font of each line; of equally frequent ones the first by name."""
    return Y.line_summaries(Y.line_clusters_by_gap(b.gl))
