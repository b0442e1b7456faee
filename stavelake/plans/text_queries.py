"""Queries on text items and glyphs, one per operator."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stavelake.functions import text as T
from stavelake.operators import review
from stavelake.plans.registry import query

PUA = "\U000f0000"
WIDTH, HEIGHT = 595.0, 842.0
PUA_SQL = r"[\x{E000}-\x{F8FF}\x{F0000}-\x{FFFFF}\x{100000}-\x{10FFFF}]"


@query("strip_pua", f"SELECT doc_id, CAST(length(t) AS BIGINT) AS n, md5(t) AS digest FROM (SELECT doc_id, regexp_replace(concat('{PUA}', coalesce(text, ''), '{PUA}'), '{PUA_SQL}', '', 'g') AS t FROM documents)")
def strip_pua(b):
    t = T.strip_pua(F.concat(F.lit(PUA), F.coalesce("text", F.lit("")), F.lit(PUA)))
    return b.table("documents").select("doc_id", F.length(t).cast("long").alias("n"), F.md5(t.cast("binary")).alias("digest"))


@query("normalize_text", r"SELECT doc_id, line_no, md5(lower(regexp_replace(text, '\s+', '', 'g'))) AS digest FROM ti")
def normalize_text(b):
    return b.ti.select("doc_id", "line_no", F.md5(T.normalize_text(F.col("text")).cast("binary")).alias("digest"))


_TERMS = ", ".join(f"'{x}'" for x in T.MUSIC_TERMS)
_SEED = ", ".join(f"'{x}'" for x in T.NOISE_SEED)
_POOL = ", ".join(f"'{x}'" for x in T.NOISE_SEED + T.NOISE_MORE + T.MUSIC_TERMS)


# The lines' short first words exercise the rules; whole lines are almost never noise.
@query(
    "noise_flag",
    rf"""WITH a AS (SELECT doc_id, line_no, part, CASE part WHEN 0 THEN text WHEN 1 THEN substr(text, 1, 2) WHEN 2 THEN concat(substr(text, 1, 1), ' ', substr(text, 3, 1)) ELSE concat('q = ', CAST(line_no AS VARCHAR)) END AS text
              FROM ti, unnest([0, 1, 2, 3]) AS p(part)),
    w AS (SELECT *, trim(text) AS t, list_filter(regexp_split_to_array(trim(regexp_replace(trim(text), '[^A-Za-z0-9\s]', ' ', 'g')), '\s+'), lambda x: x <> '') AS ws FROM a),
    l AS (SELECT *, list_transform(ws, lambda x: lower(x)) AS lw FROM w)
    SELECT doc_id, line_no, CAST(part AS INTEGER) AS part, CASE WHEN t = '' THEN true WHEN len(ws) = 0 THEN true
      WHEN len(list_filter(lw, lambda x: length(x) >= 2 AND x = repeat(substr(x, 1, 1), length(x)) AND x NOT IN ({_TERMS}))) > 0 THEN true
      WHEN len(ws) > 1 AND len(list_filter(ws, lambda x: length(x) > 2)) = 0 AND len(list_filter(lw, lambda x: x IN ({_SEED}))) > 0 THEN true
      WHEN regexp_matches(t, '[=≈]\s*\d+') THEN true
      WHEN len(list_filter(lw, lambda x: NOT (x IN ({_POOL}) OR regexp_full_match(x, '\d+')))) = 0 THEN true
      WHEN len(ws) = 1 AND ws[1] IN ({_SEED}) THEN true
      ELSE len(ws) >= 2 AND len(list_filter(ws, lambda x: length(x) <> 1)) = 0 AND len(list_filter(lw, lambda x: x IN ('a', 'i', 'o'))) = 0 END AS noise FROM l""",
)
def noise_flag(b):
    t = (
        F.when(F.col("part") == 0, F.col("text"))
        .when(F.col("part") == 1, F.substring("text", 1, 2))
        .when(F.col("part") == 2, F.concat(F.substring("text", 1, 1), F.lit(" "), F.substring("text", 3, 1)))
        .otherwise(F.concat(F.lit("q = "), F.col("line_no").cast("string")))
    )
    parts = b.ti.withColumn("part", F.explode(F.array(*map(F.lit, range(4)))))
    return parts.select("doc_id", "line_no", "part", T.noise_flag(t).alias("noise"))


@query("number_normalize", r"SELECT doc_id, line_no, CASE WHEN line_no % 3 = 0 THEN CASE WHEN line_no % 1500 BETWEEN 1 AND 999 THEN CAST(line_no % 1500 AS VARCHAR) END WHEN line_no % 3 = 1 THEN CAST(1 + doc_id % 9 AS VARCHAR) END AS number FROM ti")
def number_normalize(b):
    circled = F.element_at(F.split(F.lit("①②③④⑤⑥⑦⑧⑨"), ""), (1 + F.col("doc_id") % 9).cast("int"))
    t = F.when(F.col("line_no") % 3 == 0, F.concat(F.lit("("), (F.col("line_no") % 1500).cast("string"), F.lit(")"))).when(F.col("line_no") % 3 == 1, circled).otherwise("no number")
    return b.ti.select("doc_id", "line_no", T.number_normalize(t).alias("number"))


@query("number_leading", r"SELECT doc_id, line_no, CASE WHEN line_no % 2 = 0 AND length(CAST(doc_id AS VARCHAR)) <= 3 AND doc_id BETWEEN 1 AND 999 THEN CAST(doc_id AS VARCHAR) END AS number FROM ti")
def number_leading(b):
    t = F.when(F.col("line_no") % 2 == 0, F.concat(F.lit(" "), F.col("doc_id").cast("string"), F.lit(" To Coda"))).otherwise(F.concat(F.lit("T "), F.col("doc_id").cast("string")))
    return b.ti.select("doc_id", "line_no", T.number_leading(t).alias("number"))


_SCALE = 300.0 / 72.0
IOU_SQL = """WITH p AS (SELECT a.doc_id, a.line_no AS a_line, b.line_no AS b_line, a.x0, a.y0, a.x1, a.y1, b.x0 AS bx0, b.y0 AS by0, b.x1 AS bx1, b.y1 AS by1
  FROM ti a JOIN ti b ON a.doc_id = b.doc_id AND a.page = b.page AND a.line_no < b.line_no),
i AS (SELECT *, greatest(0, least(x1, bx1) - greatest(x0, bx0)) * greatest(0, least(y1, by1) - greatest(y0, by0)) AS inter FROM p)
SELECT doc_id, a_line, b_line, round(CASE WHEN inter <= 0 THEN 0.0 ELSE inter / ((x1 - x0) * (y1 - y0) + (bx1 - bx0) * (by1 - by0) - inter) END, 6) AS iou FROM i"""


def page_pairs(ti):
    """Pairs of items on one page, the earlier line first, with their normalised texts."""
    ti = ti.withColumn("norm", T.normalize_text(F.col("text")))
    right = ti.select("doc_id", "page", *[F.col(c).alias("b" + c) for c in ("line_no", "x0", "y0", "x1", "y1", "text", "item_type", "norm")])
    return ti.join(right, ["doc_id", "page"]).filter("line_no < bline_no")


@query("iou", IOU_SQL)
def iou(b):
    box = lambda p: tuple(F.col(p + c) for c in ("x0", "y0", "x1", "y1"))
    return page_pairs(b.ti).select("doc_id", F.col("line_no").alias("a_line"), F.col("bline_no").alias("b_line"), F.round(T.iou(box(""), box("b")), 6).alias("iou"))


@query(
    "overlap_ratio",
    """WITH n AS (SELECT *, lead(glyph_no) OVER w AS g2, lead(x0) OVER w AS bx, lead(y0) OVER w AS ty, lead(size_pt) OVER w AS bs FROM gl WINDOW w AS (PARTITION BY doc_id, page ORDER BY glyph_no)),
p AS (SELECT doc_id, page, glyph_no AS g1, g2, greatest(size_pt, 6.0) AS fs,
  greatest(0, least(x0 + 6, bx + 6) - greatest(x0, bx)) * greatest(0, least(y0 + size_pt, ty + bs) - greatest(y0, ty)) AS inter,
  6 * size_pt AS area_a, 6 * bs AS area_b FROM n)
SELECT doc_id, page, g1, g2, round(greatest(inter / greatest(area_a, fs * fs * 0.04), inter / area_b), 6) AS ratio, greatest(inter / greatest(area_a, fs * fs * 0.04), inter / area_b) >= 0.25 AS overlaps FROM p WHERE g2 IS NOT NULL""",
)
def overlap_ratio(b):
    nxt = Window.partitionBy("doc_id", "page").orderBy("glyph_no")
    g = b.gl.withColumns({"bx": F.lead("x0").over(nxt), "by": F.lead("y0").over(nxt), "bs": F.lead("size_pt").over(nxt), "g2": F.lead("glyph_no").over(nxt)}).filter("g2 is not null")
    inter = T.overlap(F.col("x0"), F.col("x0") + 6, F.col("bx"), F.col("bx") + 6) * T.overlap(F.col("y0"), F.col("y0") + F.col("size_pt"), F.col("by"), F.col("by") + F.col("bs"))
    fs = F.greatest("size_pt", F.lit(6.0))
    ratio = F.greatest(inter / F.greatest(6 * F.col("size_pt"), fs * fs * 0.04), inter / (6 * F.col("bs")))
    return g.select("doc_id", "page", F.col("glyph_no").alias("g1"), "g2", F.round(ratio, 6).alias("ratio"), (ratio >= 0.25).alias("overlaps"))


WAVE_SQL = f"""CASE WHEN x0 >= 0.72 * {WIDTH} AND y0 >= 0.52 * {HEIGHT} AND length(trim(text)) BETWEEN 1 AND 8 AND x1 - x0 <= 0.35 * {WIDTH} THEN 4 * page - 2
  WHEN page >= 2 AND y0 < 0.22 * {HEIGHT} THEN 4 * page - 7 WHEN page = 1 THEN 0 ELSE 4 * page - 5 END"""


def with_wave(ti):
    c = F.col
    pickup = T.page_end_pickup(c("text"), c("x0"), c("y0"), c("x1"), WIDTH, HEIGHT)
    return ti.withColumn("wave", T.reading_wave(c("page"), pickup, c("y0"), HEIGHT))


@query("reading_order", f"SELECT doc_id, line_no, CAST(w AS BIGINT) AS wave, round(x0 * 300 / 72.0, 4) AS px, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY w, y0, x0, line_no) AS BIGINT) AS place FROM (SELECT *, {WAVE_SQL} AS w FROM ti)")
def reading_order(b):
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("wave", "y0", "x0", "line_no"))
    return with_wave(b.ti).select("doc_id", "line_no", F.col("wave").cast("long").alias("wave"), F.round(F.col("x0") * 300 / 72.0, 4).alias("px"), place.cast("long").alias("place"))


@query("zone", f"SELECT doc_id, line_no, CASE WHEN x0 >= 0.72 * {WIDTH} AND y0 < 110 AND abs(x1 - x0) <= 14 THEN 'header' WHEN x0 < 130 AND y0 < 200 THEN 'sidebar_top' WHEN x0 < 130 THEN 'sidebar_bottom' ELSE 'other' END AS zone FROM ti")
def zone(b):
    return b.ti.select("doc_id", "line_no", T.zone(F.col("x0"), F.col("y0"), F.col("x1")).alias("zone"))


# A line whose first word is short stands for a detected number.
@query("resolve_type", "SELECT doc_id, line_no, CASE WHEN item_type IN ('page_number', 'measure_number') THEN item_type WHEN line_no % 7 = 0 THEN 'measure_number' WHEN item_type = 'title' THEN 'lyrics' ELSE item_type END AS kind FROM ti")
def resolve_type(b):
    given = F.when(F.col("item_type") != "title", F.col("item_type"))
    number = T.number_normalize(F.when(F.col("line_no") % 7 == 0, F.lit("12")))
    kind = F.when(given.isin("page_number", "measure_number"), given).when(number.isNotNull(), "measure_number").otherwise(F.coalesce(given, F.lit("lyrics")))
    return b.ti.select("doc_id", "line_no", kind.alias("kind"))


@query("default_role", "SELECT doc_id, line_no, CASE WHEN coalesce(item_type, '') IN ('', 'unknown') AND NOT (coalesce(item_type, '') = 'unknown' AND user_set) THEN 'lyrics' ELSE item_type END AS role, concat('item-', CAST(doc_id AS VARCHAR), '-', CAST(line_no AS VARCHAR)) AS item_id FROM rv")
def default_role(b):
    return b.rv.select("doc_id", "line_no", review.default_role().alias("role"), F.concat_ws("-", F.lit("item"), F.col("doc_id").cast("string"), F.col("line_no").cast("string")).alias("item_id"))


CLASS_SQL = r"CASE WHEN regexp_full_match(ch, '[♩-♯]') THEN 'music' WHEN regexp_full_match(ch, '[가-힣]') THEN 'hangul' WHEN ch = '=' THEN 'keep' WHEN regexp_full_match(ch, '[\p{L}\p{Nd}\p{No}\p{Nl}\p{Zs}\p{P}]') THEN 'strippable' ELSE 'other' END"


@query("char_class", f"SELECT doc_id, class, count(*) AS n FROM (SELECT doc_id, {CLASS_SQL} AS class FROM (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents)) GROUP BY ALL")
def char_class(b):
    counts = T.char_classes(F.col("text"))
    rows = b.table("documents").select("doc_id", F.explode(counts).alias("class", "n")).filter("n > 0")
    return rows.groupBy("doc_id", "class").agg(F.sum("n").alias("n"))


TEMPO_TEXT_SQL = "CASE line_no % 4 WHEN 0 THEN concat('q = ', CAST(10 + doc_id % 500 AS VARCHAR)) WHEN 1 THEN concat('Lento ', CAST(line_no AS VARCHAR), ' or ', CAST(60 + doc_id % 90 AS VARCHAR)) WHEN 2 THEN concat('=', CAST(66 + doc_id % 40 AS VARCHAR), '.5') ELSE 'Adagio' END"


def tempo_text():
    d, n = F.col("doc_id"), F.col("line_no")
    return (
        F.when(n % 4 == 0, F.concat(F.lit("q = "), (10 + d % 500).cast("string")))
        .when(n % 4 == 1, F.concat(F.lit("Lento "), n.cast("string"), F.lit(" or "), (60 + d % 90).cast("string")))
        .when(n % 4 == 2, F.concat(F.lit("="), (66 + d % 40).cast("string"), F.lit(".5")))
        .otherwise("Adagio")
    )


BPM_SQL = f"""(SELECT doc_id, line_no, page, y0, x0, x1, text, item_type, CASE WHEN after BETWEEN 20 AND 400 THEN after ELSE list_filter(all_n, lambda x: x BETWEEN 20 AND 400)[1] END AS bpm
  FROM (SELECT *, TRY_CAST(nullif(regexp_extract(t, '=\\s*(\\d+(?:\\.\\d+)?)', 1), '') AS DOUBLE) AS after, list_transform(regexp_extract_all(t, '\\d+(?:\\.\\d+)?'), lambda x: CAST(x AS DOUBLE)) AS all_n
        FROM (SELECT *, {TEMPO_TEXT_SQL} AS t FROM ti)))"""


@query("bpm_parse", f"SELECT doc_id, line_no, bpm, CASE WHEN bpm = floor(bpm) THEN CAST(CAST(bpm AS BIGINT) AS VARCHAR) ELSE CAST(bpm AS VARCHAR) END AS label FROM {BPM_SQL}")
def bpm_parse(b):
    return b.ti.select("doc_id", "line_no", T.bpm(tempo_text()).alias("bpm")).withColumn("label", T.bpm_label(F.col("bpm")))


@query("opening_tempo", f"SELECT doc_id, arg_min(bpm, (({WAVE_SQL}) * 1000.0 + y0) * 1000000.0 + x0 * 1000.0 + line_no / 100.0) AS bpm FROM {BPM_SQL} WHERE item_type = 'tempo' AND bpm IS NOT NULL GROUP BY doc_id")
def opening_tempo(b):
    t = with_wave(b.ti).filter("item_type = 'tempo'").withColumn("bpm", T.bpm(tempo_text())).filter("bpm is not null")
    return t.groupBy("doc_id").agg(F.min_by("bpm", F.struct("wave", "y0", "x0", "line_no")).alias("bpm"))


def hyphened():
    """Item text with hyphens where the words' length is a multiple of three."""
    return F.transform(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " "), lambda w: F.when(F.length(w) % 3 == 0, F.concat(F.substring(w, 1, 2), F.lit("-"), F.substring(w, 3, 100000))).when(F.length(w) % 7 == 0, "-").otherwise(w))


def lyric_tokens(words):
    """Rows (token_no, piece_no, op, piece, syllabic, shown): white space moves to the next note, a hyphen inside a word splits syllables."""
    pieces = F.array_remove(F.split("token", "-"), "")
    tokens = words.select("*", F.posexplode("words").alias("token_no", "token")).withColumn("pieces", F.when(F.size(pieces) == 0, F.array(F.lit(""))).otherwise(pieces))
    rows = tokens.select("*", F.posexplode("pieces").alias("piece_no", "piece"))
    last = F.size("pieces") - 1
    syllabic = F.when(F.col("piece") == "", F.lit(None)).when(last == 0, "single").when(F.col("piece_no") == 0, "begin").when(F.col("piece_no") == last, "end").otherwise("middle")
    shown = F.when(syllabic.isin("begin", "middle"), F.concat("piece", F.lit("-"))).otherwise(F.col("piece"))
    return rows.select("*", F.when(F.col("piece") == "", "empty_note").otherwise("syllable").alias("op"), syllabic.alias("syllabic"), shown.alias("shown")).drop("words", "token", "pieces")


@query(
    "lyric_tokens",
    r"""WITH w AS (SELECT doc_id, line_no, list_transform(regexp_split_to_array(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '),
   lambda x: CASE WHEN length(x) % 3 = 0 THEN concat(substr(x, 1, 2), '-', substr(x, 3)) WHEN length(x) % 7 = 0 THEN '-' ELSE x END) AS ws FROM ti WHERE item_type = 'lyrics'),
 t AS (SELECT doc_id, line_no, i - 1 AS token_no, list_filter(string_split(ws[i], '-'), lambda x: x <> '') AS ps FROM w, unnest(range(1, len(ws) + 1)) AS u(i)),
 p AS (SELECT doc_id, line_no, token_no, CASE WHEN len(ps) = 0 THEN [''] ELSE ps END AS ps FROM t),
 r AS (SELECT doc_id, line_no, token_no, j - 1 AS piece_no, ps[j] AS piece, len(ps) AS n FROM p, unnest(range(1, len(ps) + 1)) AS u(j)),
 s AS (SELECT *, CASE WHEN piece = '' THEN NULL WHEN n = 1 THEN 'single' WHEN piece_no = 0 THEN 'begin' WHEN piece_no = n - 1 THEN 'end' ELSE 'middle' END AS syllabic FROM r)
SELECT doc_id, line_no, CAST(token_no AS INTEGER) AS token_no, CAST(piece_no AS INTEGER) AS piece_no, CASE WHEN piece = '' THEN 'empty_note' ELSE 'syllable' END AS op, piece, syllabic,
  CASE WHEN syllabic IN ('begin', 'middle') THEN concat(piece, '-') ELSE piece END AS shown FROM s""",
)
def lyric_tokens_query(b):
    words = b.ti.filter("item_type = 'lyrics'").select("doc_id", "line_no", hyphened().alias("words"))
    return lyric_tokens(words)


EXPRESSION_SQL = r"(?i)\b(poco|mosso|rit\.?|accel\.?|andante|moderato|allegro|cantabile|piu|più|tempo)\b"


@query("injectable", rf"SELECT doc_id, line_no FROM (SELECT *, CASE WHEN line_no % 9 = 0 THEN concat('12 ', text) WHEN line_no % 9 = 1 THEN concat('poco ', text) WHEN line_no % 9 = 2 THEN '14' ELSE text END AS t FROM ti) WHERE item_type = 'lyrics' AND line_no % 9 <> 2 AND NOT regexp_matches(t, '{EXPRESSION_SQL}') AND NOT regexp_matches(trim(t), '^\d{{1,3}}\s+[A-Za-z]') AND NOT coalesce(length(regexp_replace(t, '[^0-9]', '', 'g')) BETWEEN 1 AND 3 AND TRY_CAST(nullif(regexp_replace(t, '[^0-9]', '', 'g'), '') AS BIGINT) BETWEEN 1 AND 999, false)")
def injectable(b):
    n = F.col("line_no") % 9
    t = F.when(n == 0, F.concat(F.lit("12 "), "text")).when(n == 1, F.concat(F.lit("poco "), "text")).when(n == 2, "14").otherwise(F.col("text"))
    return b.ti.filter(T.injectable(t, F.col("item_type"))).select("doc_id", "line_no")


@query("mask_types", "SELECT doc_id, item_type, count(*) AS n FROM ti WHERE item_type IN ('lyrics', 'title', 'unknown') GROUP BY ALL")
def mask_types(b):
    return b.ti.filter(F.col("item_type").isin("lyrics", "title", "unknown")).groupBy("doc_id", "item_type").agg(F.count("*").alias("n"))


@query("meta_concat", "SELECT doc_id, md5(coalesce(string_agg(text, ' ' ORDER BY page, y0, x0, line_no) FILTER (item_type = 'title'), '')) AS title, count(*) FILTER (item_type = 'title') AS n FROM ti GROUP BY doc_id")
def meta_concat(b):
    title = F.when(F.col("item_type") == "title", F.struct("page", "y0", "x0", "line_no", "text"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(title)), lambda s: s["text"]), " ")
    return b.ti.groupBy("doc_id").agg(F.md5(joined.cast("binary")).alias("title"), F.count(title).alias("n"))


@query("doc_kind", "SELECT doc_id, CASE WHEN sum(length(trim(text))) < 50 THEN 'image' ELSE 'vector' END AS kind FROM ti GROUP BY doc_id")
def doc_kind(b):
    return b.ti.groupBy("doc_id").agg(F.when(F.sum(F.length(F.trim("text"))) < 50, "image").otherwise("vector").alias("kind"))


@query("sparse_streams", "SELECT a.doc_id, a.page, target < greatest(10, ref / 3.0) AND ref > 2 * target AS sparse FROM (SELECT doc_id, page, sum(CASE WHEN item_type = 'lyrics' THEN length(text) ELSE 0 END) AS ref, sum(CASE WHEN item_type = 'title' THEN length(text) ELSE 0 END) AS target FROM ti GROUP BY ALL) a")
def sparse_streams(b):
    total = lambda kind: F.sum(F.when(F.col("item_type") == kind, F.length("text")).otherwise(0))
    s = b.ti.groupBy("doc_id", "page").agg(total("lyrics").alias("ref"), total("title").alias("target"))
    return s.select("doc_id", "page", ((F.col("target") < F.greatest(F.lit(10), F.col("ref") / 3.0)) & (F.col("ref") > 2 * F.col("target"))).alias("sparse"))


@query("source_priority", "SELECT doc_id, line_no, item_type FROM (SELECT *, count(*) FILTER (line_no % 2 = 1 AND doc_id % 2 = 0) OVER (PARTITION BY doc_id) AS reviewed FROM ti) WHERE item_type NOT IN ('page_number', 'unknown') AND (CASE WHEN reviewed > 0 THEN line_no % 2 = 1 AND doc_id % 2 = 0 ELSE true END OR item_type = 'title')")
def source_priority(b):
    is_review = (F.col("line_no") % 2 == 1) & (F.col("doc_id") % 2 == 0)
    any_review = F.max(is_review).over(Window.partitionBy("doc_id"))
    return b.ti.withColumns({"review": is_review, "any": any_review}).filter(~F.col("item_type").isin("page_number", "unknown")).filter(~F.col("any") | F.col("review") | (F.col("item_type") == "title")).select("doc_id", "line_no", "item_type")


@query(
    "has_user_edits",
    """SELECT doc_id, coalesce(bool_or(item_type = '_manual_lyric_mask' OR (item_type = 'unknown' AND user_set) OR (coalesce(item_type, '') NOT IN ('', 'lyrics', 'measure_number', 'page_number'))
      OR (coalesce(item_type, '') IN ('', 'lyrics') AND (part_index > 1 OR verse_index > 1 OR skip_notes > 0 OR coalesce(trim(voice), '') NOT IN ('', '1') OR len(rects) > 0))), false) AS edited FROM rv GROUP BY doc_id""",
)
def has_user_edits(b):
    return review.edited(b.rv)


@query("manifest_partition", "SELECT doc_id, count(*) FILTER (line_no % 10 = 3) AS masks, count(*) FILTER (line_no % 10 <> 3) AS items, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 2 + doc_id % 2 END AS version FROM ti GROUP BY doc_id")
def manifest_partition(b):
    """A manifest per document as JSON (a bare list is version 1), parsed with one schema and split again."""
    item = F.struct(F.col("line_no").alias("id"), F.when(F.col("line_no") % 10 == 3, "_manual_lyric_mask").otherwise(F.col("item_type")).alias("type"))
    docs = b.ti.groupBy("doc_id").agg(F.collect_list(item).alias("items"))
    v = F.when(F.col("doc_id") % 3 == 0, F.lit(1)).otherwise(2 + F.col("doc_id") % 2)
    text = docs.select("doc_id", F.when(v == 1, F.to_json("items")).otherwise(F.to_json(F.struct(v.alias("v"), "items"))).alias("json"))
    items = "array<struct<id: bigint, type: string>>"
    flat = F.startswith("json", F.lit("["))
    parsed = text.select(
        "doc_id",
        F.when(flat, 1).otherwise(F.from_json("json", f"v bigint, items {items}")["v"]).cast("long").alias("version"),
        F.when(flat, F.from_json("json", items)).otherwise(F.from_json("json", f"v bigint, items {items}")["items"]).alias("items"),
    )
    count = lambda keep: F.size(F.filter("items", keep)).cast("long")
    return parsed.select("doc_id", "version", count(lambda x: x["type"] == "_manual_lyric_mask").alias("masks"), count(lambda x: x["type"] != "_manual_lyric_mask").alias("items"))


@query("lyric_streams", f"SELECT doc_id, 1 + line_no % 3 AS part_no, least(greatest(line_no % 40, 1), 32) AS verse, count(*) AS n, md5(string_agg(text, ' ' ORDER BY w, y0, x0, line_no)) AS digest FROM (SELECT *, {WAVE_SQL} AS w FROM ti WHERE item_type = 'lyrics') GROUP BY ALL")
def lyric_streams(b):
    stream = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("wave", "y0", "x0", "line_no", "text"))), lambda s: s["text"]), " ")
    verse = F.least(F.greatest(F.col("line_no") % 40, F.lit(1)), F.lit(32))
    return with_wave(b.ti).filter("item_type = 'lyrics'").groupBy("doc_id", (1 + F.col("line_no") % 3).alias("part_no"), verse.alias("verse")).agg(F.count("*").alias("n"), F.md5(stream.cast("binary")).alias("digest"))


@query("detect_parts", "SELECT doc_id, label, line_no FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, label ORDER BY y0, line_no) AS n FROM (SELECT *, CASE WHEN regexp_matches(text, '^[Ss]') THEN 'S' WHEN regexp_matches(text, '^[Aa]') THEN 'A' WHEN regexp_matches(text, '^[Tt]') THEN 'T' WHEN regexp_matches(text, '^[Bb]') THEN 'B' END AS label FROM ti WHERE page = 2 AND x0 < 0.2 * 595) WHERE label IS NOT NULL) WHERE n = 1")
def detect_parts(b):
    label = F.when(F.col("text").rlike("^[Ss]"), "S").when(F.col("text").rlike("^[Aa]"), "A").when(F.col("text").rlike("^[Tt]"), "T").when(F.col("text").rlike("^[Bb]"), "B")
    rows = b.ti.filter((F.col("page") == 2) & (F.col("x0") < 0.2 * WIDTH)).withColumn("label", label).filter("label is not null")
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "label").orderBy("y0", "line_no"))).filter("n = 1").select("doc_id", "label", "line_no")


@query("title_candidate", "SELECT doc_id, text AS title FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY y0, length(text) DESC, line_no) AS n FROM ti WHERE page = 2 AND y0 < 0.28 * 842 AND length(text) <= 48 AND regexp_matches(text, '\\p{L}')) WHERE n = 1")
def title_candidate(b):
    rows = b.ti.filter((F.col("page") == 2) & (F.col("y0") < 0.28 * HEIGHT) & (F.length("text") <= 48) & F.col("text").rlike(r"\p{L}"))
    return rows.groupBy("doc_id").agg(F.min_by("text", F.struct("y0", -F.length("text"), "line_no")).alias("title"))


_SCORE_SQL = "100 * CASE WHEN item_type = 'unknown' THEN 1 ELSE 0 END + (x1 - x0) + 10 * CASE WHEN y0 > 421 THEN 1 ELSE 0 END"


@query("printed_markers", f"SELECT doc_id, measure, line_no, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, measure ORDER BY score DESC, line_no) AS n FROM (SELECT doc_id, line_no, 1 + line_no % 12 AS measure, {_SCORE_SQL} AS score FROM ti)) WHERE n = 1")
def printed_markers(b):
    score = 100 * F.when(F.col("item_type") == "unknown", 1).otherwise(0) + (F.col("x1") - F.col("x0")) + 10 * F.when(F.col("y0") > 421, 1).otherwise(0)
    rows = b.ti.select("doc_id", "line_no", (1 + F.col("line_no") % 12).alias("measure"), score.alias("score"))
    return rows.groupBy("doc_id", "measure").agg(F.max_by(F.struct("line_no", "score"), F.struct("score", -F.col("line_no"))).alias("x")).select("doc_id", "measure", "x.line_no", "x.score")


@query("marker_candidates", "SELECT doc_id, item_key, min(line_no) AS line_no FROM (SELECT doc_id, line_no, CASE WHEN line_no % 3 = 0 THEN concat('id', CAST(line_no % 20 AS VARCHAR)) ELSE concat_ws(':', CAST(page AS VARCHAR), item_type, CAST(x0 AS VARCHAR)) END AS item_key FROM ti) GROUP BY ALL")
def marker_candidates(b):
    key = F.coalesce(F.when(F.col("line_no") % 3 == 0, F.concat(F.lit("id"), (F.col("line_no") % 20).cast("string"))), F.concat_ws(":", F.col("page").cast("string"), "item_type", F.col("x0").cast("string")))
    return b.ti.groupBy("doc_id", key.alias("item_key")).agg(F.min("line_no").alias("line_no"))


@query("residue_counts", "SELECT doc_id, page, count(*) FILTER (regexp_matches(ch, '\\p{L}')) AS letters, count(*) FILTER (regexp_matches(ch, '[éèêçäöüßñóí]')) AS accented FROM (SELECT doc_id, page, unnest(string_split(text, '')) AS ch FROM ti) GROUP BY ALL")
def residue_counts(b):
    count = lambda pattern: F.sum(F.regexp_count("text", F.lit(pattern)).cast("long"))
    return b.ti.groupBy("doc_id", "page").agg(count(r"\p{L}").alias("letters"), count("[éèêçäöüßñóí]").alias("accented"))


@query("char_boxes", "SELECT doc_id, line_no, CAST(n - 1 AS INTEGER) AS i, round(x0 + (n - 1) * (x1 - x0) / len(cs), 4) AS cx0, round(x0 + n * (x1 - x0) / len(cs), 4) AS cx1 FROM (SELECT *, string_split(text, '') AS cs FROM ti WHERE item_type = 'title') t, unnest(range(1, len(cs) + 1)) AS u(n)")
def char_boxes(b):
    rows = b.ti.filter("item_type = 'title'").withColumn("cs", F.split("text", "")).select("*", F.posexplode("cs").alias("i", "ch"))
    width = (F.col("x1") - F.col("x0")) / F.size("cs")
    return rows.select("doc_id", "line_no", "i", F.round(F.col("x0") + F.col("i") * (F.col("x1") - F.col("x0")) / F.size("cs"), 4).alias("cx0"), F.round(F.col("x0") + (F.col("i") + 1) * (F.col("x1") - F.col("x0")) / F.size("cs"), 4).alias("cx1"))


@query("log_flag", "SELECT doc_id, regexp_matches(lower(text), '(warn|error|tion)') AS review FROM documents WHERE text IS NOT NULL")
def log_flag(b):
    return b.table("documents").filter("text is not null").select("doc_id", F.lower("text").rlike("(warn|error|tion)").alias("review"))
