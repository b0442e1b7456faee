"""Readers and writers of score files. Siblings of a measure keep their order in ``seq``.

Archives are read as binary files, one row each, and parsed inside tasks; a file that cannot be read gives one row
with ``error``, so one bad file never stops a corpus.
"""

from __future__ import annotations

import io
import itertools
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ELEMENT = (
    "path string, part_id string, measure_pos int, number string, seq int, kind string, voice string, staff string, duration int, type string, dots int, "
    "is_rest boolean, is_chord boolean, is_grace boolean, step string, alter int, octave int, lyric string, error string, "
    "stem string, default_x double, play_order int, beams array<struct<number:int,value:string>>, slurs array<struct<type:string,number:string,placement:string>>, ties array<string>, "
    "tuplet struct<actual:int,normal:int,type:string>, artic array<struct<tag:string,placement:string>>, lyrics array<struct<verse:int,syllabic:string,text:string>>"
)
#: One row per measure; null where the measure does not declare it.
MEASURES = (
    "path string, part_id string, measure_pos int, number string, implicit boolean, divisions int, beats int, beat_type int, fifths int, cancel boolean, "
    "clefs array<struct<staff:int,sign:string,line:int>>, new_page boolean, new_system boolean, error string"
)
PLAY_ORDER = "data-hitl-play-order"
# Names of the members of a work bundle, in order of preference.
BUNDLE_RANK = ("audiveris_raw", "review", "baseline")


def _text(node, tag: str, default: str | None = None) -> str | None:
    found = node.find(tag)
    return found.text.strip() if found is not None and found.text else default


def _whole(value: str | None, default: int = 0) -> int:
    return int(value) if value and value.isdigit() else default


def _number(value: str | None, kind: type = int):
    try:
        return kind(value) if value is not None else None
    except ValueError:
        return None


def _marks(node) -> dict:
    """What a note carries besides its pitch and length."""
    change, tuplet = node.find("time-modification"), node.find("notations/tuplet")
    modified = change is not None or tuplet is not None
    counts = [_number(_text(node, f"time-modification/{x}-notes")) for x in ("actual", "normal")]
    return {
        "stem": _text(node, "stem"),
        "default_x": _number(node.get("default-x"), float),
        "play_order": _number(node.get(PLAY_ORDER)),
        "beams": [{"number": _number(b.get("number", "1")), "value": (b.text or "").strip()} for b in node.findall("beam")],
        "slurs": [{x: b.get(x) for x in ("type", "number", "placement")} for b in node.findall("notations/slur")],
        "ties": [b.get("type") for b in node.findall("tie")],
        "tuplet": {"actual": counts[0], "normal": counts[1], "type": tuplet.get("type") if tuplet is not None else None} if modified else None,
        "artic": [{"tag": b.tag, "placement": b.get("placement")} for b in node.findall("notations/articulations/*")],
        "lyrics": [{"verse": _number(b.get("number", "1")), "syllabic": _text(b, "syllabic"), "text": _text(b, "text")} for b in node.findall("lyric")],
    }


#: A document type with its internal subset, in which quoted values and declarations may hold brackets.
DOCTYPE = re.compile(rb"""<!DOCTYPE(?:[^>\["']|"[^"]*"|'[^']*')*(?:\[(?:[^\]"']|"[^"]*"|'[^']*')*\]\s*)?>""")


def _root(xml: bytes):
    """The document without its type: entities that a file declares are never expanded, so a reference to one is an error."""
    root = ElementTree.fromstring(DOCTYPE.sub(b"", xml, count=1))
    for node in root.iter():
        node.tag = node.tag.rpartition("}")[2]
    return root


def _flag(node, name: str) -> bool | None:
    return None if node is None or node.get(name) is None else node.get(name) == "yes"


def _measures(path: str, xml: bytes) -> Iterator[dict]:
    for part in _root(xml).findall("part"):
        for pos, measure in enumerate(part.findall("measure"), 1):
            first = lambda tag: _number(_text(measure, f"attributes/{tag}"))
            printed, key = measure.find("print"), measure.find("attributes/key")
            clefs = [{"staff": _number(c.get("number", "1")), "sign": _text(c, "sign"), "line": _number(_text(c, "line"))} for c in measure.findall("attributes/clef")]
            yield {
                "path": path,
                "part_id": part.get("id"),
                "measure_pos": pos,
                "number": measure.get("number"),
                "implicit": _flag(measure, "implicit"),
                "divisions": first("divisions"),
                "beats": first("time/beats"),
                "beat_type": first("time/beat-type"),
                "fifths": first("key/fifths"),
                "cancel": key.find("cancel") is not None if key is not None else None,
                "clefs": clefs or None,
                "new_page": _flag(printed, "new-page"),
                "new_system": _flag(printed, "new-system"),
            }


def _elements(path: str, xml: bytes) -> Iterator[dict]:
    for part in _root(xml).findall("part"):
        for pos, measure in enumerate(part.findall("measure"), 1):
            for seq, node in enumerate((n for n in measure if n.tag in ("note", "backup", "forward")), 1):
                yield {
                    "path": path,
                    "part_id": part.get("id"),
                    "measure_pos": pos,
                    "number": measure.get("number"),
                    "seq": seq,
                    "kind": node.tag,
                    "voice": _text(node, "voice", "1"),
                    "staff": _text(node, "staff", "1"),
                    "duration": _whole(_text(node, "duration")),
                    "type": _text(node, "type"),
                    "dots": len(node.findall("dot")),
                    "is_rest": node.find("rest") is not None,
                    "is_chord": node.find("chord") is not None,
                    "is_grace": node.find("grace") is not None,
                    "step": _text(node, "pitch/step"),
                    "alter": int(float(_text(node, "pitch/alter", "0"))),
                    "octave": _whole(_text(node, "pitch/octave"), -1) if node.find("pitch") is not None else None,
                    "lyric": _text(node, "lyric/text"),
                    "error": None,
                    **_marks(node),
                }


def archive_root(content: bytes) -> bytes:
    """The score of an archive, as its container names it."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        found = re.search(r'full-path="([^"]+)"', archive.read("META-INF/container.xml").decode("utf-8", "replace"))
        if not found:
            raise ValueError("the container names no score")
        return archive.read(found.group(1))


_ARROW = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}


def _arrow(kind: str) -> pa.DataType:
    if kind.startswith("array<"):
        return pa.list_(_arrow(kind[6:-1]))
    if kind.startswith("struct<"):
        return pa.struct([(name, _ARROW[x]) for name, x in (f.split(":") for f in kind[7:-1].split(","))])
    return _ARROW[kind]


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(name, _arrow(kind)) for name, kind in (c.split() for c in ddl.split(", "))])


def _parsed(open_: Callable[[bytes], bytes], rows_of: Callable[[str, bytes], Iterator[dict]] = _elements, ddl: str = ELEMENT):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.to_pylist():
                path = file["path"]
                try:
                    rows = list(rows_of(path, open_(file["content"])))
                except Exception as error:  # the file's own fault; reported in its row
                    rows = [{"path": path, "error": f"{type(error).__name__}: {error}"[:300]}]
                yield pa.RecordBatch.from_pylist(rows, schema=_schema(ddl))

    return run


def files(spark: SparkSession, folder: str, pattern: str = "*.{mxl,musicxml,xml}") -> DataFrame:
    """path, length and content of every file below the folder whose name fits."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)


def discover(spark: SparkSession, folder: str, pattern: str = "*.{mxl,musicxml}") -> DataFrame:
    return files(spark, folder, pattern).select("path", "length").orderBy("path")


def scan_archives(spark: SparkSession, folder: str) -> DataFrame:
    found = files(spark, folder, "*.mxl").select("path", "content")
    return found.mapInArrow(_parsed(archive_root), ELEMENT)


def scan_xml(spark: SparkSession, folder: str) -> DataFrame:
    found = files(spark, folder, "*.{musicxml,xml}").select("path", "content")
    return found.mapInArrow(_parsed(bytes), ELEMENT)


def scan_measures(spark: SparkSession, folder: str) -> DataFrame:
    """The measures of every archive with what they declare; those without notes too."""
    return files(spark, folder, "*.mxl").select("path", "content").mapInArrow(_parsed(archive_root, _measures, MEASURES), MEASURES)


def scan_bundles(spark: SparkSession, folder: str) -> DataFrame:
    """Elements of the preferred score archive within each work bundle (an archive of archives)."""

    def best(content: bytes) -> bytes:
        with zipfile.ZipFile(io.BytesIO(content)) as bundle:
            rank = lambda name: next((i for i, key in enumerate(BUNDLE_RANK) if key in name), len(BUNDLE_RANK))
            names = sorted((n for n in bundle.namelist() if n.endswith(".mxl")), key=lambda n: (rank(n), n))
            if not names:
                raise ValueError("the bundle holds no score")
            return archive_root(bundle.read(names[0]))

    found = files(spark, folder, "*.zip").select("path", "content")
    return found.mapInArrow(_parsed(best), ELEMENT)


def scan_layout(spark: SparkSession, folder: str) -> DataFrame:
    """Glyphs of page-layout files: an array of pages, each with its text elements."""
    glyph = "struct<raw_text:string,x0:double,y0:double,x1:double,y1:double,fontname:string,size:double>"
    schema = f"page_number int, width double, height double, text_elements array<{glyph}>"
    pages = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).json(folder)
    return pages.select(F.col("_metadata.file_path").alias("path"), F.col("page_number").alias("page"), "width", "height", F.inline("text_elements"))


def scan_fixes(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of correction logs, ``{"fixes": [...]}`` or a bare list; a log that cannot be read gives none."""
    fix = "array<struct<id:string,kind:string,partId:string,measureMxl:string,noteIndex:int,args:map<string,string>>>"
    text = spark.read.text(folder, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("file"), F.trim("value").alias("json"))
    log = F.from_json("json", f"path string, fixes {fix}")
    bare = F.startswith("json", F.lit("["))
    listed = F.when(bare, F.from_json("json", fix)).otherwise(log["fixes"])
    # A log of write_fixes names the file its fixes came from.
    named = F.coalesce(F.when(~bare, log["path"]), F.col("file")).alias("path")
    return text.select(named, F.posexplode(listed).alias("ord", "f")).select("path", "ord", "f.*")


def write_fixes(fixes: DataFrame, folder: str, saved_at: str) -> None:
    """One log per score: a JSON object with version, time and its fixes in order, with their values; scan_fixes reads them back."""
    row = F.struct("ord", F.struct("id", "kind", "partId", "measureMxl", "noteIndex", "args").alias("f"))
    # A map has no order, so the rows are sorted by their number alone.
    placed = F.array_sort(F.collect_list(row), lambda a, b: a["ord"] - b["ord"])
    logs = fixes.groupBy("path").agg(F.transform(placed, lambda x: x["f"].withField("ord", x["ord"])).alias("fixes"))
    logs = logs.select(F.lit(1).alias("version"), F.lit(saved_at).alias("savedAt"), "path", "fixes")
    logs.write.mode("overwrite").option("maxRecordsPerFile", 1).json(folder)


SYMBOL = (
    "measure int, staff int, pitch string, duration double, duration_type string, rest boolean, voice int, x double, y double, lyric string, confidence_pitch double, "
    "confidence_duration double, kind string, clef_sign string, clef_line int, time_beats int, time_beat_type int, page int, system int"
)


def scan_symbols(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes of symbol graphs with the path and the metadata of their graph."""
    node = f"array<struct<{', '.join(x.replace(' ', ':') for x in SYMBOL.split(', '))}>>"
    graphs = spark.read.schema(f"path string, metadata map<string,string>, nodes {node}").option("multiLine", True).json(folder)
    # A graph of write_symbols names the file its nodes came from.
    return graphs.select(F.coalesce("path", F.col("_metadata.file_path")).alias("path"), "metadata", F.inline("nodes"))


def write_symbols(nodes: DataFrame, folder: str) -> None:
    """One symbol graph per path, its nodes by measure, staff, x and y, then by the rest of their fields; scan_symbols reads them back."""
    names = [x.split()[0] for x in SYMBOL.split(", ")]
    first = ["measure", "staff", "x", "y"]
    row = F.struct(*first, *[c for c in names if c not in first])
    graphs = nodes.groupBy("path").agg(F.any_value("metadata").alias("metadata"), F.array_sort(F.collect_list(row)).alias("nodes"))
    graphs.write.mode("overwrite").option("maxRecordsPerFile", 1).json(folder)


def write_elements(elements: DataFrame, folder: str, buckets: int = 64) -> None:
    """Parquet by bucket of the score, so a reader of some scores prunes the others."""
    elements.withColumn("bucket", F.pmod(F.xxhash64("path"), F.lit(buckets))).write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(folder)


def _child(to, tag: str, value=None, **attributes):
    node = ElementTree.SubElement(to, tag, {k.replace("_", "-"): str(v) for k, v in attributes.items() if v is not None})
    node.text = None if value is None else str(value)
    return node


def _xml_of(rows: list[dict], measures: list[dict]) -> bytes:
    root = ElementTree.Element("score-partwise")
    found: dict[tuple, tuple[dict, list[dict]]] = {}
    for r in sorted(measures, key=lambda r: (r["part_id"] or "", r["measure_pos"])) + sorted(rows, key=lambda r: (r["part_id"] or "", r["measure_pos"], r["seq"])):
        found.setdefault((r["part_id"] or "", r["measure_pos"]), (r, []))[1].extend([r] if "seq" in r else [])
    for part_id, part_rows in itertools.groupby(sorted(found.items(), key=lambda x: x[0]), key=lambda x: x[0][0]):
        part = _child(root, "part", id=part_id)
        for _, (head, elements) in part_rows:
            yes = lambda x: None if head.get(x) is None else "yes" if head[x] else "no"
            measure = _child(part, "measure", number=head["number"] or "", implicit=yes("implicit"))
            if "seq" not in head:
                _write_declared(measure, head, yes)
            for r in elements:
                _write_element(measure, r)
    return ElementTree.tostring(root, encoding="utf-8")


def _write_declared(measure, m: dict, yes: Callable[[str], str | None]) -> None:
    if m["new_page"] is not None or m["new_system"] is not None:
        _child(measure, "print", new_page=yes("new_page"), new_system=yes("new_system"))
    names = ("divisions", "beats", "beat_type", "fifths", "cancel", "clefs")
    if all(m[x] is None for x in names):
        return
    node = _child(measure, "attributes")
    if m["divisions"] is not None:
        _child(node, "divisions", m["divisions"])
    if m["fifths"] is not None or m["cancel"] is not None:
        key = _child(node, "key")
        if m["cancel"]:
            _child(key, "cancel")
        if m["fifths"] is not None:
            _child(key, "fifths", m["fifths"])
    if m["beats"] is not None or m["beat_type"] is not None:
        time = _child(node, "time")
        for tag in ("beats", "beat_type"):
            if m[tag] is not None:
                _child(time, tag.replace("_", "-"), m[tag])
    for c in m["clefs"] or []:
        clef = _child(node, "clef", number=c["staff"])
        for tag in ("sign", "line"):
            if c[tag] is not None:
                _child(clef, tag, c[tag])


def _write_element(measure, r: dict) -> None:
    node = _child(measure, r["kind"], **{"default-x": r.get("default_x"), PLAY_ORDER: r.get("play_order")})

    def add(tag: str, value: str | None = None, to=node):
        child = ElementTree.SubElement(to, tag)
        child.text = value
        return child

    for flag in ("grace", "chord", "rest"):
        if r[f"is_{flag}"]:
            add(flag)
    if r["step"] is not None:
        pitch = add("pitch")
        for tag in ("step", "alter", "octave"):
            add(tag, str(r[tag]), pitch)
    add("duration", str(r["duration"]))
    if r["kind"] == "note":
        for kind in r.get("ties") or []:
            _child(node, "tie", type=kind)
        add("voice", r["voice"])
        if r["type"] is not None:
            add("type", r["type"])
        for _ in range(r["dots"]):
            add("dot")
        tuplet, slurs, artic = r.get("tuplet"), r.get("slurs"), r.get("artic")
        if tuplet and (tuplet["actual"] is not None or tuplet["normal"] is not None):
            change = add("time-modification")
            for x in ("actual", "normal"):
                if tuplet[x] is not None:
                    add(f"{x}-notes", str(tuplet[x]), change)
        if r.get("stem") is not None:
            add("stem", r["stem"])
        add("staff", r["staff"])
        for b in r.get("beams") or []:
            _child(node, "beam", b["value"], number=b["number"])
        if slurs or artic or (tuplet and tuplet["type"]):
            notations = add("notations")
            for x in slurs or []:
                _child(notations, "slur", **x)
            if tuplet and tuplet["type"]:
                _child(notations, "tuplet", type=tuplet["type"])
            if artic:
                group = _child(notations, "articulations")
                for x in artic:
                    _child(group, x["tag"], placement=x["placement"])
        for x in r.get("lyrics") or ([{"verse": None, "syllabic": None, "text": r["lyric"]}] if r["lyric"] is not None else []):
            lyric = _child(node, "lyric", number=x["verse"])
            for tag in ("syllabic", "text"):
                if x[tag] is not None:
                    add(tag, x[tag], lyric)


def archives_of(elements: DataFrame, measures: DataFrame | None = None) -> DataFrame:
    """path, content: one archive per score, for tools that want files; measures: what scan_measures gives. A score bounds the group."""

    def pack(rows: pa.Table, declared: pa.Table) -> pa.Table:
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
            archive.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="score.xml"/></rootfiles></container>')
            archive.writestr("score.xml", _xml_of(rows.to_pylist(), declared.to_pylist()))
        path = (rows if rows.num_rows else declared).column("path")[:1]
        return pa.table({"path": path, "content": pa.array([buffer.getvalue()], pa.binary())})

    if measures is None:
        measures = elements.sparkSession.createDataFrame([], MEASURES)
    sound = lambda df: df.filter("error is null").groupBy("path")
    return sound(elements).cogroup(sound(measures)).applyInArrow(pack, "path string, content binary")


def write_report(issues: DataFrame, folder: str) -> None:
    """Issue reports as JSON lines, one per score; its issues are sorted by their columns."""
    rows = F.array_sort(F.collect_list(F.struct(*[c for c in issues.columns if c != "score_id"])))
    report = issues.groupBy("score_id").agg(rows.alias("issues"), F.count("*").alias("total"))
    report.write.mode("overwrite").json(folder)


