r"""Operator 12: conversation structure repair by dynamic programming over a grammar-compressed sequence.

A conversation is a sequence of symbols, one for each row: the class of its role's initial (s, u, a, other) and whether it must be deleted (blank
or a duplicate) or is truncated. Re-Pair replaces frequent pairs of symbols by rules, counted over the sequences of all conversations; each round takes
the most frequent pairs that share no symbol. A symbol's transfer matrix has, for each state before and after (nothing yet, system,
user, assistant), the least cost and its audit as a rope, inserts before the row included. Matrices multiply as (min, +), ties to
the ASCII-least audit, so a rule's matrix is the product of its two symbols'; rules are evaluated bottom-up, once for all conversations. With equal costs and
states no audit is the beginning of another one, so the least audit of a product is made of the least of its factors.

A long conversation is cut into chunks of ``CHUNK`` rows wherever the sorted rows lie; chunks are multiplied where they are and a
conversation folds its chunks' matrices, so no task gathers its rows. Its repaired text streams through one task, row by row, as its
digest is one value. The audit is one value too.

Order: turn (nulls first); ties by role and the SHA-256 of the text after damage, which tells apart all but equal rows.

Defined cases: a null role or text is one space, in the damage's key also a null turn or conv_id; a null conv_id is a conversation; an empty role has no
initial, so it is kept nowhere and makes its neighbours illegal; repeated rows are duplicates; a conversation whose rows are all dropped has zeros,
an empty audit and the hash of an empty string; gaps that do not fit in a long are null; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stavelake.llm.common import Scratch, table, written

CHUNK = 512
MAX_RULES = 256
ROUNDS = 12
#: Rows with a pair that a round must save to be worth a rule.
LEAST_PAIRS = 2
#: Rule symbols follow these code points; terminals are the letters below.
FIRST_RULE = 0x100
SPACES = " \t\n\x0b\f\r"
#: Lower case: as it is; upper case: truncated; x: must be deleted.
TERMINALS = "suaoSUAOx"
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
LEGAL = {"su", "ua", "au"}
NAMES = {USER: "user", ASSISTANT: "assistant"}


def alternate(state: int) -> int:
    """The state after an inserted or reroled turn."""
    return ASSISTANT if state == USER else USER


class Rope:
    """An audit as a tree of shared pieces; a leaf is a string."""

    __slots__ = ("left", "right")

    def __init__(self, left: Rope | str, right: Rope | str) -> None:
        self.left, self.right = left, right


def leaves(rope: Rope | str) -> Iterator[str]:
    stack = [rope]
    while stack:
        top = stack.pop()
        if isinstance(top, str):
            yield top
        else:
            stack += (top.right, top.left)


def text_of(rope: Rope | str) -> str:
    return rope if isinstance(rope, str) else "".join(leaves(rope))


def less(a: Rope | str, b: Rope | str) -> bool:
    """Whether a's letters come before b's; pieces that both share at the same place are skipped whole."""
    left, right = [a], [b]
    while left and right:
        x, y = left.pop(), right.pop()
        if x is y:
            continue
        if isinstance(x, Rope) or isinstance(y, Rope):
            left += (x.right, x.left) if isinstance(x, Rope) else (x,)
            right += (y.right, y.left) if isinstance(y, Rope) else (y,)
            continue
        n = min(len(x), len(y))
        if x[:n] != y[:n]:
            return x[:n] < y[:n]
        if len(x) > n:
            left.append(x[n:])
        if len(y) > n:
            right.append(y[n:])
    return not any(left) and any(text_of(r) for r in right)


#: Costs and audits by (state before, state after).
Matrix = dict[tuple[int, int], tuple[int, Rope | str]]


def better(new: tuple, old: tuple | None) -> bool:
    return old is None or new[0] < old[0] or (new[0] == old[0] and less(new[1], old[1]))


def times(a: Matrix, b: Matrix) -> Matrix:
    """The (min, +) product; ties to the least audit."""
    out: Matrix = {}
    for (i, k), (cost, rope) in a.items():
        for j in STATES:
            if (k, j) in b:
                more, tail = b[k, j]
                entry = (cost + more, Rope(rope, tail) if rope and tail else rope or tail)
                if better(entry, out.get((i, j))):
                    out[i, j] = entry
    return out


@functools.cache
def inserts() -> Matrix:
    """Up to two inserted turns; a third returns to a state that one reaches."""
    out: Matrix = {(i, i): (0, "") for i in STATES}
    for i in STATES:
        once = alternate(i)
        for j, entry in ((once, (2, "I")), (alternate(once), (4, "II"))):
            if better(entry, out.get((i, j))):
                out[i, j] = entry
    return out


@functools.cache
def terminal(symbol: str) -> Matrix:
    edits: Matrix = {(i, i): (3, "D") for i in STATES}
    if symbol != "x":
        late = int(symbol.isupper())
        for i in STATES:
            for j, entry in ((alternate(i), (2 + late, "R")), (KEPT.get((i, symbol.lower())), (late, "K"))):
                if j is not None and better(entry, edits.get((i, j))):
                    edits[i, j] = entry
    return times(inserts(), edits)


def compressed(symbols: str, rules: list[str]) -> str:
    for k, pair in enumerate(rules):
        symbols = symbols.replace(pair, chr(FIRST_RULE + k))
    return symbols


class Grammar:
    """Matrices of all symbols, a rule's made of the two symbols' that it stands for."""

    def __init__(self, rules: list[str]) -> None:
        self.rules = rules
        self.of = {s: terminal(s) for s in TERMINALS}
        for k, pair in enumerate(rules):
            self.of[chr(FIRST_RULE + k)] = times(self.of[pair[0]], self.of[pair[1]])
        self.seen: dict[str, Matrix] = {}

    def matrix(self, symbols: str) -> Matrix:
        short = compressed(symbols, self.rules)
        found = self.seen.get(short)
        if found is None:
            found = functools.reduce(times, (self.of[s] for s in short))
            found = {k: (cost, text_of(rope)) for k, (cost, rope) in found.items()}
            if len(short) <= 8 and len(self.seen) < 1 << 14:
                self.seen[short] = found
        return found


def re_pair(sequences: DataFrame) -> list[str]:
    """The rules, in order, from (symbols, n). Pairs are counted on the executors; a round's best ones come to the driver."""
    rules: list[str] = []
    for _ in range(ROUNDS):
        now = list(rules)

        def run(batches: Iterator[pa.RecordBatch], now: list[str] = now) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found: Counter = Counter()
                for symbols, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    short, last = compressed(symbols, now), -1
                    for i, pair in enumerate(zip(short, short[1:])):
                        if pair[0] != pair[1] or last != i - 1:  # of three equal symbols, one pair
                            found["".join(pair)] += n
                            last = i if pair[0] == pair[1] else -1
                        else:
                            last = -1
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["pair", "n"])

        counts = sequences.mapInArrow(run, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_PAIRS)
        used: set[str] = set()
        for r in counts.orderBy(F.desc("n"), "pair").limit(MAX_RULES).collect():
            if len(rules) < MAX_RULES and not used & set(r["pair"]):
                used |= set(r["pair"])
                rules.append(r["pair"])
        if len(rules) == len(now) or len(rules) == MAX_RULES:
            break
    return rules


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the contract's damage."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = (F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20).cast("int")
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), shown("role").alias("role"), shown("text").alias("text"), kind.alias("kind")).filter("kind != 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("_copy")).drop("_copy")


ORDER = ["turn", "role", "mark", "uid"]


def faults(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Narrow rows: conv_id and the order's columns, symbol, initial and fault (b, d, t or -). rows has a uid."""
    bare = F.rtrim(F.col("text"), F.lit(SPACES))
    flags = rows.select(
        "conv_id", *ORDER, (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"),
        F.when(F.left("role", F.lit(1)).isin("s", "u", "a"), F.left("role", F.lit(1))).otherwise("o").alias("initial"),
    )
    # The first of equal rows is known by its number, so no join has a key of many rows.
    first = flags.groupBy("conv_id", "role", "mark").agg(F.min(F.struct("turn", "uid")).alias("first")).select(F.col("first.uid").alias("uid"), F.lit(True).alias("new"))
    marked = flags.join(first, "uid", "left")
    fault = F.when(F.col("blank"), "b").when(F.col("new").isNull(), "d").when(F.col("cut"), "t").otherwise("-")
    symbol = F.when(fault.isin("b", "d"), "x").when(fault == "t", F.upper("initial")).otherwise(F.col("initial"))
    return scratch.written(marked.select("conv_id", *ORDER, symbol.alias("symbol"), "initial", fault.alias("fault")), "faults")


def _chunks(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Consecutive rows of one conversation, ``most`` at most: the first row's order columns, the letters of all and their numbers."""
        schema: pa.Schema | None = None
        open_rows: dict[str, list] = {}

        def closed() -> pa.RecordBatch:
            first = [pa.array(open_rows[c][:1], schema.field(c).type) for c in ("conv_id", *ORDER)]
            letters = [pa.array(["".join(open_rows[c])]) for c in ("symbol", "initial", "fault")]
            return pa.RecordBatch.from_arrays([*first, *letters, pa.array([open_rows["uid"]], pa.list_(pa.int64()))], names=["conv_id", *ORDER, "symbols", "initials", "faults", "uids"])

        for b in batches:
            schema = b.schema
            columns = {n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)}
            out, at = [], 0
            conv = columns["conv_id"]
            while at < b.num_rows:
                own = open_rows and open_rows["conv_id"][0] == conv[at] and len(open_rows["uid"]) < most
                if open_rows and not own:
                    out.append(closed())
                if not own:
                    open_rows = {c: [] for c in columns}
                room, to = most - len(open_rows["uid"]), at
                while to < b.num_rows and to - at < room and conv[to] == conv[at]:
                    to += 1
                for c, values in columns.items():
                    open_rows[c] += values[at:to]
                at = to
            if out:
                yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
        if open_rows:
            yield closed()

    return run


def _evaluated(rules: list[str], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(rules)
        for b in batches:
            found = [grammar.matrix(s) for s in b.column(b.schema.get_field_index("symbols")).to_pylist()]
            cells = [[m.get((i, j), (None, None)) for i in STATES for j in STATES] for m in found]
            costs = pa.array([[c for c, _ in row] for row in cells], pa.list_(pa.int64()))
            audits = pa.array([[a for _, a in row] for row in cells], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(n)) for n in names), costs, audits], names=[*names, "costs", "audits"])

    return run


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each conversation's chunks in order: the chunk's place, state before and audit; with the last one the totals."""
    none = object()
    conv, vector, chunks, totals, edge, kind = none, {}, [], Counter(), "", None

    def done() -> pa.RecordBatch:
        last = max(chunks, key=lambda c: c[0])[0]
        ends = times({(START, j): (cost, rope) for j, (cost, rope, _) in vector.items()}, inserts())
        end = START if (START, ASSISTANT) not in ends or ((START, START) in ends and not better(ends[START, ASSISTANT], ends[START, START])) else ASSISTANT
        cost, audit = ends[START, end][0], text_of(ends[START, end][1])
        # The state before the inserts at the end: the one whose letters, with them, are the audit.
        before = min((j for j, (c, _, _) in vector.items() if (j, end) in inserts() and c + inserts()[j, end][0] == cost and text_of(vector[j][1]) + inserts()[j, end][1] == audit))
        tail, path, rows = inserts()[before, end][1], vector[before][2], []
        while path is not None:
            path, place, uid, start, letters = path
            rows.append([uid, place, start, letters + (tail if place == last else "")] + ([cost, audit, *(totals[x] for x in ("b", "d", "t", "illegal"))] if place == last else [None] * 6))
        columns = list(zip(*rows))
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.string(), *[pa.int64()] * 4]
        names = ["uid", "place", "start", "letters", "cost", "audit", "blank", "duplicate", "truncated", "illegal"]
        return pa.RecordBatch.from_arrays([pa.array([conv] * len(rows), kind), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["conv_id", *names])

    for b in batches:
        kind, out = b.schema.field("conv_id").type, []
        for r in b.to_pylist():
            if conv is none or r["conv_id"] != conv:
                if conv is not none:
                    out.append(done())
                conv, vector, chunks, totals, edge = r["conv_id"], {START: (0, "", None)}, [], Counter(), ""
            place = chunks[-1][0] + 1 if chunks else 0
            chunks = [(place,)]
            after: dict = {}
            for i, (cost, rope, path) in vector.items():
                for j in STATES:
                    more = r["costs"][4 * i + j]
                    if more is not None:
                        letters = r["audits"][4 * i + j]
                        entry = (cost + more, Rope(rope, letters) if rope and letters else rope or letters)
                        if better(entry, after.get(j)):
                            after[j] = (*entry, (path, place, r["uid"], i, letters))
            vector = after
            letters = edge + r["initials"]
            totals["illegal"] += sum(letters[k : k + 2] not in LEGAL for k in range(len(letters) - 1))
            totals.update(r["faults"])
            edge = r["initials"][-1]
        if out:
            yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
    if conv is not none:
        yield done()


def _spelt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of chunks with their audits, for each row with output: the inserted turns before and after it, and its new role (empty: its own; null: gone)."""
    for b in batches:
        out: dict[str, list] = {c: [] for c in ("uid", "row", "at", "before", "role_now", "after")}
        rows = zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("uids", "symbols", "start", "letters")))
        for row, (uids, symbols, state, letters) in enumerate(rows):
            k, waiting, last = 0, "", None
            for letter in letters:
                if letter == "I":
                    state = alternate(state)
                    waiting += NAMES[state] + ":\n"
                    continue
                role = None
                if letter == "R":
                    state = alternate(state)
                    role = NAMES[state]
                elif letter == "K":
                    state = KEPT[state, symbols[k].lower()]
                    role = ""
                if role is not None or waiting:
                    last = len(out["uid"])
                    for c, v in (("uid", uids[k]), ("row", row), ("at", k), ("before", waiting), ("role_now", role), ("after", "")):
                        out[c].append(v)
                    waiting = ""
                k += 1
            if waiting:
                if last is None:
                    for c, v in (("uid", uids[-1]), ("row", row), ("at", k), ("before", ""), ("role_now", None), ("after", waiting)):
                        out[c].append(v)
                else:
                    out["after"][last] = waiting
        index = pa.array(out["row"], pa.int64())
        own = [b.column(b.schema.get_field_index(c)).take(index) for c in ("conv_id", "place")]
        yield pa.RecordBatch.from_arrays(
            [pa.array(out["uid"], pa.int64()), *own, pa.array(out["at"], pa.int32()), *(pa.array(out[c], pa.string()) for c in ("before", "role_now", "after"))],
            names=["uid", "conv_id", "place", "at", "before", "role_now", "after"],
        )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id and the hash of its lines, which come in order; no more than a batch is held."""
    none = object()
    conv, digest, kind, begun = none, None, None, False
    for b in batches:
        kind, found = b.schema.field("conv_id").type, []
        for c, lines in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if conv is none or c != conv:
                if conv is not none:
                    found.append((conv, digest.hexdigest()))
                conv, digest, begun = c, hashlib.sha256(), False
            digest.update((("\n" if begun else "") + lines[:-1]).encode())
            begun = True
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], kind), pa.array([h for _, h in found], pa.string())], names=["conv_id", "repaired_sha256"])
    if conv is not none:
        yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([digest.hexdigest()])], names=["conv_id", "repaired_sha256"])


def repaired_rows(rows: DataFrame, scratch: Scratch, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """Totals of each conversation (conv_id, cost, audit, blank, duplicate, truncated, illegal), and its repaired lines: conv_id, place, at, lines (each ends with a line break)."""
    conv = f"conv_id {dict(rows.dtypes)['conv_id']}"
    order = "turn long, role string, mark binary, uid long"
    rows = scratch.written(rows.withColumns({"uid": F.monotonically_increasing_id(), "mark": F.unhex(F.sha2("text", 256))}), "rows")
    narrow = faults(rows, scratch).repartitionByRange("conv_id", *ORDER).sortWithinPartitions("conv_id", *ORDER)
    chunks = scratch.written(narrow.mapInArrow(_chunks(chunk), f"{conv}, {order}, symbols string, initials string, faults string, uids array<long>"), "chunks")
    rules = re_pair(chunks.groupBy("symbols").agg(F.count("*").alias("n")))
    kept = ["conv_id", *ORDER, "initials", "faults"]
    valued = chunks.select(*kept, "symbols").mapInArrow(_evaluated(rules, kept), f"{conv}, {order}, initials string, faults string, costs array<long>, audits array<string>")
    in_order = valued.repartition("conv_id").sortWithinPartitions("conv_id", *ORDER)
    totals = "cost long, audit string, blank long, duplicate long, truncated long, illegal long"
    folded = scratch.written(in_order.mapInArrow(_folded, f"{conv}, uid long, place long, start int, letters string, {totals}"), "folded")
    chosen = chunks.select("uid", "uids", "symbols").join(folded.select("conv_id", "uid", "place", "start", "letters"), "uid")
    pieces = chosen.mapInArrow(_spelt, f"uid long, {conv}, place long, at int, before string, role_now string, after string")
    line = F.when(F.col("role_now").isNull(), "").otherwise(F.concat(F.when(F.col("role_now") == "", F.col("role")).otherwise(F.col("role_now")), F.lit(":"), "text", F.lit("\n")))
    lines = pieces.join(rows.select("uid", "role", "text"), "uid").select("conv_id", "place", "at", F.concat("before", line, "after").alias("lines"))
    return folded.filter("cost is not null").select("conv_id", *(x.split()[0] for x in totals.split(", "))), lines


def repaired(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Every conversation with its gaps, faults, cost, audit and the digest of its repaired rows."""
    with Scratch(conversations.sparkSession) as scratch:
        rows = damaged(conversations)
        conv = f"conv_id {dict(rows.dtypes)['conv_id']}"
        totals, lines = repaired_rows(rows, scratch, chunk)
        digests = lines.repartition("conv_id").sortWithinPartitions("conv_id", "place", "at").select("conv_id", "lines").mapInArrow(_digests, f"{conv}, repaired_sha256 string")
        wide = lambda c: c.cast("decimal(38,0)")
        turns = rows.groupBy("conv_id", "turn").agg(F.count("*").alias("n")).groupBy("conv_id").agg((wide(F.max("turn")) - wide(F.min("turn")) + 1 - F.count("turn")).try_cast("long").alias("gaps"), F.count("turn").alias("turns"))
        gaps = turns.select("conv_id", F.when(F.col("turns") == 0, 0).otherwise(F.col("gaps")).alias("gaps"), F.lit(True).alias("any"))
        parts = [conversations.select("conv_id").distinct(), gaps, totals, digests]
        whole = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).groupBy("conv_id")
        numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
        found = whole.agg(F.max("any").alias("any"), *[F.max(c).alias(c) for c in [*numbers, "audit", "repaired_sha256"]])
        empty = hashlib.sha256(b"").hexdigest()
        out = [F.when(F.col("any").isNull() if c == "gaps" else F.col(c).isNull(), F.lit(0).cast("long")).otherwise(F.col(c)).alias(c) for c in numbers]
        return written(found.select("conv_id", *out, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256")), "repaired")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(table(spark, sf_dir, "conversations"))


OP12_SQL = r"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([CAST(i AS BIGINT)], range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)))) AS tab),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
            encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')) AS k FROM conversations),
kinds AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(octet_length(k)), lambda i: CAST(ord(decode(k)[i + 1]) AS BIGINT))),
            lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind FROM keyed, crc),
rows AS (SELECT row_number() OVER () AS uid, conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
           CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
         FROM kinds, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS c(copy) WHERE kind != 0),
placed AS (SELECT *, row_number() OVER w AS pos, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, uid) > 1 AS dup,
             left(role, 1) AS ini, lead(left(role, 1)) OVER w AS next_ini, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare,
             count(*) OVER (PARTITION BY conv_id) AS n
           FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), uid)),
f AS (SELECT *, CASE WHEN bare = '' THEN 'b' WHEN dup THEN 'd' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '-' END AS fault FROM placed),
ins AS (SELECT * FROM (VALUES (0), (1), (2)) AS t(k)),
edits AS (SELECT * FROM (VALUES ('K'), ('R'), ('D')) AS t(e)),
walk AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS pos, 0 AS st, CAST(0 AS BIGINT) AS cost, '' AS audit, '' AS lines FROM f GROUP BY conv_id
  UNION ALL
  SELECT conv_id, pos, st, cost, audit, lines FROM (
    SELECT m.conv_id, m.pos, CASE e WHEN 'D' THEN mid WHEN 'R' THEN CASE mid WHEN 2 THEN 3 ELSE 2 END ELSE CASE ini WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END END AS st,
      m.cost + 2 * k + CASE e WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END + CASE WHEN e != 'D' AND fault = 't' THEN 1 ELSE 0 END AS cost,
      m.audit || repeat('I', k) || e AS audit,
      m.lines || inserted || CASE e WHEN 'D' THEN '' WHEN 'R' THEN CASE mid WHEN 2 THEN 'assistant' ELSE 'user' END || ':' || text || chr(10) ELSE role || ':' || text || chr(10) END AS lines
    FROM (SELECT walk.conv_id, f.pos, walk.cost, walk.audit, walk.lines, k, f.ini, f.fault, f.role, f.text,
            CASE k WHEN 0 THEN st WHEN 1 THEN CASE st WHEN 2 THEN 3 ELSE 2 END ELSE CASE st WHEN 2 THEN 2 ELSE 3 END END AS mid,
            CASE k WHEN 0 THEN '' WHEN 1 THEN CASE st WHEN 2 THEN 'assistant:' ELSE 'user:' END || chr(10) ELSE CASE st WHEN 2 THEN 'assistant:' || chr(10) || 'user:' ELSE 'user:' || chr(10) || 'assistant:' END || chr(10) END AS inserted
          FROM walk JOIN f ON f.conv_id IS NOT DISTINCT FROM walk.conv_id AND f.pos = walk.pos + 1, ins) AS m, edits
    WHERE e = 'D' OR (fault NOT IN ('b', 'd') AND (e = 'R' OR (ini = 's' AND mid = 0) OR (ini = 'u' AND mid != 2) OR (ini = 'a' AND mid = 2))))
  QUALIFY row_number() OVER (PARTITION BY conv_id, st ORDER BY cost, audit) = 1),
ends AS (SELECT conv_id, walk.cost + 2 * k AS cost, walk.audit || repeat('I', k) AS audit,
           lines || CASE k WHEN 0 THEN '' WHEN 1 THEN 'assistant:' || chr(10) ELSE 'user:' || chr(10) || 'assistant:' || chr(10) END AS lines
         FROM walk JOIN (SELECT conv_id AS c, max(pos) AS last FROM f GROUP BY conv_id) ON walk.conv_id IS NOT DISTINCT FROM c AND pos = last, ins
         WHERE (k = 0 AND st IN (0, 3)) OR (k = 1 AND st = 2) OR (k = 2 AND st IN (0, 1, 3))
         QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY walk.cost + 2 * k, walk.audit || repeat('I', k)) = 1),
sums AS (SELECT conv_id, CASE WHEN count(turn) = 0 THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps, count(*) FILTER (fault = 'b') AS blank,
           count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pos < n AND ini || next_ini NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(left(lines, greatest(length(lines) - 1, 0)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS o LEFT JOIN sums ON sums.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ends ON ends.conv_id IS NOT DISTINCT FROM o.conv_id
"""
