"""Operators 11 to 13 against plain numpy and Python on small tables."""

import hashlib
import zlib
from itertools import combinations

import numpy as np
import pytest
import xxhash

from stavelake.llm import conversation_repair, simhash, whitening
from stavelake.llm.common import Scratch

rng = np.random.default_rng(3)


# Embedding whitening


def vectors_table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, n int, component string, x int").repartition(3)


def plain_whitening(kept, k):
    """{vec_id: (deviation, [whitened], [explained])} up to signs; kept: (vec_id, whole numbers)."""
    fit = np.array(sorted({tuple(x) for _, x in kept}), object)
    n, sums = len(fit), fit.sum(axis=0)
    c = (fit - sums / n).astype(float)
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    trace = (c * c).sum() / n
    return {v: (sum(int(n * a - s) ** 2 for a, s in zip(x, sums)), (np.array(x, float) - (sums / n).astype(float)) @ u / np.sqrt(e), e / trace) for v, x in kept}, n


def test_whitening_equals_eigenvectors(spark):
    scale = np.array([9, 5, 5, 3, 1, 1, 0.5, 0.2, 0.1, 0.1, 0.05, 0.05])
    good = [(i, [float(x) for x in rng.normal(size=12) * scale]) for i in range(300)]
    good += [(300 + i, good[7][1]) for i in range(40)]  # copies count once
    good += [(400, good[3][1]), (None, good[4][1])]
    bad = [(500, None), (501, good[0][1][:11] + [None]), (502, good[0][1][:11] + [float("nan")]), (503, good[0][1][:11] + [float("inf")])]
    got = whitening.whitened(vectors_table(spark, [(i, v, 1, "c", 2) for i, v in good + bad])).collect()
    kept = [(i, [int(np.floor(256 * float(np.float32(c)))) for c in v]) for i, v in good]
    want, n = plain_whitening(kept, 4)
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0, r["component"]) for r in got) == sorted((i is None, i or 0, c) for i, _ in good for c in (1, 2, 3, 4))
    for r in got:
        deviation, white, explained = want[r["vec_id"]]
        c = r["component"] - 1
        assert (r["n"], r["deviation"]) == (n, deviation)
        assert abs(r["explained"] / explained[c] - 1) < 1e-12 and r["identity_error"] < 1e-10
    for c in range(4):
        ours = np.array([r["whitened"] for r in sorted(got, key=lambda r: (r["vec_id"] is None, r["vec_id"])) if r["component"] == c + 1])
        plain = np.array([want[i][1][c] for i, _ in sorted(good, key=lambda r: (r[0] is None, r[0]))])
        assert min(abs(ours - plain).max(), abs(ours + plain).max()) < 1e-9


@pytest.mark.parametrize(
    "rows, components",
    [
        ([], set()),
        ([(1, None), (2, [float("nan")])], set()),
        ([(1, [1.0, 2.0]), (2, [1.0, 2.0])], set()),
        ([(1, []), (2, [])], set()),
        ([(1, [1.0, 0.0]), (2, [1.0]), (3, [0.0])], {1}),
        ([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0])], {1, 2}),
        ([(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 5.0])], {1}),
    ],
)
def test_whitening_edges(spark, rows, components):
    got = whitening.whitened(vectors_table(spark, [(i, v, 1, "c", 2) for i, v in rows])).collect()
    assert {r["component"] for r in got} == components
    assert len(got) == len(components) * len({i for i, v in rows if v is not None and not any(np.isnan(c) for c in v)})
    assert all(np.isfinite(r["whitened"]) and r["identity_error"] < 1e-4 for r in got)


@pytest.mark.parametrize("spectrum", [np.linspace(1, 2, 80), np.ones(40), np.r_[np.ones(6) * 5, np.ones(54)], np.r_[1e8, 1e8 - 1e-2, 1e4, 1.0, np.zeros(30)], 2.0 ** -np.arange(50)])
def test_jacobi_davidson(spectrum):
    d = len(spectrum)
    q = np.linalg.qr(rng.normal(size=(d, d)))[0]
    a = (q * spectrum) @ q.T
    a = (a + a.T) / 2
    e, u = whitening.jacobi_davidson(lambda x: a @ x, d, a.trace(), 4)
    goal = 1e-13 * np.sqrt(a.trace() * spectrum.max())
    assert np.abs(e - np.sort(spectrum)[::-1][:4]).max() < goal
    assert np.linalg.norm(a @ u - u * e, axis=0).max() < goal and np.abs(u.T @ u - np.eye(4)).max() < 1e-13


# Conversation repair


def plain_repair(rows, conv):
    """The contract's columns for one conversation, by all states at once over one row after another."""
    damaged = []
    for turn, role, text in rows:
        key = " ".join([""]) + f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        damaged += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    damaged.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).hexdigest()))
    turns = [t for t, _, _ in damaged if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    kinds, seen = [], set()
    for _, role, text in damaged:
        bare = text.strip(" \t\n\x0b\f\r")
        kinds.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [role[:1] for _, role, _ in damaged]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    step = {"u": "a", "": "u", "s": "u", "a": "u"}
    name = {"u": "user:", "a": "assistant:"}
    best = {"": (0, "", ())}

    def widened(best):
        out = dict(best)
        for _ in range(3):
            for state, (cost, audit, lines) in list(out.items()):
                to = step[state]
                new = (cost + 2, audit + "I", (*lines, name[to]))
                if to not in out or new[:2] < out[to][:2]:
                    out[to] = new
        return out

    for (_, role, text), kind in zip(damaged, kinds):
        after = {}
        for state, (cost, audit, lines) in widened(best).items():
            options = [(state, cost + 3, audit + "D", lines)]
            if kind not in ("blank", "duplicate"):
                late = kind == "truncated"
                options.append((step[state], cost + 2 + late, audit + "R", (*lines, name[step[state]] + text)))
                if role[:1] == step[state] or (role[:1], state) == ("s", ""):
                    options.append((role[:1], cost + late, audit + "K", (*lines, f"{role}:{text}")))
            for to, *new in options:
                if to not in after or tuple(new[:2]) < after[to][:2]:
                    after[to] = tuple(new)
        best = after
    cost, audit, lines = min(v for k, v in widened(best).items() if k in ("", "a"))
    count = [sum(k == x for k in kinds) for x in ("blank", "duplicate", "truncated")]
    return (gaps, *count, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def test_repair_equals_a_plain_program(spark):
    roles = ["user", "assistant", "system", "tool", "", None, "Assistant", "sage"]
    texts = ["Hello.", "Yes!", "no end", "", "  \n", "Why?\t", None, "same", "x" * 3000 + ".", "ß…"]
    rows = []
    for conv in [None, *range(70)]:
        n = 220 if conv == 5 else int(rng.integers(1, 12))
        weights = [8, 8, 3, 1, 1, 1, 1, 1] if conv is None or conv % 2 else [1] * 8
        for t in range(n):
            turn = None if rng.random() < 0.08 else int(t + (3 if rng.random() < 0.2 else 0))
            text = texts[rng.integers(len(texts))] if rng.random() < 0.5 else f"Line {rng.integers(50)} of {t}."
            row = (conv, turn, roles[rng.choice(8, p=np.array(weights) / sum(weights))], text)
            rows += [row] * (2 if rng.random() < 0.05 else 1)
    table = spark.createDataFrame([(*r, "c", 1) for r in rows], "conv_id long, turn long, role string, text string, cost string, mark int").repartition(5)
    want = {c: plain_repair([r[1:] for r in rows if r[0] == c], c) for c in {r[0] for r in rows}}
    for chunk in (7, conversation_repair.CHUNK):
        got = {r["conv_id"]: tuple(r)[1:] for r in conversation_repair.repaired(table, chunk).collect()}
        assert got == want


def test_repair_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation_repair.repaired(empty).collect() == []
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:1".encode()) % 20 == 0)
    got = conversation_repair.repaired(spark.createDataFrame([(dropped, 1, "user", "Hi.")], empty.schema)).collect()
    assert [tuple(r) for r in got] == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_grammar_keeps_the_matrices():
    letters = conversation_repair.TERMINALS
    rules = ["ua", "ĀĀ", "su", "xx", "Ua", "āu"]
    for _ in range(60):
        symbols = "".join(rng.choice(list(letters), size=int(rng.integers(1, 40)), p=[0.05, 0.3, 0.3, 0.05, 0.02, 0.05, 0.05, 0.03, 0.15]))
        assert conversation_repair.Grammar(rules).matrix(symbols) == conversation_repair.Grammar([]).matrix(symbols)


# SimHash


def plain_fingerprint(text):
    words = [w for w in (text or "").translate({ord(c): " " for c in "\t\n\x0b\f\r"}).translate({i: i + 32 for i in range(65, 91)}).split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps):
    label = list(range(len(fps)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 3:
            label[top(i)] = top(j)
    return [top(i) for i in range(len(fps))]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_golay_code_is_perfect():
    every = np.arange(1 << 23)
    index = simhash.codeword_index(every)
    assert (np.bincount(index) == 2048).all() and len(np.unique(index)) == 4096
    v = rng.integers(0, 1 << 23, 500)
    row, found = simhash.nearby(v, 23)
    near = {(r, i) for r, i in zip(row.tolist(), found.tolist())}
    assert all((k, i) in near for k, x in enumerate(v) for i in simhash.codeword_index(np.r_[x, x ^ (1 << np.arange(23))]).tolist())


@pytest.mark.parametrize("max_bucket", [0, 3, 128])
def test_links_equal_all_pairs(spark, max_bucket):
    base = [int(x) for x in rng.integers(0, 1 << 63, 30)]
    fps = {0, 1, (1 << 64) - 1, *base}
    for b in base[:12]:
        x = b
        for _ in range(25):
            flips = rng.choice(64, size=int(rng.integers(1, 7)), replace=False)
            y = x ^ sum(1 << int(f) for f in flips)
            fps.add(y)
            x = y if rng.random() < 0.3 else x
    fps = sorted(fps)
    want = plain_components(fps)
    with Scratch(spark) as scratch:
        nodes = spark.createDataFrame([(signed(f),) for f in fps], "node long").repartition(4)
        labels = {r["node"]: r["label"] for r in simhash.linked(nodes, scratch, max_bucket).collect()}
    got = [labels.get(signed(f), signed(f)) for f in fps]
    classes = lambda x: {frozenset(i for i, v in enumerate(x) if v == k) for k in set(x)}
    assert classes(got) == classes(want)


def test_simhash_of_texts(spark):
    words = [f"w{i}" for i in range(400)]
    long = " ".join(rng.choice(words, 20000))
    texts = ["", None, " \n\t", "One", "one", "Two words", "a b c", long, long.replace("w1 ", "w2 ", 3), "Été à l'eau\x0bÉ", "x" * 100000]
    for i in range(60):
        text = list(rng.choice(words, 120))
        texts.append(" ".join(text))
        text[int(rng.integers(120))] = "changed"
        texts.append("\n".join(text).upper())
    texts += texts[20:25]
    rows = [(i, t, "fr", i) for i, t in enumerate(texts)] + [(None, "Two words", "fr", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, label int").repartition(3)
    got = simhash.near_copies(docs).collect()
    fps = [plain_fingerprint(t) for _, t, _, _ in rows]
    label = plain_components(fps)
    least = {}
    for (doc, *_), k in zip(rows, label):
        least[k] = min([x for x in (doc, least.get(k)) if x is not None], default=None)
    want = sorted(((-1 if d is None else d), signed(f), least[k]) for (d, *_), f, k in zip(rows, fps, label))
    assert sorted(((-1 if r[0] is None else r[0]), r[1], r[2]) for r in got) == want
    assert any(least[k] != d for (d, *_), k in zip(rows[:-6], label) if d and d > 10)
    assert simhash.near_copies(docs.limit(0)).collect() == []
