"""Whole queries and the pipeline against plain Python on small tables."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from stavelake.llm import bpe, quality_classifier, sharding, tokens, url_filter
from tests.llm.test_operators import BASE, NEAR, WORDS, prose, shingle_set, word_edit, words


def plain_isotonic(y, n):
    """The best ascending fit, by its min-max formula."""
    mean = lambda a, b: np.dot(y[a : b + 1], n[a : b + 1]) / n[a : b + 1].sum()
    return np.array([max(min(mean(a, b) for b in range(i, len(y))) for a in range(i + 1)) for i in range(len(y))])


def test_classifier_equals_plain_algebra(spark):
    rng = np.random.default_rng(8)
    noise = lambda t, i: t if i % 3 else " ".join(w + "##" * (rng.random() < 0.7) for w in t.split())
    texts = [noise(prose(3000 + i, int(rng.integers(5, 60))), i) for i in range(240)] + ["", None]
    rows = list(enumerate(texts))
    label = {i: int(i % 3 > 0) if rng.random() < 0.9 else int(i % 3 == 0) for i in range(0, 240) if i % 4}
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, y in label.items()] + [(5, None), (None, 1)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality_classifier.scored(table, labels).collect()}
    held = {r[0]: r[1] for r in spark.range(242).selectExpr("id", "crc32(cast(cast(id as string) as binary)) % 3 = 1").collect()}
    fold = {r[0]: r[1] for r in spark.range(242).selectExpr("id", "pmod(xxhash64(id), 2)").collect()}

    c = quality_classifier.CONFIG
    x = quality_classifier.statistics(tokens.text_of(pa.array(texts)))
    train = np.array([i for i in label if not held[i]])
    y = np.array([label[i] for i in train], float)
    generator = np.random.default_rng(c.seed)
    d = x.shape[1]
    w, phase = generator.normal(size=(d, c.features)) / (c.bandwidth * np.sqrt(d)), generator.uniform(0, 2 * np.pi, c.features)
    z = np.clip((x - x[train].mean(axis=0)) / np.maximum(x[train].std(axis=0), 1e-6), -8, 8)
    z = np.column_stack([np.cos(z @ w + phase) * np.sqrt(2 / c.features), z, np.ones(len(z))])
    penalty = c.ridge * np.diag([1.0] * (z.shape[1] - 1) + [1e-9])
    fit = lambda rows, goal: np.linalg.solve(z[rows].T @ z[rows] + penalty, z[rows].T @ goal)
    side = np.array([fold[i] for i in train])
    models = {k: fit(train[side != k], y[side != k]) for k in (0, 1)}
    raw = np.array([z[i] @ models[k] for i, k in zip(train, side)])
    place = np.floor(np.clip((raw + 0.5) * c.bins / 2, 0, c.bins - 1))
    bins = np.unique(place)
    n = np.array([(place == b).sum() for b in bins], float)
    means = [np.array([v[place == b].mean() for b in bins]) for v in (raw, y)]
    level = plain_isotonic(means[1], n)
    blocks = [np.flatnonzero(np.isclose(level, v, atol=1e-12)) for v in sorted({round(v, 12) for v in level})]
    xs, ys = [np.average(means[0][b], weights=n[b]) for b in blocks], [level[b[0]] for b in blocks]
    want = np.clip(np.interp(z @ fit(train, y), xs, ys), 0, 1)
    assert len(got) == 242 and all(got[i]["held_out"] == held[i] for i in range(242))
    assert max(abs(got[i]["score"] - want[i]) for i in range(242)) < 1e-5
    assert all(r["predicted"] == int(r["score"] >= 0.5) for r in got.values())


def test_sharding_equals_a_plain_tree(spark, small, monkeypatch):
    monkeypatch.setattr(sharding, "TOLERANCE", 0)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    dims = sharding.text_dimensions()
    points = [(r["doc_id"], r["size"], tuple(r[d] for d in dims)) for r in sharding.measured(docs, dims).collect()]
    high = lambda v: v >> sharding.TIE_BITS
    spread = lambda own, d: high(max(p[2][d] for p in own)) - high(min(p[2][d] for p in own))
    full = [max(1, spread(points, d)) for d in range(len(dims))]
    want = {}

    def split(own, first, k):
        if k == 1 or len({p[2] for p in own}) < 2:
            want.update({p[0]: first for p in own})
            return
        d = max(range(len(dims)), key=lambda i: (spread(own, i) / full[i], -i))
        weight, goal, under = sum(p[1] for p in own), sum(p[1] for p in own) * (k // 2) / k, 0
        for cut in sorted({p[2][d] for p in own}):
            over = under + sum(p[1] for p in own if p[2][d] == cut)
            if over >= goal:
                break
            under = over
        before = (goal - under < over - goal and under > 0) or over >= weight
        left = [p for p in own if (p[2][d] < cut if before else p[2][d] <= cut)]
        kept = {p[0] for p in left}
        k_left = min(k - 1, max(1, round(k * (under if before else over) / weight)))
        split(left, first, k_left)
        split([p for p in own if p[0] not in kept], first + k_left, k - k_left)

    split(points, 0, 7)
    got = {r["doc_id"]: r["shard"] for r in sharding.shard_by_bytes(docs, shards=7).collect()}
    assert got == want and len(set(got.values())) == 7


def plain_judgement(pages):
    """{page_id: (host, path, rule, verdict)} by the rules and by ranks iterated until nothing moves."""
    fold = lambda s: s.translate(str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)}))

    def split(url):
        if not url or "://" not in url:
            return "", ""
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        return fold(host), re.match(r"[^?#]*", rest[len(host) :])[0]

    out, edges, seeds = {}, defaultdict(float), {"allow": defaultdict(float), "block": defaultdict(float)}
    for page, url, html in pages:
        host, path = split(url)
        fits = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        rule = max(fits, key=lambda r: len(r.host + r.path), default=None)
        out[page] = [host, path, rule and rule.host + rule.path, rule and rule.verdict]
        if rule:
            seeds[rule.verdict][host] += 1
        for link in re.findall(r'href="(http[^"]+)"', html or ""):
            to = split(link)[0]
            if to and host and to != host:
                edges[host, to] += 1

    def rank(edges, seed):
        total, seed = defaultdict(float), {h: v / sum(seed.values()) for h, v in seed.items()}
        for (a, _), v in edges.items():
            total[a] += v
        r = dict(seed)
        for _ in range(400):
            moved = defaultdict(float)
            for (a, b), v in edges.items():
                moved[b] += r.get(a, 0) * v / total[a]
            sent = sum(moved.values())
            r = {h: seed.get(h, 0) * (1 - 0.85 * sent) + 0.85 * moved[h] for h in {*seed, *moved}}
        return r

    trust, distrust = rank(edges, seeds["allow"]), rank({(b, a): v for (a, b), v in edges.items()}, seeds["block"])
    for x in out.values():
        x[3] = x[3] or ("block" if distrust.get(x[0], 0) > trust.get(x[0], 0) else "allow")
    return {k: tuple(x) for k, x in out.items()}


def test_url_filter_equals_plain_ranks(spark):
    rng = np.random.default_rng(6)
    hosts = [f"h{i}.{'net com org'.split()[i % 3]}" for i in range(12)] + ["a.example.org", "d.example.com"]
    link = lambda h: f'<a href="http://{h}/x">x</a>'
    urls = [f"http://{h}/{p}" for h in hosts for p in ("fr/1", "de/2", "es/3", "en/1x")] + [None, "", "no", "x://", "http://ORG/?q", "http://u.org#f"]
    rows = [(i, u, "".join(link(hosts[j]) for j in rng.integers(0, len(hosts), 2)) if i % 5 == 0 else None) for i, u in enumerate(urls)]
    # A chain of hosts of which only the last links to a blocked one.
    rows += [(1000 + i, f"http://far{i}.net/", link("d.example.com" if i == 0 else f"far{i - 1}.net")) for i in range(14)]
    rows += [(2000, "http://alone.net/", None), (2000, "http://alone.net/", None)]
    pages = spark.createDataFrame([(*r, "own", "rank") for r in rows], "page_id long, url string, html string, host string, rank string").repartition(3)
    want = plain_judgement(rows)
    found = url_filter.judged_pages(pages).collect()
    assert len(found) == len(rows) and {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in found} == want
    assert all(want[1000 + i][3] == "block" for i in range(14)) and {v[3] for v in want.values()} == {"allow", "block"}


def plain_pipeline(rows, items):
    """{doc_id: text} of what the first four stages keep. rows: (doc_id, text, host)."""
    folded = lambda line: " ".join(words(line.lower()))
    texts, holds = defaultdict(set), defaultdict(set)
    for _, text, host in rows:
        texts[host].add(text)
        for line in (text or "").split("\n"):
            holds[host, folded(line)].add(text)
    docs = []
    for doc, text, host in rows:
        w = words(text)
        runs = defaultdict(list)
        for i in range(len(w) - 4):
            runs[tuple(w[i : i + 5])].append(i)
        again = {i + j for places in runs.values() if len(places) > 1 for i in places for j in range(5)}
        if len(w) >= 10 and 100 * len(again) <= 20 * len(w):
            limit = min(1000, max(10, 0.1 * len(texts[host])))
            stay = [x for x in text.split("\n") if not words(x) or len(holds[host, folded(x)]) <= limit]
            left = len(words("\n".join(stay)))
            if left == len(w) or (left >= 10 and left >= 0.3 * len(w)):
                docs.append((doc, "\n".join(stay)))
    seen, left = [], []
    for doc, text in sorted(docs):
        keep = []
        for line in text.split("\n"):
            w = words(line.lower())
            copy = w and any(v == w or (len(v) >= 5 and len(w) >= 5 and word_edit(v, w) <= 1) for v in seen)
            seen += [w] if w else []
            keep += [] if copy else [line]
        if any(words(x) for x in keep):
            left.append((doc, "\n".join(keep)))
    stay = []
    label = {d: d for d, _ in left}
    sets = {d: shingle_set(t) for d, t in left}
    for _ in left:
        for a in sets:
            for b in sets:
                if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    stay = [(d, t) for d, t in left if label[d] == d]
    plain = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t.lower())
    spans = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    windows = {s for t in items if t for s in spans(plain(t), min(10, len(plain(t)))) if s}
    return {d: t for d, t in stay if not any(spans(plain(t), n) & windows for n in {len(s) for s in windows})}


def test_pipeline_equals_plain_python(spark, tmp_path):
    import corpus_pipeline

    tiktoken = pytest.importorskip("tiktoken")
    other = " ".join("far" + w for w in BASE.split())
    texts = [None, "", " \n\t", "one two", BASE, BASE, NEAR, BASE + "\n" + prose(70, 40), prose(71, 30) + "\n\n" + prose(72, 30), prose(71, 30), "so " * 90, prose(73, 50) + " " + prose(74, 12), prose(75, 3000), other]
    # Near copies without a common line: every line of the second has two words changed.
    lines = [prose(80 + i, 40) for i in range(6)]
    changed = [" ".join("new" if j in (3, 30) and i < 2 else w for j, w in enumerate(x.split())) for i, x in enumerate(lines)]
    texts += ["\n".join(lines), "\n".join(x + "," if i >= 2 else x for i, x in enumerate(changed)) + " " + WORDS[3]]
    rows = [(d, t, None if d % 4 == 0 else "s") for d, t in enumerate(texts)]
    # A host with a line in 11 of 12 texts: it goes, and with it the text that is hardly more; it is short, so line dedup would keep each of its near copies.
    frequent = prose(60, 20)
    rows += [(100 + i, (frequent.upper() if i % 2 else frequent) + "\n" + prose(200 + i, 3 if i == 5 else 30), "b") for i in range(11)] + [(111, prose(240, 30), "b")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _th long, node long, keep string, label string"
    table = [(d, t, "en", host, len(t or ""), 1, 2, "k", "l") for d, t, host in rows]
    items = [prose(74, 12), None, "", "  ", other[:30]]
    spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(table + table[8:9], schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    want = plain_pipeline(rows, items)
    assert got.keys() == want.keys() and 14 < len(want) < 20 and 105 not in want and want[100] == prose(200, 30)
    path, pattern = bpe.public_vocabulary()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.vocabulary(path, pattern).ranks, special_tokens={})
    for d, text in want.items():
        assert got[d]["ids"] == library.encode_ordinary(text), d
        assert got[d]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").filter("doc_id < 0")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0, name
