"""Each operator against plain Python on small tables with nulls, empty texts, ties, repeated rows and clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from stavelake.llm import bpe, chat, decontamination, language_model, line_dedup, near_dedup, quality_classifier, quality_rules, sharding, tokens, url_filter
from tests.harness import compare

SEP = re.compile(r"[\x20\x09-\x0d]+")
WORDS = [f"w{i}" for i in range(400)]


def words(text):
    return [w for w in SEP.split(text or "") if w]


def prose(seed, n=60):
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[i] for i in rng.integers(0, len(WORDS), n))


BASE = prose(1, 80)
NEAR = BASE.replace(BASE.split()[40], "changed", 1)
TEXTS = [None, "", " \n\t", "one two", "one two", BASE, BASE, NEAR, prose(2), prose(3) + "\n" + prose(4), prose(3), "é" * 5 + " \\n <|im_end|> x|y", "long " * 3000]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _th long, host string, node long, keys string, n string, _row string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if i == 3 else f"s{i % 2}", len(t or ""), i, "h", i, "k", "n", "r") for i, t in enumerate(TEXTS)]
    rows.append(rows[8])  # a repeated row
    rows.append((None, prose(9), "en", "s0", 3, 1, "h", 1, "k", "n", "r"))
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("doc_id < -5")


def test_registered_queries_equal_their_sql(spark, small, con):
    import __spark_entry__ as e

    for name in [n for n in e.oracle_sql() if re.match(r"op\d+_", n)]:
        assert compare(e.queries()[name](spark, small), e.oracle_sql()[name], con) == "", name


def test_quality_rules(docs, empty):
    rows = quality_rules.verdicts(docs, least=1, share=0.0).collect()
    assert len(rows) == docs.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[0]["n_words"] == 0 and by[0]["base_failed"] and not by[1]["kept"]
    assert by[12]["n_repeat_words"] == 3000 and by[12]["base_failed"]
    # Line prose(3) stands in two texts of different hosts (9 and 10): no host has it twice.
    assert by[9]["removed_words"] == 0 and by[9]["kept"]
    kept = quality_rules.clean(docs, least=1, share=0.0)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in rows if r["kept"]}
    assert quality_rules.verdicts(empty).count() == 0 and quality_rules.clean(empty).count() == 0


def test_quality_rules_remove_frequent_lines(spark):
    shared = prose(50, 12)
    rows = [(i, prose(100 + i, 40) + "\n" + shared, "h") for i in range(5)] + [(9, shared + "\nx", "h"), (10, shared, "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    by = {r["doc_id"]: r for r in quality_rules.verdicts(docs, least=3, share=0.0).collect()}
    assert all(by[i]["removed_words"] == 12 and by[i]["kept"] for i in range(5))
    assert not by[9]["kept"] and by[10]["kept"]
    assert all(shared not in r["text"] for r in quality_rules.clean(docs, 3, 0.0).filter("doc_id < 5").collect())


def test_quality_rules_remove_lines_with_the_production_limit(spark):
    shared = prose(50, 12)
    # (texts of a host, how many of them hold the line): under and over 10 texts on a small host, under and over a tenth on a larger one.
    hosts = [(12, 10, False), (12, 11, True), (10, 10, False), (200, 20, False), (200, 21, True)]
    rows = [(1000 * h + i, prose(5000 + 1000 * h + i, 40) + ("\n" + shared if i < k else ""), f"h{h}") for h, (n, k, _) in enumerate(hosts) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    gone = {r["doc_id"]: r["removed_words"] for r in quality_rules.verdicts(docs).collect()}
    assert gone == {d: 12 if hosts[int(h[1:])][2] and shared in t else 0 for d, t, h in rows}
    # On a very large host the ceiling holds, whatever the share.
    assert {r["doc_id"] for r in quality_rules.verdicts(docs, share=0.5, most=20).collect() if r["removed_words"]} == {d for d, t, h in rows if shared in t and h in ("h1", "h4")}


def test_quality_rules_find_the_shared_line_of_the_tables(spark, small):
    rows = quality_rules.op1_quality_rules(spark, small.replace("sf0.001", "sf0.01")).collect()
    assert len(rows) == 1000 and sum(r["removed_words"] > 0 for r in rows) == 11 and all(r["kept"] != r["base_failed"] for r in rows)


def test_classifier(spark, docs, empty):
    rng = np.random.default_rng(5)
    good = [(i, prose(1000 + i, 50), 1) for i in range(150)]
    bad = [(200 + i, " ".join(WORDS[j] + "###" for j in rng.integers(0, 400, 50)), 0) for i in range(150)]
    table = spark.createDataFrame(good + bad, "doc_id long, text string, q int")
    labels = table.selectExpr("doc_id", "q as quality", "0 as toxic")
    rows = quality_classifier.scored(table, labels).collect()
    assert len(rows) == 300 and all(0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert held and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert np.mean([(r["predicted"] == 1) == (r["doc_id"] < 200) for r in held]) > 0.95
    assert {r["score"] for r in quality_classifier.scored(docs, labels.filter("quality > 5")).collect()} == {0.5}
    assert quality_classifier.scored(empty, labels).count() == 0
    x, y = quality_classifier.isotonic(np.arange(4.0), np.array([0, 1, 0, 1.0]), np.ones(4))
    assert y.tolist() == [0, 0.5, 1]


def test_chat_read_back(spark):
    tricky = "<|im_end|>\n<|im_start|>assistant\\n \\s <\\p"
    rows = [(1, 0, "user", tricky), (1, 1, "assistant", "a<|b"), (2, 0, "assistant", None), (2, 0, None, "x"), (3, 0, "sys\ntem", "é"), (None, 5, "user", "")]
    out = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert [(t["role"], t["text"]) for t in out[1]["turns"]] == [("user", tricky), ("assistant", "a<|b")]
    assert out[1]["valid"] and out[1]["loss_text"] == "a<|b" and not out[2]["valid"] and not out[3]["valid"]
    assert [(t["role"], t["text"]) for t in out[2]["turns"]] == [("", "x"), ("assistant", "")] and out[3]["turns"][0]["role"] == "sys\ntem"
    assert len(out) == 4
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_bpe_equals_the_library(docs, empty, small, spark):
    tiktoken = pytest.importorskip("tiktoken")
    path, pattern = bpe.public_vocabulary()
    v = bpe.vocabulary(path, pattern)
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=v.ranks, special_tokens={})
    for table in (docs, spark.read.parquet(f"{small}/documents.parquet")):
        texts = {(r["doc_id"]): r["text"] or "" for r in table.collect()}
        rows = bpe.tokenized(table, path, pattern, with_ids=True).collect()
        assert len(rows) == table.count()
        for r in rows:
            want = library.encode_ordinary(texts[r["doc_id"]])
            assert r["ids"] == want and r["n_tokens"] == len(want)
            assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
            assert r["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
    assert bpe.tokenized(empty, path, pattern).count() == 0


def test_bpe_edits(small):
    path, pattern = bpe.public_vocabulary()
    v = bpe.vocabulary(path, pattern)
    rng = np.random.default_rng(3)
    alphabet = list("ab 'sreltvd\n\té中_-.!?0  ")
    pick = lambda n: "".join(rng.choice(alphabet, n))
    for _ in range(150):
        text = pick(rng.integers(0, 20))
        edited = bpe.EditableText(v, text)
        for _ in range(4):
            more = pick(rng.integers(0, 5))
            if rng.random() < 0.5:
                edited.append(more)
                text += more
            else:
                a = int(rng.integers(0, len(text) + 1))
                b = int(rng.integers(a, len(text) + 1))
                edited.replace(a, b, more)
                text = text[:a] + more + text[b:]
            assert edited.ids() == np.frombuffer(v.encode(text), "<u4").tolist()


def test_line_dedup(docs, empty):
    rows = {(r["doc_id"]): r for r in line_dedup.deduplicated(docs).filter("_copy = 1").collect()}
    assert rows[5]["_kept"] == 1 and rows[6]["_kept"] == 0 and rows[7]["_kept"] == 0  # a copy, and one word changed
    assert rows[4]["_clean"] == "" and rows[3]["_clean"] == "one two"
    assert rows[10]["_kept"] == 0 and rows[9]["_kept"] == 2 and rows[0]["_clean"] is None and rows[2]["_clean"] == " \n\t"
    out = line_dedup.without_repeated_lines(docs)
    assert out.columns == docs.columns
    ids = sorted((r["doc_id"] for r in out.collect()), key=lambda x: -1 if x is None else x)
    assert ids == [None, 0, 1, 2, 3, 5, 8, 9, 11, 12]
    assert line_dedup.without_repeated_lines(empty).count() == 0


def word_edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_line_dedup_equals_all_pairs(spark):
    rng = np.random.default_rng(11)
    lines = []
    for i in range(12):
        base = prose(300 + i, int(rng.integers(3, 14))).split()
        for _ in range(6):
            line = list(base)
            for _ in range(rng.integers(0, 3)):
                at = int(rng.integers(0, len(line)))
                line[at : at + int(rng.integers(0, 2))] = list(rng.choice(WORDS, int(rng.integers(0, 2))))
            lines.append(" ".join(line))
    order = rng.permutation(len(lines))
    docs = spark.createDataFrame([(int(i), lines[j]) for i, j in enumerate(order)], "doc_id long, text string")
    got = {r["doc_id"] for r in line_dedup.without_repeated_lines(docs).collect()}
    seen, want = [], set()
    for i, j in enumerate(order):
        w = lines[j].split()
        near = lambda v: v == w or (len(v) >= 5 and len(w) >= 5 and word_edit(v, w) <= 1)
        if not w or not any(near(v) for v in seen):
            want.add(i)
        seen.append(w)
    assert got == want


def test_line_dedup_compares_words(spark):
    thue = [bin(i).count("1") % 2 for i in range(2048)]
    rows = [(1, " ".join("ab"[x] for x in thue)), (2, " ".join("ba"[x] for x in thue)), (3, " ".join("ab"[x] for x in thue[:-1]) + " c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in line_dedup.without_repeated_lines(docs).collect()) == [1, 2]
    within = line_dedup.within_one_edit
    assert within(["a"], ["b"]) and within(["a", "b"], ["a"]) and within([], ["a"]) and within(["a"], ["a"])
    assert not within(["a", "b"], ["b", "a"]) and not within(["a", "b", "c"], ["a"]) and not within(["a", "b"], ["c", "d", "a"])


def test_sharding(docs, empty, spark, small):
    out = sharding.with_slots(sharding.shard_by_bytes(docs, shards=4)).collect()
    assert len(out) == docs.count() and all(0 <= r["shard"] < 4 for r in out)
    groups = defaultdict(set)
    for r in out:
        groups[r["text_crc32"], r["size"]].add(r["shard"])
    assert all(len(s) == 1 for s in groups.values())
    assert sharding.shard_by_bytes(empty, shards=4).count() == 0
    rows = sharding.op6_sharding(spark, small).collect()
    size, slots = Counter(), defaultdict(list)
    for r in rows:
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert len(size) == 24 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean, largest = sum(size.values()) / 24, max(r["size"] for r in rows)
    assert all(abs(s - mean) <= largest for s in size.values())
    by_target = sharding.shard_by_bytes(spark.read.parquet(f"{small}/documents.parquet"), target_bytes=100_000)
    assert by_target.select("shard").distinct().count() == round(sum(size.values()) / 100_000)


def test_url_rules_and_graph(spark):
    urls = ["http://A.example.com/fr/1?x", "https://b.example.org/es/2", "https://b.example.org/en/1", "https://c.org/x#y", "http://net.example.net/en/", None, "no url", "http://d.example.com/de/3", "http://d.example.com/en/3"]
    link = '<a href="http://d.example.com/de/9">x</a>'
    rows = [(i, u, link if i == 4 else None) for i, u in enumerate(urls)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in url_filter.judged_pages(pages).collect()}
    assert [got[i]["rule"] for i in range(9)] == ["com/fr/", "example.org/es/", "example.org/en/1", "org/", None, None, None, "com/de/", None]
    assert got[0]["host"] == "a.example.com" and got[0]["path"] == "/fr/1" and got[5]["host"] == "" and got[6]["path"] == ""
    assert [got[i]["verdict"] for i in range(9)] == ["allow", "block", "block", "allow", "block", "allow", "allow", "block", "block"]
    assert got[4]["distrust"] > 0  # it links to a blocked host
    assert url_filter.judged_pages(pages.filter("page_id > 99")).count() == 0


def test_pagerank_equals_plain_iteration(spark):
    pairs = [("a", "b", 1.0), ("a", "c", 3.0), ("b", "c", 1.0), ("c", "a", 1.0), ("c", "d", 1.0)]
    edges = spark.createDataFrame(pairs, "src string, dst string, weight double")
    seeds = spark.createDataFrame([("a", 0.5), ("z", 0.5)], "host string, seed double")
    got = {r["host"]: r["rank"] for r in url_filter.personalised_pagerank(edges, seeds, tolerance=1e-5).collect()}
    out = defaultdict(float)
    for s, _, w in pairs:
        out[s] += w
    seed, rank = {"a": 0.5, "z": 0.5}, {"a": 0.5, "z": 0.5}
    for _ in range(500):
        moved = defaultdict(float)
        for s, d, w in pairs:
            moved[d] += rank.get(s, 0) * w / out[s]
        sent = sum(moved.values())
        rank = {h: seed.get(h, 0) * (1 - 0.85 * sent) + 0.85 * moved[h] for h in {*seed, *moved}}
    assert got.keys() == rank.keys() and all(math.isclose(got[h], rank[h], abs_tol=1e-4) for h in rank) and math.isclose(sum(got.values()), 1)


def test_language_model(docs, empty, small, spark):
    table = docs.unionByName(spark.read.parquet(f"{small}/documents.parquet").withColumn("doc_id", language_model.F.col("doc_id") + 1000), allowMissingColumns=True)
    rows = language_model.scored(table, language_model.training_split(language_model.F.col("doc_id"))).collect()
    assert len(rows) == table.count() and len({(r["doc_id"], round(r["score"], 6)) for r in rows}) == len({r["doc_id"] for r in rows})
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    fold = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    texts = {r["doc_id"]: words((r["text"] or "").translate(fold)) + [None] for r in table.collect()}
    trained = [t for d, t in ((r["doc_id"], texts[r["doc_id"]]) for r in rows if not r["held_out"])]
    c = Counter(w for t in trained for w in t)
    n, v = sum(c.values()), len(c)
    for r in rows:
        t = texts[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(w in c for w in t), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), rel_tol=1e-9)
    assert language_model.scored(empty, language_model.training_split(language_model.F.col("doc_id"))).count() == 0


def katz(trained, text):
    """Plain Katz over all words: the score of a text (its end as None) after the trained texts."""
    c, pairs, after = Counter(w for t in trained for w in t), Counter(), defaultdict(dict)
    for t in trained:
        pairs.update(zip(["<s>", *t], t))
    for (h, w), n in pairs.items():
        after[h][w] = n
    of = lambda counts: language_model.discounts({r: k for r, k in Counter(counts.values()).items() if r <= language_model.K + 1})
    kept = lambda n, d: n * (1.0 if n > language_model.K else d[n])
    kept_pair = lambda n: n - language_model.TAIL if n > language_model.K else n * d2[n]
    total, d1, d2 = sum(c.values()), of(c), of(pairs)
    p = {w: kept(n, d1) / total for w, n in c.items()}
    unseen = 1 - sum(p.values())
    assert unseen > 0
    score = 0.0
    for h, w in zip(["<s>", *text], text):
        seen = after.get(h, {})
        if not seen:
            score += math.log10(p.get(w, unseen))
            continue
        n = sum(seen.values())
        free = 1 - sum(map(kept_pair, seen.values())) / n
        weight = free / (1 - sum(p[x] for x in seen))
        # Each context's probabilities add up to one over the vocabulary and the unseen word.
        assert math.isclose(sum(kept_pair(x) / n for x in seen.values()) + weight * (unseen + sum(q for x, q in p.items() if x not in seen)), 1)
        score += math.log10(kept_pair(seen[w]) / n if w in seen else weight * p.get(w, unseen))
    return score


def test_language_model_equals_plain_katz_over_all_words(spark):
    train = language_model.F.col("doc_id") < 80
    texts = [prose(700 + i, 50) for i in range(100)]
    for i in range(0, 80, 20):
        texts[i] += " seldom together"  # four times: under every threshold, yet a pair of its own
    texts[90], texts[91] = "seldom together", "together seldom"
    for i in range(3, 40):
        texts[i] += " ever after"  # a context with one successor
    texts[92] = "ever before " + texts[92]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["score"] for r in language_model.scored(table, train).collect()}
    trained = [[*words(t), None] for t in texts[:80]]
    for i, t in enumerate(texts):
        assert math.isclose(got[i], katz(trained, [*words(t), None]), rel_tol=1e-9), i
    assert got[90] - got[91] > 2


def test_language_model_bounds_the_part_of_a_word_that_training_lacks(spark):
    col = language_model.F.col
    texts = [prose(1700 + i, 60) for i in range(120)] + ["strange " * 400 for _ in range(60)] + ["strange " + prose(1900 + i, 20) + " strange strange" for i in range(20)]
    keyed = spark.createDataFrame([(i, i < 100, t) for i, t in enumerate(texts)], "doc long, training boolean, text string").repartition(4)
    with language_model.Scratch(spark) as scratch:
        m = language_model.learned(keyed, scratch)
    shared = spark.sparkContext.broadcast(m.known)
    parts = [r["n"] for turn in range(language_model.ROUNDS) for r in language_model.packs(keyed, shared, 16, turn).filter("not own").groupBy("part").agg(language_model.F.sum("n").alias("n")).collect()]
    assert len(parts) == 16 and max(parts) < 3 * sorted(parts)[8]
    got = {r["doc_id"]: r["score"] for r in language_model.scored(keyed.select(col("doc").alias("doc_id"), "text"), col("doc_id") < 100).collect()}
    trained = [[*words(t), None] for t in texts[:100]]
    assert all(math.isclose(got[i], katz(trained, [*words(t), None]), rel_tol=1e-9) for i, t in enumerate(texts))


def test_language_model_contexts_add_up_to_one(spark, small):
    col = language_model.F.col
    docs = spark.read.parquet(f"{small}/documents.parquet").select(col("doc_id").alias("doc"), (col("doc_id") % 10 != 0).alias("training"), "text")
    with language_model.Scratch(spark) as scratch:
        m = language_model.learned(docs, scratch, with_pairs=True)
        uni, f = m.known.uni, m.known.frequent
        pairs = {(r["key"], r["doc"]): r["total"] for r in m.parts.filter("kind = 3").collect()}
        pairs |= {tuple(map(int, divmod(c, f.start + 1))): int(n) for c, n in zip(m.known.pair_codes, m.known.pair_counts) if n}
        weights = {r["key"]: 10 ** r["weight"] for r in language_model.backoff_weights(m.contexts, m.discount, uni).collect()}
    count, after = Counter(), defaultdict(dict)
    for (h, x), n in pairs.items():
        count[x] += n
        after[h][x] = n
    assert sum(count.values()) == uni.total and len(count) == uni.distinct and weights.keys() == after.keys()
    p = dict(zip(count, uni.probabilities(np.array(list(count.values()))).tolist()))
    assert math.isclose(sum(p.values()) + uni.unseen, 1)
    for h, seen in list(after.items())[:500]:
        kept = sum(n - language_model.TAIL if n > language_model.K else n * m.discount[n] for n in seen.values()) / sum(seen.values())
        assert math.isclose(kept + weights[h] * (1 - sum(p[x] for x in seen)), 1, rel_tol=1e-9)


def test_language_model_tells_texts_of_one_id_apart(spark):
    table = spark.createDataFrame([(1, "a b c d e f"), (1, "z"), (2, "a b"), (2, "a b"), (10, None)], "doc_id long, text string")
    rows = language_model.scored(table, language_model.training_split(language_model.F.col("doc_id"))).collect()
    assert sorted((r["doc_id"], r["n_tokens"]) for r in rows) == [(1, 2), (1, 7), (2, 3), (2, 3), (10, 1)]
    assert len({r["score"] for r in rows if r["doc_id"] == 2}) == 1 and all(math.isfinite(r["score"]) for r in rows)


def test_good_turing_discounts():
    d = language_model.discounts({1: 1000, 2: 400, 3: 200, 4: 120, 5: 80, 6: 55})
    assert all(0 < x < 1 for x in d[1:])
    assert language_model.discounts({1: 3})[1] == 0.5


def shingle_set(text, k=5):
    w = words(text)
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def test_near_dedup_equals_all_pairs(spark, docs, empty):
    rng = np.random.default_rng(2)
    rows = []
    for g in range(6):
        base = prose(500 + g, 90).split()
        for _ in range(int(rng.integers(1, 12))):
            w = list(base)
            for _ in range(int(rng.integers(0, 5))):
                w[int(rng.integers(0, len(w)))] = str(rng.choice(WORDS))
            rows.append((len(rows), " ".join(w)))
    rows += [(100 + i, t) for i, t in enumerate(["", None, "a b", "a b", "a b c d e"])]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {d: shingle_set(t) for d, t in rows}
    label = {d: d for d in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(table).collect()}
    assert got == {d: find(d) for d in sets}
    kept = sorted(r["doc_id"] for r in near_dedup.one_of_each(table).collect())
    assert kept == sorted({*got.values()})
    out = near_dedup.one_of_each(docs)
    assert out.columns == docs.columns and Counter(r["doc_id"] for r in out.collect())[8] == 1
    assert near_dedup.classes(empty).count() == 0


def test_near_dedup_links_texts_with_repeated_passages(spark):
    rows = []
    for g, times in enumerate([5, 10, 50] * 8):
        base = prose(900 + g, 400)
        # Each text repeats a passage of its own, so nearly all of the differing shingles are frequent in their text.
        rows += [(2 * g + k, base + (" " + prose(1000 + 2 * g + k, 40)) * times) for k in (0, 1)]
    sets = {d: shingle_set(t) for d, t in rows}
    for g in range(24):
        a, b = sets[2 * g], sets[2 * g + 1]
        assert len(a & b) >= 0.8 * len(a | b)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: d // 2 * 2 for d in sets}


def test_probminhash_estimates_probability_jaccard():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 2**63, 300).astype(np.uint64)
    b = a.copy()
    b[:60] = rng.integers(0, 2**63, 60).astype(np.uint64)
    row = np.repeat([0, 1], 300)
    kept = near_dedup.probminhash(row, np.concatenate([a, b]), np.ones(600), 2, 2000)
    assert abs(np.mean(kept[0] == kept[1]) - 240 / 360) < 0.05


def test_decontamination(spark, docs, empty):
    items = [(1, prose(2)), (2, "one TWO"), (3, None), (4, "!!"), (5, prose(2))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    report = {r["doc_id"]: r for r in decontamination.contamination_report(docs, benchmark).collect()}
    assert report[8]["n_hit"] == report[8]["n_words"] == 60 and report[8]["n_items"] == 2
    assert report[8]["items_sha256"] == hashlib.sha256(b"1,5").hexdigest() and report[3]["n_hit"] == 2 and report[0]["n_words"] == 0
    assert not report[5]["contaminated"]
    clean = decontamination.decontaminate(docs, benchmark)
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == {None, 0, 1, 2, 5, 6, 7, 9, 10, 11, 12}
    mixed = spark.createDataFrame([(1, "Before it, " + prose(2) + "; after it."), (2, "...")], "doc_id long, text string")
    cut = {r["doc_id"]: r["text"] for r in decontamination.decontaminate(mixed, benchmark, remove="spans").collect()}
    assert cut == {1: "Before it, after it.", 2: "..."}
    assert decontamination.decontaminate(docs, benchmark.filter("item_id > 99")).count() == docs.count()
    assert decontamination.contamination_report(empty, benchmark).count() == 0


def test_decontamination_without_broadcast(docs, spark, monkeypatch):
    benchmark = spark.createDataFrame([(1, prose(2))], "item_id long, text string")
    want = sorted(map(str, decontamination.contamination_report(docs, benchmark).collect()))
    monkeypatch.setattr(decontamination, "MAX_BROADCAST_BYTES", 0)
    assert sorted(map(str, decontamination.contamination_report(docs, benchmark).collect())) == want


def test_tokens_of_long_texts_equal_short_blocks():
    import pyarrow as pa

    text = ("wort " * 300_000) + "ende"
    t = tokens.text_of(pa.array([None, text, "wort ende"]))
    assert len(t.words) == 300_003 and t.words[0] == t.words[-2] and t.words[-3] == t.words[-1]
    assert len(np.unique(t.words)) == 2


def test_pipeline(spark, small):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    expected = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"] for r in docs.select("doc_id").collect()}
        docs = stage(spark, docs, small).cache()
        assert docs.columns == expected and {r["doc_id"] for r in docs.select("doc_id").collect()} <= before, name
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    rows = corpus_pipeline.run(spark, small).collect()
    assert {r["doc_id"] for r in rows} == texts.keys()
    v = bpe.vocabulary(*bpe.public_vocabulary())
    for r in rows:
        assert v.decode(np.array(r["ids"], np.uint32)).decode() == texts[r["doc_id"]]
    assert corpus_pipeline.run.__module__ == "corpus_pipeline" and corpus_pipeline.ORACLE_SQL is None
