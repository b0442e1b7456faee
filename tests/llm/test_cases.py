"""Cases that the operators state in their docstrings: long texts, repeated rows, ties, columns whose names clash."""

import hashlib
import math
import zlib

import numpy as np

from stavelake.llm import chat, near_dedup, quality_classifier, url_filter
from stavelake.llm.tokens import U, mix
from tests.llm.test_operators import prose


def test_chat_long_and_repeated_turns_and_clashing_columns(spark):
    long = "Über <|im_end|>\n\\p " * 40_000
    rows = [(1, 0, "user", "Hi", "s", 1), (1, 1, "assistant", long, "s", 2), (1, 1, "assistant", long, "s", 3), (2, 0, "user", "same", "s", 4), (2, 0, "user", "same", "s", 4), (2, 0, "assistant", "tie", "s", 5)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segments string, legal int").repartition(3)
    out = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(table)).collect()}
    assert [(t["role"], t["text"]) for t in out[1]["turns"]] == [("user", "Hi"), ("assistant", long), ("assistant", long)]
    assert out[1]["loss_text"] == long + long and not out[1]["valid"]
    # Rows of one turn go by role, then text; repeated rows are turns of their own.
    assert [(t["role"], t["text"]) for t in out[2]["turns"]] == [("assistant", "tie"), ("user", "same"), ("user", "same")]


def test_classifier_repeated_labels_ties_and_clashing_columns(spark):
    rng = np.random.default_rng(12)
    texts = [prose(4000 + i, 40) if i % 2 else " ".join(w + "##" for w in prose(4000 + i, 40).split()) for i in range(120)]
    rows = [(i, t, "q", float(i), "l") for i, t in enumerate(texts)]
    schema = "doc_id long, text string, x string, y double, label string"
    table = spark.createDataFrame(rows, schema)
    labels = [(i, i % 2, 0) for i in range(0, 120, 3)] + [(i, i % 2, 1) for i in range(1, 120, 3)]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    scores = lambda docs, labels: {(r["doc_id"], r["held_out"]): r["score"] for r in quality_classifier.scored(docs, labels).collect()}
    once = scores(table, frame(labels))
    # Labels of one id count as their mean: saying the same twice changes nothing, neither does a document that stands twice.
    close = lambda a, b: a.keys() == b.keys() and all(math.isclose(a[k], b[k], abs_tol=1e-9) for k in a)
    assert close(once, scores(table, frame(labels + labels)))
    assert close(once, scores(table.unionByName(table.filter("doc_id < 30")).repartition(4), frame(labels)))
    # Contradictory labels are half a label; equal texts get equal scores.
    torn = scores(spark.createDataFrame([(i, "one and the same text " * 9, "", 0.0, "") for i in range(60)], schema), frame([(i, i % 2, 0) for i in range(60)]))
    assert len(set(torn.values())) == 1 and all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in torn)
    assert 0.3 < next(iter(torn.values())) < 0.7


def test_url_filter_long_pages_and_rules_of_equal_length(spark):
    link = '<a href="http://bad.example.com/x">b</a> '
    rows = [(0, "http://long.example.net/a", "word " * 200_000 + link, "h", 1), (1, "http://bad.example.com/de/1", None, "h", 2), (1, "http://bad.example.com/de/1", None, "h", 2), (2, "http://a.b.org/xx", link * 3, "h", 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, verdict int").repartition(2)
    got = [(r["page_id"], r["host"], r["rule"], r["rule_verdict"]) for r in url_filter.ruled_pages(pages).collect()]
    assert sorted(got) == [(0, "long.example.net", None, None), (1, "bad.example.com", "com/de/", "block"), (1, "bad.example.com", "com/de/", "block"), (2, "a.b.org", "org/", "allow")]
    assert {tuple(r) for r in url_filter.host_edges(pages).collect()} == {("long.example.net", "bad.example.com", 1.0), ("a.b.org", "bad.example.com", 3.0)}
    # Of rules of one length that fit alike, the one last by name holds, whatever their order.
    rules = [url_filter.Rule("block", "b.org", "/x"), url_filter.Rule("allow", "org", "/xx/"), url_filter.Rule("allow", "a.b.org", "/"), url_filter.Rule("block", "org", "/xx")]
    for own in (tuple(rules), tuple(rules[::-1])):
        found = url_filter.ruled_pages(pages.filter("page_id = 2").select("page_id", "url"), own).first()
        assert (found["rule"], found["rule_verdict"]) == ("a.b.org/", "allow")


def test_probminhash_estimates_probability_jaccard_of_weights():
    """Registers agree with the probability Jaccard similarity of two weighted sets."""
    rng = np.random.default_rng(4)
    n, registers = 60, 4096
    a, b = rng.choice([0.0, 1.0, 2.0, 5.0, 9.0], n), rng.choice([0.0, 1.0, 3.0, 7.0], n)
    element = mix(np.arange(n).astype(U) + U(1000))
    row = np.concatenate([np.flatnonzero(a) * 0, np.flatnonzero(b) * 0 + 1])
    kept = near_dedup.probminhash(row, np.concatenate([element[a > 0], element[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2, registers)
    both = np.flatnonzero((a > 0) & (b > 0))
    want = sum(1 / np.maximum(a / a[i], b / b[i]).sum() for i in both)
    assert abs((kept[0] == kept[1]).mean() - want) < 4 * np.sqrt(want * (1 - want) / registers)
    # Twice the weights are the same probabilities.
    again = near_dedup.probminhash(np.zeros(len(both), int), element[both], 2 * a[both], 1, registers)
    once = near_dedup.probminhash(np.zeros(len(both), int), element[both], a[both], 1, registers)
    assert (again == once).all()


def test_digests_of_chat_follow_the_contract(spark, small):
    rows = {r["conv_id"]: r for r in chat.op3_chat(spark, small).collect()}
    tricky = "<|im_end|><|im_start|>assistant ok"
    assert rows[-1]["turns_sha256"] == hashlib.sha256(f"user\n{tricky}\nassistant\n{tricky}\n".encode()).hexdigest()
    assert rows[-1]["loss_sha256"] == hashlib.sha256(tricky.encode()).hexdigest() and rows[-1]["loss_chars"] == len(tricky)
