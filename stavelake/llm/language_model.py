"""Operator 8: Katz backoff scoring.

Bigrams of all words are counted over the whole training corpus and Good-Turing discounted; what a context's discounts
free goes to the words never seen after it, by their unigram probability, with a backoff weight that makes each context's
probabilities add up to one exactly. Counts above ``K`` are taken as they are but for ``TAIL``, so every context has
something to back off with. No word is left out as a context or as a successor, however rare; all words unseen in training
share one symbol, as in the base score.

Occurrences of pairs are dealt by the pair, or by the second word where it is rare, in packs of arrays: a part holds every
occurrence of its pairs and of its rare words, in training and outside, so one shuffle counts them and scores them. Words that make
at least one in ``VOCABULARY_SHARE`` tokens of all rows and pairs of two very frequent words of at least one in ``PAIR_SHARE`` (at most
that many of each) are counted before and looked up in broadcast arrays, whether training has them or not; that changes no
score. Every part gives sums by document, sums by context (a written table of contexts: total, successors by count, their unigram mass) and
the pairs unseen in training by document and context, which are joined with the contexts' backoff weights. A token's score is split into what the pair, the
context and the word say, so nothing is sent back and forth. The parts are worked in ``ROUNDS``: each reads the texts again and needs
its share of the disk.

Parts follow the bytes of the texts. What one part holds of one key is below a share of all tokens (a 65,536th for a word, an 8,192nd for a pair with a
word that is not very frequent), which passes the part's own size from some 10^10 tokens on; packs stay large while there are fewer parts than tokens in a block.

Defined cases: a null text is empty and is scored as its end alone; without training documents every word is unseen and the
score falls back to that; rows of one doc_id with different texts are documents of their own, repeated rows get equal scores, and a
null doc_id stands for its text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stavelake.llm import tokens
from stavelake.llm.common import Scratch, table, with_text_key, written
from stavelake.llm.tokens import U, mix

VOCABULARY_SHARE = 1 << 16
#: Words of which pairs are counted before the others, and what makes such a pair frequent.
PAIR_WORD_SHARE, PAIR_SHARE = 1 << 13, 1 << 20
#: Counts up to this are discounted by Good-Turing, those above by a fixed part of one.
K, TAIL = 5, 0.1
#: Set in every word hash: as a signed number it is negative, so it is never the place of a frequent word.
TOP = U(1 << 63)
END = U(0x452821E638D01377) | TOP
TOKENS_A_BLOCK = 1_000_000
#: Bytes of text whose occurrences are one part, and in how many rounds the parts are worked.
PART_BYTES, ROUNDS = 8_000_000, 2
BIGRAM_TAG = U(0x9216D5D98979FB1B)


@dataclass(frozen=True)
class Frequent:
    """Sorted hashes and counts of the frequent words; the code of one is its place, that of any other word its hash."""

    hashes: np.ndarray
    counts: np.ndarray  # in training
    every: np.ndarray  # in all rows

    @property
    def start(self) -> int:
        """The code of the context of a first word, and the place of a word that is not frequent."""
        return len(self.hashes)

    def places(self, words: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, words), len(self.hashes) - 1)
        return np.where(self.hashes[at] == words, at, self.start)

    def pairs(self, row: np.ndarray, words: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(context, word) of every token, as codes."""
        x = np.where(places < self.start, places, words.view(np.int64))
        h = np.empty(len(x), np.int64)
        h[1:] = x[:-1]
        first = np.ones(len(x), bool)
        first[1:] = row[1:] != row[:-1]
        h[first] = self.start
        return h, x


def with_ends(t: tokens.Text) -> tuple[np.ndarray, np.ndarray]:
    """(row, word hash) of the tokens, each row closed by its end."""
    rows = len(t.row_at) - 1
    n = np.diff(t.word_at) + 1
    at_end = np.cumsum(n) - 1
    out = np.empty(n.sum(), U)
    is_word = np.ones(len(out), bool)
    is_word[at_end] = False
    out[is_word], out[at_end] = t.folded | TOP, END
    return np.repeat(np.arange(rows), n), out


def pair_keys(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    return mix(mix(h.astype(U) ^ BIGRAM_TAG) + x.astype(U) * U(0xD1342543DE82EF95))


def _blocks(docs: DataFrame, columns: tuple[str, ...], columns_of) -> DataFrame:
    """The columns, n (in training) and every (in all rows): counted in blocks before the shuffle. docs: training, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def block() -> pa.RecordBatch:
            training, *found = (np.concatenate(x) for x in zip(*held))
            _, at, key, every = np.unique(found[0] if len(found) == 1 else pair_keys(*found), return_index=True, return_inverse=True, return_counts=True)
            n = np.bincount(key, weights=training, minlength=len(at)).astype(np.int64)
            return pa.RecordBatch.from_arrays([*[pa.array(x[at].view(np.int64), pa.int64()) for x in found], pa.array(n, pa.int64()), pa.array(every, pa.int64())], names=[*columns, "n", "every"])

        for b, column in tokens.slices(batches):
            row, words = with_ends(tokens.text_of(column))
            mine, *found = columns_of(row, words)
            held.append((b.column(b.schema.get_field_index("training")).to_numpy(zero_copy_only=False)[row][mine], *found))
            size += len(held[-1][0])
            if size >= TOKENS_A_BLOCK:
                yield block()
                held, size = [], 0
        if held:
            yield block()

    return docs.select("training", "text").mapInArrow(run, ", ".join(f"{c} long" for c in (*columns, "n", "every")))


def counted_words(docs: DataFrame) -> DataFrame:
    """key, n (in training) and every (in all rows) of every word."""
    return _blocks(docs, ("key",), lambda row, words: (slice(None), words)).groupBy("key").agg(F.sum("n").alias("n"), F.sum("every").alias("every"))


def discounts(counts_of_counts: dict[int, int]) -> np.ndarray:
    """Katz's Good-Turing discounts of the counts 0 (unused) to K; absolute discounting of 0.5 where they are no ratios below 1."""
    n = [0] + [counts_of_counts.get(r, 0) for r in range(1, K + 2)]
    out = np.ones(K + 1)
    if all(n[1:]):
        a = (K + 1) * n[K + 1] / n[1]
        found = [((r + 1) * n[r + 1] / n[r] / r - a) / (1 - a) if a < 1 else -1 for r in range(1, K + 1)]
        if all(0 < d < 1 for d in found):
            out[1:] = found
            return out
    out[1:] = [(r - 0.5) / r for r in range(1, K + 1)]
    return out


@dataclass(frozen=True)
class Unigrams:
    """What the word table says in a few numbers."""

    total: int
    distinct: int
    discount: np.ndarray
    unseen: float  # the probability of the one unseen word
    seen_scale: float

    def probabilities(self, count: np.ndarray) -> np.ndarray:
        """Of words with these counts; 0 stands for the unseen word."""
        seen = count * np.where(count > K, 1.0, self.discount[np.minimum(count, K)]) / max(self.total, 1) * self.seen_scale
        return np.where(count > 0, seen, self.unseen)


def count_histogram(counts: DataFrame) -> dict[int, tuple[int, int]]:
    """count (K + 1 for K + 1 itself, K + 2 for more) -> (keys, their sum)."""
    rows = counts.groupBy(F.least("n", F.lit(K + 2)).alias("r")).agg(F.count("*").alias("keys"), F.sum("n").alias("sum")).collect()
    return {r["r"]: (r["keys"], r["sum"]) for r in rows}


def unigrams(words: DataFrame) -> Unigrams:
    seen = count_histogram(words.filter("n > 0"))
    total, distinct = sum(s for _, s in seen.values()), sum(k for k, _ in seen.values())
    if not total:
        return Unigrams(0, 0, np.ones(K + 1), 1.0, 0.0)
    d = discounts({r: k for r, (k, _) in seen.items() if r <= K + 1})
    unseen = 1 - sum(s * (d[r] if r <= K else 1.0) for r, (_, s) in seen.items()) / total
    if unseen <= 0:
        return Unigrams(total, distinct, d, 1 / (total + 1), total / (total + 1))
    return Unigrams(total, distinct, d, unseen, 1.0)


R = [f"r{r}" for r in range(1, K + 2)]
#: kind 0: sums of a context (key); 1: sums of a document (key); 2: a pair unseen in training (key: its context, doc);
#: 3, if asked for: a pair (key: its context, doc: its word) and its count (total).
SUMS = f"kind int, key long, doc long, total long, {', '.join(f'{r} int' for r in R)}, more int, x double, y double, known long, tokens long"
NAMES = [c.split()[0] for c in SUMS.split(", ")]


def _sums(kind: int, key: np.ndarray, **columns: np.ndarray) -> pa.Table:
    types = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
    given = {"kind": np.full(len(key), kind), "key": key.view(np.int64)} | columns
    arrays = []
    for c in SUMS.split(", "):
        name, kind_of = c.split()
        arrays.append(pa.array(given[name], types[kind_of]) if name in given else pa.nulls(len(key), types[kind_of]))
    return pa.Table.from_arrays(arrays, names=NAMES)


@dataclass(frozen=True)
class Known:
    """What every task looks up: the frequent words, the frequent pairs (codes ascending) and the unigram numbers."""

    frequent: Frequent
    uni: Unigrams
    starts: int  # training documents
    pair_codes: np.ndarray
    pair_counts: np.ndarray

    def counts_of_pairs(self, h: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The training counts of the frequent pairs among these; -1 for all others."""
        out = np.full(len(h), -1, np.int64)
        both = np.flatnonzero((h >= 0) & (x >= 0))
        if len(self.pair_codes):
            code = h[both] * (self.frequent.start + 1) + x[both]
            at = np.minimum(np.searchsorted(self.pair_codes, code), len(self.pair_codes) - 1)
            out[both] = np.where(self.pair_codes[at] == code, self.pair_counts[at], -1)
        return out


def kept_log(n: np.ndarray) -> np.ndarray:
    return np.log10(n - TAIL)


def frequent_pairs(docs: DataFrame, frequent, least: float, very: float) -> tuple[np.ndarray, np.ndarray]:
    """(codes, training counts) of the pairs with ``least`` occurrences in all rows whose words have ``very`` each; the start counts as such a word."""

    def codes(row: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        f = frequent.value
        often = np.append(f.every >= very, True)
        h, x = f.pairs(row, words, f.places(words))
        both = np.flatnonzero((h >= 0) & (x >= 0))
        both = both[often[h[both]] & often[x[both]]]
        return both, (h[both] * (f.start + 1) + x[both]).view(U)

    found = _blocks(docs, ("code",), codes).groupBy("code").agg(F.sum("n").alias("n"), F.sum("every").alias("every")).filter(F.col("every") >= F.lit(least)).toArrow()
    code, n = (found.column(c).to_numpy() for c in ("code", "n"))
    order = np.argsort(code)
    return code[order], n[order]


def _halves(codes: np.ndarray) -> list[bytes]:
    """Codes of words as bits (rare or not), places and hashes."""
    rare = codes < 0
    return [np.packbits(rare).tobytes(), codes[~rare].astype(np.uint32).tobytes(), codes[rare].tobytes()]


def _whole(data: list[bytes], n: int) -> np.ndarray:
    rare = np.unpackbits(np.frombuffer(data[0], np.uint8), count=n).astype(bool)
    out = np.empty(n, np.int64)
    out[~rare], out[rare] = np.frombuffer(data[1], np.uint32), np.frombuffer(data[2], np.int64)
    return out


def _unseen(doc: np.ndarray, h: np.ndarray) -> list[np.ndarray]:
    """(doc, context, times) of pairs unseen in training, each document and context once."""
    _, at, times = np.unique(pair_keys(doc, h), return_index=True, return_counts=True)
    return [doc[at], h[at], times.astype(np.int64)]


PACK = "part int, own boolean, n int, data array<binary>"


def packs(docs: DataFrame, known, parts: int, turn: int) -> DataFrame:
    """The occurrences of all but the frequent pairs in packs by part, for the parts of this turn; in turn 0 also each document's own sums.

    docs: doc, training, text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k: Known = known.value
        f, uni = k.frequent, k.uni
        counts = np.append(f.counts, 0)
        floor = uni.total + 0.1 * (uni.distinct + 1)
        word_base = np.log10((counts + 0.1) / floor)
        # What a word says as the context of the next token; the end is none.
        as_context = -np.log10(np.maximum(counts, 1))
        as_context[:-1][f.hashes == END] = 0
        start = -np.log10(max(k.starts, 1))
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def rows(found: list[tuple[int, bool, int, list[bytes]]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate((pa.int32(), pa.bool_(), pa.int32(), pa.list_(pa.binary())))], names=["part", "own", "n", "data"])

        def block() -> pa.RecordBatch:
            part, doc, training, h, x = (np.concatenate(c) for c in zip(*held))
            order = np.argsort(part, kind="stable")
            part, doc, training, h, x = (c[order] for c in (part, doc, training, h, x))
            ends = np.append(np.flatnonzero(part[1:] != part[:-1]) + 1, len(part))
            out, low = [], 0
            for high in ends if len(part) else []:
                d = doc[low:high]
                first = np.append(0, np.flatnonzero(d[1:] != d[:-1]) + 1)
                runs = np.diff(np.append(first, len(d))).astype(np.uint32)
                out.append((int(part[low]), False, int(high - low), [d[first].tobytes(), training[low:high][first].tobytes(), runs.tobytes(), *_halves(h[low:high]), *_halves(x[low:high])]))
                low = high
            return rows(out)

        for b, column in tokens.slices(batches, limit=1 << 20):
            row, words = with_ends(tokens.text_of(column))
            places = f.places(words)
            h, x = f.pairs(row, words, places)
            doc, training = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("doc", "training"))
            n = k.counts_of_pairs(h, x)
            if turn == 0:
                per_row = lambda w: np.bincount(row, weights=w, minlength=len(doc))
                of_pair = np.where(n > K, kept_log(np.maximum(n, 1)), np.where(n == 0, np.log10(uni.probabilities(counts[places])), 0.0))
                score = per_row(as_context[places] + of_pair) + start
                own = [doc, np.bincount(row, minlength=len(doc)), per_row(counts[places] > 0).astype(np.int64), per_row(word_base[places]), score]
                own += [per_row(n == i).astype(np.int64) for i in range(1, K + 1)]
                none = np.flatnonzero(n == 0)
                own += _unseen(doc[row[none]], h[none])
                yield rows([(int(doc[0].view(np.uint64) % U(parts)) // ROUNDS * ROUNDS, True, len(doc), [c.tobytes() for c in own])])
            by = np.where(x < 0, x.view(U), pair_keys(h, x))
            part = (mix(by) % U(parts)).astype(np.int32)
            mine = np.flatnonzero((n < 0) & (part % ROUNDS == turn))
            held.append((part[mine], doc[row[mine]], training[row[mine]], h[mine], x[mine]))
            size += len(mine)
            if size >= TOKENS_A_BLOCK:
                yield block()
                held, size = [], 0
        if size:
            yield block()

    return docs.select("doc", "training", "text").mapInArrow(run, PACK)


def sums_of_part(known, with_pairs: bool = False):
    """Counts a part's pairs and rare words in training, and gives its sums (see SUMS)."""

    def run(group: pa.Table) -> pa.Table:
        k: Known = known.value
        out, occurrences = [], []
        for own, n, data in zip(*(group.column(c).to_pylist() for c in ("own", "n", "data"))):
            if own:
                longs, doubles = [np.frombuffer(d, np.int64) for d in [*data[:3], *data[5:]]], [np.frombuffer(d, np.float64) for d in data[3:5]]
                by_count = {r: c.astype(np.int32) for r, c in zip(R[:K], longs[3 : 3 + K])}
                out.append(_sums(1, longs[0], tokens=longs[1], known=longs[2], y=doubles[0], x=doubles[1], **by_count))
                docs, contexts, times = longs[3 + K :]
                out.append(_sums(2, contexts, doc=docs, total=times))
            else:
                runs = np.frombuffer(data[2], np.uint32)
                doc, training = (np.repeat(np.frombuffer(d, t), runs) for d, t in ((data[0], np.int64), (data[1], bool)))
                occurrences.append((doc, training, _whole(data[3:6], n), _whole(data[6:9], n)))
        if occurrences:
            out += _counted(k, with_pairs, *(np.concatenate(c) for c in zip(*occurrences)))
        return pa.concat_tables(out)

    return run


def _counted(k: Known, with_pairs: bool, doc: np.ndarray, training: np.ndarray, h: np.ndarray, x: np.ndarray) -> list[pa.Table]:
    _, at, pair = np.unique(pair_keys(h, x), return_index=True, return_inverse=True)
    n_of = np.bincount(pair, weights=training, minlength=len(at)).astype(np.int64)
    rare = np.flatnonzero(x < 0)
    words, word = np.unique(x[rare], return_inverse=True)
    n_x = np.append(k.frequent.counts, 0)[np.maximum(x, 0)]
    n_x[rare] = np.bincount(word, weights=training[rare], minlength=len(words)).astype(np.int64)[word]

    at, n = at[n_of > 0], n_of[n_of > 0]
    h_of, x_count = h[at], n_x[at]
    of_pairs = [_sums(3, h_of, doc=x[at], total=n)] if with_pairs else []
    contexts, c = np.unique(h_of, return_inverse=True)
    per_context = lambda w: np.bincount(c, weights=w, minlength=len(contexts))
    by_count = {r: per_context(n == i).astype(np.int32) for i, r in enumerate(R, 1)}
    of_contexts = _sums(0, contexts, total=per_context(n).astype(np.int64), more=per_context(n > K).astype(np.int32), x=per_context(k.uni.probabilities(x_count)), **by_count)

    n = n_of[pair]
    docs, d = np.unique(doc, return_inverse=True)
    per_doc = lambda w: np.bincount(d, weights=w, minlength=len(docs))
    known = (x < 0) & (n_x > 0)
    score = np.where(n == 0, np.log10(k.uni.probabilities(n_x)), np.where(n > K, kept_log(np.maximum(n, 1)), 0.0))
    score -= np.where(known & (x.view(U) != END), np.log10(np.maximum(n_x, 1)), 0.0)
    by_count = {r: per_doc(n == i).astype(np.int32) for i, r in enumerate(R[:K], 1)}
    of_docs = _sums(1, docs, known=per_doc(known).astype(np.int64), x=per_doc(score), y=per_doc(np.where(known, np.log10((n_x + 0.1) / 0.1), 0.0)), **by_count)
    unseen = np.flatnonzero(n == 0)
    docs, contexts, times = _unseen(doc[unseen], h[unseen])
    return [of_contexts, of_docs, _sums(2, contexts, doc=docs, total=times), *of_pairs]


def sums_of_frequent(k: Known) -> pa.Table:
    """The sums of the contexts over their frequent pairs."""
    seen = k.pair_counts > 0
    h, x = np.divmod(k.pair_codes[seen], k.frequent.start + 1)
    n = k.pair_counts[seen]
    contexts, c = np.unique(h, return_inverse=True)
    per_context = lambda w: np.bincount(c, weights=w, minlength=len(contexts))
    by_count = {r: per_context(n == i).astype(np.int32) for i, r in enumerate(R, 1)}
    mass = per_context(k.uni.probabilities(k.frequent.counts[x]))
    return _sums(0, contexts, total=per_context(n).astype(np.int64), more=per_context(n > K).astype(np.int32), x=mass, **by_count)


def backoff_weights(contexts: DataFrame, d: np.ndarray, uni: Unigrams) -> DataFrame:
    """key, log10 of the backoff weight, and log10 of what the context's count times that weight is (``freed``)."""
    freed = sum((F.col(r) * F.lit(float((1 - d[i]) * i)) for i, r in enumerate(R[:K], 1)), F.col("more") * F.lit(TAIL))
    # The unseen word follows no context, so at least its probability is left to back off to.
    rest = F.greatest(1 - F.col("mass"), F.lit(float(uni.unseen)))
    return contexts.select("key", F.log10(freed / F.col("total") / rest).alias("weight"), F.log10(freed / rest).alias("freed"))


@dataclass(frozen=True)
class Model:
    contexts: DataFrame  # key, total, r1 ... (successors by count), more, mass: a row for each context
    parts: DataFrame  # see SUMS
    discount: np.ndarray
    known: Known


def learned(keyed: DataFrame, scratch: Scratch, with_pairs: bool = False) -> Model:
    """Counts of the training rows of ``keyed`` (doc, training, text), with what its parts say about every row.

    ``with_pairs`` also keeps the counts of all but the frequent pairs as a table, for use beyond these rows.
    """
    spark = keyed.sparkSession
    words = scratch.written(counted_words(keyed), "words")
    uni = unigrams(words)
    # Shares of all rows, not of the training rows: a word of the others can be as hot.
    total = words.agg(F.sum("every")).first()[0] or 0
    found = words.filter(F.col("every") >= F.lit(max(total / VOCABULARY_SHARE, K + 1))).toArrow()
    key, n, every = (found.column(c).to_numpy() for c in ("key", "n", "every"))
    order = np.argsort(key.view(U))
    frequent = Frequent(key.view(U)[order], n[order], every[order])
    ends = words.filter(F.col("key") == F.lit(int(END.astype(np.int64)))).first()

    shared = spark.sparkContext.broadcast(frequent)
    codes, counts = frequent_pairs(keyed, shared, max(total / PAIR_SHARE, K + 1), total / PAIR_WORD_SHARE)
    known = Known(frequent, uni, ends["n"] if ends else 0, codes, counts)
    shared.destroy()
    shared = spark.sparkContext.broadcast(known)
    size = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = ROUNDS * max(1, -(-size // (PART_BYTES * ROUNDS)))
    done = [scratch.written(packs(keyed, shared, parts, turn).groupBy("part").applyInArrow(sums_of_part(shared, with_pairs), SUMS), "sums") for turn in range(ROUNDS)]
    shared.destroy()
    scratch.drop(words)
    sums = done[0]
    for more in done[1:]:
        sums = sums.union(more)
    of_contexts = sums.filter("kind = 0").union(spark.createDataFrame(sums_of_frequent(known), SUMS))
    of_contexts = of_contexts.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("total", *R, "more")], F.sum("x").alias("mass"))
    contexts = scratch.written(of_contexts, "contexts")
    totals = contexts.agg(*[F.sum(r).alias(r) for r in R]).first()
    return Model(contexts, sums, discounts({i: totals[r] or 0 for i, r in enumerate(R, 1)}), known)


def scored(docs: DataFrame, train: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every document; learns where ``train`` holds."""
    keyed = with_text_key(docs.select("doc_id", "text", F.coalesce(train, F.lit(False)).alias("training")))
    keyed = keyed.select("doc_id", "training", "text", F.xxhash64("doc_id", "_th").alias("doc"))
    with Scratch(docs.sparkSession) as scratch:
        model = learned(keyed, scratch)
        uni = model.known.uni
        weights = backoff_weights(model.contexts, model.discount, uni).select("key", "freed")
        unseen = model.parts.filter("kind = 2").select("key", "doc", "total")
        # Frequent contexts are few: at most VOCABULARY_SHARE + 1.
        often = unseen.filter("key >= 0").join(F.broadcast(weights.filter("key >= 0")), "key")
        seldom = unseen.filter("key < 0").join(weights.filter("key < 0"), "key")
        own = model.parts.filter("kind = 1").select(F.col("key").alias("doc"), "tokens", "known", "x", "y", *R[:K])
        said = own.unionByName(often.union(seldom).select("doc", (F.col("freed") * F.col("total")).alias("x")), allowMissingColumns=True)
        seen = sum((F.coalesce(F.sum(r), F.lit(0)) * F.lit(float(np.log10(model.discount[i] * i))) for i, r in enumerate(R[:K], 1)), F.sum("x"))
        # Repeated rows of a document say the same: the sums are shared out.
        copies = F.count("tokens")
        sums = said.groupBy("doc").agg(
            (F.sum("tokens") / copies).cast("long").alias("n_tokens"), (F.sum("known") / copies).cast("long").alias("n_known"), (F.sum("y") / copies).alias("base_score"), (seen / copies).alias("score")
        )
        rows = keyed.select("doc_id", "doc", (~F.col("training")).alias("held_out"))
        out = rows.join(sums, "doc").select("doc_id", "held_out", "n_tokens", "n_known", F.lit(uni.total).cast("long").alias("train_tokens"), "base_score", "score")
        return written(out, "scores")


def training_split(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 != 0


def op8_katz_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), training_split(F.col("doc_id")))
