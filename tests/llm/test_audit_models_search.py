"""Source audit, language model and lexical search against plain versions, with their edge cases."""

from __future__ import annotations

import collections
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

from touchline.llm import divergence, hidden_markov, lexical_search

SCHEMA = "doc_id long, text string, lang string, source string, term string, n int, row_id string, score int, part string, item_id string, block string"
EXTRA = ("t", 1, "r", 2, "p", "i", "b")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def some_words(rng, n):
    return [rng.choice(["An", "er", "tion", "Über", "é", "x1", "the", "of", "ha2ha", "9"]) + rng.choice(["", "", "s", ",", "."]) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    out = [(k, " ".join(some_words(rng, rng.randint(1, 60))), rng.choice(["en", "de", None]), rng.choice(["a", "b", "ä", None, "c"]), *EXTRA) for k in range(90)]
    out += [(90, None, "en", "a", *EXTRA), (91, "", "fr", "alone", *EXTRA), (92, " \n", None, None, *EXTRA), (93, out[3][1], "en", "b", *EXTRA), (93, out[3][1], "en", "b", *EXTRA)]
    return [*out, (None, "the of the", "en", "z", *EXTRA), (95, "the " * 5000 + "An", "en", "a", *EXTRA)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# Divergence


def plain_audit(rows, least, top):
    terms = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    cut = [(r[2] or "", r[3] or "", terms.findall((r[1] or "").translate(ASCII))) for r in rows]
    out = []
    for lang in {c[0] for c in cut}:
        df = collections.Counter(t for c in cut if c[0] == lang for t in set(c[2]))
        kept = sorted(t for t, n in df.items() if n >= least)
        whole = collections.Counter(t for c in cut if c[0] == lang for t in c[2])
        groups = {s: collections.Counter(t for c in cut if c[:2] == (lang, s) for t in c[2]) for s in {c[1] for c in cut if c[0] == lang}}
        v = len(kept)
        share = lambda counts: {t: 1 + 10**9 * (counts[t] + 2) // (sum(counts[u] for u in kept) + 2 * v) for t in kept}  # noqa: E731, B023
        f = lambda p, q: (p - q) ** 2 // (p + q)
        q = share(whole)
        p = {s: share(c) for s, c in groups.items()}
        for s in groups:
            pair = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in groups if o != s)
            term = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if groups[s][t] and p[s][t] > q[t])[:top]
            for name, found in (("pair", pair), ("term", term)):
                out += [(lang, s, name, i.decode(), -value, k + 1) for k, (value, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize(("least", "top"), [(3, 10), (10, 2), (1000, 10)])
def test_audit_matches_a_plain_version(docs, rows, least, top):
    got = sorted(tuple(r) for r in divergence.audit(docs, least, top).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == plain_audit(rows, least, top)


def test_audit_of_nothing_and_parts_of_any_size(docs, rows, empty, monkeypatch):
    assert divergence.audit(empty).count() == 0
    monkeypatch.setattr(divergence, "_ROWS", 3)
    monkeypatch.setattr(divergence, "_GATHERED", 5)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist([{"lang": "en", "term": t, "source": s, "n": n} for t in "abc" for s, n in (("p", 1), ("q", 2), ("r", 1))])
    met = collections.Counter()
    for b in divergence._tally(iter([batch.slice(k, 2) for k in range(0, 9, 2)])):
        for r in b.to_pylist():
            met[r["a"], r["b"], r["ca"], r["cb"]] += r["m"]
    assert met == {("p", "q", 1, 2): 3, ("p", "r", 1, 1): 3, ("q", "r", 2, 1): 3}


def test_shares_beyond_a_long(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(divergence.share(F.lit(10**13), F.lit(10**14), F.lit(7)).alias("p")).first()
    assert row["p"] == 1 + 10**9 * (10**13 + 2) // (10**14 + 14)


# Hidden Markov


def chain_of(rng, size):
    start, steps = rng.random(size), rng.random((size, size))
    return hidden_markov.Chain(start / start.sum(), steps / steps.sum(1, keepdims=True))


def plain_expected(chain, emit, text):
    size = len(chain.start)
    starts, steps, codes, total = np.zeros(size), np.zeros((size, size)), np.zeros(emit.shape), 0.0
    for path in itertools.product(range(size), repeat=len(text)):
        p = chain.start[path[0]] * emit[text[0], path[0]]
        for a, b, w in zip(path[:-1], path[1:], text[1:], strict=True):
            p *= chain.steps[a, b] * emit[w, b]
        total += p
        starts[path[0]] += p
        for a, b in zip(path[:-1], path[1:], strict=True):
            steps[a, b] += p
        for s, w in zip(path, text, strict=True):
            codes[w, s] += p
    return total, starts / total, steps / total, codes / total


@pytest.mark.parametrize("piece", [2, 3, 100])
def test_recursions_match_all_paths(monkeypatch, piece):
    monkeypatch.setattr(hidden_markov, "PIECE", piece)
    monkeypatch.setattr(hidden_markov, "_HELD", 6)
    rng = np.random.default_rng(5)
    chain, emit = chain_of(rng, 3), rng.random((4, 3))
    texts = [rng.integers(0, 4, n) for n in (1, 7, 2, 5, 3, 6)]
    tokens, ends = np.concatenate(texts), np.cumsum([len(t) for t in texts])
    plain = [plain_expected(chain, emit, t) for t in texts]
    assert chain.likelihood(tokens, emit, ends) == pytest.approx([math.log(p[0]) for p in plain])
    for got, k in zip(chain.expected(tokens, emit, ends), (1, 2, 3), strict=True):
        assert got == pytest.approx(sum(p[k] for p in plain), abs=1e-5)


def test_scores_counts_and_reruns(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(hidden_markov, "BLOCK_BYTES", 600)
    got = hidden_markov.score(docs, states=3, passes=2).collect()
    space = re.compile(r"[\x20\x09-\x0D]+")
    cut = [(r[0], zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 10 == 0, [w for w in space.split((r[1] or "").translate(ASCII)) if w] + ["\n"]) for r in rows]
    c = collections.Counter(w for _, out, t in cut if not out for w in t)
    n, v = sum(c.values()), len(c)
    want = sorted((-1 if i is None else i, out, len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 6)) for i, out, t in cut)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    again = hidden_markov.score(docs.repartition(2), states=3, passes=2).collect()
    assert sorted((r["doc_id"] or 0, round(r["score"], 3)) for r in again) == sorted((r["doc_id"] or 0, round(r["score"], 3)) for r in got)


def test_the_probabilities_of_all_texts_sum_to_one(spark):
    rows = [(k, t) for k, t in enumerate(["a b a", "b b", "a c", "c", "a b", "", "b a b a"] * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    from pyspark.sql import functions as F

    base = df.select(F.col("doc_id").alias("row_id"), "text", F.lit(False).alias("held_out"))
    blocks = hidden_markov.blocks_of(base)
    chain, emit = hidden_markov.fit_tied(blocks, 2, 2)
    words = hidden_markov.learn_words(blocks, chain, emit)
    e = hidden_markov.Emissions(words, 2)
    known = sorted((r["word"], r["c"], r["shares"]) for r in words.collect())
    assert [w[0] for w in known] == ["\n", "a", "b", "c"]
    p = e.rows(np.array([w[1] for w in known] + [0]), np.array([w[2] for w in known] + [[0, 0]], float))
    assert p.sum(axis=0) == pytest.approx([1, 1], abs=1e-9)
    # texts of up to 40 tokens: an end at step k after k - 1 other words
    states, total = chain.start, 0.0
    for _ in range(60):
        total += float((states * p[0]).sum())
        states = (states * (1 - p[0])) @ chain.steps
    assert total == pytest.approx(1, abs=1e-3)


def test_two_kinds_of_texts_are_told_apart(spark):
    rng = random.Random(2)
    kinds = [[f"{c}{k}" for k in range(60)] for c in "xy"]
    rows = [(k, " ".join(rng.choice(kinds[k % 2]) for _ in range(50))) for k in range(300)]
    got = hidden_markov.score(spark.createDataFrame(rows, "doc_id long, text string"), states=4, passes=6).where("held_out").collect()
    assert len(got) > 10
    # knowing the kind halves the words that may follow: log10(2) of 50 words
    assert all(r["score"] > r["base_score"] + 8 for r in got)


def test_scores_of_nothing_and_without_training(spark, empty):
    assert hidden_markov.score(empty).count() == 0
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 10 == 0)
    row = hidden_markov.score(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert row["held_out"] and (row["n_tokens"], row["n_known"], row["train_tokens"]) == (3, 0, 0) and math.isfinite(row["score"])


# Search


def plain_search(rows, items, top=20):
    terms = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    cut = [(r[0], collections.Counter(terms.findall((r[1] or "").translate(ASCII)))) for r in rows]
    n = [sum(c.values()) for _, c in cut]
    n_docs, total = sum(k > 0 for k in n), sum(n)
    df = collections.Counter(t for _, c in cut for t in c)
    out = []
    for item, text in items:
        scored = []
        for (doc, c), k in zip(cut, n, strict=True):
            score = 0
            for t in terms.findall((text or "").translate(ASCII)):
                if c[t]:
                    m = 75 + 25 * k * n_docs // total
                    score += math.floor(1000 * math.log((2.0 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
            if score > 0:
                scored.append((-score, math.inf if doc is None else doc))
        out += [(item, k + 1, None if d == math.inf else d, -s) for k, (s, d) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("top", [1, 3, 20])
def test_search_matches_a_plain_version(spark, docs, rows, top, monkeypatch):
    rng = random.Random(6)
    items = [(k, " ".join(some_words(rng, rng.randint(1, 12)))) for k in range(12)] + [(20, None), (21, "!?"), (22, "nowhere"), (3, "Über the"), (23, "the the THE of"), (24, rows[3][1])]
    df = spark.createDataFrame([(*i, "x", 1) for i in items], "item_id long, text string, doc_id string, term int")
    monkeypatch.setattr(lexical_search, "BLOCK_ITEMS", 7)
    monkeypatch.setattr(lexical_search, "_CELLS", 60)
    got = sorted((tuple(r) for r in lexical_search.search(docs, df, top).select("item_id", "rank", "doc_id", "score").collect()), key=repr)
    assert got == plain_search(rows, items, top)


def test_search_of_nothing(spark, docs, empty):
    items = spark.createDataFrame([(1, "the")], "item_id long, text string")
    assert lexical_search.search(empty, items).count() == 0
    assert lexical_search.search(docs, items.where("item_id > 1")).count() == 0
