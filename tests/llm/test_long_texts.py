"""One text longer than a slice, through each operator that works in slices."""

from __future__ import annotations

import hashlib
import random

import pytest

from touchline.llm import common, minhash_dedup, quality, suffix_dedup, token_counts


@pytest.fixture(scope="module")
def long_rows():
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgéü") for _ in range(rng.randint(2, 9))) for _ in range(400_000)]
    text = " ".join(words)
    assert len(text.encode()) > 2 * common.SLICE_BYTES
    near = " ".join(words[:390_000] + ["other"] * 10)
    return [(1, "a short text before it", "en", "a"), (2, text, "en", "a"), (3, near, "de", "b"), (4, "and a short one after it", "en", "b"), (5, None, "en", "a")]


@pytest.fixture(scope="module")
def long_docs(spark, long_rows):
    return spark.createDataFrame(long_rows, "doc_id long, text string, lang string, source string")


def test_near_copies_of_a_long_text(long_docs, long_rows):
    got = {r["doc_id"]: (r["component_id"], r["kept"], r["n_shingles"]) for r in minhash_dedup.near_duplicates(long_docs).collect()}
    words = long_rows[1][1].split()
    assert got[2] == (2, True, len({tuple(words[i : i + 5]) for i in range(len(words) - 4)}))
    assert got[3][:2] == (2, False) and got[1][:2] == (1, True) and got[4][:2] == (4, True) and got[5][2] == 0


def test_repeats_of_a_long_text(long_docs, long_rows):
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(long_docs).collect()}
    a, b = long_rows[1][1].encode(), long_rows[2][1].encode()
    same = next(i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y)
    assert got[2]["n_removed"] == got[3]["n_removed"] == same and got[2]["n_spans"] == 1
    assert got[2]["kept_sha256"] == hashlib.sha256(a[same:]).hexdigest() and got[3]["kept_sha256"] == hashlib.sha256(b[same:]).hexdigest()
    assert got[1]["n_removed"] == got[5]["n_bytes"] == 0


def test_a_long_text_is_scored_and_counted_whole(long_docs, long_rows):
    labels = long_docs.sparkSession.createDataFrame([(1, 0, 0), (2, 1, 0), (3, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    scored = quality.score(long_docs, quality.fit(long_docs, labels)).collect()
    assert len(scored) == 5 and all(0 <= r["score"] <= 1 for r in scored)
    counts = token_counts.count_tokens(long_docs).groupBy("doc_id").sum("n_tokens").collect()
    n = {r["doc_id"]: r["sum(n_tokens)"] for r in counts}
    assert n[2] > 400_000 and n[2] > n[3] > n[1] > 0
