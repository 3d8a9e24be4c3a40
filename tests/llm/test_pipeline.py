from __future__ import annotations

import random
from pathlib import Path

import pytest

import corpus_pipeline

STAGES = dict(corpus_pipeline.STAGES)
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row_id string, kept string, n_lines int"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(4)
    make = lambda n: " ".join("".join(rng.choice(["an", "er", "ti", "on", "es"]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    item = make(30)
    texts = [make(60) for _ in range(60)] + [make(40).replace(" ", "### ") for _ in range(30)]
    texts += [texts[0], texts[1] + "\n" + make(50), f"{make(5)} {item} {make(5)}", None, ""]
    at = tmp_path_factory.mktemp("tables")
    docs = [(k, t, "en", f"s{k % 3}", len(t or ""), "x", "y", 1) for k, t in enumerate(texts)]
    spark.createDataFrame(docs, COLUMNS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(k, int(k < 60), 0) for k in range(90)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_stages_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    good = STAGES["quality_filter"](spark, docs, folder)
    ids = {r["doc_id"] for r in good.collect()}
    assert good.columns == docs.columns and not ids & set(range(60, 90)) and len(ids & set(range(60))) >= 58
    cut = {r["doc_id"]: r for r in STAGES["line_dedup"](spark, docs, folder).collect()}
    assert 90 not in cut and "\n" not in cut[91]["text"] and cut[91]["n_chars"] == len(cut[91]["text"])
    assert cut[0]["row_id"] == "x" and {93, 94} <= set(cut)
    near = {r["doc_id"] for r in STAGES["minhash_dedup"](spark, docs, folder).collect()}
    assert 90 not in near and {0, 91, 93, 94} <= near
    clean = {r["doc_id"] for r in STAGES["decontamination"](spark, docs, folder).collect()}
    assert clean == {k for k in range(95) if k != 92}
    assert STAGES["mixing"](spark, docs, folder).count() == 95


def test_line_stage_takes_short_lines(spark, folder):
    texts = ["Les.\none two three four five\n\na b a b a b", "A  B\none two three four five\nLes.", "les.\n\nnew"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    cut = {r["doc_id"]: r["text"] for r in STAGES["line_dedup"](spark, docs, folder).collect()}
    assert cut == {0: texts[0], 2: "\nnew"}


def test_empty_input_passes_every_stage(spark, folder):
    none = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0


def test_run(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    kept = {r["doc_id"] for r in rows}
    assert 92 not in kept and 90 not in kept and len(kept) > 50
    assert Path(corpus_pipeline.__file__).name == "corpus_pipeline.py"
