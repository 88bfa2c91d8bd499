"""The pipeline against its stages' own brute-force rules, one after the other."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registry
import corpus_pipeline
from tests.llm.helpers import prose
from tests.llm.test_jaccard_and_components import brute
from tests.llm.test_quality_and_vectors import graded
from tests.llm.test_scans import leaks


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows, labels = graded(300)
    r = random.Random(4)
    items = [(i, prose(r, 30, 90)) for i in range(5)]
    rows += [(1000 + i, prose(r, 50) + "\n" + items[i % 5][1]) for i in range(10)]
    rows += [(2000 + i, rows[7][1]) for i in range(3)] + [(3000, prose(r, 60) + " token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" " + prose(r, 60)), (3001, None), (3002, "")]
    docs = [(d, t, "en", "s", len(t or "")) for d, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, labels, items


def test_stages(spark, sf_dir):
    path, rows, labels, items = sf_dir
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    steps = dict(corpus_pipeline.STAGES)

    kept = steps["quality_classifier"](spark, docs, path)
    assert kept.columns == columns
    have = {r["doc_id"]: r["text"] for r in kept.collect()}
    bad = {d for d, q, _ in labels if not q}
    assert len(bad & have.keys()) <= 0.05 * len(bad) and len({d for d, q, _ in labels if q} - have.keys()) <= 2

    kept = steps["ngram_jaccard_join"](spark, kept, path)
    have_after = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert have_after.keys() == {d for d, _, c in brute(sorted(have.items())) if d == c} and kept.columns == columns

    kept = steps["benchmark_decontamination"](spark, kept, path)
    clean = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert clean.keys() == have_after.keys() - {d for d, _ in leaks(have_after.items(), items)} and kept.columns == columns

    kept = steps["secret_scan"](spark, kept, path)
    redacted = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert redacted.keys() == clean.keys() and {d for d in clean if clean[d] != redacted[d]} == {3000} and "[SECRET]" in redacted[3000]
    assert kept.columns == columns

    packed = steps["best_fit_packing"](spark, kept, path).collect()
    assert {r["doc_id"] for r in packed} == redacted.keys()
    whole = registry.queries()["pipeline"](spark, path).collect()
    place = lambda rows: sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in rows)
    assert place(whole) == place(packed)


DOCUMENTS, LABELS, ITEMS = "doc_id long, text string, lang string, source string, n_chars long", "doc_id long, quality int, toxic int", "item_id long, text string"


def test_nulls_everywhere_and_empty_tables(spark, tmp_path):
    tables = {
        "nulls": ([(None,) * 5, (1, None, None, None, None), (1, "a b c", None, None, None), (2, "a b c", "x", "y", 5)], [(None, None, None), (1, None, None), (2, 1, None)], [(None, None), (1, None), (None, "x")]),
        "empty": ([], [], []),
    }
    for name, contents in tables.items():
        for table, schema, rows in zip(("documents", "labels", "benchmark"), (DOCUMENTS, LABELS, ITEMS), contents):
            spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}/{table}.parquet")
    rows = corpus_pipeline.run(spark, f"{tmp_path}/nulls").collect()
    assert sorted((r["doc_id"] or 0, r["length"]) for r in rows) == [(0, 1), (1, 1), (1, 4)]  # the copy with the larger id is gone
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0


CLASHING = ("part", "piece", "start", "license", "score", "_id", "key", "rid", "set", "h", "f1", "n", "row", "p", "spans", "hash", "_gone", "value", "s", "v", "node")


def test_columns_with_clashing_names(spark, tmp_path):
    """The stages and the queries carry or leave out columns that are named like their own."""
    rows = [(i, t, "en", "s", None) for i, t in enumerate(["a b c d e f g", "a b c d e f g", "token = \"24be64439e3e49cf46b2d7c90f3602a3\"", "Released under the MIT License.", None, ""])]
    docs = spark.createDataFrame(rows, DOCUMENTS).withColumns({c: F.lit(7) for c in CLASHING})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0), (1, 1, 0)], LABELS).withColumns({c: F.lit(7) for c in CLASHING}).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "x y z")], ITEMS).withColumns({c: F.lit(7) for c in CLASHING}).write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns, name
        assert {tuple(r[len(rows[0]) :]) for r in kept.collect()} == {(7,) * len(CLASHING)}, name
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 3, 4, 5] and kept.where("doc_id = 2").first()["n_chars"] == len('[SECRET]"')
    assert corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().count() == 5
    for name, n in (("op1", 6), ("op2", 6), ("op3", 1), ("op4", 6), ("op6", 6), ("op7", 6), ("op10", 0)):
        query = next(q for k, q in registry.queries().items() if k.startswith(f"{name}_"))
        assert query(spark, str(tmp_path)).count() == n, name


def test_registry():
    names = registry.queries()
    for n in range(1, 11):
        assert sum(q.startswith(f"op{n}_") for q in names) == 1
    assert set(registry.oracle_sql()) <= set(names)
