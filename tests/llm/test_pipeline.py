"""The pipeline: every stage on what the one before kept."""

import pytest

import corpus_pipeline
from emberfold.llm import quality_knn
from tests.llm.conftest import awkward_rows, by_id
from tests.llm.test_duplicates import plain_components
from tests.llm.test_learned import plain_mix
from tests.llm.test_native import item_words, plain_base, plain_contamination

SF = "/root/testdata/sf0.001"


def test_stages_in_turn(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + 10]) for _, t in bench for w in [item_words(t)] for i in range(max(1, len(w) - 9))}
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        rows = [tuple(r[c] for c in ("doc_id", "text")) for r in docs.collect()]
        out = stage(spark, docs, SF).cache()
        kept = {r["doc_id"] for r in out.collect()}
        if name == "near_dup":
            want = plain_components(rows, 5)
            assert kept == {d for d, c in want.items() if d == c}
        elif name == "decontaminate":
            hits = {d for d, t in rows for w in [item_words(t)] if any(tuple(w[i : i + 10]) in windows for i in range(len(w) - 9)) or (len(w) < 40 and plain_contamination(t, bench)[1])}
            assert kept == {d for d, _ in rows} - hits
        elif name == "secrets":
            assert kept == {d for d, _ in rows} and not any(plain_base(r["text"]) for r in out.collect())
        if name != "mix":
            assert out.columns == columns
        docs = out
    assert 0 < docs.count() < before


def test_run_equals_the_stages(spark):
    got = corpus_pipeline.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
    assert by_id(got, "doc_id", "taken") == by_id(docs, "doc_id", "taken")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, labels):
    """Labels and benchmark items of the awkward rows."""
    path = str(tmp_path_factory.mktemp("tables"))
    words = awkward_rows()[0][1].split()
    items = [(1, " ".join(words[:14])), (2, None), (3, ""), (None, " ".join(words[20:33])), (1, " ".join(words[:14]))]
    labels.coalesce(1).write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{path}/benchmark.parquet")
    return path


def shown(rows, columns):
    return sorted(str(tuple(r[c] for c in columns)) for r in rows)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_awkward_rows(spark, awkward, folder, name):
    """Nulls, repeats, very long texts and clashing columns: each stage drops the rows that it should, and leaves the others as they are."""
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, awkward, folder)
    before, after = awkward.collect(), out.collect()
    every = shown(before, awkward.columns)
    assert [c for c in out.columns if c not in ("taken", "first_slot")] == awkward.columns
    if name == "quality":
        model, _ = quality_knn._model(awkward, spark.read.parquet(f"{folder}/labels.parquet"))
        good = {r["doc_id"]: r["predicted"] for r in quality_knn.score(awkward.drop("score", "predicted"), model).collect()}
        assert shown(after, awkward.columns) == shown([r for r in before if good[r["doc_id"]] == 1], awkward.columns)
    elif name == "near_dup":
        want = plain_components(awkward_rows(), 5)
        assert shown(after, awkward.columns) == shown([r for r in before if r["doc_id"] is None or want[r["doc_id"]] == r["doc_id"]], awkward.columns)
    elif name == "decontaminate":
        items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
        assert shown(after, awkward.columns) == shown([r for r in before if not plain_contamination(r["text"], items)[1]], awkward.columns)
    elif name == "secrets":
        rest = [c for c in awkward.columns if c not in ("text", "n_chars")]
        assert shown(after, rest) == shown(before, rest) and not any(plain_base(r["text"]) for r in after)
        clean = lambda rows: [r for r in rows if r["doc_id"] != 8]
        assert shown(clean(after), awkward.columns) == shown(clean(before), awkward.columns)
    else:
        assert shown(after, awkward.columns) == every
        plain = plain_mix(awkward_rows())[2]
        assert sorted(str((r["doc_id"], r["taken"], r["first_slot"])) for r in after) == sorted(str((p[0], p[2], p[4])) for p in plain)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_empty_tables(spark, awkward, nothing, folder, name, tmp_path):
    """No documents give none; without labels all pass with the score of no model, without items nothing is contaminated."""
    stage = dict(corpus_pipeline.STAGES)[name]
    assert stage(spark, nothing, folder).count() == 0
    for table in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    n = len(awkward_rows())
    got = stage(spark, awkward, str(tmp_path)).count()
    assert got == n if name != "near_dup" else 0 < got < n
