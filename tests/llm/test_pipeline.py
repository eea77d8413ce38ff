import shutil

import corpus_pipeline
import pyarrow as pa
import pytest
from tests.conftest import SF

from tidemark.llm.merge_encoding import MergeEncoder, load_merges
from tidemark.session import BATCH_ROWS
from tests.llm.test_pieces import PATH


@pytest.fixture
def tables(spark, documents, tmp_path):
    draw = [f"word{k}" for k in range(300)]
    clean = [" ".join(draw[k : k + 40]) for k in range(0, 240, 7)]
    rows = [(k, t) for k, t in enumerate(clean)]
    rows += [(100 + k, t + " more") for k, t in enumerate(clean[:5])] + [(200, "one two three four five"), (201, "it has token=abcdef in it"), (202, "it has  token=abcdef in it")]
    # A long text with one passage of the benchmark, too short a part of it to drop the text.
    item = " ".join(f"item{k}" for k in range(15))
    rows += [(203, " ".join(f"own{k}" for k in range(200)) + " " + item + " " + " ".join(f"more{k}" for k in range(200)))]
    labels = spark.createDataFrame([(k, 1) for k in range(40)], "doc_id long, quality int")
    bench = spark.createDataFrame([("q", "one two three four five"), ("long", item)], "item_id string, text string")
    documents(rows).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path), rows


def test_stages_take_effect(spark, tables):
    folder, rows = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, folder)
        if name != "encoding":
            assert after.columns == docs.columns
        after.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        kept[name] = {r["doc_id"]: r for r in docs.collect()}
    assert set(kept["quality"]) == {k for k, _ in rows}
    assert set(kept["quality"]) - set(kept["near_duplicates"]) == {100, 101, 102, 103, 104, 202}
    assert set(kept["near_duplicates"]) - set(kept["decontamination"]) == {200}
    cut = kept["decontamination"][203]
    assert cut["text"] == kept["quality"][203]["text"].replace(" ".join(f"item{k}" for k in range(15)), "") and cut["n_chars"] == len(cut["text"])
    assert all(kept["decontamination"][k] == kept["near_duplicates"][k] for k in kept["decontamination"] if k != 203)
    assert set(kept["secrets"]) == set(kept["decontamination"]) and kept["secrets"][201]["text"] == "it has [removed] in it"
    assert kept["secrets"][201]["n_chars"] == 22 and kept["secrets"][1] == kept["decontamination"][1]
    encoder = MergeEncoder(load_merges(PATH))
    assert all(r["ids"] == encoder.encode(kept["secrets"][k]["text"]) and r["n_tokens"] == len(r["ids"]) for k, r in kept["encoding"].items())
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, folder).collect()) == sorted(kept["encoding"])


def test_rejects_what_the_labels_reject(spark, documents, tmp_path):
    rows = [(k, "plain words here and there " * 4 if k % 2 else "$$$ !!! %%% ### " * 4) for k in range(60)]
    spark.createDataFrame([(k, k % 2) for k, _ in rows], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = corpus_pipeline.quality(spark, documents(rows), str(tmp_path))
    assert {r["doc_id"] for r in kept.collect()} == {k for k, _ in rows if k % 2}


def test_odd_rows_pass(spark, documents):
    rows = [(1, None), (2, ""), (None, "no id"), (3, "x" * 50_000), (4, "same text"), (4, "same text")]
    df = documents(rows).withColumnRenamed("source", "score")
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, df, SF)
        assert after.count() >= 0, name
        assert stage(spark, df.where("false"), SF).count() == 0, name
        if name in ("decontamination", "secrets"):
            assert sorted(after.collect(), key=str) == sorted(df.collect(), key=str)


@pytest.mark.parametrize("own", [None, "70"])
@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_texts_go_to_python_in_small_batches(spark, documents, name, stage, own):
    """Batches of 10,000 texts, which executor and worker hold at once, took the pipeline beyond an executor's memory."""

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting, None)
    try:
        spark.conf.unset(setting) if own is None else spark.conf.set(setting, own)
        assert stage(spark, documents([(1, "one two three four five six")]), SF).count() <= 1
        rows = spark.range(3000, numPartitions=1).mapInArrow(sizes, "n bigint").collect()
        assert max(r["n"] for r in rows) == (BATCH_ROWS if own is None else int(own)) and sum(r["n"] for r in rows) == 3000
    finally:
        spark.conf.unset(setting) if before is None else spark.conf.set(setting, before)


def test_guard(tmp_path):
    """Without this package and the pipeline the entry module still imports."""
    import pathlib
    import subprocess
    import sys

    root = pathlib.Path(__file__).resolve().parent.parent.parent
    copy = tmp_path / "repo"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; assert len(e.queries()) > 100; assert not [q for q in e.queries() if q.startswith('op') or q == 'pipeline']"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True)
