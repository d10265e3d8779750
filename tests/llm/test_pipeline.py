"""The pipeline's stages against their operators' own verdicts and brute force; and the guard of the entry module."""

import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest

import corpus_pipeline
from millrace.llm import near_duplicates, ngram_quality, quality_classifier
from millrace.llm.queries import held_out
from tests.llm.test_near_duplicates import partition, plain_classes

SF = "/root/testdata/sf0.01"
ROOT = Path(__file__).resolve().parents[2]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What goes into and comes out of each stage, reread from Parquet."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((docs, after))
        docs = after
    return out


def ids(df):
    return Counter(r["doc_id"] for r in df.select("doc_id").collect())


def test_schema_and_rows(spark, stages):
    want = spark.read.parquet(f"{SF}/documents.parquet")
    for before, after in stages[:3]:
        assert after.columns == want.columns and [f.dataType for f in after.schema] == [f.dataType for f in want.schema]
        assert after.join(want, want.columns, "left_anti").count() == 0
        assert after.count() < before.count()


def test_verdicts_take_effect(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    before, after = stages[0]
    assert ids(after) == ids(quality_classifier.classify(before, labels, lambda d: ~held_out(d)).where("predicted = 1"))
    before, after = stages[1]
    assert ids(after) == ids(ngram_quality.assess(before).where("kept"))


def test_one_of_each_group_stays(stages):
    before, after = stages[2]
    rows = [(r["doc_id"], r["text"]) for r in before.collect()]
    groups = partition((d, c) for (d, _), c in zip(rows, plain_classes(rows)))
    assert sorted(ids(after)) == sorted(g[0] for g in groups)


def test_run_equals_the_stages(spark, stages):
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    got = corpus_pipeline.run(spark, SF)
    assert Counter(map(tuple, got.select(columns).collect())) == Counter(map(tuple, stages[3][1].select(columns).collect()))
    assert ids(got).keys() == ids(stages[2][1]).keys()


def test_entry_without_llm(tmp_path):
    """With both folders and the pipeline gone, the entry module imports and has the other queries."""
    for p in ROOT.iterdir():
        if p.name not in (".git", "corpus_pipeline.py", "millrace"):
            (tmp_path / p.name).symlink_to(p)
    (tmp_path / "millrace").mkdir()
    for p in (ROOT / "millrace").iterdir():
        if p.name != "llm":
            (tmp_path / "millrace" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert not any(k.startswith('op') or k == 'pipeline' for k in q); print(len(q), len(e.oracle_sql()))"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_operators_on_odd_rows(odd_documents):
    assert near_duplicates.keep_first(odd_documents).columns == odd_documents.columns
