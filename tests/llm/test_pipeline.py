"""The corpus pipeline end to end and each of its stages on nasty tables."""

import random
from collections import Counter

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from test_operators import CLASHES, LABELS, corpus, frame, labels, nasty  # noqa: E402


@pytest.fixture
def sf_dir(spark, tmp_path):
    """Documents with copies, near copies, shared lines, nulls and labels."""
    rows, marks = corpus(21, 160)
    rng = random.Random(1)
    shared = " ".join(f"shared{i}" for i in range(60)) + "."
    for i, t, x in rows[:40]:
        words = t.split(" ")
        words[rng.randrange(len(words))] = "edit"
        rows.append((1000 + i, t, x))
        rows.append((2000 + i, " ".join(words), x))
    rows = [(i, f"{t}\n{shared}" if i in range(60, 80) else t, x) for i, t, x in rows]
    rows += [(i if i is None else 5000 + i, t, x) for i, t, x in nasty()]  # ids that no other document has
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(marks, LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, sf_dir)
        assert kept.columns == docs.columns and 0 < kept.count() <= before.count(), name
    packed = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in kept.collect()}
    assert max(Counter(r.doc_id for r in packed if r.doc_id is not None and r.length < 1024).values()) == 1
    ends = Counter()
    for r in packed:
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= 1024


@pytest.mark.parametrize("at", range(len(corpus_pipeline.STAGES)))
def test_stage_on_nasty_and_empty_tables(spark, tmp_path, at):
    labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    docs = frame(spark, nasty())
    name, stage = corpus_pipeline.STAGES[at]
    out = stage(spark, docs, str(tmp_path))
    if at < len(corpus_pipeline.STAGES) - 1:
        assert out.columns == docs.columns
        got, had = Counter(map(tuple, out.drop("text", "n_chars").collect())), Counter(map(tuple, docs.drop("text", "n_chars").collect()))
        assert not got - had and out.where(" OR ".join(f"{c} <> 7" for c in CLASHES)).count() == 0
    assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0
