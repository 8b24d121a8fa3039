"""The quality classifier: held-out accuracy, and that it learns from the right rows and the text alone."""

import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from docfields.llm import quality
from docfields.llm.batches import text_bytes

SF = "/root/testdata/sf0.1"


def out(text):
    return zlib.crc32(str(text).encode()) % 4 == 2


@pytest.fixture(scope="module")
def scored(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id as entry_id", "text as full_text", "source as score")
    labels = spark.read.parquet(f"{SF}/labels.parquet").withColumnRenamed("doc_id", "entry_id")
    return quality.quality_scores(docs, labels).toPandas()


def test_held_out_labels_are_predicted(scored):
    labels = duckdb.sql(f"select doc_id as entry_id, quality from '{SF}/labels.parquet'").df()
    both = scored.merge(labels, on="entry_id")
    assert (both.held_out == both.entry_id.map(out)).all()
    test = both[both.held_out]
    assert len(test) > 500 and (test.predicted == test.quality).mean() > 0.97
    assert (test.predicted[test.quality == 1] == 1).mean() > 0.985
    likely = np.clip(test.score, 1e-6, 1 - 1e-6)
    assert -(np.log(np.where(test.quality == 1, likely, 1 - likely))).mean() < 0.1
    assert len(scored) == duckdb.sql(f"select count(*) from '{SF}/documents.parquet'").fetchall()[0][0]


def test_held_out_labels_are_not_learnt(spark, entries):
    own = entries.where("entry_id is not null").select("entry_id").distinct().collect()
    rows = [(r[0], r[0] % 2) for r in own]
    flipped = [(k, 1 - q if out(k) else q) for k, q in rows]
    schema = "entry_id bigint, quality int"
    a, b = (sorted(map(str, quality.quality_scores(entries, spark.createDataFrame(x, schema)).collect())) for x in (rows, flipped))
    assert rows != flipped and a == b


def test_edge_cases(spark, entries, corpus):
    labels = spark.createDataFrame([(1, None), (2, 7), (None, 1)], "entry_id bigint, quality int")
    got = quality.quality_scores(entries, labels).collect()
    assert len(got) == len(corpus) and {(r.score, r.predicted) for r in got} == {(0.5, 0)}
    assert [r.held_out for r in got if r.entry_id is None] == [out("")] * 2
    some = spark.createDataFrame([(0, 1), (1, 0), (1, 1), (4, 0), (5, 1), (None, 0)], "entry_id bigint, quality int")
    got = quality.quality_scores(entries, some, max_labelled=3).collect()
    assert len(got) == len(corpus) and all(0 <= r.score <= 1 for r in got)
    assert quality.quality_scores(entries.limit(0), labels).count() == 0
    kept = quality.good_entries(entries, some, threshold=0.0)
    assert kept.columns == entries.columns and kept.count() == len(corpus)


def test_word_vectors_are_sums_of_neighbours():
    data, offsets = text_bytes(pa.array(["the cat!! the", None, "", "cat"]))
    words, at = quality.word_buckets(data, offsets)
    assert at.tolist() == [0, 4, 4, 4, 5] and words[0] == words[3] and words[1] == words[4]
    batch = pa.RecordBatch.from_arrays([pa.array(["the cat!! the", None, "", "cat"])], names=["_text"])
    made = next(quality._contexts(iter([batch])))
    table = np.concatenate([np.frombuffer(x, np.int64) for x in made.column(1).to_pylist()]).reshape(quality.BUCKETS, -1)

    def index(w):
        v = np.zeros(quality.DIMENSIONS)
        for place, sign in quality._INDEX:
            v[place[w]] += sign[w]
        return v

    the, cat, mark = words[0], words[1], words[2]
    assert (table[cat] == 2 * index(the) + index(mark)).all()
    assert (table[the] == 2 * index(cat) + 2 * index(mark)).all()


def test_network_calibrates_noisy_labels():
    rng = np.random.default_rng(random.Random(1).randrange(99))
    x = rng.normal(size=(4000, 5))
    y = (rng.random(4000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    p = quality.train(x, y).probability(x)
    for low in (0.1, 0.3, 0.5, 0.7):
        part = (p >= low) & (p < low + 0.2)
        assert abs(y[part].mean() - p[part].mean()) < 0.1
