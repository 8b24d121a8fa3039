"""The pipeline stage by stage against brute-force versions, over the smallest table folder."""

import duckdb
import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from docfields.llm import quality
from tests.llm.test_contamination import brute as contaminated
from tests.llm.test_near_entries import brute as near
from tests.llm.test_repeated_lines import brute as lines

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.materialize(stage(spark, out[-1], SF)))
    return out


def rows(df):
    return sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_all_but_the_last_return_the_columns_of_documents(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])
    counts = [s.count() for s in stages]
    assert counts == sorted(counts, reverse=True) and counts[0] > counts[1] > counts[2] > counts[4] > 0


def test_quality_filter_keeps_what_is_scored_good(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scores = quality.quality_scores(stages[0], labels, "doc_id", "text", label_key="doc_id").collect()
    assert [k for k, _ in rows(stages[1])] == sorted(r.doc_id for r in scores if r.predicted)
    truth = dict(duckdb.sql(f"select doc_id, quality from '{SF}/labels.parquet'").fetchall())
    kept = {k for k, _ in rows(stages[1])}
    good = [k for k, q in truth.items() if q == 1]
    assert sum(k in kept for k in good) >= 0.95 * len(good)


def test_line_dedup(stages):
    got = lines(rows(stages[1]), 3)
    assert rows(stages[2]) == sorted((k, t) for k, t, gone in got if not gone or t)
    assert all(r.n_chars == len(r.text) for r in stages[2].collect())


def test_near_duplicates(stages):
    assert [k for k, _ in rows(stages[3])] == sorted({c for _, _, c in near(rows(stages[2]))})


def test_decontamination(stages):
    items = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    assert [k for k, _ in rows(stages[4])] == sorted(k for k, _, hit, _, _ in contaminated(rows(stages[3]), items) if not hit)


def test_token_ids(spark, stages):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = dict(rows(stages[4]))
    got = stages[5].collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        assert list(r.token_ids) == library.encode(texts[r.doc_id]) and r.n_tokens == len(r.token_ids)
        assert r.decoded_text == texts[r.doc_id]
    ran = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.decoded_text) for r in ran) == sorted((r.doc_id, r.decoded_text) for r in got)


def test_stages_on_no_rows_and_on_null_texts(spark):
    """Every stage keeps its columns on an empty table; null and empty texts pass or go without an error."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(-1, None, None, None, None), (-2, "", "en", "s", 0), (-2, "", "en", "s", 0), (None, None, "de", "s", 1)], docs.schema)
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.limit(0), SF)
        assert empty.collect() == [], name
        some = stage(spark, odd, SF)
        assert some.columns == empty.columns and (name == "token_ids" or some.columns == docs.columns)
        rows = some.collect()
        assert len(rows) <= 4
        if name in ("line_dedup", "decontamination"):
            assert len(rows) == 4 and {r.text for r in rows} == {None, ""}
        if name == "token_ids":
            assert [(list(r.token_ids), r.n_tokens, r.decoded_text) for r in rows] == [([], 0, "")] * 4
