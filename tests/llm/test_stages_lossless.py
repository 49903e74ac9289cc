"""Stages on input whose partitions don't follow from its rows, and the chain of all stages."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyloom.llm.exact_dedup import exact_dedup, keep_first
from tallyloom.llm.jaccard import jaccard_components, keep_one_of_each
from tallyloom.llm.licenses import scan_licenses
from tallyloom.llm.lm import lm_scores
from tallyloom.llm.suffix_array import without_repeats

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Hashes like `license` where the seed is known.
MADE = "rfh9fg8732skocof"


def _rows():
    own = lambda i: " ".join(f"w{i}x{j}" for j in range(40))
    rows = [(i, own(i), "en", "s", 9) for i in range(149)]
    return [*rows, (7, own(1000), "en", "s", 9), (None, own(1001), "de", "t", 9), (None, own(1002), "de", "t", 9), (8, own(8), "en", "s", 9)]


@pytest.mark.parametrize(("stage", "kept"), [(keep_first, 152), (keep_one_of_each, 152), (without_repeats, 153)])
def test_repeated_ids_lose_no_rows(spark, stage, kept):
    """Two rows share an id, two have none, one is a copy: on rows dealt round-robin, as a retried task might deal them otherwise."""
    docs = spark.createDataFrame(_rows(), SCHEMA).repartition(5)
    out = stage(docs).collect()
    assert len(out) == kept
    assert {r.doc_id for r in out} == {r[0] for r in _rows()}
    assert sum(r.doc_id is None for r in out) == 2 and sum(r.doc_id == 7 for r in out) == 2


def test_chain_reads_each_stage_once(spark, monkeypatch, tmp_path):
    """All rows go through, and the first stage's work is done once, however often the others read it."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    first = lambda spark, docs, sf_dir: docs.mapInArrow(count, docs.schema)
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("toxicity", first), *corpus_pipeline.STAGES[1:]])
    spark.createDataFrame(_rows(), SCHEMA).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert seen.value == len(_rows())
    assert sum(p.piece == 0 for p in packed) == 152
    assert sum(p.doc_id is None for p in packed) == 2


def test_words_made_alike_are_told_apart(spark):
    docs = spark.createDataFrame([(1, f"the mit {MADE} here"), (2, f"a b c d license q r s t a b c d {MADE}"), (3, "the mit license here")], "doc_id long, text string")
    found = {r.doc_id: (r.n_base, r.base_labels) for r in scan_licenses(docs).collect()}
    assert found == {1: (0, ""), 2: (0, ""), 3: (1, "mit")}
    assert {r.doc_id: r.n_shingles for r in jaccard_components(docs).collect()} == {1: 1, 2: 10, 3: 1}
    alone = spark.createDataFrame([(1, MADE), (2, "license license"), (3, "other")], "doc_id long, text string")
    shared = spark.createDataFrame([(1, "license"), (2, "license license"), (3, "other")], "doc_id long, text string")
    score = lambda df: {r.doc_id: round(r.log_score, 6) for r in lm_scores(df).collect()}
    assert score(alone)[1] == score(alone)[3] != score(shared)[1]


def test_operators_agree_with_their_stages(spark):
    docs = spark.createDataFrame([(i % 40, f"{i % 25} a b c d e f", "en", "s", 1) for i in range(200)], SCHEMA).repartition(7)
    assert exact_dedup(docs).filter("kept").count() == keep_first(docs).count() == docs.select(F.trim("text")).distinct().count()
