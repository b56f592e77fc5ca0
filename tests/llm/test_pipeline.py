"""The corpus pipeline: every stage on the rows that the stage before kept, against brute force."""

import corpus_pipeline
from test_operators import brute_components, brute_pieces, documents, fixture, folded

from reliefspark.llm.common import written
from reliefspark.llm.queries import QUERIES, SQL


def test_stages(spark):
    docs = documents(spark, fixture())
    kept = written(corpus_pipeline.keep_quality(spark, docs, ""), "t1")
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()

    once = written(corpus_pipeline.keep_one_copy(spark, kept, ""), "t2")
    newest = {}
    for r in kept.collect():
        newest[folded(r["text"])] = max(newest.get(folded(r["text"]), -1), r["doc_id"])
    assert once.columns == docs.columns and {r["doc_id"] for r in once.collect()} == set(newest.values())

    apart = written(corpus_pipeline.keep_one_near_copy(spark, once, ""), "t3")
    of = brute_components([(r["doc_id"], r["text"]) for r in once.collect()], 5, 80, 100)
    assert apart.columns == docs.columns and {r["doc_id"] for r in apart.collect()} == {d for d, (_, c) in of.items() if d == c}

    mixed = written(corpus_pipeline.mix_sources(spark, apart, ""), "t4")
    assert mixed.columns == docs.columns and mixed.count() > 0

    packed = corpus_pipeline.pack_sequences(spark, mixed, "").collect()
    assert sum(brute_pieces([(r["doc_id"], r["text"]) for r in mixed.collect()], 4096).values()) == len(packed)


def test_ids_may_clash(spark):
    rows = [(5, "same text here"), (9, "same text here"), (5, "a wholly different text"), (5, "Same text here")]
    docs = documents(spark, [(i, t, "en", "a") for i, t in rows])
    got = corpus_pipeline.keep_one_copy(spark, docs, "").collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == [(5, "a wholly different text"), (9, "same text here")]


def test_an_empty_table_passes_all_stages(spark):
    docs = documents(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, ""), "empty")
    assert docs.count() == 0 and len(corpus_pipeline.STAGES) == 5


def test_queries_are_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {"pipeline", *QUERIES} <= names and len(QUERIES) == 13 and set(SQL) <= set(QUERIES)
