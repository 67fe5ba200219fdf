"""The five stages, one after the other."""

import corpus_pipeline as pipeline


def test_stages(spark, sf_dir, docs):
    kept = docs
    for name, stage in pipeline.STAGES[:-1]:
        before, after = kept, stage(spark, kept, sf_dir)
        assert after.columns == docs.columns
        kept = spark.createDataFrame(after.collect(), docs.schema)
        ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
        assert ids <= {r["doc_id"] for r in before.select("doc_id").collect()}, name
        assert 0.5 * before.count() < kept.count() < before.count(), name
    pieces = pipeline.STAGES[-1][1](spark, kept, sf_dir)
    assert {r["doc_id"] for r in pieces.select("doc_id").collect()} == ids
    assert pipeline.run(spark, sf_dir).count() == pieces.count()


def test_stages_on_edges(spark, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(i, t, None, "s", 0) for i, t in ((1, None), (2, ""), (3, "a b c d e f g"), (3, "a b c d e f g"), (4, "A different text entirely, of nine words, more or less"), (None, "no id but kept text of its own kind here"))]
    for given, left in ((rows, 4), ([], 0)):
        kept = spark.createDataFrame(given, schema)
        for _, stage in pipeline.STAGES[:-1]:
            kept = spark.createDataFrame(stage(spark, kept, sf_dir).collect(), schema)
        assert kept.count() == left
        assert pipeline.STAGES[-1][1](spark, kept, sf_dir).count() == left


def test_stages_with_clashing_columns(spark, sf_dir):
    """Columns named as ours are kept as they are, rows of one id with several spellings become one, and very long texts pass."""
    schema = "doc_id long, text string, id long, sha string, kept boolean, __id long, one string, best string, group_id long, key string, i long, m int"
    own = (7, "s", False, 8, "o", "b", 9, "k", 1, 2)
    texts = [(1, "a b c d e f g"), (1, "a b  c d e f g"), (1, "abcdefg"), (2, "another text of its own, with more words than the first"), (3, None), (4, " ".join(f"w{k}" for k in range(60_000)))]
    kept = spark.createDataFrame([(*t, *own) for t in texts], schema)
    for name, stage in pipeline.STAGES[:-1]:
        after = stage(spark, kept, sf_dir)
        assert after.columns == kept.columns, name
        kept = spark.createDataFrame(after.collect(), schema)
    assert sorted((r["doc_id"], len(r["text"] or "")) for r in kept.collect()) == [(1, 14), (2, len(texts[3][1])), (3, 0), (4, len(texts[5][1]))]
    assert all(tuple(r)[2:] == own for r in kept.collect())
    assert {r["doc_id"] for r in pipeline.STAGES[-1][1](spark, kept, sf_dir).collect()} == {1, 2, 3, 4}
