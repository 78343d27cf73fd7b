"""The language stage where the labels of its input say little or nothing."""

import pytest

import corpus_pipeline

ROWS = [(0, None), (1, ""), (2, "123 !!"), (3, "the of and the"), (4, "\u043f\u0440\u0438\u0432\u0435\u0442"), (5, "7 w")]


@pytest.mark.parametrize("labels", [[None] * 6, ["und"] * 6, ["en", "en", "en", "und", "und", "en"]], ids=["null", "und", "mixed"])
def test_texts_with_letters_stay(spark, sf_dir, labels):
    docs = spark.createDataFrame([(i, t, lang, "x", len(t or "")) for (i, t), lang in zip(ROWS, labels, strict=True)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.language(spark, docs, sf_dir).collect()) == [3, 4, 5]
