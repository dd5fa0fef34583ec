import random

import numpy as np

from convena.llm import langid


def rows_of(n):
    rng = random.Random(n)
    own = [["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(12)] for _ in range(n)]
    return [(" ".join(rng.choices(own[i], k=15)), f"l{i:03d}") for i in range(n) for _ in range(6)]


def test_more_than_64_languages(spark):
    df = spark.createDataFrame(rows_of(80), "text string, lang string")
    model = langid.fit(df)
    assert len(model.languages) == 80
    got = langid.identify(df, model).collect()
    assert len(got) == 480 and sum(r["lang_pred"] == r["lang"] for r in got) >= 470


def test_rows_of_counts_give_the_weights_of_a_dense_table(spark, monkeypatch):
    df = spark.createDataFrame(rows_of(9), "text string, lang string")
    dense = langid.fit(df)
    monkeypatch.setattr(langid, "DENSE", 1)
    monkeypatch.setattr(langid, "DECODED", 500)
    sparse = langid.fit(df)
    assert np.allclose(dense.weights, sparse.weights, atol=1e-5) and np.allclose(dense.trust, sparse.trust)
    assert langid.identify(df, dense).select("lang_pred").collect() == langid.identify(df, sparse).select("lang_pred").collect()


def test_words_of_many_languages_differ():
    code = langid.codewords(1500)
    assert len(np.unique(code, axis=0)) == 1500
