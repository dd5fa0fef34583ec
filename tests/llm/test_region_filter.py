"""What keeps near dedup's shuffles small: regions that don't recur stay where they are made."""

import numpy as np
import pyarrow as pa

from convena.llm import jaccard_join, langid


def test_regions_that_recur_pass_and_few_others(spark):
    rng = np.random.default_rng(1)
    names = rng.integers(-(1 << 63), (1 << 63) - 1, 40_000)
    recurring = spark.createDataFrame([(x,) for x in names[:20_000].tolist()], "_key long")
    made = jaccard_join.region_filter(recurring, 20_000)
    passed = np.logical_and.reduce([made[x >> 3] >> (x & 7).astype(np.uint8) & 1 for x in jaccard_join._places(names, len(made).bit_length() + 2)]).astype(bool)
    assert passed[:20_000].all() and passed[20_000:].mean() < 0.03


def test_same_groups_where_too_many_regions_recur(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = [" ".join(map(str, rng.integers(0, 5000, 60))) for _ in range(40)]
    texts = [(i, b + " x" * (i % 3)) for i, b in enumerate(base * 3)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    groups = lambda: sorted(tuple(r) for r in jaccard_join.near_groups(docs, 5, jaccard_join.Threshold(80, 100)).select("doc_id", "component_id", "n_links").collect())
    few = groups()
    made, kept = [], jaccard_join.region_filter
    monkeypatch.setattr(jaccard_join, "BROADCAST_REGIONS", 1)
    monkeypatch.setattr(jaccard_join, "region_filter", lambda *a: made.append(kept(*a)) or made[-1])
    assert groups() == few and made and len({c for _, c, _ in few}) == 40


def test_language_of_a_text_within_a_row(spark):
    df = spark.createDataFrame([("the cat and the dog", "en"), ("der hund und die katze", "de"), (None, None), ("123", None)], "text string, lang string")
    model = langid.fit(df)
    said = [tuple(r) for r in langid.identify(df, model).select("lang_pred", "score", "ambiguous").collect()]
    row = df.selectExpr("struct(lang, text) AS doc")
    within = langid.identify(row, model, ("doc", "text"))
    assert within.columns == ["doc", "lang_pred", "score", "ambiguous"] and [tuple(r) for r in within.select("lang_pred", "score", "ambiguous").collect()] == said
