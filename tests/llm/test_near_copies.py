from convena.llm import jaccard_join

DOCS = "doc_id long, text string"


def test_groups_of_null_or_repeated_ids_stay_apart(spark):
    t = jaccard_join.Threshold(80, 100)
    rows = [(None, "a b c d"), (None, "a b c d"), (None, "p q r s"), (None, "P q r s"), (5, "k l m n"), (6, "k l m n"), (5, "u v w x"), (7, "u v w x"), (None, "lone one here"), (None, "")]
    left = jaccard_join.drop_near_copies(spark.createDataFrame(rows, DOCS), 3, t).collect()
    assert sorted((str(r["doc_id"]), r["text"].lower()) for r in left) == [("5", "k l m n"), ("5", "u v w x"), ("None", ""), ("None", "a b c d"), ("None", "lone one here"), ("None", "p q r s")]
