import random

from pyspark.sql import functions as F

from convena.llm import quality


def test_every_significant_feature_has_evidence(spark):
    """300 words mark most bad documents; one that ranks below them all is the only mark of the others."""
    rng = random.Random(3)
    filler = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(40)]
    strong = " ".join(f"strong{i}" for i in range(300))
    rows, said = [], []
    for i in range(660):
        kind = "good" if i < 400 else "marked" if i < 600 else "rare"
        body = " ".join(rng.choice(filler) for _ in range(30))
        rows.append((i, body + {"good": " " + filler[0], "marked": " " + strong, "rare": " zrare"}[kind], "h", "p"))
        if i < 630:
            said.append((i, kind == "good"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = {r["doc_id"]: r["kept"] for r in quality.posteriors(docs, spark.createDataFrame(said, "doc_id long, good boolean"), F.lit(True), "source", "lang").collect()}
    assert not any(got[i] for i in range(630, 660)) and sum(got[i] for i in range(400)) > 390
