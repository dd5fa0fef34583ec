"""The pipeline stage by stage: each on all that the one before kept."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from convena.llm import langid

pytest.importorskip("public_tokenizers")


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))


def corpus():
    rng = random.Random(1)
    passage = words(rng, 60)
    base = [words(rng, 120) for _ in range(30)]
    near = []
    for t in base[:5]:
        w = t.split()
        w[60] = "changed"
        near.append(" ".join(w))
    texts = base + base[:3] + near + [words(rng, 40) + " " + passage + " " + words(rng, 40) for _ in range(4)] + ["", None, "123 456", "short text here"]
    return [(i, t, "en", "s", 0 if t is None else len(t), "x") for i, t in enumerate(texts)], passage


def test_pipeline(spark, tmp_path):
    rows, passage = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, Spans string")
    columns = docs.columns
    kept = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, "").write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        if i + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns
            kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
    told = {i for i, t, *_ in rows if t and any(c.isalpha() for c in t)}
    assert set(kept[0]) == told
    assert set(kept[1]) == told - {0, 1, 2}
    assert len(kept[2]) == len(kept[1]) - 5 and set(range(5, 30)) <= set(kept[2])
    assert set(kept[3]) == set(kept[2]) and not any(passage in (t or "") for t in kept[3].values())
    assert all(kept[3][i] == kept[2][i] for i in range(5, 30))
    packed = docs.collect()
    assert {r["doc_id"] for r in packed} == set(kept[3])
    seqs = defaultdict(int)
    for r in packed:
        seqs[r["sequence_id"]] += r["length"]
    assert max(seqs.values()) <= 1024


def test_language_decides(spark):
    """Documents go by the language told from their text, whatever the table says; a missing label is filled in."""
    rng = random.Random(2)
    say = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(30))
    rows = [(i, say("abcdefgh") if i % 2 else say("mnopqrst"), "one" if i % 2 else "two", "s", 1) for i in range(200)] + [(900, say("abcdefgh"), None, "s", 1), (901, say("mnopqrst"), None, "s", 1), (902, say("abcdefgh"), "two", "s", 1), (903, "12", "one", "s", 1), (904, None, "one", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"]: r["lang"] for r in corpus_pipeline.language(spark, docs, "").collect()}
    assert set(kept) == set(range(200)) | {900, 901, 902} and (kept[900], kept[901]) == ("one", "two")
    only = {r["doc_id"] for r in corpus_pipeline.language(spark, docs, "", frozenset({"one"})).collect()}
    assert only == {i for i in range(200) if i % 2} | {900, 902}


def test_stages_by_brute_force(spark):
    """Exact and near dedup, repeats and packing on repeated ids, null ids and a very long text, against plain Python."""
    rng = random.Random(3)
    base = [words(rng, n) for n in (30, 40, 60, 200, 20000)]
    texts = base + [base[0], base[4], base[1] + " end", words(rng, 300) + " " + base[3][:400] + " " + words(rng, 300), None, "", ""]
    ids = [1, 2, 2, 3, None, 1, 4, 5, None, 6, 7, 7]
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.exact(spark, docs, "").collect()
    best = {}
    for i, t in zip(ids, texts, strict=True):
        best[t or ""] = max(best.get(t or "", -1), -1 if i is None else i)
    assert sorted((r["text"] or "", -1 if r["doc_id"] is None else r["doc_id"]) for r in kept) == sorted(best.items())

    def shingles(t):
        w = (t or "").split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    rows = [(r["doc_id"], r["text"]) for r in kept]
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [b if x == a else x for x in root]
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], docs.schema)
    near = corpus_pipeline.near(spark, docs, "").collect()
    order = lambda k: (rows[k][0] is None, rows[k][0] or 0)
    want = {min((k for k in range(len(rows)) if root[k] == r), key=order) for r in set(root)}
    assert sorted((r["text"] or "") for r in near) == sorted((rows[k][1] or "") for k in want) and len(near) < len(rows)

    docs = spark.createDataFrame([(r["doc_id"], r["text"], "en", "s", None) for r in near], docs.schema)
    found = corpus_pipeline.repeats(spark, docs, "").collect()
    data = [(r["text"] or "").encode() for r in near]
    places = defaultdict(list)
    for k, t in enumerate(data):
        for a in range(len(t) - 199):
            places[t[a : a + 200]].append((k, a))
    gone = [bytearray(len(t)) for t in data]
    for at in places.values():
        if len(at) > 1:
            for k, a in at:
                gone[k][a : a + 200] = b"\1" * 200
    left = [bytes(b for b, g in zip(t, m, strict=True) if not g).decode() for t, m in zip(data, gone, strict=True)]
    assert sorted(r["text"] or "" for r in found) == sorted(left) and any(any(m) for m in gone)

    docs = spark.createDataFrame([(r["doc_id"], r["text"], "en", "s", None) for r in found], docs.schema)
    packed = corpus_pipeline.pack(spark, docs, "").collect()
    room = defaultdict(list)
    for r in packed:
        room[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in room.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 1024
    import public_tokenizers
    import tokenizers

    encoder = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert sum(r["length"] for r in packed) == sum(len(encoder.encode(t, add_special_tokens=False).ids) + 1 for t in left)


def test_run_leaves_little_behind(spark, tmp_path):
    from convena.llm import common

    rows, _ = corpus()
    spark.createDataFrame([r[:5] for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    before = set(common.WRITTEN)
    corpus_pipeline.run(spark, str(tmp_path))
    left = set(common.WRITTEN) - before
    assert all("pipeline-" in x or "op8-" in x for x in left)


def test_empty_corpus(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, "").write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
    assert docs.count() == 0 and "sequence_id" in docs.columns


def test_run_reads_documents(spark, tmp_path):
    rows, _ = corpus()
    spark.createDataFrame([r[:5] for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).filter(F.col("piece") == 0).count() > 30
    assert langid.UNDETERMINED == "und"
