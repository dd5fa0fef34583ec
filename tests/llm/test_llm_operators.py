"""Operators for training text against brute-force versions, with nulls, blanks, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from convena.llm import ann, block_names, bpe, common, jaccard_join, langid, maxent, packing, quality, suffixes, url_filter

tokenizers = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string"


def words(rng, n, vocabulary=200):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))



def brute_components(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)] + [(50, 51), (51, 52)]])
def test_components(spark, edges):
    got = {r["_node"]: r["_root"] for r in common.components(spark.createDataFrame(edges, "_a long, _b long"), "t").collect()}
    assert got == {k: v for k, v in brute_components(edges).items() if any(a != b for a, b in edges)}


# Language ID


def texts_of(rng, letters, n):
    return [(i, " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(20))) for i in range(n)]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 12, 40])
def test_codewords_differ(n):
    code = langid.codewords(n)
    assert set(np.unique(code)) <= {-1.0, 1.0}
    assert n == 1 or len({tuple(x) for x in code}) == n and (np.abs(code.sum(axis=0)) < n).all()


def test_language_id(spark):
    rng = random.Random(1)
    rows = [(i, t, lang) for lang, letters in (("aa", "abcde"), ("bb", "defgh"), ("cc", "éèçüö")) for i, t in texts_of(rng, letters, 40)]
    df = spark.createDataFrame([*rows, (99, None, "aa"), (98, "abc", None)], "doc_id long, text string, lang string")
    model = langid.fit(df.filter("doc_id % 4 <> 2 or doc_id > 90"))
    assert model.languages == ["aa", "bb", "cc"]
    odd = [(1000, None, "x", 1.0), (1001, "", "x", 1.0), (1002, "12 .. 3", "x", 1.0), (1003, "abcab " * 30000, "x", 1.0), (1003, "abcab " * 30000, "x", 1.0)]
    held = [(i, t, lang, 0.0) for i, t, lang in rows if i % 4 == 2]
    got = langid.identify(spark.createDataFrame(held + odd, "doc_id long, text string, lang string, SCORE double"), model).collect()
    assert [r["lang_pred"] for r in got[: len(held)]] == [r["lang"] for r in got[: len(held)]]
    assert [r["lang_pred"] for r in got[len(held) :]] == ["und", "und", "und", "aa", "aa"]
    assert all(0 <= r["score"] <= 1 for r in got) and [r["score"] for r in got[len(held) : len(held) + 3]] == [0, 0, 0]
    assert langid.identify(df.limit(0), model).count() == 0 and langid.fit(df.limit(0)) is None
    assert {r["lang_pred"] for r in langid.identify(df, None).collect()} == {"und"}


def test_two_equal_languages_are_ambiguous(spark):
    df = spark.createDataFrame([(t, lang) for lang in ("aa", "bb") for t in ("abc def", "ghi")], "text string, lang string")
    assert all(r["ambiguous"] for r in langid.identify(df, langid.fit(df)).collect())


# URL filters


def brute_verdict(url, rules):
    rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host) :].split("?")[0].split("#")[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path) and host]
    best = max(fits, key=lambda r: (len(r.host + r.path), len(r.host), r.verdict == "block"), default=None)
    return host, path, best and best.name, best.verdict if best else "allow"


def test_url_filter(spark):
    rng = random.Random(2)
    hosts = ["net", "a.net", "b.a.net", "anet", "x.a.net", "org", "a.org", "É.net", "a.net:80", ".net", "a..net"]
    paths = ["", "/", "/en/", "/en/a", "/enx", "/de/"]
    rules = [url_filter.Rule(h, p, v) for h, p, v in (("net", "/", "block"), ("a.net", "/en/", "allow"), ("a.net", "/", "block"), ("x.a.net", "/en/a", "block"), ("org", "/de/", "allow"), ("b.a.net", "", "allow"))]
    urls = [f"{rng.choice(['http', 'HTTPS'])}://{rng.choice(hosts).upper() if rng.random() < 0.3 else rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?q=/en/', '#x'])}" for _ in range(400)]
    urls += [None, "", "no scheme", "://", "mailto:a", "http://a.net/" + "y" * 100000] + ["http://hot.a.net/en/"] * 300
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("Host", F.lit("old"))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(df, rules).collect()}
    assert got == {i: brute_verdict(u, rules) for i, u in enumerate(urls)}
    assert url_filter.judge(df.limit(0), rules).count() == 0
    assert {r["verdict"] for r in url_filter.judge(df, []).collect()} == {"allow"}


# Exact de-duplication


@pytest.mark.parametrize("block", [1000, 2048])
def test_exact_groups(spark, block):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.randrange(12)))) for i in range(150)] + [(200 + i, "xyxyxyxyé" * 300) for i in range(40)]
    rows += [(300, None), (301, ""), (None, "ab"), (400, "z" * 50001), (401, "z" * 50000), (402, "z" * 50001), (500, "same"), (500, "same")]
    df = spark.createDataFrame(rows, DOCS).withColumn("kept", F.lit("own"))
    by = defaultdict(list)
    for i, t in rows:
        by[t or ""].append(i)
    got = block_names.exact_groups(df, block_bytes=block).collect()
    assert len(got) == len(rows)
    kept = Counter()
    texts = {hashlib.sha256(t.encode()).hexdigest(): t for t in by}
    for r in got:
        ids = by[texts[r["text_sha256"]]]
        assert r["keep_id"] == max((i for i in ids if i is not None), default=None) and r["group_size"] == len(ids) and r["doc_id"] in ids
        kept[r["text_sha256"]] += r["kept"]
    assert set(kept.values()) == {1}
    left = block_names.drop_copies(df)
    assert left.columns == df.columns and left.count() == len(by)
    assert block_names.exact_groups(df.limit(0)).count() == 0


def test_block_names_recur_through_levels(spark):
    texts = ["abababab", "abababab", "ababab", "abababac", "ab", "ab", "abab", "", ""]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in block_names.exact_groups(df, block_bytes=2).collect()}
    assert got == {i: (max(j for j, x in enumerate(texts) if x == t), texts.count(t)) for i, t in enumerate(texts)}


# Quality


def test_quality(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        bad = i % 3 == 0
        body = words(rng, 30) + (" awful" if bad else " fine")
        rows.append((i, body, "big" if i < 500 else f"s{i % 5}", "en", "x"))
        if i % 2:
            labels.append((i, not bad))
    rows += [(None, "a", "big", "en", "x"), (1000, None, None, None, "x"), (1001, "", "new", "en", "x"), (1, "again", "big", "en", "x"), (1002, "fine " * 60000, "big", "en", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, score string")
    said = spark.createDataFrame([*labels, (None, True), (3, None)], "doc_id long, good boolean")
    got = quality.posteriors(docs, said, F.lit(True), "source", "lang").collect()
    assert len(got) == len(rows) and all(0 < r["score"] < 1 for r in got)
    right = [r["kept"] == (r["doc_id"] % 3 != 0) for r in got if r["doc_id"] is not None and r["doc_id"] < 600 and r["doc_id"] != 1]
    assert sum(right) / len(right) > 0.95
    none = quality.posteriors(docs, said.limit(0), F.lit(True), "source", "lang").collect()
    assert all(r["kept"] and r["score"] == 0.5 for r in none)
    assert quality.posteriors(docs.limit(0), said, F.lit(True), "source", "lang").count() == 0


def test_sparse_sites_shrink_toward_the_global_share(spark):
    rows = [(i, f"w{i}", "large", "en") for i in range(200)] + [(i, f"w{i}", f"s{i}", "en") for i in range(200, 210)] + [(i, f"w{i}", "other", "en") for i in range(300, 400)]
    said = [(i, True) for i in range(200)] + [(i, False) for i in range(200, 210)] + [(i, i % 2 == 0) for i in range(300, 400)]
    got = quality.posteriors(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), spark.createDataFrame(said, "doc_id long, good boolean"), F.lit(True), "source", "lang").collect()
    by = {r["host"]: r["host_score"] for r in got}
    assert by["large"] > by["other"] and 0.0 < by["s200"] < 0.8


# Repeated substrings


def brute_removed(texts):
    seen = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = [True] * 200
        out.append((bytes(b for b, g in zip(t, gone, strict=True) if not g), sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1])), sum(gone)))
    return out


def repeated(rng):
    passage, other = words(rng, 60), "é" + words(rng, 80, 20)
    texts = [words(rng, 30) + " " + passage + " " + words(rng, rng.randrange(60)) for _ in range(25)] + [passage, passage, other + " x " + other, "ab" * 300, "a" * 450, "", None, passage[:199], "ñ" * 150, "ñ" * 150]
    return texts + [words(rng, 100)[:300] for _ in range(10)] + [passage[i : i + 230] for i in range(0, 60, 7)]


@pytest.mark.parametrize("hot", [2000, 2])
def test_remove_repeats(spark, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT", hot)
    texts = repeated(random.Random(5))
    df = spark.createDataFrame([(i, t, "own") for i, t in enumerate(texts)], "doc_id long, text string, Spans string")
    got = {r["doc_id"]: (bytes(r["kept"]), len(r["spans"]), sum(s["end"] - s["start"] for s in r["spans"])) for r in suffixes.remove_repeats(df).collect()}
    want = brute_removed([(t or "").encode() for t in texts])
    assert got == dict(enumerate(want)) and sum(w[2] for w in want) > 2000
    assert {r["doc_id"]: r["n_bytes"] for r in suffixes.remove_repeats(df).collect()} == {i: len((t or "").encode()) for i, t in enumerate(texts)}


def test_remove_repeats_keeps_whole_characters(spark):
    df = spark.createDataFrame([(0, "a" + "é" * 120 + "b"), (1, "c" + "é" * 120 + "d"), (2, "x")], DOCS)
    got = {r["doc_id"]: bytes(r["kept"]).decode() for r in suffixes.remove_repeats(df, characters=True).collect()}
    assert got == {0: "ab", 1: "cd", 2: "x"}
    assert suffixes.remove_repeats(df.limit(0)).count() == 0


def test_contexts_cover_every_window_once():
    rng = random.Random(6)
    texts = [words(rng, n).encode() for n in (10, 60, 400, 90000)]
    seen = defaultdict(list)
    for h, _, row, pos, run in suffixes.contexts_of(list(range(4)), texts):
        for r, p, k in zip(row.tolist(), pos.tolist(), run.tolist(), strict=True):
            seen[r] += range(p, p + k)
    assert {r: sorted(x) for r, x in seen.items()} == {r: list(range(len(t) - 199)) for r, t in enumerate(texts) if len(t) >= 200}


@pytest.mark.parametrize("alphabet", [b"a", b"ab", b"abcdefgh ", bytes(range(245))])
def test_two_stage_sort(alphabet):
    rng = random.Random(7)
    base = [bytes(rng.choice(alphabet) for _ in range(700)) for _ in range(3)]
    contexts = {}
    for _ in range(40):
        run = rng.randint(1, 169)
        at = rng.randint(0, 700 - run - 199)
        x = bytearray(rng.choice(base)[at : at + run + 199])
        if rng.random() < 0.5:
            x[rng.randrange(len(x))] = rng.choice(alphabet)
        contexts[bytes(x)] = run
    many = [rng.random() < 0.1 for _ in contexts]
    seen = Counter()
    for (x, run), m in zip(contexts.items(), many, strict=True):
        for i in range(run):
            seen[x[i : i + 200]] += 1 + m
    got = suffixes.repeated_windows(list(contexts), list(contexts.values()), many)
    assert all((g == [seen[x[i : i + 200]] > 1 for i in range(run)]).all() for g, (x, run) in zip(got, contexts.items(), strict=True))


# Language-model scores


def test_scores(spark):
    rng = random.Random(8)
    pairs = {f"w{i}": f"v{i}" for i in range(300)}
    texts = [" ".join(y for w in words(rng, 20, 300).split() for y in (w, pairs[w])) for _ in range(300)] + ["", None, " \t\n", "Unseen WORDS here", "x" * 100000, "é W1 w1"]
    df = spark.createDataFrame([(i, t, i % 7 != 2, "own") for i, t in enumerate(texts)], "doc_id long, text string, train boolean, Score string")
    got = {r["doc_id"]: r for r in maxent.score(df, F.col("train")).collect()}
    toks = [[*(t or "").encode().lower().split(), None] for t in texts]
    c = Counter(w for i, t in enumerate(toks) for w in t if i % 7 != 2)
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(toks):
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(w in c for w in t), n)
        assert r["base_score"] == pytest.approx(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in t), rel=1e-9)
        assert r["score"] < 0
    held = [i for i in range(300) if i % 7 == 2]
    assert sum(got[i]["score"] for i in held) > sum(got[i]["base_score"] for i in held)
    empty = maxent.score(df, F.lit(False)).collect()
    assert len(empty) == len(texts) and all(r["train_tokens"] == 0 and r["n_known"] == 0 for r in empty)
    assert maxent.score(df.limit(0), F.col("train")).count() == 0


def fitted(texts):
    """A model trained on the texts by one step for each of them, and its counts."""
    found = maxent.tokens(texts)
    h, first, n = np.unique(found.hashes, return_index=True, return_counts=True)
    order = np.lexsort((h.view(np.int64), -n))
    h, n, form = h[order], n[order], found.form[first][order]
    sums, depth = np.zeros((maxent.FORMS, 16)), 4
    for x, k, f in list(zip(h.tolist(), n.tolist(), form.tolist(), strict=True))[maxent.CLASSES * maxent.WORDS :]:
        sums[f, x >> (64 - depth)] += k
    model = maxent.Model(h, n, int(n.sum()), len(n), sums)
    state = maxent.new_state(model)
    for t in texts:
        maxent.train_step(model, state, maxent.tokens([t]))
    return model, dict(zip(h.tolist(), n.tolist(), strict=True))


def test_probabilities_sum_to_one():
    texts = [words(random.Random(9 + i), 50, 3000).encode() for i in range(60)]
    model, counts = fitted(texts)
    found = maxent.tokens(texts[:1])
    rank = model.ranks(found)
    symbol, _ = model.symbols(found, rank)
    assert model.class_probabilities(model.features(symbol, found.starts)).sum(axis=1) == pytest.approx(1, abs=1e-5)
    contexts = model.contexts(found, rank)[:, 7:8]
    known = np.array(sorted(counts, key=lambda h: (-counts[h], np.array(h, np.uint64).view(np.int64))), dtype=np.uint64)
    for c in range(maxent.CLASSES):  # all words of a common class
        size = min(max(len(known) - c * maxent.WORDS, 0), maxent.WORDS)
        if size:
            of, sym = np.full(size, c), c * maxent.WORDS + np.arange(size)
            assert np.exp(model.halves(np.repeat(contexts, size, axis=1), sym, of, sym * 0)).sum() == pytest.approx(1, abs=1e-5)
    for c in range(maxent.CLASSES, maxent.OUT):  # all leaves of an open class; a leaf's size is the counts of its words and one for unknown ones
        of, leaf = np.full(16, c), np.arange(16)
        assert np.exp(model.halves(np.repeat(contexts, 16, axis=1), of * 0, of, leaf)).sum() == pytest.approx(1, abs=1e-5)


def plain_score(model, counts, text):
    """The score from the definition, token by token in plain Python."""
    mask = (1 << 64) - 1

    def mixed(h):
        h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & mask
        h = (h ^ h >> 27) * 0x94D049BB133111EB & mask
        return h ^ h >> 31

    def row(key):
        h = (key + 1) * 0x9E3779B97F4A7C15 & mask
        return ((h ^ h >> 32) * 0xBF58476D1CE4E5B9 & mask) >> (65 - maxent.ROWS.bit_length())

    found = maxent.tokens([text])
    place = {int(h): int(r) for h, r in zip(model.cached, model.rank, strict=True)}
    total, symbols, own = 0.0, [], []
    for h, form in zip(found.hashes.tolist(), found.form.tolist(), strict=True):
        back = [(symbols[-k] + 1 if len(symbols) >= k else 0) for k in (1, 2, 3)]
        rows = [row(back[0] << 2), row(back[1] << 2 | 1), row(back[2] << 2 | 2), row((back[0] << 20 | back[1]) << 2 | 3)]
        rank = place.get(h, 1 << 30)
        common = rank < maxent.CLASSES * maxent.WORDS
        c = rank // maxent.WORDS if common else maxent.CLASSES + form
        logits = [float(model.class_bias[o] + sum(model.class_weights[r][o] for r in rows)) for o in range(maxent.OUT)]
        total += logits[c] - np.log(sum(np.exp(x) for x in logits))
        contexts = [mixed(((own[-k] if len(own) >= k else 1) + ((k - 1) << 40)) & mask) for k in (1, 2)]
        depth = maxent.WORDS.bit_length() - 1 if common else model.depth
        way = rank % maxent.WORDS if common else h >> (64 - depth)
        base = c * maxent.WORDS if common else maxent.CLASSES * maxent.WORDS + ((c - maxent.CLASSES) << depth)
        for level in range(depth):
            node = base + (1 << level) + (way >> (depth - level))
            z = float(model.half_bias[node]) + sum(float(model.half_weights[(x + node * 0x9E3779B97F4A7C15 & mask) >> (64 - model.bits)]) for x in contexts)
            total -= np.log1p(np.exp(-z if way >> (depth - level - 1) & 1 else z))
        if not common:
            total += np.log(counts.get(h, 1) / float(model.leaf_size[form, way]))
        symbols.append(rank if common else maxent.CLASSES * maxent.WORDS + form)
        own.append(h if rank < maxent.CONTEXTS else form + 2)
    return total / np.log(10)


def test_score_from_the_definition(spark):
    texts = [words(random.Random(19 + i), 60, 4000) for i in range(80)]
    model, counts = fitted([t.encode() for t in texts[:60]])
    batch = pa.RecordBatch.from_arrays([pa.array(range(80)), pa.array([None] * 80, pa.string()), pa.array(texts)], names=["_rid", "_own", "_text"])
    got = [x for b in maxent._scorer(model)([batch]) for x in b.column("_score").to_pylist()]
    assert got == pytest.approx([plain_score(model, counts, t.encode()) for t in texts], rel=1e-4)


def test_commonest(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([1, 2, 5, 300, 301, 5000 + i])) for i in range(400)]
    h, n = maxent.commonest(spark.createDataFrame(rows, "_h long, _n long"), 150)
    assert len(h) <= 150 and n.tolist() == sorted((x for _, x in rows), reverse=True)[: len(h)]
    assert all(x < n[-1] for i, x in rows if i not in set(h.tolist()))
    assert len(maxent.commonest(spark.createDataFrame([(i, 1) for i in range(10)], "_h long, _n long"), 5)[0]) == 0


# Jaccard join


def brute_links(texts, n, part):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    return sets, [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= part * len(sets[i] | sets[j])]


def near(rng):
    base = [words(rng, n, 5000).split() for n in (1, 2, 3, 8, 20, 40, 120, 400)]
    texts = []
    for b in base:
        for _ in range(12):
            w = list(b)
            for _ in range(rng.randrange(1 + len(w) // 15)):
                w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
            texts.append(" ".join(w[rng.randrange(2) if len(w) > 30 else 0 :]))
    return texts + [texts[3].upper(), texts[-1] + "\n", "", None, "  ", "a b", "b a", "x " * 30000]


@pytest.mark.parametrize(("n", "part"), [(3, 90), (5, 80), (2, 50)])
@pytest.mark.parametrize("small", [False, True])
def test_near_groups(spark, monkeypatch, n, part, small):
    if small:
        monkeypatch.setattr(jaccard_join, "REGION_SHINGLES", 300)
    texts = near(random.Random(10))
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    sets, edges = brute_links(texts, n, part)
    reach = brute_components(edges)
    degree = Counter(x for e in edges for x in e)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in jaccard_join.near_groups(df, n, jaccard_join.Threshold(part, 100)).collect()}
    assert got == {i: (len(s), reach.get(i, i), degree[i]) for i, s in enumerate(sets)}
    assert len(edges) > 50


@pytest.mark.parametrize("part", [40, 50, 80, 90])
def test_join_region(part):
    rng = random.Random(part)
    base = [rng.sample(range(5000), k) for k in (1, 2, 30, 60, 60, 200)]
    sets = {tuple(sorted({*rng.sample(b, max(len(b) - rng.randrange(1 + len(b) // 3), 1)), *(rng.randrange(5000) for _ in range(rng.randrange(1 + len(b) // 5)))})) for b in base for _ in range(70)}
    arrays = [np.array(x, np.uint64) for x in sets]
    prints, weights = [b"%06d" % rng.randrange(10**6) + str(i).encode() for i in range(len(arrays))], [rng.randrange(1, 4) for _ in arrays]
    home, side = [rng.random() < 0.7 for _ in arrays], [rng.randrange(3) for _ in arrays]
    for sides in (None, side):
        links, edges = Counter(), []
        for i, a in enumerate(map(set, sets)):
            for j, b in enumerate(list(map(set, sets))[:i]):
                if 100 * len(a & b) >= part * len(a | b) and home[i if prints[i] < prints[j] else j] and (not sides or sides[i] == 0 or sides[j] == 0 or sides[i] != sides[j]):
                    links[i] += weights[j]
                    links[j] += weights[i]
                    edges.append((i, j))
        reach = brute_components(edges)
        least = {r: min(prints[i] for i in reach if reach[i] == r) for r in reach.values()}
        got = jaccard_join.join_region(prints, weights, arrays, home, jaccard_join.Threshold(part, 100), sides)
        assert len(edges) > 8 and sorted(got) == sorted((prints[i], least[reach[i]], links[i]) for i in links)


def test_parting_goes_on(spark, monkeypatch):
    """Clusters within a cluster: each level of pivots makes regions smaller, until they fit a task."""
    monkeypatch.setattr(jaccard_join, "REGION_SHINGLES", 2500)
    monkeypatch.setattr(jaccard_join, "PIVOTS", 3)
    parted = []
    once = jaccard_join._parted
    monkeypatch.setattr(jaccard_join, "_parted", lambda big, t: parted.append(1) or once(big, t))
    rng = random.Random(4)
    # Two families of three groups: groups of a family share half their shingles.
    pools = [[f * 10000 + x for x in range(50)] + [f * 10000 + 1000 * (g + 1) + x for x in range(50)] for f in range(2) for g in range(3)]
    pools[2], pools[3] = pools[3], pools[2]  # so that the three pivots are of both families
    sets = [np.unique(np.array(rng.sample(pool, 97), np.uint64)) for pool in pools for _ in range(10)]
    rows = [(1, b"%05d" % i, 1, s.tobytes(), True) for i, s in enumerate(sets)]
    t = jaccard_join.Threshold(90, 100)
    got = defaultdict(int)
    for r in jaccard_join._links(spark.createDataFrame(rows, jaccard_join.MEMBER), t).collect():
        got[bytes(r["_set"])] += r["_links"]
    own = [set(s.tolist()) for s in sets]
    want = {b"%05d" % i: sum(100 * len(a & b) >= 90 * len(a | b) for j, b in enumerate(own) if j != i) for i, a in enumerate(own)}
    assert dict(got) == {k: v for k, v in want.items() if v} and sum(want.values()) > 100 and len(parted) > 1


def test_near_groups_of_odd_rows(spark):
    t = jaccard_join.Threshold(90, 100)
    df = spark.createDataFrame([(None, "a b c d"), (5, "A b c d"), (5, "a b c d"), (7, ""), (7, None)], DOCS).withColumn("component_id", F.lit("own"))
    got = sorted((str(r["doc_id"]), r["component_id"], r["n_links"]) for r in jaccard_join.near_groups(df, 3, t).collect())
    assert got == [("5", 5, 2), ("5", 5, 2), ("7", 7, 0), ("7", 7, 0), ("None", 5, 2)]
    left = jaccard_join.drop_near_copies(df, 3, t)
    assert left.columns == df.columns and sorted(str(r["doc_id"]) for r in left.collect()) == ["5", "7", "7"]
    assert jaccard_join.near_groups(df.limit(0), 3, t).count() == 0


# Packing


@pytest.mark.parametrize("seed", range(4))
def test_plans_place_every_piece(seed):
    rng = np.random.default_rng(seed)
    counts = np.zeros(1025, np.int64)
    for x in rng.integers(1, [1025, 60, 1025, 700][seed], [5000, 3000, 3, 20000][seed]):
        counts[x] += 1
    intervals, n = packing.plan(counts, 1024)
    lengths = np.repeat(np.arange(1024, 0, -1), counts[1024:0:-1])
    of = np.full(len(lengths), -1)
    for place, k, seq in intervals:
        assert (of[place : place + k] == -1).all()
        of[place : place + k] = np.arange(seq, seq + k)
    fill = np.bincount(of, weights=lengths)
    assert (of >= 0).all() and len(fill) == n and 0 < fill.min() and fill.max() <= 1024
    assert n <= 1.02 * lengths.sum() / 1024 + 2
    assert packing.plan(np.zeros(1025, np.int64), 1024) == ([], 0)


def test_ids_are_those_of_the_library():
    tokens = packing.Tokens(tokenizers.path("byte_bpe_50k.json"))
    assert tokens.fast is not None
    rng = random.Random(11)
    letters = [chr(c) for c in range(256)] + list("  \n\n'stabc123é\u0085 ")
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(30))) for _ in range(3000)] + ["", "<|endoftext|>", "日本語 テキスト", "a" * 5000, "œuf"]
    assert all(np.frombuffer(tokens.encode(t), "<u4").tolist() == tokens.tokenizer.encode(t, add_special_tokens=False).ids for t in texts)


def test_pack(spark):
    rng = random.Random(12)
    texts = [words(rng, rng.randrange(400)) for _ in range(120)] + ["", None, words(rng, 5000), "same", "same"]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS).withColumn("offset", F.lit("own"))
    path = tokenizers.path("byte_bpe_50k.json")
    tokens = packing.Tokens(path)
    rows = packing.pack(df, path, 2, 256, with_ids=True).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    for i, t in enumerate(texts):
        ids = np.frombuffer(tokens.encode(t or ""), "<u4").tolist() + [2]
        pieces = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(len(pieces))) and sum(r["length"] for r in pieces) == len(ids)
        assert len(pieces) == 1 or all(r["length"] == 256 for r in pieces[1:])
        for r in pieces:
            assert r["ids"] == ids[r["start"] : r["start"] + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    for parts in by_seq.values():
        parts.sort(key=lambda r: r["offset"])
        ends = np.cumsum([r["length"] for r in parts])
        assert [r["offset"] for r in parts] == [0, *ends[:-1]] and ends[-1] <= 256
    assert packing.pack(df.limit(0), path, 2, 256).count() == 0
    plain = packing.pack(df, path, 2, 256)
    assert "ids" not in plain.columns and plain.count() == len(rows)


# Nearest neighbours


def brute_nearest(vectors, q, k):
    found = sorted((float(np.sqrt(((v - vectors[q]) ** 2).sum())), i) for i, v in vectors.items() if i != q)
    return found[:k]


def test_nearest(spark):
    rng = np.random.default_rng(13)
    centres = rng.standard_normal((20, 16))
    vectors = {i: centres[i % 20] + 0.3 * rng.standard_normal(16) for i in range(3000)} | {i: np.ones(16) for i in range(3000, 3030)}
    odd = [(9000, None), (9001, []), (9002, [0.0] * 16), (9003, [float("nan")] * 16), (9004, [1.0] * 15 + [None]), (9005, [1.0] * 15 + [float("inf")]), (9006, [1.0] * 8), (None, [1.0] * 16)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()] + odd, "vec_id long, embedding array<double>").withColumn("rank", F.lit("own"))
    queries = df.filter("vec_id % 100 = 0 or vec_id = 9002")
    got = defaultdict(list)
    for r in ann.nearest(df, queries).collect():
        got[r["query_id"]].append((r["rank"], r["score"], r["vec_id"]))
    assert sorted(got) == [i for i in vectors if i % 100 == 0]
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [x[0] for x in found] == list(range(1, 11)) and [x[1:] for x in found] == sorted(x[1:] for x in found)
        want = brute_nearest(vectors, q, 10)
        hits += len({i for _, i in want} & {x[2] for x in found})
        assert all(s == pytest.approx(float(np.linalg.norm(vectors[i] - vectors[q]))) for _, s, i in found)
    assert hits / (10 * len(got)) >= 0.95
    assert [x[2] for x in got[3000]] == list(range(3001, 3011))


def test_nearest_of_few(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in ann.nearest(df, df.filter("vec_id = 0")).collect())
    assert got == [(0, 1, 2, 0.0), (0, 2, 1, 1.414214)]
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0 and ann.nearest(df, df.limit(0)).count() == 0


# Byte-level BPE


def test_bpe_is_that_of_the_rank_file(spark):
    import tiktoken

    path = tokenizers.path("byte_bpe_50k.tiktoken")
    encoder = bpe._encoder(path, tokenizers.PATTERN)
    known = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=encoder.pieces, special_tokens={})
    rng = random.Random(14)
    texts = ["".join(rng.choice(a) for _ in range(n)) for a in ("ab", "a", "abcé ", "\n \t", "日本語x", "<|endoftext|>") for n in (0, 1, 2, 3, 10, 100, 3000, 20000)]
    for t in texts:
        ids = encoder.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == known.encode_ordinary(t) and encoder.decode(ids) == t.encode()
    df = spark.createDataFrame([*enumerate(texts), (0, None), (0, None)], DOCS).withColumn("n_tokens", F.lit("own"))
    got = bpe.encode_decode(df, path, tokenizers.PATTERN, with_ids=True).collect()
    for r, t in zip(got, [*texts, "", ""], strict=True):
        ids = known.encode_ordinary(t)
        assert (r["ids"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (ids, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert bpe.encode_decode(df.limit(0), path, tokenizers.PATTERN).count() == 0


def test_bpe_forgets_and_stays_right(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 20)
    encoder = bpe.Encoder(bpe._encoder(tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN).pieces, tokenizers.PATTERN)
    text = words(random.Random(15), 500)
    assert encoder.decode(encoder.encode(text)) == text.encode() and len(encoder.words) <= 20
