"""Language ID and quality posteriors against versions in plain Python, written from their definitions."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from convena.llm import langid, quality

MASK = (1 << 32) - 1


def buckets(text):
    """Of every n-gram of a folded text, three spaces before it and after."""
    folded = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in (text or "").encode())
    padded = b"   " + folded + b"   "
    for i in range(len(folded) + 3):
        for k in langid.ORDERS:
            h = (int.from_bytes(padded[i : i + k], "big") ^ (k * 0x9E3779B1 & MASK)) * 2654435761 & MASK
            yield ((h ^ h >> 15) * 2246822519 & MASK) >> 17


def plain_languages(training, texts):
    """(language, score, ambiguous) of each text."""
    languages = sorted({l for _, l in training})
    code = langid.codewords(len(languages)).tolist()
    bits = range(len(code[0]))
    counts = [defaultdict(int) for _ in languages]
    for t, l in training:
        for b in buckets(t):
            counts[languages.index(l)][b] += 1
    totals = [sum(c.values()) + langid.SMOOTHING * langid.BUCKETS for c in counts]
    likely = lambda l, b: (counts[l].get(b, 0) + langid.SMOOTHING) / totals[l]

    def weight(b, bit):
        ones = [likely(l, b) for l in range(len(languages)) if code[l][bit] > 0]
        rest = [likely(l, b) for l in range(len(languages)) if code[l][bit] < 0]
        return math.log(sum(ones) / len(ones)) - math.log(sum(rest) / len(rest)) if rest else 0.0

    def margins(t):
        found = list(buckets(t))
        return [sum(weight(b, bit) for b in found) / len(found) for bit in bits]

    own = [(languages.index(l), margins(t)) for t, l in training]
    scale = [max(sum(abs(m[bit]) for _, m in own) / len(own), 1e-9) for bit in bits]
    trust = []
    for l in range(len(languages)):
        mine = [m for i, m in own if i == l]
        row = [(sum(m[bit] * code[l][bit] > 0 for m in mine) + 1) / (len(mine) + 2) for bit in bits]
        trust.append([x / sum(row) for x in row])
    out = []
    for t in texts:
        if not any(c.isalpha() for c in t or ""):
            out.append(("und", 0.0, False))
            continue
        m = margins(t)
        distance = [sum(math.log1p(math.exp(-4 * code[l][bit] * m[bit] / scale[bit])) * trust[l][bit] for bit in bits) for l in range(len(languages))]
        order = sorted(range(len(languages)), key=lambda l: (distance[l], l))
        share = 1 / sum(math.exp(-len(bits) * (d - distance[order[0]])) for d in distance)
        out.append((languages[order[0]], share, distance[order[1]] - distance[order[0]] < langid.AMBIGUOUS))
    return out


def test_languages_from_the_definition(spark):
    rng = random.Random(2)
    letters = {"aa": "abcdefghij", "bb": "defghijklm", "cc": "ghijklmnop", "dd": "éüabcxyz"}
    say = lambda l, n: " ".join("".join(rng.choice(letters[l]) for _ in range(4)) for _ in range(n))
    training = [(say(l, 12), l) for l in letters for _ in range(12)] + [(say("aa", 5) + " " + say("bb", 5), "aa")]
    texts = [say(l, n) for l in letters for n in (1, 2, 6, 20)] + [say("aa", 3) + " " + say("bb", 3) for _ in range(12)] + ["GHI jkl! 12", "", None, "123 -", "é"]
    model = langid.fit(spark.createDataFrame(training, "text string, lang string"))
    found = langid.identify(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), model)
    got = {r["i"]: (r["lang_pred"], r["score"], r["ambiguous"]) for r in found.collect()}
    for i, (language, score, ambiguous) in enumerate(plain_languages(training, texts)):
        assert got[i][0] == language and got[i][1] == pytest.approx(score, rel=1e-3) and got[i][2] == ambiguous


def strength(groups):
    """Of (n, good, mean of the parent): moments of the shares about their parents' means."""
    v = c = w = 0.0
    for n, good, mean in groups:
        if n > 1:
            m = min(max(mean, 1e-4), 1 - 1e-4)
            v, c, w = v + n * (good / n - m) ** 2, c + m * (1 - m), w + n * m * (1 - m)
    if not w:
        return quality.STRONG
    excess = max(v - c, 0.0) / max(w - c, 1e-9)
    return min(max((1 - excess) / max(excess, 1e-9), quality.WEAK), quality.STRONG)


def test_posteriors_from_the_definition(spark):
    """Ties of ids, sites without labels, a null host: what the text alone says is taken from the result, all else is worked out again."""
    rng = random.Random(3)
    rows = []
    for i in range(400):
        host, good = rng.choice(["a", "b", "c", "d", None]), rng.random() < 0.6
        good = good if host != "a" else rng.random() < 0.1
        rows.append((i if i % 50 else 0, " ".join(rng.choice(["fine", "sound", "clear"] if good ^ (rng.random() < 0.2) else ["junk", "spam", "noise"]) for _ in range(8)), host, rng.choice(["x", "y"]), good))
    docs = spark.createDataFrame([(r[0], r[1], r[2], r[3]) for r in rows], "doc_id long, text string, source string, lang string")
    labels = [(r[0], r[4]) for r in rows if r[0] % 3 == 0]
    said = {}
    for i, good in labels:
        said[i] = said.get(i, True) and good
    found = quality.posteriors(docs, spark.createDataFrame(labels, "doc_id long, good boolean"), F.col("doc_id") % 4 != 2, "source", "lang").collect()
    trained = [(r[0], r[2], r[3]) for r in rows if r[0] % 4 != 2 and r[0] in said]
    goods = sum(said[i] for i, *_ in trained)
    base = math.log(goods / (len(trained) - goods))
    paths, hosts = defaultdict(lambda: [0.0, 0.0]), defaultdict(lambda: [0.0, 0.0])
    for r in found:
        labelled = r["doc_id"] % 4 != 2 and r["doc_id"] in said
        for sums in (paths[r["host"], r["path"]], hosts[r["host"]]):
            sums[0] += 1.0 if labelled else quality.SOFT
            sums[1] += float(said[r["doc_id"]]) if labelled else quality.SOFT * r["doc_score"]
    overall = sum(s for _, s in hosts.values()) / sum(n for n, _ in hosts.values())
    k = strength([(n, s, overall) for n, s in hosts.values()])
    host = {h: (s + k * overall) / (n + k) for h, (n, s) in hosts.items()}
    k = strength([(n, s, host[h]) for (h, _), (n, s) in paths.items()])
    path = {(h, p): (s + k * host[h]) / (n + k) for (h, p), (n, s) in paths.items()}
    assert len(found) == len(rows) and len(path) == 10
    for r in found:
        mine = path[r["host"], r["path"]]
        logit = math.log(mine / (1 - mine)) + math.log(r["doc_score"] / (1 - r["doc_score"])) - base
        assert r["host_score"] == pytest.approx(host[r["host"]]) and r["path_score"] == pytest.approx(mine)
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-logit)), rel=1e-6) and r["kept"] == (r["score"] >= 0.5)
