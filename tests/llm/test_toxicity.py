import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from ledgerloom.llm import toxicity

SF = "/root/testdata/sf0.01"


def brute_ratio(train, text):
    """Interpolated Kneser-Ney by plain recursion over dictionaries."""
    n, d = toxicity.ORDER, toxicity.DISCOUNT

    def cut(t):
        raw = b" " * (n - 1) + t.lower().encode() + b" "
        out = []
        for i in range(len(raw) - n + 1):
            g = raw[i : i + n]
            spaces = [k for k in range(n - 1) if g[k] in b" \t\n\x0b\x0c\r"]
            out.append(b" " * spaces[-1] + g[spaces[-1] :] if spaces else g)
        return out

    counts = [Counter(), Counter()]
    for t, y in train:
        counts[y].update(cut(t))
    kinds = {n: set(counts[0]) | set(counts[1])}
    for k in range(n - 1, 0, -1):
        kinds[k] = {g[1:] for g in kinds[k + 1]}
    cont = {k: Counter(g[1:] for g in kinds[k + 1]) for k in range(1, n)}
    total, types = defaultdict(float), defaultdict(float)
    for k in cont:
        for g, c in cont[k].items():
            total[g[:-1], k] += c
            types[g[:-1], k] += 1

    def shared(g):
        if not g:
            return 1 / 256
        k = len(g)
        return (max(cont[k][g] - d, 0) + d * types[g[:-1], k] * shared(g[1:])) / total[g[:-1], k]

    def pooled(g):
        own = [c for h, c in (counts[0] + counts[1]).items() if h[:-1] == g[:-1]]
        return (max(counts[0][g] + counts[1][g] - d, 0) + d * len(own) * shared(g[1:])) / sum(own)

    def one(y, g, below):
        own = [c for h, c in counts[y].items() if h[:-1] == g[:-1]]
        return (max(counts[y][g] - d, 0) + (toxicity.SHARED + d * len(own)) * below) / (toxicity.SHARED + sum(own))

    def ratio(g):
        below = pooled(g) if g in kinds[n] else 1.0
        return math.log(one(1, g, below) / one(0, g, below))

    seen = {g[:-1] for g in kinds[n]}
    words = [0.0]
    own = cut(text)
    for i, g in enumerate(own):
        words[-1] += ratio(g) if g[:-1] in seen else 0.0
        if g[-1:] in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r") and i < len(own) - 1:
            words.append(0.0)
    middle = sorted(words)
    median = (middle[len(middle) // 2] + middle[(len(middle) - 1) // 2]) / 2
    return sum(max(0.0, w - min(0.0, median) - toxicity.EXCESS) for w in words) / (len(own) + toxicity.PRIOR)


def test_ratio_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SHARED", 2.0)
    monkeypatch.setattr(toxicity, "EXCESS", 0.25)
    rng = random.Random(2)
    say = lambda n, more: " ".join(rng.choice(["loom", "weft", "warp", "the"] + more) for _ in range(n))
    train = [(say(12, []), 0) for _ in range(6)] + [(say(12, ["vile", "rot"]), 1) for _ in range(40)] + [("", 0)]
    model = toxicity.fit(spark.createDataFrame(train, "text string, y int"))
    for text in ["vile loom", "the weft", "", "ROT zzz", "unseen words", "rot\n\tvile  vile", train[8][0]]:
        assert model.ratio(text.encode()) == pytest.approx(brute_ratio(train, text), abs=2e-5)
    assert model.ratio(b"vile loom") > 0 == model.ratio(b"the weft")


def test_every_ngram_keeps_its_score(spark, monkeypatch):
    """More n-grams than slots of any fixed table would keep apart, in one block and in several."""
    keys = np.arange(3_000_000, dtype=np.uint64) * np.uint64(7919)
    table = toxicity.Scores(keys, np.arange(len(keys)) % 1000)
    assert (table.get(keys) == np.arange(len(keys)) % 1000).all() and np.isnan(table.get(keys + np.uint64(1))).all()
    rng = random.Random(3)
    train = [("".join(rng.choice("abcdefgh ") for _ in range(300)), i % 3 == 0) for i in range(60)]
    train, said = spark.createDataFrame([(t, int(y)) for t, y in train], "text string, y int"), [train[0][0], "", "never met: xyz", "abc def"]
    whole = toxicity.fit(train)
    monkeypatch.setattr(toxicity, "BLOCK_GRAMS", 2000)
    parts = toxicity.fit(train)
    n = len(whole.grams)
    assert len(whole.blocks) == 1 and len(parts.blocks) == -(-n // 2000) > 2 and len(parts.grams) == n == toxicity.count_grams(train).count()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "doc_id int, text string")
    for model in (whole, parts):
        got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
        assert [got[i] for i in range(len(said))] == pytest.approx([whole.score(t.encode()) for t in said], abs=1e-6)


def test_scores_and_edges(spark, docs, none):
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(100)] + [(None, 1, 1), (3, None, None), (7, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(none, model).count() == 0
    assert toxicity.clean(none, labels).count() == 0
    for named in ("score", "_toxic"):  # every value of the caller's own columns comes back
        own = docs.withColumnRenamed("score", named).withColumnRenamed("n_chars", "Score" if named != "score" else "n_chars")
        kept = toxicity.clean(own, labels).collect()
        assert Counter(map(repr, kept)) == Counter(repr(r) for r in own.collect() if model.score((r.text or "").encode()) < 0.5) and 0 < len(kept)
    assert toxicity.clean(docs, labels.limit(0)).count() == docs.count()
    blank = toxicity.train(none, labels)
    assert np.isnan(blank.grams).all() and blank.score(b"x") == 0.5
    assert toxicity.train(docs, labels.limit(0)).score(b"x") == 0.5


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF.replace('0.01', '0.1')}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels, folds=5, held_out=0)
    known = toxicity.labelled(docs, toxicity.known_labels(labels, "toxic")).filter(toxicity.remainder(toxicity.F.col("doc_id"), 5) == 0)
    rows = toxicity.score(known, model).join(docs.select("doc_id", "lang"), "doc_id").select("lang", "y", "score").collect()
    assert sum((r.score >= 0.5) == (r.y == 1) for r in rows) / len(rows) > 0.95
    called = [r for r in rows if r.score >= 0.5]
    assert sum(r.y for r in called) / len(called) >= 0.8
    recall = {lang: [r.score >= 0.5 for r in rows if r.lang == lang and r.y] for lang in ("en", "de", "fr", "es")}
    assert all(recall.values()) and sum(recall["en"]) / len(recall["en"]) >= 53 / 58
    assert all(sum(own) / len(own) >= 0.5 for own in recall.values())
