import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import quality
from ledgerloom.llm.batches import remainder
from ledgerloom.llm.toxicity import known_labels, labelled

SF = "/root/testdata/sf0.1"


def plain_tokens(text: bytes) -> list[int]:
    runs, kinds = [], []
    for c in text:
        k = int(quality._KIND[c])
        if kinds and kinds[-1] == k:
            runs[-1] += bytes([c])
        else:
            runs.append(bytes([c]))
            kinds.append(k)
    out, words = [], [(run, k) for run, k in zip(runs, kinds) if k]
    for at, (run, k) in enumerate(words):
        if k == 1 and run in [r for r, _ in words[max(0, at - 2) : at]]:
            out.append(quality.AGAIN)
        else:
            h = sum(c * pow(quality._BASE, i, 1 << 64) for i, c in enumerate(run)) % (1 << 64)
            h ^= h >> 31
            out.append((h * 0xD6E8FEB86659FD93 % (1 << 64)) >> (64 - quality.BITS))
    return out


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(max_size=30), min_size=1, max_size=5))
def test_tokens(texts):
    parts = [t.encode("utf-8", "replace") for t in texts]
    word, first = quality.tokens(parts)
    assert [word[a:b].tolist() for a, b in zip(first[:-1], first[1:])] == [plain_tokens(p) for p in parts]


def test_word_vectors(spark):
    texts = ["a b c", "c b", None, "", "a"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(2)
    place, sign = quality.index_vectors()
    want = np.zeros((1 << quality.BITS, quality.DIM))
    for t in texts:
        own = plain_tokens((t or "").encode())
        for i, w in enumerate(own):
            for j in range(max(0, i - quality.REACH), min(len(own), i + quality.REACH + 1)):
                if i != j:
                    for k in range(quality.NONZERO):
                        want[w, place[own[j], k]] += sign[own[j], k]
    want /= np.maximum(1e-9, np.linalg.norm(want, axis=1, keepdims=True))
    assert np.allclose(quality.word_vectors(docs), want, atol=1e-6)


def test_network_learns_and_is_calibrated():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, quality.DIM))
    y = (x[:, 0] * x[:, 1] > 0) ^ (rng.random(2000) < 0.1)
    net = quality.fit(x, y)
    p = net.probability(x)
    assert ((p >= 0.5) == y).mean() > 0.85 and net.temperature > 0


def test_edges(spark, docs, none):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(80)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    got = quality.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert quality.score(none, model).count() == 0
    blank = quality.train(none, labels.limit(0))
    assert {r.score for r in quality.score(docs.limit(5), blank).collect()} == {0.5}


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    held = labelled(docs, known_labels(labels, "quality")).filter(remainder(quality.F.col("doc_id"), 3) == 1)
    rows = quality.score(held, model).select("y", "score").collect()
    assert sum((r.score >= 0.5) == (r.y == 1) for r in rows) / len(rows) > 0.95


def test_runs_hashed_in_parts(monkeypatch):
    """Hashes do not depend on where a text is taken apart, and a text of ten million bytes takes bounded memory."""
    import tracemalloc

    texts = ["the weft, the... weft of é漢 loom!!" * n for n in range(5)] + ["a" * 50, ""]
    for part in (1, 7, 64):
        monkeypatch.setattr(quality, "PART", part)
        word, first = quality.tokens([t.encode() for t in texts])
        assert [word[a:b].tolist() for a, b in zip(first[:-1], first[1:])] == [plain_tokens(t.encode()) for t in texts]
    monkeypatch.undo()
    text = b"threads of warp, and weft " * 400_000
    vectors = np.random.default_rng(0).normal(size=(1 << quality.BITS, quality.DIM)).astype(np.float32)
    tracemalloc.start()
    quality.pool(vectors, [text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 26 * len(text)


def test_pool_against_plain_means():
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(1 << quality.BITS, quality.DIM))
    texts = ["a b a c, c!", "", "   ", "one", "x " * 300]
    want = [np.mean([vectors[w] for w in own], axis=0) if (own := plain_tokens(t.encode())) else np.zeros(quality.DIM) for t in texts]
    assert np.allclose(quality.pool(vectors, [t.encode() for t in texts]), want)


def test_the_callers_columns(spark, docs):
    """Every value of the caller's own columns comes back, but for the one that is called like the new one."""
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(80)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    kept = [c for c in docs.columns if c != "score"]
    got, want = quality.score(docs, model), docs.collect()
    assert got.columns == [*kept, "score"]
    assert sorted(repr([r[c] for c in kept]) for r in got.collect()) == sorted(repr([r[c] for c in kept]) for r in want)
