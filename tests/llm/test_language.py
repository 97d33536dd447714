import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import language
from ledgerloom.llm.batches import remainder

SF = "/root/testdata/sf0.1"


def brute(scores, switch):
    """The best total over all paths, by trying every one."""
    import itertools

    n, k = scores.shape
    return max(sum(scores[i, p[i]] for i in range(n)) - switch * sum(a != b for a, b in zip(p, p[1:])) for p in itertools.product(range(k), repeat=n))


def total(scores, path, switch):
    return sum(scores[i, p] for i, p in enumerate(path)) - switch * sum(a != b for a, b in zip(path, path[1:]))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(*[st.integers(-30, 30)] * 3), min_size=1, max_size=6))
def test_path_is_best(rows):
    scores = np.array(rows, np.float32)
    model = language.Model(["a", "b", "c"], np.zeros((1, 3)), np.ones((1, 3), bool))
    for path in (model.path(scores), language.viterbi(scores, language.SWITCH)):
        assert abs(total(scores, path, language.SWITCH) - brute(scores, language.SWITCH)) < 1e-3


def corpus(spark):
    say = {"en": "the thing with that loom and this thread", "de": "der faden und die spule mit dem weberschiff", "ru": "нить и ткань на станке в доме", "el": "το νημα και το υφασμα"}
    return spark.createDataFrame([(i, say[l] + f" {i}", l) for i, l in enumerate([*say] * 40)] + [(1000, None, "en"), (1001, "x", None)], "doc_id long, text string, lang string")


def test_words_spans_and_edges(spark, none):
    model = language.train(corpus(spark))
    assert model.languages == ["de", "el", "en", "ru"]
    mixed = "the thing with that loom and this thread " * 3 + "der faden und die spule mit dem weberschiff " * 3
    texts = ["the thread", "нить и ткань", None, "", " 123 -- ", "το νημα", mixed, "日本語 テキスト", "THE THING WITH THAT"]
    docs = spark.createDataFrame([(i, t, "zz", 0.1) for i, t in enumerate(texts)], "doc_id long, text string, lang_pred string, score double")
    got = {r.doc_id: r for r in language.identify(docs, model).collect()}
    assert [got[i].lang_pred for i in range(7)] == ["en", "ru", "und", "und", "und", "el", got[6].lang_pred] and got[8].lang_pred == "en"
    assert [(s.lang, s.words) for s in got[6].spans] == [("en", 24), ("de", 24)] and got[6].score == 0.5 and got[6].lang_pred == "de"
    assert got[2].score == 0 and got[2].spans == [] and all(0 <= r.score <= 1 for r in got.values()) and got[7].lang_pred in model.languages
    assert language.identify(none, model).count() == 0
    blank = language.train(corpus(spark).limit(0))
    assert {r.lang_pred for r in language.identify(docs, blank).collect()} == {"und"}


def test_scripts():
    words = language.split(["Abc где 漢字 12 é"])
    assert [language._NAMES[s] for s in words.scripts] == ["latin", "cyrillic", "han", "common", "latin"]


def test_slices_do_not_matter(spark, monkeypatch):
    model = language.train(corpus(spark))
    words = language.split(["the thing with that", "", "der faden und"])
    whole = model.word_scores(words)
    monkeypatch.setattr(language, "_CELLS", 40)
    assert np.allclose(whole, model.word_scores(words), atol=1e-4)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    fold = remainder(language.F.col("doc_id"), 4)
    model = language.train(docs.filter(fold != 2))
    got = language.identify(docs.filter(fold == 2), model).select("lang", "lang_pred").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97


def test_long_texts(spark, monkeypatch):
    """Parts give what the whole gives, also where a path changes language, and ten million bytes take bounded memory."""
    import tracemalloc

    model = language.train(corpus(spark))
    text = "the thing with that loom and this thread " * 40 + "der faden und die spule mit dem weberschiff " * 40 + "το ΝΗΜΑΣ και"
    docs = spark.createDataFrame([(1, text), (2, " " * 300), (3, "x" * 500)], "doc_id long, text string")
    whole = {r.doc_id: (r.lang_pred, r.score, r.spans) for r in language.identify(docs, model).collect()}
    plain = model.word_scores(language.split([text]))
    for part in (1, 37, 200):
        monkeypatch.setattr(language, "PART", part)
        assert np.allclose(model.text_scores(text), plain, atol=1e-5)
    monkeypatch.undo()
    assert [s.lang for s in whole[1][2]][:2] == ["en", "de"] and whole[2][0] == "und"
    many = language.Model([f"l{i}" for i in range(20)], np.random.default_rng(0).normal(size=((1 << language.BITS) + 1, 20)).astype(np.float32), np.ones((len(language._NAMES), 20), bool))
    long = "thread of the warp " * 520_000
    tracemalloc.start()
    many.path(many.text_scores(long))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 45 * len(long)


def test_repeats_and_null_ids(spark, docs):
    """Copies get the same answer, whatever their id, and every value of the caller's own columns comes back."""
    got = language.identify(docs, language.train(corpus(spark)))
    kept = [c for c in docs.columns if c != "score"]
    rows = got.collect()
    assert sorted(repr([r[c] for c in kept]) for r in rows) == sorted(repr([r[c] for c in kept]) for r in docs.collect())
    seen: dict = {}
    for r in rows:
        assert seen.setdefault(r.text, (r.lang_pred, r.score)) == (r.lang_pred, r.score)
    assert any(r.doc_id is None for r in rows)
