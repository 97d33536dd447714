import os
import random
import re
import subprocess
import sys
import tempfile

from ledgerloom.llm import decontaminate as d

ROOT = os.path.join(os.path.dirname(__file__), "..", "..")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, window=10):
    own, hit, found = words(text), set(), set()
    for item, t in items:
        w = words(t)
        k = min(window, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            for j in range(len(own) - k + 1):
                if own[j : j + k] == w[i : i + k]:
                    hit |= set(range(j, j + k))
                    found.add(str(item))
    return len(own), len(hit), sorted(found)


def case(spark):
    rng = random.Random(3)
    vocabulary = ["a", "bb", "the", "of", "ñandú", "x9"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(rng.choice([12, 15, 30]))) for i in range(30)] + [(100, "Ünique"), (101, "two, Words"), (102, None), (103, "--"), (104, ""), (None, say(20)), (7, say(14))]
    texts = [say(rng.randint(0, 60)) for _ in range(60)] + [None, "", "..", "two words", "TWO-WORDS ünique Ünique", items[0][1], items[1][1] + " " + items[1][1], "xx" + items[2][1], items[3][1].replace(" ", ",;\n")]
    texts += ["pre " + items[4][1][3:] + " post", say(4000)]
    extra = "items string, n_hit string, N_WORDS int, spans double, _spans int"
    return items, spark.createDataFrame(items, "item_id long, text string"), texts, spark.createDataFrame([(i, t, f"c{i}", "h", i, 0.5, -i) for i, t in enumerate(texts)], f"doc_id long, text string, {extra}")


def test_against_brute_force(spark):
    items, bench, texts, docs = case(spark)
    known = [x for x in items if x[0] is not None and x[1] is not None]
    for size in (d.BENCHMARK_BYTES, 400):  # in one block, and in several
        got = {r.doc_id: r for r in d.mark(docs, bench, block_bytes=size).collect()}
        for i, t in enumerate(texts):
            n, hit, found = brute(t, known)
            assert (got[i].n_words, got[i].n_hit, got[i]["items"]) == (n, hit, found), (i, t)


def test_clean_and_empty(spark):
    items, bench, texts, docs = case(spark)
    kept = {r.doc_id for r in d.clean(docs, bench).collect()}
    assert kept == {r.doc_id for r in d.mark(docs, bench).filter("n_hit = 0").collect()} and d.clean(docs, bench).columns == docs.columns
    for size in (d.BENCHMARK_BYTES, 400):  # every value of the caller's own columns comes back
        assert sorted(map(repr, d.clean(docs, bench, block_bytes=size).collect())) == sorted(repr(r) for r in docs.collect() if r.doc_id in kept)
    assert d.clean(docs, bench.limit(0)).count() == len(texts)
    assert d.mark(docs.limit(0), bench).count() == 0


def test_large_benchmark_in_bounded_memory():
    """A whole block and a benchmark of two: a worker's share stays under 20 bytes for each byte of it."""
    code = """
import random, resource, pickle, sys
from ledgerloom.llm import decontaminate as d
rng = random.Random(1)
vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(50_000)]
items = [(str(i), " ".join(rng.choices(vocabulary, k=1600)).encode()) for i in range(int(sys.argv[1]) // 10_400)]
open(sys.argv[2], "wb").write(pickle.dumps((d.Matcher(items, 10), items[7])))
"""
    use = """
import pickle, resource, sys
import numpy, pyarrow, pyspark.sql.functions
from ledgerloom.llm import decontaminate as d
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
matcher, (item, text) = pickle.load(open(sys.argv[1], "rb"))
words = text.split()
assert matcher.search([b"zz", *words[5:20], b"zz"]) == ([(1 + i, 11 + i) for i in range(6)], {item}), matcher.search(words[5:20])
assert matcher.search([b"zz"] * 300_000) == ([], set())
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) * 1024)
"""
    with tempfile.TemporaryDirectory() as folder:
        for size in (d.BENCHMARK_BYTES, 16 << 20):
            subprocess.run([sys.executable, "-c", code, str(size), f"{folder}/m"], cwd=ROOT, check=True)
            took = int(subprocess.run([sys.executable, "-c", use, f"{folder}/m"], cwd=ROOT, check=True, capture_output=True, text=True).stdout)
            assert took < 20 * size + (32 << 20), took / size


def test_digest():
    assert d.digest([]) == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
