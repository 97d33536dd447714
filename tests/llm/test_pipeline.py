import os
import sys
import zlib
from collections import Counter

import numpy as np
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", ".."))
import corpus_pipeline as cp  # noqa: E402

from ledgerloom.llm import decontaminate, mixing, simhash, toxicity  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    """Every stage's input and output, written and read again."""
    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in cp.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF).write.parquet(path)
        seen.append((docs, spark.read.parquet(path)))
        docs = seen[-1][1]
    return seen


def ids(df):
    return Counter(r.doc_id for r in df.select("doc_id").collect())


def test_filters(spark, staged):
    (d0, d1), (_, d2), (_, d3), *_ = staged
    model = toxicity.train(d0, spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids(d1) == Counter(r.doc_id for r in d0.collect() if model.score((r.text or "").encode()) < 0.5)
    texts = {r.doc_id: r.text for r in d1.collect()}
    prints = {i: simhash.fingerprint(t.encode()) & (1 << 64) - 1 for i, t in texts.items()}
    up = {i: i for i in prints}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3:
                lo, hi = sorted((root(a), root(b)))
                up[hi] = lo
    assert ids(d2) == Counter(i for i in up if root(i) == i)
    matcher = decontaminate.Matcher([(str(r.item_id), r.text.encode()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()], 10)
    assert ids(d3) == Counter(r.doc_id for r in d2.collect() if not matcher.search(decontaminate.plain_words(r.text.encode()))[0])
    assert all(d.columns == d0.columns for d in (d1, d2, d3))


def test_mix_and_tokens(spark, staged):
    (d3, d4), (_, out) = staged[3], staged[4]
    copies = {r.doc_id: r.copies for r in mixing.mix(d3).collect()}
    assert ids(d4) == +Counter(copies)
    from tokenizers import Tokenizer

    whole, at = Tokenizer.from_file(cp.TOKENIZER), 0
    want = []
    for r in sorted(d4.collect(), key=lambda r: r.doc_id):
        own = [*whole.encode(r.text, add_special_tokens=False).ids, 0]
        want.append((r.doc_id, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
        at += len(own)
    assert sorted(map(tuple, out.select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == sorted(want)


def test_run(spark, staged):
    assert Counter(map(tuple, cp.run(spark, SF).collect())) == Counter(map(tuple, staged[-1][1].collect()))


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES])
def test_odd_rows(spark, docs, none, name):
    """Nulls, empty and long texts, repeated rows and columns of clashing names: every stage takes and keeps them."""
    stage = dict(cp.STAGES)[name]
    out, given = stage(spark, docs, SF), Counter(map(tuple, docs.collect()))
    if name == "token_ids":
        assert Counter(r.doc_id for r in out.collect()) == Counter(r.doc_id for r in docs.select("doc_id").collect())
        assert stage(spark, none, SF).count() == 0
        return
    assert out.schema == docs.schema
    kept = Counter(map(tuple, out.collect()))
    assert kept and set(kept) <= set(given)
    if name == "mix_sources":
        assert all(n <= 3 * given[r] for r, n in kept.items())
    else:
        assert not kept - given
    assert stage(spark, none, SF).count() == 0
