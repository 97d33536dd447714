import os
import subprocess
import sys

import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import token_counts as tc

PATH = P.path("piece_bpe_32k.model")


def library(pieces, byte_fallback=True):
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.Unigram([(p, s) for p, s in pieces], 0, byte_fallback))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement=tc.MARK, prepend_scheme="always", split=True)
    return t


@pytest.fixture(scope="module")
def real():
    pieces = tc.vocabulary(PATH)
    return tc.Counter(pieces), library(pieces)


@settings(max_examples=300, deadline=None)
@given(text=st.text(st.sampled_from(list("abcdefgh the of in ▁é漢字🙂\n\t  XY.,'")), max_size=40))
def test_against_the_library(real, text):
    counter, whole = real
    assert tc.count_text(counter, text, {}) == len(whole.encode(text, add_special_tokens=False).ids)


# ties on purpose: few scores, many ways to cut a text
TIED = [("<unk>", 0.0), ("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), ("aba", -3.0), ("▁a", -2.0), ("abab", -4.0), ("é", -3.5)]


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list("ab cé漢")), max_size=25))
def test_ties_and_unknown_runs(text):
    whole = library(TIED, byte_fallback=False)
    assert tc.count_text(tc.Counter(TIED), text, {}) == len(whole.encode(text, add_special_tokens=False).ids)


def test_table(spark, docs, rows, none, real):
    got = sorted((str(r.doc_id), r.n_tokens) for r in tc.count_tokens(docs, PATH).collect())
    want = sorted((str(r[0]), len(real[1].encode(r[1] or "", add_special_tokens=False).ids)) for r in rows)
    assert got == want and tc.count_tokens(none, PATH).count() == 0


def test_words():
    for text in ("", "▁", "a▁b", "▁▁a▁", "x" * 50 + "▁" + "y" * 50 + "▁▁z"):
        whole, tc.PART = tc.PART, 7
        try:
            assert list(tc._words(text)) == text.split("▁")
        finally:
            tc.PART = whole


def test_unbroken_text_in_bounded_memory():
    """Five million characters without a space take little beside the text."""
    code = """
import resource, sys
from ledgerloom.llm import token_counts as t
counter = t._counter(sys.argv[1])
text = "漢字かな交じり文abc9" * 400_000
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
n = t.count_text(counter, text, {})
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024, n)
"""
    out = subprocess.run([sys.executable, "-c", code, PATH], cwd=os.path.join(os.path.dirname(__file__), "..", ".."), check=True, capture_output=True, text=True).stdout.split()
    assert float(out[0]) < 100 and int(out[1]) > 400_000
