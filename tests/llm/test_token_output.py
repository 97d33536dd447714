import zlib

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import simple8b, token_output
from ledgerloom.shared import scratch_path

PATH = P.path("byte_bpe_50k.json")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 60_000), st.integers(0, 2**64 - 1)), max_size=400), st.sampled_from([7, 64, 8192]))
def test_round_trip(values, block):
    words, offsets = simple8b.encode(np.array(values, np.uint64), block)
    assert simple8b.decode(words, offsets).tolist() == values
    for k in range(len(offsets) - 1):  # each block by itself
        assert simple8b.decode_block(words[offsets[k] : offsets[k + 1]]).tolist() == values[k * block : (k + 1) * block]


def test_word_counts():
    words, _ = simple8b.encode(np.ones(600, np.uint64))
    assert len(words) == 10
    words, _ = simple8b.encode(np.full(8, 30_000, np.uint64))
    assert len(words) == 2


def plain(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [0]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("ab'sé \n\t漢1.!<|>  "))), max_size=6).map(" ".join))
def test_cuts_do_not_change_ids(text):
    encoder = token_output.Encoder(PATH)
    assert encoder.encode([text])[0].tolist() == plain(text)[:-1]


def test_against_the_library(spark, docs, rows, monkeypatch):
    got = token_output.token_table(docs, PATH).collect()
    ids = {t: plain(t) for t in {r[1] for r in rows}}
    left = sorted((r[0] is not None, r[0] or 0, len(ids[r[1]]), zlib.crc32(np.array(ids[r[1]], "<u4").tobytes())) for r in rows)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == left
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    in_order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert in_order == sorted(in_order, key=lambda x: (x is not None, x or 0))


def test_files_and_empty(spark, docs, none):
    assert token_output.token_table(none, PATH).count() == 0
    path = scratch_path(spark, "own")
    token_output.write_tokens(docs, path, PATH)
    assert {"shard", "row", "offsets", "words"} <= set(spark.read.parquet(path).columns)
