import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import pieces

PATH = P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def encoder():
    return pieces.Encoder(PATH)


TEXT = st.text(st.sampled_from(list("abeinrst   \n\t1.'²▁é漢😀<s>\x00​﻿")), max_size=60)


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_ids_and_text(encoder, text):
    ids = encoder.whole(text).tolist()
    assert ids == encoder.model.library.encode(text, add_bos=True, add_eos=True)
    assert encoder.model.decode(np.array(ids)) == encoder.model.library.decode(ids)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 2), st.integers(3, 258), st.integers(131, 258), st.sampled_from([259, 260, 264, 28705]), st.integers(0, 31999)), max_size=9))
def test_any_ids_decode(encoder, ids):
    assert encoder.model.decode(np.array(ids, np.int64)) == encoder.model.library.decode(ids)


@settings(max_examples=200, deadline=None)
@given(TEXT, st.integers(1, 12))
def test_parts_do_not_change_ids(encoder, text, size):
    ids = encoder.whole(text).tolist()
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(pieces, "PART", size)
        assert encoder.whole(text).tolist() == ids


def test_without_cuts(encoder):
    """The agenda over a whole text gives what the agenda over its segments gives."""
    rng = random.Random(3)
    for _ in range(50):
        text = "".join(rng.choice("the  in ance▁nation \n") for _ in range(rng.randint(1, 300)))
        marked = pieces.MARK + text.replace(" ", pieces.MARK)
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == encoder.model.segment(marked)


def test_ties_go_left(encoder):
    # pieces of marks alone share one score
    for n in range(1, 40):
        assert encoder.whole(" " * n).tolist() == encoder.model.library.encode(" " * n, add_bos=True, add_eos=True)


def test_whole_table(docs, rows, none):
    made = pieces.ids_digest(pieces.encode_decode(docs, PATH)).collect()
    library = pieces.Model(PATH).library
    want = []
    for r in rows:
        ids = library.encode(r[1] or "", add_bos=True, add_eos=True)
        want.append((str(r[0]), r[3] or "", ids, library.decode(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()))
    assert sorted((str(r.doc_id), r.source or "", list(r.ids), r.decoded, r.ids_sha256) for r in made) == sorted(want)
    assert pieces.encode_decode(none, PATH).count() == 0


def test_clashing_columns(spark):
    own = spark.createDataFrame([("a b", "mine", "keep")], "text string, IDS string, c0 string")
    row = pieces.encode_decode(own, PATH).first()
    assert row.c0 == "keep" and row.text == "a b" and row.decoded == "a b" and list(row.ids)[:1] == [1]


def test_a_difference_is_an_error(encoder):
    ids = encoder.whole("a b")
    encoder.check(["a b"], [ids], ["a b"])
    with pytest.raises(ValueError, match="ids"):
        encoder.check(["a b"], [ids[:-1]], ["a b"])
    with pytest.raises(ValueError, match="text"):
        encoder.check(["a b"], [ids], ["a c"])
    encoder.met.append(("▁a", b"1234"))
    with pytest.raises(ValueError, match="ids"):
        encoder.check([], [], [])


def test_segments_by_themselves(spark, encoder, monkeypatch):
    """Every segment that the agenda runs on in a table is one that the library is asked for."""
    monkeypatch.setattr(encoder, "memo", {})
    encoder.met.clear()
    texts = ["Loom, (weft) and\nwarp...  x", "▁▁ a▁b", "é漢😀", "\n\n", " ", ""]
    ids = [encoder.whole(t) for t in texts]
    assert {s for s, _ in encoder.met} >= {"▁Loom", ",", "▁(", "weft", ")", "\n", "..."}
    encoder.check(texts, ids, [encoder.model.decode(i) for i in ids])
    assert not encoder.met


def test_long_texts(encoder):
    """Spaced text in parts, and half a million characters without a place to cut, equal to the library's."""
    import tracemalloc

    for text in ("the weft and   warp\n" * 60_000, "thread" * 80_000):
        assert encoder.whole(text).tolist() == encoder.model.library.encode(text, add_bos=True, add_eos=True)
    text = "thread" * 80_000
    tracemalloc.start()
    encoder.whole(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300 * len(text)


def test_other_kinds_are_refused(tmp_path):
    import sentencepiece  # noqa: F401
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(PATH, "rb") as file:
        proto.ParseFromString(file.read())
    proto.trainer_spec.model_type = proto.trainer_spec.UNIGRAM
    path = tmp_path / "other.model"
    path.write_bytes(proto.SerializeToString())
    with pytest.raises(ValueError, match="merge-type"):
        pieces.Model(str(path))


def test_the_library_decodes_every_text(spark, tmp_path):
    """What a model's file says of decoding (here of unknown pieces) shows in every row, not in one of a batch."""
    import sentencepiece  # noqa: F401
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(PATH, "rb") as file:
        proto.ParseFromString(file.read())
    kept = [p for p in proto.pieces if p.type != pieces.BYTE]
    del proto.pieces[:]
    proto.pieces.extend(kept)
    proto.trainer_spec.byte_fallback = False
    proto.trainer_spec.unk_surface = "<what>"
    path = tmp_path / "own.model"
    path.write_bytes(proto.SerializeToString())
    library = pieces.Model(str(path)).library
    said = ["weft and warp", "a \U0001f9f6\U0001f9f6 b", "\U0001f9f6", "", "the loom's \U0001f9f6 thread, twice \U0001f9f6"]
    made = {r.text: r for r in pieces.encode_decode(spark.createDataFrame([(t,) for t in said], "text string").coalesce(1), str(path)).collect()}
    for text in said:
        ids = library.encode(text, add_bos=True, add_eos=True)
        assert list(made[text].ids) == ids and made[text].decoded == library.decode(ids)
    assert made["\U0001f9f6"].decoded.count("<what>") == 1


def test_each_text_is_decoded_once_whole(encoder, monkeypatch):
    """The library gets all ids of a text at once, begin and end included."""
    asked = []

    class Library:
        def decode(self, ids):
            asked.append(list(ids))
            return "said by the library"

    texts = ["a b", "", "weft\n" * 40_000]
    ids = [encoder.whole(t) for t in texts]
    monkeypatch.setattr(encoder.model, "library", Library())
    assert [encoder.model.decode(i) for i in ids] == ["said by the library"] * 3
    assert asked == [i.tolist() for i in ids]


def test_memory_of_decoding():
    """Some 400,000 ids in a process of its own: under 60 bytes an id at the peak."""
    import subprocess
    import sys

    code = f"""
import numpy as np
from ledgerloom.llm import pieces
model = pieces.Model({PATH!r})
ids = np.tile(np.array(model.library.encode("the weft and warp, 12 threads"), "<u4"), 40_000)
model.decode(ids[:100])
status = lambda name: next(int(line.split()[1]) * 1024 for line in open("/proc/self/status") if line.startswith(name))
before = status("VmRSS")
open("/proc/self/clear_refs", "w").write("5")
assert model.decode(ids)
assert status("VmHWM") - before < 60 * len(ids), ((status("VmHWM") - before) / len(ids))
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)
