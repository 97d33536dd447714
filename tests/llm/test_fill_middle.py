import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.llm import fill_middle

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def by_hand(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output) as the contract words it."""
    text = text or ""
    units = UNITS.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    n = len(units)
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def arranged(texts, ids):
    made = fill_middle.arrange([t.encode() for t in texts], ids, 42, 50, 80)
    return list(zip(made["n"], made["form"], made["prefix_chars"], made["middle_chars"], [o.decode() for o in made["output"]], strict=True))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("ab é漢😀\n\t\x0b\x1c\xa0<PSM>")), max_size=40), min_size=1, max_size=12), st.integers(-5, 10**12))
def test_texts(texts, first):
    ids = list(range(first, first + len(texts)))
    assert arranged(texts, ids) == [by_hand(i, t) for i, t in zip(ids, texts, strict=True)]


@pytest.mark.parametrize("block", [5, 8, 64])
def test_lanes(monkeypatch, block):
    """Characters, runs of white space and sentinels that cross the ends of lanes."""
    monkeypatch.setattr(fill_middle, "BLOCK", block)
    texts = ["é漢😀 " * n + "<" * (n % 7) + "x  \n" * (n % 5) for n in range(60)] + ["a" * n + "<P>" + "b" * n for n in range(20)]
    assert arranged(texts, list(range(len(texts)))) == [by_hand(i, t) for i, t in enumerate(texts)]


def test_sentinels():
    scan = fill_middle.Scan([b"<P>", b"<<P>>", b"<P", b"< P>", b"<PS>", b"<S><M><P>", b"<p>", b""])
    assert scan.sentinels.tolist() == [1, 1, 0, 0, 0, 3, 0, 0]
    assert scan.units.tolist() == [1, 1, 1, 2, 1, 1, 1, 0]


def test_whole_table(docs, rows):
    made = fill_middle.transform(docs)
    assert made.columns == [*docs.columns, "n", "form", "prefix_chars", "middle_chars", "output"]
    told = made.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    seen = sorted((str(r.doc_id), r.text or "", r.source or "", r.n, r.form, r.prefix_chars or 0, r.middle_chars or 0, r.output) for r in told)
    assert seen == sorted((str(x[0]), x[1] or "", x[3] or "", *[v or 0 if k in (2, 3) else v for k, v in enumerate(by_hand(x[0], x[1]))]) for x in rows)
    assert all(r.back == (r.text or "") for r in told)
    assert {r.form for r in told} == {"plain", "spm", "psm"}


def test_clashing_columns_and_empty(spark, none):
    assert fill_middle.transform(none).count() == 0
    own = spark.createDataFrame([(1, "a b c", "mine", 7)], "doc_id long, text string, Output string, c0 int")
    row = fill_middle.transform(own).first()
    assert row.c0 == 7 and row.text == "a b c" and row.output == by_hand(1, "a b c")[4]


def test_long_text():
    """A text of 10 million bytes takes a few times its size."""
    import tracemalloc

    text = "wört  x\n" * 1_200_000
    tracemalloc.start()
    assert arranged([text], [10]) == [by_hand(10, text)]
    data = text.encode()
    tracemalloc.reset_peak()
    before = tracemalloc.get_traced_memory()[0]
    fill_middle.arrange([data], [10], 42, 50, 80)
    peak = tracemalloc.get_traced_memory()[1] - before
    tracemalloc.stop()
    assert peak < 8 * len(data)
