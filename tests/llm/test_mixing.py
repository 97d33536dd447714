import re
from collections import Counter, defaultdict

import pytest

from ledgerloom.llm import mixing


def brute_targets(sizes: dict, weights=(1, 2, 3), cap=3) -> dict:
    """Reshare the excess over the caps until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(cap * sizes[s] for s in full)
        free = sum(weight[s] for s in sizes if s not in full)
        level = rest / free if free else 0
        over = {s for s in sizes if s not in full and level * weight[s] >= cap * sizes[s]}
        if not over:
            return {s: float(cap * sizes[s]) if s in full else level * weight[s] for s in sizes}
        full |= over


def test_targets_and_totals(docs, rows):
    got = mixing.mix(docs, block=4).collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((r[0], r[3], count(r[1])) for r in rows)
    sizes: dict = defaultdict(int)
    for r in rows:
        sizes[r[3]] += count(r[1])
    want = brute_targets(sizes)
    taken: dict = defaultdict(int)
    longest: dict = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], rel=1e-12)
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r.size
        base = int(r.target / r.source_size)
        assert r.size == 0 or r.copies in (base, base + 1)
        taken[r.source] += r.taken
        longest[r.source] = max(longest[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= longest[s]


def test_close_with_even_documents(spark):
    docs = spark.range(5000).selectExpr("id as doc_id", "repeat('w ', 5 + int(id % 17)) as text", "if(id % 10 < 7, 'a', 'b') as source")
    got = mixing.mix(docs).groupBy("source", "target").sum("taken").collect()
    assert len(got) == 2 and all(abs(r["sum(taken)"] - r.target) <= 22 for r in got)


def test_reruns_agree_and_rates_hold(docs):
    one, two = (Counter(map(tuple, mixing.mix(docs).collect())) for _ in range(2))
    assert one == two


def test_hot_repeated_row(spark):
    docs = spark.range(3000).selectExpr("cast(null as long) as doc_id", "'a b c' as text", "'s' as source").unionByName(spark.range(3000).selectExpr("id as doc_id", "'x y' as text", "'t' as source"))
    got = mixing.mix(docs).groupBy("source", "target").sum("taken").collect()
    assert all(abs(r["sum(taken)"] - r.target) <= 3 for r in got)


def test_many_sources_meet_the_cap(spark):
    docs = spark.range(400).selectExpr("id as doc_id", "repeat('w ', if(id < 40, 1, 50)) as text", "if(id < 40, concat('s', id), 'z') as source")
    got = {r.source: r for r in mixing.mix(docs).collect()}
    sizes = {f"s{i}": 1 for i in range(40)} | {"z": 360 * 50}
    want = brute_targets(sizes)
    assert {s: r.target for s, r in got.items()} == pytest.approx(want)


def test_repeat_takes_the_copies(docs, rows):
    mixed = mixing.repeat(docs)
    assert mixed.columns == docs.columns
    got = Counter((r.doc_id, r.source, r.text) for r in mixed.collect())
    want: Counter = Counter()
    text = {(r[0], r[3], len((r[1] or "").split())): r[1] for r in rows}
    for r in mixing.mix(docs).collect():
        want[r.doc_id, r.source, text[r.doc_id, r.source, r.size]] += r.copies
    assert got == +want


def test_the_callers_columns(spark):
    """Columns that are called like the operator's own ones keep their values."""
    names = ["_unit", "unit", "_nth", "nth", "_copies", "copies", "_rows", "rows", "copy", "c2", "Size"]
    docs = spark.createDataFrame([(k % 50, "w " * (k % 7), f"s{k % 3}", *[f"{n} {k}" for n in names]) for k in range(120)], ", ".join(["doc_id long", "text string", "source string", *[f"`{n}` string" for n in names]]))
    mixed = mixing.repeat(docs)
    assert mixed.columns == docs.columns
    own = {r["unit"]: r for r in docs.collect()}
    rows = mixed.collect()
    assert all(r == own[r["unit"]] for r in rows)
    assert len(rows) == sum(r.copies for r in mixing.mix(docs).collect())


def test_empty(none):
    assert mixing.mix(none).count() == 0 and mixing.repeat(none).count() == 0
