from collections import defaultdict

import pytest

from ledgerloom import shared
from ledgerloom.llm import line_dedup as ld


def brute(rows, sites):
    strip = lambda x: x.strip(ld.BLANK)
    seen = defaultdict(set)
    for _, text, site in rows:
        for line in (text or "").split("\n") if text is not None else []:
            if site is not None and strip(line):
                seen[strip(line)].add(site)
    out = []
    for i, text, _ in rows:
        own = [] if text is None else text.split("\n")
        kept = [x for x in own if not strip(x) or len(seen[strip(x)]) < sites]
        out.append((str(i), None if text is None else "\n".join(kept), len(own), len(own) - len(kept)))
    return sorted(out, key=str)


ROWS = [(i, f"own line {i}\n  shared by all \t\n\nshared by {i % 3}\né {i % 2}", f"site{i % 7}") for i in range(60)]
ROWS += [(100, None, "site1"), (101, "", "site1"), (102, "shared by all", None), (103, "shared by all\nshared by all", "site9"), (None, "only\nshared by all", None), (104, "\n", "x"), (0, ROWS[0][1], "site0")]
ROWS += [(200 + i, "one site only", "site0") for i in range(30)]


@pytest.mark.parametrize("few", [10**6, 0])
@pytest.mark.parametrize("sites", [1, 3, 7, 8])
def test_against_brute_force(spark, monkeypatch, few, sites):
    monkeypatch.setattr(ld, "broadcast_if_small", lambda df: shared.broadcast_if_small(df, few))
    monkeypatch.setattr(ld, "BROADCAST_ROWS", few)
    monkeypatch.setattr(ld, "PLACES", few)
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string").repartition(3)
    got = ld.remove_boilerplate(docs, sites=sites).collect()
    assert sorted([(str(r.doc_id), r.kept, r.n_lines, r.n_removed) for r in got], key=str) == brute(ROWS, sites)


def test_the_callers_columns(spark):
    """Columns that are called like the operator's own ones keep their values."""
    names = ["row", "keys", "gone", "at", "h1", "c0", "_row", "n_sites"]
    docs = spark.createDataFrame([(*r, *[f"{n} {k}" for n in names], f"mine {k}", k) for k, r in enumerate(ROWS)], ["doc_id", "text", "source", *names, "Kept", "n_lines"])
    made = ld.remove_boilerplate(docs, sites=3).collect()
    assert sorted(repr([r[n] for n in ["doc_id", "text", "source", *names]]) for r in made) == sorted(repr([r[n] for n in ["doc_id", "text", "source", *names]]) for r in docs.collect())
    clean = ld.clean(docs, sites=3)
    assert clean.columns == docs.columns
    kept = [next(x[1] for x in brute([*ROWS[:k], (f"this {k}", *r[1:]), *ROWS[k + 1 :]], 3) if x[0] == f"this {k}") for k, r in enumerate(ROWS)]
    for r in clean.collect():
        k = int(r.row.split()[1])
        assert r.text == kept[k] and r.Kept == f"mine {k}" and r.n_lines == k and r.source == ROWS[k][2]


def test_far_from_the_threshold_a_sketch_decides(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "'everywhere' as text", "concat('s', id) as source")
    (r,) = ld.spread(docs, sites=8).collect()
    assert not r.exact and abs(r.n_sites - 4000) < 400


def test_long_text(spark):
    """Two hundred thousand lines in one text, one of them on all sites."""
    long = "\n".join(f"line {i}" if i % 1000 else "shared by all" for i in range(200_000))
    rows = [(0, long, "s0"), *[(i, "shared by all", f"s{i}") for i in range(1, 9)]]
    got = {r.doc_id: r for r in ld.remove_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string"), sites=8).collect()}
    assert got[0].n_lines == 200_000 and got[0].n_removed == 200 and got[0].kept == "\n".join(x for x in long.split("\n") if x != "shared by all")
    assert all(got[i].kept == "" and got[i].n_removed == 1 for i in range(1, 9))


def test_empty(none):
    assert ld.remove_boilerplate(none).count() == 0
