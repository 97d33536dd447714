import random
import re

import xxhash

from ledgerloom.llm import simhash
from ledgerloom.llm.components import components
from ledgerloom.shared import materialize


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def groups(nodes, pairs):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {n: root(n) for n in nodes}


def test_against_brute_force(docs, rows):
    got = simhash.near_duplicates(docs).withColumn("hex", simhash.hexadecimal(simhash.F.col("fp"))).collect()
    prints = [brute_print(r[1]) for r in rows]
    assert sorted((str(r.doc_id), r.hex) for r in got) == sorted((str(r[0]), f"{p:016x}") for r, p in zip(rows, prints))
    keys = range(len(rows))
    of = groups(keys, [(i, j) for i in keys for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3])
    least: dict = {}
    for i in keys:
        if rows[i][0] is not None:
            least[of[i]] = min(least.get(of[i], 10**9), rows[i][0])
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == sorted((str(rows[i][0]), str(least.get(of[i]))) for i in keys)


def test_links_are_whole_in_full_segments(spark, monkeypatch):
    """Clusters of flipped bits, so that segment values are shared by many fingerprints."""
    rng = random.Random(1)
    prints = set()
    for _ in range(4):
        centre = rng.getrandbits(64)
        for _ in range(150):
            x = centre
            for _ in range(rng.randint(0, 5)):
                x ^= 1 << rng.choice([rng.randrange(64), rng.randrange(32)])
            prints.add(x)
    prints |= {rng.getrandbits(64) for _ in range(200)}
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    want = {(min(a, b), max(a, b)) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    table = spark.createDataFrame([(x,) for x in signed], "fp long")
    for full in (3, 10**6):
        monkeypatch.setattr(simhash, "FULL", full)
        assert {tuple(r) for r in simhash.links(table).collect()} == want
    assert len(want) > 500


def test_probes_are_never_broadcast(spark, monkeypatch):
    """A stored table of fingerprints is small enough to broadcast by its size, its probes are not."""
    prints = materialize(spark.range(2000).select(simhash.F.xxhash64("id").alias("fp")), "prints")
    for full in (simhash.FULL, 0):
        monkeypatch.setattr(simhash, "FULL", full)
        plan = simhash.links(prints)._jdf.queryExecution().executedPlan().toString()
        built = [x.split("Join")[0].split()[-1] for x in plan.splitlines() if "Join [seg" in x and "bit_count" in x]
        assert built and set(built) == {"SortMerge"}, plan


def test_components(spark):
    rng = random.Random(5)
    chain = [(i, i + 1) for i in range(200, 260)]
    star = [(1000, 1000 + i) for i in range(1, 150)]
    other = [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(90)]
    pairs = chain + star + other + [(5, 5), (200, 201)]
    got = {r.node: r.component for r in components(spark.createDataFrame([*pairs, (None, 3)], "a long, b long")).collect()}
    nodes = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == groups(nodes, [p for p in pairs if p[0] != p[1]])
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_deduplicate(docs, rows, none):
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect() if r.doc_id is not None}
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids == sorted(i for i, c in found.items() if i == c)
    assert simhash.deduplicate(none).count() == 0 and simhash.near_duplicates(none).count() == 0


def test_repeated_ids_count_by_their_own_text(spark):
    """An id with two texts, one of them in the group of a smaller id; and two unrelated texts of one id."""
    rng = random.Random(9)
    one, two, three, four = (" ".join(str(rng.randrange(10**6)) for _ in range(60)) for _ in range(4))
    rows = [(1, one), (5, one), (5, two), (7, two), (8, three), (8, four), (8, four), (9, four), (None, one)]
    want = [(1, one), (5, two), (8, three), (8, four), (None, one)]
    for order in (rows, rows[::-1]):
        kept = simhash.deduplicate(spark.createDataFrame(order, "doc_id long, text string").repartition(4)).collect()
        assert sorted(map(tuple, kept), key=str) == sorted(want, key=str)


def test_the_callers_columns(spark):
    """Columns that are called like the operator's own ones keep their values, with and without repeated ids."""
    names = ["_gone", "gone", "again", "fp", "root", "print", "id", "n", "c1", "component_id", "FINGERPRINT"]
    texts = ["a b c d e", "a b c d e", "x y z", "x y z", None, "", "k l m n", "o p q"]
    for ids in (range(8), [0, 0, 2, 2, 4, 4, 6, 6]):
        docs = spark.createDataFrame([(i, t, *[f"{n} {k}" for n in names]) for k, (i, t) in enumerate(zip(ids, texts))], ", ".join(["doc_id long", "text string", *[f"`{n}` string" for n in names]]))
        kept = simhash.deduplicate(docs)
        assert kept.columns == docs.columns
        rows, own = kept.collect(), {r["id"]: r for r in docs.collect()}
        assert len(rows) == 5 and all(r == own[r["id"]] for r in rows)
