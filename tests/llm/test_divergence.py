import random
import re
from collections import Counter, defaultdict

import pytest

from ledgerloom.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def by_hand(rows, least, top):
    """(lang, source, part, item, value, rank) of rows (lang, source, text), from dense counts in whole numbers."""
    n, documents, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words = TERM.findall(lower(text or ""))
        n[lang, source].update(words)
        documents[lang].update(set(words))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, d in documents[lang].items() if d >= least]
        own = sorted((g for g in groups if g[0] == lang), key=lambda g: g[1].encode())
        whole = Counter()
        for g in own:
            whole.update({t: n[g][t] for t in kept})

        def p(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (counts[t] + 5) // (total + 5 * len(kept)) for t in kept}

        ps, q = {g: p(n[g]) for g in own}, p(whole)
        for g in own:
            pairs = sorted(((-sum(abs(ps[g][t] - ps[h][t]) for t in kept), h[1].encode()) for h in own if h != g))
            terms = sorted((-(ps[g][t] - q[t]), t.encode()) for t in kept if n[g][t] and ps[g][t] > q[t])[:top]
            for part, found in (("pair", pairs), ("term", terms)):
                out |= {(*g, part, item.decode(), -value, k) for k, (value, item) in enumerate(found, 1)}
    return out


def made(rng, sources, count=400):
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)] + ["Été", "ÉTÉ", "naïve", "漢字", "_x", "A1b"]
    rows = []
    for _ in range(count):
        s = rng.choice(sources)
        pool = words[hash_of(s) % 60 :] if s else words
        rows.append((rng.choice(["en", "en", "fr", None]), s, rng.choice([None, "", "1 2", *[" ".join(rng.choice(pool) for _ in range(rng.randint(1, 60))) for _ in range(6)]])))
    return rows + [("xx", "alone", "one two"), ("yy", "a", ""), ("yy", "b", None), *[("en", "hot", "the same text")] * 80]


def hash_of(text):
    return sum(text.encode())


@pytest.mark.parametrize(("tile_groups", "tile_terms", "heavy"), [(256, 2048, 4), (3, 16, 4), (4, 8, 1), (3, 2048, 10**9)])
def test_against_dense(spark, monkeypatch, tile_groups, tile_terms, heavy):
    """Tiles of any size, and terms all light or all heavy, give the same sums."""
    for name, value in (("TILE_GROUPS", tile_groups), ("TILE_TERMS", tile_terms), ("HEAVY", heavy)):
        monkeypatch.setattr(divergence, name, value)
    rows = made(random.Random(tile_terms), [f"s{i}" for i in range(10)] + ["é", None])
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(4)
    got = divergence.audit(docs, least=8, top=5).collect()
    assert {tuple(r) for r in got} == by_hand(rows, 8, 5) and len(got) == len({tuple(r) for r in got})


def test_fixture(docs, rows, none):
    got = divergence.audit(docs).collect()
    assert {tuple(r) for r in got} == by_hand([(r[2], r[3], r[1]) for r in rows], divergence.LEAST_DOCUMENTS, divergence.TOP)
    assert divergence.audit(none).count() == 0


def test_parts_and_flushes(spark, monkeypatch):
    """Long texts are counted in parts, and full counts passed on, without a change to any count."""
    rows = made(random.Random(5), ["s1", "s2", "s3"], 60) + [("en", "s1", "wab wac Été " * 2000)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").coalesce(1)
    want = sorted(map(tuple, divergence.counted(docs.na.fill("")).groupBy("lang", "source", "term").sum("n", "documents").na.fill("").collect()))
    monkeypatch.setattr(divergence, "PART", 50)
    monkeypatch.setattr(divergence, "HELD", 40)
    got = divergence.counted(docs.na.fill(""))
    assert sorted(map(tuple, got.groupBy("lang", "source", "term").sum("n", "documents").na.fill("").collect())) == want
    assert got.count() > len(want)


def test_large_counts_are_exact(spark):
    from pyspark.sql import functions as F

    n, total = 9 * 10**18, 9 * 10**18 + 7
    got = spark.range(1).select(divergence.frequency(F.lit(n), F.lit(total), F.lit(3).cast("long")).alias("p")).first().p
    assert got == 1 + 10**9 * (n + 5) // (total + 15)
