"""Benchmark decontamination by Wu-Manber multi-pattern search."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.batches import append_columns, apart, columns, texts
from ledgerloom.llm.words import plain_words

WINDOW = 10
#: Benchmark text, in bytes, that is broadcast at a time; a larger benchmark takes further passes. A worker
#: holds about 15 bytes for each (tests measure it), so 120 MB here.
BENCHMARK_BYTES = 8 << 20
#: Patterns are searched by class of length, so that a short one does not shorten every shift.
CLASSES = (1, 12, 24, 40)
#: Bytes of a block, and of a pattern at most that the search window covers.
SUFFIX, COVERED = 8, 200
#: The search runs in so many places of a chunk at a time, each over LANE bytes or more.
LANES, LANE = 8192, 256
#: Pairs of a place and a pattern of its bucket that are looked at together.
PAIRS = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)

FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("spans", T.ArrayType(T.IntegerType())),
    T.StructField("items", T.ArrayType(T.StringType())),
]


def _codes(raw: bytes) -> np.ndarray:
    """The eight bytes from each place on as one number, without a copy."""
    return np.ndarray((max(0, len(raw) - 7),), "<u8", raw, strides=(1,))


class WuManber:
    """Patterns, as places in a text, of at least `shortest` bytes. The shift table says for a hash of each
    block of bytes how far the search may jump when its window ends in the block; blocks that end the
    window of a pattern lead by their hash to a bucket of patterns, and those are compared whole."""

    def __init__(self, text: bytes, starts: np.ndarray, ends: np.ndarray):
        self.m = m = min(COVERED, int((ends - starts).min()))
        self.b = b = min(SUFFIX, m)
        self.first_bytes = np.uint64((1 << 8 * min(8, m)) - 1)
        codes = _codes(text + b" " * 8)
        self.bits = np.uint64(64 - min(26, max(10, math.ceil(math.log2(4 * min(len(text), len(starts) * (m - b + 1)))))))
        self.shift = np.full(1 << 64 - int(self.bits), m - b + 1, np.uint8)
        for j in range(m - b + 1):  # the nearer to the window's end, the smaller the shift, and the later it is set
            self.shift[self._hash(codes[starts + j], low=True)] = m - b - j
        key = self._hash(codes[starts + (m - b)], low=True).astype(np.uint32)
        self.order = np.argsort(key, kind="stable").astype(np.int32)
        self.keys = key[self.order]
        self.firsts = codes[starts] & self.first_bytes

    def _hash(self, code: np.ndarray, low: bool) -> np.ndarray:
        """Of the block that the code's low (or high) bytes hold."""
        if self.b < 8:
            code = code << np.uint64(64 - 8 * self.b) if low else code >> np.uint64(64 - 8 * self.b) << np.uint64(64 - 8 * self.b)
        return (code * _MIX) >> self.bits

    def candidates(self, codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, bucket) of window ends in n bytes whose block leads to a bucket. The text has eight bytes
        before its first and after its last; places are cut into lanes that jump on their own."""
        lanes = max(1, min(LANES, n // LANE))
        edge = np.linspace(self.m, n + 1, lanes + 1).astype(np.int64)
        at, stop = edge[:-1], edge[1:]
        found, buckets = [], []
        at, stop = at[at < stop], stop[at < stop]
        while len(at):
            h = self._hash(codes[at], low=False)  # the code from at - 8 + 8 on ends just before at
            step = self.shift[h]
            hit = step == 0
            if hit.any():
                found.append(at[hit])
                buckets.append(h[hit])
            at = at + np.maximum(step, 1)
            left = at < stop
            at, stop = at[left], stop[left]
        return (np.concatenate(found), np.concatenate(buckets)) if found else (np.empty(0, np.int64), np.empty(0, np.uint64))

    def pairs(self, codes: np.ndarray, n: int):
        """(place, pattern) of those candidates whose first bytes are the pattern's, some at a time."""
        at, h = self.candidates(codes, n)
        low, high = (np.searchsorted(self.keys, h.astype(np.uint32), side) for side in ("left", "right"))
        total = np.cumsum(high - low)
        begin = 0
        while begin < len(at):
            end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + PAIRS, "right")))
            n_own = (high - low)[begin:end]
            which = np.repeat(np.arange(begin, end), n_own)
            one = self.order[low[which] + np.arange(len(which)) - np.repeat(np.cumsum(n_own) - n_own, n_own)]
            start = at[which] - self.m
            same = codes[start + 8] & self.first_bytes == self.firsts[one]
            yield start[same], one[same]
            begin = end


class Matcher:
    """The windows of some benchmark items, ready to be searched for.

    Windows overlap, so they are kept as places in the items' text; equal ones are one pattern, known by
    a 128-bit hash, with the items that own it."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.items = sorted({item for item, _ in items})
        number = {item: i for i, item in enumerate(self.items)}
        parts, starts, ends, sizes, owners, at = [], [], [], [], [], 0
        for item, raw in items:
            words = plain_words(raw)
            if not words:
                continue
            part = b" " + b" ".join(words) + b" "
            spaces = np.flatnonzero(np.frombuffer(part, np.uint8) == 32) + at
            k = min(window, len(words))
            starts.append(spaces[:-k])
            ends.append(spaces[k:] + 1)
            sizes.append(np.full(len(spaces) - k, k))
            owners.append(np.full(len(spaces) - k, number[item]))
            parts.append(part)
            at += len(part)
        self.text = b"".join(parts)
        start, end, size, owner = (np.concatenate([np.empty(0, np.int64), *x]) for x in (starts, ends, sizes, owners))
        digest = np.array([xxhash.xxh3_128_digest(self.text[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)], "S16").view("<u8").reshape(-1, 2) if len(start) else np.empty((0, 2), "<u8")
        order = np.lexsort((owner, digest[:, 1], digest[:, 0]))
        new = np.ones(len(order), bool)
        new[1:] = (digest[order][1:] != digest[order][:-1]).any(axis=1)
        self.owners, self.first_owner = owner[order].astype(np.int32), np.append(np.flatnonzero(new), len(order)).astype(np.int32)
        at = order[new]
        self.starts, self.ends, self.n_words = start[at].astype(np.int32), end[at].astype(np.int32), size[at].astype(np.int32)
        length = self.ends - self.starts
        self.classes = []
        for low, high in zip(CLASSES, [*CLASSES[1:], math.inf]):
            own = np.flatnonzero((length >= low) & (length < high))
            if len(own):
                self.classes.append((WuManber(self.text, self.starts[own].astype(np.int64), self.ends[own].astype(np.int64)), own))

    def search_all(self, docs: list[list[bytes]]) -> list[tuple[list[tuple[int, int]], set[str]]]:
        """For each text's words the spans [from, to) of all occurrences, and the items they belong to."""
        parts = [b" " + b" ".join(words) + b" " for words in docs]
        text = b"".join(parts)
        codes = _codes(b" " * 8 + text + b" " * 8)
        at, which = [], []
        for search, own in self.classes:
            for places, patterns in search.pairs(codes, len(text)):
                patterns = own[patterns]
                ends = places + self.ends[patterns] - self.starts[patterns]
                equal = [text[a:b] == self.text[c:d] for a, b, c, d in zip(places.tolist(), ends.tolist(), self.starts[patterns].tolist(), self.ends[patterns].tolist(), strict=True)]
                equal = np.array(equal, bool)
                at.append(places[equal])
                which.append(patterns[equal])
        out: list[tuple[list[tuple[int, int]], set[str]]] = [([], set()) for _ in docs]
        if not at or not sum(map(len, at)):
            return out
        at, which = np.concatenate(at), np.concatenate(which)
        begin = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        spaces = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
        doc = np.searchsorted(begin, at, "right") - 1
        first = np.searchsorted(spaces, at) - np.searchsorted(spaces, begin[doc])
        for d, i, k in zip(doc.tolist(), first.tolist(), which.tolist(), strict=True):
            out[d][0].append((i, i + int(self.n_words[k])))
            out[d][1].update(self.items[o] for o in self.owners[self.first_owner[k] : self.first_owner[k + 1]])
        return out

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        return self.search_all([words])[0]


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of word spans as sorted spans that do not touch."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def mark(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BENCHMARK_BYTES) -> DataFrame:
    """docs with n_words, n_hit, spans (flat from, to pairs of hit words) and items (ids, sorted as strings).

    The benchmark is the query set: it is made ready and broadcast in blocks of bounded size, one map over
    the documents for each, without a shuffle; workers keep it from task to task. Null or wordless
    documents have no words and no hits. Items without an id or a word take no part; rows with the same
    id are one item. Copies of a document are marked alike. Empty tables give no rows, or no hits. Other
    columns pass through; a column named like a new one (in any case) is replaced by it.
    """
    items = columns(benchmark, **{item_id: "item", item_text: "text"}).filter("item is not null and text is not null")
    items = items.select(F.col("item").cast("string").alias("item"), "text")
    blocks = max(1, math.ceil((items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / block_bytes))
    out = docs
    for k in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        shared = docs.sparkSession.sparkContext.broadcast(Matcher([(r.item, r.text.encode()) for r in part.collect()], window))

        def start(shared=shared, more=k > 0) -> Callable:
            def compute(batch: pa.RecordBatch) -> list[pa.Array]:
                rows: tuple[list, ...] = ([], [], [], [])
                words = [plain_words(t) for t in texts(batch, text_col)]
                found = shared.value.search_all(words)
                before = zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist(), strict=True) if more else ((None, None) for _ in words)
                for own, (spans, ids), (old, old_ids) in zip(words, found, before, strict=True):
                    if old:
                        spans, ids = spans + list(zip(old[::2], old[1::2], strict=True)), ids | set(old_ids)
                    spans = merge(spans)
                    for column, value in zip(rows, (len(own), sum(b - a for a, b in spans), [x for s in spans for x in s], sorted(ids)), strict=True):
                        column.append(value)
                return [pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string())), strict=True)]

            return compute

        out = append_columns(out, FIELDS, start, [text_col, *(["spans", "items"] if k else [])])
    return out


def items_digest(items):
    """sha256 of the item ids, joined by commas."""
    return F.sha2(F.concat_ws(",", items), 256)


def clean(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", **how) -> DataFrame:
    """The documents that share no window with the benchmark, with their own columns, whatever those are called.

    Null, empty and wordless texts are kept, as are null ids; repeated rows are kept or go together. An
    empty benchmark keeps all, an empty table gives an empty one."""
    flat, at, back = apart(docs)
    return back(mark(flat, benchmark, text_col=at[text_col], **how).filter("n_hit = 0"))


def digest(hit_ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(hit_ids)).encode()).hexdigest()
