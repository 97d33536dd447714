"""Quality: random-indexing word vectors, pooled per document, and a small network with calibrated output."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.batches import append_columns, chunks, columns, remainder, texts
from ledgerloom.llm.toxicity import known_labels, label_sample, labelled
from ledgerloom.shared import materialize

#: Words are told apart by this many bits of a hash; vectors have DIM numbers, index vectors NONZERO of them.
BITS, DIM, NONZERO, REACH = 14, 32, 2, 2
AGAIN = (1 << BITS) - 1
#: Labelled rows, at most, on which the network is fitted; the last fifth of them sets the temperature.
SAMPLE_ROWS = 20_000
HIDDEN, STEPS, RATE = 24, 400, 0.02

# bytes of a word, of white space, and all others, which form runs of their own
_KIND = np.array([1 if chr(c).isalnum() or c >= 128 else 0 if chr(c).isspace() else 2 for c in range(256)], np.uint8)
_BASE = 0x9E3779B97F4A7C15 | 1


#: Bytes, about, whose runs are hashed at a time (one run is never cut).
PART = 1 << 20


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _hashes(raw: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The polynomial hash of each run: its bytes times powers of an odd base, from its own start on."""
    out, at = np.empty(len(edges), np.uint64), 0
    while at < len(edges):
        to = max(at + 1, int(np.searchsorted(edges, edges[at] + PART)))
        part, own = raw[edges[at] : edges[to] if to < len(edges) else len(raw)], edges[at:to] - edges[at]
        out[at:to] = np.add.reduceat(part.astype(np.uint64) * _powers(len(part), _BASE), own) * _powers(len(part), pow(_BASE, -1, 1 << 64))[own]
        at = to
    return out


def tokens(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): runs of word bytes or of punctuation, hashed to BITS bits; text d has first[d]:first[d + 1].

    A word that repeats one of the two runs before it stands as AGAIN, so that repetition has a vector."""
    raw = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    kind = _KIND[raw]
    change = np.flatnonzero(np.diff(kind)) + 1
    edges = np.concatenate([[0], change])
    real = kind[edges] > 0
    h = _hashes(raw, edges)[real]
    first = np.concatenate([[0], np.searchsorted(edges[real], np.cumsum([len(p) + 1 for p in parts]))])
    doc, again = np.repeat(np.arange(len(parts)), np.diff(first)), np.zeros(len(h), bool)
    for gap in (1, 2):
        again[gap:] |= (h[gap:] == h[:-gap]) & (doc[gap:] == doc[:-gap])
    again &= kind[edges][real] == 1
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return np.where(again, AGAIN, (h >> np.uint64(64 - BITS)).astype(np.int64)), first


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the NONZERO numbers in each word's index vector."""
    rng = np.random.default_rng(11)
    return rng.integers(0, DIM, (1 << BITS, NONZERO)), rng.choice([-1.0, 1.0], (1 << BITS, NONZERO))


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Context vectors over all documents: for each word the sum of its neighbours' index vectors, scaled
    to length 1. Tasks add up their own texts, Spark the tasks; the driver gets 2**BITS rows."""
    names = [f"d{k}" for k in range(DIM)]

    def run(batches):
        place, sign = index_vectors()
        total = np.zeros((1 << BITS, DIM))
        for whole in batches:
            for batch in chunks(whole, "text"):
                word, first = tokens(texts(batch))
                doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
                for gap in range(1, REACH + 1):
                    same = doc[gap:] == doc[:-gap]
                    left, right = word[:-gap][same], word[gap:][same]
                    for a, b in ((left, right), (right, left)):
                        for k in range(NONZERO):
                            total += np.bincount(a * DIM + place[b, k], weights=sign[b, k], minlength=total.size).reshape(total.shape)
        used = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used), *[pa.array(total[used, k]) for k in range(DIM)]], names=["word", *names])

    rows = columns(docs, **{text_col: "text"}).mapInArrow(run, ", ".join(["word long", *[f"{n} double" for n in names]])).groupBy("word").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
    out = np.zeros((1 << BITS, DIM), np.float32)
    out[rows["word"].to_numpy()] = np.column_stack([rows[n].to_numpy() for n in names]) if rows.num_rows else 0
    return out / np.maximum(1e-9, np.linalg.norm(out, axis=1, keepdims=True))


def pool(vectors: np.ndarray, parts: list[bytes]) -> np.ndarray:
    """A row for each text: the mean of its words' vectors, zero for none."""
    word, first = tokens(parts)
    out = np.zeros((len(parts), DIM))
    for d in range(len(parts)):
        own = word[first[d] : first[d + 1]]
        for i in range(0, len(own), 1 << 16):
            out[d] += vectors[own[i : i + (1 << 16)]].sum(axis=0)
        out[d] /= max(1, len(own))
    return out


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]  # weights and biases of the two layers
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((x - self.mean) / self.scale @ w1 + b1) @ w2 + b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))


def fit(x: np.ndarray, y: np.ndarray) -> Network:
    """Full-batch Adam on the first four fifths, the classes weighing the same; the last fifth sets the temperature."""
    rng = np.random.default_rng(5)
    cut = max(1, len(x) * 4 // 5)
    mean, scale = (x[:cut].mean(axis=0), x[:cut].std(axis=0) + 1e-6) if len(x) else (np.zeros(DIM), np.ones(DIM))
    net = Network(mean, scale, [rng.normal(0, DIM**-0.5, (DIM, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(())])
    if not len(x) or len(set(y[:cut])) < 2:
        net.layers[2][:] = 0
        net.layers[3] = np.asarray(0.0 if not len(x) else 8.0 if y[0] else -8.0)
        return net
    z, t = (x[:cut] - mean) / scale, y[:cut].astype(float)
    share = np.where(t > 0, 0.5 / t.mean(), 0.5 / (1 - t.mean())) / len(t)
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in net.layers]
    for step in range(1, STEPS + 1):
        w1, b1, w2, b2 = net.layers
        h = np.tanh(z @ w1 + b1)
        error = (1 / (1 + np.exp(-np.clip(h @ w2 + b2, -60, 60))) - t) * share
        back = np.outer(error, w2) * (1 - h * h)
        for i, g in enumerate((z.T @ back + 1e-5 * w1, back.sum(axis=0), h.T @ error + 1e-5 * w2, error.sum())):
            m, v = state[i]
            state[i] = m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            net.layers[i] = net.layers[i] - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    if cut < len(x):
        logits, t = net.logits(x[cut:]), y[cut:].astype(float)
        tried = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
        net.temperature = float(tried[np.argmin([np.mean(np.logaddexp(0, logits / k) - t * logits / k) for k in tried])])
    return net


def train(docs: DataFrame, labels: DataFrame, *, label: str = "quality", folds: int = 3, held_out: int = 1, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, Network]:
    """Word vectors of all documents, and the network of a bounded sample of labels outside the fold held out."""
    vectors = word_vectors(docs, text_col)
    known = materialize(known_labels(labels, label), "labels")
    sample = labelled(docs, label_sample(known.filter(remainder(F.col("_id"), folds) != held_out), SAMPLE_ROWS), id_col=id_col, text_col=text_col)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)
    field = T.StructField("x", T.ArrayType(T.DoubleType()))
    rows = append_columns(sample, [field], lambda: lambda batch: [pa.array(list(pool(shared.value, texts(batch))), pa.list_(pa.float64()))], ["text"]).select("doc_id", "x", "y").collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r.doc_id).encode()), str(r.doc_id)))  # any order but the table's
    return vectors, fit(np.array([r.x for r in rows]).reshape(len(rows), DIM), np.array([r.y for r in rows]) > 0)


def score(docs: DataFrame, model: tuple[np.ndarray, Network], *, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with the calibrated probability of good quality, in a map without a shuffle.

    Texts are pooled whole, a long one with some 25 bytes of memory a byte of it; a null or empty one, or
    one of white space, is the zero vector. Without labels every score is 0.5. Copies score alike; other columns pass through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        vectors, net = shared.value
        return [pa.array(net.probability(pool(vectors, texts(batch, text_col))), pa.float64())]

    return append_columns(docs, [T.StructField(name, T.DoubleType())], lambda: compute, [text_col])
