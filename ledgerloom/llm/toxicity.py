"""Toxicity by class-conditional Kneser-Ney models of bytes that share their lower orders."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.batches import append_columns, apart, chunks, columns, remainder, texts
from ledgerloom.llm.words import LOWER
from ledgerloom.shared import broadcast_if_small, materialize

ORDER = 5
DISCOUNT = 0.75
#: Neutral bytes that the normalisation adds to a text, so that a short one needs more evidence. This constant and
#: the two below were chosen among a few by the errors on the calibration fold of `sf0.1`, never on a fold held out.
PRIOR = 300
#: What a word's log-likelihood ratio must be above the text's own level to tell anything.
EXCESS = 2.0
#: Occurrences that the counts of both classes together are worth to each class in a context.
SHARED = 100.0
#: N-grams, about, whose scores are broadcast at a time; more of them take further blocks over the same texts.
BLOCK_GRAMS = 2_000_000
#: Labelled rows, at most, on which the two numbers of the calibration are fitted.
CALIBRATION_ROWS = 20_000
#: Blocks that a worker keeps at once; of more, each is loaded for every few texts.
KEPT_BLOCKS = 4
#: Distinct n-grams that a task holds before it hands them on.
TASK_GRAMS = 1_000_000
_MIX, _PART = 0x9E3779B97F4A7C15, 1540483477


#: White space, which ends a word.
_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))


def grams(text: bytes) -> np.ndarray:
    """The n-grams of a text between two spaces, as integers of ORDER bytes, in order. What comes before the
    last white space ahead of a byte is read as spaces, so that a word is known by itself."""
    raw = np.frombuffer(b" " * (ORDER - 1) + text.translate(LOWER) + b" ", np.uint8)
    n = len(raw) - ORDER + 1
    out, ended = raw[ORDER - 1 :].astype(np.uint64), np.zeros(n, bool)
    for k in range(1, ORDER):
        before = raw[ORDER - 1 - k : ORDER - 1 - k + n]
        out |= np.where(ended, np.uint8(32), before).astype(np.uint64) << np.uint64(8 * k)
        ended |= _SPACE[before]
    return out


def excess(keys: np.ndarray, ratios: np.ndarray) -> float:
    """What the words of a text (n-grams, with their log-likelihood ratios) say above the text's own level.

    A language or a style in which toxic texts are rare makes all words of a text look ordinary, by much
    the same; so a word is measured from the median word, where that is below 0, and only what it has over
    EXCESS counts."""
    ends = _SPACE[(keys & np.uint64(255)).astype(np.uint8)]
    words = np.bincount(np.concatenate([[0], np.cumsum(ends)[:-1]]), weights=ratios)
    return float(np.maximum(0.0, words - min(0.0, float(np.median(words))) - EXCESS).sum())


class Scores:
    """Exact scores by key: keys in the order of a hash that is one-to-one, found from the start of a bucket."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        hashed = keys.astype(np.uint64) * np.uint64(_MIX)
        order = np.argsort(hashed)
        self.hashed, self.values = hashed[order], values.astype(np.float32)[order]
        self.shift = np.uint64(63 - max(1, len(keys)).bit_length())
        self.first = np.searchsorted(self.hashed >> self.shift, np.arange((1 << 64 - int(self.shift)) + 1, dtype=np.uint64)).astype(np.int32)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The keys' scores, NaN for a key that is not here."""
        out, hashed = np.full(len(keys), np.nan), keys * np.uint64(_MIX)
        bucket = (hashed >> self.shift).astype(np.int64)
        at, end = self.first[bucket], self.first[bucket + 1]
        left = np.flatnonzero(at < end)
        while len(left):
            here = at[left]
            same = self.hashed[here] == hashed[left]
            out[left[same]] = self.values[here[same]]
            left = left[~same]
            at[left] += 1
            left = left[at[left] < end[left]]
        return out


@dataclass
class Model:
    blocks: list[Broadcast]  # of (Scores of n-grams that training met, Scores of others by their context)
    slope: float = 1.0
    offset: float = 0.0
    learned: bool = False  # a calibration has seen both classes

    @property
    def grams(self) -> np.ndarray:
        """The scores of all n-grams that training met."""
        return np.concatenate([np.empty(0, np.float32), *[b.value[0].values for b in self.blocks]])

    def ratios(self, parts: list[bytes]) -> np.ndarray:
        """Each text's words by toxic minus ordinary log-likelihood (see excess), per byte of it and of PRIOR neutral ones.

        A block holds whole contexts, so each n-gram finds its score, or its context's, in one of them;
        of several blocks a task holds KEPT_BLOCKS, or one at a time if there are more."""
        n, keys = len(self.blocks), [grams(text) for text in parts]
        found = [np.zeros(len(k)) for k in keys]
        for i, block in enumerate(self.blocks):
            met, contexts = block.value
            for own, out in zip(keys, found, strict=True):
                here = np.flatnonzero((own >> np.uint64(8)) * np.uint64(_PART) // np.uint64(1 << 20) % np.uint64(n) == i) if n > 1 else slice(None)
                asked = own[here]
                ratio = met.get(asked)
                missed = np.isnan(ratio)
                if missed.any():
                    ratio[missed] = np.nan_to_num(contexts.get(asked[missed] >> np.uint64(8)))
                out[here] = ratio
            if n > KEPT_BLOCKS:
                vars(block).pop("_value", None)
        return np.array([excess(k, f) for k, f in zip(keys, found, strict=True)]) / (np.array([len(text) + 1 for text in parts]) + PRIOR)

    def ratio(self, text: bytes) -> float:
        return float(self.ratios([text])[0])

    def probabilities(self, parts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.ratios(parts) + self.offset, -500, 500)))

    def score(self, text: bytes) -> float:
        return float(self.probabilities([text])[0])


def known_labels(labels: DataFrame, label: str, label_id: str = "doc_id") -> DataFrame:
    """_id, y of the labels that say something; of contrary ones for an id the larger counts."""
    own = columns(labels, **{label_id: "_id", label: "y"}).filter("_id is not null and y is not null")
    return own.groupBy("_id").agg(F.max("y").cast("int").alias("y"))


def labelled(docs: DataFrame, known: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, y of the documents with a label; a label table of known size is broadcast."""
    return columns(docs, **{id_col: "doc_id", text_col: "text"}).join(broadcast_if_small(known, 2_000_000), F.col("doc_id") == F.col("_id")).drop("_id")


def label_sample(known: DataFrame, rows: int) -> DataFrame:
    """At most so many labels, in the order of a hash of the id; texts are joined to them afterwards."""
    return materialize(known.orderBy(F.xxhash64("_id"), "_id").limit(rows), "sample")


def count_grams(train: DataFrame) -> DataFrame:
    """g, n0, n1: how often each n-gram occurs in ordinary and in toxic texts, over all of train (text, y)."""

    def counted(keys: np.ndarray, n: np.ndarray, n1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
        add = lambda x: np.add.reduceat(x[order], first) if len(first) else x
        return keys[first], add(n), add(n1)

    def rows(held: list) -> pa.RecordBatch:
        keys, n, n1 = counted(*map(np.concatenate, zip(*held, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(n - n1), pa.array(n1)], names=["g", "n0", "n1"])

    def run(batches):
        held: list = []  # a task adds up its own texts, and hands on what it has once that grows large
        for whole in batches:
            for batch in chunks(whole, "text"):
                parts = [grams(x) for x in texts(batch)]
                keys = np.concatenate(parts)
                toxic = np.repeat(np.array(batch.column("y").to_pylist()) > 0, list(map(len, parts))).astype(np.int64)
                held.append(counted(keys, np.ones(len(keys), np.int64), toxic))
                if sum(len(k) for k, _, _ in held) > TASK_GRAMS:
                    yield rows(held)
                    held = []
        if held:
            yield rows(held)

    return train.select("text", "y").mapInArrow(run, "g long, n0 long, n1 long").groupBy("g").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def shared_backoff(counts: DataFrame) -> DataFrame:
    """s, p: Kneser-Ney probability of the last byte of each (ORDER - 1)-gram, by the numbers of distinct
    contexts in both classes together; lower orders are interpolated down to the uniform one."""
    kinds = [counts.select(F.col("g").alias("s"))]
    for n in range(ORDER - 1, 0, -1):
        cut = F.col("s").bitwiseAND(F.lit((1 << 8 * n) - 1))
        kinds.append(materialize(kinds[-1].groupBy(cut.alias("s")).agg(F.count(F.lit(1)).alias("k")), f"kinds{n}"))
    lower = None
    for n in range(1, ORDER):
        own = kinds[ORDER - n].withColumn("c", F.shiftright("s", 8))
        context = own.groupBy("c").agg(F.sum("k").alias("all"), F.count(F.lit(1)).alias("types"))
        met = own.join(context, "c").withColumn("short", F.col("s").bitwiseAND(F.lit((1 << 8 * (n - 1)) - 1)))
        if lower is None:
            met = met.withColumn("q", F.lit(1 / 256))
        else:
            met = met.join(lower.select(F.col("s").alias("short"), F.col("p").alias("q")), "short")
        p = (F.greatest(F.col("k") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col("types") * F.col("q")) / F.col("all")
        lower = materialize(met.select("s", p.alias("p")), f"backoff{n}")
    return lower


def fit(train: DataFrame) -> Model:
    """Both models from all of train (text, y), as their log-likelihood ratios by n-gram and by context.

    In each context both classes back off, by their own discounted counts, to one model of all texts
    together, which backs off to shorter contexts by counts that the classes share as well. Where a class
    has shown little, as in a language that is rare in it, both say nearly the same."""
    counts = materialize(count_grams(train), "grams").withColumn("c", F.shiftright("g", 8))
    context = counts.groupBy("c").agg(F.sum("n0").alias("a0"), F.sum("n1").alias("a1"), F.count(F.lit(1)).alias("t"), F.count_if(F.col("n0") > 0).alias("t0"), F.count_if(F.col("n1") > 0).alias("t1"))
    weight = lambda i: (SHARED + DISCOUNT * F.col(f"t{i}")) / (SHARED + F.col(f"a{i}"))
    context = materialize(context.select("c", "a0", "a1", "t", weight(0).alias("w0"), weight(1).alias("w1")), "contexts")
    less = lambda n: F.greatest(n - DISCOUNT, F.lit(0.0))
    met = counts.join(context, "c").join(shared_backoff(counts).withColumnRenamed("s", "short"), F.col("g").bitwiseAND(F.lit((1 << 8 * (ORDER - 1)) - 1)) == F.col("short"))
    both = (less(F.col("n0") + F.col("n1")) + DISCOUNT * F.col("t") * F.col("p")) / (F.col("a0") + F.col("a1"))
    met = met.withColumn("both", both)
    p0, p1 = (less(F.col(f"n{i}")) / (SHARED + F.col(f"a{i}")) + F.col(f"w{i}") * F.col("both") for i in (0, 1))
    seen = materialize(met.select(counts["c"], F.col("g").alias("key"), F.log(p1 / p0).alias("v")), "scores")
    # what no text has shown in a context falls to the shared model, by each class's weight of it
    return Model(_blocks(seen, context.select("c", F.col("c").alias("key"), F.log(F.col("w1") / F.col("w0")).alias("v"))))


def _blocks(*tables: DataFrame) -> list[Broadcast]:
    """The scores of each table (c, key, v), dealt by context to blocks of about BLOCK_GRAMS rows: the driver holds one at a time."""
    n = max(1, -(-tables[0].count() // BLOCK_GRAMS))
    part = F.shiftright(F.col("c") * F.lit(_PART), 20) % n

    def scores(df: DataFrame, i: int) -> Scores:
        rows = df.filter(part == i).select("key", F.col("v").cast("float").alias("v")).toArrow()
        return Scores(rows["key"].to_numpy(), rows["v"].to_numpy())

    return [tables[0].sparkSession.sparkContext.broadcast(tuple(scores(df, i) for df in tables)) for i in range(n)]


def calibrate(model: Model, rows: list[tuple[float, int]]) -> Model:
    """Slope and offset of a logistic curve over length-normalised ratios: 0.5 lies where the errors on
    these rows are fewest, in the middle of such places; the slope follows their mean distance from it."""
    x, y = np.array([r[0] for r in rows]), np.array([r[1] > 0 for r in rows])
    if not len(x) or y.all() or not y.any():
        return model
    order = np.argsort(x)
    xs, ys = x[order], y[order]
    # errors if everything from place i on is called toxic
    wrong = np.concatenate([[0], np.cumsum(ys)]) + (~ys).sum() - np.concatenate([[0], np.cumsum(~ys)])
    # equal ratios fall on one side of it; beyond all of them it keeps off the last by their mean distance
    apart = np.concatenate([[True], xs[1:] > xs[:-1], [True]])
    best = np.flatnonzero(apart & (wrong == wrong[apart].min()))
    i = int(best[len(best) // 2])
    beyond = max(1e-6, float(np.mean(np.abs(x - x.mean()))))
    cut = xs[0] - beyond if i == 0 else xs[-1] + beyond if i == len(xs) else (xs[i - 1] + xs[i]) / 2
    spread = max(1e-6, float(np.mean(np.abs(x - cut))))
    model.slope = 4.0 / spread
    model.offset = -model.slope * cut
    model.learned = True
    return model


def train(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", folds: int = 5, held_out: int | None = None, calibration: int = 1, **how) -> Model:
    """Fit on the labelled documents of all folds but held_out. Of one fold, at most CALIBRATION_ROWS rows
    set the two numbers of the calibration and are left out of the counts."""
    known = materialize(known_labels(labels, label), "labels")
    fold = remainder(F.col("_id"), folds)
    if held_out is not None:
        known = known.filter(fold != held_out)
    asked = label_sample(known.filter(fold == calibration), CALIBRATION_ROWS)
    # a bounded number of ids
    model = fit(labelled(docs, known.join(F.broadcast(asked.select("_id")), "_id", "left_anti"), **how))
    rows = append_columns(labelled(docs, asked, **how), [T.StructField("x", T.DoubleType())], lambda: lambda batch: [pa.array(model.ratios(texts(batch)))], ["text"])
    return calibrate(model, [tuple(r) for r in rows.select("x", "y").collect()])


def score(docs: DataFrame, model: Model, *, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with the probability of being toxic, in a map without a shuffle.

    Every text is scored whole, an empty or null one by the edges of a text alone; a model of an empty
    training set gives 0.5. Copies score alike; other columns pass through.
    """
    return append_columns(docs, [T.StructField(name, T.DoubleType())], lambda: lambda batch: [pa.array(model.probabilities(texts(batch, text_col)))], [text_col])


def clean(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents that are not called toxic, with their own columns, whatever those are called.

    Every row is judged by its own text: repeated rows are kept or go together, null and empty texts are
    judged by the edges of a text alone, null ids like any other. An empty table gives an empty one;
    where labels do not show both classes, nothing can be learned and all documents stay."""
    model = train(docs, labels, id_col=id_col, text_col=text_col, **how)
    if not model.learned:
        return docs
    flat, at, back = apart(docs)
    return back(score(flat, model, text_col=at[text_col]).filter("score < 0.5"))
