"""Language identification: script ranges, scores of words and a Viterbi path with a switching penalty."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.batches import append_columns, chunks, columns
from ledgerloom.llm.words import PLAIN

UNKNOWN = "und"
BITS = 16
#: What a change of language costs a path, in nats.
SWITCH = 12.0
#: A language is a candidate for a script in which it has at least this share of its words.
SHARE = 0.02
#: What a word of a script in which a language is no candidate costs that language.
FOREIGN = 25.0
_CELLS = 1 << 24
#: Characters, about, that are scored at a time.
PART = 1 << 20

# First code points of Unicode ranges and the script each holds.
SCRIPTS = {
    0x0000: "common", 0x0041: "latin", 0x005B: "common", 0x0061: "latin", 0x007B: "common", 0x00C0: "latin", 0x0250: "common",
    0x0370: "greek", 0x0400: "cyrillic", 0x0530: "armenian", 0x0590: "hebrew", 0x0600: "arabic", 0x0700: "common",
    0x0900: "devanagari", 0x0980: "bengali", 0x0A00: "common", 0x0B80: "tamil", 0x0C00: "telugu", 0x0C80: "common",
    0x0E00: "thai", 0x0E80: "common", 0x10A0: "georgian", 0x1100: "hangul", 0x1200: "ethiopic", 0x1380: "common",
    0x1E00: "latin", 0x1F00: "greek", 0x2000: "common", 0x3040: "kana", 0x3100: "common", 0x3400: "han", 0xA000: "common",
    0xAC00: "hangul", 0xD7B0: "common", 0xF900: "han", 0xFB00: "common",
}
_STARTS = np.array(list(SCRIPTS))
_NAMES = sorted(set(SCRIPTS.values()), key=lambda s: (s != "common", s))
_OF = np.array([_NAMES.index(s) for s in SCRIPTS.values()])


@dataclass
class Words:
    """The words of some texts in one array of bytes: word i starts at starts[i], doc d has words first[d]:first[d + 1]."""

    slots: np.ndarray  # of the byte trigram around each byte; the last slot stands for what is between words
    starts: np.ndarray
    first: np.ndarray
    scripts: np.ndarray


def split(texts: list[str]) -> Words:
    parts = [b" " + t.lower().encode("utf-8", "replace").translate(PLAIN) + b" " for t in texts]
    raw = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint32)
    inside = raw != 32
    slots = np.full(len(raw), 1 << BITS, np.int64)
    h = raw[:-2] * np.uint32(0x9E3779B1) + raw[1:-1] * np.uint32(0x85EBCA77) + raw[2:] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    slots[1:-1] = np.where(inside[1:-1], h >> np.uint32(32 - BITS), 1 << BITS)
    starts = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    ends = np.cumsum([len(p) for p in parts])
    first = np.concatenate([[0], np.searchsorted(starts, ends)])
    a = raw[starts]
    b, c = (raw[np.minimum(starts + k, len(raw) - 1)] & 0x3F for k in (1, 2))
    point = np.where(a < 0x80, a, np.where(a < 0xE0, (a & 0x1F) << 6 | b, np.where(a < 0xF0, (a & 0x0F) << 12 | b << 6 | c, 0x10000)))
    return Words(slots, starts, first, _OF[np.searchsorted(_STARTS, point, side="right") - 1])


@dataclass
class Model:
    languages: list[str]
    trigrams: np.ndarray  # log-probability of each slot in each language, less the mean; 0 between words
    candidates: np.ndarray  # by script and language

    def word_scores(self, words: Words) -> np.ndarray:
        """A row for each word: the sum over its trigrams, narrowed by its script."""
        n, out = len(words.starts), []
        step = max(1, _CELLS // max(1, len(self.languages)))
        at = 0
        while at < n:  # as many words at a time as keep the gathered cells bounded
            to = max(at + 1, int(np.searchsorted(words.starts, words.starts[at] + step)))
            begin, end = words.starts[at], words.starts[to] if to < n else len(words.slots)
            out.append(np.add.reduceat(self.trigrams[words.slots[begin:end]], words.starts[at:to] - begin, axis=0))
            at = to
        scores = np.concatenate(out) if out else np.zeros((0, len(self.languages)), np.float32)
        return scores - FOREIGN * ~self.candidates[words.scripts]

    def path(self, scores: np.ndarray) -> np.ndarray:
        """The language of each word on the best path, where each change costs SWITCH."""
        total = scores.sum(axis=0, dtype=np.float64)
        best = int(np.argmax(total))
        # If no other language gains SWITCH / 2 on any stretch, a path that leaves the best one loses more
        # by its changes than it gains, so the constant path is the best and the recursion is not needed.
        for k in range(scores.shape[1]):  # one language at a time, so that a long text takes little memory
            gain = np.concatenate([[0.0], np.cumsum(scores[:, k].astype(np.float64) - scores[:, best])])
            if (gain[1:] - np.minimum.accumulate(gain)[:-1]).max() > SWITCH / 2:
                return viterbi(scores, SWITCH)
        return np.full(len(scores), best)

    def text_scores(self, text: str) -> np.ndarray:
        """word_scores() of a long text, part by part; words do not know each other."""
        out, at = [], 0
        while at < len(text):
            cut = text.find(" ", at + PART)
            cut = len(text) if cut < 0 else cut
            out.append(self.word_scores(split([text[at:cut]])).astype(np.float32))
            at = cut + 1
        return np.concatenate(out)


def viterbi(scores: np.ndarray, switch: float) -> np.ndarray:
    n, k = scores.shape
    back = np.zeros((n, k), np.int16)
    best = scores[0].astype(np.float64)
    stay = np.arange(k)
    for i in range(1, n):
        top = int(best.argmax())
        moved = best[top] - switch > best
        back[i] = np.where(moved, top, stay)
        best = np.where(moved, best[top] - switch, best) + scores[i]
    out = np.empty(n, np.int64)
    out[-1] = best.argmax()
    for i in range(n - 1, 0, -1):
        out[i - 1] = back[i, out[i]]
    return out


def train(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Trigram and script counts of every text with a language; at most a row per language and slot
    reaches the driver, however many documents there are."""
    rows = columns(docs, **{text_col: "text", lang_col: "lang"}).filter("text is not null and lang is not null")
    width = (1 << BITS) + len(_NAMES)

    def run(batches):
        for whole in batches:
            for batch in chunks(whole, "text"):
                langs = batch.column("lang").to_pylist()
                for lang in set(langs):
                    words = split([t for t, own in zip(batch.column("text").to_pylist(), langs, strict=True) if own == lang])
                    n = np.bincount(words.slots[words.slots < 1 << BITS], minlength=width)
                    n[1 << BITS :] += np.bincount(words.scripts, minlength=len(_NAMES))
                    at = np.flatnonzero(n)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at])], names=["lang", "slot", "n"])

    counts = rows.mapInArrow(run, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(counts["lang"].to_pylist()))
    table = np.zeros((len(langs), width))
    table[np.searchsorted(np.array(langs), counts["lang"].to_numpy(zero_copy_only=False).astype(str)) if langs else [], counts["slot"].to_numpy()] = counts["n"].to_numpy()
    n, scripts = table[:, : 1 << BITS], table[:, 1 << BITS :]
    logs = np.log((n + 0.5) / (n.sum(axis=1, keepdims=True) + 0.5 * (1 << BITS)))
    logs = np.vstack([(logs - logs.mean(axis=0)).T, np.zeros(len(langs))]) if langs else np.zeros(((1 << BITS) + 1, 0))
    candidates = (scripts / np.maximum(1, scripts.sum(axis=1, keepdims=True)) >= SHARE).T
    candidates[0] = True  # words of digits and of no script say nothing
    candidates[~candidates.any(axis=1)] = True
    return Model(langs, logs.astype(np.float32), candidates)


FIELDS = [
    T.StructField("lang_pred", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("words", T.LongType())]))),
]
_SPANS = pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int64())]))


def identify(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score and spans, in a map without a shuffle.

    spans says which language runs over how many words, in order; lang_pred has most words on the path
    (ties: the first by name) and score is its share of them. A long text is scored in parts, and takes some
    10 bytes for each word and language. A null text, one without a letter, or a
    model without a language gives `und`, score 0 and no spans. Copies get the same; an empty table
    gives an empty one; other columns pass through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        model = shared.value

        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            values = batch.column(text_col).to_pylist()
            long = [d for d, t in enumerate(values) if t and len(t) > PART]
            words = split(["" if d in long else t or "" for d, t in enumerate(values)])
            scores = model.word_scores(words)
            names, shares, spans = [], [], []
            for d, text in enumerate(values):
                own = model.text_scores(text) if d in long else scores[words.first[d] : words.first[d + 1]]
                if not model.languages or not text or not len(own) or not any(map(str.isalpha, text)):
                    names.append(UNKNOWN)
                    shares.append(0.0)
                    spans.append([])
                    continue
                path = model.path(own)
                n = np.bincount(path, minlength=len(model.languages))
                names.append(model.languages[int(n.argmax())])
                shares.append(float(n.max() / len(path)))
                cuts = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
                spans.append([{"lang": model.languages[path[a]], "words": b - a} for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
            return [pa.array(names, pa.string()), pa.array(shares, pa.float64()), pa.array(spans, _SPANS)]

        return compute

    return append_columns(docs, FIELDS, start, [text_col])
