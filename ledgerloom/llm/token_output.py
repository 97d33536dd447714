"""Token-ID output: documents encoded, ordered by id and written as Simple-8b blocks."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import simple8b
from ledgerloom.llm.batches import chunks, columns
from ledgerloom.shared import part_offsets, scratch_path

#: Ids that one row of the file format holds, but for a longer last document.
ROW_IDS = 1 << 18
#: Distinct pieces, the first met, whose ids a Python worker remembers (some 200 bytes each, kept as long as
#: the worker lives), and words encoded in one string.
PIECES, WORDS = 100_000, 2000
#: A row of the format: words and block offsets as little-endian 64-bit integers, and where its documents end.
FORMAT = "shard int, row int, doc_ids array<{kind}>, lengths array<long>, n_tokens long, offsets binary, words binary"

_encoders: dict[str, Encoder] = {}


class Encoder:
    """Ids of texts by a tokenizer file.

    Byte-level BPE never joins bytes across a space that follows a non-space, so texts are cut there and
    a piece that repeats is encoded once. New pieces are split into words by the tokenizer's pattern, and
    the tokenizer encodes many distinct words in one string, cut at line feeds (which byte-level words
    never hold). Any other kind of tokenizer, and texts with special tokens or a space behind white
    space, are left to the tokenizer as a whole."""

    def __init__(self, path: str, remember: int = PIECES):
        os.environ.setdefault("RAYON_NUM_THREADS", "1")  # Spark runs as many workers as there are cores

        import public_tokenizers
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        state = self.tokenizer.pre_tokenizer.__getstate__() if self.tokenizer.pre_tokenizer else b""
        plain = all(x in state for x in (b'"ByteLevel"', b'"add_prefix_space":false', b'"use_regex":true'))
        self.cuts = plain and self.tokenizer.normalizer is None
        self.by_word = Tokenizer.from_file(path)
        self.by_word.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        self.by_word.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab()
        self.spelled = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.spelled[list(vocabulary.values())] = [len(x) for x in vocabulary]
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pieces, self.remember = _Numbers(), remember
        # ids of all pieces, and for each piece where its ids end and whether it ends in white space; the
        # arrays have room to spare, so that new pieces are written behind the known ones
        self.flat, self.ends, self.odd = np.empty(0, np.uint32), np.zeros(1, np.int64), np.zeros(0, bool)

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, and where each word's end."""
        feeds = [i for i, w in enumerate(words) if "\n" in w]
        plain = words.copy()
        for i in feeds:
            plain[i] = ""
        shown = _shown("\n".join(plain)).split(_SHOWN_AS["\n"])
        for i in feeds:
            shown[i] = _shown(words[i])
        parts = [shown[i : i + WORDS] for i in range(0, len(shown), WORDS)]
        made = self.by_word.encode_batch_fast(["\n".join(p) for p in parts], add_special_tokens=False)
        ids = np.array([i for e in made for i in e.ids], np.int64)
        # tokens spell the words out one behind the other, so a word's tokens end where its bytes do
        ends = np.searchsorted(np.cumsum(self.spelled[ids]), np.cumsum([len(x) for x in shown])) + 1
        return ids.astype(np.uint32), ends

    def _learn(self, pieces: list[str]) -> None:
        """Ids of new pieces, behind those that are known, and whether they end in white space."""
        words: dict[str, int] = {}
        # the pattern takes a space and letters as one word
        own = [[words.setdefault(p, len(words))] if p[1:].isalpha() and p[0] == " " else [words.setdefault(w, len(words)) for w in self.split(p)] for p in pieces]
        flat, stop = self._words(list(words))
        at = np.fromiter(chain.from_iterable(own), np.int64)
        stop = np.concatenate([[0], stop])
        sizes = stop[at + 1] - stop[at]
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([len(x) for x in own])]
        known = len(self.pieces) - len(pieces)
        last = int(self.ends[known])
        self.ends = _place(self.ends, known + 1, last + ends)
        self.flat = _place(self.flat, last, flat[_gather(stop[at], sizes)])
        self.odd = _place(self.odd, known, np.array([p[-1:].isspace() for p in pieces]))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        memo = self.pieces
        parts: list[np.ndarray] = [np.empty(0, np.int64)]
        counts, whole = [], np.zeros(len(texts), bool)
        for k, text in enumerate(texts):
            if not text or not self.cuts or any(x in text for x in self.special):
                whole[k] = bool(text)
                counts.append(0)
                continue
            pieces = text.split(" ")
            # a piece is known by its text without the space before it; the one without a space has one
            pieces[0] = " " + pieces[0]
            if len(pieces[0]) == 1:
                del pieces[0]
            parts.append(np.fromiter(map(memo.__getitem__, pieces), np.int64, len(pieces)))
            counts.append(len(pieces))
        new = memo.take()
        if new:
            self._learn([p[1:] if p[:1] == " " else " " + p for p in new])
        at, first = np.concatenate(parts), np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        inner = self.odd[at]
        inner[first[1:][np.array(counts) > 0] - 1] = False  # a text may end in white space
        whole[np.searchsorted(first, np.flatnonzero(inner), side="right") - 1] = True
        sizes = self.ends[at + 1] - self.ends[at]
        ids = self.flat[_gather(self.ends[at], sizes)]
        cut = np.concatenate([[0], np.cumsum(sizes)])[first]
        if len(memo) > self.remember:
            memo.forget(new)
        return [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32) if whole[k] else ids[cut[k] : cut[k + 1]] for k, t in enumerate(texts)]


class _Numbers(dict):
    """Gives every new key the next number."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        self.new.append(key)
        return n

    def take(self) -> list[str]:
        new, self.new = self.new, []
        return new

    def forget(self, keys: list[str]) -> None:
        for k in keys:
            del self[k]


def _place(array: np.ndarray, at: int, values: np.ndarray) -> np.ndarray:
    """The array with values from a place on, in a larger one if there is no room."""
    if at + len(values) > len(array):
        larger = np.zeros(max(2 * len(array), at + len(values)), array.dtype)
        larger[:at] = array[:at]
        array = larger
    array[at : at + len(values)] = values
    return array


def _gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of the runs that start so, one behind the other."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


# Byte-level vocabularies show printable bytes as themselves, and the rest from U+0100 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_SHOWN_AS = {chr(b): chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


def _shown(text: str) -> str:
    """The bytes of a text as a byte-level vocabulary shows them."""
    raw = text.encode().decode("latin-1")
    for c in _SHOWN_AS.keys() & set(raw):
        raw = raw.replace(c, _SHOWN_AS[c])
    return raw


def encoder(path: str, remember: int = PIECES) -> Encoder:
    """One for each file and worker."""
    own = _encoders.get(path)
    if own is None or own.remember != remember:
        own = _encoders[path] = Encoder(path, remember)
    return own


def write_tokens(docs: DataFrame, path: str, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, remember: int = PIECES) -> None:
    """Encode every text whole, append end_id to each document and write the ids in ascending doc_id order.

    Documents are dealt out by ranges of the id, so that the shards, and the rows in each, follow the
    order of ids; equal ids follow a hash of the text, and copies any order, so a frequent id or text
    spreads over shards. Null ids come first. Null text is empty: its document is the end id alone.
    The shards are written by Spark's own committed writer, so a lost executor repeats its shards.
    An empty table gives files without rows. Other columns are not looked at.
    """
    rows = columns(docs, **{id_col: "doc_id", text_col: "text"})
    keys = [F.col("doc_id"), F.xxhash64("text")]
    dealt = rows.withColumn("nth", F.monotonically_increasing_id()).repartitionByRange(*keys, F.col("nth")).sortWithinPartitions(*keys).select("doc_id", "text", F.spark_partition_id().alias("shard"))
    kind = dict(dealt.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end, row, shard, total = encoder(tokenizer, remember), np.array([end_id], np.uint32), 0, 0, 0
        held: list[np.ndarray] = []
        doc_ids: list[pa.Array] = []
        lengths: list[int] = []

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(held)
            words, offsets = simple8b.encode(ids)
            ids_of = pa.concat_arrays(doc_ids)
            values = [
                pa.array([shard], pa.int32()), pa.array([row], pa.int32()), pa.ListArray.from_arrays([0, len(ids_of)], ids_of), pa.array([lengths], pa.list_(pa.int64())),
                pa.array([len(ids)], pa.int64()), pa.array([offsets.astype("<i8").tobytes()], pa.binary()), pa.array([words.astype("<u8").tobytes()], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(values, names=["shard", "row", "doc_ids", "lengths", "n_tokens", "offsets", "words"])

        for whole in batches:
            for batch in chunks(whole, "text"):
                shard, start = batch.column("shard")[0].as_py(), 0
                for k, ids in enumerate(own.encode([x or "" for x in batch.column("text").to_pylist()])):
                    held += [ids, end]
                    lengths.append(len(ids) + 1)
                    total += lengths[-1]
                    if total >= ROW_IDS:
                        doc_ids.append(batch.column("doc_id").slice(start, k + 1 - start))
                        yield flush()
                        held, doc_ids, lengths, total, row, start = [], [], [], 0, row + 1, k + 1
                if start < batch.num_rows:
                    doc_ids.append(batch.column("doc_id").slice(start))
        if lengths:
            yield flush()

    dealt.mapInArrow(run, FORMAT.format(kind=kind)).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The documents of such files: doc_id, start (ids of all documents before), n_tokens and ids_crc32.

    Blocks are decoded in the tasks that read them; only a total for each row of the files, never ids,
    meets in the sum of what lies before."""
    files = spark.read.parquet(path)
    kind = dict(files.dtypes)["doc_ids"].removeprefix("array<")[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                lengths = np.array(one.column("lengths")[0].as_py(), np.int64)
                words, offsets = (np.frombuffer(one.column(c)[0].as_py(), t) for c, t in (("words", "<u8"), ("offsets", "<i8")))
                raw = memoryview(simple8b.decode(words, offsets).astype("<u4")).cast("B")
                starts = np.cumsum(lengths) - lengths
                crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(starts.tolist(), lengths.tolist(), strict=True)]
                own = one.column("doc_ids").flatten()
                n = len(own)
                yield pa.RecordBatch.from_arrays([pa.repeat(one.column("shard")[0], n), pa.repeat(one.column("row")[0], n), own, pa.array(starts), pa.array(lengths), pa.array(crc, pa.int64())], names=["shard", "row", "doc_id", "inside", "n_tokens", "ids_crc32"])

    read = files.select("shard", "row", "doc_ids", "lengths", "offsets", "words").mapInArrow(run, f"shard int, row int, doc_id {kind}, inside long, n_tokens long, ids_crc32 long")
    from pyspark.sql import Window

    shards = part_offsets(files, "shard", F.col("n_tokens"))
    before = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = files.select("shard", "row", before.alias("_rows")).join(shards, "shard").select("shard", "row", (F.col("_offset") + F.col("_rows")).alias("before"))
    return read.join(rows, ["shard", "row"]).select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def token_table(docs: DataFrame, tokenizer: str, path: str | None = None, **how) -> DataFrame:
    """Write docs to path (a folder of the shared scratch space if none is given) and read the files back."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "tokens")
    write_tokens(docs, path, tokenizer, **how)
    return read_tokens(spark, path)
