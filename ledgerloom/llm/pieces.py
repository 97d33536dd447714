"""Merge-type subword pieces: encoding by an agenda of symbol pairs, and decoding by the library."""

from __future__ import annotations

import functools
import re
import unicodedata
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.batches import append_columns, texts

MARK = "▁"  # stands for a space, and for the start of a text
#: Characters from which on a segment's places are kept in arrays.
LONG = 1000
#: Distinct segments whose ids a Python worker remembers, and how long such a segment may be.
MEMO, REMEMBERED = 500_000, 60
#: Characters, about, that are encoded at a time. A part ends where a space follows another character.
PART = 1 << 18

#: Kinds of pieces in a model file (fixed values).
NORMAL, OWN, UNUSED, BYTE = 1, 4, 5, 6


def _separate(pieces: dict[str, int]) -> tuple[str, list[str]]:
    """(the characters that are no letters, digits or accents, the pairs of such a one and another that some piece holds).

    But for those pairs (and marks), no merge joins a separate character to another kind."""
    letter = lambda c: c.isalnum() or unicodedata.category(c)[0] == "M"
    own = {c for c in {*map(chr, range(128)), *"".join(pieces)} if c != MARK and not letter(c)}
    pairs = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
    return "".join(sorted(own)), [x for x in pairs if MARK not in x and (x[0] in own) != (x[1] in own)]


class Model:
    """A merge-type vocabulary as its file has it.

    Only vocabularies that take text as it is are read: no normalisation table, spaces kept and escaped,
    no pieces of the user's own and none unused; anything else is an error."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        how, kinds = proto.normalizer_spec, {p.type for p in proto.pieces}
        if proto.trainer_spec.model_type != proto.trainer_spec.BPE or how.precompiled_charsmap or how.remove_extra_whitespaces or not how.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix or kinds & {OWN, UNUSED}:
            raise ValueError(f"{path}: not a merge-type vocabulary that takes text as it is")
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.begins = how.add_dummy_prefix
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.unknown, self.begin, self.end = (self.library.unk_id(), self.library.bos_id(), self.library.eos_id())
        # equal scores have equal ranks: of such pairs the one further left is first
        order = {score: rank for rank, score in enumerate(sorted({p.score for p in proto.pieces if p.type == NORMAL}, reverse=True))}
        self.rank = {p.piece: order[p.score] for p in proto.pieces if p.type == NORMAL}
        in_bytes = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.bytes = [in_bytes[f"<0x{b:02X}>"] for b in range(256)] if proto.trainer_spec.byte_fallback else []
        # no merge reaches from another character to a mark if no piece does
        self.apart = not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids)
        self.separate, self.joined = _separate(self.ids)

    def symbols(self, text: str) -> list[str]:
        """The pieces that a text (with marks for spaces) ends up in.

        Symbols begin as characters. The agenda holds adjacent pairs that form a piece, the best score
        first and of equal ones the leftmost; a pair is void if either of its symbols has been merged
        since it was noted. A merge notes the new symbol with its two neighbours."""
        n, rank = len(text), self.rank.get
        if n < 2:
            return [text] if n else []
        # an entry is one number: rank, then where the pair begins, then where it ends
        bits = n.bit_length()
        mask = (1 << bits) - 1
        ends = [*range(1, n + 1)] if n < LONG else array("q", range(1, n + 1))  # where the symbol that begins here ends; 0 if none begins here
        before = [*range(-1, n - 1)] if n < LONG else array("q", range(-1, n - 1))  # where the symbol before the one that begins here begins
        agenda = [(best << bits | at) << bits | at + 2 for at in range(n - 1) if (best := rank(text[at : at + 2])) is not None]
        heapify(agenda)
        while agenda:
            entry = heappop(agenda)
            end, at = entry & mask, entry >> bits & mask
            middle = ends[at]
            if not middle or middle >= end or ends[middle] != end:
                continue
            ends[at], ends[middle] = end, 0
            if end < n:
                before[end] = at
                after = ends[end]
                best = rank(text[at:after])
                if best is not None:
                    heappush(agenda, (best << bits | at) << bits | after)
            left = before[at]
            if left >= 0:
                best = rank(text[left:end])
                if best is not None:
                    heappush(agenda, (best << bits | left) << bits | end)
        found, at = [], 0
        while at < n:
            end = ends[at]
            found.append(text[at:end])
            at = end
        return found

    def segment(self, text: str) -> list[int]:
        """Ids of a stretch that no merge reaches out of. What no piece spells is written in bytes, or is one unknown piece."""
        ids: list[int] = []
        for symbol in self.symbols(text):
            own = self.ids.get(symbol)
            if own is not None:
                ids.append(own)
            elif self.bytes:
                ids += [self.bytes[b] for b in symbol.encode()]
            elif not ids or ids[-1] != self.unknown:
                ids.append(self.unknown)
        return ids

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids, by the library's decode(ids): of all ids of a text at once, begin and end included.

        As an array of 32-bit integers they take some 12 bytes an id meanwhile, as a list 48 (measured on 10 MB)."""
        return self.library.decode(np.asarray(ids, np.int32))


def parts(text: str) -> Iterator[str]:
    """A text in parts that encode by themselves: each begins with a space behind another character, but
    the first, and leaves that space out, as the mark that begins every text stands for it."""
    start = 0
    while len(text) - start > PART:
        cut = text.find(" ", start + PART)
        while cut > 0 and (text[cut - 1] in (" ", MARK) or cut == len(text) - 1):  # an empty text has no mark
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        yield text[start:cut]
        start = cut + 1
    yield text[start:]


class Encoder:
    """Ids of texts by one model, with the segments met remembered.

    What the agenda finds is held against the library before it is used: a batch ends with check()."""

    def __init__(self, path: str):
        self.model = Model(path)
        self.memo: dict[str, bytes] = {}
        self.met: list[tuple[str, bytes]] = []  # the agenda's results since the last check
        # a segment is a run of marks and a run of separate characters, or of others, behind it; in texts with a
        # pair that joins both it is a run of marks and all behind it
        apart = self.model.apart and self.model.begins and not any("\n" in p for p in self.model.ids)
        own = re.escape(self.model.separate)
        self.cut = re.compile(f"{MARK}*(?:[^{MARK}{own}]+|[{own}]+)|{MARK}+").findall if apart else None
        self.cut_at_marks = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+").findall

    def _segment(self, text: str) -> bytes:
        own = self.memo.get(text)
        if own is None:
            own = np.array(self.model.segment(text), "<u4").tobytes()
            self.met.append((text, own))
            if len(self.memo) < MEMO and len(text) < REMEMBERED:
                self.memo[text] = own
        return own

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit integers, without begin and end."""
        if not text:
            return b""
        marked = (MARK if self.model.begins else "") + text.replace(" ", MARK)
        if self.cut is None:
            return np.array(self.model.segment(marked), "<u4").tobytes()
        memo, own = self.memo.get, self._segment
        cut = self.cut_at_marks if any(x in marked for x in self.model.joined) else self.cut
        return b"".join([memo(s) or own(s) for s in cut(marked)])

    def whole(self, text: str) -> np.ndarray:
        """Ids of a whole text with begin and end, part by part."""
        pieces = parts(text) if self.cut is not None else [text]
        ends = [np.array([i], "<u4").tobytes() for i in (self.model.begin, self.model.end)]
        return np.frombuffer(b"".join([ends[0], *map(self.encode, pieces), ends[1]]), "<u4")

    def check(self, batch: list[str], ids: list[np.ndarray], decoded: list[str]) -> None:
        """Hold a batch against the library: every segment that the agenda has run on since the last check,
        and of one text (the batch's median by length) all ids and their text. Where texts are not cut
        into segments, all of every text."""
        library, met = self.model.library, self.met
        self.met = []
        if met:
            # a line feed joins no merge, so what stands behind it is encoded by itself
            before = library.encode("\n")
            made = library.encode(["\n" + s for s, _ in met], num_threads=1)
            if any(np.array(theirs[len(before) :], "<u4").tobytes() != mine for theirs, (_, mine) in zip(made, met, strict=True)):
                raise ValueError("the agenda and the library give different ids")
        order = sorted(range(len(batch)), key=lambda i: len(batch[i]))
        for i in order if self.cut is None else order[len(order) // 2 :][:1]:
            cut = list(parts(batch[i])) if self.cut is not None else [batch[i]]
            theirs = [library.bos_id(), *(k for own in library.encode(cut, num_threads=1) for k in own), library.eos_id()]
            if theirs != ids[i].tolist():
                raise ValueError("the agenda and the library give different ids")
            if library.decode(theirs) != decoded[i]:
                raise ValueError("the library decodes the ids to another text")


@functools.cache
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_decode(docs: DataFrame, model: str, *, text_col: str = "text", checked: bool = True) -> DataFrame:
    """docs with ids (of the whole text, with begin and end) and decoded (the text of those ids, which the library decodes), in a map without a shuffle.

    Null text is an empty one: begin and end alone. If `checked`, what the agenda finds in a batch is held
    against the library, as is one whole text of it, and a difference is an error. A text is encoded in parts of some 260,000 characters; a stretch without
    a place to cut is one segment, which takes about 250 bytes a character while its agenda is open. Copies
    come out alike, an empty table gives an empty one; other columns pass through, and a column named like
    a new one (in any case) is replaced by it.
    """

    def start():
        own = _encoder(model)

        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            whole = [t.decode("utf-8", "replace") for t in texts(batch, text_col)]
            ids = [own.whole(t) for t in whole]
            decoded = [own.model.decode(i) for i in ids]
            if checked:
                own.check(whole, ids, decoded)
            ends = np.cumsum([0, *map(len, ids)])
            flat = np.concatenate([np.empty(0, np.int32), *ids]).astype(np.int32)
            return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)), pa.array(decoded, pa.string())]

        return compute

    return append_columns(docs, [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())], start, [text_col])


def ids_digest(encoded: DataFrame, ids_col: str = "ids") -> DataFrame:
    """encoded with ids_sha256: lowercase hex of the SHA-256 of the ids as little-endian 32-bit integers; null without ids."""
    import hashlib

    def start():
        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            lists = batch.column(1)
            return [pa.array([hashlib.sha256(np.asarray(x.values).astype("<u4").tobytes()).hexdigest() if x.is_valid else None for x in lists], pa.string())]

        return compute

    sized = encoded.withColumn("_ids_text", F.lit(""))
    return append_columns(sized, [T.StructField("ids_sha256", T.StringType())], start, ["_ids_text", ids_col]).drop("_ids_text")
