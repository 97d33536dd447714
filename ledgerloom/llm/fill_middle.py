"""Fill-in-the-middle: texts cut into units and rearranged, by a byte automaton in lanes."""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.batches import append_columns, texts

#: The sentinels, and the white space that ends a word.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SPACES = b" \t\n\x0b\x0c\r"
#: Not a byte of UTF-8: stands before each text and behind it, and puts the automaton back to its start.
RESET = 0xFF
#: Bytes of a lane. A lane belongs to one text, so a long text has many and a short one has one.
BLOCK = 512
#: The automaton's state depends on no more bytes than these before it.
MEMORY = 3

#: Start of a text, in white space, in a word, 1 to 3 bytes short of a character's end, behind "<", behind "<P", "<S" or "<M".
START, SPACE, WORD, SHORT1, SHORT2, SHORT3, OPEN, NAMED = range(8)
#: A transition counts characters, units and sentinels that begin or end with its byte; a lane has fewer than 1024 of each.
CHAR, UNIT, SENTINEL = 1, 1 << 10, 1 << 20


@functools.cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """(next state times 256, counts) of each transition, at state times 256 plus byte."""
    go, count = np.zeros((8, 256), np.uint16), np.zeros((8, 256), np.uint32)
    for state in range(8):
        for byte in range(256):
            if byte == RESET:
                continue
            if 0x80 <= byte < 0xC0 and state in (SHORT1, SHORT2, SHORT3):
                go[state, byte] = WORD if state == SHORT1 else state - 1
                continue
            space = byte in SPACES
            count[state, byte] = CHAR + UNIT * (state == START or space and state != SPACE)
            if space:
                go[state, byte] = SPACE
            elif byte >= 0xC0:
                go[state, byte] = SHORT3 if byte >= 0xF0 else SHORT2 if byte >= 0xE0 else SHORT1
            elif byte == PREFIX[0]:
                go[state, byte] = OPEN
            elif state == OPEN and byte in (PREFIX[1], SUFFIX[1], MIDDLE[1]):
                go[state, byte] = NAMED
            else:
                go[state, byte] = WORD
                count[state, byte] += SENTINEL * (state == NAMED and byte == PREFIX[2])
    return (go * 256).ravel(), count.ravel()


class Scan:
    """One pass of the automaton over texts (UTF-8), all lanes at once.

    units, chars and sentinels are counts per text; what each lane counted is kept for cut()."""

    def __init__(self, texts: list[bytes]):
        self.sizes = np.array([len(t) for t in texts], np.int64)
        lanes = (self.sizes + BLOCK) // BLOCK  # a text begins with a reset
        self.first = np.cumsum(lanes) - lanes
        fill = lanes * BLOCK - 1 - self.sizes
        reset = bytes([RESET])
        raw = b"".join(part for t, n in zip(texts, fill.tolist(), strict=True) for part in (reset, t, reset * n))
        self.lanes = np.frombuffer(raw, np.uint8).reshape(-1, BLOCK)
        before = np.full((len(self.lanes), MEMORY), RESET, np.uint8)
        before[1:] = self.lanes[:-1, -MEMORY:]
        self.states = _run(before, np.zeros(len(before), np.uint16))[0]
        counted = _run(self.lanes, self.states)[1]
        ends = np.append(self.first, len(self.lanes))
        self.unit_ends, self.char_ends = (np.concatenate([[0], np.cumsum(counted // step % UNIT)]) for step in (UNIT, CHAR))
        sentinel_ends = np.concatenate([[0], np.cumsum(counted // SENTINEL)])
        self.units, self.chars, self.sentinels = (np.diff(total[ends]) for total in (self.unit_ends, self.char_ends, sentinel_ends))

    def cut(self, text: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(byte, character) at which the unit-th unit of each text begins, or its end behind the last.

        The lane is found among the counts of the first pass, and only it is read again."""
        place, chars = self.sizes[text], self.chars[text]
        inner = np.flatnonzero(unit < self.units[text])
        asked = self.unit_ends[self.first[text[inner]]] + unit[inner]
        lane = np.searchsorted(self.unit_ends, asked, side="right") - 1
        at, before = _find(self.lanes[lane], self.states[lane], asked - self.unit_ends[lane])
        own = self.first[text[inner]]
        place[inner] = (lane - own) * BLOCK + at - 1
        chars[inner] = self.char_ends[lane] - self.char_ends[own] + before
        return place, chars


def _run(lanes: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """States behind the last byte of each lane, and the counts of its transitions."""
    go, count = tables()
    total = np.zeros(len(lanes), np.uint32)
    for column in np.ascontiguousarray(lanes.T):
        at = states + column
        total += count[at]
        states = go[at]
    return states, total


def _find(lanes: np.ndarray, states: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place in each lane where its nth unit (from 0) begins, and characters of the lane before it."""
    go, count = tables()
    units, chars = np.zeros(len(lanes), np.int64), np.zeros(len(lanes), np.int64)
    place, before = np.zeros(len(lanes), np.int64), np.zeros(len(lanes), np.int64)
    for i, column in enumerate(np.ascontiguousarray(lanes.T)):
        at = states + column
        counted = count[at]
        begins = counted // UNIT % 2 == 1
        here = begins & (units == nth)
        place[here], before[here] = i, chars[here]
        units += begins
        chars += counted % UNIT
        states = go[at]
    return place, before


def draws(seed: int, doc_id: object) -> list[int]:
    """The first four 32-bit numbers of the SHA-256 of seed and id; a null id is written as nothing."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


def arrange(batch: list[bytes], ids: list, seed: int, rearranged: int, suffix_first: int) -> dict[str, list]:
    """The new columns of a batch of texts."""
    scan = Scan(batch)
    drawn = np.array([draws(seed, i) for i in ids], np.int64).reshape(-1, 4)
    n = scan.units
    plain = (scan.sizes == 0) | (scan.sentinels > 0) | (drawn[:, 2] % 100 >= rearranged)
    moved = np.flatnonzero(~plain)
    cuts = np.sort(drawn[moved, :2] % (n[moved, None] + 1), axis=1)
    (a, a_chars), (b, b_chars) = scan.cut(moved, cuts[:, 0]), scan.cut(moved, cuts[:, 1])
    form: list[str] = ["plain"] * len(batch)
    prefix: list[int | None] = [None] * len(batch)
    middle: list[int | None] = [None] * len(batch)
    output = list(batch)
    for k, lo, hi, lo_chars, hi_chars in zip(*(x.tolist() for x in (moved, a, b, a_chars, b_chars)), strict=True):
        text = batch[k]
        before, between, behind = text[:lo], text[lo:hi], text[hi:]
        prefix[k], middle[k] = lo_chars, hi_chars - lo_chars
        if drawn[k, 3] % 100 < suffix_first:
            form[k], output[k] = "spm", b"".join([SUFFIX, behind, PREFIX, before, MIDDLE, between])
        else:
            form[k], output[k] = "psm", b"".join([PREFIX, before, SUFFIX, behind, MIDDLE, between])
    return {"n": n.tolist(), "form": form, "prefix_chars": prefix, "middle_chars": middle, "output": output}


def transform(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rearranged: int = 50, suffix_first: int = 80) -> DataFrame:
    """docs with n (units of the text), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output.

    A unit is a word with the white space before it, or white space at the end. Of 100 documents about
    `rearranged` are cut at two units drawn from seed and id, and of 100 of those about `suffix_first` have
    the suffix first; a text that is empty or holds a sentinel stays plain. A map without a shuffle, in
    which a text takes a few times its own size, however long it is. Null text is an empty one; a null id
    draws as an empty one does; repeated rows come out alike; an empty table gives an empty one. Other
    columns pass through, and a column named like a new one (in any case) is replaced by it.
    """
    kinds = {"n": T.LongType(), "form": T.StringType(), "prefix_chars": T.LongType(), "middle_chars": T.LongType(), "output": T.StringType()}

    def start():
        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            made = arrange(texts(batch, text_col), batch.column(id_col).to_pylist(), seed, rearranged, suffix_first)
            long = pa.int64()
            return [pa.array(made["n"], long), pa.array(made["form"]), pa.array(made["prefix_chars"], long), pa.array(made["middle_chars"], long), pa.array(made["output"], pa.binary()).cast(pa.string())]

        return compute

    return append_columns(docs, [T.StructField(c, t) for c, t in kinds.items()], start, [text_col, id_col])


def restored(output: Column, form: Column) -> Column:
    """The text that an output and its form came from. Null where either is."""
    part = F.split(output, "<[PSM]>", -1)
    psm = F.concat(part[1], part[3], part[2])
    spm = F.concat(part[2], part[3], part[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).when(form == "plain", output)
