"""Token counts of a unigram tokenizer, without building its tokens."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ledgerloom.llm.batches import append_columns

MARK = "▁"  # stands for a space, and for the start of a text
#: What a character outside the vocabulary costs below the least score (a fixed value of the tokenizer).
UNKNOWN_PENALTY = 10.0
#: Distinct pieces between spaces whose count a Python worker remembers.
MEMO = 400_000
#: Characters, about, that are cut into words at a time.
PART = 1 << 20

_memo: dict[str, dict[str, int]] = {}


def vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece model file, by id."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter:
    """Counts for a vocabulary, with unknown characters taken byte by byte where it has all byte pieces."""

    def __init__(self, pieces: list[tuple[str, float]], unknown_id: int = 0):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.usable = len(self.automaton) > 0
        if self.usable:
            self.automaton.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.bytes = {p for p, _ in pieces} >= {f"<0x{b:02X}>" for b in range(256)}
        self.longest = max((len(p) for p, _ in pieces), default=1) or 1

    def count(self, text: str) -> int:
        """Pieces on the best path. Matches come by their end, the longest first, as ends are settled in
        order; a later start must be strictly better, and the unknown character comes last of all.

        A piece reaches back no further than the longest, so only so many places are remembered."""
        size = self.longest + 1
        best, pieces = [0.0] * size, [0] * size
        matches = self.automaton.iter(text) if self.usable and text else iter(())
        match, after_unknown, n = next(matches, None), False, 0
        for end in range(len(text)):
            top, known = None, False
            while match is not None and match[0] == end:
                length, score = match[1]
                at = (end + 1 - length) % size
                value = score + best[at]
                if top is None or value > top:
                    top, n = value, pieces[at] + 1
                known = known or length == 1
                match = next(matches, None)
            unknown = False
            if not known:
                at = end % size
                value = self.unknown + best[at]
                if top is None or value > top:
                    # a run of unknown characters is one piece, or the bytes of its characters
                    top, unknown = value, True
                    n = pieces[at] + (len(text[end].encode("utf-8", "surrogatepass")) if self.bytes else not after_unknown)
            best[(end + 1) % size], pieces[(end + 1) % size], after_unknown = top, n, unknown
        return n


@functools.cache
def _counter(path: str) -> Counter:
    return Counter(vocabulary(path))


def _words(marked: str) -> Iterator[str]:
    """What split(MARK) gives, of a part of the text at a time."""
    at = 0
    while (cut := marked.find(MARK, at + PART)) >= 0:
        yield from marked[at:cut].split(MARK)
        at = cut + 1
    yield from marked[at:].split(MARK)


def count_text(counter: Counter, text: str, memo: dict[str, int]) -> int:
    """Pieces of a whole text: spaces become marks, one stands before the text, and each mark begins a
    piece of its own, so words are counted one by one and a frequent word once."""
    if not text:
        return 0
    marked = text.replace(" ", MARK)
    total = 0
    for word in _words(marked.removeprefix(MARK)):
        n = memo.get(word)
        if n is None:
            n = counter.count(MARK + word)
            if len(memo) < MEMO and len(word) < 60:
                memo[word] = n
        total += n
    return total


def count_tokens(docs: DataFrame, model: str, *, text_col: str = "text", name: str = "n_tokens") -> DataFrame:
    """docs with the number of tokens of each whole text, in a map without a shuffle.

    A null or empty text has none. Beside the text itself, a word without a space takes no more memory
    the longer it is. Copies count alike, an empty table gives an empty one, and other
    columns pass through. model is a sentencepiece file; its pieces and scores are read as those of a
    unigram vocabulary.
    """

    def start():
        counter, memo = _counter(model), _memo.setdefault(model, {})
        return lambda batch: [pa.array([count_text(counter, t or "", memo) for t in batch.column(text_col).to_pylist()], pa.int64())]

    return append_columns(docs, [T.StructField(name, T.LongType())], start, [text_col])
