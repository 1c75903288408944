"""Encoding of a whole corpus with a public byte-level BPE tokenizer, by batched numpy merge rounds.

The texts of a batch are one byte array. Words (the tokenizer's pre-tokens) are found by array comparisons of
character classes; only words that a worker has not seen are merged: their symbols lie in one flat array,
and each round merges, in every word, all places of its lowest-ranked pair, found by binary search over the
sorted pair keys.

Defined cases: an empty text and a null text give an empty list; blanks are encoded as they stand; strings of
special tokens are ordinary text. Ids are those of the tokenizer file.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravand.llm import codepoints as cp
from ravand.session import spread

#: Words a worker remembers with their ids; beyond it the memory starts anew (a bound of memory, not of words).
REMEMBERED = 1_000_000
NONE = np.iinfo(np.int64).max


class Vocabulary(NamedTuple):
    """A byte-level BPE model: about 50,000 pairs, whatever the size of the corpus."""

    byte_ids: np.ndarray  # id of each single byte
    keys: np.ndarray  # sorted: left id << 32 | right id
    ranks: np.ndarray
    merged: np.ndarray


def load_vocabulary(path: str) -> Vocabulary:
    """Read a tokenizers-library JSON file of a byte-level BPE model."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab = model["vocab"]
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {b: chr(b) for b in printable}
    shown |= {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in shown)}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
    merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
    order = np.argsort(keys, kind="stable")
    return Vocabulary(np.array([vocab[shown[b]] for b in range(256)], np.int64), keys[order], order.astype(np.int64), merged[order])


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """By code point: 1 letter, 2 number, 3 white space, 0 anything else, as the pre-token pattern sees them."""
    out = np.zeros(cp.LIMIT, np.uint8)
    for lo, hi in ((0, 0x3400), (0xA000, 0xAC00), (0xF900, 0x20000)):
        for c in range(lo, hi):
            out[c] = {"L": 1, "N": 2}.get(unicodedata.category(chr(c))[0], 0)
    for lo, hi in ((0x3400, 0x4DC0), (0x4E00, 0xA000), (0xAC00, 0xD7A4), (0x20000, 0x2A6E0), (0x2A700, 0x2B73A), (0x2B740, 0x2B81E), (0x2B820, 0x2CEA2), (0x2CEB0, 0x2EBE1), (0x2EBF0, 0x2EE5E), (0x2F800, 0x2FA1E), (0x30000, 0x3134B), (0x31350, 0x323B0)):
        out[lo:hi] = 1
    for c in (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
        out[c] = 3
    return out


def split_words(cps: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Places where a pre-token begins: runs of letters, numbers or other marks, each with one space before it;
    the endings after an apostrophe ('s 't 'm 'd 're 've 'll); white space, of which the last goes apart."""
    n = len(cps)
    kind = _classes()[cps]
    begin = np.zeros(n + 1, bool)
    begin[offs] = True
    edge = begin.copy()  # the first character of a text, and the end of all
    begin[1:n] |= kind[1:] != kind[:-1]
    starts_run = begin.copy()
    white = kind == 3
    # the last blank of a run that ends before other text: a space goes with what follows, another blank apart
    last = np.flatnonzero(white[:-1] & ~white[1:] & ~edge[1:n]) if n > 1 else np.zeros(0, np.int64)
    begin[last] = True
    spaced = last[cps[last] == 0x20]
    begin[spaced + 1] = False
    # an apostrophe that begins a run of other marks of its own, and the letters of an ending behind it
    mark = np.flatnonzero((cps == 0x27) & starts_run[:n])
    mark = mark[begin[mark] & (mark + 1 < n)]
    mark = mark[(kind[mark + 1] == 1) & ~edge[mark + 1]]
    if len(mark):
        one = cps[mark + 1]
        second = np.where((mark + 2 < n) & ~edge[np.minimum(mark + 2, n)], cps[np.minimum(mark + 2, n - 1)], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        double = ((one == ord("r")) & (second == ord("e"))) | ((one == ord("v")) & (second == ord("e"))) | ((one == ord("l")) & (second == ord("l")))
        taken = mark[short | double]
        begin[taken + 1] = False
        begin[taken + 2 + double[short | double]] = True  # what is left of the run of letters, if any, or what follows
        # a space after the ending keeps its place as the beginning of the next word
        after = taken + 2 + double[short | double]
        after = after[after < n]
        swallowed = after[(after > 0) & white[np.maximum(after, 0)]]
        begin[swallowed] = True
    return np.flatnonzero(begin[:n])


def merge_words(ids: np.ndarray, word: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """BPE of many words at once. `ids`: symbols of all words, `word`: the word of each; both come back merged."""
    done_ids, done_word = [], []
    while len(ids):
        same = word[1:] == word[:-1]
        key = ids[:-1] << 32 | ids[1:]
        at = np.searchsorted(vocab.keys, key)
        at[at == len(vocab.keys)] = 0
        rank = np.where(same & (vocab.keys[at] == key), vocab.ranks[at], NONE)
        rank = np.append(rank, NONE)
        first = np.flatnonzero(np.concatenate([[True], ~same]))
        lowest = np.minimum.reduceat(rank, first)
        size = np.diff(np.append(first, len(ids)))
        low = np.repeat(lowest, size)
        over = low == NONE
        if over.any():
            done_ids.append(ids[over])
            done_word.append(word[over])
        take = (rank == low) & ~over
        # of places of one pair that overlap (as in aaa) every second one counts, from the left
        run = take.copy()
        run[1:] &= ~take[:-1]
        place = np.arange(len(ids))
        odd = (place - np.maximum.accumulate(np.where(run, place, 0))) % 2 == 1
        take &= ~(odd & take)
        ids = ids.copy()
        hits = np.flatnonzero(take)
        ids[hits] = vocab.merged[at[hits]]
        keep = ~over
        keep[hits + 1] = False
        ids, word = ids[keep], word[keep]
    if not done_ids:
        return ids, word
    ids, word = np.concatenate(done_ids), np.concatenate(done_word)
    order = np.argsort(word, kind="stable")
    return ids[order], word[order]


class Encoder:
    """Encodes batches of texts and remembers the words it has merged."""

    def __init__(self, vocab: Vocabulary) -> None:
        self.vocab = vocab
        self.forget()

    def forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)  # sorted
        self.slot = np.zeros(0, np.int64)
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets)."""
        cps, offs = cp.decode(texts)
        if not len(cps):
            return np.zeros(0, np.int32), np.zeros(len(offs), np.int64)
        starts = split_words(cps, offs)
        ends = np.append(starts[1:], len(cps))
        place = np.arange(len(cps)) - np.repeat(starts, ends - starts)
        with np.errstate(over="ignore"):
            hashes = cp.mix(np.add.reduceat(cp.mix((cps.astype(np.uint64) << np.uint64(32)) + place.astype(np.uint64)), starts))
        unique, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.hashes) + len(unique) > REMEMBERED:
            self.forget()
        at = np.searchsorted(self.hashes, unique)
        known = at < len(self.hashes)
        known[known] = self.hashes[at[known]] == unique[known]
        if not known.all():
            self._learn(cps, starts[where[~known]], ends[where[~known]], unique[~known])
            at = np.searchsorted(self.hashes, unique)
        slot = self.slot[at][back]
        size = self.size[slot]
        total = np.concatenate([[0], np.cumsum(size)])
        flat = self.ids[np.repeat(self.start[slot] - total[:-1], size) + np.arange(total[-1])]
        return flat, total[np.searchsorted(starts, offs)]

    def _learn(self, cps: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> None:
        size = ends - starts
        first = np.concatenate([[0], np.cumsum(size)])
        chars = cps[np.repeat(starts - first[:-1], size) + np.arange(first[-1])]
        raw = np.frombuffer(chars.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
        width = 1 + (chars >= 0x80).astype(np.int64) + (chars >= 0x800) + (chars >= 0x10000)
        word = np.repeat(np.repeat(np.arange(len(size)), size), width)
        ids, word = merge_words(self.vocab.byte_ids[raw], word, self.vocab)
        count = np.bincount(word, minlength=len(size))
        begin = len(self.ids) + np.concatenate([[0], np.cumsum(count)[:-1]]).astype(np.int64)
        slots = len(self.start) + np.arange(len(size))
        self.start, self.size = np.concatenate([self.start, begin]), np.concatenate([self.size, count])
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
        at = np.searchsorted(self.hashes, hashes)  # both are sorted: they are merged
        self.hashes, self.slot = np.insert(self.hashes, at, hashes), np.insert(self.slot, at, slots)


def encode_corpus(df: DataFrame, row_id: str, text: str, tokenizer: str = "/opt/tokenizers/byte_bpe_50k.json") -> DataFrame:
    """(`row_id`, ids array<int>) of every row. The model (a file of fixed size) is read on the driver and broadcast."""
    model = df.sparkSession.sparkContext.broadcast(tuple(load_vocabulary(tokenizer)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary(*model.value))
        for batch in batches:
            for a, b in cp.blocks(batch.column(1), 600_000):
                ids, offs = encoder.encode(batch.column(1).slice(a, b - a))
                lists = pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], names=[row_id, "ids"])

    kind = df.schema[row_id].dataType.simpleString()
    return spread(df.select(F.col(f"`{row_id}`"), F.col(f"`{text}`"))).mapInArrow(run, f"`{row_id}` {kind}, ids array<int>")
