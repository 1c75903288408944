"""Evaluation passages leaking into training text, by pigeonhole edit matching.

Texts are word-hash sequences in the normal form of lookalikes.py. Every run of WORDS consecutive words of a
held-out item is a passage. With an error budget of e words a passage is cut into e + 1 pieces, of which an
occurrence with at most e errors holds one unchanged; exact piece hits are found by binary search over the
sorted hashes of the pieces, and each hit is verified by Myers' bit-parallel distance of the passage to the
document around the hit, all hits of a batch at once. A distance of 0 is an exact passage.

The stated query set is the held-out table: it is read on the driver and broadcast in blocks of BLOCK_WORDS
words, one pass over the corpus for each block, so what is broadcast has a bound at any size of either side.

Defined cases: null and empty texts, and items of fewer than WORDS words, have no passage; an item stored
twice counts under both ids; repeated documents each count; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravand.llm import codepoints as cp
from ravand.session import spread

WORDS = 8
BUDGET = 1
BLOCK_WORDS = 1_000_000


def _sequences(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    hashes, _, first = cp.words(*cp.look(*cp.decode(pa.array(texts, pa.string()))))
    return hashes, first


def _gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Rolling hash of every `size` words in a row."""
    n = max(len(words) - size + 1, 0)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = cp.mix(out * np.uint64(31) + words[k : k + n])
    return out


def myers_distance(pattern: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Least edit distance of each pattern (rows of at most 63 symbols) to any part of its text row, in symbols."""
    rows, m = pattern.shape
    one = np.uint64(1)
    full = np.full(rows, (1 << m) - 1, np.uint64)
    top = np.uint64(1 << (m - 1))
    vp, vn = full.copy(), np.zeros(rows, np.uint64)
    score = np.full(rows, m, np.int64)
    best = score.copy()
    shifts = one << np.arange(m, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(text.shape[1]):
            eq = ((pattern == text[:, j : j + 1]) * shifts).sum(axis=1, dtype=np.uint64)
            x = eq | vn
            d0 = (((x & vp) + vp) ^ vp) | x
            hn = vp & d0
            hp = vn | ~(vp | d0)
            score += ((hp & top) != 0).astype(np.int64) - ((hn & top) != 0)
            hp, hn = hp << one, hn << one
            vp = (hn | ~(hp | d0)) & full
            vn = hp & d0 & full
            best = np.minimum(best, score)
    return best


class Passages:
    """The pieces of all passages of a block of items, ready to be searched for."""

    def __init__(self, ids: list[int], texts: list[str | None], words: int = WORDS, budget: int = BUDGET) -> None:
        self.words, self.budget, self.size = words, budget, words // (budget + 1)
        hashes, first = _sequences(texts)
        self.hashes = hashes
        self.item = np.repeat(np.array(ids, np.int64), np.diff(first))
        self.start = np.repeat(first[:-1], np.diff(first))
        self.end = np.repeat(first[1:], np.diff(first))
        grams = _gram_hashes(hashes, self.size)
        places = np.arange(len(grams))
        whole = places + self.size <= self.end[: len(grams)] if len(grams) else np.zeros(0, bool)
        whole &= (self.end - self.start)[: len(grams)] >= words
        places, grams = places[whole], grams[whole]
        order = np.argsort(grams, kind="stable")
        self.grams, self.places = grams[order], places[order]

    def search(self, hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, distance) for all passages within budget of a place in the texts; a pair once, at its best."""
        none = (np.zeros(0, np.int64),) * 3
        grams = _gram_hashes(hashes, self.size)
        if not len(grams) or not len(self.grams):
            return none
        low = np.searchsorted(self.grams, grams, side="left")
        hit = low < len(self.grams)
        hit[hit] = self.grams[low[hit]] == grams[hit]
        hit &= owner[: len(grams)] == owner[self.size - 1 :][: len(grams)]
        at = np.flatnonzero(hit)
        if not len(at):
            return none
        count = np.searchsorted(self.grams, grams[at], side="right") - low[at]
        found = []
        step = max(1, 400_000 // max(int(count.max()), 1))
        for k in range(0, len(at), step):  # a common piece may hit often: so many at a time
            found.append(self._verify(hashes, owner, at[k : k + step], low[at[k : k + step]], count[k : k + step]))
        text, item, distance = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((distance, item, text))
        text, item, distance = text[order], item[order], distance[order]
        once = np.ones(len(text), bool)
        once[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1])
        return text[once], item[once], distance[once]

    def _verify(self, hashes: np.ndarray, owner: np.ndarray, at: np.ndarray, low: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        doc = np.repeat(at, count)
        ends = np.cumsum(count)
        place = self.places[np.repeat(low - (ends - count), count) + np.arange(ends[-1])]
        out = []
        for piece in range(self.budget + 1):
            # the hit is this piece of the passage that begins `back` words before it
            back = piece * self.size
            begin = place - back
            fits = (begin >= self.start[place]) & (begin + self.words <= self.end[place])
            p, d, b = place[fits], doc[fits], begin[fits]
            pattern = self.hashes[b[:, None] + np.arange(self.words)]
            around = d[:, None] - back - self.budget + np.arange(self.words + 2 * self.budget)
            inside = (around >= 0) & (around < len(hashes))
            around = np.clip(around, 0, len(hashes) - 1)
            inside &= owner[around] == owner[d][:, None]
            text = np.where(inside, hashes[around], np.uint64(0))
            distance = myers_distance(pattern, text) if len(p) else np.zeros(0, np.int64)
            near = distance <= self.budget
            out.append((owner[d[near]], self.item[p[near]], distance[near]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def leaked_passages(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", words: int = WORDS, budget: int = BUDGET) -> DataFrame:
    """(item_id, doc_id, distance): documents that hold a passage of an item, and the least number of word errors."""
    rows = items.select(F.col(f"`{item_id}`").cast("bigint"), F.col(f"`{item_text}`")).where(F.col(f"`{item_text}`").isNotNull()).collect()
    texts = spread(documents.select(F.col(f"`{doc_id}`").cast("bigint"), F.col(f"`{doc_text}`")).where(F.col(f"`{doc_text}`").isNotNull()))
    schema = "item_id bigint, doc_id bigint, distance bigint"
    blocks, block, total = [], [], 0
    for row_id, text in rows:
        size = len(text.split())
        if block and total + size > BLOCK_WORDS:
            blocks.append(block)
            block, total = [], 0
        block.append((row_id, text))
        total += size
    if block:
        blocks.append(block)
    out = documents.sparkSession.createDataFrame([], schema)
    for k, block in enumerate(blocks):
        given = documents.sparkSession.sparkContext.broadcast(([i for i, _ in block], [t for _, t in block], words, budget))

        def run(batches: Iterator[pa.RecordBatch], given=given) -> Iterator[pa.RecordBatch]:
            passages = Passages(*given.value)
            for batch in batches:
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                for a, b in cp.blocks(batch.column(1)):
                    hashes, owner, _ = cp.words(*cp.look(*cp.decode(batch.column(1).slice(a, b - a))))
                    text, item, distance = passages.search(hashes, owner)
                    yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(ids[a:b][text]), pa.array(distance)], names=["item_id", "doc_id", "distance"])

        found = texts.mapInArrow(run, schema)
        out = found if k == 0 else out.unionByName(found)
    return out


def exact_leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, doc_id) where a document holds WORDS consecutive words of an item without an error."""
    return leaked_passages(documents, items).where("distance = 0").select("item_id", "doc_id")
