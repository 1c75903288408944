"""Same or near-same records across splits, by winnowing fingerprints.

Texts are word-hash sequences in the normal form of lookalikes.py, without case, marks and punctuation; exact
copies form one class and only classes are compared.

1. Rolling hashes cover every two words in a row. Of every window of them the minimum is selected; minima are
   ordered by how often the hash stands in the corpus, ties by the hash (otherwise template phrases would be the
   minima and join almost everything). A window follows from the longest run of words that a partner within
   tolerance must share (`window`), so a pair shares a minimum wherever words were changed, added or dropped.
2. A minimum is a seed with its place. One that is common in the corpus (over COMMON) is a seed only together
   with each of the next CHAINED common ones, and, in texts where one word may differ, with each of the two rarest
   other words. All this rests on the text alone, so both sides do the same.
3. A seed that many evaluation classes hold (HOT) would meet them all. It is joined together with each of the
   rarest distinct other words of the text, one more than words may differ: of texts within tolerance that share
   the seed, the rarest word they share is among those of both, so no pair is lost. In texts of over LONG words the
   rare words are those around the seed, so that rows grow with the length of a text and not with its square: a pair
   is found by any of its hot seeds around which at most two words in five differ, which is twice the share allowed.
4. Seeds of the two sides are joined. A meeting stays if lengths, places and 64-bit word maps allow a near text;
   the test is a necessary condition. The seeds of a pair are chained collinearly, and the chain is extended by
   alignment of what lies between. A pair is kept if at most a fifth of the longer text's words is left.

Counters, the filter of evaluation seeds and the list of hot seeds grow with the corpus up to a fixed size; beyond
it they only save less work.

Defined cases: null and blank texts, texts without a letter or digit, records without a known split or without
an id are no case; repeated rows are records of their own; other columns of the input don't matter.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravand.llm import codepoints as cp
from ravand.llm.group_split import split_name
from ravand.session import free, materialize, spread

#: One word in so many may differ.
TOLERANCE = 5
#: Occurrences in the corpus beyond which a minimum alone is no seed, and with how many next ones it is chained.
COMMON, CHAINED = 200, 3
#: Evaluation classes beyond which a seed is hot.
HOT = 200
#: Words beyond which rare words are taken from the REACH words on either side of a hot seed instead of the whole text; a partner has a fourth more at most.
LONG, REACH = 64, 20
#: Bounds of what is broadcast: counters of words and rolling hashes, bits of the seed filter, hot seeds.
MOST_COUNTERS, MOST_FILTER_BITS, MOST_HOT = 1 << 22, 1 << 27, 1 << 20


def word_sequences(df: DataFrame, keep: list[str], text: str) -> DataFrame:
    """`keep` with words (hashes of 32 bits, packed: far cheaper to move than an array) and (k1, k2), a hash of the sequence; rows without words are left out."""
    fields = df.select(*keep).schema
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", k1 bigint, k2 bigint, words binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(len(keep))
            for a, b in cp.blocks(column):
                hashes, owner, first = cp.words(*cp.look(*cp.decode(column.slice(a, b - a))))
                place = (np.arange(len(hashes)) - first[owner]).astype(np.uint64)
                size = np.diff(first)
                keys = []
                with np.errstate(over="ignore"):
                    for salt in (np.uint64(11), np.uint64(29)):
                        mixed = cp.mix(hashes + place * np.uint64(0x9E3779B97F4A7C15) + salt)
                        total = np.concatenate([[np.uint64(0)], np.cumsum(mixed, dtype=np.uint64)])
                        keys.append(pa.array(cp.mix(total[first[1:]] - total[first[:-1]]).view(np.int64)))
                packed = pa.py_buffer((hashes >> np.uint64(32)).astype("<u4").tobytes())
                words = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer((first * 4).astype(np.int32).tobytes()), packed])
                some = pa.array(size > 0)
                columns = [*(c.slice(a, b - a) for c in batch.columns[: len(keep)]), *keys, words]
                yield pa.RecordBatch.from_arrays([c.filter(some) for c in columns], names=[*keep, "k1", "k2", "words"])

    return spread(df.select(*keep, F.col(f"`{text}`").alias("__text")).where("__text is not null")).mapInArrow(run, schema)


def window(n: np.ndarray) -> np.ndarray:
    """Rolling hashes in a window, for texts of n words.

    A text of m words of which m // TOLERANCE differ keeps a run of 2 words at least for m = 5, of 3 for m up
    to 15, of 4 beyond; a partner may have a fourth more words.
    """
    return np.where(n < 6, 1, np.where(n < 16, 2, 3))


def rolling(words: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every two words in a row, place of the first) within texts."""
    at = np.flatnonzero(owner[1:] == owner[:-1]) if len(words) else np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        return cp.mix(cp.mix(words[at] * np.uint64(3)) + words[at + 1] * np.uint64(5)), at


def slots(hashes: np.ndarray, size: int) -> np.ndarray:
    return (hashes & np.uint64(size - 1)).astype(np.int64)


def winnow(grams: np.ndarray, owner: np.ndarray, width: np.ndarray, counters: np.ndarray) -> np.ndarray:
    """Numbers of the selected rolling hashes: the minimum of every window; a text shorter than a window is one."""
    if not len(grams):
        return np.zeros(0, np.int64)
    order = counters[slots(grams, len(counters))].astype(np.uint64) << np.uint64(48) | cp.mix(grams) >> np.uint64(16)
    count = np.bincount(owner)[owner]
    width = np.minimum(width[owner], count)
    chosen = []
    for w in (1, 2, 3):
        last = len(grams) - w + 1
        if last > 0:
            whole = (width[:last] == w) & (owner[:last] == owner[w - 1 :])
            views = np.stack([order[k : k + last] for k in range(w)])
            chosen.append((np.arange(last) + views.argmin(axis=0))[whole])
    return np.unique(np.concatenate(chosen))


def rare_words(words: np.ndarray, owner: np.ndarray, counters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct words of each text from the rarest on, first of each text)."""
    n = int(owner[-1]) + 1 if len(owner) else 0
    order = np.lexsort((words, counters[slots(cp.mix(words), len(counters))], owner))
    w, o = words[order], owner[order]
    once = np.ones(len(w), bool)
    once[1:] = (w[1:] != w[:-1]) | (o[1:] != o[:-1])
    w, o = w[once], o[once]
    return w, np.searchsorted(o, np.arange(n + 1))


def with_rare_words(sig: np.ndarray, who: np.ndarray, inner: np.ndarray, most: np.ndarray, rare: np.ndarray, first: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(seed number, hash, word) of each seed with each of the `most` rarest words of its text that are not among its own, `inner`.

    A text that has fewer is one in which none of them may be shared: the seed alone stands for it as well.
    """
    width = inner.shape[1]
    begin, total = first[who], first[who + 1] - first[who]
    reach = np.minimum(most + width, total)
    ends = np.cumsum(reach)
    row = np.repeat(np.arange(len(sig)), reach)
    place = np.arange(len(row)) - np.repeat(ends - reach, reach)
    word = rare[begin[row] + place]
    fresh = ~(inner[row] == word[:, None]).any(axis=1)
    rank = np.cumsum(fresh)
    before = np.concatenate([[0], rank])[ends - reach]
    fresh &= rank - before[row] <= most[row]
    found = np.bincount(row[fresh], minlength=len(sig))
    alone = np.flatnonzero(found < most)
    with np.errstate(over="ignore"):
        out = cp.mix(sig[row[fresh]] * np.uint64(7) + cp.mix(word[fresh] + np.uint64(salt)))
        single = cp.mix(sig[alone] * np.uint64(7) + np.uint64(salt + 1))
    return np.concatenate([row[fresh], alone]), np.concatenate([out, single]), np.concatenate([word[fresh], inner[alone, 0]])


def with_near_words(sig: np.ndarray, place: np.ndarray, inner: np.ndarray, words: np.ndarray, owner: np.ndarray, counters: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(seed number, hash) of each seed with each of the rarest words among the REACH before and behind it, two in five and one more.

    A window with fewer other words is one in which none of them may be shared: the seed alone stands for it as well.
    """
    numbers, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for a in range(0, len(sig), 20_000):
        s, own = sig[a : a + 20_000], inner[a : a + 20_000]
        around = place[a : a + 20_000, None] + np.arange(-REACH, REACH + 1)
        inside = (around >= 0) & (around < len(words))
        around = np.clip(around, 0, len(words) - 1)
        inside &= owner[around] == owner[place[a : a + 20_000]][:, None]
        word = words[around]
        most = inside.sum(axis=1) * 2 // TOLERANCE + 1
        # words are of 32 bits and ranks of 16: sorted as one number, what is outside last
        key = np.where(inside, counters[slots(cp.mix(word), len(counters))].astype(np.uint64) << np.uint64(32) | word, np.uint64(2**64 - 1))
        key.sort(axis=1)
        word = key & np.uint64(2**32 - 1)
        fresh = key != np.uint64(2**64 - 1)
        fresh[:, 1:] &= key[:, 1:] != key[:, :-1]
        for k in range(own.shape[1]):
            fresh &= word != own[:, k, None]
        fresh &= np.cumsum(fresh, axis=1) <= most[:, None]
        row, column = np.nonzero(fresh)
        alone = np.flatnonzero(fresh.sum(axis=1) < most)
        with np.errstate(over="ignore"):
            hashes += [cp.mix(s[row] * np.uint64(7) + cp.mix(word[row, column] + np.uint64(salt))), cp.mix(s[alone] * np.uint64(7) + np.uint64(salt + 1))]
        numbers += [row + a, alone + a]
    return np.concatenate(numbers), np.concatenate(hashes)


def text_seeds(words: np.ndarray, owner: np.ndarray, size: np.ndarray, counters: np.ndarray, hot: np.ndarray, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, place in the text) of the seeds of texts, without those that the bit map `among` rules out.

    `hot` are the hashes, sorted, that are joined with rare words.
    """
    grams, at = rolling(words, owner)
    chosen = winnow(grams, owner[at], window(size), counters)
    grams, at = grams[chosen], at[chosen]
    who = owner[at]
    first = np.concatenate([[0], np.cumsum(size)])
    common = counters[slots(grams, len(counters))] > COMMON
    pairs_of = np.stack([words[at], words[at + 1]], axis=1) if len(at) else np.zeros((0, 2), np.uint64)
    sigs, texts, places, inner = [grams[~common]], [who[~common]], [at[~common]], [np.repeat(pairs_of[~common], 2, axis=1)]
    g, o, a, p = grams[common], who[common], at[common], pairs_of[common]
    for step in range(1, CHAINED + 1):
        same = np.flatnonzero(o[step:] == o[:-step]) if len(o) > step else np.zeros(0, np.int64)
        with np.errstate(over="ignore"):
            sigs.append(cp.mix(g[same] * np.uint64(3) + cp.mix(g[same + step] * np.uint64(5))))
        texts.append(o[same])
        places.append(a[same])
        inner.append(np.concatenate([p[same], p[same + step]], axis=1))
    few = np.flatnonzero(size[o] < 2 * TOLERANCE)
    rare = rare_words(words, owner, counters) if len(few) or len(hot) else None
    if len(few):
        number, h, word = with_rare_words(g[few], o[few], p[few], np.full(len(few), 2), *rare, 31)
        sigs.append(h)
        texts.append(o[few][number])
        places.append(a[few][number])
        inner.append(np.concatenate([p[few][number], word[:, None], word[:, None]], axis=1))
    sig, text, place, inside = (np.concatenate(x) for x in (sigs, texts, places, inner))
    if among is not None:
        low = sig & np.uint64(len(among) * 64 - 1)
        may = (among[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63))) & np.uint64(1) == 1
        sig, text, place, inside = sig[may], text[may], place[may], inside[may]
    if len(hot) and len(sig):
        near = np.minimum(np.searchsorted(hot, sig), len(hot) - 1)
        is_hot = np.flatnonzero(hot[near] == sig)
        if len(is_hot):
            length = size[text[is_hot]]
            whole, long = is_hot[length <= LONG * 25 // 16], is_hot[length > LONG]
            number, h, _ = with_rare_words(sig[whole], text[whole], inside[whole], size[text[whole]] // TOLERANCE + 1, *rare, 57)
            number_long, h_long = with_near_words(sig[long], place[long], inside[long], words, owner, counters, 91)
            cool = np.ones(len(sig), bool)
            cool[is_hot] = False
            at = np.concatenate([np.flatnonzero(cool), whole[number], long[number_long]])
            sig, text, place = np.concatenate([sig[cool], h, h_long]), text[at], place[at]
    return sig, text, place - first[text]


def _batches(batches: Iterator[pa.RecordBatch], most: int = 100_000) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of (cid, words) batches of about `most` words, with words, text index and sizes."""
    for whole in batches:
        column = whole.column(1).cast(pa.large_binary())
        bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        sizes = np.diff(bounds) // 4
        block = np.cumsum(sizes) // most
        cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(sizes)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a < b:
                words = np.frombuffer(column.buffers()[2][int(bounds[a]) : int(bounds[b])].to_pybytes(), "<u4").astype(np.uint64)
                yield whole.slice(a, b - a), words, np.repeat(np.arange(b - a), sizes[a:b]), sizes[a:b]


def _power_of_two(n: int, least: int, most: int) -> int:
    return max(least, min(most, 1 << max(n - 1, 1).bit_length()))


def rank_of(counts: np.ndarray) -> np.ndarray:
    """Counts in two bytes each: exact up to 1,024, their logarithm beyond; the order stays."""
    large = 1024 + 64 * np.log2(np.maximum(counts, 1024) / 1024)
    return np.where(counts <= 1024, counts, large).astype(np.uint16)


def word_counters(classes: DataFrame, size: int) -> np.ndarray:
    """How often words and rolling hashes stand in the texts of `classes`, by counter (`rank_of`)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(size, np.int64)
        for _, words, owner, _ in _batches(batches, 1_000_000):
            table += np.bincount(slots(cp.mix(words), size), minlength=size)
            table += np.bincount(slots(rolling(words, owner)[0], size), minlength=size)
        some = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(table[some])], names=["i", "n"])

    counted = classes.select("cid", "words").mapInArrow(run, "i int, n bigint").groupBy("i").agg(F.sum("n").alias("n")).where("n > 1").toPandas()
    out = np.ones(size, np.uint16)
    out[counted["i"].to_numpy(np.int64)] = rank_of(counted["n"].to_numpy(np.int64))
    return out


def seed_filter(counts: DataFrame, bits: int) -> np.ndarray:
    """Bit map of the hashes of `counts`: one whose bit is not set is not among them."""
    place = F.expr(f"cast(shiftright(sig & {bits - 1}L, 6) as int)")
    words = counts.groupBy(place.alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, cast(sig & 63 as int))")).alias("w")).toPandas()
    out = np.zeros(bits // 64, np.int64)
    out[words["i"].to_numpy(np.int64)] = words["w"].to_numpy(np.int64)
    return out.view(np.uint64)


def class_seeds(classes: DataFrame, counters: Broadcast, hot: Broadcast | None = None, among: Broadcast | None = None) -> DataFrame:
    """(sig, cid, n, lo, hi, map) for every seed of every class, without those that `among` rules out; lo and hi are its first and last place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, refined, wanted = counters.value, hot.value if hot else np.zeros(0, np.uint64), among.value if among else None
        for batch, words, owner, size in _batches(batches):
            sig, who, place = text_seeds(words, owner, size, table, refined, wanted)
            order = np.lexsort((place, sig, who))
            sig, who, place = sig[order], who[order], place[order]
            begins = np.ones(len(sig), bool)
            begins[1:] = (sig[1:] != sig[:-1]) | (who[1:] != who[:-1])
            lo = np.flatnonzero(begins)
            hi = np.append(lo[1:], len(sig))[: len(lo)] - 1
            first = np.concatenate([[0], np.cumsum(size)])
            bit = np.uint64(1) << (cp.mix(words + np.uint64(77)) >> np.uint64(58))
            maps = np.zeros(len(size), np.uint64)
            some = size > 0
            if len(words):
                maps[some] = np.bitwise_or.reduceat(bit, first[:-1][some])
            own = who[lo]
            columns = [pa.array(sig[lo].view(np.int64)), batch.column(0).take(pa.array(own)), *(pa.array(x.astype(np.int32)) for x in (size[own], place[lo], place[hi])), pa.array(maps[own].view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["sig", "cid", "n", "lo", "hi", "map"])

    return classes.select("cid", "words").mapInArrow(run, "sig bigint, cid bigint, n int, lo int, hi int, map bigint")


def chain(hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest chain of seed hits (place, place) that go forward in both texts."""
    hits = sorted(set(hits), key=lambda h: (h[0], -h[1]))
    tails: list[int] = []
    heads: list[int] = []
    back: list[int] = []
    for k, (_, b) in enumerate(hits):
        at = bisect_left(tails, b)
        back.append(heads[at - 1] if at else -1)
        if at == len(tails):
            tails.append(b)
            heads.append(k)
        else:
            tails[at], heads[at] = b, k
    out, k = [], heads[-1] if heads else -1
    while k >= 0:
        out.append(hits[k])
        k = back[k]
    return out[::-1]


def chain_length(a: list[int], b: list[int]) -> int:
    """Length of the longest collinear chain of equal words of two texts (bit-parallel alignment)."""
    if not a or not b:
        return 0
    places: dict[int, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        match = row & places.get(w, 0)
        row = ((row + match) | (row - match)) & full
    return len(a) - row.bit_count()


def extended(a: list[int], b: list[int], seeds: list[tuple[int, int]]) -> int:
    """Words matched by the chain of `seeds`, each extended as far as words agree, with alignment of what lies between."""
    matched = x = y = 0
    for p, q in seeds:
        if p < x or q < y:
            continue
        matched += chain_length(a[x:p], b[y:q])
        x, y = p, q
        while x < len(a) and y < len(b) and a[x] == b[y]:
            x, y, matched = x + 1, y + 1, matched + 1
    return matched + chain_length(a[x:], b[y:])


def aligned(pairs: DataFrame) -> DataFrame:
    """Of (ca, cb, hits, wa, wb) the pairs within tolerance: (ca, cb, matched, na, nb).

    Where the chain of seeds leaves too much, the whole texts are aligned, as an exact check.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ca, cb, kept = [], [], []
            for x, y, hits, wa, wb in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                wa, wb = (np.frombuffer(w, "<u4").tolist() for w in (wa, wb))
                most = max(len(wa), len(wb))
                matched = extended(wa, wb, chain([(h["a"], h["b"]) for h in hits]))
                if (most - matched) * TOLERANCE > most:
                    matched = chain_length(wa, wb)
                if (most - matched) * TOLERANCE <= most:
                    ca.append(x)
                    cb.append(y)
                    kept.append((matched, len(wa), len(wb)))
            counts = [pa.array([k[i] for k in kept], pa.int32()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(ca, pa.int64()), pa.array(cb, pa.int64()), *counts], names=["ca", "cb", "matched", "na", "nb"])

    return pairs.select("ca", "cb", "hits", "wa", "wb").mapInArrow(run, "ca bigint, cb bigint, matched int, na int, nb int")


def _side(split: Column) -> Column:
    name = split_name(split)
    return F.when(name == "train", True).when(name.isin("validation", "test"), False)


#: Differences allowed between two texts, of their lengths and of the places of a seed in them.
_FEW = f"(greatest(ta.n, tb.n) div {TOLERANCE})"
NEAR = (
    f"ta.cid <> tb.cid and abs(ta.n - tb.n) <= {_FEW} and bit_count(ta.map ^ tb.map) <= 2 * {_FEW} "
    f"and ta.lo - tb.hi <= least(0, ta.n - tb.n) + {_FEW} and ta.hi - tb.lo >= greatest(0, ta.n - tb.n) - {_FEW}"
)


def candidates(classes: DataFrame) -> DataFrame:
    """(ca, cb, hits), a written table, of classes of train and evaluation records that share a seed where a near text may have it."""
    context = classes.sparkSession.sparkContext
    n = classes.count()
    counters = context.broadcast(word_counters(classes, _power_of_two(4 * n, 1 << 16, MOST_COUNTERS)))
    train, held_out = classes.where("in_train"), classes.where("in_eval")
    counts = materialize(class_seeds(held_out, counters).groupBy("sig").agg(F.count(F.lit(1)).alias("n")))
    among = seed_filter(counts, _power_of_two(48 * n, 1 << 16, MOST_FILTER_BITS))
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.where(F.col("n") > max(HOT, total // MOST_HOT)).select("sig").toPandas()["sig"].to_numpy(np.int64).view(np.uint64)
    hot, among = context.broadcast(np.sort(hot)), context.broadcast(among)
    # most train seeds meet no evaluation seed: the filter keeps them out of the shuffle
    ta, tb = (class_seeds(side, counters, hot, among) for side in (train, held_out))
    meetings = ta.alias("ta").join(tb.alias("tb"), F.expr(f"ta.sig = tb.sig and {NEAR}")).selectExpr("ta.cid as ca", "tb.cid as cb", "ta.lo as a", "tb.lo as b")
    met = materialize(meetings.groupBy("ca", "cb").agg(F.collect_set(F.struct("a", "b")).alias("hits")))
    free(counts)
    for given in (counters, hot, among):
        given.destroy()
    return met


def cross_split_classes(df: DataFrame, row_id: str = "rec_id", text: str = "text", split: str = "split") -> tuple[DataFrame, DataFrame]:
    """(members, links): links (ca, cb, matched, na, nb) of a class in train and one in evaluation, members (rec_id, in_train, cid) of those classes.

    A class that is in both stands in links with itself. Both are written tables.
    """
    source = df.select(F.col(f"`{row_id}`").cast("bigint").alias("rec_id"), _side(F.col(f"`{split}`")).alias("in_train"), F.col(f"`{text}`").alias("text")).where("in_train is not null and rec_id is not null")
    sequences = materialize(word_sequences(source, ["rec_id", "in_train"], "text"))
    classes = materialize(sequences.groupBy("k1", "k2").agg(F.min("rec_id").alias("cid"), F.bool_or("in_train").alias("in_train"), F.bool_or(~F.col("in_train")).alias("in_eval"), F.first("words").alias("words")))
    met = candidates(classes)
    needed = met.select(F.explode(F.array("ca", "cb")).alias("cid"))
    texts = materialize(classes.select("cid", "words").join(needed, "cid", "left_semi"))
    pairs = met.join(texts.select(F.col("cid").alias("ca"), F.col("words").alias("wa")), "ca").join(texts.select(F.col("cid").alias("cb"), F.col("words").alias("wb")), "cb")
    same = classes.where("in_train and in_eval").select(F.col("cid").alias("ca"), F.col("cid").alias("cb"), *[F.expr("int(octet_length(words) div 4)").alias(c) for c in ("matched", "na", "nb")])
    links = materialize(aligned(spread(pairs)).unionByName(same))
    linked = classes.select("k1", "k2", "cid").join(links.select(F.explode(F.array("ca", "cb")).alias("cid")), "cid", "left_semi")
    members = materialize(sequences.select("rec_id", "in_train", "k1", "k2").join(linked, ["k1", "k2"]).select("rec_id", "in_train", "cid"))
    free(sequences, classes, met, texts)
    return members, links


def cross_split_pairs(df: DataFrame, row_id: str = "rec_id", text: str = "text", split: str = "split") -> DataFrame:
    """(rec_id_a, rec_id_b): every pair of a train and an evaluation record with same or near-same texts."""
    members, links = cross_split_classes(df, row_id, text, split)
    t = members.where("in_train").select(F.col("cid").alias("ca"), F.col("rec_id").alias("rt"))
    e = members.where("not in_train").select(F.col("cid").alias("cb"), F.col("rec_id").alias("re"))
    return links.join(t, "ca").join(e, "cb").select(F.least("rt", "re").alias("rec_id_a"), F.greatest("rt", "re").alias("rec_id_b"))


def _evaluation(df: DataFrame, row_id: str, split: str, dataset: str) -> DataFrame:
    return df.select(F.col(f"`{row_id}`").cast("bigint").alias("rec_id"), split_name(F.col(f"`{split}`")).alias("split"), F.col(f"`{dataset}`").alias("dataset")).where("split in ('validation', 'test')")


def record_coverage(df: DataFrame, row_id: str = "rec_id", text: str = "text", split: str = "split", dataset: str = "dataset") -> DataFrame:
    """Per overlapping evaluation record and train dataset: (rec_id, split, dataset, train_dataset, n_train, n_same, coverage).

    coverage is the best share of the record's words that lie in the chain with one train record of that dataset.
    """
    members, links = cross_split_classes(df, row_id, text, split)
    sources = df.select(F.col(f"`{row_id}`").cast("bigint").alias("rec_id"), F.col(f"`{dataset}`").alias("train_dataset"))
    held = members.where("in_train").join(sources, "rec_id").groupBy("cid", "train_dataset").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("cid", "ca")
    best = links.join(held, "ca").groupBy("cb", "train_dataset").agg(F.sum("n").alias("n_train"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("n")).otherwise(0)).alias("n_same"), F.max(F.col("matched") / F.col("nb")).alias("coverage"))
    own = members.where("not in_train").select("rec_id", F.col("cid").alias("cb")).join(_evaluation(df, row_id, split, dataset), "rec_id")
    return own.join(best, "cb").select("rec_id", "split", "dataset", "train_dataset", "n_train", "n_same", "coverage")


def overlap_report(df: DataFrame, row_id: str = "rec_id", text: str = "text", split: str = "split", dataset: str = "dataset") -> DataFrame:
    """Per split and dataset of the evaluation records: records, those that also stand in train, and how much of them.

    (split, dataset, n_records, n_overlapping, n_same, mean_coverage): coverage is the best share of an
    overlapping record's words that lie in the chain with one train record.
    """
    members, links = cross_split_classes(df, row_id, text, split)
    best = links.groupBy("cb").agg(F.max(F.col("matched") / F.col("nb")).alias("coverage"), F.bool_or(F.col("ca") == F.col("cb")).alias("same"))
    found = members.where("not in_train").join(best, F.col("cid") == F.col("cb")).select("rec_id", "coverage", "same")
    return (
        _evaluation(df, row_id, split, dataset)
        .join(found, "rec_id", "left")
        .groupBy("split", "dataset")
        .agg(F.count(F.lit(1)).alias("n_records"), F.count("coverage").alias("n_overlapping"), F.count_if("same").alias("n_same"), F.avg("coverage").alias("mean_coverage"))
    )
