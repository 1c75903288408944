"""Arrow text as flat numpy code-point arrays, and the look-alike normal form on top of them.

A batch of texts is one uint32 array of code points plus int64 offsets (text i is
``cps[offs[i]:offs[i + 1]]``). All steps are array operations over the whole batch.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LIMIT = 0x110000


def decode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points and offsets of an Arrow string array; a null counts as an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offs = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False), out=offs[1:])
    if not len(texts) or not offs[-1]:
        return np.zeros(0, np.uint32), offs
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2][int(bounds[0]) : int(bounds[-1])].to_pybytes()
    cps = np.frombuffer(raw.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    return cps, offs


def encode(cps: np.ndarray, offs: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """The inverse of decode(); `valid` marks the rows that are not null."""
    width = 1 + (cps >= 0x80).astype(np.int64) + (cps >= 0x800) + (cps >= 0x10000)
    ends = np.concatenate([[0], np.cumsum(width)])[offs].astype(np.int64)
    raw = cps.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    array = pa.Array.from_buffers(pa.large_string(), len(offs) - 1, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(raw)])
    if valid is not None and not valid.all():
        array = pc.if_else(pa.array(valid), array, pa.scalar(None, pa.large_string()))
    return array.cast(pa.string()) if ends[-1] < 2**31 else array


# Letters of other scripts that are drawn like a Latin letter, in code-point order.
LOOKALIKE_LETTERS = {
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ϲ": "c", "ϳ": "j", "Ϲ": "C",
    # Cyrillic
    "Ѕ": "S", "І": "I", "Ј": "J", "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O",
    "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c",
    "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "Ү": "Y", "ү": "y", "Ӏ": "I", "ԁ": "d", "ԛ": "q", "Ԛ": "Q",
    "ԝ": "w", "Ԝ": "W",
    # Armenian
    "ո": "n", "ս": "u", "օ": "o", "Տ": "S", "Օ": "O",
    # Arabic letters written with another letter's shape
    "ى": "ی", "ي": "ی", "ك": "ک", "ە": "ه",
    # Arabic-Indic digits drawn like the Persian ones; four, five and six differ
    "٠": "۰", "١": "۱", "٢": "۲", "٣": "۳", "٧": "۷", "٨": "۸", "٩": "۹",
}
#: Characters that are not drawn and change nothing that is.
INVISIBLE = [0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180E, 0x200B, 0x200D, 0x200E, 0x200F, *range(0x202A, 0x202F), *range(0x2060, 0x2070), 0x3164, *range(0xFE00, 0xFE10), 0xFEFF, 0xFFA0, *range(0xE0000, 0xE0080), *range(0xE0100, 0xE01F0)]
BLANKS = [0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]
#: Blocks whose characters are only other forms of ordinary ones: ligatures, presentation and full-width forms.
FORMS = [(0xFB00, 0xFB07), (0xFB13, 0xFB18), (0xFB1D, 0xFBB2), (0xFBD3, 0xFDFE), (0xFE70, 0xFEFD), (0xFF01, 0xFF9F), (0xFFE0, 0xFFEF)]
ZWNJ = 0x200C
DECOMPOSED = [(0x20, 0x3400), (0xA640, 0xABFF), (0xF900, 0x10000), (0x11000, 0x11FFF), (0x1D100, 0x1D200), (0x1F100, 0x1F200), (0x2F800, 0x2FA20)]


class _Tables:
    """Lookup tables by code point, built once for each Python worker."""

    def __init__(self) -> None:
        fold = {ord(a): ord(b) for a, b in LOOKALIKE_LETTERS.items()}
        gone = set(INVISIBLE)
        blank = set(BLANKS)
        forms = {c for lo, hi in FORMS for c in range(lo, hi)}
        self.size = np.ones(LIMIT, np.uint8)
        self.at = np.arange(LIMIT, dtype=np.int32)
        extra: list[int] = []
        ccc = np.zeros(LIMIT, np.uint8)
        for lo, hi in DECOMPOSED:
            for c in range(lo, hi):
                if 0xD800 <= c < 0xE000:
                    continue
                ch = chr(c)
                ccc[c] = unicodedata.combining(ch)
                if c in gone:
                    new: list[int] = []
                elif c in blank:
                    new = [0x20]
                else:
                    text = unicodedata.normalize("NFKD" if c in forms else "NFD", ch)
                    new = [fold.get(ord(x), ord(x)) for x in text if ord(x) not in gone]
                    if c in forms:
                        new = [0x20 if x in blank else x for x in new]
                    if c == 0x6C0:  # heh with yeh above is heh and a hamza, however it is stored
                        new = [0x647, 0x654]
                if new != [c]:
                    self.size[c], self.at[c] = len(new), LIMIT + len(extra)
                    extra += new
        for c in range(0xE0000, 0xE01F0):
            if c in gone:
                self.size[c] = 0
        self.flat = np.concatenate([np.arange(LIMIT, dtype=np.uint32), np.array(extra, np.uint32)])
        self.ccc = ccc
        pairs: dict[int, int] = {}
        for lo, hi in DECOMPOSED:
            for c in range(lo, hi):
                if 0xD800 <= c < 0xE000 or c in forms:
                    continue
                text = unicodedata.decomposition(chr(c))
                if text and text[0] != "<" and len(parts := text.split()) == 2 and unicodedata.normalize("NFC", unicodedata.normalize("NFD", chr(c))) == chr(c):
                    a, b = int(parts[0], 16), int(parts[1], 16)
                    if a not in fold:
                        pairs[a << 21 | b] = c
                    elif 0x600 <= a < 0x700:  # yeh with hamza is written with a folded yeh
                        pairs[fold[a] << 21 | b] = c
        pairs.pop(0x647 << 21 | 0x654, None)
        keys = np.array(sorted(pairs), np.int64)
        self.pair_keys, self.pair_to = keys, np.array([pairs[int(k)] for k in keys], np.uint32)
        self.second = np.zeros(LIMIT, bool)
        self.second[keys & 0x1FFFFF] = True
        self.second[0x1161:0x1176] = self.second[0x11A8:0x11C3] = True
        self.joins = self.second | (ccc > 0)


@lru_cache(maxsize=1)
def tables() -> _Tables:
    return _Tables()


@lru_cache(maxsize=1)
def letter_class() -> np.ndarray:
    """By code point: 1 letter, 2 decimal digit or other number, 3 combining mark, 0 anything else."""
    out = np.zeros(LIMIT, np.uint8)
    for lo, hi in ((0, 0x3400), (0xA000, 0xAC00), (0xF900, 0x20000)):
        for c in range(lo, hi):
            kind = unicodedata.category(chr(c))[0]
            out[c] = {"L": 1, "N": 2, "M": 3}.get(kind, 0)
    for lo, hi in ((0x3400, 0x4DC0), (0x4E00, 0xA000), (0xAC00, 0xD7A4), (0x20000, 0x323B0)):
        out[lo:hi] = 1
    return out


@lru_cache(maxsize=1)
def lower_table() -> np.ndarray:
    """Simple lower-case mapping by code point."""
    out = np.arange(LIMIT, dtype=np.uint32)
    for lo, hi in ((0x41, 0x600), (0x10A0, 0x1100), (0x13A0, 0x1400), (0x1C80, 0x2000), (0x2100, 0x2200), (0x2C00, 0x2E00), (0xA640, 0xAC00), (0xFF21, 0xFF3B), (0x10400, 0x10600), (0x1E900, 0x1E944)):
        for c in range(lo, hi):
            x = chr(c).lower()
            if len(x) == 1:
                out[c] = ord(x)
    return out


def drop(cps: np.ndarray, offs: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points where `keep` holds, with their offsets."""
    return cps[keep], np.concatenate([[0], np.cumsum(keep)])[offs]


def gather(cps: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded and decomposed: each code point is replaced by its table entry of none, one or more."""
    t = tables()
    size = t.size[cps]
    if (size == 1).all():
        return t.flat[t.at[cps]], offs
    ends = np.cumsum(size, dtype=np.int64)
    start = np.repeat(t.at[cps].astype(np.int64) - (ends - size), size)
    return t.flat[start + np.arange(len(start))], np.concatenate([[0], ends])[offs]


def compose(cps: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks in canonical order and composed with their letters; a mark never joins the text before."""
    t = tables()
    joins = t.joins[cps]
    if not joins.any():
        return cps, offs
    # only marks and what stands before them take part: a small array with the same neighbours
    near = joins.copy()
    near[:-1] |= joins[1:]
    place = np.flatnonzero(near)
    sub = cps[place]
    ccc = t.ccc[sub]
    first = ~joins[place]
    first |= np.isin(place, offs[:-1])
    if ((ccc[1:] > 0) & (ccc[:-1] > ccc[1:]) & ~first[1:]).any():
        order = np.argsort(np.cumsum((ccc == 0) | first) * 256 + ccc, kind="stable")
        sub, ccc = sub[order], ccc[order]
    gone = np.zeros(len(cps), bool)
    while True:
        cand = np.flatnonzero(t.second[sub] & ~first)
        if not len(cand):
            break
        starter = np.maximum.accumulate(np.where((ccc == 0) | first, np.arange(len(sub)), 0))
        # the letter that a mark belongs to: for a mark the last starter, for a starter the one just before it
        base = np.where(ccc[cand] > 0, starter[cand], cand - 1)
        free = (base == cand - 1) | ((ccc[cand - 1] > 0) & (ccc[cand - 1] < ccc[cand]))
        free &= ccc[base] == 0
        cand, base = cand[free], base[free]
        a, b = sub[base].astype(np.int64), sub[cand].astype(np.int64)
        at = np.searchsorted(t.pair_keys, a << 21 | b)
        at[at == len(t.pair_keys)] = 0
        hit = t.pair_keys[at] == a << 21 | b
        to = np.where(hit, t.pair_to[at], 0).astype(np.int64)
        lv = (a >= 0x1100) & (a < 0x1113) & (b >= 0x1161) & (b < 0x1176)
        to = np.where(lv, 0xAC00 + ((a - 0x1100) * 21 + b - 0x1161) * 28, to)
        lvt = (a >= 0xAC00) & (a < 0xD7A4) & ((a - 0xAC00) % 28 == 0) & (b >= 0x11A8) & (b < 0x11C3)
        to = np.where(lvt, a + b - 0x11A7, to)
        hit |= lv | lvt
        if not hit.any():
            break
        cand, base, to = cand[hit], base[hit], to[hit]
        base, once = np.unique(base, return_index=True)
        cand, to = cand[once], to[once]
        clash = np.isin(base, cand)  # a pair whose first half has just been used waits a round
        cand, base, to = cand[~clash], base[~clash], to[~clash]
        sub[base] = to
        gone[place[cand]] = True
        keep = np.ones(len(sub), bool)
        keep[cand] = False
        sub, ccc, first, place = sub[keep], ccc[keep], first[keep], place[keep]
    cps = cps.copy()
    cps[place] = sub
    return drop(cps, offs, ~gone)


def look(cps: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The normal form in which texts that look the same are the same code points.

    Full-width and presentation forms, look-alike letters, Arabic yeh and kaf and digits drawn alike
    become one letter; invisible characters go; every kind of blank is a space, one for one; repeated
    half-spaces are one; marks are composed. Vowel marks, differing digits, punctuation and a single
    half-space stay.
    """
    cps, offs = gather(cps, offs)
    twice = np.zeros(len(cps), bool)
    twice[1:] = (cps[1:] == ZWNJ) & (cps[:-1] == ZWNJ)
    if twice.any():
        twice[offs[:-1][offs[:-1] < len(cps)]] = False
        cps, offs = drop(cps, offs, ~twice)
    return compose(cps, offs)


def words(cps: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the comparable words of texts in normal form: (hash, text index, first word of each text).

    Case, combining marks and half-spaces don't count; a word is a run of letters and digits.
    """
    kind = letter_class()[cps]
    soft = (kind == 3) | (cps == ZWNJ) | (cps == 0x640)
    cps, offs = drop(cps, offs, ~soft)
    kind = kind[~soft]
    low = lower_table()[cps]
    inside = (kind == 1) | (kind == 2)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edge = offs[:-1]
    edge = edge[edge < len(cps)]
    begins[edge] = inside[edge]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    text = np.searchsorted(offs, starts, side="right") - 1
    number = np.cumsum(begins)[inside] - 1
    place = np.flatnonzero(inside) - starts[number]
    mixed = mix((low[inside].astype(np.uint64) << np.uint64(32)) + place.astype(np.uint64))
    hashes = np.add.reduceat(mixed, np.flatnonzero(place == 0))
    return mix(hashes), text, np.searchsorted(text, np.arange(len(offs)))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def blocks(column: pa.Array, most: int = 1_000_000) -> list[tuple[int, int]]:
    """Row ranges of at most `most` bytes of text each (one row at least), to bound a task's memory."""
    size = np.asarray(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), np.int64)
    out, begin, total = [], 0, 0
    for i, s in enumerate(size.tolist()):
        if total and total + s > most:
            out.append((begin, i))
            begin, total = i, 0
        total += s
    if len(size):
        out.append((begin, len(size)))
    return out
