"""The counter of profile.py within one row: windows that are known to have keys of their own are counted where they stand.

A batch's windows are the rows of a matrix of letters.  K-mers are numbers over the letters that occur, sorted within their window, and every
aggregate of the counter is a run in a sorted array, so nothing is exchanged, memory is bounded by BLOCK and a window costs some tens of microseconds.
profile.kmer_profile() is the same counter for tables in which keys repeat; tests hold both to the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from ..functions.sequence import ANY_BASE, BASES, COMPLEMENTS, DIGITS, FOLDS, LETTERS

#: Letters of the windows that are counted at once.
BLOCK = 1 << 19
#: Cells of sums by rank that are kept as an array; beyond it they are sorted.
DENSE = 1 << 22
#: Words of a table by code; beyond it the words that occur are looked up.
TABLE = 1 << 17
PAD = 255
TURNED = np.arange(256, dtype=np.uint8)
TURNED[np.frombuffer(LETTERS.encode(), np.uint8)] = np.frombuffer(COMPLEMENTS.encode(), np.uint8)
RANKS = np.full(256, -1, np.int64)
RANKS[np.frombuffer("".join(DIGITS).encode(), np.uint8)] = list(DIGITS.values())


class Rows(NamedTuple):
    """Entries of a block: window, word, count, and the place at which the word is met."""

    row: np.ndarray
    code: np.ndarray
    cnt: np.ndarray
    ord: np.ndarray
    words: Words


class Words:
    """Words of one width, as numbers over an alphabet or, where these would not fit, as places in a list."""

    def __init__(self, letters: np.ndarray, width: int, listed: np.ndarray | None = None):
        self.letters, self.width, self.listed = letters, width, listed
        self.size = len(letters) ** width if listed is None else len(listed)

    def digits(self) -> np.ndarray:
        """Each letter's place in the alphabet."""
        out = np.zeros(256, np.int64)
        out[self.letters] = np.arange(len(self.letters))
        return out

    def spelled(self, code: np.ndarray) -> np.ndarray:
        """The letters of each word."""
        if self.listed is not None:
            return self.listed[code]
        out = np.empty((len(code), self.width), np.uint8)
        for j in range(self.width - 1, -1, -1):
            code, digit = np.divmod(code, len(self.letters))
            out[:, j] = self.letters[digit]
        return out

    def table(self, f: Callable[[np.ndarray], np.ndarray], code: np.ndarray) -> np.ndarray:
        """f of each code's letters, for every word once."""
        if self.size <= TABLE:
            return f(self.spelled(np.arange(self.size)))[code]
        found, at = np.unique(code, return_inverse=True)
        return f(self.spelled(found))[at]


def _starts(*sorted_: np.ndarray) -> np.ndarray:
    """Places at which a run of equal values begins."""
    new = np.ones(len(sorted_[0]), bool)
    if len(new):
        new[1:] = False
        for x in sorted_:
            new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts) if len(starts) else values[:0]


def _by(*keys: tuple[np.ndarray, int]) -> np.ndarray:
    """The order of rows by keys of values below a bound each, the first key first."""
    bound = 1
    for _, n in keys:
        bound *= n
    n = len(keys[0][0])
    if bound * max(n, 1) >= 2**62:
        return np.lexsort([k for k, _ in reversed(keys)])
    packed = keys[0][0].astype(np.int64)
    for k, b in keys[1:]:
        packed = packed * b + k
    # With its place as the last digit a row's key is sorted as a plain number.
    packed = packed * n + np.arange(n)
    packed.sort()
    return packed % n


def _summed(row: np.ndarray, code: np.ndarray, cnt: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of equal codes of a window, added; codes are below size."""
    rows = int(row.max(initial=-1)) + 1
    cell = row * size + code
    if rows * size <= DENSE:
        met = np.zeros(rows * size, bool)
        met[cell] = True
        out = np.flatnonzero(met)
        total = np.bincount(cell, cnt, rows * size)[out].astype(np.int64) if len(cell) else cnt
    else:
        order = np.argsort(cell, kind="stable")
        first = _starts(cell[order])
        out, total = cell[order][first], _sums(cnt[order], first)
    return out // size, out % size, total


def counted(wins: np.ndarray, length: np.ndarray, width: int, semantics: str = "reference", both: bool = False) -> Rows:
    """profile.count_kmers(): each word of a window, its number and first place (from 1).

    both: profile.count_canonical(), where a word and its reverse complement are one, by the lesser code; no complement may be shared.
    """
    short = 2 if semantics == "reference" else 0
    places = max(wins.shape[1] - width + 1, 0)
    n = np.where(length >= width + short, length - (width + short) + 1, 0)
    letters = _letters(wins)
    base, bits = max(len(letters), 1), int(places).bit_length() + 1
    if base**width << bits < 2**62:
        kind = np.int32 if base**width << bits < 2**31 else np.int64
        words = Words(letters, width)
        at = words.digits().astype(kind)[wins]
        code = np.zeros((len(wins), places), kind)
        for j in range(width):
            code *= base
            code += at[:, j : j + places]
        if both:
            at = words.digits().astype(kind)[TURNED][wins]
            back = np.zeros_like(code)
            for j in range(width - 1, -1, -1):
                back *= base
                back += at[:, j : j + places]
            np.minimum(code, back, out=code)
    else:  # long words are numbered as they occur, with their reverse complements
        every = np.lib.stride_tricks.sliding_window_view(wins, width, axis=1).reshape(-1, width)
        back = TURNED[every[:, ::-1]]
        every = np.unique(np.concatenate([every, back, TURNED[back[:, ::-1]]]), axis=0, return_inverse=True)
        words = Words(letters, width, every[0])
        code = every[1].ravel()[: len(wins) * places].reshape(len(wins), places).astype(np.int64)
        if both:
            code = np.minimum(code, _turned(words, code.ravel()).reshape(code.shape))
    key = (code << bits) + np.arange(1, places + 1, dtype=code.dtype)
    key[np.arange(places) >= n[:, None]] = np.iinfo(code.dtype).max
    key.sort(axis=1)
    row = np.repeat(np.arange(len(wins)), n)
    flat = key.ravel() if (n == places).all() else key[np.arange(places) < n[:, None]]
    code = flat >> bits
    first = _starts(row, code)
    return Rows(row[first], code[first].astype(np.int64), np.diff(first, append=len(flat)), (flat[first] & (1 << bits) - 1).astype(np.int64), words)


def _letters(wins: np.ndarray) -> np.ndarray:
    """The letters that occur, with their complements."""
    seen = np.bincount(wins.ravel(), minlength=256) > 0
    seen[TURNED[np.flatnonzero(seen)]] = True
    seen[PAD] = False
    return np.flatnonzero(seen).astype(np.uint8)


def _paired(letters: np.ndarray) -> bool:
    """Whether no two letters share a complement."""
    return len(np.unique(TURNED[letters])) == len(letters)


def _turned(words: Words, code: np.ndarray) -> np.ndarray:
    """Codes of the reverse complements."""
    if words.listed is not None:  # in order, so that a complement is found by its place
        every = np.concatenate([words.listed, TURNED[words.listed[:, ::-1]]])
        return np.unique(every, axis=0, return_inverse=True)[1].ravel()[words.size :][code]
    digit = words.digits()
    power = len(words.letters) ** np.arange(words.width, dtype=np.int64)
    return words.table(lambda w: digit[TURNED[w]] @ power, code)


def stranded(wins: np.ndarray, length: np.ndarray, width: int, semantics: str = "reference", ordered: bool = False) -> Rows:
    """profile.merge_strands() of all words.  ordered: with the places at which words are met, else these are all 0."""
    if _paired(_letters(wins)) and not ordered:
        r = counted(wins, length, width, semantics, True)
        turn = _turned(r.words, r.code)
        two = turn != r.code
        cnt = np.where(two, r.cnt, 2 * r.cnt)
        row, code, cnt = np.append(r.row, r.row[two]), np.append(r.code, turn[two]), np.append(cnt, cnt[two])
        return Rows(row, code, cnt, np.zeros(len(row), np.int64), r.words)
    r = counted(wins, length, width, semantics)
    most, rows = int(r.ord.max(initial=0)) + 1, int(r.row.max(initial=-1)) + 1
    if _paired(r.words.letters) and r.words.listed is None and rows * r.words.size <= DENSE:
        n, place = np.zeros((rows, r.words.size), np.int32), np.zeros((rows, r.words.size), np.int64)
        n[r.row, r.code], place[r.row, r.code] = r.cnt, r.ord
        turn = _turned(r.words, np.arange(r.words.size))
        row, code = np.divmod(np.flatnonzero(n + n[:, turn]), max(r.words.size, 1))
        own, other = n[row, code], n[row, turn[code]]
        met = np.where(own > 0, place[row, code], most + place[row, turn[code]])
        return Rows(row, code, own.astype(np.int64) + other, met, r.words)
    row, code = np.concatenate([r.row, r.row]), np.concatenate([r.code, _turned(r.words, r.code)])
    side = np.repeat([0, 1], len(r.row))
    cnt, place = np.concatenate([r.cnt, r.cnt]), np.concatenate([r.ord, r.ord])
    order = _by((row, rows), (code, r.words.size), (side, 2), (place, most))
    row, code, side, cnt, place = (x[order] for x in (row, code, side, cnt, place))
    if semantics == "reference":  # of several words with one reverse complement the last counts
        last = np.zeros(len(row), bool)
        last[_starts(row, code, side)[1:] - 1] = True
        last[-1:] = True
        cnt = np.where(last, cnt, 0)
    first = _starts(row, code)
    return Rows(row[first], code[first], _sums(cnt, first), side[first] * most + place[first], r.words)


def masked(r: Rows, pattern: list[int], semantics: str = "reference") -> Rows:
    """profile.apply_pattern_counts() of stranded(), which in the reference semantics has to be ordered."""
    if 0 not in pattern:
        return r
    keep = np.flatnonzero(pattern)
    if r.words.listed is None:
        words, power = Words(r.words.letters, len(keep)), len(r.words.letters) ** np.arange(len(keep) - 1, -1, -1, dtype=np.int64)
        digit = r.words.digits()
        code = r.words.table(lambda w: digit[w[:, keep]] @ power, r.code)
    else:
        found, every = np.unique(r.words.listed[:, keep], axis=0, return_inverse=True)
        words, code = Words(r.words.letters, len(keep), found), every.ravel()[r.code]
    if semantics == "clean":
        row, code, cnt = _summed(r.row, code, r.cnt, words.size)
    else:
        rows, most = int(r.row.max(initial=-1)) + 1, int(r.cnt.max(initial=0)) + 1
        if rows * words.size <= DENSE and int(r.ord.max(initial=0)) * most < 2**62:
            best = np.zeros(rows * words.size, np.int64)
            np.maximum.at(best, r.row * words.size + code, r.ord * most + r.cnt)
            cell = np.flatnonzero(best)
            row, code, cnt = cell // words.size, cell % words.size, best[cell] % most
        else:
            order = _by((r.row, rows), (code, max(words.size, 1)), (r.ord, int(r.ord.max(initial=0)) + 1))
            row, code = r.row[order], code[order]
            last = np.append(_starts(row, code)[1:], len(row))[: len(row)] - 1
            row, code, cnt = row[last], code[last], r.cnt[order][last]
    return Rows(row, code, cnt, np.zeros(len(row), np.int64), words)


def without_homopolymers(r: Rows, k: int) -> Rows:
    """profile.drop_homopolymers()."""
    if r.words.width != k:
        return r
    plain = r.words.table(lambda w: ~((w == w[:, :1]).all(axis=1) & np.isin(w[:, 0], list(ANY_BASE.encode()))), r.code)
    return Rows(r.row[plain], r.code[plain], r.cnt[plain], r.ord[plain], r.words)


@lru_cache(1 << 16)
def _meanings(word: bytes) -> np.ndarray:
    """Ranks of all plain words that a word stands for."""
    every = product(*([DIGITS[b] for b in BASES.get(chr(c), ANY_BASE)] for c in word))
    return np.array(list(every), np.int64) @ (4 ** np.arange(len(word) - 1, -1, -1, dtype=np.int64))


def _spread(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each word's meanings begin, how many they are, and all meanings."""
    means = [_meanings(w.tobytes()) for w in words]
    many = np.array([len(m) for m in means], np.int64)
    return np.cumsum(many) - many, many, np.concatenate([*means, np.zeros(0, np.int64)])


@lru_cache(16)
def _every_spread(letters: bytes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words = Words(np.frombuffer(letters, np.uint8), width)
    return _spread(words.spelled(np.arange(words.size)))


def expanded(r: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """profile.sum_expanded(): window, rank of a plain word and count, in order."""
    width, size = r.words.width, 4**r.words.width
    power = 4 ** np.arange(width - 1, -1, -1, dtype=np.int64)
    rank = r.words.table(lambda w: np.where((RANKS[w] >= 0).all(axis=1), RANKS[w] @ power, -1), r.code)
    vague = np.flatnonzero(rank < 0)
    row, cnt = r.row, r.cnt
    if len(vague):
        if r.words.listed is None and r.words.size <= 1 << 13:
            (begin, many, means), at = _every_spread(r.words.letters.tobytes(), width), r.code[vague]
        else:
            found, at = np.unique(r.code[vague], return_inverse=True)
            begin, many, means = _spread(r.words.spelled(found))
        each, known = many[at], rank >= 0
        inside = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        rank = np.concatenate([rank[known], means[np.repeat(begin[at], each) + inside]])
        row = np.concatenate([row[known], np.repeat(row[vague], each)])
        cnt = np.concatenate([cnt[known], np.repeat(cnt[vague] // each, each)])
    return _summed(row, rank, cnt, size)


def profiled(wins: np.ndarray, length: np.ndarray, pattern: list[int], semantics: str = "reference") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """profile.kmer_profile(): window, rank of a plain word and count, in order."""
    k = sum(pattern)
    both = stranded(wins, length, len(pattern), semantics, 0 in pattern and semantics == "reference")
    row, rank, cnt = expanded(without_homopolymers(masked(both, pattern, semantics), k))
    if semantics == "clean":
        same = np.isin(rank, np.arange(4) * ((4**k - 1) // 3))
        row, rank, cnt = row[~same], rank[~same], cnt[~same]
    return row, rank, cnt


# ---- batches -----------------------------------------------------------------------------------------------------------
class Block(NamedTuple):
    """Some windows: rows of their batch, numbers within these, and letters."""

    at: np.ndarray
    win_idx: np.ndarray
    wins: np.ndarray
    length: np.ndarray


class Texts(NamedTuple):
    """Texts whose letters stand for bases by a fold: functions.sequence.derived_sequence() and operators.windows.windows()."""

    fold: str
    size: int
    sampling: int
    column: str = "text"

    def blocks(self, batch: pa.RecordBatch) -> Iterator[Block]:
        letters = "".join(map(chr, range(65, 91))).encode()
        table = bytes.maketrans(letters + letters.lower(), FOLDS[self.fold].encode() * 2)
        other = bytes(set(range(256)) - set(letters + letters.lower()))
        return _cut(batch.column(self.column), lambda x: x.translate(table, other), self.size, self.sampling)


def _cut(column: pa.Array, letters: Callable[[bytes], bytes], size: int, sampling: int) -> Iterator[Block]:
    """windows() of every row, blocks of whole rows."""
    at: list[int] = []
    parts: list[bytes] = []
    held = 0

    def block() -> Block:
        length = np.array([len(p) for p in parts])
        begin = np.cumsum(length) - length
        steps = ((length - size) // sampling)[:, None] * np.arange(sampling) + begin[:, None]
        wins = np.frombuffer(b"".join(parts), np.uint8)[steps.reshape(-1, 1) + np.arange(size)]
        return Block(np.repeat(at, sampling), np.tile(np.arange(sampling, dtype=np.int32), len(parts)), wins, np.full(len(wins), size))

    for i, x in enumerate(column.cast(pa.binary())):
        if not x.is_valid:
            continue
        part = letters(x.as_buffer().to_pybytes())
        if len(part) < size:
            continue
        at.append(i)
        parts.append(part)
        held += max(len(part), size * sampling)
        if held >= BLOCK:
            yield block()
            at, parts, held = [], [], 0
    if parts:
        yield block()


class Windows(NamedTuple):
    """Windows as they are, one in a row."""

    column: str = "win"

    def blocks(self, batch: pa.RecordBatch) -> Iterator[Block]:
        wins = [None if x is None else bytes(x) for x in batch.column(self.column).to_pylist()]
        at = [i for i, x in enumerate(wins) if x]
        while at:
            longest = max(len(wins[i]) for i in at[:4096])
            some, at = at[: max(1, min(4096, BLOCK // longest))], at[max(1, min(4096, BLOCK // longest)) :]
            length = np.array([len(wins[i]) for i in some])
            padded = b"".join(wins[i].ljust(int(length.max()), bytes([PAD])) for i in some)
            yield Block(np.array(some), np.zeros(len(some), np.int32), np.frombuffer(padded, np.uint8).reshape(len(some), -1), length)


def spelled(letters: np.ndarray) -> pa.Array:
    """Rows of letters as texts."""
    n, width = letters.shape
    return pa.StringArray.from_buffers(n, pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(letters)))


def plain_words(rank: np.ndarray, k: int) -> tuple[pa.Array, np.ndarray]:
    """Words of k bases by rank, and their codes."""
    digits = rank[:, None] // (4 ** np.arange(k - 1, -1, -1, dtype=np.int64)) % 4
    return spelled(np.frombuffer("".join(DIGITS).encode(), np.uint8)[digits]), digits @ (10 ** np.arange(k - 1, -1, -1, dtype=np.int64))


def listed(row: np.ndarray, rank: np.ndarray, cnt: np.ndarray, k: int) -> tuple[np.ndarray, list]:
    """profiled() as a row a window: its (code, cnt) in a list."""
    first = _starts(row)
    code = rank[:, None] // (4 ** np.arange(k - 1, -1, -1, dtype=np.int64)) % 4 @ (10 ** np.arange(k - 1, -1, -1, dtype=np.int64))
    cells = pa.StructArray.from_arrays([pa.array(code), pa.array(cnt)], ["code", "cnt"])
    return row[first], [pa.ListArray.from_arrays(pa.array(np.append(first, len(row)).astype(np.int32)), cells)]


def dense(row: np.ndarray, rank: np.ndarray, cnt: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """profiled() as windows and the matrix of their 4^k counts by rank."""
    first = _starts(row)
    x = np.zeros((len(first), 4**k), np.int64)
    x[np.repeat(np.arange(len(first)), np.diff(first, append=len(row))), rank] = cnt
    return row[first], x


def mapped(df: DataFrame, source: Texts | Windows, keys: list[str], columns: str, f: Callable[[Block], tuple[np.ndarray | None, list]], numbered: bool = False) -> DataFrame:
    """df -> keys, win_idx where it is numbered, and f's columns: f gives the window of each of its rows, or none for one row a window."""
    schema = ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), *(["win_idx int"] if numbered else []), columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in source.blocks(batch):
                row, out = f(block)
                at, win_idx = (block.at, block.win_idx) if row is None else (block.at[row], block.win_idx[row])
                own = [batch.column(k).take(pa.array(at)) for k in keys] + ([pa.array(win_idx)] if numbered else [])
                arrays = [*own, *(x if isinstance(x, pa.Array) else pa.array(x) for x in out)]
                yield pa.RecordBatch.from_arrays(arrays, names)

    names = StructType.fromDDL(schema).names
    return df.select(*keys, source.column).mapInArrow(run, schema)
