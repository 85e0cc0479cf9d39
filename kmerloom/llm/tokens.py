"""Token ids of whole texts by a public tokenizer file, a batch of texts at a time.

Both supported files cut a text into pre-tokens that never reach across a single space after a non-space character,
so a text's ids are its space-separated parts' ids in a row.  A batch is split by Arrow, its distinct parts are looked up
among those that the process remembers, the rest are encoded by the tokenizers library, and the ids are gathered by the
parts' numbers.  A text with a part for which that rule can't hold takes the library's plain path.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Parts that one Python process remembers, about 40 bytes each; further ones are encoded each time. This bounds memory, not results.
CACHE_PARTS = 1_000_000
#: Ids of remembered parts in all.
CACHE_IDS = 1 << 24
#: First parts of texts that it remembers.
CACHE_HEADS = 50_000
#: Literal strings of special tokens that the library looks for in a text; such texts take the plain path.
_MARK = "<|"
#: Any character that either Python or the files count as white space.
_SPACE = re.compile(r"\s")

#: Letters below this code point are equal for Python and for the tokenizer files' letter class, and stable under NFC.
#: The one that lower-cases to two characters takes the library's plain path.
_PLAIN_LETTERS = "ƀ"


def _byte_letters() -> dict[int, str]:
    """The letters by which byte-level vocabularies write the 256 byte values: printable ones stand for themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in own)}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def string_hashes(values: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each string: sums of bytes times multipliers by place."""
    values = pa.concat_arrays([values])  # offsets from 0
    ends = np.frombuffer(values.buffers()[1], dtype=np.int32, count=len(values) + 1)
    data = np.frombuffer(values.buffers()[2] or b"", dtype=np.uint8)[: ends[-1]].astype(np.uint64) + np.uint64(1)
    size = np.diff(ends)
    place = np.arange(len(data)) - np.repeat(ends[:-1], size)
    steps = np.arange(1, int(size.max(initial=0)) + 1, dtype=np.uint64)
    out = []
    for seed in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03):
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(data * _mix(steps * np.uint64(seed))[place], out=total[1:])
        out.append(_mix(total[ends[1:]] - total[ends[:-1]] + size.astype(np.uint64) * np.uint64(seed)))
    return out[0], out[1]


class _Known:
    """Ids of remembered parts in a few arrays: sorted hashes, places and numbers of ids, and the ids in a row."""

    def __init__(self):
        self.hash, self.check = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.uint64)
        self.at, self.size = np.empty(0, dtype=np.int32), np.empty(0, dtype=np.int32)
        self.ids, self.used = np.empty(1 << 16, dtype="<u4"), 0

    def find(self, hashes: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """The entry of each part, -1 for none."""
        if not len(self.hash):
            return np.full(len(hashes), -1)
        i = np.minimum(np.searchsorted(self.hash, hashes), len(self.hash) - 1)
        return np.where((self.hash[i] == hashes) & (self.check[i] == checks), i, -1)

    def add(self, hashes: np.ndarray, checks: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Remember more parts, as far as there is room; `ids` are theirs in a row."""
        hashes, first = np.unique(hashes, return_index=True)
        spot = np.searchsorted(self.hash, hashes)
        new = np.ones(len(hashes), dtype=bool) if not len(self.hash) else self.hash[np.minimum(spot, len(self.hash) - 1)] != hashes
        new &= np.cumsum(new) <= CACHE_PARTS - len(self.hash)
        if not new.any() or self.used + len(ids) > CACHE_IDS:
            return
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        at = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)
        spot, first = spot[new], first[new]
        self.hash, self.check = np.insert(self.hash, spot, hashes[new]), np.insert(self.check, spot, checks[first])
        self.at, self.size = np.insert(self.at, spot, at[first]), np.insert(self.size, spot, sizes[first])

    def rows(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of entries in a row, and the number of ids of each."""
        size, at = self.size[entries].astype(np.int64), self.at[entries].astype(np.int64)
        ahead = np.cumsum(size) - size
        return self.ids[np.repeat(at - ahead, size) + np.arange(int(size.sum()))], size


class TextEncoder:
    """Ids of texts as the library gives them with add_special_tokens=False."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_file(path)
        self._tokenize = self._tok.model.tokenize
        self.vocab = self._tok.get_vocab_size(with_added_tokens=True)
        # Byte-level files keep the space before a word as part of it and newlines as tokens; the others drop both.
        keeps = self._tok.encode("a b", add_special_tokens=False).ids != (
            self._tok.encode("a", add_special_tokens=False).ids + self._tok.encode("b", add_special_tokens=False).ids
        )
        self._lower = self._plain("A") == self._plain("a")
        self._letters = _byte_letters()
        self._lead, self._line = (" ", self._plain("\n")) if keeps else ("", b"")
        self._marks = {m: self._plain(m) for m in ",."}
        self._known = _Known()
        self._heads: dict[str, bytes | None] = {}

    def _plain(self, text: str) -> bytes:
        return array("I", self._tok.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of one pre-token, straight from the file's BPE model."""
        if word.isascii():
            word = self._letters[32] + word[1:] if word[0] == " " else word
        else:
            word = word.encode().decode("latin-1").translate(self._letters)
        return array("I", [t.id for t in self._tokenize(word)]).tobytes()

    def _part(self, part: str, lead: str) -> bytes | None:
        """Ids of a part with what stands before it; None where a text with this part needs the plain path."""
        if part[:1] == "\n":  # the parts of a line after the first; no space is before its first word
            rest = self._part(part[1:], "")
            return None if rest is None else self._line + rest
        body = part[:-1] if part[-1:] in self._marks else part
        if body.isalpha() and (body.isascii() or max(body) < _PLAIN_LETTERS and "İ" not in body):
            got = self._word(lead + (body.lower() if self._lower else body))
            return got if body is part else got + self._marks[part[-1]]
        if not part or _SPACE.search(part):
            return None
        return self._plain(lead + part)

    def _head(self, part: str) -> bytes | None:
        """Ids of a text's first part."""
        if part not in self._heads:
            if len(self._heads) >= CACHE_HEADS:
                return self._part(part, "")
            self._heads[part] = self._part(part, "")
        return self._heads[part]

    def _values(self, keys: pa.StringArray) -> tuple[pa.LargeBinaryArray, np.ndarray]:
        """Ids of distinct parts behind a space as bytes, and whether each needs the plain path."""
        hashes, checks = string_hashes(keys)
        entry = self._known.find(hashes, checks)
        miss = np.flatnonzero(entry < 0)
        new = [self._part(p, self._lead) for p in keys.take(pa.array(miss)).to_pylist()]
        bad = np.zeros(len(keys), dtype=bool)
        bad[miss] = [v is None for v in new]
        new = [v or b"" for v in new]
        ids, size = self._known.rows(entry[entry >= 0])
        sizes = np.zeros(len(keys), dtype=np.int64)
        sizes[entry >= 0] = size
        sizes[miss] = mine = np.fromiter(map(len, new), dtype=np.int64, count=len(new)) // 4
        fresh = np.frombuffer(b"".join(new), dtype="<u4")
        out = np.empty(int(sizes.sum()), dtype="<u4")
        old = np.repeat(entry >= 0, sizes)
        out[old], out[~old] = ids, fresh
        ok = ~bad[miss]  # a part without ids of its own has none to leave out
        self._known.add(hashes[miss][ok], checks[miss][ok], fresh, mine[ok])
        ends = np.concatenate([[0], np.cumsum(sizes)]) * 4
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(keys), [None, pa.py_buffer(ends), pa.py_buffer(out)]), bad

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts one after another, and each text's number of ids; null is empty."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if not len(texts):
            return np.empty(0, dtype="<u4"), np.empty(0, dtype=np.int64)
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        many = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.cumsum(many) - many
        words = split.flatten().dictionary_encode()
        codes, parts = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary
        # A plain word with a mark behind it is the word and the mark; equal words are looked up once.
        body = pc.utf8_slice_codeunits(parts, 0, -1)
        last = pc.utf8_slice_codeunits(parts, -1)
        plain_body = pc.ascii_is_alpha(body)
        mark = np.zeros(len(parts), dtype=np.int64)
        for i, m in enumerate(self._marks, 1):
            mark[pc.and_(plain_body, pc.equal(last, m)).to_numpy(zero_copy_only=False)] = i
        keys = pc.if_else(pa.array(mark > 0), body, parts)
        if self._lower:
            keys = pc.if_else(pc.ascii_is_alpha(keys), pc.ascii_lower(keys), keys)
        keys = keys.dictionary_encode()
        key = keys.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        values, bad = self._values(keys.dictionary)
        # Two places for every part: its word and its mark.
        none = len(values)
        spots = np.empty((len(codes), 2), dtype=np.int64)
        spots[:, 0], spots[:, 1] = key[codes], none + mark[codes]
        extra: list[bytes | None] = [b"", *self._marks.values()]
        heads, where = np.unique(codes[first], return_inverse=True)
        spots[first, 0], spots[first, 1] = none + len(extra) + where, none
        extra += [self._head(h) for h in parts.take(pa.array(heads)).to_pylist()]
        plain = pc.match_substring(texts, _MARK).to_numpy(zero_copy_only=False)
        bad = np.concatenate([bad, [v is None for v in extra]])
        if bad.any():
            plain = plain | np.logical_or.reduceat(bad[spots[:, 0]], first)
        for i in np.flatnonzero(plain).tolist():  # the whole text stands in place of its first part
            spots[first[i] : first[i] + many[i]] = none
            spots[first[i], 0] = none + len(extra)
            extra.append(self._plain(texts[i].as_py()))
        values = pa.concat_arrays([values, pa.array(extra, pa.large_binary())])
        got = values.take(pa.array(spots.ravel()))
        ends = np.frombuffer(got.buffers()[1], dtype=np.int64, count=2 * len(codes) + 1)
        return np.frombuffer(got.buffers()[2] or b"", dtype="<u4"), (ends[2 * (first + many)] - ends[2 * first]) // 4

    def encode_closed(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """encode_batch() with the id `end` behind each text."""
        ids, counts = self.encode_batch(texts)
        return np.insert(ids, np.cumsum(counts), np.uint32(end)), counts + 1

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian uint32 bytes."""
        return self.encode_batch(pa.array([text], pa.string()))[0].tobytes()


@lru_cache(maxsize=2)
def encoder(path: str) -> TextEncoder:
    """One encoder per Python process and file."""
    return TextEncoder(path)
