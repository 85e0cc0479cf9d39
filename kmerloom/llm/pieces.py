"""Operator 11: SentencePiece encoding with byte spans in the original text, and decoding.

The model file is read here; the sentencepiece library isn't needed.  A batch of texts is one run of bytes.

* Normalising: at every character the longest prefix that the file's compiled character map (a double-array trie) holds is
  found by walking the trie from all characters at once; units are then taken from left to right.  Every normalised byte
  keeps the place of the unit it comes from.
* Cutting: between a character that isn't a space mark and a space mark no piece reaches across, nor between two letters that
  stand side by side in no piece, nor around characters of no longer piece, so the text is cut there.  Equal stretches are encoded once and their ids gathered by numpy.
* Merging: a stretch's best pair by score, the leftmost of equal ones, until none is a piece; characters without a piece
  become their bytes.
* Spans: a piece's normalised bytes lead back to the original bytes [begin, end).  Of a character that became bytes, the last
  one has the span and the others are empty where it begins.

Null texts are empty and have no ids; texts of any length are taken whole; repeated rows are each encoded.  Other columns, whatever
their names and types, are passed on, and a name that is taken gets `_` behind it.  An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, fresh, map_arrow, slices

#: The mark that stands for a space.
MARK = "▁"
_MARK = MARK.encode()
#: Kinds of pieces in the file format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Stretches that one Python process remembers, of at most so many bytes each; others are encoded each time.
CACHE_STRETCHES, CACHE_BYTES = 300_000, 64
#: Characters of a stretch up to which all pairs are looked through; longer ones have a queue.
SHORT = 48
#: What an unknown piece is decoded to, and an invalid byte.
UNKNOWN_TEXT, BAD_BYTE = " ⁇ ", "�"


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = raw[at]
        value, shift, at = value | (byte & 127) << shift, shift + 7, at + 1
        if byte < 128:
            return value, at


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message."""
    at = 0
    while at < len(raw):
        tag, at = _varint(raw, at)
        if tag & 7 == 0:
            value, at = _varint(raw, at)
        else:
            size, at = _varint(raw, at) if tag & 7 == 2 else ({1: 8, 5: 4}[tag & 7], at)
            value, at = raw[at : at + size], at + size
        yield tag >> 3, value


class CharMap:
    """A compiled character map: little-endian size of the trie, the trie's 32-bit units, null-ended replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4) if blob else np.zeros(0, "<u4")
        self.strings = blob[4 + size :]

    def replacement(self, value: int) -> bytes:
        return self.strings[value : self.strings.index(b"\0", value)]

    @staticmethod
    def _children(unit: np.ndarray) -> np.ndarray:
        return (unit >> np.uint32(10)) << ((unit & np.uint32(1 << 9)) >> np.uint32(6))

    def longest(self, data: np.ndarray, at: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Length and value of the longest key that starts at each place; length 0 for none. ends: where each place's text ends."""
        length, value = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        if not len(self.units) or not len(at):
            return length, value
        who = np.arange(len(at))
        node = np.broadcast_to(self._children(self.units[:1]), len(at)).astype(np.int64)
        depth = 0
        while len(who):
            inside = at[who] + depth < ends[who]
            who, node = who[inside], node[inside]
            byte = data[at[who] + depth].astype(np.int64)
            node = node ^ byte
            unit = self.units[np.minimum(node, len(self.units) - 1)]
            ok = (node < len(self.units)) & ((unit & np.uint32(0x800000FF)) == byte)
            who, node, unit = who[ok], node[ok], unit[ok]
            node = node ^ self._children(unit).astype(np.int64)
            depth += 1
            leaf = (unit >> np.uint32(8)) & np.uint32(1) == 1
            length[who[leaf]] = depth
            value[who[leaf]] = self.units[node[leaf]] & np.uint32(0x7FFFFFFF)
        return length, value


class PieceModel:
    def __init__(self, raw: bytes):
        pieces, spec, trainer = [], {}, {}
        for number, value in _fields(raw):
            if number == 1:
                got = dict(_fields(value))
                pieces.append((got[1].decode(), struct.unpack("<f", got.get(2, bytes(4)))[0], got.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                spec = dict(_fields(value))
        kinds = {kind for _, _, kind in pieces}
        if trainer.get(3, 1) != 2 or trainer.get(24, 0):
            raise ValueError("only BPE models with the space mark before words are read")
        if kinds & {USER, UNUSED} or not kinds >= {BYTE}:
            raise ValueError("models with user-defined or unused pieces, or without byte pieces, aren't read")
        self.chars = CharMap(spec.get(2, b""))
        self.prefix, self.collapse, self.escape = bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
        self.ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == NORMAL}
        self.score = [s for _, s, _ in pieces]
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        longer = [p for p in self.ids if len(p) > 1]
        self.cut_at_mark = not any(MARK in p.lstrip(MARK) for p in longer)
        used = set().union(*longer) if longer else set()
        self.alone = np.array([b < 128 and chr(b) not in used for b in range(256)])
        # Pairs of ASCII characters that stand side by side in no piece; there a text may be cut.
        self.apart = np.zeros((256, 256), bool)
        self.apart[:128, :128] = True
        for a, b in {pair for p in longer for pair in zip(p, p[1:], strict=False)}:
            if a < "\x80" and b < "\x80":
                self.apart[ord(a), ord(b)] = False
        self.apart = self.apart.ravel()
        self.order = {p: -self.score[self.ids[p]] for p in longer}
        surface = [UNKNOWN_TEXT if k == UNKNOWN else "" if k == CONTROL else p.replace(MARK, " ") for p, _, k in pieces]
        raws = [bytes([int(p[3:5], 16)]) if k == BYTE else s.encode() for (p, _, k), s in zip(pieces, surface, strict=True)]
        self.surface, self.surface_size = np.frombuffer(b"".join(raws), np.uint8), np.array([len(r) for r in raws], np.int64)
        self.surface_at = np.cumsum(self.surface_size) - self.surface_size
        self.marked = np.array([k == NORMAL and p.startswith(MARK) for p, _, k in pieces])
        self.kind = np.array([k for _, _, k in pieces])
        self.known: dict[bytes, bytes] = {}

    # ---- normalising --------------------------------------------------------------------------------------------------
    def _units(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of units, and length and value of those that the character map replaces (length 0: kept)."""
        head = (data & 0xC0) != 0x80
        at = np.flatnonzero(head)
        if not len(self.chars.units):
            return at, np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        text = np.searchsorted(starts, at, "right") - 1
        length, value = self.chars.longest(data, at, starts[text + 1])
        own = np.diff(np.append(at, len(data)))
        keep, covered = np.ones(len(at), bool), -1
        for i in np.flatnonzero(length > own).tolist():  # units of several characters, from left to right
            if at[i] >= covered:
                covered = at[i] + length[i]
                keep[i + 1 : np.searchsorted(at, covered)] = False
        return at[keep], length[keep], value[keep]

    def _replaced(self, value: int) -> bytes:
        text = self.chars.replacement(value)
        return text.replace(b" ", _MARK) if self.escape else text

    def normalise(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Normalised bytes of all texts, the original place of each, and where each text starts in them and ends in the original."""
        if self.collapse:
            return self._collapsed(data, starts)
        at, length, value = self._units(data, starts)
        put = length > 0
        place = np.int32 if len(data) < 1 << 29 else np.int64  # a byte may become three
        counts = np.ones(len(data), place)
        unit_at = np.zeros(len(data), place)
        unit_at[at] = at
        np.maximum.accumulate(unit_at, out=unit_at)
        space = np.zeros(0, np.int64)
        if self.escape:
            space = np.flatnonzero(data == 32)
            counts[space] = 3
        texts = {v: self._replaced(v) for v in np.unique(value[put]).tolist()}
        if put.any():
            gone = np.zeros(len(data), bool)
            gone[at] = put
            gone = gone[unit_at]
            counts[gone] = 0
            counts[at[put]] = [len(texts[v]) for v in value[put].tolist()]
            space = space[~gone[space]]
        first = starts[:-1][np.diff(starts) > 0]
        lead = _MARK if self.escape else b" "
        if self.prefix:
            counts[first] += len(lead)
        ends = np.cumsum(counts, dtype=place)
        out, back = np.repeat(data, counts), np.repeat(unit_at, counts)
        if self.prefix and len(first):
            begins = ends[first] - counts[first]
            for k, b in enumerate(lead):
                out[begins + k] = b
        for k, b in enumerate(_MARK):
            out[ends[space] - 3 + k] = b
        for p, v in zip(at[put].tolist(), value[put].tolist(), strict=True):
            text = texts[v]
            out[ends[p] - len(text) : ends[p]] = np.frombuffer(text, np.uint8)
        bounds = np.concatenate([[0], ends])[starts]
        return out, back, bounds, starts[1:]

    def _collapsed(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """normalise() for models that leave out spaces at both ends and all but one of a run."""
        at, length, value = self._units(data, starts)
        stop, raw = np.append(at[1:], len(data)), data.tobytes()
        space = _MARK if self.escape else b" "
        out, back, bounds, ends = bytearray(), [], [0], []
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            lo, hi = np.searchsorted(at, [a, b])
            begin, open_, end = len(out), True, b
            for i in range(lo, hi):
                text = self.chars.replacement(int(value[i])) if length[i] else raw[at[i] : stop[i]]
                while open_ and text.startswith(b" "):
                    text = text[1:]
                if text:
                    if len(out) == begin and self.prefix:
                        out += space
                        back += [int(at[i])] * len(space)
                    open_ = text.endswith(b" ")
                    text = text.replace(b" ", space)
                    out += text
                    back += [int(at[i])] * len(text)
            while len(out) > begin and out.endswith(space):
                end = back[-len(space)]
                del out[-len(space) :], back[-len(space) :]
            bounds.append(len(out))
            ends.append(end)
        return np.frombuffer(bytes(out), np.uint8), np.array(back, np.int64), np.array(bounds), np.array(ends, np.int64)

    # ---- merging ------------------------------------------------------------------------------------------------------
    def _merge_short(self, text: str) -> list[str]:
        """merge() by looking through all pairs each time."""
        none, get, parts = float("inf"), self.order.get, list(text)
        pairs = [get(a + b, none) for a, b in zip(text, text[1:], strict=False)]
        while pairs:
            first = min(pairs)
            if first == none:
                break
            i = pairs.index(first)
            parts[i] += parts.pop(i + 1)
            del pairs[i]
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], none)
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], none)
        return parts

    def merge(self, text: str) -> list[str]:
        """The stretch's characters, merged pair by pair."""
        if len(text) <= SHORT:
            return self._merge_short(text)
        parts, left, right = list(text), list(range(-1, len(text) - 1)), list(range(1, len(text) + 1))
        queue: list[tuple[float, int, int, int]] = []

        def offer(i: int) -> None:
            j = right[i] if i >= 0 else len(parts)
            if 0 <= i and j < len(parts):
                found = self.ids.get(parts[i] + parts[j])
                if found is not None:
                    heapq.heappush(queue, (-self.score[found], i, j, len(parts[i]) + len(parts[j])))

        for i in range(len(parts) - 1):
            offer(i)
        while queue:
            _, i, j, size = heapq.heappop(queue)
            if not parts[i] or not parts[j] or right[i] != j or len(parts[i]) + len(parts[j]) != size:
                continue
            parts[i], parts[j] = parts[i] + parts[j], ""
            right[i] = right[j]
            if right[j] < len(parts):
                left[right[j]] = i
            offer(i)
            offer(left[i])
        return [p for p in parts if p]

    def _encode(self, stretch: bytes) -> bytes:
        """Id and number of bytes of each of a stretch's pieces, as uint32."""
        out, ids = array("I"), self.ids
        for piece in self.merge(stretch.decode()):
            found, raw = ids.get(piece), piece.encode()
            if found is None:
                for at, b in enumerate(raw, 1):
                    out.extend((self.bytes[b], len(raw) if at == len(raw) else 0))
            else:
                out.extend((found, len(raw)))
        return out.tobytes()

    def _look_up(self, stretch: bytes) -> bytes:
        got = self.known.get(stretch)
        if got is None:
            got = self._encode(stretch)
            if len(stretch) <= CACHE_BYTES and len(self.known) < CACHE_STRETCHES:
                self.known[stretch] = got
        return got

    def _stretches(self, norm: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Where stretches start."""
        cut = np.zeros(len(norm) + 1, bool)
        cut[bounds] = True
        if self.cut_at_mark and len(norm) > 2:
            mark = np.zeros(len(norm), bool)
            mark[:-2] = (norm[:-2] == _MARK[0]) & (norm[1:-1] == _MARK[1]) & (norm[2:] == _MARK[2])
            after = np.zeros(len(norm), bool)
            after[3:] = mark[:-3]
            cut[:-1] |= mark & ~after
        alone = self.alone[norm]
        cut[:-1] |= alone
        cut[1:] |= alone
        if len(norm) > 1:
            cut[1:-1] |= self.apart[(norm[:-1].astype(np.int32) << 8) | norm[1:]]
        return np.flatnonzero(cut[:-1])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids, begins and ends (bytes in the own text) of all texts' pieces in a row, and the texts' numbers of pieces."""
        raw = texts.cast(pa.large_string()).cast(pa.large_binary()).fill_null(b"")
        raw = pa.concat_arrays([raw])  # offsets from 0
        starts = np.frombuffer(raw.buffers()[1], np.int64, len(raw) + 1) if len(raw) else np.zeros(1, np.int64)
        data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[: starts[-1]] if len(raw) else np.zeros(0, np.uint8)
        norm, back, bounds, stops = self.normalise(data, starts)
        at = self._stretches(norm, bounds)
        if not len(at):
            none = np.zeros(0, np.int64)
            return none.astype(np.uint32), none, none, np.zeros(len(raw), np.int64)
        places = np.append(at, len(norm))
        parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(norm))])
        coded = parts.dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        values = [self._look_up(s) for s in coded.dictionary.to_pylist()]
        many = np.fromiter(map(len, values), np.int64, len(values)) // 8
        ahead = np.cumsum(many) - many
        pairs = np.frombuffer(b"".join(values), np.uint32).reshape(-1, 2)
        per = many[codes]
        upto = np.cumsum(per)
        pairs = pairs[np.repeat(ahead[codes] - (upto - per), per) + np.arange(int(upto[-1]))]
        ids, size = pairs[:, 0], pairs[:, 1].astype(np.int64)
        norm_end = np.cumsum(size)
        # Pieces of each text, by the stretches that lie in it.
        upto = np.concatenate([[0], upto])
        text_at = upto[np.searchsorted(at, bounds)]
        counts = np.diff(text_at)
        place = np.append(back, len(data))
        begins, ends = place[norm_end - size], place[norm_end]
        last = counts > 0
        ends[text_at[1:][last] - 1] = stops[last]
        own = np.repeat(starts[:-1], counts)
        return ids, begins - own, ends - own, counts

    # ---- decoding -----------------------------------------------------------------------------------------------------
    def _decode_one(self, ids: np.ndarray) -> bytes:
        """Piece by piece: runs of bytes that aren't UTF-8 have a mark for every wrong byte."""
        out, run, first = [], b"", True
        for i in [*ids.tolist(), -1]:
            if i >= 0 and self.kind[i] == BYTE:
                run += bytes([self.surface[self.surface_at[i]]])
                continue
            while run:
                size = next((n for n in range(1, 5) if _is_utf8(run[:n]) and n <= len(run)), 0)
                out.append(run[:size] if size else BAD_BYTE.encode())
                run, first = run[size or 1 :], False
            if i >= 0:
                text = self.surface[self.surface_at[i] : self.surface_at[i] + self.surface_size[i]].tobytes()
                strip = first and self.marked[i] and (self.prefix or self.collapse)
                out.append(text[1:] if strip else text)
                first = first and not text
                if strip and self.collapse and not text[1:]:
                    first = True
        return b"".join(out)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes] | pa.Array:
        """UTF-8 of each text from its ids."""
        if len(ids) and int(ids.max()) >= len(self.kind):
            raise ValueError("an id is beyond the model's pieces")
        sizes = self.surface_size[ids]
        ahead = np.cumsum(counts) - counts
        some = counts > 0
        heads = ids[ahead[some]]
        plain = not self.collapse and not (self.kind[heads] == CONTROL).any()
        ends = np.concatenate([[0], np.cumsum(sizes)])
        data = self.surface[np.repeat(self.surface_at[ids] - ends[:-1], sizes) + np.arange(int(ends[-1]))]
        bounds = np.concatenate([[0], ends[np.cumsum(counts)]])
        tops = data[bounds[:-1][np.diff(bounds) > 0]]
        if plain and not ((tops & 0xC0) == 0x80).any() and _is_utf8(data.tobytes()):
            if self.prefix:
                drop = ahead[some][self.marked[heads]]
                left = np.ones(len(data), bool)
                left[ends[drop]] = False
                gone = np.zeros(len(counts), np.int64)
                gone[np.flatnonzero(some)[self.marked[heads]]] = 1
                data, bounds = data[left], bounds - np.concatenate([[0], np.cumsum(gone)])
            return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
        return [self._decode_one(ids[a : a + n]) for a, n in zip(ahead.tolist(), counts.tolist(), strict=True)]


def _is_utf8(raw: bytes) -> bool:
    try:
        raw.decode()
    except UnicodeDecodeError:
        return False
    return True


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    """One model per Python process and file."""
    with open(path, "rb") as f:
        return PieceModel(f.read())


def _list(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values.astype(np.int32), pa.int32()))


def encode_pieces(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """docs with ids, begins and ends: the pieces of each whole text and their byte spans in it."""
    names = fresh(docs, "ids", "begins", "ends")
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, T.ArrayType(T.IntegerType())) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in slices(batches, text, 2 << 20):
            ids, begins, ends, counts = m.encode(column(batch, text))
            lists = [_list(x, counts) for x in (ids, begins, ends)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *lists], names=schema.names)

    return map_arrow(docs, run, schema)


def decode_pieces(docs: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """docs with decoded: the text that a list of ids stands for; null and empty lists give the empty text."""
    (name,) = fresh(docs, "decoded")
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in slices(batches, ids, 2 << 20):
            lists = column(batch, ids)
            counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            texts = m.decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts)
            texts = pa.array(texts, pa.large_binary()) if isinstance(texts, list) else texts
            yield pa.RecordBatch.from_arrays([*batch.columns, texts.cast(pa.binary()).cast(pa.string())], names=schema.names)

    return map_arrow(docs, run, schema)


def op11_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    coded = encode_pieces(docs, path).drop("text", "begins", "ends")
    rows = decode_pieces(coded, path)
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
