"""Offset-preserving SentencePiece encoding (BPE models) and decoding.

The model file is read once and its bytes are broadcast (a vocabulary file: a fixed size). Texts
are normalised by the longest prefix in the model's compiled character map, and each normalised
character keeps the byte of the source it came from, so every piece has its source span.
"""

from __future__ import annotations

import heapq
import re
import struct
from array import array
from collections.abc import Iterator
from itertools import chain, islice, repeat
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
CACHE = 500_000          # segments whose pieces a worker remembers (some 150 bytes each)
CACHED_CHARS = 40      # longest segment that it remembers
SCANNED_CHARS = 32     # longer segments merge with a heap, in n log n steps
# Piece types and field numbers of the model file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol-buffer message."""
    def number(i: int) -> tuple[int, int]:
        out = shift = 0
        while True:
            out |= (b[i] & 127) << shift
            shift += 7
            i += 1
            if b[i - 1] < 128:
                return out, i
    i = 0
    while i < len(b):
        key, i = number(i)
        if key & 7 == 0:
            value, i = number(i)
        else:
            n, i = number(i) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], i)
            value, i = b[i:i + n], i + n
        yield key >> 3, value


class CharMap:
    """The compiled character map: a double-array trie over bytes, then the replacements."""

    def __init__(self, blob: bytes):
        n = struct.unpack("<I", blob[:4])[0] if blob else 0
        self.units = np.frombuffer(blob[4:4 + n], "<u4").tolist()
        self.texts = blob[4 + n:]

    def longest(self, raw: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest key that ``raw`` has at ``at``."""
        if not self.units:
            return None
        def jump(u: int) -> int:
            return (u >> 10) << ((u & 512) >> 6)
        node, found = jump(self.units[0]), None
        for i in range(at, len(raw)):
            node ^= raw[i]
            unit = self.units[node] if node < len(self.units) else 0
            if unit & 0x800000FF != raw[i]:
                break
            node ^= jump(unit)
            if unit & 256:
                found = i + 1 - at, self.units[node] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.texts[found[1]:self.texts.index(b"\0", found[1])]


class Model:
    def __init__(self, blob: bytes):
        self.pieces, scores, self.types = [], [], []
        spec: dict[int, int | bytes] = {}
        trainer: dict[int, int | bytes] = {}
        for field, value in _fields(blob):
            if field == 1:
                p = dict(_fields(value))
                self.pieces.append(p[1].decode())
                scores.append(struct.unpack("<f", p.get(2, b"\0\0\0\0"))[0])
                self.types.append(p.get(3, NORMAL))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                spec = dict(_fields(value))
        if trainer.get(3, 1) != 2 or USER_DEFINED in self.types or UNUSED in self.types:
            raise ValueError("only BPE models without user-defined or unused pieces")
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.types[i] == NORMAL}
        self.cost = {p: -scores[i] for p, i in self.ids.items()}
        self.unk, self.eos = self.types.index(UNKNOWN), self.pieces.index("</s>")
        self.byte = [self.pieces.index(f"<0x{i:02X}>") for i in range(256)] if BYTE in self.types else None
        self.map = CharMap(spec.get(2, b""))
        self.dummy, self.trim, self.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        # merges never cross from another character to a space mark, nor a line feed, if no piece does
        self.cut = self.cut_plain = None
        if not any(SPACE in p.lstrip(SPACE) for p in self.ids):
            alone = "" if any("\n" in p for p in self.ids) else "\n"
            self.cut, self.cut_plain = (re.compile(f"{c}*[^{c}{alone}]+|{c}+" + f"|{alone}" * bool(alone)) for c in (SPACE, " "))
        self.code = np.dtype(np.uint16 if len(self.pieces) <= 1 << 16 else np.uint32)
        # text of a piece, for all that need no look at their neighbours
        self.plain = [p if t == NORMAL else "" if t == CONTROL else chr(int(p[3:5], 16)) if t == BYTE and p < "<0x80>" else None
                      for p, t in zip(self.pieces, self.types)]
        self.segments = Segments(self)

    def normalize(self, text: str) -> tuple[str, np.ndarray]:
        """Normalised text, and for each of its characters and the end the byte of the source
        where it starts. Empty texts stay empty (no dummy prefix)."""
        out, start = self._unescaped(text)
        return (out.replace(" ", SPACE) if self.escape else out), start

    def _unescaped(self, text: str) -> tuple[str, np.ndarray]:
        raw = text.encode()
        if not self.map.units and not self.trim:
            # identity map: one character each
            code = np.frombuffer(text.encode("utf-32-le"), "<u4")
            size = 1 + (code >= 0x80).astype(np.int32) + (code >= 0x800) + (code >= 0x10000)
            out, start = text, np.concatenate([[0], np.cumsum(size)])
        else:
            chars, at, i = [], [], 0
            while i < len(raw):
                hit = self.map.longest(raw, i)
                if hit is None:
                    n = 1 + (raw[i] >= 0xC0) + (raw[i] >= 0xE0) + (raw[i] >= 0xF0)
                    hit = n, raw[i:i + n]
                for c in hit[1].decode():
                    if not (self.trim and c == " " and (not chars or chars[-1] == " ")):
                        chars.append(c)
                        at.append(i)
                i += hit[0]
            if self.trim and chars and chars[-1] == " ":
                chars.pop()
                at.pop()
            out, start = "".join(chars), np.array([*at, len(raw)], np.int64)
        if out and self.dummy:
            out, start = " " + out, np.concatenate([start[:1] if not self.trim else [0], start])
        return out, start

    def merge(self, segment: str) -> list[str]:
        """Merge the adjacent pair of the best score, leftmost first, until no pair is a piece."""
        return self._scan(segment) if len(segment) <= SCANNED_CHARS else self._heap(segment)

    def _scan(self, segment: str) -> list[str]:
        parts, get, never = list(segment), self.cost.get, float("inf")
        pairs = list(map(get, map(add, parts, segment[1:]), repeat(never)))
        while pairs and (best := min(pairs)) != never:
            i = pairs.index(best)
            both = parts[i] + parts.pop(i + 1)
            parts[i] = both
            del pairs[i]
            if i < len(pairs):
                pairs[i] = get(both + parts[i + 1], never)
            if i:
                pairs[i - 1] = get(parts[i - 1] + both, never)
        return parts

    def _heap(self, segment: str) -> list[str]:
        parts: list[str | None] = list(segment)
        before, after = list(range(-1, len(parts) - 1)), [*range(1, len(parts)), -1]
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] >= 0:
                both = parts[i] + parts[after[i]]
                if both in self.cost:
                    heapq.heappush(heap, (self.cost[both], i, after[i], both))
        for i in range(len(parts)):
            offer(i)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if parts[i] is None or parts[j] is None or after[i] != j or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j], after[i] = both, None, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [p for p in parts if p is not None]

    def segment(self, text: str) -> bytes:
        """Pairs of numbers: the ids of a segment, and how many characters each takes (a
        character of several byte pieces counts at the last)."""
        parts = self.merge(text)
        ids, size = list(map(self.ids.get, parts)), list(map(len, parts))
        if None in ids:
            ids, size = self._with_bytes(parts)
        return array(self.code.char, chain.from_iterable(zip(ids, size))).tobytes()

    def _with_bytes(self, parts: list[str]) -> tuple[list[int], list[int]]:
        ids, size = [], []
        for p in parts:
            known = self.ids.get(p, self.unk if self.byte is None else None)
            if known is not None:
                ids.append(known)
                size.append(len(p))
            else:
                raw = p.encode()
                ids.extend(self.byte[c] for c in raw)
                size.extend([0] * (len(raw) - 1) + [len(p)])
        return ids, size

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids with an end id, and for each the byte of the source text where its span ends (it
        starts where the one before ends)."""
        norm, start = self._unescaped(text)
        cut = self.cut
        if self.escape:
            # spaces become marks segment by segment: a cache of plain texts takes half the memory
            norm, cut = (norm.replace(" ", SPACE), cut) if SPACE in norm else (norm, self.cut_plain)
        found = cut.findall(norm) if cut else [norm] if norm else []
        coded = np.frombuffer(b"".join(map(self.segments.__getitem__, found)), self.code).reshape(-1, 2)
        ends = start[np.cumsum(coded[:, 1])]
        return np.append(coded[:, 0], self.eos).astype(np.int32), np.append(ends, start[-1]).astype(np.int32)

    def decode(self, ids: list[int]) -> str:
        """Text of pieces: one space mark at the start is the dummy prefix; runs of byte pieces are
        UTF-8 (bytes that are not become U+FFFD each)."""
        if ids and self.types[ids[0]] == NORMAL:
            try:
                text = "".join(map(self.plain.__getitem__, ids))
                return (text[1:] if text[0] == SPACE and (self.dummy or self.trim) else text).replace(SPACE, " ")
            except TypeError:     # a piece that needs its neighbours
                pass
        out: list[str] = []
        held = bytearray()
        first = self.dummy or self.trim
        for i in ids:
            kind = self.types[i]
            if kind == BYTE:
                held.append(int(self.pieces[i][3:5], 16))
                first = False
                continue
            if held:
                out.append(_utf8(bytes(held)))
                held.clear()
            if kind == CONTROL:
                continue
            piece = " ⁇ " if kind == UNKNOWN else self.pieces[i]
            if first and piece.startswith(SPACE):
                piece = piece[1:]
            first = False
            out.append(piece)
        out.append(_utf8(bytes(held)))
        return "".join(out).replace(SPACE, " ")


class Segments(dict):
    """Segments met so far, up to ``CACHE`` of them; then the first half stays, which frequent ones are in."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, text: str) -> bytes:
        coded = self.model.segment(text.replace(" ", SPACE) if self.model.escape else text)
        if len(text) <= CACHED_CHARS:
            if len(self) >= CACHE:
                kept = list(islice(self.items(), CACHE // 2))
                self.clear()
                self.update(kept)
            self[text] = coded
        return coded


def _utf8(raw: bytes) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out = []
        while raw:
            n = 1 + (raw[0] >= 0xC0) + (raw[0] >= 0xE0) + (raw[0] >= 0xF0)
            try:
                out.append(raw[:n].decode())
                raw = raw[n:]
            except UnicodeDecodeError:
                out.append("�")
                raw = raw[1:]
        return "".join(out)


_loaded: dict[int, Model] = {}


def _model(blob: bytes) -> Model:
    """The model of this worker process (read once, with its cache)."""
    key = hash(blob)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Model(blob)
    return _loaded[key]


def read_model(path: str) -> bytes:
    """Bytes of a model file that the driver can open."""
    with open(path, "rb") as f:
        return f.read()


def encode_decode(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id, ids (with an end id), ends (source byte where each piece's span ends), decoded:
    one row per row of ``docs (doc_id, text)``. A null text is empty: the end id alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(shared.value)
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                ids, ends, texts = [], [], []
                for t in part["text"].to_pylist():
                    i, e = m.encode(t or "")
                    ids.append(i)
                    ends.append(e)
                    texts.append(m.decode(i.tolist()))
                where = pa.array(np.cumsum([0, *map(len, ids)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], pa.ListArray.from_arrays(where, np.concatenate(ids)),
                     pa.ListArray.from_arrays(where, np.concatenate(ends)), pa.array(texts, pa.string())],
                    ["doc_id", "ids", "ends", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<int>, ends array<int>, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of rows of ``encode_decode``."""
    return encoded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
                          F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"))
