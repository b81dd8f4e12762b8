"""SentencePiece encoding and decoding with byte spans of the original text.

A text is normalised by longest-prefix replacement through the model's compiled character map
(a double array trie), and every normalised character keeps the span of original bytes it came
from. Byte-pair merges then run on the normalised string, and each piece is projected through
that alignment to a span of the original UTF-8 bytes. Decoding turns ids back into text.

Merges never cross the front of a run of space marks when no piece has a space mark behind
another character, nor a character that occurs in no longer piece; the text is cut there. A
process remembers the ids of the words it met, in a memory of bounded size; words that it does not remember are
merged anew. The library reads the model's file for the tests alone.

``digest_table`` encodes with spans, decodes, and returns digests of ids, spans and the decoded text. Where the map is
empty (each character stands for itself) the alignment follows from the bytes of the pieces, and spans are made as
arrays; else, and for texts that hold the space mark itself, character by character. Both are held against each other by tests.

Defined cases: null is the empty text; an empty text has no pieces; a text of any length is
encoded whole; repeated rows stay repeated; an empty table gives an empty table; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from treeledger.llm.common import mapped

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Words whose ids a process remembers, and their length at most. When the memory is full it becomes the old one,
#: and the words that are met again move to the new one.
REMEMBERED, LONGEST = 120_000, 48
NONE = math.inf


class CharacterMap:
    """A compiled character map: a double array trie whose values are offsets of replacements."""

    def __init__(self, blob: bytes):
        self.blob = blob
        if blob:
            (n,) = struct.unpack_from("<I", blob)
            self.units = struct.unpack_from(f"<{n // 4}I", blob, 4)
            self.texts = blob[4 + n :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest rule that data has at this place, and what replaces it."""
        if not self.blob:
            return None
        unit, found = self.units[0], None
        node = self._offset(unit)
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= self._offset(unit)
            if (unit >> 8) & 1:
                start = self.units[node] & 0x7FFFFFFF
                found = i + 1 - at, self.texts[start : self.texts.index(b"\0", start)]
        return found

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)


class Model:
    """A byte-pair model of the sentencepiece library, read from its file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        if proto.trainer_spec.model_type != 2:
            raise ValueError("only byte-pair models are supported")
        spec = proto.normalizer_spec
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.dummy, self.squeeze, self.mark_spaces = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.pieces = [p.piece for p in proto.pieces]
        self.kinds = [p.type for p in proto.pieces]
        self.merge = {p.piece: (-p.score, i) for i, p in enumerate(proto.pieces) if p.type in (NORMAL, USER, UNUSED)}
        self.unknown = self.kinds.index(UNKNOWN)
        self.byte_ids = {int(p[1:-1], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        self.said_out = {str(i): self._said(i) for i in range(len(self.pieces))}
        joined = set("".join(p for p in self.merge if len(p) > 1))
        self.free = self.mark_spaces and not any(SPACE in p.lstrip(SPACE) for p in self.merge)
        line = "" if "\n" in joined else "\\n"
        self.unit = re.compile(f"{SPACE}*[^{SPACE}{line}]+|{SPACE}+" + (f"|{line}" if line else ""))
        #: Whether a text is cut at single spaces, and each word can be encoded by itself.
        self.plain = self.free and self.dummy and not self.map.blob and not self.squeeze and line != ""
        self.words: dict[str, str] = {}
        self.old: dict[str, str] = {}
        self.ranks = {p: r for p, (r, _) in self.merge.items()}
        self.numbers = {p: str(i) for p, (_, i) in self.merge.items()}
        #: Source bytes that a piece stands for where the map is empty; the value of a byte piece, else -1.
        self.bytes_of = np.array([1 if k == BYTE else 0 if k == CONTROL else len(p.replace(SPACE, " ").encode()) for p, k in zip(self.pieces, self.kinds, strict=True)])
        self.byte_of = np.full(len(self.pieces), -1)
        for value, i in self.byte_ids.items():
            self.byte_of[i] = value
        #: Normalised characters that a piece covers; of the bytes of a character, the last one covers it.
        self.sizes = [0 if k == BYTE else len(p) for p, k in zip(self.pieces, self.kinds, strict=True)]

    def _said(self, i: int) -> bytes:
        kind, piece = self.kinds[i], self.pieces[i]
        if kind == BYTE:
            return bytes([int(piece[1:-1], 16)])
        return b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else piece.replace(SPACE, " ").encode()

    def normalise(self, text: str) -> tuple[str, list[int] | None]:
        """The normalised text, and for each of its characters and its end the original byte it starts at.

        Where each character stands for itself the places are left out (None): they follow from
        the lengths.
        """
        if not self.map.blob and not self.squeeze:
            if not text:
                return "", None
            return (SPACE if self.dummy else "") + (text.replace(" ", SPACE) if self.mark_spaces else text), None
        data, out, places, at = text.encode(), [], [], 0
        while at < len(data):
            size, new = self._step(data, at)
            for c in new.decode():
                out.append(c)
                places.append(at)
            at += size
        if self.squeeze:
            kept = [i for i, c in enumerate(out) if c != " " or (i and out[i - 1] != " ")]
            while kept and out[kept[-1]] == " ":
                kept.pop()
            end = places[kept[-1] + 1] if kept and kept[-1] + 1 < len(places) else len(data)
            out, places = [out[i] for i in kept], [places[i] for i in kept]
        else:
            end = len(data)
        if out and self.dummy:
            out.insert(0, " ")
            places.insert(0, places[0])
        return "".join(SPACE if c == " " and self.mark_spaces else c for c in out), [*places, end]

    def _step(self, data: bytes, at: int) -> tuple[int, bytes]:
        if found := self.map.longest(data, at):
            return found
        first = data[at]
        size = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
        return size, data[at : at + size]

    def _merged(self, unit: str) -> list[str]:
        """Pieces of a unit: the best pair is merged until none is in the vocabulary; of equals, the left one first."""
        if len(unit) > LONGEST:
            return self._merged_long(unit)
        pieces, rank = list(unit), self.ranks.get
        ranks = [rank(a + b, NONE) for a, b in pairwise(pieces)]
        while ranks and (least := min(ranks)) < NONE:
            i = ranks.index(least)
            pieces[i] = both = pieces[i] + pieces.pop(i + 1)
            del ranks[i]
            if i:
                ranks[i - 1] = rank(pieces[i - 1] + both, NONE)
            if i < len(ranks):
                ranks[i] = rank(both + pieces[i + 1], NONE)
        return pieces

    def _merged_long(self, unit: str) -> list[str]:
        """The same with a heap, in n log n steps."""
        parts: list[str | None] = list(unit)
        n = len(parts)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (found := self.merge.get(both := parts[a] + parts[b])):
                heapq.heappush(heap, (found[0], a, b, both))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, a, b, both = heapq.heappop(heap)
            if parts[a] is None or parts[b] is None or right[a] != b or parts[a] + parts[b] != both:
                continue
            parts[a], parts[b] = both, None
            right[a] = right[b]
            if right[b] >= 0:
                left[right[b]] = a
            offer(left[a], a)
            offer(a, right[a])
        return [p for p in parts if p is not None]

    def _joined(self, unit: str) -> str:
        """Ids of a unit as decimal numbers joined by commas."""
        pieces = self._merged(unit)
        try:
            return ",".join([self.numbers[p] for p in pieces])
        except KeyError:
            return ",".join(map(str, self._ids(pieces)))

    def _ids(self, pieces: list[str]) -> list[int]:
        ids = []
        for piece in pieces:
            if found := self.merge.get(piece):
                ids.append(found[1])
            elif self.byte_ids:
                ids += [self.byte_ids[b] for b in piece.encode()]
            else:
                ids.append(self.unknown)
        return ids

    def joined(self, normal: str) -> str:
        """The ids of a normalised text as decimal numbers joined by commas."""
        return self.joined_many([normal])[0]

    def joined_many(self, normals: list[str]) -> list[str]:
        """The same of many texts; the words of all of them that aren't remembered are learned at once."""
        out: list[str | None] = [None] * len(normals)
        words, known, new = {}, self.words.get, set()
        for i, normal in enumerate(normals):
            if self.plain and normal[:1] == SPACE and SPACE * 2 not in normal and normal[-1] != SPACE:  # single spaces between words
                parts = normal[1:].split(SPACE)
                words[i] = parts, (got := list(map(known, parts)))
                if None in got:
                    new.update([w for w, g in zip(parts, got, strict=True) if g is None])
            else:
                units = self.unit.findall(normal) if self.free else [normal] if normal else []
                out[i] = ",".join([self._joined(u) for u in units])
        said = self._learn(list(new)) if new else {}
        for i, (parts, got) in words.items():
            if None in got:
                got = [g if g is not None else said[w] for g, w in zip(got, parts, strict=True)]
            out[i] = ",".join(got)
        return out

    def _learn(self, words: list[str]) -> dict[str, str]:
        """Ids of words, each with the space mark before it."""
        said = {}
        for w in words:
            if (x := self._older(w)) is None:
                x = self._joined(SPACE + w) if "\n" not in w else ",".join([self._joined(u) for u in self.unit.findall(SPACE + w)])
                if len(w) <= LONGEST:
                    if len(self.words) >= REMEMBERED:
                        self.old, self.words = self.words, {}
                    self.words[w] = x
            said[w] = x
        return said

    def _older(self, word: str) -> str | None:
        """Of a word met before the memory was last full."""
        said = self.old.get(word)
        if said is not None:
            self.words[word] = said
        return said

    def encode(self, text: str | None) -> list[int]:
        said = self.joined(self.normalise(text or "")[0])
        return list(map(int, said.split(","))) if said else []

    def encode_spans(self, text: str | None) -> list[tuple[int, int, int]]:
        """(id, first byte, end byte) of each piece, in bytes of the original text. Bytes of one character share its span."""
        text = text or ""
        normal, places = self.normalise(text)
        if places is None:  # each character stands for itself
            places = [0] * (bool(text) and self.dummy) + list(accumulate([len(c.encode()) for c in text], initial=0))
        said = self.joined(normal)
        out, at, held = [], 0, []
        for i in map(int, said.split(",") if said else ()):
            held.append(i)
            size = self.sizes[i] or (len(held) == len(normal[at].encode()))
            if size:
                out += [(x, places[at], places[at + size]) for x in held]
                held, at = [], at + size
        return out

    def span_arrays(self, text: str, said: str) -> tuple[np.ndarray, np.ndarray]:
        """First bytes and end bytes of the pieces of a text whose ids are given as decimal numbers joined by commas."""
        if not said:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if self.map.blob or self.squeeze or not self.mark_spaces or not self.byte_ids or SPACE in text:
            spans = self.encode_spans(text)
            return np.array([a for _, a, _ in spans]), np.array([b for _, _, b in spans])
        ids = np.fromstring(said, dtype=np.int64, sep=",")
        sizes = self.bytes_of[ids]
        ends = np.cumsum(sizes) - self.dummy
        begins = np.maximum(ends - sizes, 0)
        value = self.byte_of[ids]
        if (value >= 0).any():  # the bytes of a character share its span
            new = (value < 0x80) | (value >= 0xC0)
            of = np.cumsum(new) - 1
            begins = begins[new][of]
            ends = ends[np.append(np.flatnonzero(new)[1:] - 1, len(ids) - 1)][of]
        return begins, ends

    def decode(self, ids: Iterable[int]) -> str:
        return self.decode_joined(",".join(map(str, ids)))

    def decode_joined(self, said: str) -> str:
        """The text of ids given as decimal numbers joined by commas."""
        raw = b"".join(map(self.said_out.__getitem__, said.split(","))) if said else b""
        if self.dummy and raw[:1] == b" ":
            first = next(i for i in map(int, said.split(",")) if self.kinds[i] != CONTROL)
            raw = raw[1:] if self.kinds[first] not in (BYTE, UNKNOWN) else raw
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return _lenient(raw)


def _lenient(raw: bytes) -> str:
    """Each byte that starts no valid character becomes U+FFFD."""
    out, at = [], 0
    while at < len(raw):
        for size in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + size].decode())
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


@lru_cache(maxsize=2)
def model(path: str) -> Model:
    return Model(path)


ENCODED = "doc_id bigint, ids array<int>, begins array<int>, ends array<int>"
DIGESTS = "doc_id bigint, n_tokens bigint, n_bytes bigint, spanned_bytes bigint, ids_sha256 string, decoded_sha256 string, spans_sha256 string"


def encode_table(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, begins, ends: the pieces of each document with their spans of original bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                spans = [m.encode_spans(t) for t in part.column(1).to_pylist()]
                columns = [pa.array([[x[k] for x in s] for s in spans], pa.list_(pa.int32())) for k in range(3)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc_id", "ids", "begins", "ends"])

    return mapped(docs.select("doc_id", "text"), run, ENCODED)


def decode_table(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of encoded documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            texts = [m.decode(x or ()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return mapped(encoded.select("doc_id", "ids"), run, "doc_id bigint, text string")


def digest_table(docs: DataFrame, path: str) -> DataFrame:
    """Encodes with spans, decodes, and returns the digests, in one pass.

    ``spans_sha256`` is of the first byte and the end byte of each piece, as 64-bit little-endian numbers;
    ``spanned_bytes`` is where the last span ends, ``n_bytes`` where the text does.
    """
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
    columns = [c.split()[0] for c in DIGESTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                rows = [_digest(m, t, x) for t, x in zip(texts, m.joined_many([m.normalise(t)[0] for t in texts]), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], columns)

    return mapped(docs.select("doc_id", "text"), run, DIGESTS)


def _digest(m: Model, text: str, said: str) -> tuple[int, int, int, str, str, str]:
    begins, ends = m.span_arrays(text, said)
    spans = np.stack([begins, ends], axis=1).astype("<i8").tobytes()
    decoded = m.decode_joined(said).encode()
    return len(begins), len(text.encode()), int(ends[-1]) if len(ends) else 0, *(hashlib.sha256(x).hexdigest() for x in (said.encode(), decoded, spans))
