"""Byte-level BPE over content-defined chunks, equal to the tokenizers library.

A rolling hash over the bytes cuts each text where its last bytes say so, so
passages that documents share give the same chunks, which a task encodes once. A
chunk's inside is what lies between places at which the library's splitting
pattern must begin a new piece whatever stands around: a single space, or line
feed, between two characters that are not white space. What is left over at the
joins is re-encoded together with the piece on either side, which must come out as
it does within its chunk; if it does not, the text is encoded anew as a whole.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

#: Mean bytes of a chunk, as a power of two, and bytes the rolling hash looks at.
CHUNK_BITS = 11
WINDOW = 32
#: Bytes of chunks, and number of pieces, that a task keeps.
KEPT_BYTES = 48 << 20
KEPT_PIECES = 100_000
_BASE = 0x9E3779B97F4A7C15
_BLOCK = 1 << 18
_OTHER_CONTROL = bytes(x for x in (*range(32), 127) if x != 10)
_WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
#: What a piece may hold to go to the rank encoder: printable ASCII, line feeds and
#: the Latin letters of U+00C0 to U+00FF, whose classes no library disputes.
_COMMON = re.compile(rb"(?:[\n\x20-\x7e]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])*")
_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SAFE = re.compile(rb"(?<=[\x21-\x7e])(?= [\x21-\x7e])")


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, _BLOCK + WINDOW), _powers(pow(_BASE, -1, 1 << 64), _BLOCK + WINDOW)


def cuts(texts: list[bytes]) -> list[list[int]]:
    """Where the chunks of each text begin, 0 left out: after windows whose hash has
    its top bits zero. The hash looks at ``WINDOW`` bytes of one text, whatever else
    stands in the list, and a cut moves on to the next whole character."""
    data = b"".join(texts)
    raw, found = np.frombuffer(data, np.uint8), [np.zeros(0, np.int64)]
    for lo in range(0, max(0, len(raw) - WINDOW), _BLOCK):
        block = raw[lo : lo + _BLOCK + WINDOW - 1].astype(np.uint64)
        sums = np.zeros(len(block) + 1, np.uint64)
        np.cumsum(block * _UP[: len(block)], out=sums[1:])
        h = (sums[WINDOW:] - sums[:-WINDOW]) * _DOWN[: len(block) + 1 - WINDOW]
        h ^= h >> np.uint64(29)
        found.append(np.flatnonzero(h * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - CHUNK_BITS) == 0) + lo + WINDOW)
    at = np.concatenate(found)
    ends = np.cumsum([len(t) for t in texts])
    out: list[list[int]] = [[] for _ in texts]
    if not len(at):
        return out
    for c, k in zip(at.tolist(), np.searchsorted(ends, at).tolist()):  # a window that ends with its text cuts nothing
        begin, end, own = int(ends[k]) - len(texts[k]), int(ends[k]), out[k]
        if c - begin < WINDOW:
            continue
        while c < end and data[c] & 0xC0 == 0x80:
            c += 1
        if c < end and (not own or c - begin > own[-1]):
            own.append(c - begin)
    return out


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class Codec:
    """Encodes and decodes whole texts with one vocabulary file."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        byte = _byte_of()
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes_of = {i: bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t, i in vocab.items()}
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        ranks = {self.bytes_of[i]: i for t, i in vocab.items() if t not in special}
        merges = [m if isinstance(m, list) else m.split(" ") for m in json.loads(self.tokenizer.to_str())["model"]["merges"]]
        #: Ranks are ids where each merge makes the next id; then both libraries merge alike.
        alike = all(vocab[a + b] == 256 + k for k, (a, b) in enumerate(merges))
        self.ranked = tiktoken.Encoding("ranks", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={}) if alike else None
        self.special, self.special_ids = [t.encode() for t in special], [vocab[t] for t in special]
        self.pieces: dict[bytes, bytes] = {}
        self.chunks: dict[tuple[bool, bytes], tuple | None] = {}
        self.kept = 0

    def whole(self, data: bytes) -> bytes:
        """Ids of ``data`` on its own, as little-endian int32."""
        return np.array(self.tokenizer.encode(data.decode(), add_special_tokens=False).ids, "<i4").tobytes()

    def _common(self, data: bytes) -> bool:
        """Whether the rank encoder may take ``data`` or any piece of it."""
        return self.ranked is not None and _COMMON.fullmatch(data) is not None and not any(t in data for t in self.special)

    def ids(self, data: bytes) -> bytes:
        """Ids of a stretch on its own, by the rank encoder where it may be used."""
        if self._common(data):
            return self.ranked.encode_to_numpy(data.decode(), disallowed_special=()).astype("<i4").tobytes()
        return self.whole(data)

    def piece(self, data: bytes) -> bytes:
        """As ``ids``, and kept: pieces beside joins come again and again."""
        ids = self.pieces.get(data)
        if ids is None:
            if len(self.pieces) >= KEPT_PIECES:
                self.pieces.clear()
            ids = self.pieces[data] = self.ids(data)
        return ids

    def _split(self, chunk: bytes, plain: bool) -> list[bytes]:
        """Pieces of a chunk; all but the first begin where a new one must begin."""
        if not plain:
            return _SAFE.split(chunk)
        first, *rest = chunk.replace(b"\n", b" \n").split(b" ")
        return [first, *(w if w[:1] == b"\n" else b" " + w for w in rest)]

    def chunk(self, chunk: bytes, plain: bool) -> tuple | None:
        """(head, first piece, ids of the inside, last piece, tail); None: no inside."""
        key = (plain, chunk)
        if key in self.chunks:
            return self.chunks[key]
        parts = self._split(chunk, plain)
        got = None
        if len(parts) > 2:
            inside = parts[1:-1]
            got = parts[0], inside[0], self.ids(b"".join(inside)), inside[-1], parts[-1]
        if self.kept > KEPT_BYTES:
            self.chunks.clear()
            self.kept = 0
        self.chunks[key] = got
        self.kept += 3 * len(chunk)
        return got

    def _seam(self, left: bytes, seam: bytes, right: bytes) -> bytes | None:
        """Ids of a join, if ``left`` and ``right`` beside it come out unchanged."""
        ids, a, b = self.piece(seam) if seam else b"", self.piece(left) if left else b"", self.piece(right) if right else b""
        return ids if self.piece(left + seam + right) == a + ids + b else None

    def encode(self, data: bytes, at: list[int] | None = None) -> bytes:
        """Ids of a whole text, as little-endian int32. ``at``: its ``cuts``, if known."""
        at = cuts([data])[0] if at is None else at
        plain = len(data.translate(None, _OTHER_CONTROL)) == len(data) and not any(x in data for x in (b"  ", b" \n", b"\n ", b"\n\n")) and not _WIDE_SPACE.search(data)
        out, seam, last, begin = [], b"", b"", 0
        for end in (*at, len(data)):
            got = self.chunk(data[begin:end], plain)
            if got is None:
                seam += data[begin:end]
            else:
                head, first, ids, tail_piece, tail = got
                mended = self._seam(last, seam + head, first)
                if mended is None:
                    return self.whole(data)
                out += mended, ids
                seam, last = tail, tail_piece
            begin = end
        if seam:
            mended = self._seam(last, seam, b"")
            if mended is None:
                return self.whole(data)
            out.append(mended)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        ids = np.frombuffer(ids, "<i4")
        if self.ranked and not np.isin(ids, self.special_ids).any():
            return self.ranked.decode_bytes(ids.tolist())
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _round_trip(path: str, decode: bool):
    def run(batches):
        own = codec(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = pc.cast(part.column(1), pa.binary()).to_pylist()
                ids: list[bytes] = []
                for k, (t, at) in enumerate(zip(texts, cuts(texts))):  # copies in a row, as a mix leaves them, are encoded once
                    ids.append(ids[-1] if k and t == texts[k - 1] else own.encode(t, at))
                offsets = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<i4")))
                cols, names = [part.column(0), lists], ["doc_id", "ids"]
                if decode:
                    cols.append(pa.array([own.decode(x).decode("utf-8", "replace") for x in ids], pa.string()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def _input(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) for every row, of the whole text however long. Null texts count as
    empty and give no ids; rows that repeat, or have a null doc_id, get a row each; an
    empty table has none; other columns of ``docs`` are not read."""
    return _input(docs).mapInArrow(_round_trip(path, False), "doc_id long, ids array<int>")


def encode_and_decode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded): as ``encode``, with the text that the ids stand for."""
    return _input(docs).mapInArrow(_round_trip(path, True), "doc_id long, ids array<int>, decoded string")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """(doc_id, decoded) of (doc_id, ids); null ids count as none."""

    def run(batches):
        own = codec(path)
        for batch in batches:
            text = [own.decode(np.array(x or [], "<i4").tobytes()).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], ["doc_id", "decoded"])

    return tokens.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, decoded string")


def public_vocabulary(name: str = "byte_bpe_50k.json") -> str:
    from public_tokenizers import path

    return path(name)
