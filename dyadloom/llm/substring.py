"""Removal of repeated passages, found by recompression.

Each text becomes a sequence of symbols, at first its words, named by 128 bits: the
word itself, or a digest of a long one. A round of recompression collapses runs of
equal symbols and then puts every neighbour pair of a first-class and a second-class
symbol under one new name; classes follow from names, so equal stretches get equal
symbols in their interior. After the later rounds all names go to buckets, where Spark
counts them over the whole corpus, and the answer goes back: a symbol that occurs once
is no part of a repeat, so it never pairs again and sends nothing more.

Locality. Each symbol carries the range of words that its making depended on: its own,
its neighbours' at each step, and the edge of the document, if it looked there. Two
equal windows that hold a symbol's whole range both have that symbol. Hence a window
over the range of a symbol that occurs once does not repeat, and all others are
compared by 128 bits over the names of their words. Inside a run no symbol's
range fits into a window, so such windows are compared too.

Messages between stages are packed: documents travel as compressed batches, names as
one array for each (bucket, batch), answers as one bit a name or as compressed
distances of starts. A name is sent once for
each batch, however often it occurs, so a passage that a third of the corpus holds
loads no task more than another.

Answers meet by batch before they are written, so a round writes a file for ``ANSWERS``
bytes of text and not one for each task: on a local or mounted folder Hadoop starts a
process for each file, which until its exec shares all memory of the executor's JVM.
"""

from __future__ import annotations

import gc
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, parts, settle

#: Bytes of text in a batch, and of text for each bucket of names.
BATCH = 4 << 20
BUCKET = 8 << 20
#: Bytes of text whose answers are one file.
ANSWERS = 128 << 20
LEAST_BUCKETS = 6
ROUNDS = 3
#: Rounds after which symbols are counted. The first leaves pairs of common words, most
#: of which occur twice anywhere, so asking about them would only cost a pass.
COUNTED = (1, 2)
#: Parameter of the digests of words: names are the same wherever it is.
KEY = b"dyadloom words"
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_NONE = np.iinfo(np.int64).max


def _far(kind) -> int:
    """A word's number beyond any that ``kind`` is used for; twice that still fits."""
    return int(np.iinfo(kind).max) // 4


# --- batches of documents -------------------------------------------------------


def _tie(text: bytes) -> int:
    """Order of rows that share a doc_id: by their texts, whatever the partitions."""
    return int.from_bytes(blake2b(text, digest_size=8).digest(), "little", signed=True)


def _packed(docs: list[tuple[int | None, bytes]]) -> bytes:
    docs = sorted(docs, key=lambda d: (d[0] is None, d[0] or 0, _tie(d[1])))
    head = np.array([len(docs), *(0 if i is None else i for i, _ in docs), *(i is None for i, _ in docs), *(len(t) for _, t in docs)], "<i8")
    return zstandard.ZstdCompressor(level=9).compress(head.tobytes() + b"".join(t for _, t in docs))


def _unpacked(blob: bytes) -> tuple[list[int | None], list[bytes]]:
    raw = memoryview(zstandard.ZstdDecompressor().decompress(blob))
    n = int(np.frombuffer(raw[:8], "<i8")[0])
    ids, null, size = np.frombuffer(raw[8 : 8 + 24 * n], "<i8").reshape(3, n)
    ends = 8 + 24 * n + np.cumsum(size)
    return [None if z else int(i) for i, z in zip(ids, null)], [bytes(raw[e - s : e]) for e, s in zip(ends, size)]


def _pack(batches):
    part, count, held, size = TaskContext.get().partitionId(), 0, [], 0

    def row():
        return pa.RecordBatch.from_arrays([pa.array([part << 32 | count]), pa.array([size]), pa.array([_packed(held)], pa.binary())], ["batch", "n_bytes", "blob"])

    for batch in parts(batches):
        ids, texts = batch.column(0).to_pylist(), pc.cast(batch.column(1), pa.binary())
        for i, t in zip(ids, texts):
            t = t.as_py() or b""
            held.append((i, t))
            size += len(t)
            if size >= BATCH or len(held) >= 1 << 16:
                yield row()
                count, held, size = count + 1, [], 0
    if held:
        yield row()


# --- names ------------------------------------------------------------------------


def _word_names(words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit names of each word. Up to 15 bytes they are the word itself and its
    length, longer words have a 120-bit digest; a keyed bijection then mixes both halves."""
    size = np.asarray(pc.binary_length(words)).astype(np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    wide = np.zeros((len(words), 16), np.uint8)
    short = size < 16
    for k in range(15):
        own = np.flatnonzero(short & (size > k))
        wide[own, k] = data[ends[own] + k]
    wide[:, 15] = np.where(short, size, 255)
    for i in np.flatnonzero(~short):
        wide[i, :15] = np.frombuffer(blake2b(words[int(i)].as_buffer(), digest_size=15, person=KEY).digest(), np.uint8)
    a, b = wide.view("<u8").T.copy()
    for salt in (1, 2):
        a = a ^ mix64(b + _BASES[0] + np.uint64(salt))
        b = b ^ mix64(a + _BASES[1] + np.uint64(salt))
    return a, b


def _words(texts: list[bytes]) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray, np.ndarray]:
    """Names of the distinct words, and for every word which of them it is and its document."""
    lists = pc.ascii_split_whitespace(pa.array(texts, pa.string()))  # with empty words at the ends of texts
    words = lists.flatten()
    some = np.asarray(pc.binary_length(words)) > 0
    of = np.repeat(np.arange(len(texts), dtype=np.int32), lists.value_lengths().to_numpy())[some]
    coded = words.filter(pa.array(some)).dictionary_encode()
    return _word_names(coded.dictionary), coded.indices.to_numpy().copy(), of  # a copy, as Arrow's memory goes


def _spans(names: np.ndarray, width: int, base: np.uint64) -> np.ndarray:
    """Name of names[i : i + width] for every i at which it fits, by doubling."""
    if len(names) < width:
        return names[:0]
    out, have, step, p, left = None, 0, names, int(base), width
    size = 1
    while left:
        if left & 1:
            scale = np.uint64(pow(int(base), have, 1 << 64))
            piece = step[have:] * scale
            out = piece if out is None else out[: len(piece)] + piece[: len(out)]
            have += size
        left >>= 1
        if left:
            step = step[: len(step) - size] + step[size:] * np.uint64(p)
            p = p * p % (1 << 64)
            size *= 2
    return mix64(out[: len(names) - width + 1])


def _joined(left: np.ndarray, right: np.ndarray, salt: int) -> np.ndarray:
    return mix64(mix64(left + np.uint64(salt)) * _BASES[0] + right * _BASES[1])


class _Symbols:
    """A round's symbols over the words of a batch: name, range of words that it depends
    on, document, and whether it may still be part of a repeat."""

    def __init__(self, name, lo, hi, doc, live):
        self.name, self.lo, self.hi, self.doc, self.live = name, lo, hi, doc, live

    def _beside(self) -> tuple[np.ndarray, np.ndarray]:
        """The ranges' ends of the symbols before and after, beyond reach at an edge."""
        kind = self.lo.dtype
        before, after = np.full(len(self.lo), -_far(kind), kind), np.full(len(self.lo), _far(kind), kind)
        same = self.doc[1:] == self.doc[:-1]
        before[1:][same], after[:-1][same] = self.lo[:-1][same], self.hi[1:][same]
        return before, after

    def collapsed(self, salt: int) -> _Symbols:
        """Runs of equal symbols as one, of their name and length."""
        n = len(self.name)
        begins = np.ones(n, bool)
        begins[1:] = (self.name[1:] != self.name[:-1]) | (self.doc[1:] != self.doc[:-1]) | ~self.live[1:] | ~self.live[:-1]
        first = np.flatnonzero(begins)
        last = np.append(first[1:], n) - 1 if n else first
        runs = np.flatnonzero(last > first)
        name = self.name[first]
        name[runs] = _joined(name[runs], (last[runs] - first[runs] + 1).astype(np.uint64), salt)
        before, after = self._beside()
        return _Symbols(name, np.minimum(self.lo[first], before[first]), np.maximum(self.hi[last], after[last]), self.doc[first], self.live[first])

    def paired(self, salt: int) -> _Symbols:
        """Every neighbour pair of a first and a second class as one symbol."""
        second = mix64(self.name + np.uint64(salt)) >> np.uint64(63) == 1
        pair = np.zeros(len(self.name), bool)  # of a symbol with the one after it
        pair[:-1] = ~second[:-1] & second[1:] & (self.doc[1:] == self.doc[:-1]) & self.live[1:] & self.live[:-1]
        ends = np.zeros(len(self.name), bool)
        ends[1:] = pair[:-1]
        before, after = self._beside()
        alone = ~pair & ~ends
        lo = np.where(alone & second, np.minimum(self.lo, before), self.lo)
        hi = np.where(alone & ~second, np.maximum(self.hi, after), self.hi)
        name, live = self.name.copy(), self.live.copy()
        k = np.flatnonzero(pair)
        name[k] = _joined(self.name[k], self.name[k + 1], salt)
        lo[k], hi[k] = np.minimum(self.lo[k], self.lo[k + 1]), np.maximum(self.hi[k], self.hi[k + 1])
        keep = ~ends
        return _Symbols(name[keep], lo[keep], hi[keep], self.doc[keep], live[keep])

    def units(self, width: int, last: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(key, lo, hi, symbol) of what is counted: live symbols whose range a window can
        hold; in the last round each with its two neighbours, which tell more."""
        key, lo, hi, live, some = self.name, self.lo, self.hi, self.live, np.arange(len(self.name))
        if last:
            side = lambda x: (x[:-2], x[1:-1], x[2:])
            a, b, c = side(self.name)
            key, some = _joined(_joined(a, b, 3), c, 3), some[1:-1]
            lo, hi, live = np.minimum.reduce(side(lo)), np.maximum.reduce(side(hi)), np.logical_and.reduce(side(live))
            live = live & (self.doc[:-2] == self.doc[2:])
        fit = live & (hi - lo <= width)
        return key[fit], lo[fit], hi[fit], some[fit]


class _Batch:
    """Words and windows of one batch as arrays over its words, with the rounds run as far
    as there are answers; ``key`` then has the names to be counted next."""

    def __init__(self, blob: bytes, width: int, answers: list[dict[int, bytes]], n_buckets: int):
        self.ids, self.texts = _unpacked(blob)
        self.names, self.which, self.doc = _words(self.texts)
        pa.default_memory_pool().release_unused()
        n = len(self.doc)
        self.width = width
        kind = np.int32 if n + width < _far(np.int32) else np.int64
        first = np.searchsorted(self.doc, np.arange(len(self.texts) + 1, dtype=np.int32)).astype(kind)  # of each document, among the words
        at = np.arange(n, dtype=kind)
        self.valid = np.flatnonzero(at <= (first[1:] - width)[self.doc]).astype(kind)  # where windows start
        self.alone = np.full(n + 1, _far(kind), kind)  # least end of a range that starts here and occurs once
        now = _Symbols(self.names[0][self.which], at, at + 1, self.doc, np.ones(n, bool))
        del at
        for r in range(ROUNDS):
            now = now.collapsed(4 * r + 1).paired(4 * r + 2)
            if r not in COUNTED:
                continue
            key, lo, hi, which = now.units(width, r == ROUNDS - 1)
            self.key, back, count = np.unique(key, return_inverse=True, return_counts=True)
            asked = COUNTED.index(r)
            if asked == len(answers):
                return
            once = ~((count > 1) | _answered(self.key, answers[asked], n_buckets))[back]
            now.live[which[once]] = False
            np.minimum.at(self.alone, lo[once], hi[once])
        ends = np.minimum.accumulate(self.alone[::-1])[::-1]
        self.starts = self.valid[ends[self.valid] > self.valid + width]

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Names of the distinct windows among the candidates, where each is first, and the
        starts that repeat one of them in this batch."""
        a, b = (_spans(x[self.which], self.width, _BASES[0])[self.starts] for x in self.names)
        order = np.lexsort((b, a))  # stable, and starts ascend: the smallest start comes first
        new = np.ones(len(a), bool)
        new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        first = order[new]
        return a[first], b[first], self.starts[first], self.starts[order[~new]]


def _bucket(key: np.ndarray, n_buckets: int) -> np.ndarray:
    return ((key >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)


def _by_bucket(key: np.ndarray, n_buckets: int):
    """Slices of ascending ``key`` for each bucket that has any."""
    b = _bucket(key, n_buckets)
    cut = np.flatnonzero(np.diff(b, prepend=-1))
    for lo, hi in zip(cut, [*cut[1:], len(b)]):
        yield int(b[lo]), slice(int(lo), int(hi))


def _answered(key: np.ndarray, answers: dict[int, bytes], n_buckets: int) -> np.ndarray:
    out = np.zeros(len(key), bool)
    for b, s in _by_bucket(key, n_buckets):
        if b in answers:
            out[s] = np.unpackbits(np.frombuffer(answers[b], np.uint8), count=s.stop - s.start).astype(bool)
    return out


# --- rounds between batches ---------------------------------------------------------


def _rows(names: list[str], types: list, rows: list[tuple]) -> pa.RecordBatch:
    cols = zip(*rows) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names)


def _told(row: pa.RecordBatch, done: int) -> list[dict[int, bytes]]:
    """Answers of the rounds so far to the one batch of a row, by round and bucket."""
    return [{x["bucket"]: x["bits"] for x in row.column(f"known_{r}")[0].as_py() or ()} for r in range(done)]


def _each(batches):
    """Rows of Arrow batches one at a time: a row is a batch of documents."""
    for part in parts(batches):
        for k in range(part.num_rows):
            yield part.slice(k, 1)


def _send_symbols(width: int, n_buckets: int, done: int):
    def send(batches):
        for row in _each(batches):
            k = row.column("batch")[0].as_py()
            key = _Batch(row.column("blob")[0].as_buffer(), width, _told(row, done), n_buckets).key
            low = key.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
            yield _rows(["bucket", "batch", "names"], [pa.int64(), pa.int64(), pa.binary()], [(b, k, low[s].tobytes()) for b, s in _by_bucket(key, n_buckets)])

    return send


def _answer(bits: np.ndarray, sizes: list[int], batch: pa.ChunkedArray, bucket: int) -> pa.Table:
    ends = np.cumsum(sizes)
    out = [np.packbits(bits[e - s : e]).tobytes() for e, s in zip(ends, sizes)]
    return pa.table({"batch": batch, "bucket": pa.array([bucket] * len(out), pa.int64()), "bits": pa.array(out, pa.binary())})


def _shared(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
    """A bit for each name sent to this bucket: whether another batch sent it too."""
    sent = [np.frombuffer(x.as_buffer(), np.uint8).reshape(-1, 6) for x in t["names"]]
    sizes = [len(p) for p in sent]
    wide = np.zeros((sum(sizes), 8), np.uint8)
    np.concatenate(sent, out=wide[:, :6])
    _, back, count = np.unique(wide.view("<u8").ravel(), return_inverse=True, return_counts=True)
    return _answer(count[back] > 1, sizes, t["batch"], key[0].as_py())


def _packed_starts(starts: np.ndarray) -> bytes:
    """Distinct starts as compressed distances: those of a repeat follow one another."""
    return zstandard.ZstdCompressor(level=1).compress(np.diff(np.sort(starts), prepend=starts.dtype.type(0)).astype("<u4").tobytes())


def _unpacked_starts(blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), "<u4").cumsum(dtype=np.int64)


def _send_windows(width: int, n_buckets: int):
    names = ["bucket", "batch", "a", "b", "doc", "tie", "which", "start"]

    def send(batches):
        for row in _each(batches):
            k = row.column("batch")[0].as_py()
            own = _Batch(row.column("blob")[0].as_buffer(), width, _told(row, len(COUNTED)), n_buckets)
            a, b, first, again = own.windows()
            ids, ties = np.array([_NONE if i is None else i for i in own.ids], np.int64), np.array([_tie(t) for t in own.texts], np.int64)
            doc, start = own.doc[first], first.astype("<u4")
            del own
            rows = []
            for x, s in _by_bucket(a, n_buckets):
                some, which = np.unique(doc[s], return_inverse=True)  # documents once a message: a batch has 2^16 at most
                rows.append((x, k, a[s].tobytes(), b[s].tobytes(), ids[some].tobytes(), ties[some].tobytes(), which.astype("<u2").tobytes(), start[s].tobytes()))
            rows.append((k % n_buckets, k, b"", b"", b"", b"", b"", _packed_starts(again)))  # repeats it has in itself, known already
            yield _rows(names, [pa.int64(), pa.int64(), *[pa.binary()] * 6], rows)

    return send


def _later(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
    """(batch, starts): the windows sent to this bucket that another batch has earlier, and
    the starts that came without windows as they came."""
    read = lambda c, kind: [np.frombuffer(x.as_buffer(), kind) for x in t[c]]
    sent = read("a", "<u8")
    sizes = [len(p) for p in sent]
    a, b, which = np.concatenate(sent), np.concatenate(read("b", "<u8")), read("which", "<u2")
    doc, tie = (np.concatenate([d[w] for d, w in zip(read(c, "<i8"), which)]) for c in ("doc", "tie"))
    batch = np.repeat(t["batch"].to_numpy(), sizes)
    order = np.lexsort((batch, tie, doc, b, a))
    later = np.zeros(len(a), bool)
    later[order[1:]] = (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])
    ends = np.cumsum(sizes)
    out = [_packed_starts(np.frombuffer(x.as_buffer(), "<u4")[later[e - n : e]]) if n else x.as_py() for x, e, n in zip(t["start"], ends, sizes)]
    return pa.table({"batch": t["batch"], "bucket": pa.array([key[0].as_py()] * len(out), pa.int64()), "bits": pa.array(out, pa.binary())})


def _keep(width: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary())])

    def keep(batches):
        for row in _each(batches):
            ids, texts = _unpacked(row.column("blob")[0].as_buffer())
            split = [t.split() for t in texts]
            first = np.cumsum([0, *map(len, split)])
            cover = np.zeros(int(first[-1]) + 1, np.int32)
            for x in row.column("known_0")[0].as_py() or ():
                starts = _unpacked_starts(x["bits"])
                cover[starts] += 1  # a start is named once in all answers
                cover[starts + width] -= 1
            gone = cover.cumsum()[:-1] > 0
            out = []
            for i, words, lo, hi in zip(ids, split, first, first[1:]):
                n = int(gone[lo:hi].sum())
                if n:
                    words = [words[j] for j in np.flatnonzero(~gone[lo:hi])]
                out.append((i, int(hi - lo), n, b" ".join(words)))
            yield _rows(schema.names, schema.types, out)

    return keep


def _free(spark) -> None:
    """Let shuffle files of finished rounds go."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def without_repeats(docs: DataFrame, width: int = 20) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for every row: ``kept`` is the words left.

    A word goes if some window of ``width`` words over it also starts earlier, by
    (doc_id, start), in the input as it is. Null texts have no words, an empty table has
    no rows, and a text of any length is one task's, a batch to itself. A null doc_id
    comes after all others. Rows that repeat a doc_id count as documents of their own, in
    the order of a digest of their texts, so reruns agree however the rows are split.
    Other columns of ``docs`` are not read.
    """
    if width < 2:
        raise ValueError("a window has two words or more")
    spark = docs.sparkSession
    text = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    packs = settle(text.mapInArrow(_pack, "batch long, n_bytes long, blob binary"), "packs")
    n_bytes = packs.agg(F.sum("n_bytes")).first()[0] or 0
    n_buckets = max(LEAST_BUCKETS, -(-n_bytes // BUCKET))
    blobs = packs.select("batch", "blob")

    n_files = max(1, -(-n_bytes // ANSWERS))

    def known(answers: list[DataFrame]) -> DataFrame:
        out = blobs
        for r, told in enumerate(answers):
            out = out.join(told.withColumnRenamed("known", f"known_{r}"), "batch", "left")
        return out

    def told(sent: DataFrame, answer, r: int) -> DataFrame:
        rows = sent.groupBy("bucket").applyInArrow(answer, "batch long, bucket long, bits binary").repartition(n_files, "batch")
        out = settle(rows.groupBy("batch").agg(F.collect_list(F.struct("bucket", "bits")).alias("known")), f"round-{r}")
        _free(spark)
        return out

    answers: list[DataFrame] = []
    for r in range(len(COUNTED)):
        sent = known(answers).mapInArrow(_send_symbols(width, n_buckets, r), "bucket long, batch long, names binary")
        answers.append(told(sent, _shared, r))
    sent = known(answers).mapInArrow(_send_windows(width, n_buckets), "bucket long, batch long, a binary, b binary, doc binary, tie binary, which binary, start binary")
    rows = known([told(sent, _later, len(COUNTED))]).mapInArrow(_keep(width), "doc_id long, n_words long, n_removed long, kept binary")
    return rows.withColumn("kept", F.col("kept").cast("string"))
