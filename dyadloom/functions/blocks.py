"""Robust means by group for many labellings of the same cells at once.

A gene's stored values do not change when labels are dealt anew, so they are sorted
once, by a range partitioning over (gene, value), and cut into blocks. A replicate's
label is a function of the cell's id and of a few cut points, so no table of labels is
joined or moved. Every mean here weighs values by their rank within gene and group:
blocks first count their members by label, a prefix sum by gene says where each block
begins in every group, and then each block adds the values whose ranks weigh anything.
No task holds more of a gene than a block, whatever the number of cells.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..durable import written

#: Values in a block, and stored values for each task of the range partitioning.
BLOCK = 8192
PART = 1 << 17
#: Hashes that share a histogram bin when cut points are sought, about.
BIN = 512
#: Fixed odd constants of the hash, which the SQL of the registered queries repeats.
STEP, TIMES = 0x9E3779B97F4A7C15, 0x1F58476D1CE4E5B9
_U = np.uint64


def identity(cell: Column) -> Column:
    """60 bits of a cell's id."""
    return F.conv(F.substring(F.md5(cell.cast("string")), 1, 15), 16, 10).cast("long")


def hashes(ids: np.ndarray, nboot: int) -> np.ndarray:
    """A 64-bit hash of each id in each replicate 1..nboot, one row a replicate."""
    with np.errstate(over="ignore"):
        x = ids.astype(_U)[None, :] + np.arange(1, nboot + 1, dtype=_U)[:, None] * _U(STEP)
        for _ in range(2):
            x = (x ^ (x >> _U(32))) * _U(TIMES)
        return x ^ (x >> _U(32))


def cut_points(ids: DataFrame, sizes: list[int], nboot: int) -> np.ndarray:
    """[nboot, groups - 1]: the hash at which each further group begins, so that groups
    have ``sizes`` members in every replicate.

    ``ids`` is (x), one row a cell. Exact: a histogram says which bin of hashes holds a
    cut point, and only the members of those bins are put in order. The driver receives
    replicates times groups numbers."""
    n, ends = sum(sizes), np.cumsum(sizes)[:-1]
    if not nboot or not len(ends):
        return np.zeros((nboot, len(ends)), _U)
    shift = _U(64 - max(1, (n // BIN).bit_length()))

    def count(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            h = hashes(batch.column(0).to_numpy(), nboot) >> shift
            for b in range(nboot):
                bins, many = np.unique(h[b], return_counts=True)
                if b not in total:
                    total[b] = np.zeros(1 << int(_U(64) - shift), np.int64)
                total[b][bins.astype(np.int64)] += many
        for b, t in total.items():
            at = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), b)), pa.array(at), pa.array(t[at])], ["b", "bin", "n"])

    bins = ids.mapInArrow(count, "b long, bin long, n long").groupBy("b", "bin").agg(F.sum("n").alias("n"))
    bins = bins.withColumn("upto", F.sum("n").over(Window.partitionBy("b").orderBy("bin")))
    cut = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(int(e)).cast("long").alias("rank")) for k, e in enumerate(ends)))).alias("cut")
    # the cut point of k is the hash of the cell with that many before it
    held = bins.select("*", cut).filter((F.col("cut.rank") >= F.col("upto") - F.col("n")) & (F.col("cut.rank") < F.col("upto")))
    wanted = [(r.b, r.bin, r.k, r.rank) for r in held.select("b", "bin", "cut.k", (F.col("cut.rank") - F.col("upto") + F.col("n")).alias("rank")).collect()]
    by_b: dict[int, np.ndarray] = {}
    for b in {w[0] for w in wanted}:
        by_b[b] = np.unique(np.array([w[1] for w in wanted if w[0] == b], _U))

    def members(batches):
        for batch in batches:
            h = hashes(batch.column(0).to_numpy(), nboot)
            for b, some in by_b.items():
                own = h[b][np.isin(h[b] >> shift, some)]
                if len(own):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), b)), pa.array((own >> shift).astype(np.int64)), pa.array((own ^ _U(1 << 63)).view(np.int64))], ["b", "bin", "h"])

    def pick(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        b, at = key[0].as_py(), key[1].as_py()
        h = np.sort(t["h"].to_numpy())
        own = [(k, rank) for x, y, k, rank in wanted if (x, y) == (b, at)]
        return pa.table({"b": pa.array([b] * len(own), pa.int64()), "k": pa.array([k for k, _ in own], pa.int64()), "h": pa.array([int(h[r]) for _, r in own], pa.int64())})

    out = np.zeros((nboot, len(ends)), _U)
    for r in ids.mapInArrow(members, "b long, bin long, h long").groupBy("b", "bin").applyInArrow(pick, "b long, k long, h long").collect():
        out[r.b, r.k] = np.int64(r.h).view(_U) ^ _U(1 << 63)
    return out


@dataclass(frozen=True)
class Rule:
    """Which ranks weigh what in a group of ``n`` cells."""

    kind: str
    trim: float

    def weigh(self, values: np.ndarray, starts: np.ndarray, counts: np.ndarray, before: np.ndarray, n: np.ndarray) -> np.ndarray:
        """What the block's values add to each group's mean. ``values`` are ascending by
        group; ``before`` counts members of lower rank, implicit zeros included (-1: the
        group has too few stored values to count)."""
        if self.kind in ("mean", "thresholdedMean"):
            lo, hi = np.zeros_like(counts), np.where(before < 0, 0, counts)
        elif self.kind == "truncatedMean" and self.trim < 0.5:
            cut = np.floor(n * self.trim).astype(np.int64)
            lo, hi = np.clip(cut - before, 0, counts), np.clip(n - cut - before, 0, counts)
            n = n - 2 * cut
        else:
            out = np.zeros(len(n))
            for p, share in ((0.25, 0.25), (0.5, 0.5), (0.75, 0.25)) if self.kind == "triMean" else ((0.5, 1.0),):
                place = (n - 1) * p
                low = np.floor(place).astype(np.int64)
                for rank, weight in ((low, 1 - (place - low)), (low + 1, place - low)):
                    at = rank - before
                    own = (at >= 0) & (at < counts) & (weight > 0)
                    out[own] += share * weight[own] * values[starts[own] + at[own]]
            return out
        sums = np.concatenate([[0.0], np.cumsum(values)])
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(hi > lo, (sums[starts + hi] - sums[starts + lo]) / n, 0.0)


def _labelled(ids: np.ndarray, own: np.ndarray, cuts: np.ndarray, dealt: np.ndarray | None):
    """Labels of a block, the observed ones first and then a row a replicate."""
    yield own.astype(np.int64)
    if dealt is not None:
        yield from dealt.T.astype(np.int64)
    elif len(cuts):
        for h, cut in zip(hashes(ids, len(cuts)), cuts):
            yield np.searchsorted(cut, h, side="right")


def block_means(expr: DataFrame, labels: DataFrame, sizes: list[int], kind: str, trim: float, cuts: np.ndarray | None = None, dealt: int = 0) -> DataFrame:
    """(gene, means): float64 [1 + replicates, groups] as bytes, for every gene with a
    stored value; the first row has the observed groups.

    ``labels`` is (cell, x, own) with ``own`` the number of the group, and (dealt), its
    numbers in ``dealt`` replicates as uint16 bytes, where those do not follow ``cuts``."""
    cuts = np.zeros((0, max(0, len(sizes) - 1)), _U) if cuts is None else cuts
    n, groups = np.array(sizes, np.int64), len(sizes)
    rows, rule = 1 + (dealt or len(cuts)), Rule(kind, trim)
    width = rows * groups
    extra = ["dealt"] if dealt else []
    stored = expr.filter("value <> 0").join(labels, "cell").select("gene", "value", "x", "own", *extra)
    stored = written(stored, "stored")
    parts = max(min(expr.sparkSession.sparkContext.defaultParallelism, -(-stored.count() // BLOCK)), -(-stored.count() // PART), 1)
    ordered = stored.repartitionByRange(parts, "gene", "value", "x").sortWithinPartitions("gene", "value", "x")

    def cut(batches):
        from pyspark import TaskContext

        part, seq, gene, held, size = TaskContext.get().partitionId(), 0, None, [], 0

        def block():
            cols = [b"".join(h[k] for h in held) for k in range(3 + len(extra))]
            return pa.RecordBatch.from_arrays([pa.array([gene]), pa.array([part << 32 | seq]), *(pa.array([c], pa.binary()) for c in cols)], ["gene", "block", "values", "ids", "own", *extra])

        for batch in batches:
            names = batch.column(0).to_pylist()
            value, x, own = batch.column(1).to_numpy(), batch.column(2).to_numpy(), batch.column(3).to_numpy()
            more = batch.column(4).to_pylist() if extra else []
            name = np.array(names, object)
            ends = [*(np.flatnonzero(name[1:] != name[:-1]) + 1), len(names)]
            lo = 0
            while lo < len(names):
                if names[lo] != gene or size >= BLOCK:
                    if held:
                        yield block()
                        seq, held, size = seq + 1, [], 0
                    gene = names[lo]
                hi = min(ends[np.searchsorted(ends, lo, side="right")], lo + BLOCK - size)
                held.append((value[lo:hi].astype("<f8").tobytes(), x[lo:hi].astype("<i8").tobytes(), own[lo:hi].astype("<u2").tobytes(), *([b"".join(more[lo:hi])] if extra else [])))
                size += hi - lo
                lo = hi
        if held:
            yield block()

    binary = ", ".join(f"{c} binary" for c in ("values", "ids", "own", *extra))
    blocks = written(ordered.mapInArrow(cut, f"gene string, block long, {binary}"), "blocks")

    def parsed(batch):
        for i in range(batch.num_rows):
            get = lambda c: batch.column(batch.schema.get_field_index(c))[i].as_py()  # noqa: E731, B023
            value, ids, own = np.frombuffer(get("values"), "<f8"), np.frombuffer(get("ids"), "<i8"), np.frombuffer(get("own"), "<u2")
            table = np.frombuffer(get("dealt"), "<u2").reshape(len(own), dealt) if extra else None
            yield get("gene"), get("block"), value, _labelled(ids, own, cuts, table), get

    def count(batches):
        for batch in batches:
            out = [(g, b, np.concatenate([np.bincount(x, minlength=groups) for x in labelled]).astype("<i8").tobytes()) for g, b, _, labelled, _ in parsed(batch)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.binary()))], ["gene", "block", "counts"])

    def offsets(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        order = np.argsort(t["block"].to_numpy(), kind="stable")
        counts = np.array([np.frombuffer(t["counts"][int(k)].as_py(), "<i8") for k in order]).reshape(len(order), rows, groups)
        zeros = n[None, :] - counts.sum(axis=0)
        before = np.cumsum(counts, axis=0) - counts + zeros[None]
        if kind == "thresholdedMean":
            before = np.where((n - zeros) / n < trim, -1, before)
        return pa.table({"gene": [key[0].as_py()] * len(order), "block": t["block"].take(pa.array(order)), "before": pa.array([b.tobytes() for b in before], pa.binary())})

    places = blocks.mapInArrow(count, "gene string, block long, counts binary").groupBy("gene").applyInArrow(offsets, "gene string, block long, before binary")

    def add(batches):
        for batch in batches:
            out = []
            for g, _, value, labelled, get in parsed(batch):
                before = np.frombuffer(get("before"), "<i8").reshape(rows, groups)
                total = np.empty((rows, groups))
                for k, label in enumerate(labelled):
                    counts = np.bincount(label, minlength=groups)
                    total[k] = rule.weigh(value[np.argsort(label.astype(np.uint16), kind="stable")], np.cumsum(counts) - counts, counts, before[k], n)
                out.append((g, total.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in out], pa.string()), pa.array([m for _, m in out], pa.binary())], ["gene", "means"])

    sums = blocks.join(places, ["gene", "block"]).mapInArrow(add, "gene string, means binary")

    def total_of(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        total = np.zeros(width)
        for part in t["means"]:
            total += np.frombuffer(part.as_py(), "<f8")
        return pa.table({"gene": [key[0].as_py()], "means": pa.array([total.tobytes()], pa.binary())})

    return sums.groupBy("gene").applyInArrow(total_of, "gene string, means binary")
