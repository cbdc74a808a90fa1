"""Toxicity by compression distance with zstandard dictionaries.

A dictionary each is trained on toxic and on ordinary text. Both begin with what the
zstandard trainer finds in texts of both classes, so that common prose costs the same
with either. Then come the strings that a class has far more often than the other, by
a likelihood ratio over occurrences, chained where they overlap. A text is cut into
windows, and each is compressed with both; the bytes that one dictionary saves over the
other are the evidence. Largest, summed and mean savings go through a logistic curve
whose threshold is calibrated on texts that the dictionaries in use there have not seen.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts

#: Bounds of the labelled sample that is learned from: texts of each class, bytes of one.
TOXIC_SAMPLE, ORDINARY_SAMPLE, SAMPLE_BYTES = 1500, 4500, 64 << 10
#: Bytes of the strings compared; a shorter match saves nothing.
GRAM = 5
WINDOW, OVERLAP = 256, 16
#: A string is telling from this likelihood ratio (G²), ratio of rates, and number of texts on.
TELLING, RATIO, TEXTS = 20.0, {"toxic": 6.0, "ordinary": 1.5}, 4
#: Occurrences that one text counts for, bytes of what both have in common, and of a piece of it.
REPEATS, COMMON, PIECE = 4, 256, 512
CUT = 0.7
#: Share of unseen ordinary texts that the threshold may flag.
FALSE_ALARMS = 0.005
_BIG = np.uint64(8)


def _plain(text: bytes) -> bytes:
    return b" " + b" ".join(text.lower().split()) + b" "


def _grams(data: bytes) -> np.ndarray:
    """Strings of ``GRAM`` bytes within words, a space before or after included."""
    raw = np.frombuffer(_plain(data), np.uint8)
    n = len(raw) - GRAM + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out, space = np.zeros(n, np.uint64), np.zeros(n, bool)
    for k in range(GRAM):
        part = raw[k : k + n]
        out = out << _BIG | part.astype(np.uint64)
        if 0 < k < GRAM - 1:
            space |= part == 0x20
    return out[~space]


def _kin(data: bytes) -> list[int]:
    """Marks that near copies share: the least hashes of runs of three words."""
    w = data.split()
    return sorted({zlib.crc32(b" ".join(x)) for x in zip(w, w[1:], w[2:])} or {zlib.crc32(b" ".join(w))})[:2]


def _counted(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Strings, how often they occur (a text counts a few times at most), and in how many
    texts, merged a few hundred texts at a time."""
    keys, counts = np.zeros(0, np.uint64), np.zeros((0, 2), np.int64)
    for k in range(0, len(texts), 400):
        found = [np.unique(_grams(t), return_counts=True) for t in texts[k : k + 400]]
        more, back = np.unique(np.concatenate([u for u, _ in found]), return_inverse=True)
        times = np.minimum(np.concatenate([c for _, c in found]), REPEATS)
        both = np.union1d(keys, more)
        total = np.zeros((len(both), 2), np.int64)
        total[np.searchsorted(both, keys)] = counts
        total[np.searchsorted(both, more)] += np.column_stack([np.bincount(back, times, len(more)), np.bincount(back, minlength=len(more))]).astype(np.int64)
        keys, counts = both, total
    return keys, counts[:, 0], counts[:, 1]


def _chains(grams: list[bytes]) -> list[bytes]:
    """Strings that overlap in all but one byte, put together."""
    left, follow = dict.fromkeys(grams), {}
    for g in grams:
        follow.setdefault(g[:-1], []).append(g)
    ends = {g[1:] for g in grams}
    out = []
    for g in (*(g for g in grams if g[:-1] not in ends), *grams):
        if g not in left:
            continue
        del left[g]
        chain = g
        while more := next((x for x in follow.get(chain[1 - GRAM :], ()) if x in left), None):
            del left[more]
            chain += more[-1:]
        out.append(chain)
    return out


def common(texts: list[bytes]) -> bytes:
    """What the zstandard trainer finds in texts of both classes; nothing if too few."""
    plain = [_plain(t) for t in texts]
    pieces = [t[k : k + PIECE] for t in plain for k in range(0, min(len(t), 8 * PIECE), PIECE)]
    try:
        return zstandard.train_dictionary(COMMON, pieces).as_bytes()
    except zstandard.ZstdError:
        return b""


def dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes]:
    """Contents for the two classes, equally long, the most telling strings last."""
    (ka, ca, ta), (kb, cb, tb) = _counted(toxic), _counted(ordinary)
    keys = np.union1d(ka, kb)
    a, b, own_a, own_b = (np.zeros(len(keys)) for _ in range(4))
    at_a, at_b = np.searchsorted(keys, ka), np.searchsorted(keys, kb)
    a[at_a], own_a[at_a], b[at_b], own_b[at_b] = ca, ta, cb, tb
    n, m = max(1, ca.sum()), max(1, cb.sum())

    def part(x, whole, share):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(x > 0, x * np.log(x / (whole * share / (n + m))), 0)

    g2 = 2 * (part(a, a + b, n) + part(b, a + b, m))
    rates = (a + 0.5) / n, (b + 0.5) / m

    def telling(mine, other, own, ratio):
        found = np.flatnonzero((g2 >= TELLING) & (mine >= ratio * other) & (own >= TEXTS))
        found = found[np.argsort(-g2[found], kind="stable")]
        return b"\0".join(reversed(_chains([int(keys[k]).to_bytes(8, "big")[-GRAM:] for k in found])))

    shared = common(toxic + ordinary)
    one, two = telling(*rates, own_a, RATIO["toxic"]), telling(*rates[::-1], own_b, RATIO["ordinary"])
    size = max(len(one), len(two), 16)
    return shared + one.rjust(size + 1, b"\0"), shared + two.rjust(size + 1, b"\0")


class Comparer:
    """Savings of the toxic dictionary over the ordinary one, window by window."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        # literals stay as they are, so that a short match is worth what it covers
        how = zstandard.ZstdCompressionParameters(
            window_log=17, hash_log=15, chain_log=15, search_log=4, min_match=GRAM, target_length=1, strategy=zstandard.STRATEGY_FAST, write_content_size=False
        )
        raw = zstandard.DICT_TYPE_RAWCONTENT
        made = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=raw), compression_params=how) for d in (toxic, ordinary)]
        self.toxic, self.ordinary = (c.compress for c in made)

    def evidence(self, text: bytes) -> tuple[float, float, float, float]:
        """(largest saving of a window, sum of savings, their mean over windows, sum of what
        the ordinary dictionary saves) of a whole text."""
        text = _plain(text)
        toxic, ordinary, most, total, against, n = self.toxic, self.ordinary, 0, 0, 0, 0
        for k in range(0, len(text), WINDOW):
            part = text[k : k + WINDOW + OVERLAP]
            saved = len(ordinary(part)) - len(toxic(part))
            n += 1
            if saved > 1:
                most, total = max(most, saved), total + saved
            elif saved < -1:
                against -= saved
        return float(most), float(total), total / n, float(against)


def _features(found: np.ndarray) -> np.ndarray:
    most, total, mean, against = found.T
    return np.column_stack([np.ones(len(found)), np.minimum(most, 12) / 4, np.log1p(total), mean, -np.log1p(against)])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]

    def scores(self, found: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_features(found) @ np.array(self.weights), -30, 30)))


def _threshold(z: np.ndarray, y: np.ndarray, none: float) -> float:
    """The middle of the gap at which F1 is largest among those that flag few enough of
    the ordinary texts, always above ``none``, where a text without evidence stands."""
    order = np.argsort(-z, kind="stable")
    hit, z = np.cumsum(y[order]), z[order]
    wrong = np.arange(1, len(y) + 1) - hit
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    ends = np.flatnonzero(np.append(z[1:] != z[:-1], True))
    ends = ends[(z[ends] > none + 1e-9) & (wrong[ends] <= FALSE_ALARMS * (len(y) - y.sum()))]
    if not len(ends):
        return max(none + 1, float(z[0]) if len(z) else none)
    best = ends[int(np.argmax(f1[ends]))]
    return float((z[best] + max(none, z[best + 1] if best + 1 < len(z) else none)) / 2)


def train(toxic: list[bytes], ordinary: list[bytes]) -> Model:
    """A model of two samples; of near copies within them, one counts. A sample without
    one of the classes gives a constant score, that class's absence."""
    kept: list[list[bytes]] = []
    seen: set[int] = set()
    for texts in (toxic, ordinary):
        own = []
        for t in sorted(texts, key=lambda t: (zlib.crc32(t), t)):
            marks = _kin(t := t.lower())
            if not seen.intersection(marks):
                own.append(t)
            seen.update(marks)
        kept.append(own)
    toxic, ordinary = kept
    if len(toxic) < 2 or len(ordinary) < 2:
        return Model(b"", b"", (-30.0 if not toxic else 30.0 if not ordinary else -2.0, 0.0, 0.0, 0.0, 0.0))
    found, y = [], []
    for half in (0, 1):  # each half judged by dictionaries of the other
        learn = Comparer(*dictionaries(toxic[half::2], ordinary[half::2]))
        held = [(t, 1.0) for t in toxic[1 - half :: 2]] + [(t, 0.0) for t in ordinary[1 - half :: 2]]
        found += [learn.evidence(t) for t, _ in held]
        y += [k for _, k in held]
    x, y = _features(np.array(found)), np.array(y)
    w = _logistic(x, y)
    w[1:] = np.maximum(w[1:], 1e-3)  # more evidence never lowers a score
    w[0] += np.log(CUT / (1 - CUT)) - _threshold(x @ w, y, float(w[0]))
    return Model(*dictionaries(toxic, ordinary), tuple(map(float, w)))


def sample(docs: DataFrame, labels: DataFrame) -> tuple[list[bytes], list[bytes]]:
    """Labelled texts to learn from: of each class those with the smallest hashes of
    their ids, up to the bounds above. Labels that differ for a document count as toxic."""
    one = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.max(F.col("toxic").cast("int")).alias("label"))
    order = F.xxhash64("label_id"), F.col("label_id")
    picked = one.filter("label = 1").orderBy(*order).limit(TOXIC_SAMPLE).unionAll(one.filter("label = 0").orderBy(*order).limit(ORDINARY_SAMPLE))
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.cast("binary").alias("text")).filter((F.octet_length(text) <= SAMPLE_BYTES) & (F.octet_length(text) > 0))
    # at most TOXIC_SAMPLE + ORDINARY_SAMPLE ids are broadcast
    got = rows.join(F.broadcast(picked), F.col("doc_id") == F.col("label_id")).groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label")).select("text", "label").toArrow()
    texts, y = got.column("text").to_pylist(), got.column("label").to_pylist()
    return [bytes(t) for t in compress(texts, y)], [bytes(t) for t, k in zip(texts, y) if not k]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted, evidence) for every row, of the whole text alone.

    Null texts count as empty; an empty text, or one without evidence, has the lowest
    score. A text of any length goes through window by window. Rows that repeat, or have
    a null doc_id, get a row each; an empty table has none; other columns of ``docs`` are
    not read."""

    def run(batches):
        own = Comparer(model.toxic, model.ordinary) if model.toxic else None
        for batch in batches:
            texts = pc.cast(batch.column(1), pa.binary())
            found = np.array([own.evidence(t.as_py()) if own else (0.0,) * 4 for t in texts]).reshape(-1, 4)
            s = model.scores(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= CUT).astype(np.int32)), pa.array(found[:, 1])], ["doc_id", "score", "predicted", "evidence"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).mapInArrow(run, "doc_id long, score double, predicted int, evidence double")


def keep(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose own text is not predicted toxic, columns as they are,
    whatever their names; null and empty texts stay."""
    schema = docs.schema
    place = [f.name for f in schema].index("text")

    def run(batches):
        own = Comparer(model.toxic, model.ordinary) if model.toxic else None

        def kept(part):
            texts = pc.cast(part.column(place), pa.binary())
            found = np.array([own.evidence(t.as_py() or b"") if own else (0.0,) * 4 for t in texts]).reshape(-1, 4)
            return part.filter(pa.array(model.scores(found) < CUT))

        yield from map(kept, parts(batches))

    return docs.mapInArrow(run, schema)
