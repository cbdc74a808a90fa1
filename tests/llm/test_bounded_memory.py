"""What a Python worker holds follows neither the bytes of an Arrow batch nor the pairs of a cell."""

import tracemalloc
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from dyadloom.llm import common, similar, simhash, substring, toxicity


def _peak(work):
    tracemalloc.start()
    try:
        return work(), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


@pytest.fixture(scope="module")
def batch():
    rng = np.random.default_rng(1)
    texts = [" ".join(map(str, rng.integers(0, 1 << 40, 1000))) for _ in range(1200)]
    texts[5], texts[7] = None, " ".join(map(str, range(500_000)))  # one longer than a part
    return pa.RecordBatch.from_arrays([pa.array(range(1200), pa.int64()), pa.array(texts), pa.array([b"0"] * 1200)], ["doc_id", "text", "tx"])


def test_parts_are_all_rows_in_order(batch):
    got = list(common.parts([batch, batch.slice(0, 0), batch.slice(3, 9)]))
    assert pa.Table.from_batches(got).equals(pa.Table.from_batches([batch, batch.slice(3, 9)]))
    assert all(p.nbytes <= common.PART or p.num_rows == 1 for p in got)
    assert len(got) < 30


def test_shingles_of_a_part_at_a_time(batch):
    out, peak = _peak(lambda: [(b.column("doc_id").to_pylist(), b.nbytes) for b in similar._marks(5, 0.8)([batch])])
    assert [i for ids, _ in out for i in ids] == list(range(1200)) and len(out) > 5
    usual = batch.slice(8)
    assert _peak(lambda: sum(b.num_rows for b in similar._marks(5, 0.8)([usual])))[1] < 12 < usual.nbytes / 1e6
    assert peak < 80  # the long text's own shingles


def test_clean_rows_leave_in_parts(batch):
    class Docs:
        schema = StructType([StructField("doc_id", LongType()), StructField("text", StringType())])
        mapInArrow = staticmethod(lambda run, schema: run)

    model = toxicity.Model(b"", b"", (-1.0,) + (0.0,) * (toxicity._features(np.zeros((1, 4))).shape[1] - 1))
    out = list(toxicity.keep(Docs, model)([batch.select(["doc_id", "text"])]))
    assert all(p.nbytes <= common.PART or p.num_rows == 1 for p in out)
    assert model.scores(np.zeros((1, 4)))[0] < toxicity.CUT
    assert [i for p in out for i in p.column(0).to_pylist()] == list(range(1200))


def test_walk_of_a_cell_holds_few_pairs():
    words = np.random.default_rng(2).integers(-(1 << 63), (1 << 63) - 1, (16_000, 2))
    rows = pd.DataFrame({"high": words[:, 0], "low": words[:, 1], "node": np.arange(len(words))})
    _, peak = _peak(lambda: simhash._window_forest(0, 2)((0, 0, 0), rows))
    assert peak < 50


def test_words_of_a_full_batch_of_texts():
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{k}" for k in np.minimum(rng.zipf(1.3, 1000), 50_000)).encode() for _ in range(660)]
    blob = substring._packed(list(enumerate(texts)))
    got, peak = _peak(lambda: substring._Batch(blob, 20, [{}] * len(substring.COUNTED), 64))
    assert len(got.doc) == 660_000 and got.ids == list(range(660))
    assert peak < 90


def test_a_round_of_few_bytes_writes_one_file(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        there = set(Path(common.shared_dir(spark)).glob("round-*"))
        text = [" ".join(f"w{k * k % 997}" for k in range(a, a + 300)) for a in range(0, 4000, 100)]
        docs = spark.createDataFrame(list(enumerate(text)), "doc_id long, text string").repartition(5)
        assert {r.n_words for r in substring.without_repeats(docs).collect()} == {300}
        rounds = set(Path(common.shared_dir(spark)).glob("round-*")) - there
        assert len(rounds) == len(substring.COUNTED) + 1
        assert [len(list(p.glob("part-*"))) for p in rounds] == [1] * len(rounds)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
