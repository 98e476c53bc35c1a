"""What a task of near_dedup holds at once."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from tests.llm.test_operators import documents
from tidemark.llm import near_dedup, scratch


def peak_mb(f):
    tracemalloc.start()
    try:
        out = f()
        return out, tracemalloc.get_traced_memory()[1] / 2**20
    finally:
        tracemalloc.stop()


def test_texts_are_summed_up_in_small_slices():
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(9000)}" for _ in range(350)) for _ in range(1000)]  # 2 MB
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(texts)], ["id", "text"])
    one = pa.RecordBatch.from_arrays([pa.array([0]), pa.array(["a b c d"])], ["id", "text"])
    list(near_dedup._summaries(3)([one]))  # tables that stay
    rows, mb = peak_mb(lambda: sum(len(b) for b in near_dedup._summaries(3)([batch])))
    assert rows == 1000 and mb < 25


def test_counts_of_blocks_of_large_sets_are_made_in_parts():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 2**63, 40_000).astype(np.uint64) * np.uint64(2)) for _ in range(50)]
    sets = [np.unique(np.concatenate([s, sets[0][:k]])) for k, s in enumerate(sets)]
    got, mb = peak_mb(lambda: near_dedup.shared(sets[:25], sets[25:]))
    assert got.tolist() == [[len(np.intersect1d(a, b, assume_unique=True)) for b in sets[25:]] for a in sets[:25]]
    assert mb < 60


def test_batches_of_texts_are_small(spark, monkeypatch):
    """Every job runs under the bound, which ends with the call."""
    key, seen, write = scratch.BATCH_BYTES, [], near_dedup.written

    def written(df):
        seen.append(spark.conf.get(key))
        return write(df)

    monkeypatch.setattr(near_dedup, "written", written)
    text = " ".join(f"w{i}" for i in range(40))
    docs = documents(spark, [(i, text + f" x{i // 2}") for i in range(6)])
    for before in (spark.conf.get(key), "33554432"):
        spark.conf.set(key, before)
        got = near_dedup.near_duplicates(docs, 85, 3).collect()
        assert {r["component_id"] for r in got} == {0} and len(got) == 6
        assert spark.conf.get(key) == before
    spark.conf.unset(key)
    assert seen and set(seen) == {str(near_dedup.BATCH)}


def test_a_batch_holds_few_texts(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    with scratch.small_batches(spark, 1 << 20):
        got = [r["n"] for r in spark.range(0, 3000, 1, 1).selectExpr("repeat('x', 2000) AS t").mapInArrow(sizes, "n long").collect()]
    assert sum(got) > 6_000_000 and max(got) < 1.2 * 2**20
