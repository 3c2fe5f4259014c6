"""Reads made in Arrow batches are those that Catalyst derives."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from porelane import made, queries, synth


@pytest.mark.parametrize("size", [0, 1, 17, 55])
def test_digests(size):
    rows = np.random.default_rng(size).integers(0, 256, (9, size), np.uint8)
    assert [d.tobytes() for d in made.md5s(rows, 4)] == [hashlib.md5(r.tobytes()).digest() for r in rows]


@pytest.mark.parametrize("name", ["planted_reads", "noisy_reads"])
@pytest.mark.parametrize("keys", [[*range(300), 999, 1000, 123456789, 10**15 + 7, None], []])
def test_made_reads_equal_derived_ones(spark, name, keys):
    orders = spark.createDataFrame([(k,) for k in keys], "o_orderkey long").repartition(3)
    got, want = getattr(made, name)(orders).frame(), getattr(synth, name)(orders)
    assert set(got.columns) == set(want.columns)
    order = lambda df: sorted(map(str, df.select(*made.ALL).collect()))
    assert order(got) == order(want) and len(order(got)) == len(keys)


def test_only_keys_travel_to_annotation(spark, tmp_path):
    spark.range(50).select(F.col("id").alias("o_orderkey")).write.parquet(f"{tmp_path}/orders.parquet")
    for name in ("exact_planted_demux", "planted_slices", "demux_rapid", "residual_exact", "annotate_table", "kit_right_tags", "residual_adapter_qc"):
        plan = queries.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
        below = plan[plan.rindex("MapInArrow") :]
        assert "md5" not in below and "translate" not in below, name
    # what isn't asked for doesn't come back
    plan = queries.annotate_table(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "seq#" not in plan
