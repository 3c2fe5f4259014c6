"""Every registered query of the engine against its SQL in DuckDB, on small orders."""

import hashlib
import os

import duckdb
import pytest

import __spark_entry__ as entry
from porelane import oracles, queries


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    con = duckdb.connect()
    con.execute(f"COPY (SELECT i::BIGINT AS o_orderkey FROM range(600) t(i)) TO '{path}/orders.parquet' (FORMAT parquet)")
    return str(path)


def normal(rows):
    return sorted(str([None if x != x else x for x in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_equals_its_sql(spark, sf, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{sf}/orders.parquet'")
    want = con.execute(oracles.ORACLES[name])
    columns = [c[0] for c in want.description]
    got = entry.queries()[name](spark, sf)
    assert sorted(got.columns) == sorted(columns)
    assert normal(tuple(r) for r in got.select(columns).collect()) == normal(want.fetchall())


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(queries.QUERIES) - set(oracles.ORACLES) == {"demux_rapid", "demux_noisy_recall", "annotate_table", "residual_adapter_qc", "kit_right_tags"}


def test_planted_truth(spark, sf):
    got = {r["scenario"]: r for r in queries.demux_noisy_recall(spark, sf).collect()}
    assert got[0]["annotated"] == 0
    for s in (1, 2, 3, 4, 5):
        assert got[s]["right_label"] >= 0.95 * got[s]["reads"]
    # one adapter at the left is kept; two different barcodes at the right or in the middle are not
    assert got[1]["kept"] >= 0.95 * got[1]["reads"]
    assert got[4]["kept"] <= 0.05 * got[4]["reads"] and got[5]["kept"] <= 0.05 * got[5]["reads"]


def test_trimmed_reads_hold_no_adapter(spark, sf):
    got = queries.residual_adapter_qc(spark, sf).collect()
    assert sum(r["residual"] for r in got) <= 0.02 * sum(r["reads"] for r in got)


def test_flagship_counts(spark, sf):
    rows = queries.demux_rapid(spark, sf).collect()
    assert sum(r["reads"] for r in rows) >= 200 and all(r["bases"] % 10 == 0 for r in rows)


@pytest.mark.parametrize("name, scenarios", [("exact_planted_demux", (1, 2)), ("planted_slices", (1, 2, 3))])
def test_planted_slices_are_whole_and_of_all_scenarios(spark, sf, name, scenarios):
    reads = {r["read_id"]: r for r in queries.derive_reads_planted(spark, sf).collect()}
    got = {r["id"]: r for r in queries.QUERIES[name](spark, sf).collect()}
    # kept: one adapter at the left, cut or not, and with `maximize` two next to each other; the slice is what follows the last one
    assert set(got) == {i for i, r in reads.items() if r["scenario"] in scenarios}
    for i, r in got.items():
        seq, qual = (reads[i][c][-640:] for c in ("seq", "qual"))
        assert (r["bases"], r["seq_md5"], r["qual_md5"]) == (640, hashlib.md5(seq.encode()).hexdigest(), hashlib.md5(qual.encode()).hexdigest())
        assert r["label"] == reads[i]["label"] or reads[i]["scenario"] == 3


@pytest.mark.parametrize("name", ["failed_reads", "stage_counters", "trim_flip", "pull_reads"])
def test_reads_are_not_broadcast(spark, sf, name):
    plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("name, scans", [("label_variants", 1), ("trim_flip", 2), ("failed_reads", 2)])
def test_orders_are_read_once_a_side_and_dealt_over_all_cores(spark, sf, name, scans):
    plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == plan.count("RoundRobinPartitioning") == scans


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the driver's tables")
def test_entry(spark):
    assert entry.entry(spark).columns == ["label", "reads", "bases"]
