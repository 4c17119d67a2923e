"""The registered queries: names, columns, and a sample of results against DuckDB."""

import pathlib

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import compare

FOLDER = "/root/testdata/sf0.001"
SAMPLE = (
    "quality_levels", "temporal_jitter", "burst_error", "stitched_windows", "epoch_cut", "artifact_overlap", "latest_after_latency",
    "evidence_accumulation", "direction_reversals", "continuous_dwell", "episode_summary", "bursts_drawn", "score_blocks", "report_kappa_lines",
)

pytestmark = pytest.mark.skipif(not pathlib.Path(FOLDER).exists(), reason="needs the test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in pathlib.Path(FOLDER).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 130


@pytest.mark.parametrize("name", SAMPLE)
def test_result_equals_the_sql(spark, con, name):
    got = entry.queries()[name](spark, FOLDER).toPandas()
    assert compare(name, got, con.execute(entry.oracle_sql()[name]).df()) == ""


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["quality_levels", "bursts_drawn", "resampled_subjects", "inner_folds"])
def test_results_do_not_depend_on_partitioning(spark, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        out = []
        for n in ("3", "11"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            out.append(sorted(map(str, entry.queries()[name](spark, FOLDER).collect())))
        assert out[0] == out[1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
