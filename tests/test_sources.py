import pyarrow as pa
import pyarrow.parquet as pq

from tests.conftest import day
from tidemark.functions.scratch import new_path, scratch_dir
from tidemark.jobs import queries
from tidemark.operators import quality
from tidemark.sources import market, tables
from tidemark.streaming.ingest import ingest_landing

SCHEMA = "date date, close double"


def land(path, name, rows):
    pq.write_table(pa.table({"date": pa.array([r[0] for r in rows], pa.date32()), "close": pa.array([r[1] for r in rows], pa.float64())}), f"{path}/{name}.parquet")


def test_landing_skips_files_without_columns(spark, tmp_path):
    land(tmp_path, "1101", [(day("2020-01-01"), 1.0)])
    land(tmp_path, "2202", [])
    pq.write_table(pa.table({}), f"{tmp_path}/3303.parquet")
    got = tables.merge_landing(spark, str(tmp_path), SCHEMA, "stock_id")
    assert [tuple(r) for r in got.collect()] == [(day("2020-01-01"), 1.0, "1101")]


def test_landing_of_nothing(spark, tmp_path):
    pq.write_table(pa.table({}), f"{tmp_path}/3303.parquet")
    assert tables.merge_landing(spark, str(tmp_path), SCHEMA).count() == 0


def test_ingest_reads_each_file_once(spark, tmp_path):
    landing, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    (tmp_path / "in").mkdir()
    for i in range(3):
        land(landing, f"f{i}", [(day("2020-01-01"), float(i))])
        ingest_landing(spark, landing, SCHEMA, out, check)
        assert sorted(r.close for r in spark.read.parquet(out).collect()) == [float(k) for k in range(i + 1)]


def test_optional_tables(spark, tmp_path):
    assert tables.read_table(spark, str(tmp_path / "none"), SCHEMA, optional=True) is None


def test_pending_and_sinks(spark, tmp_path):
    a = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    assert [r.k for r in tables.pending_keys(a, a.filter("k = 'b'"), "k", 1).collect()] == ["a"]
    df = spark.createDataFrame([(day("2020-05-01"), 1.0), (day("2021-05-01"), 2.0)], SCHEMA)
    tables.write_by_year(df, str(tmp_path / "y"))
    assert spark.read.parquet(str(tmp_path / "y")).filter("year = 2021").count() == 1
    tables.write_report(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["date", "close"]


def test_scratch_paths_are_new(spark):
    assert new_path(spark, "x") != new_path(spark, "x")
    assert new_path(spark, "x").startswith(scratch_dir(spark))


def test_overview_counts_duplicates(spark):
    df = spark.createDataFrame([("a", day("2020-01-01"), 1.0), ("a", day("2020-01-01"), None), ("b", day("2020-01-02"), 1.0)], "stock_id string, date date, v double")
    r = quality.table_overview(df).first()
    assert (r.n_rows, r.n_entities, r.n_duplicates, r.null_v) == (3, 2, 1, 1)


def test_agreement_of_constant_series_is_null(spark):
    df = spark.createDataFrame([(day("2020-01-01"), 1.0), (day("2020-02-01"), 1.0)], "ym date, ret double")
    assert quality.agreement(df, df).first().correlation is None


def test_long_supplier_ids_stay_apart(spark, tmp_path):
    base = "/root/testdata/sf0.001"
    keys = [1, 12, 123, 1000, 10000, 10001, 100002]
    s = spark.read.parquet(f"{base}/supplier.parquet").limit(1).drop("s_suppkey", "s_nationkey").crossJoin(spark.createDataFrame([(k, 0) for k in keys], "s_suppkey long, s_nationkey int"))
    s.write.parquet(f"{tmp_path}/supplier.parquet")
    for name in ("nation", "region"):
        spark.read.parquet(f"{base}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    want = {"0001", "0012", "0123", "1000", "10000", "10001", "100002"}
    assert {r.stock_id for r in market.info(spark, str(tmp_path)).collect()} == want
    assert sorted(r.stock_id for r in queries.universe_classify(spark, str(tmp_path)).collect()) == sorted(want)


def test_the_panels_days_are_hashed_not_sorted(spark):
    plan = queries._days(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
