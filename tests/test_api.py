"""Names, plans, the trusted names, configuration, sources, streams, and the queries against DuckDB."""

import glob
import json
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import foldspark as fs
from foldspark import queries, sources, streaming
from foldspark.functions import columns as C
from foldspark.operators import trusted

DATA = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_trusted_names(spark):
    assert len(trusted.NAMES) == 73
    table = sources.vector(spark, [1.0, 2.0, 4.0], [10.0, 20.0, 30.0])
    found = table.agg(trusted.weighted_sum_valid("x", "w").alias("t"), trusted.weighted_average_valid("x", "w").alias("a"), trusted.std_mean_valid("x", 1).alias("s")).first()
    assert tuple(found["t"]) == (170, 60, 7) and found["a"] == pytest.approx(170 / 60) and found["s"]["mean"] == pytest.approx(7 / 3)
    noisy = sources.vector(spark, [1.0, np.nan, np.inf, 4.0], [2.0, 3.0, 5.0, 7.0])
    found = noisy.agg(trusted.weighted_sum_skip_nan("x", "w").alias("a"), trusted.weighted_sum_skip_nonfinite("x", "w").alias("b")).first()
    assert tuple(found["a"]) == (np.inf, 14, np.inf) and tuple(found["b"]) == (30, 9, 5)
    rows = sources.stack(spark, np.arange(6.0).reshape(3, 2))
    assert [r["value"] for r in trusted.reduce_axis0_valid(rows, "a", "median").orderBy("pos").collect()] == [2, 3]
    assert [r["value"] for r in trusted.percentile_axis_last_valid(rows, "a", 50).orderBy("row").collect()] == [0.5, 2.5, 4.5]
    with pytest.raises(ValueError, match="unknown op"):
        trusted.reduce_axis0_valid(rows, "a", "mode")
    assert table.agg(trusted.percentiles_valid("x", [0, 100])).first()[0] == [1, 4]


def test_fused_results_share_one_aggregate(spark):
    table = spark.read.parquet(f"{DATA}/lineitem.parquet")
    plan = plan_of(fs.nanminmax(table, "l_tax", by="l_returnflag"))
    assert plan.count("HashAggregate") == 2 and plan.count("Exchange") == 1
    assert "ReadSchema: struct<l_tax:double,l_returnflag:string>" in plan
    both = fs.nansum(table, "l_tax", by="l_returnflag", weights="l_quantity", return_sum_weights=True, return_unweighted_sum=True)
    assert plan_of(both).count("Exchange") == 1
    assert "Python" not in plan and "PushedFilters: [IsNotNull(l_tax), LessThan(l_tax,0.05)]" in plan_of(fs.mean(table.filter("l_tax < 0.05"), "l_tax"))


def test_variance_reads_twice_only_far_from_zero(spark, tmp_path):
    near = spark.range(2000).selectExpr("id % 3 AS g", "double(id) AS x")
    far = near.selectExpr("g", "IF(g = 1, 1e15 + 2 * (x % 7), x) AS x")
    for kind, table in (("near", near), ("far", far)):
        table.write.parquet(str(tmp_path / kind))
        read = spark.read.parquet(str(tmp_path / kind))
        for by in (["g"], []):
            values = read.filter("g = 1") if not by else read
            found = fs.var(values, "x", by=by)
            got = {r["g"] if by else 1: r["value"] for r in found.collect()}
            for g, own in table.toPandas().groupby("g"):
                if g in got:
                    assert got[g] == pytest.approx(np.var(own["x"].to_numpy() - own["x"].iloc[0]), rel=1e-9)
            # The second part of the plan is gone from the final one unless a group needs it.
            final = plan_of(found).split("Initial Plan")[0]
            assert ("Union" in final) == (kind == "far"), final


def test_no_job_while_building(spark):
    table = sources.vector(spark, np.arange(8.0)).withColumn("g", F.col("pos") % 2)
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    plans = [fs.var(table, "x", by="g"), fs.std(table, "x"), fs.median(table, "x", by="g", bracketed=True), fs.lmedian(table, "pos")]
    assert len(tracker.getJobIdsForGroup(None)) == before
    assert [p.count() for p in plans] == [2, 1, 2, 1]


def test_approximate_ranks(spark):
    table = spark.range(20_000).selectExpr("id % 2 AS g", "double(id) AS x", "IF(id = 7, double('NaN'), double(id)) AS n")
    for r in fs.percentile(table, "x", q=[10, 50, 99], by="g", approx=1000).collect():
        assert r["value"] == pytest.approx([2000, 10_000, 19_800], abs=25)
    assert fs.median(table, "x", approx=1000).first()[0] == pytest.approx(10_000, abs=25)
    assert np.isnan(fs.median(table, "n", approx=1000).first()[0]) and fs.nanmedian(table, "n", approx=100).first()[0] > 0
    assert np.isnan(fs.quantile(table.filter("false"), "x", q=0.5, approx=10).first()[0])
    with pytest.raises(ValueError, match="approx"):
        fs.mean(table, "x", approx=10)


@pytest.mark.parametrize("few", [50_000, 2500])
def test_bracketed_ranks(spark, monkeypatch, few):
    """Equal to the map of counts, for groups with a bracket and without."""
    monkeypatch.setattr("foldspark.operators.frame.FEW", few)
    table = spark.range(9000).selectExpr(
        "IF(id % 50 = 0, 'small', IF(id % 3 = 0, NULL, 'big')) AS g",
        "CASE WHEN id % 97 = 0 THEN double('NaN') WHEN id % 101 = 0 THEN double('Infinity') ELSE round(pow(hash(id) / 1e9, 3), 2) END AS x",
        "CASE WHEN id % 4 = 0 THEN 7 ELSE 9007199254740993 + hash(id) END AS k", "id % 5 > 1 AS b", "float(id % 1000) AS f", "IF(id % 11 = 0, NULL, double(id)) AS m",
    )

    def rows(found):
        return sorted((str(r["g"]) if "g" in found.columns else "", str(r["value"])) for r in found.collect())

    for by in (["g"], []):
        for n, call in enumerate((
            lambda **o: fs.nanpercentile(table, "x", q=[0, 16, 50, 99.9, 100], **o), lambda **o: fs.nanmedian(table, "x", ignore_inf=True, **o), lambda **o: fs.median(table, "x", **o),
            lambda **o: fs.median(table, "m", **o), lambda **o: fs.lmedian(table, "k", **o), lambda **o: fs.lmedian(table, "b", **o), lambda **o: fs.lmedian(table, "f", **o), lambda **o: fs.quantile(table, "k", q=0.3, **o),
            lambda **o: fs.median(table.filter("false"), "x", **o), lambda **o: fs.nanmedian(table.withColumn("x", F.lit(float("nan"))), "x", **o),
        )):
            if n % 3 and (not by or few < 50_000):
                continue
            a, b = call(by=by, bracketed=False), call(by=by, bracketed=True)
            assert a.dtypes == b.dtypes and rows(a) == rows(b)
    stack = spark.range(300).selectExpr("array(double(id), IF(id % 7 = 0, double('NaN'), -double(id))) AS a")
    a, b = (sorted(map(tuple, fs.nanquantile(stack, "a", 0, q=[0.1, 0.9], bracketed=x).selectExpr("pos", "string(value)").collect())) for x in (False, True))
    assert a == b and "percentile_approx" in plan_of(fs.median(table, "x", by="g", bracketed=True))


def test_array_rows_are_not_shuffled(spark):
    plan = plan_of(fs.std(sources.stack(spark, np.ones((2, 3))), "a", -1))
    assert "Exchange" not in plan and "Python" not in plan


def test_expressions_compose(spark):
    table = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 3.0), ("b", "x", float("nan"))], "g string, h string, v double")
    cube = {(r["g"], r["h"]): r["m"] for r in table.cube("g", "h").agg(C.nanmean("v").alias("m")).collect()}
    assert cube[(None, None)] == 2 and cube[("a", "y")] == 3 and np.isnan(cube[("b", "x")])
    with pytest.raises(TypeError):
        fs.mean(table, "v", ignore_inf=True)
    with pytest.raises(ValueError):
        fs.reduce(table, "mode", "v")


def test_grains(tmp_path, monkeypatch):
    defaults = fs.get_default_parallel_grains()
    assert len(defaults) == 7
    file = tmp_path / "deep" / "grains.json"
    try:
        fs.set_parallel_grain("minmax_1d", 5)
        fs.set_axis_scan_grain(6)
        fs.set_axis_order_grain(7)
        assert fs.get_parallel_grains() == defaults | {"minmax_1d": 5, "axis_scan_plain": 6, "axis_order_median": 7}
        assert fs.save_parallel_grains_config(path=file) == file
        fs.use_default_parallel_grains()
        assert fs.get_parallel_grains() == defaults
        assert fs.apply_parallel_grains_config(file) and fs.get_parallel_grains()["minmax_1d"] == 5
        for bad in ({"other": 1}, {"minmax_1d": 0}, {"minmax_1d": True}, {"minmax_1d": 1.5}):
            with pytest.raises(ValueError):
                fs.set_parallel_grains({"axis_scan_nan": 9, **bad})
            file.write_text(json.dumps(bad))
            with pytest.raises(ValueError):
                fs.load_parallel_grains_config(file)
        assert fs.get_parallel_grains()["axis_scan_nan"] == defaults["axis_scan_nan"]
        file.write_text("{")
        with pytest.raises(ValueError):
            fs.load_parallel_grains_config(file)
        monkeypatch.setenv("FOLDSPARK_GRAINS_FILE", str(file))
        assert fs.parallel_grains_config_path() == file
        monkeypatch.setenv("FOLDSPARK_IGNORE_GRAINS", "1")
        assert not fs.apply_parallel_grains_config()
        assert fs.clear_parallel_grains_config() and not fs.clear_parallel_grains_config()
        assert fs.load_parallel_grains_config() is None
    finally:
        fs.use_default_parallel_grains()


def test_saved_grains_on_import(tmp_path):
    import subprocess
    import sys
    from pathlib import Path

    file = tmp_path / "grains.json"
    code = "import foldspark as fs; print(fs.get_parallel_grains()['minmax_1d'])"
    for text, said, warned in (('{"minmax_1d": 12}', "12", False), ("{", "65536", True), ('{"other": 1}', "65536", True)):
        file.write_text(text)
        run = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True, env={**os.environ, "FOLDSPARK_GRAINS_FILE": str(file)})
        assert run.stdout.strip() == said and ("saved grains are not used" in run.stderr) == warned, run.stderr


def test_grains_limit_tasks(spark):
    table = spark.range(50_000).selectExpr("id % 100 AS g", "double(id) AS x").repartition(4, "x")
    usual = {r["g"]: r["value"] for r in fs.minmax(table, "x", by="g").collect()}
    try:
        fs.set_parallel_grain("minmax_1d", 1 << 40)
        assert spark.conf.get("spark.foldspark.grain.minmax_1d") == str(1 << 40)
        found = fs.minmax(table, "x", by="g")
        assert found.rdd.getNumPartitions() == 1 and "Coalesce 1" in plan_of(found)
        assert {r["g"]: r["value"] for r in found.collect()} == usual
        assert "Coalesce" not in plan_of(fs.mean(table, "x", by="g"))
    finally:
        fs.use_default_parallel_grains()
    assert "Coalesce" not in plan_of(fs.minmax(table, "x", by="g"))


def test_partitions_for(spark):
    from foldspark.plans.config import partitions_for

    assert [partitions_for(w, 100, 8) for w in (0, 99, 250, 10_000)] == [1, 1, 2, 8]
    assert fs.get_num_threads(spark) == spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("kind", sources.FORMATS)
def test_formats(spark, tmp_path, kind):
    table = spark.createDataFrame([(1, 1.5), (2, float("nan"))], "k int, x double")
    sources.write(table, str(tmp_path / kind), kind)
    back = sources.read(spark, str(tmp_path / kind), kind, schema=table.schema)
    assert back.agg(C.nansum("x")).first()[0] == 1.5
    with pytest.raises(ValueError):
        sources.read(spark, "x", "xml2")


def test_streams(spark, tmp_path):
    table = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, id) AS t, id % 2 AS g, IF(id = 3, double('NaN'), double(id)) AS x FROM range(20)")
    table.write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    for op in ("mean", "sum", "minmax", "var", "count_finite"):
        found = streaming.reduced(events, "t", op, "x", length="10 minutes", ignore_inf=False, by=["g"])
        query = found.writeStream.format("memory").queryName(f"w_{op}").outputMode("complete").trigger(availableNow=True).start()
        query.awaitTermination(60)
        rows = spark.table(f"w_{op}").collect()
        assert len(rows) == 4
        if op == "sum":
            assert sorted(r["value"] for r in rows) == [20, 22, 70, 75]
    with pytest.raises(ValueError, match="keeps every value"):
        streaming.reduced(events, "t", "median", "x", length="1 hour")
    assert fs.std(events, "x", by="g").isStreaming


def test_queries_equal_their_sql(spark):
    """Every query on the smallest tables, exactly."""
    db = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        db.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    sql = queries.oracle_sql()
    assert sql.keys() == queries.queries().keys()
    for name, query in queries.queries().items():
        found, wanted = query(spark, DATA).toPandas(), db.execute(sql[name]).fetchdf()
        assert sorted(found.columns) == sorted(wanted.columns), name
        order = sorted(found.columns)
        rows = [sorted(map(repr, x[order].astype(object).where(x[order].notna(), None).itertuples(index=False, name=None))) for x in (found, wanted)]
        assert len(rows[0]) == len(rows[1]), name
        a, b = (x[order].sort_values(order).reset_index(drop=True) for x in (found, wanted))
        for c in order:
            if a[c].dtype.kind == "f":
                assert a[c].to_numpy() == pytest.approx(b[c].to_numpy(dtype=float), rel=1e-6, abs=2e-4, nan_ok=True), (name, c)
            else:
                assert a[c].astype(object).where(a[c].notna(), None).tolist() == b[c].astype(object).where(b[c].notna(), None).tolist(), (name, c)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 3
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_tuning(spark, tmp_path, capsys):
    from foldspark.plans import tuning

    assert tuning.grain_from(1000, 2.0, 1.0) == 256 and tuning.grain_from(0, 0.0, 1.0) == 1
    spark.range(20_000).selectExpr("id % 3 AS g", "double(id) AS x").write.parquet(str(tmp_path / "t"))
    file = tmp_path / "grains.json"
    try:
        assert tuning.main(["--table", str(tmp_path / "t"), "--column", "x", "--by", "g", "--config", str(file)]) == 0
        saved = fs.load_parallel_grains_config(file)
        assert saved == fs.get_parallel_grains() and all(v & (v - 1) == 0 for v in saved.values())
    finally:
        fs.use_default_parallel_grains()
    assert "PySpark" in capsys.readouterr().out
    assert tuning.main(["--reset", "--config", str(file)]) == 0 and not file.exists()


def test_names_need_no_session():
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; print(len(e.queries()) >= len(e.oracle_sql()) > 80)"
    said = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True)
    assert said.stdout.strip() == "True", said.stderr
