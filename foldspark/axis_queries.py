"""Queries of reductions along an axis with NaN, infinity, integers, booleans and weights, of the names that carry a
policy, and of edge cases; each with SQL that gives the same rows.

The arrays are the test vectors with special values put in by a rule on row and position: ``n`` has NaN, ``x`` NaN and
infinity, ``e`` neither, ``i`` whole numbers, ``b`` truth values, ``r`` ragged and null arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import reduce
from .functions import columns as C
from .functions.policy import Policy
from .operators import frame, trusted
from .plans import config

NAN, INF = float("nan"), float("inf")
SHIFT = 3.3e-7
Query = Callable[[SparkSession, str], DataFrame]

_NAN, _INF = "CAST('NaN' AS DOUBLE)", "CAST('Infinity' AS DOUBLE)"
_CELLS = f"""WITH raw AS (SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS pos, label, CAST(unnest(embedding) AS DOUBLE) AS e FROM embeddings),
t AS (SELECT vec_id, pos, e, CASE WHEN (vec_id * 7 + pos) % 11 = 0 THEN {_NAN} ELSE e END AS n,
  CASE WHEN (vec_id * 7 + pos) % 11 = 0 THEN {_NAN} WHEN (vec_id + pos) % 13 = 0 THEN {_INF} ELSE e END AS x,
  CAST(floor(e * 100) AS INTEGER) AS i, e > 0 AS b, CAST(floor(e * 100) AS BIGINT) + 9007199254740993 AS k, CAST(label + 1 AS DOUBLE) AS w, CAST(pos % 3 + 1 AS DOUBLE) AS u,
  CASE WHEN vec_id % 7 <> 0 AND pos < vec_id % 5 THEN e END AS r FROM raw)
"""
_OPS = ("mean", "sum", "min", "max", "median", "lmedian", "var", "std", "count_finite")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors with their special forms, one array column each."""
    vec = F.col("vec_id")
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", (F.col("label") + 1).cast("double").alias("w"), F.col("embedding").cast("array<double>").alias("e"))
    is_nan = lambda p: (vec * 7 + p) % 11 == 0
    return table.withColumns(
        {
            "n": F.transform("e", lambda v, p: F.when(is_nan(p), F.lit(NAN)).otherwise(v)),
            "x": F.transform("e", lambda v, p: F.when(is_nan(p), F.lit(NAN)).when((vec + p) % 13 == 0, F.lit(INF)).otherwise(v)),
            "i": F.transform("e", lambda v: F.floor(v * 100).cast("int")),
            "b": F.transform("e", lambda v: v > 0),
            "k": F.transform("e", lambda v: F.floor(v * 100).cast("long") + 9007199254740993),
            "u": F.transform("e", lambda v, p: (p % 3 + 1).cast("double")),
            "r": F.when(vec % 7 != 0, F.slice("e", 1, (vec % 5).cast("int"))),
        }
    )


def safe(value: Column) -> Column:
    """A result as a number that compares: rounded (shifted a little, as fractions of whole numbers lie midway between two
    rounded ones), with marks for NaN and infinity."""
    value = value.cast("double")
    return F.when(F.isnan(value), F.lit(-999.0)).when(value == INF, F.lit(999999.0)).when(value == -INF, F.lit(-999999.0)).otherwise(F.round(value + SHIFT, 5) + F.lit(0.0))


def _safe_sql(value: str) -> str:
    return f"CASE WHEN isnan({value}) THEN -999.0 WHEN {value} = {_INF} THEN 999999.0 WHEN {value} = -{_INF} THEN -999999.0 ELSE round(({value}) + {SHIFT}, 5) + 0.0 END"


def _kept(column: str, policy: Policy) -> str:
    if policy is Policy.FINITE:
        return f"CASE WHEN abs({column}) < {_INF} THEN {column} END"
    return f"CASE WHEN NOT isnan({column}) THEN {column} END" if policy is Policy.SKIP_NAN else column


def _op_sql(op: str, k: str) -> str:
    """An aggregate of DuckDB for an op, as a double, over an expression that is null where nothing takes part."""
    sql = {
        "mean": f"avg({k})", "sum": f"sum({k})", "min": f"min({k})", "max": f"max({k})", "median": f"median({k})", "lmedian": f"quantile_disc({k}, 0.5)",
        "var": f"var_samp({k})", "std": f"stddev_samp({k})", "count_finite": f"count({k})",
    }[op]
    return f"CAST({sql} AS DOUBLE)"


def _rows(parts: Sequence[tuple[str, DataFrame, Column]], key: str) -> DataFrame:
    """op, key, v of several reductions."""
    out: DataFrame | None = None
    for name, found, value in parts:
        own = found.select(F.lit(name).alias("op"), F.col(key), safe(value).alias("v"))
        out = own if out is None else out.unionAll(own)
    return out


def _sql_rows(parts: Sequence[tuple[str, str]], key: str, where: str = "") -> str:
    return _CELLS + " UNION ALL ".join(f"SELECT '{name}' AS op, {key}, {_safe_sql(value)} AS v FROM t {where} GROUP BY {key}" for name, value in parts)


def _axis(axis: int, column: str, policy: Policy, ops: Sequence[str] = _OPS, number: bool = False) -> tuple[Query, str]:
    """Every op along an axis, with the ranks, the pair and the moments with their mean; ddof is 1."""
    key = "pos" if axis == 0 else "vec_id"

    def query(spark: SparkSession, d: str) -> DataFrame:
        table = cells(spark, d).select("vec_id", F.col(column).alias("a"))
        parts = []
        for op in ops:
            found = reduce(table, op, "a", axis=axis, policy=policy, ddof=1 if op in ("var", "std") else 0)
            value = F.col("value")
            parts.append((op, found, value.cast("int") if found.schema["value"].dataType.simpleString() == "boolean" else value))
        pair = reduce(table, "minmax", "a", axis=axis, policy=policy)
        flag = pair.schema["value"].dataType.fields[0].dataType.simpleString() == "boolean"
        parts += [(f"minmax_{m}", pair, F.col("value")[m].cast("int") if flag else F.col("value")[m]) for m in ("min", "max")]
        ranks = reduce(table, "percentile", "a", axis=axis, policy=policy, q=[10, 75])
        parts += [(f"p{q}", ranks, F.col("value")[j]) for j, q in enumerate((10, 75))]
        parts.append(("q40", reduce(table, "quantile", "a", axis=axis, policy=policy, q=0.4), F.col("value")))
        for op in ("var", "std"):
            found = reduce(table, op, "a", axis=axis, policy=policy, ddof=1, return_mean=True)
            parts += [(f"{op}_{m}", found, F.col("value")[m]) for m in (op, "mean")]
        return _rows(parts, key)

    number_of = f"CAST({column} AS INTEGER)" if column == "b" else column
    k = _kept(number_of, policy)
    count = number_of if number else f"CASE WHEN abs({number_of}) < {_INF} THEN 1 END"
    sql = [(op, _op_sql(op, count if op == "count_finite" else k)) for op in ops]
    sql += [(f"minmax_{m}", _op_sql(m, k)) for m in ("min", "max")]
    sql += [(f"p{q}", f"CAST(quantile_cont(CAST({k} AS DOUBLE), {q / 100}) AS DOUBLE)") for q in (10, 75)] + [("q40", f"CAST(quantile_cont(CAST({k} AS DOUBLE), 0.4) AS DOUBLE)")]
    sql += [(f"{op}_{m}", _op_sql(m, k)) for op in ("var", "std") for m in (op, "mean")]
    return query, _sql_rows(sql, key)


def _propagates(axis: int) -> tuple[Query, str]:
    """Plain reductions of arrays with NaN: which results are NaN."""
    key, ops = ("pos" if axis == 0 else "vec_id"), ("mean", "sum", "min", "max", "median", "var", "std")

    def query(spark: SparkSession, d: str) -> DataFrame:
        table = cells(spark, d).filter("vec_id % 5 < 2")
        return _rows([(op, reduce(table, op, "n", axis=axis), F.isnan("value").cast("int")) for op in ops], key)

    return query, _sql_rows([(op, "CAST(max(CASE WHEN isnan(n) THEN 1 ELSE 0 END) AS DOUBLE)") for op in ops], key, "WHERE vec_id % 5 < 2")


def _weighted(axis: int, policy: Policy, column: str) -> tuple[Query, str]:
    """Averages and the weighted triple, with a weight for each element and, along axis 0, for each row."""
    key = "pos" if axis == 0 else "vec_id"
    forms = [("u", "u")] + ([("w", "w")] if axis == 0 else [])
    fields = ("weighted_sum", "sum_weights", "unweighted_sum")

    def query(spark: SparkSession, d: str) -> DataFrame:
        table, parts = cells(spark, d), []
        for name, weights in forms:
            parts.append((f"average_{name}", reduce(table, "average", column, axis=axis, policy=policy, weights=weights), F.col("value")))
            triple = reduce(table, "sum", column, axis=axis, policy=policy, weights=weights, return_sum_weights=True, return_unweighted_sum=True)
            parts += [(f"{f}_{name}", triple, F.col("value")[f]) for f in fields]
            parts.append((f"only_{name}", reduce(table, "sum", column, axis=axis, policy=policy, weights=weights), F.col("value")))
        if axis == -1:
            ramp = [float(p % 3 + 1) for p in range(64)]
            parts.append(("list", reduce(table, "sum", column, axis=-1, policy=policy, weights=ramp), F.col("value")))
        return _rows(parts, key)

    number_of = f"CAST({column} AS INTEGER)" if column == "b" else column
    k, sql = _kept(number_of, policy), []
    for name, w in forms:
        ws, sw = f"sum(({k}) * {w})", f"sum(CASE WHEN ({k}) IS NOT NULL THEN {w} END)"
        sql += [(f"average_{name}", f"{ws} / {sw}"), (f"weighted_sum_{name}", ws), (f"sum_weights_{name}", sw), (f"unweighted_sum_{name}", f"CAST(sum({k}) AS DOUBLE)"), (f"only_{name}", ws)]
    if axis == -1:
        sql.append(("list", f"sum(({k}) * u)"))
    return query, _sql_rows(sql, key)


def _ragged(axis: int) -> tuple[Query, str]:
    """Arrays of unequal lengths, empty and null: a null array is no row of a stack, and has no result of its own."""
    key, ops = ("pos" if axis == 0 else "vec_id"), ("mean", "sum", "min", "max", "median", "lmedian", "count_finite")

    def query(spark: SparkSession, d: str) -> DataFrame:
        table = cells(spark, d)
        return _rows([(op, reduce(table, op, "r", axis=axis), F.col("value")) for op in ops], key)

    if axis == 0:
        return query, _sql_rows([(op, _op_sql(op, "r")) for op in ops], key, "WHERE r IS NOT NULL")
    empty = {"sum": "0.0", "count_finite": "0.0"}
    return query, _sql_rows([(op, f"CASE WHEN vec_id % 7 <> 0 THEN coalesce({_op_sql(op, 'r')}, {empty.get(op, _NAN)}) END") for op in ops], key)


_LINES = f"""WITH t AS (SELECT l_returnflag AS g, l_linestatus AS s, l_linenumber AS i, l_orderkey AS k, l_quantity AS w, l_extendedprice AS y,
  CASE WHEN l_orderkey % 97 = 0 THEN {_NAN} ELSE l_extendedprice END AS n,
  CASE WHEN l_orderkey % 97 = 0 THEN {_NAN} WHEN l_orderkey % 101 = 0 THEN {_INF} ELSE l_extendedprice END AS x FROM lineitem)
"""
_TRUSTED = {"valid": ("y", Policy.TRUSTED), "skip_nan": ("n", Policy.SKIP_NAN), "skip_nonfinite": ("x", Policy.FINITE)}


def _trusted_1d(suffix: str) -> tuple[Query, str]:
    """Every one-dimensional name of a policy, in one aggregate by flag."""
    from .queries import lines

    column, policy = _TRUSTED[suffix]
    k = _kept(column, policy)
    kw, sw = f"sum(({k}) * w)", f"sum(CASE WHEN ({k}) IS NOT NULL THEN w END)"

    def named() -> dict[str, Column]:
        call = lambda name, *a: getattr(trusted, f"{name}_{suffix}")(column, *a)
        out = {op: call(op) for op in ("sum", "mean", "min", "max", "median", "lmedian")}
        out |= {f"minmax_{m}": call("minmax")[m] for m in ("min", "max")}
        out |= {"var": call("var", 1), "std": call("std", 1)}
        out |= {f"{op}_mean_{m}": call(f"{op}_mean", 1)[m] for op in ("var", "std") for m in (op, "mean")}
        for name, fields in {"weighted_sum": ("weighted_sum", "sum_weights", "unweighted_sum"), "weighted_sum_and_weights": ("weighted_sum", "sum_weights"), "weighted_sum_and_unweighted": ("weighted_sum", "unweighted_sum")}.items():
            out |= {f"{name}_{f}": call(name, "w")[f] for f in fields}
        out |= {"weighted_sum_only": call("weighted_sum_only", "w"), "weighted_average": call("weighted_average", "w"), "percentile": call("percentile", 12.5), "quantile": call("quantile", 0.75)}
        if suffix == "valid":
            out |= {f"{op}_in_place": getattr(trusted, f"{op}_valid_in_place")(column) for op in ("median", "lmedian")}
            out |= {"percentile_in_place": trusted.percentile_valid_in_place(column, 30), "quantile_in_place": trusted.quantile_valid_in_place(column, 0.3)}
            out |= {"percentiles": trusted.percentiles_valid(column, [5, 95])[1], "percentiles_in_place": trusted.percentiles_valid_in_place(column, [5, 95])[0], "count_finite": trusted.count_finite("x")}
        return out

    sums = {"weighted_sum": kw, "sum_weights": sw, "unweighted_sum": f"sum({k})"}
    sql = {op: _op_sql(op, k) for op in ("sum", "mean", "min", "max", "median", "lmedian")} | {f"minmax_{m}": _op_sql(m, k) for m in ("min", "max")}
    sql |= {"var": _op_sql("var", k), "std": _op_sql("std", k)} | {f"{op}_mean_{m}": _op_sql(m, k) for op in ("var", "std") for m in (op, "mean")}
    sql |= {f"weighted_sum_{f}": sums[f] for f in sums} | {f"weighted_sum_and_weights_{f}": sums[f] for f in ("weighted_sum", "sum_weights")} | {f"weighted_sum_and_unweighted_{f}": sums[f] for f in ("weighted_sum", "unweighted_sum")}
    rank = lambda q: f"quantile_cont({k}, {q})"
    sql |= {"weighted_sum_only": kw, "weighted_average": f"{kw} / {sw}", "percentile": rank(0.125), "quantile": rank(0.75)}
    if suffix == "valid":
        sql |= {"median_in_place": rank(0.5), "lmedian_in_place": f"quantile_disc({k}, 0.5)", "percentile_in_place": rank(0.3), "quantile_in_place": rank(0.3), "percentiles": rank(0.95), "percentiles_in_place": rank(0.05)}
        sql["count_finite"] = f"CAST(count(CASE WHEN abs(x) < {_INF} THEN 1 END) AS DOUBLE)"

    def near(value: Column) -> Column:
        # Sums in another order differ in the last digits: eight of them are compared.
        return F.round(value / F.pow(F.lit(10.0), F.floor(F.log10(F.abs(value) + 1))), 8)

    def query(spark: SparkSession, d: str) -> DataFrame:
        table = lines(spark, d)
        return table.groupBy("g").agg(*[near(v.cast("double")).alias(n) for n, v in named().items()])

    near_sql = lambda v: f"round(({v}) / pow(10.0, floor(log10(abs({v}) + 1))), 8)"
    return query, f"{_LINES} SELECT g, {', '.join(f'{near_sql(v)} AS {n}' for n, v in sql.items())} FROM t GROUP BY g"


def _trusted_axis(axis: int) -> tuple[Query, str]:
    """Every axis name: each op of each policy, and the ranks."""
    key, where = ("pos", "axis0") if axis == 0 else ("vec_id", "axis_last")
    columns = {"valid": "e", "skip_nan": "n", "skip_nonfinite": "x"}

    def query(spark: SparkSession, d: str) -> DataFrame:
        table, parts = cells(spark, d), []
        for suffix, column in columns.items():
            call = getattr(trusted, f"reduce_{where}_{suffix}")
            parts += [(f"{op}_{suffix}", call(table, column, op, 1 if op in ("var", "std") else 0), F.col("value")) for op in trusted.AXIS_OPS]
            if suffix != "skip_nan":
                parts.append((f"percentile_{suffix}", getattr(trusted, f"percentile_{where}_{suffix}")(table, column, 20), F.col("value")))
        parts.append(("quantile_valid", getattr(trusted, f"quantile_{where}_valid")(table, "e", 0.8), F.col("value")))
        return _rows(parts, key)

    sql = []
    for suffix, column in columns.items():
        k = _kept(column, _TRUSTED[suffix][1])
        sql += [(f"{op}_{suffix}", _op_sql(op, f"CASE WHEN abs({column}) < {_INF} THEN 1 END" if op == "count_finite" else k)) for op in trusted.AXIS_OPS]
        if suffix != "skip_nan":
            sql.append((f"percentile_{suffix}", f"quantile_cont({k}, 0.2)"))
    return query, _sql_rows([*sql, ("quantile_valid", "quantile_cont(e, 0.8)")], key)


def _nothing(spark: SparkSession, d: str) -> DataFrame:
    """Inputs without an element: empty, all skipped, and too few for ddof; along each axis and whole."""
    from .queries import lines

    table = lines(spark, d)
    none, skipped = table.filter("k < 0"), table.filter("k % 97 = 0")
    found: list[tuple[str, DataFrame, Column]] = []
    for op in ("mean", "sum", "min", "max", "median", "var", "std", "lmedian", "count_finite", "average"):
        found.append((f"empty_{op}", reduce(none, op, "x"), F.col("value")))
        found.append((f"skipped_{op}", reduce(skipped, op, "x", policy=Policy.SKIP_NAN), F.col("value")))
    found.append(("empty_percentile", frame.percentile(none, "x", q=[10, 20]), F.col("value")[1]))
    found.append(("too_few_var", frame.var(table.filter("k = 1").limit(1), "y", ddof=1), F.col("value")))
    found.append(("both_infinities_sum", frame.sum(spark.range(2).selectExpr("IF(id = 0, double('Infinity'), double('-Infinity')) AS x"), "x"), F.col("value")))
    found.append(("infinity_var", frame.nanvar(spark.range(3).selectExpr("IF(id = 0, double('Infinity'), double(id)) AS x"), "x"), F.col("value")))
    found.append(("infinite_end_one_q", frame.percentile(spark.range(3).selectExpr("IF(id = 2, double('Infinity'), double(id)) AS x"), "x", q=50), F.col("value")))
    found.append(("infinite_end_fraction", frame.percentile(spark.range(3).selectExpr("IF(id = 0, double('-Infinity'), double(id)) AS x"), "x", q=25), F.col("value")))
    row = spark.range(1).selectExpr("array(0D, 1D, double('Infinity')) AS a")
    found.append(("infinite_end_several_q", frame.percentile(row, "a", -1, q=[0, 100]), F.col("value")[1]))
    found.append(("all_infinite_ignored", frame.nanmean(spark.range(2).selectExpr("double('Infinity') AS x"), "x", ignore_inf=True), F.col("value")))
    found.append(("zero_frames", frame.mean(spark.range(0).selectExpr("array(1D) AS a"), "a", 0).agg(F.count("*").alias("value")), F.col("value")))
    return _rows([(n, df.select(F.lit(0).alias("z"), v.alias("value")), F.col("value")) for n, df, v in found], "z").drop("z")


_NOTHING = {
    **{f"{kind}_{op}": -999.0 for kind in ("empty", "skipped") for op in ("mean", "min", "max", "median", "var", "std", "lmedian")}, "empty_average": -999.0, "skipped_average": -999.0,
    **{f"{kind}_{op}": 0.0 for kind in ("empty", "skipped") for op in ("sum", "count_finite")}, "empty_percentile": -999.0, "too_few_var": -999.0, "both_infinities_sum": -999.0,
    "infinity_var": -999.0, "infinite_end_one_q": 1.0, "infinite_end_fraction": -999999.0, "infinite_end_several_q": -999.0, "all_infinite_ignored": -999.0, "zero_frames": 0.0,
}


def _composed() -> dict[str, tuple[Query, str]]:
    """Aggregate expressions in cubes, grouping sets, windows and time windows; ranks by brackets; the grains."""
    from .queries import lines

    finite = _kept("x", Policy.FINITE)
    mean = lambda: F.round(C.nanmean("x", ignore_inf=True), 4).alias("v")

    def running(spark: SparkSession, d: str) -> DataFrame:
        events = spark.read.parquet(f"{d}/events.parquet")
        by = Window.partitionBy("event_type").orderBy("event_id").rowsBetween(-3, 0)
        return events.select("event_id", F.round(F.avg("value").over(by), 6).alias("mean"), F.max("value").over(by).alias("hi"))

    def hourly(spark: SparkSession, d: str) -> DataFrame:
        events = spark.read.parquet(f"{d}/events.parquet")
        found = events.groupBy(F.window("ts", "1 hour").alias("win"), "event_type").agg(F.round(C.mean("value"), 6).alias("mean"), C.minmax("value")["max"].alias("hi"), C.count_finite("value").alias("n"))
        return found.select(F.unix_timestamp("win.start").alias("begins"), "event_type", "mean", "hi", "n")

    def brackets(spark: SparkSession, d: str) -> DataFrame:
        table, o = lines(spark, d), {"by": "g", "bracketed": True}
        ranks = frame.nanpercentile(table, "x", q=[16, 50, 84], ignore_inf=True, **o).select("g", *[F.round(F.col("value")[j], 4).alias(f"p{q}") for j, q in enumerate((16, 50, 84))])
        lower = frame.lmedian(table, "k", **o).select(F.col("g").alias("g2"), F.col("value").alias("lower"))
        middle = frame.nanmedian(table, "n", **o).select(F.col("g").alias("g3"), F.round("value", 4).alias("middle"))
        return ranks.join(lower, F.col("g") == F.col("g2")).join(middle, F.col("g") == F.col("g3")).drop("g2", "g3")

    defaults = sorted(config.DEFAULTS.items())
    kinds = [(op, axis, grain) for op in ("mean", "var", "median", "percentile", "minmax") for axis in (0, -1) for grain in [config.grain_of(op, axis, False, False)]]
    return {
        "nanmean_cube": (lambda spark, d: lines(spark, d).cube("g", "s").agg(mean()), f"{_LINES} SELECT g, s, round(avg({finite}), 4) AS v FROM t GROUP BY CUBE (g, s)"),
        "nanmean_grouping_sets": (
            lambda spark, d: lines(spark, d).groupingSets([["g"], ["s"]], "g", "s").agg(mean()),
            f"{_LINES} SELECT g, s, round(avg({finite}), 4) AS v FROM t GROUP BY GROUPING SETS ((g), (s))",
        ),
        "running_mean_and_max": (
            running,
            "SELECT event_id, round(avg(value) OVER w, 6) AS mean, max(value) OVER w AS hi FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)",
        ),
        "hourly_summary": (
            hourly,
            "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS begins, event_type, round(avg(value), 6) AS mean, max(value) AS hi, count(value) AS n FROM events GROUP BY ALL",
        ),
        "bracketed_ranks_by_flag": (
            brackets,
            f"{_LINES} SELECT g, " + ", ".join(f"round(quantile_cont({finite}, {q / 100}), 4) AS p{q}" for q in (16, 50, 84)) + f", quantile_disc(k, 0.5) AS lower, round(median({_kept('n', Policy.SKIP_NAN)}), 4) AS middle FROM t GROUP BY g",
        ),
        "grain_defaults": (
            lambda spark, d: spark.createDataFrame(sorted(config.get_default_parallel_grains().items()), "name string, elements long"),
            "SELECT name, CAST(elements AS BIGINT) AS elements FROM (VALUES " + ", ".join(f"('{n}', {v})" for n, v in defaults) + ") AS v(name, elements)",
        ),
        "grains_of_reductions": (
            lambda spark, d: spark.createDataFrame([(op, axis, config.grain_of(op, axis, False, False)) for op, axis, _ in kinds], "op string, axis int, grain string"),
            "SELECT op, CAST(axis AS INTEGER) AS axis, grain FROM (VALUES "
            + ", ".join(f"('{op}', {axis}, '{'axis_scan_var' if op == 'var' else 'axis_order_' + op if op in ('median', 'percentile') else 'axis_scan_plain'}')" for op, axis, _ in kinds)
            + ") AS v(op, axis, grain)",
        ),
    }


def catalogue() -> dict[str, tuple[Query, str]]:
    out: dict[str, tuple[Query, str]] = {}
    for axis, name in ((0, "axis0"), (-1, "axislast")):
        out[f"{name}_skip_nan_ops"] = _axis(axis, "n", Policy.SKIP_NAN)
        out[f"{name}_finite_ops"] = _axis(axis, "x", Policy.FINITE)
        out[f"{name}_plain_ops"] = _axis(axis, "e", Policy.ALL)
        out[f"{name}_int_ops"] = _axis(axis, "i", Policy.ALL, number=True)
        out[f"{name}_bool_ops"] = _axis(axis, "b", Policy.ALL, number=True)
        out[f"{name}_plain_nan"] = _propagates(axis)
        out[f"{name}_weighted_nan"] = _weighted(axis, Policy.SKIP_NAN, "n")
        out[f"{name}_weighted_finite"] = _weighted(axis, Policy.FINITE, "x")
        out[f"{name}_weighted_int"] = _weighted(axis, Policy.ALL, "i")
        out[f"{name}_weighted_bool"] = _weighted(axis, Policy.ALL, "b")
        out[f"{name}_ragged"] = _ragged(axis)
        out[f"trusted_{name}"] = _trusted_axis(axis)
    for axis, name, key in ((0, "axis0", "pos"), (-1, "axislast", "vec_id")):
        # Whole numbers that doubles do not hold keep their type.
        out[f"{name}_wide_exact"] = (
            lambda spark, d, axis=axis, key=key: reduce(cells(spark, d), "lmedian", "k", axis=axis, alias="lower").select(key, "lower")
            .join(reduce(cells(spark, d), "minmax", "k", axis=axis, alias="ends").select(key, "ends.min", "ends.max"), key),
            f"{_CELLS} SELECT {key}, quantile_disc(k, 0.5) AS lower, min(k) AS min, max(k) AS max FROM t GROUP BY {key}",
        )
    for suffix in _TRUSTED:
        out[f"trusted_{suffix}_by_flag"] = _trusted_1d(suffix)
    out["without_elements"] = (_nothing, "SELECT op, CAST(v AS DOUBLE) AS v FROM (VALUES " + ", ".join(f"('{n}', {v})" for n, v in _NOTHING.items()) + ") AS x(op, v)")
    return out | _composed()
