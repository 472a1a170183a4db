"""The reductions as queries over the test tables, each with SQL that gives the same rows.

Special values are put in by a rule on the order key: ``x`` carries NaN and infinity, ``n`` NaN alone, ``y`` neither.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import reduce
from .functions import columns as C
from .functions.policy import Policy
from .operators import frame, trusted

NAN, INF = float("nan"), float("inf")
Query = Callable[[SparkSession, str], DataFrame]

_T = """WITH t AS (SELECT l_returnflag AS g, l_linestatus AS s,
  CASE WHEN l_orderkey % 97 = 0 THEN CAST('NaN' AS DOUBLE) WHEN l_orderkey % 101 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE l_extendedprice END AS x,
  CASE WHEN l_orderkey % 97 = 0 THEN CAST('NaN' AS DOUBLE) ELSE l_extendedprice END AS n,
  l_extendedprice AS y, l_quantity AS w, l_linenumber AS i, l_orderkey AS k FROM lineitem)
"""
_FINITE = "abs(x) < CAST('Infinity' AS DOUBLE)"
_POS = "(SELECT CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS pos, vec_id, CAST(unnest(embedding) AS DOUBLE) AS e FROM embeddings)"
_LIST = "list_transform(embedding, lambda v: CAST(v AS DOUBLE))"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, price = F.col("l_orderkey"), F.col("l_extendedprice")
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.col("l_returnflag").alias("g"), F.col("l_linestatus").alias("s"),
        F.when(key % 97 == 0, F.lit(NAN)).when(key % 101 == 0, F.lit(INF)).otherwise(price).alias("x"),
        F.when(key % 97 == 0, F.lit(NAN)).otherwise(price).alias("n"),
        price.alias("y"), F.col("l_quantity").alias("w"), F.col("l_linenumber").alias("i"), key.alias("k"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("e"), (F.col("label") + 1).cast("double").alias("w"))


def _rounded(found: DataFrame, *keys: str, digits: int | None, value: str = "value") -> DataFrame:
    column = F.col(value) if digits is None else F.round(value, digits)
    return found.select(*keys, column.alias("v"))


def _grouped(op: str, column: str, digits: int | None, nan_aware: bool = True, **options) -> Query:
    call = getattr(frame, f"nan{op}" if nan_aware and op not in ("lmedian", "count_finite") else op)
    return lambda spark, d: _rounded(call(lines(spark, d), column, by="g", **options), "g", digits=digits)


def _ranks(column: str, ignore_inf: bool) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        found = frame.nanpercentile(lines(spark, d), column, by="g", q=[16, 50, 84], ignore_inf=ignore_inf)
        return found.select("g", *[F.round(F.col("value")[k], 4).alias(f"p{p}") for k, p in enumerate((16, 50, 84))])

    return query


def _position(op: str, digits: int | None, **options) -> Query:
    return lambda spark, d: _rounded(reduce(vectors(spark, d), op, "e", axis=0, **options), "pos", digits=digits)


def _row(op: str, digits: int | None, **options) -> Query:
    return lambda spark, d: _rounded(reduce(vectors(spark, d), op, "e", axis=-1, **options), "vec_id", digits=digits)


def _special(values: Callable[[], dict[str, Column]]) -> Query:
    """Named aggregates, made when the query runs: an expression needs a session."""
    return lambda spark, d: lines(spark, d).groupBy("g").agg(*[v.alias(k) for k, v in values().items()])


def _unpacked(op: str, fields: dict[str, tuple[str, int | None]], call: Callable[[DataFrame], DataFrame], *keys: str) -> Callable[[DataFrame], DataFrame]:
    def run(df: DataFrame) -> DataFrame:
        parts = [(F.col("value")[f] if r is None else F.round(F.col("value")[f], r)).alias(a) for a, (f, r) in fields.items()]
        return call(df).select(*keys, *parts)

    return run


def _over_lines(run: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: run(lines(spark, d))


def _over_vectors(run: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: run(vectors(spark, d))


def _sql(value: str, source: str = "t", key: str = "g") -> str:
    return f"{_T} SELECT {key}, {value} FROM {source} GROUP BY {key}"


def _kept(column: str, finite: bool) -> str:
    return f"CASE WHEN {_FINITE} THEN {column} END" if finite else "CASE WHEN NOT isnan(n) THEN n END"


def _catalogue() -> dict[str, tuple[Query, str]]:
    out: dict[str, tuple[Query, str]] = {}
    nan = "CAST('NaN' AS DOUBLE)"
    for finite, tag, column in ((False, "", "n"), (True, "_finite", "x")):
        k, o = _kept("x", finite), {"ignore_inf": finite}
        out[f"nansum{tag}_by_flag"] = (_grouped("sum", column, 2, **o), _sql(f"round(coalesce(sum({k}), CAST(0 AS DOUBLE)), 2) AS v"))
        out[f"nanmean{tag}_by_flag"] = (_grouped("mean", column, 4, **o), _sql(f"round(coalesce(avg({k}), {nan}), 4) AS v"))
        out[f"nanmin{tag}_by_flag"] = (_grouped("min", column, None, **o), _sql(f"coalesce(min({k}), {nan}) AS v"))
        out[f"nanmax{tag}_by_flag"] = (_grouped("max", column, None, **o), _sql(f"coalesce(max({k}), {nan}) AS v"))
        out[f"nanminmax{tag}_by_flag"] = (
            _over_lines(_unpacked("minmax", {"lo": ("min", None), "hi": ("max", None)}, lambda df, c=column, o=o: frame.nanminmax(df, c, by="g", **o), "g")),
            _sql(f"min({k}) AS lo, max({k}) AS hi"),
        )
        out[f"nanmedian{tag}_by_flag"] = (_grouped("median", column, 4, **o), _sql(f"round(coalesce(median({k}), {nan}), 4) AS v"))
        out[f"lmedian{tag}_by_flag"] = (_grouped("lmedian", column, None, **o), _sql(f"quantile_disc({k}, 0.5) AS v"))
        out[f"nanpercentile{tag}_by_flag"] = (_ranks(column, finite), _sql(", ".join(f"round(quantile_cont({k}, {p / 100}), 4) AS p{p}" for p in (16, 50, 84))))
        out[f"nanquantile{tag}_by_flag"] = (_grouped("quantile", column, 4, q=0.25, **o), _sql(f"round(quantile_cont({k}, 0.25), 4) AS v"))
        out[f"nanvar{tag}_by_flag"] = (_grouped("var", column, 2, **o), _sql(f"round(var_pop({k}), 2) AS v"))
        out[f"nanstd{tag}_ddof1_by_flag"] = (_grouped("std", column, 5, ddof=1, **o), _sql(f"round(stddev_samp({k}), 5) AS v"))
        out[f"nanaverage{tag}_by_flag"] = (
            _grouped("average", column, 4, weights="w", **o),
            _sql(f"round(sum({k} * w) / sum(CASE WHEN ({k}) IS NOT NULL THEN w END), 4) AS v"),
        )
    k = _kept("x", True)
    out["nanvar_finite_ddof3_by_flag"] = (_grouped("var", "x", 2, ignore_inf=True, ddof=3), _sql(f"round(var_pop({k}) * count({k}) / (count({k}) - 3), 2) AS v"))
    out["nanvar_one_pass_by_flag"] = (_grouped("var", "x", 2, ignore_inf=True, ddof=1, one_pass=True), _sql(f"round(var_samp({k}), 2) AS v"))
    out["nanvar_with_mean_by_flag"] = (
        _over_lines(_unpacked("var", {"var": ("var", 2), "mean": ("mean", 4)}, lambda df: frame.nanvar(df, "x", by="g", ignore_inf=True, return_mean=True), "g")),
        _sql(f"round(var_pop({k}), 2) AS var, round(avg({k}), 4) AS mean"),
    )
    out["nanstd_with_mean_by_flag"] = (
        _over_lines(_unpacked("std", {"std": ("std", 4), "mean": ("mean", 4)}, lambda df: frame.nanstd(df, "x", by="g", ignore_inf=True, ddof=1, return_mean=True), "g")),
        _sql(f"round(stddev_samp({k}), 4) AS std, round(avg({k}), 4) AS mean"),
    )
    # Exact where one pass is not: values far from zero by group.
    out["var_far_offset_by_flag"] = (
        lambda spark, d: _rounded(frame.var(lines(spark, d).withColumn("far", 1e15 + 2.0 * F.col("i")), "far", by="g"), "g", digits=6),
        _sql("round(var_pop(2.0 * i), 6) AS v"),
    )
    out["inf_is_kept_by_skip_nan"] = (
        _special(lambda: {"kept": C.nanmax("x") == INF, "sum_inf": C.nansum("x") == INF}),
        _sql(f"max(CASE WHEN NOT isnan(x) THEN x END) = CAST('Infinity' AS DOUBLE) AS kept, sum(CASE WHEN NOT isnan(x) THEN x END) = CAST('Infinity' AS DOUBLE) AS sum_inf"),
    )
    plain = {"mean": "avg(y)", "sum": "sum(y)", "median": "median(y)", "average": "sum(y * w) / sum(w)", "var": "var_pop(y)", "std": "stddev_pop(y)"}
    for op, sql in plain.items():
        options = {"weights": "w"} if op == "average" else {}
        digits = 2 if op in ("sum", "var") else 4
        out[f"plain_{op}_clean_by_flag"] = (_grouped(op, "y", digits, nan_aware=False, **options), _sql(f"round({sql}, {digits}) AS v"))
        out[f"plain_{op}_propagates_nan"] = (
            lambda spark, d, op=op, o=options: reduce(lines(spark, d), op, "x", by="g", **o).select("g", F.isnan("value").alias("is_nan")),
            _sql("bool_or(isnan(x)) AS is_nan"),
        )
    for op, clean in (("min", "min(y)"), ("max", "max(y)")):
        out[f"plain_{op}_propagates_nan"] = (
            _special(lambda op=op: {"is_nan": F.isnan(getattr(C, op)("x")), f"clean_{op}": getattr(C, op)("y")}),
            _sql(f"bool_or(isnan(x)) AS is_nan, {clean} AS clean_{op}"),
        )
    out["plain_percentile_propagates_nan"] = (
        lambda spark, d: frame.percentile(lines(spark, d), "x", by="g", q=[25, 75]).select("g", F.isnan(F.col("value")[0]).alias("low"), F.isnan(F.col("value")[1]).alias("high")),
        _sql("bool_or(isnan(x)) AS low, bool_or(isnan(x)) AS high"),
    )
    out["plain_quantile_by_flag"] = (_grouped("quantile", "y", 4, nan_aware=False, q=0.9), _sql("round(quantile_cont(y, 0.9), 4) AS v"))
    out["plain_percentile_by_flag"] = (_grouped("percentile", "y", 2, nan_aware=False, q=12.5), _sql("round(quantile_cont(y, 0.125), 2) AS v"))
    out["plain_minmax_struct"] = (
        _over_lines(_unpacked("minmax", {"lo": ("min", None), "hi": ("max", None)}, lambda df: frame.minmax(df, "y", by="g"), "g")),
        _sql("min(y) AS lo, max(y) AS hi"),
    )
    out["count_finite_by_flag"] = (_grouped("count_finite", "x", None), _sql(f"count(CASE WHEN {_FINITE} THEN 1 END) AS v"))
    out["int_exact_select"] = (
        lambda spark, d: lines(spark, d).groupBy("g").agg(C.min("i", kind="int").alias("lo"), C.max("i", kind="int").alias("hi"), C.lmedian("i", kind="int", dtype="int").alias("lmed")),
        _sql("min(i) AS lo, max(i) AS hi, quantile_disc(i, 0.5) AS lmed"),
    )
    out["int_computed_float"] = (
        _special(lambda: {"mean": F.round(C.mean("i", kind="int"), 6), "s": C.sum("i", kind="int"), "med": C.median("i", kind="int")}),
        _sql("round(avg(i), 6) AS mean, CAST(sum(i) AS DOUBLE) AS s, median(i) AS med"),
    )
    out["bigint_lower_median_by_flag"] = (_grouped("lmedian", "k", None), _sql("quantile_disc(k, 0.5) AS v"))
    out["bool_lower_median_by_flag"] = (
        lambda spark, d: _rounded(frame.lmedian(lines(spark, d).withColumn("b", F.col("i") > 3), "b", by="g"), "g", digits=None),
        _sql("quantile_disc(CASE WHEN i > 3 THEN 1 ELSE 0 END, 0.5) = 1 AS v"),
    )
    triple = {"ws": ("weighted_sum", 1), "sw": ("sum_weights", None), "us": ("unweighted_sum", 2)}
    both = {"return_sum_weights": True, "return_unweighted_sum": True}
    out["weighted_nansum_triple"] = (
        _over_lines(_unpacked("sum", triple, lambda df: frame.nansum(df, "x", by="g", weights="w", ignore_inf=True, **both), "g")),
        _sql(f"round(sum({k} * w), 1) AS ws, sum(CASE WHEN {_FINITE} THEN w END) AS sw, round(sum({k}), 2) AS us"),
    )
    out["weighted_sum_only_by_flag"] = (_grouped("sum", "y", 1, nan_aware=False, weights="w"), _sql("round(sum(y * w), 1) AS v"))
    out["global_nanmean_axis_none"] = (
        lambda spark, d: _rounded(frame.nanmean(lines(spark, d), "x", ignore_inf=True), digits=4),
        f"{_T} SELECT round(avg({k}), 4) AS v FROM t",
    )
    out["global_nanstd_axis_none"] = (
        lambda spark, d: _rounded(frame.nanstd(lines(spark, d), "x", ignore_inf=True, ddof=1), digits=4),
        f"{_T} SELECT round(stddev_samp({k}), 4) AS v FROM t",
    )
    out["nanmean_by_two_keys"] = (
        lambda spark, d: _rounded(frame.nanmean(lines(spark, d), "x", by=["g", "s"], ignore_inf=True), "g", "s", digits=4),
        f"{_T} SELECT g, s, round(avg({k}), 4) AS v FROM t GROUP BY g, s",
    )
    out["nanmean_rollup"] = (
        lambda spark, d: lines(spark, d).rollup("g", "s").agg(F.round(C.nanmean("x", ignore_inf=True), 4).alias("v")),
        f"{_T} SELECT g, s, round(avg({k}), 4) AS v FROM t GROUP BY ROLLUP (g, s)",
    )
    events = lambda spark, d: spark.read.parquet(f"{d}/events.parquet")
    out["events_summary_by_type"] = (
        lambda spark, d: events(spark, d).groupBy("event_type").agg(
            F.round(C.mean("value"), 6).alias("mean"), F.round(C.median("value"), 6).alias("median"), C.minmax("value")["min"].alias("lo"), C.minmax("value")["max"].alias("hi"), C.count_finite("value").alias("n")
        ),
        "SELECT event_type, round(avg(value), 6) AS mean, round(median(value), 6) AS median, min(value) AS lo, max(value) AS hi, count(value) AS n FROM events GROUP BY event_type",
    )
    # Trusted names: one query with every scan, one with every weighted form, one with the ranks.
    out["trusted_scans_by_flag"] = (
        _special(lambda: {
            "s": F.round(trusted.sum_valid("y"), 2), "m": F.round(trusted.mean_valid("y"), 4), "lo": trusted.min_valid("y"), "hi": trusted.max_valid("y"),
            "lo2": trusted.minmax_skip_nonfinite("x")["min"], "hi2": trusted.minmax_skip_nan("n")["max"], "sd": F.round(trusted.std_valid("y", 1), 4),
            "vm": F.round(trusted.var_mean_skip_nonfinite("x", 1)["mean"], 4), "med": F.round(trusted.median_skip_nonfinite("x"), 4), "lmed": trusted.lmedian_skip_nan("n"), "c": trusted.count_finite("x"),
        }),
        _sql(f"round(sum(y), 2) AS s, round(avg(y), 4) AS m, min(y) AS lo, max(y) AS hi, min({k}) AS lo2, max(CASE WHEN NOT isnan(n) THEN n END) AS hi2, round(stddev_samp(y), 4) AS sd, "
             f"round(avg({k}), 4) AS vm, round(median({k}), 4) AS med, quantile_disc(CASE WHEN NOT isnan(n) THEN n END, 0.5) AS lmed, count({k}) AS c"),
    )
    out["trusted_weighted_by_flag"] = (
        _special(lambda: {
            "a": F.round(trusted.weighted_average_valid("y", "w"), 4), "b": F.round(trusted.weighted_average_skip_nonfinite("x", "w"), 4), "c": F.round(trusted.weighted_sum_only_skip_nan("n", "w"), 1),
            "d": trusted.weighted_sum_and_weights_skip_nonfinite("x", "w")["sum_weights"], "e": F.round(trusted.weighted_sum_and_unweighted_skip_nan("n", "w")["unweighted_sum"], 2), "f": F.round(trusted.weighted_sum_valid("y", "w")["weighted_sum"], 1),
        }),
        _sql(f"round(sum(y * w) / sum(w), 4) AS a, round(sum({k} * w) / sum(CASE WHEN {_FINITE} THEN w END), 4) AS b, round(sum(CASE WHEN NOT isnan(n) THEN n * w END), 1) AS c, "
             f"sum(CASE WHEN {_FINITE} THEN w END) AS d, round(sum(CASE WHEN NOT isnan(n) THEN n END), 2) AS e, round(sum(y * w), 1) AS f"),
    )
    out["trusted_ranks_by_flag"] = (
        _special(lambda: {
            "a": F.round(trusted.percentile_valid("y", 10), 4), "b": F.round(trusted.quantile_skip_nonfinite("x", 0.75), 4), "c": F.round(trusted.percentiles_valid("y", [5, 95])[1], 4), "d": F.round(trusted.quantile_valid_in_place("y", 0.5), 4),
        }),
        _sql(f"round(quantile_cont(y, 0.1), 4) AS a, round(quantile_cont({k}, 0.75), 4) AS b, round(quantile_cont(y, 0.95), 4) AS c, round(median(y), 4) AS d"),
    )

    # Arrays, position by position.
    by_pos = {
        "mean": ("round(avg(e), 6)", 6), "sum": ("round(sum(e), 4)", 4), "min": ("min(e)", None), "max": ("max(e)", None), "var": ("round(var_pop(e), 6)", 6), "std": ("round(stddev_pop(e), 6)", 6),
        "median": ("round(median(e), 6)", 6), "lmedian": ("quantile_disc(e, 0.5)", None), "count_finite": ("count(e)", None),
    }
    for op, (sql, digits) in by_pos.items():
        out[f"axis0_{op}_embeddings"] = (_position(op, digits), f"SELECT pos, {sql} AS v FROM {_POS} GROUP BY pos")
    out["axis0_minmax_embeddings"] = (
        _over_vectors(_unpacked("minmax", {"lo": ("min", None), "hi": ("max", None)}, lambda df: frame.minmax(df, "e", 0), "pos")),
        f"SELECT pos, min(e) AS lo, max(e) AS hi FROM {_POS} GROUP BY pos",
    )
    out["axis0_percentile_embeddings"] = (
        lambda spark, d: frame.percentile(vectors(spark, d), "e", 0, q=[16, 84]).select("pos", F.round(F.col("value")[0], 6).alias("p16"), F.round(F.col("value")[1], 6).alias("p84")),
        f"SELECT pos, round(quantile_cont(e, 0.16), 6) AS p16, round(quantile_cont(e, 0.84), 6) AS p84 FROM {_POS} GROUP BY pos",
    )
    weighted = _POS.replace("vec_id,", "vec_id, CAST(label + 1 AS DOUBLE) AS w,")
    out["axis0_average_embeddings"] = (_position("average", 6, weights="w"), f"SELECT pos, round(sum(e * w) / sum(w), 6) AS v FROM {weighted} GROUP BY pos")
    out["axis0_weighted_sum_embeddings"] = (
        _over_vectors(_unpacked("sum", {"ws": ("weighted_sum", 4), "sw": ("sum_weights", None), "us": ("unweighted_sum", 4)}, lambda df: frame.sum(df, "e", 0, weights="w", **both), "pos")),
        f"SELECT pos, round(sum(e * w), 4) AS ws, sum(w) AS sw, round(sum(e), 4) AS us FROM {weighted} GROUP BY pos",
    )
    out["axis_none_mean_embeddings"] = (lambda spark, d: _rounded(frame.mean(vectors(spark, d), "e"), digits=6), f"SELECT round(avg(e), 6) AS v FROM {_POS}")
    # Arrays, inside each row.
    per_row = {
        "mean": (f"round(list_avg({_LIST}), 6)", 6), "sum": (f"round(list_sum({_LIST}), 5)", 5), "min": (f"list_min({_LIST})", None), "max": (f"list_max({_LIST})", None),
        "var": (f"round(list_var_pop({_LIST}), 6)", 6), "std": (f"round(list_stddev_pop({_LIST}), 6)", 6), "median": (f"round(list_median({_LIST}), 6)", 6),
        "lmedian": (f"list_sort({_LIST})[(len(embedding) - 1) // 2 + 1]", None), "count_finite": ("CAST(len(embedding) AS BIGINT)", None),
    }
    for op, (sql, digits) in per_row.items():
        out[f"axislast_{op}_embeddings"] = (_row(op, digits), f"SELECT vec_id, {sql} AS v FROM embeddings")
    out["axislast_minmax_embeddings"] = (
        _over_vectors(_unpacked("minmax", {"lo": ("min", None), "hi": ("max", None)}, lambda df: frame.minmax(df, "e", -1), "vec_id")),
        f"SELECT vec_id, list_min({_LIST}) AS lo, list_max({_LIST}) AS hi FROM embeddings",
    )
    out["axislast_quantile_embeddings"] = (_row("quantile", 6, q=0.25), f"SELECT vec_id, round(list_aggregate({_LIST}, 'quantile_cont', 0.25), 6) AS v FROM embeddings")
    ramp = [float(i + 1) for i in range(64)]
    out["axislast_average_embeddings"] = (
        _row("average", 6, weights=ramp),
        f"SELECT vec_id, round(sum(e * (pos + 1)) / sum(pos + 1), 6) AS v FROM {_POS} GROUP BY vec_id",
    )
    from .axis_queries import catalogue

    return out | catalogue()


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in _catalogue().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _catalogue().items()}
