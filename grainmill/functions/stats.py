"""Statistics of comparisons: closed forms as Column expressions, tail probabilities as one small vectorised UDF.

Where a test isn't possible (one observation, no variance) results are null, never NaN or infinite."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window as W

from grainmill.operators.evaluation import PLACE, vs_baseline


def normal_tail(z: float) -> float:
    """Two-sided."""
    return math.erfc(abs(z) / math.sqrt(2))


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny, c = 1e-300, 1.0
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            c = 1 + top / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return out


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def student_tail(t: float, df: float) -> float:
    """Two-sided."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def normal_p(z: Column | str) -> Column:
    @F.pandas_udf("double")
    def f(z: pd.Series) -> pd.Series:
        return z.map(normal_tail, na_action="ignore").astype("float64")

    return f(z)


def student_p(t: Column | str, df: Column | str) -> Column:
    @F.pandas_udf("double")
    def f(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) or pd.isna(b) else student_tail(a, b) for a, b in zip(t, df, strict=True)], dtype="float64")

    return f(t, df)


def _over(top: Column, bottom: Column) -> Column:
    """Quotient, null where there is nothing to divide by."""
    return F.when(bottom > 0, top / bottom)


def comparisons(facts: DataFrame) -> DataFrame:
    """Per (condition, benchmark, data, instr): one-sample t of per-seed means against the baseline mean, Welch t of
    observations, pooled two-proportion z, without their probabilities. Row counts come from the data."""
    cell = ["condition", "benchmark", "data", "instr"]
    versus = vs_baseline(facts)
    base = versus.select(*cell, "template", "base_rep").distinct().groupBy(*cell).agg(F.count("*").alias("n_base"), F.avg("base_rep").alias("base_acc"), F.var_samp("base_rep").alias("var_base"), F.sum("base_rep").alias("sum_base"))
    cond = versus.groupBy(*cell).agg(F.count("*").alias("n_cond"), F.avg("cond_rep").alias("cond_acc"), F.var_samp("cond_rep").alias("var_cond"), F.sum(F.col("cond_rep") * F.col("n")).alias("right_cond"), F.sum("n").alias("rows_cond"))
    seeds = versus.groupBy(*cell, "seed").agg(F.avg("cond_rep").alias("a")).groupBy(*cell).agg(F.count("*").alias("n_seeds"), F.avg("a").alias("seed_mean"), F.stddev_samp("a").alias("seed_sigma"))
    sizes = facts.where("condition = 'baseline'").groupBy(*PLACE[1:]).agg(F.sum("n").alias("rows_base"), F.sum(F.col("rep_acc") * F.col("n")).alias("right_base"))
    out = cond.join(base, cell).join(seeds, cell).join(sizes, PLACE[1:])
    err_c, err_b = F.col("var_cond") / F.col("n_cond"), F.col("var_base") / F.col("n_base")
    pooled = (F.col("right_cond") + F.col("right_base")) / (F.col("rows_cond") + F.col("rows_base"))
    error = F.sqrt(pooled * (1 - pooled) * (1 / F.col("rows_cond") + 1 / F.col("rows_base")))
    two = (F.col("n_cond") >= 2) & (F.col("n_base") >= 2)
    return out.select(
        *cell,
        "n_seeds",
        F.col("rows_cond").alias("n_rows_cond"),
        F.col("rows_base").alias("n_rows_base"),
        "base_acc",
        "cond_acc",
        (100 * (F.col("cond_acc") - F.col("base_acc"))).alias("delta_pp"),
        (100 * F.col("seed_sigma")).alias("seed_sigma_pp"),
        _over(F.col("seed_mean") - F.col("base_acc"), F.col("seed_sigma") / F.sqrt("n_seeds")).alias("one_sample_t"),
        F.when(F.col("n_seeds") >= 2, F.col("n_seeds") - 1).otherwise(0).cast("bigint").alias("one_sample_df"),
        F.when(two, _over(F.col("cond_acc") - F.col("base_acc"), F.sqrt(err_c + err_b))).alias("welch_t"),
        F.when(two, _over((err_c + err_b) * (err_c + err_b), err_c * err_c / (F.col("n_cond") - 1) + err_b * err_b / (F.col("n_base") - 1))).alias("welch_df"),
        _over(F.col("right_cond") / F.col("rows_cond") - F.col("right_base") / F.col("rows_base"), error).alias("z"),
    )


def significance(facts: DataFrame, alpha: float = 0.05) -> DataFrame:
    """comparisons with two-sided probabilities and the marks of the z test, uncorrected and after Bonferroni."""
    out = comparisons(facts)
    out = out.withColumns({"one_sample_p": student_p("one_sample_t", F.nullif(F.col("one_sample_df"), F.lit(0)).cast("double")), "welch_p": student_p("welch_t", "welch_df"), "z_p": normal_p("z")})
    tests = F.count("*").over(W.partitionBy(F.lit(1)))
    return out.withColumns({"mark": F.when(F.col("z_p") < 0.01, "**").when(F.col("z_p") < alpha, "*").otherwise(""), "mark_bonferroni": F.when(F.col("z_p") < alpha / tests, "***").otherwise("")})


def significance_summary(tested: DataFrame, alpha: float = 0.05) -> DataFrame:
    return tested.groupBy("benchmark").agg(F.count("*").alias("n_cells"), F.count_if(F.col("z_p") < alpha).alias("n_z"), F.count_if(F.col("mark_bonferroni") == "***").alias("n_z_bonferroni"), F.count_if(F.col("one_sample_p") < alpha).alias("n_one_sample"))


def scale_bound(x: Column | str, share: float = 0.95) -> Column:
    """Interpolated quantile of absolute values; 0 gives 1e-3."""
    bound = F.percentile(F.abs(x), share)
    return F.when(bound == 0, F.lit(1e-3)).otherwise(bound)
