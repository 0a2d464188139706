"""Extreme-value statistics of many locations at once: block maxima, fits, return levels, bootstrap bands, trend."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tephra.functions import gev
from tephra.schemas import MIN_BLOCKS_FOR_TREND, RETURN_PERIODS, SIGNIFICANCE
from tephra.sources.scratch import materialized

#: Bootstrap replicates, stationary and drifting, and replicates in one task.
BOOT, BOOT_TREND, BOOT_TASK = 300, 200, 100
ALPHA = 0.10


def block_maxima(daily: DataFrame, block: Column | None = None) -> DataFrame:
    """(location, block, value): the maximum of each block (the year by default); null days are skipped."""
    return daily.where("value is not null").groupBy(
        "location", (F.year("day") if block is None else block).alias("block")
    ).agg(F.max("value").alias("value"))


def record_summary(maxima: DataFrame) -> DataFrame:
    """(location, n_blocks, first_block, last_block, record_max)."""
    return maxima.groupBy("location").agg(
        F.count("*").alias("n_blocks"), F.min("block").alias("first_block"), F.max("block").alias("last_block"),
        F.max("value").alias("record_max")
    )


def with_record_summary(maxima: DataFrame) -> DataFrame:
    """Maxima with the summary of their location beside each; one pass, a location has a row for each block."""
    at = Window.partitionBy("location")
    return maxima.select(
        "*", F.count("*").over(at).alias("n_blocks"), F.min("block").over(at).alias("first_block"),
        F.max("block").over(at).alias("last_block"), F.max("value").over(at).alias("record_max")
    )


def gumbel_moments(maxima: DataFrame) -> DataFrame:
    """(location, c, loc, scale): Gumbel parameters by moments, in columns only; needs two blocks that differ."""
    scale = F.stddev_samp("value") * F.sqrt(F.lit(6.0)) / F.lit(np.pi)
    return maxima.groupBy("location").agg(F.avg("value").alias("mean"), scale.alias("scale")).where("scale > 0").select(
        "location", F.lit(0.0).alias("c"), (F.col("mean") - gev._EULER * F.col("scale")).alias("loc"), "scale"
    )


def fit(maxima: DataFrame) -> DataFrame:
    """(location, c, loc, scale, log_likelihood, n_blocks): maximum-likelihood fit of each location's maxima."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values("block")["value"].to_numpy(float)
        c, loc, scale, likelihood = gev.fit(y)
        return pd.DataFrame(
            {
                "location": [pdf["location"].iloc[0]], "c": [c], "loc": [loc], "scale": [scale],
                "log_likelihood": [likelihood], "n_blocks": [len(y)]
            }
        )

    kind = dict(maxima.dtypes)["location"]
    return maxima.groupBy("location").applyInPandas(
        one, f"location {kind}, c double, loc double, scale double, log_likelihood double, n_blocks long"
    )


def fit_trend(maxima: DataFrame) -> DataFrame:
    """(location, c, mu0, slope, sigma, x_mean, lr_statistic, p_value, last_block, slope_per_decade, significant)."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        found = gev.fit_trend(pdf["value"].to_numpy(float), pdf["block"].to_numpy(float))
        return pd.DataFrame([{"location": pdf["location"].iloc[0], **found, "last_block": float(pdf["block"].iloc[-1])}])

    kind = dict(maxima.dtypes)["location"]
    fitted = maxima.groupBy("location").applyInPandas(
        one,
        f"location {kind}, c double, mu0 double, slope double, sigma double, x_mean double, lr_statistic double, p_value double, last_block double"
    )
    return with_trend_verdict(fitted)


def with_trend_verdict(fits: DataFrame) -> DataFrame:
    return fits.withColumns({"slope_per_decade": F.col("slope") * 10, "significant": F.col("p_value") < SIGNIFICANCE})


def location_at(at: Column) -> Column:
    """Location of a drifting fit at a covariate."""
    return F.col("mu0") + F.col("slope") * (at - F.col("x_mean"))


def return_levels(fits: DataFrame, periods=RETURN_PERIODS) -> DataFrame:
    """(…, return_period, level): one row for each fit (c, loc, scale) and period."""
    wide = fits.withColumn("return_period", F.explode(F.array(*(F.lit(int(p)) for p in periods))))
    return wide.withColumn("level", gev.return_level(F.col("c"), F.col("loc"), F.col("scale"), F.col("return_period")))


def _band(draws: DataFrame, levels: DataFrame, alpha: float) -> DataFrame:
    """Linear percentiles of bootstrap levels, widened to hold the point estimate."""
    bands = draws.groupBy("location", "return_period").agg(
        F.percentile("draw", alpha / 2).alias("low"), F.percentile("draw", 1 - alpha / 2).alias("high")
    )
    joined = levels.join(bands, ["location", "return_period"])
    return joined.select(
        "location", "return_period", "level", F.least("low", "level").alias("ci_low"),
        F.greatest("high", "level").alias("ci_high")
    )


def _without_band(levels: DataFrame) -> DataFrame:
    return levels.select(
        "location", "return_period", "level", F.lit(None).cast("double").alias("ci_low"),
        F.lit(None).cast("double").alias("ci_high")
    )


def return_levels_with_band(
    maxima: DataFrame, fits: DataFrame | None = None, periods=RETURN_PERIODS, boot: int = BOOT, seed: int = 0,
    alpha: float = ALPHA
) -> DataFrame:
    """(location, return_period, level, ci_low, ci_high): parametric bootstrap of the stationary fit, none where ``boot`` is 0.

    Replicates are dealt over tasks in blocks, each with a random stream of its own that only the seed, the location and
    the replicate's number decide.
    """
    fits = materialized(fit(maxima), "fits") if fits is None else fits
    if boot <= 0:
        return _without_band(return_levels(fits, periods))
    blocks = -(-boot // BOOT_TASK)
    work = fits.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in pdf.itertuples():
            numbers = range(r.part * BOOT_TASK, min(boot, (r.part + 1) * BOOT_TASK))
            samples = np.array(
                [
                    gev.draws(r.c, r.loc, r.scale, int(r.n_blocks), (seed, zlib.crc32(str(r.location).encode()), b))
                    for b in numbers
                ]
            )
            c, loc, scale, _ = gev.fits(samples)
            out += [
                pd.DataFrame(
                    {"location": r.location, "return_period": int(p), "draw": gev.quantile(1 - 1 / p, c, loc, scale)}
                )
                for p in periods
            ]
        return pd.concat(out)

    kind = dict(fits.dtypes)["location"]
    draws = work.groupBy("location", "part").applyInPandas(run, f"location {kind}, return_period int, draw double")
    return _band(draws, return_levels(fits, periods).select("location", "return_period", "level"), alpha)


def trend_return_levels(
    maxima: DataFrame, trends: DataFrame, periods=RETURN_PERIODS, boot: int = 0, seed: int = 0, alpha: float = ALPHA
) -> DataFrame:
    """Return levels of drifting fits at their last block, with a bootstrap band where ``boot`` is positive.

    Replicates are drawn on the covariates of the fit and refitted from its own optimum.
    """
    point = trends.select("location", "c", location_at(F.col("last_block")).alias("loc"), F.col("sigma").alias("scale"))
    levels = return_levels(point, periods).select("location", "return_period", "level")
    if boot <= 0:
        return _without_band(levels)
    grids = maxima.groupBy("location").agg(F.sort_array(F.collect_list(F.col("block").cast("double"))).alias("grid"))
    blocks = -(-boot // BOOT_TASK)
    work = trends.join(grids, "location").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in pdf.itertuples():
            x = np.asarray(r.grid, float) - r.x_mean
            parent = [r.c, r.mu0, r.slope, np.log(r.sigma)]
            numbers = range(r.part * BOOT_TASK, min(boot, (r.part + 1) * BOOT_TASK))
            samples = np.array(
                [
                    gev.draws(
                        r.c, r.mu0 + r.slope * x, r.sigma, len(x), (seed, zlib.crc32(str(r.location).encode()), b)
                    )
                    for b in numbers
                ]
            )
            found, _ = gev.trend_fits(samples, x, parent)
            loc = found[:, 1] + found[:, 2] * (r.last_block - r.x_mean)
            level = lambda p: gev.quantile(1 - 1 / p, found[:, 0], loc, np.exp(found[:, 3]))  # noqa: B023, E731
            out += [pd.DataFrame({"location": r.location, "return_period": int(p), "draw": level(p)}) for p in periods]
        return pd.concat(out)

    kind = dict(trends.dtypes)["location"]
    draws = work.groupBy("location", "part").applyInPandas(run, f"location {kind}, return_period int, draw double")
    return _band(draws, levels, alpha)


def hazard_statistics(
    maxima: DataFrame, boot: int = BOOT, boot_trend: int = BOOT_TREND, least: int = MIN_BLOCKS_FOR_TREND
) -> DataFrame:
    """One row for each location: record summary, return levels with bands, and the trend where enough blocks exist.

    Levels are those of the drifting fit at the last block where its trend is significant, else of the stationary fit.
    """
    maxima = materialized(maxima, "block-maxima")
    summary = record_summary(maxima)
    fits = materialized(fit(maxima), "fits")
    long = maxima.join(summary.where(F.col("n_blocks") >= least).select("location"), "location", "left_semi")
    trends = materialized(fit_trend(long), "trends")
    strong = trends.where("significant")
    stationary = return_levels_with_band(maxima, fits.join(strong.select("location"), "location", "left_anti"), boot=boot)
    effective = trend_return_levels(long.join(strong.select("location"), "location", "left_semi"), strong, boot=boot_trend)
    levels = stationary.unionByName(effective).groupBy("location").agg(
        F.array_sort(F.collect_list(F.struct("return_period", "level", "ci_low", "ci_high"))).alias("return_levels")
    )
    trend = trends.select(
        "location",
        F.struct(
            F.lit("year").alias("covariate"), "slope_per_decade", "p_value", "significant",
            F.when(F.col("significant"), F.col("last_block")).alias("evaluated_at")
        ).alias("trend")
    )
    return summary.join(levels, "location").join(trend, "location", "left")
