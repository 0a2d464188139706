"""Queries over daily series: block maxima, return levels, fits, bands, verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tephra.functions import gev
from tephra.operators import extremes, verdict
from tephra.schemas import MIN_BLOCKS_FOR_TREND, RETURN_PERIODS
from tephra.sources import tables


def _daily(spark, sf_dir, variable="precipitation_sum"):
    return tables.daily(spark, sf_dir).where(F.col("variable") == variable)


def _monthly(spark, sf_dir):
    return extremes.block_maxima(_daily(spark, sf_dir), F.year("day") * 12 + F.month("day"))


def block_maxima(spark, sf_dir):
    maxima = extremes.block_maxima(_daily(spark, sf_dir, "temperature_2m_max"))
    return extremes.with_record_summary(maxima).select(
        "location", "block", F.round("value", 6).alias("value"), "n_blocks", "first_block", "last_block",
        F.round("record_max", 6).alias("record_max")
    )


def block_maxima_with_gaps(spark, sf_dir):
    """Maxima of a series with missing values: two days of three, and a whole year of every fifth location."""
    gap = (F.dayofyear("day") % 3 > 0) | ((F.col("location") % 5 == 0) & (F.year("day") == 1995))
    daily = _daily(spark, sf_dir, "temperature_2m_max").withColumn("value", F.when(~gap, F.col("value")))
    return extremes.block_maxima(daily).select("location", "block", F.round("value", 6).alias("value"))


def return_level_curve(spark, sf_dir):
    fits = extremes.gumbel_moments(extremes.block_maxima(_daily(spark, sf_dir, "temperature_2m_max")))
    return extremes.return_levels(fits).select("location", "return_period", F.round("level", 4).alias("level"))


def return_period_of_peak(spark, sf_dir):
    maxima = extremes.block_maxima(_daily(spark, sf_dir, "temperature_2m_max"))
    both = extremes.gumbel_moments(maxima).join(extremes.record_summary(maxima), "location")
    return both.select(
        "location",
        F.round(
            gev.return_period(F.col("c"), F.col("loc"), F.col("scale"), F.col("record_max")), 4
        ).alias("return_period")
    )


def bootstrap_band(spark, sf_dir):
    """The band step alone, over given draws: every month's maximum as a draw of the yearly level."""
    draws = _monthly(spark, sf_dir).groupBy("location").agg(
        F.percentile("value", 0.05).alias("low"), F.percentile("value", 0.95).alias("high"),
        F.avg("value").alias("level")
    )
    return draws.select(
        "location",
        *(
            F.round(c, 6).alias(n)
            for n, c in (("ci_low", F.least("low", "level")), ("ci_high", F.greatest("high", "level")))
        )
    )


def _peaks(spark, sf_dir):
    """Peaks of the last seven days of each location's series, as its forecast."""
    d = tables.daily(spark, sf_dir)
    last = d.groupBy("location").agg(F.max("day").alias("last"))
    window = d.join(last, "location").where("datediff(last, day) < 7").withColumn("day_no", 7 - F.datediff("last", "day"))
    return verdict.forecast_peak(window)


def forecast_peak(spark, sf_dir):
    return _peaks(spark, sf_dir).select("location", "variable", F.round("peak", 6).alias("peak"))


def risk_verdict(spark, sf_dir):
    maxima = extremes.block_maxima(_daily(spark, sf_dir, "temperature_2m_max"))
    levels = extremes.return_levels(extremes.gumbel_moments(maxima)).groupBy("location").agg(
        F.map_from_entries(F.collect_list(F.struct("return_period", F.round("level", 6)))).alias("levels")
    )
    peaks = _peaks(spark, sf_dir).where("variable = 'temperature_2m_max'").unionByName(
        extremes.record_summary(maxima).select(
            "location", F.lit("record").alias("variable"), F.col("record_max").alias("peak")
        )
    )
    return peaks.join(levels, "location").select(
        "location", "variable", verdict.level_by_return_period(F.col("peak"), F.col("levels")).alias("risk_level")
    )


def absolute_level(spark, sf_dir):
    hazard = F.when(F.col("variable") == "precipitation_sum", "extreme_precip").otherwise("heatwave")
    metric = F.when(F.col("variable") == "precipitation_sum", F.col("value")).otherwise(F.round(F.col("value") / 2000, 3))
    return tables.daily(spark, sf_dir).select(
        hazard.alias("hazard"), verdict.absolute_level(hazard, metric).alias("level")
    ).groupBy("hazard", "level").agg(F.count("*").alias("n"))


def confidence(spark, sf_dir):
    e = tables.read(spark, sf_dir, "events")
    names = F.array(
        *(
            F.lit(x)
            for x in (
                "station_calibrated", "point_interpolated_reanalysis", "regional_grid_signal", "not_representative"
            )
        )
    )
    grade = F.get(names, (F.col("event_id") % 5).cast("int"))
    return e.select("event_id", verdict.confidence(grade, F.col("event_id") % 2 == 0).alias("confidence"))


def wind_speeds(spark, sf_dir):
    e = tables.read(spark, sf_dir, "events")
    return e.select(
        "event_id", F.round(verdict.metres_per_second(F.col("value")), 6).alias("ms"),
        verdict.absolute_level(F.lit("wind"), F.col("value")).alias("level")
    )


def _rounded(df, **digits):
    """``df`` with these columns rounded to so many digits, further than two optimisers of one likelihood differ."""
    return df.withColumns({c: F.round(c, n) + 0.0 for c, n in digits.items()})


def gev_fit(spark, sf_dir):
    return _rounded(extremes.fit(_monthly(spark, sf_dir)), c=3, loc=2, scale=2, log_likelihood=4)


def gev_trend_fit(spark, sf_dir):
    fits = extremes.fit_trend(_monthly(spark, sf_dir))
    return _rounded(fits, c=3, mu0=2, slope=3, sigma=2, x_mean=4, lr_statistic=3, p_value=4, slope_per_decade=2)


def hazard_levels(spark, sf_dir):
    """The hazard statistic without bands: summary, levels at the latest block, trend."""
    found = extremes.hazard_statistics(_monthly(spark, sf_dir), boot=0, boot_trend=0)
    level = F.explode(
        F.transform(
            "return_levels",
            lambda r: F.struct(r["return_period"].alias("return_period"), (F.round(r["level"], 1) + 0.0).alias("level"))
        )
    ).alias("r")
    trend = (
        F.round(F.col("trend.slope_per_decade"), 2) + 0.0, F.round(F.col("trend.p_value"), 4) + 0.0,
        F.col("trend.significant"), F.col("trend.evaluated_at")
    )
    names = ("slope_per_decade", "p_value", "significant", "evaluated_at")
    return found.select(
        "location", "n_blocks", "first_block", "last_block", "record_max", *(c.alias(n) for n, c in zip(names, trend)),
        level
    ).select("*", "r.*").drop("r")


def return_levels_ci(spark, sf_dir):
    return extremes.return_levels_with_band(_monthly(spark, sf_dir))


def trend_levels_ci(spark, sf_dir):
    monthly = _monthly(spark, sf_dir)
    return extremes.trend_return_levels(monthly, extremes.fit_trend(monthly), boot=extremes.BOOT_TREND)


def hazard_stat(spark, sf_dir):
    return extremes.hazard_statistics(_monthly(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        block_maxima, block_maxima_with_gaps, return_level_curve, return_period_of_peak, bootstrap_band, forecast_peak,
        risk_verdict, absolute_level, confidence, wind_speeds, gev_fit, gev_trend_fit, hazard_levels, return_levels_ci,
        trend_levels_ci, hazard_stat
    )
}

_DAILY = """
daily as (select s_nationkey as location, l_shipdate::date as day, sum(l_quantity) as precip, max(l_extendedprice) as temp from lineitem join supplier on l_suppkey = s_suppkey group by all),
maxima as (select location, year(day) as block, max(temp) as value from daily group by all),
summary as (select location, count(*) as n_blocks, min(block) as first_block, max(block) as last_block, max(value) as record_max from maxima group by location),
gum as (select location, avg(value) - 0.5772156649015329 * (stddev_samp(value) * sqrt(6.0) / pi()) as loc, stddev_samp(value) * sqrt(6.0) / pi() as scale from maxima group by location having stddev_samp(value) > 0),
levels as (select location, t as return_period, loc - scale * ln(-ln(1 - 1.0::double / t)) as level from gum, (select unnest([10, 50, 100]) as t))"""
_PEAKS = """
long as (select location, day, 'precipitation_sum' as variable, precip as value from daily union all select location, day, 'temperature_2m_max', temp from daily),
peaks as (select location, variable, max(value) as peak from long join (select location, max(day) as last from daily group by 1) using (location) where date_diff('day', day, last) < 7 group by all)"""

#: Negative log-likelihood of one value under shape c, location l and log scale g, infinite off the support.
_NLL = """case when abs(c) < 1e-8 then g + (value - l) / exp(g) + exp(-(value - l) / exp(g)) when 1 - c * (value - l) / exp(g) <= 0 then 1e200
  else g - (1 / c - 1) * ln(1 - c * (value - l) / exp(g)) + pow(1 - c * (value - l) / exp(g), 1 / c) end"""
# Maximum likelihood by pattern search: the best of all neighbours a step away in any of the parameters; the step halves
# where the centre is best. An optimiser other than the operators', on the same likelihood.
_MONTHLY = "m as (select location, year(day) * 12 + month(day) as block, max(precip) as value from daily group by all)"
_FITS = f"""{_MONTHLY},
st as (select location, count(*) as n_blocks, min(block) as first_block, max(block) as last_block, max(value)::double as record_max, avg(block)::double as x_mean, greatest(max(block) - avg(block), avg(block) - min(block))::double as reach,
  stddev_pop(value) * sqrt(6.0) / pi() as sd, avg(value) as mean from m group by location),
d as (select unnest([-1, 0, 1]) as k),
search as (
  select 0 as i, location, 0.0::double as c, mean - 0.5772156649 * sd as l0, ln(sd) as g, 1e300::double as v, 0.25::double as w from st
  union all
  select i + 1, location, best.c, best.l, best.g, best.v, case when best.moved then w else w / 2 end from (
    select i, location, any_value(w) as w, arg_min({{'c': c, 'l': l, 'g': g, 'v': v, 'moved': moved}}, (v, moved)) as best from (
      select i, location, any_value(w) as w, c, l, g, any_value(moved) as moved, case when abs(c) >= 1 then 1e200 else sum({_NLL}) end as v from (
        select i, search.location, w, search.c + a.k * w as c, l0 + b.k * w * exp(search.g) as l, search.g + e.k * w as g, not (a.k = 0 and b.k = 0 and e.k = 0) as moved
        from search, d a, d b, d e where i < 400 and w > 1e-8) n join m using (location) group by i, location, c, l, g) group by i, location)),
fit as (select location, arg_max(c, i) as c, arg_max(l0, i) as loc, exp(arg_max(g, i)) as scale, -arg_max(v, i) as log_likelihood from search group by location)"""
_TRENDS = f"""{_FITS},
drift as (
  select 0 as i, location, c, loc as l0, 0.0::double as s, ln(scale) as g, 1e300::double as v, 0.25::double as w from fit
  union all
  select i + 1, location, best.c, best.l0, best.s, best.g, best.v, case when best.moved then w else w / 2 end from (
    select i, location, any_value(w) as w, arg_min({{'c': c, 'l0': l0, 's': s, 'g': g, 'v': v, 'moved': moved}}, (v, moved)) as best from (
      select i, location, any_value(w) as w, c, l0, s, g, any_value(moved) as moved, case when abs(c) >= 1 then 1e200 else sum({_NLL}) end as v from (
        select n.*, value, l0 + s * (block - x_mean) as l from (
          select i, drift.location, w, drift.c + a.k * w as c, l0 + b.k * w * exp(drift.g) as l0, s + f.k * w * exp(drift.g) / reach as s, drift.g + e.k * w as g, not (a.k = 0 and b.k = 0 and e.k = 0 and f.k = 0) as moved, x_mean
          from drift join st using (location), d a, d b, d e, d f where i < 400 and w > 1e-8) n join m using (location)) group by i, location, c, l0, s, g) group by i, location)),
tr as (select location, arg_max(drift.c, i) as c, arg_max(l0, i) as mu0, arg_max(s, i) as slope, exp(arg_max(g, i)) as sigma, -arg_max(v, i) as drifting from drift group by location),
lr as (select tr.*, greatest(0, 2 * (drifting - log_likelihood)) as lr_statistic, sqrt(greatest(0, 2 * (drifting - log_likelihood)) / 2) as z, 1 / (1 + 0.3275911 * sqrt(greatest(0, 2 * (drifting - log_likelihood)) / 2)) as t from tr join fit using (location)),
trends as (select *, (((((1.061405429 * t - 1.453152027) * t) + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * exp(-z * z) as p_value from lr)"""
_LEVEL = "case when abs(c) < 1e-8 then l - g * ln(-ln(1 - 1.0::double / t)) else l + g * (1 - pow(-ln(1 - 1.0::double / t), c)) / c end"

ORACLES = {
    "gev_fit": f"with recursive {_DAILY}, {_FITS} select location, round(c, 3) + 0.0 as c, round(loc, 2) as loc, round(scale, 2) as scale, round(log_likelihood, 4) as log_likelihood, n_blocks from fit join st using (location)",
    "gev_trend_fit": f"""with recursive {_DAILY}, {_TRENDS}
select location, round(c, 3) + 0.0 as c, round(mu0, 2) as mu0, round(slope, 3) + 0.0 as slope, round(sigma, 2) as sigma, round(x_mean, 4) as x_mean, round(lr_statistic, 3) as lr_statistic, round(p_value, 4) as p_value, last_block::double as last_block,
  round(slope * 10, 2) + 0.0 as slope_per_decade, p_value < 0.05 as significant from trends join st using (location)""",
    "hazard_levels": f"""with recursive {_DAILY}, {_TRENDS},
long as (select * from trends join (select location from st where n_blocks >= {MIN_BLOCKS_FOR_TREND}) using (location)),
used as (select location, case when p_value < 0.05 then long.c else fit.c end as c, case when p_value < 0.05 then mu0 + slope * (last_block - x_mean) else loc end as l, case when p_value < 0.05 then sigma else scale end as g
  from fit join st using (location) left join long using (location)),
periods as (select unnest([{", ".join(map(str, RETURN_PERIODS))}])::int as t)
select location, n_blocks, first_block, last_block, record_max, round(slope * 10, 2) + 0.0 as slope_per_decade, round(p_value, 4) as p_value, p_value < 0.05 as significant, case when p_value < 0.05 then last_block::double end as evaluated_at, t as return_period, round({_LEVEL}, 1) as level
from used join st using (location) left join (select location, slope, p_value from long) using (location), periods""",
    "block_maxima": f"with {_DAILY} select location, block, round(value, 6) as value, n_blocks, first_block, last_block, round(record_max, 6) as record_max from maxima join summary using (location)",
    "block_maxima_with_gaps": f"with {_DAILY} select location, year(day) as block, round(max(temp), 6) as value from daily where dayofyear(day) % 3 = 0 and not (location % 5 = 0 and year(day) = 1995) group by all",
    "return_level_curve": f"with {_DAILY} select location, return_period, round(level, 4) as level from levels",
    "return_period_of_peak": f"with {_DAILY} select location, round(1 / (1 - exp(-exp(-(record_max - loc) / scale))), 4) as return_period from gum join summary using (location)",
    "bootstrap_band": f"with {_DAILY}, m as (select location, year(day) * 12 + month(day) as block, max(precip) as value from daily group by all) select location, round(least(quantile_cont(value, 0.05), avg(value)), 6) as ci_low, round(greatest(quantile_cont(value, 0.95), avg(value)), 6) as ci_high from m group by location",
    "forecast_peak": f"with {_DAILY}, {_PEAKS} select location, variable, round(peak, 6) as peak from peaks",
    "risk_verdict": f"""with {_DAILY}, {_PEAKS},
l as (select location, round(max(level) filter (where return_period = 10), 6) as l10, round(max(level) filter (where return_period = 50), 6) as l50, round(max(level) filter (where return_period = 100), 6) as l100 from levels group by location),
p as (select * from peaks where variable = 'temperature_2m_max' union all select location, 'record', record_max from summary)
select location, variable, case when peak >= l100 then 'SEVERE' when peak >= l50 then 'HIGH' when peak >= l10 then 'MODERATE' else 'LOW' end as risk_level from p join l using (location)""",
    "absolute_level": f"""with {_DAILY}, {_PEAKS}
select hazard, level, count(*) as n from (
  select 'extreme_precip' as hazard, case when precip < 20 then 'LOW' when precip < 50 then 'MODERATE' when precip < 100 then 'HIGH' else 'SEVERE' end as level from daily
  union all select 'heatwave', case when t < 35 then 'LOW' when t < 40 then 'MODERATE' when t < 45 then 'HIGH' else 'SEVERE' end from (select round(temp / 2000, 3) as t from daily)) group by all""",
    "confidence": "select event_id, round(least(0.3 + case event_id % 5 when 0 then 0.35 when 1 then 0.25 when 2 then 0.15 else 0 end + case when event_id % 2 = 0 then 0.1 else 0 end, 0.75)::double, 2) as confidence from events",
    "wind_speeds": "select event_id, round(value / 3.6, 6) as ms, case when value < 40 then 'LOW' when value < 62 then 'MODERATE' when value < 88 then 'HIGH' else 'SEVERE' end as level from events",
}
