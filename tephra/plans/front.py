"""Queries of the free-text front door: rules, places, validation and assembled reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tephra.functions import text as t
from tephra.operators import extremes, places, verdict
from tephra.sources import tables

# Sentences that exercise every rule; literals of our own.
SENTENCES = (
    "Will the heat wave in Osaka last?", "Marine heatwave near Perth next week",
    "How much rain falls over Mount Isa this week?", "Any drought or aridity in Lima?",
    "Hurricanes and winds around Havana in the next 3 days",
    "sea level rise at Venice", "Hail, tornadoes!", "wildfire season for California over the next two weeks",
    "landslides and avalanches", "Hot spells in Rio Next Week", "What is the plan for tomorrow in Paris?",
    "gusts at Cape Town for five days", "next twelve weeks in Oslo", "next 99 days near New York",
    "a fortnight of monsoons in Pune", "nothing here", "Temperature extremes in Kyoto", "next 0 days for Rome",
    "downpours around Lagos During The Night", "",
)


def _sentences(spark, sf_dir):
    mine = spark.createDataFrame([(-1 - k, s) for k, s in enumerate(SENTENCES)], "qid long, text string")
    return tables.questions(spark, sf_dir).unionByName(mine)


def scope_guard(spark, sf_dir):
    return _sentences(spark, sf_dir).select("qid", t.out_of_scope("text").alias("out_of_scope"))


def hazard_classify(spark, sf_dir):
    return _sentences(spark, sf_dir).select(
        "qid", t.hazard_of("text").alias("hazard"), t.parsed_out_of_scope("text").alias("out_of_scope")
    )


def horizon_extract(spark, sf_dir):
    return _sentences(spark, sf_dir).select("qid", t.horizon_of("text").alias("horizon_days"))


def place_extract(spark, sf_dir):
    return _sentences(spark, sf_dir).select("qid", t.place_of("text").alias("place"))


def geocode_first(spark, sf_dir):
    return places.geocode(
        places.parse(_sentences(spark, sf_dir)).select("qid", "place"), tables.gazetteer(spark, sf_dir)
    ).select("qid", "place", "name", "latitude", "longitude", "country")


def region_lookup(spark, sf_dir):
    points = tables.read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), (F.col("c_custkey") * 7 % 181 - 90).cast("double").alias("latitude"),
        (F.col("c_custkey") * 13 % 361 - 180).cast("double").alias("longitude")
    )
    return places.region_of(points, tables.regions(spark)).select("id", "acronym", "region")


def input_validation(spark, sf_dir):
    c = tables.read(spark, sf_dir, "customer").select(
        "c_custkey", (F.col("c_acctbal") / 50).alias("lat"), (F.col("c_acctbal") / 25).alias("lon"),
        (F.col("c_custkey") % 20).alias("days")
    )
    return c.select(
        "c_custkey", places.valid_coordinates(F.col("lat"), F.col("lon")).alias("coordinates_ok"),
        places.valid_horizon(F.col("days")).alias("horizon_ok")
    )


def evidence_questions(spark, sf_dir):
    q = places.located(_sentences(spark, sf_dir), tables.gazetteer(spark, sf_dir), tables.regions(spark))
    return q.where("refusal is null").select(
        "qid", t.evidence_question(F.col("hazard"), F.col("location")).alias("question")
    )


def _two_digits(x):
    """Rounded as SQL does, by the nearest whole number of hundredths; Spark's round goes by the shortest decimals."""
    return F.round(x * 100) / 100


def _runs(spark, sf_dir):
    """Located questions with the peak of their nation's series and, for heat, its return levels."""
    q = places.located(_sentences(spark, sf_dir), tables.gazetteer(spark, sf_dir), tables.regions(spark))
    series = tables.daily(spark, sf_dir)
    last = series.groupBy("location").agg(F.max("day").alias("last"))
    recent = series.join(last, "location").where("datediff(last, day) < 7")
    peaks = verdict.forecast_peak(recent).groupBy("location").pivot(
        "variable", ["precipitation_sum", "temperature_2m_max"]
    ).agg(F.max("peak"))
    maxima = extremes.block_maxima(series.where("variable = 'temperature_2m_max'"))
    stats = extremes.return_levels(extremes.gumbel_moments(maxima)).groupBy("location").agg(
        F.array_sort(F.collect_list(F.struct("return_period", _two_digits(F.col("level")).alias("level")))).alias("levels")
    )
    stats = stats.join(extremes.record_summary(maxima).select("location", "n_blocks"), "location")
    known = peaks.join(stats, "location", "left").withColumnRenamed("location", "nation")
    joined = q.withColumn("nation", F.regexp_extract("name", "([0-9]+)$", 1).try_cast("int")).join(known, "nation", "left")
    heat = F.col("hazard") == "heatwave"
    peak = F.when(heat, F.col("temperature_2m_max")).when(
        F.col("hazard") == "extreme_precip", F.col("precipitation_sum")
    ).otherwise(F.col("precipitation_sum") / 2)
    return joined.select(
        "qid", "location", "hazard", "horizon_days", "refusal", _two_digits(peak).alias("peak"),
        F.when(heat, F.lit("temperature_2m_max")).otherwise(F.lit("wind_gusts_10m_max")).alias("variable"),
        F.lit("x").alias("unit"), F.col("n_blocks").alias("n_years"),
        F.when(F.col("hazard").isin("heatwave", "wind"), F.col("levels")).alias("return_levels"),
        F.lit("point_interpolated_reanalysis").alias("representativeness"),
        F.lit(None).cast(
            "struct<significant: boolean, slope_per_decade: double, p_value: double, evaluated_at: double>"
        ).alias("trend"),
        F.when(F.col("qid") % 20 == 0, F.lit("as assessed.")).alias("answer"),
        F.when(
            F.col("qid") % 20 == 0,
            F.array(
                *(F.struct(F.lit(s).alias("source"), F.lit(p).alias("page")) for s, p in (("A", 1), ("A", 1), ("B", 2)))
            )
        ).alias("citations"),
    )


def assess_nl(spark, sf_dir):
    r = verdict.reports(_runs(spark, sf_dir))
    return r.select(
        "qid", "location", "hazard", "horizon_days", "risk_level", "confidence", "refusal",
        F.size("drivers").alias("n_drivers"), F.size("citations").alias("n_citations"), "grounding_status"
    )


def report_text(spark, sf_dir):
    """What a reader sees: summary, drivers and cited pages of each report; without a peak neither of the first two."""
    r = verdict.reports(_runs(spark, sf_dir)).where("refusal is null")
    told = F.transform("drivers", lambda d: F.concat(d["factor"], F.lit("="), d["detail"]))
    drivers = F.when(F.forall(told, lambda x: x.isNotNull()), F.array_join(told, "; "))
    pages = F.array_join(F.transform("citations", lambda c: F.concat(c["source"], F.lit(" "), c["locator"])), ", ")
    return r.select("qid", "summary", drivers.alias("drivers"), pages.alias("citations"))


def report_invariants(spark, sf_dir):
    r = verdict.reports(_runs(spark, sf_dir))
    broken = r.withColumns(
        {
            "confidence": F.when(F.col("qid") % 3 == 0, F.lit(1.5)).otherwise(F.col("confidence")),
            "horizon_days": F.when(F.col("qid") % 4 == 0, F.lit(0)).otherwise(F.col("horizon_days"))
        }
    )
    return verdict.violations(broken).select("qid", F.array_join("violations", ",").alias("violations"))


def report_checks(spark, sf_dir):
    """The checks of assembled reports, rolled up: how many fail which."""
    r = verdict.reports(_runs(spark, sf_dir)).where("refusal is null and risk_level is not null")
    basis = F.get(F.filter("drivers", lambda d: d["factor"] == "severity_basis"), F.lit(0))["detail"]
    has_stat = F.size("drivers") == 3
    checks = {
        "gev_basis_used": F.when(has_stat & (F.col("hazard") != "wind"), F.contains(basis, F.lit("GEV return levels"))),
        "wind_declares_absolute_basis": F.when(
            has_stat & (F.col("hazard") == "wind"), F.contains(basis, F.lit("absolute thresholds"))
        ),
        "confidence_in_composed_range": F.col("confidence").between(0.3, 0.75),
        "citations_deduped": F.size("citations") == F.size(F.array_distinct("citations")),
        "citations_page_level": F.forall("citations", lambda c: F.startswith(c["locator"], F.lit("p"))),
    }
    return verdict.roll_up_checks(r, checks).select("qid", F.array_join("failed", ",").alias("failed"))


def request_status(spark, sf_dir):
    from tephra.plans import api

    c = tables.read(spark, sf_dir, "customer")
    hazard = F.when(F.col("c_custkey") % 11 == 0, "hail").otherwise("wind")
    r = c.select(
        "c_custkey", (F.col("c_acctbal") / 50).alias("latitude"), (F.col("c_acctbal") / 25).alias("longitude"),
        (F.col("c_custkey") % 20).alias("horizon_days"), hazard.alias("hazard"),
        F.when(F.col("c_custkey") % 7 != 0, "key").alias("api_key")
    )
    return api.request_status(r, "key").groupBy("status").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        scope_guard, hazard_classify, horizon_extract, place_extract, geocode_first, region_lookup, input_validation,
        evidence_questions, assess_nl, report_text, report_invariants, report_checks, request_status
    )
}

_quote = lambda s: "'" + s.replace("'", "''") + "'"
_QUESTIONS = f"""
q as (select n_nationkey * 10 + case k when 'click' then 0 when 'view' then 1 when 'purchase' then 2 when 'signup' then 3 else 4 end as qid,
    'How risky are ' || case k when 'click' then 'heat waves' when 'view' then 'rainfall' when 'purchase' then 'winds' when 'signup' then 'droughts' else 'crowds' end || ' in ' ||
    case when n_nationkey % 6 = 5 then 'nowhere' else 'Nation' || (n_nationkey + case when n_nationkey % 8 = 7 then 100 else 0 end) end || ' ' ||
    case n_nationkey % 5 when 0 then 'over the next ' || (n_nationkey + 1) || ' days' when 1 then 'next two weeks' when 2 then 'tomorrow' when 3 then 'within three days' else 'soon' end || '?' as text
  from nation, (select distinct event_type as k from events)
  union all select * from (values {", ".join(f"({-1 - k}, {_quote(s)})" for k, s in enumerate(SENTENCES))}))"""
_SCOPE = f"case when regexp_matches(text, '(?i){t.MARINE_PATTERN}') then 'marine heatwave' when regexp_matches(text, '(?i){t.SUPPORTED_PATTERN}') then null " + " ".join(
    f"when regexp_matches(text, '(?i){p}') then '{n}'" for p, n in t.UNSUPPORTED_PATTERNS.items()
) + " end"
_HAZARD = "case " + " ".join(
    f"when regexp_matches(text, '(?i){p}') then '{h}'" for h, p in t.HAZARD_PATTERNS.items()
) + " end"
_WORDS = "map {" + ", ".join(f"'{w}': {n}" for w, n in t.WORD_NUMBERS.items()) + "}"
_HORIZON = rf"""coalesce(case when regexp_matches(lower(text), 'next\s+\d+\s+days?') then least(regexp_extract(lower(text), 'next\s+(\d+)\s+days?', 1)::bigint, 16) end,
  case when ({_WORDS})[regexp_extract(lower(text), 'next\s+(\w+)\s+weeks?', 1)] is not null then least(({_WORDS})[regexp_extract(lower(text), 'next\s+(\w+)\s+weeks?', 1)] * 7, 16) end,
  case when ({_WORDS})[regexp_extract(lower(text), '(\w+)\s+days?', 1)] is not null then least(({_WORDS})[regexp_extract(lower(text), '(\w+)\s+days?', 1)], 16) end,
  case when regexp_matches(lower(text), '\bnext week\b|\bthis week\b') then 7 when regexp_matches(lower(text), '\bfortnight\b|\btwo weeks\b') then 14 when regexp_matches(lower(text), '\btomorrow\b') then 2 else 7 end)::int"""
_PLACE = rf"""list_filter(list_transform(regexp_extract_all(text, {_quote(t.PLACE_PATTERN)}, 1), lambda x: trim(regexp_replace(x, '\s+(?:Next|This|Over|During|The)\b.*$', ''), '?.!, ')), lambda x: x <> '')[1]"""
_PARSED = f"{_QUESTIONS}, parsed as (select qid, text, {_HAZARD} as hazard0, case when {_HAZARD} is null then {_SCOPE} end as oos, {_PLACE} as place, {_HORIZON} as horizon_days from q)"
_LOCATED = f"""{_PARSED},
gaz as (select 'Nation' || n_nationkey as place, (n_nationkey * 37 % 120 - 60)::double as latitude, (n_nationkey * 83 % 340 - 170)::double as longitude, r_name as country, n_nationkey as nation from nation join region on r_regionkey = n_regionkey),
geo as (select p.*, g.place as name, latitude, longitude, country, nation,
  case when longitude > -180 and longitude < 0 and latitude > 10 and latitude < 60 then 0 when longitude > 0 and longitude < 180 and latitude > 10 and latitude < 60 then 1 when longitude > -180 and longitude < 0 and latitude > -60 and latitude < -10 then 2
    when longitude > 0 and longitude < 100 and latitude > -60 and latitude < -35 or longitude > 0 and longitude < 50 and latitude > -60 and latitude < -10 then 3 end as r from parsed p left join gaz g on p.place = g.place),
loc as (select *, case when oos is not null then oos || ' is not a supported hazard (supported: heatwave, extreme precipitation, wind).' when hazard0 is null then 'could not identify a supported hazard in the question (supported: heatwave, extreme precipitation, wind).'
  when place is null then 'could not identify a location in the question.' when name is null then 'could not resolve the location: ' || place end as refusal from geo),
located as (select *, case when refusal is null then hazard0 end as hazard, case when refusal is not null then text when r is not null then name || ', Region of the ' || ['North-West', 'North-East', 'South-West', 'South-East'][r + 1] || ' (' || ['AAA', 'BBB', 'CCC', 'DDD'][r + 1] || ')' else name || ', ' || country end as location from loc)"""
from tephra.plans.climate import _DAILY, _PEAKS  # noqa: E402

_RUNS = f"""{_LOCATED}, {_DAILY}, {_PEAKS},
pk as (select location as nation, max(peak) filter (where variable = 'precipitation_sum') as precip_peak, max(peak) filter (where variable = 'temperature_2m_max') as temp_peak from peaks group by 1),
lv as (select location as nation, round(max(level) filter (where return_period = 10), 2) as l10, round(max(level) filter (where return_period = 50), 2) as l50, round(max(level) filter (where return_period = 100), 2) as l100 from levels group by 1),
runs as (select qid, l.location, hazard, horizon_days, refusal, round(case hazard when 'heatwave' then temp_peak when 'extreme_precip' then precip_peak else precip_peak / 2 end, 2) as peak, hazard in ('heatwave', 'wind') and l10 is not null as has_stat, l10, l50, l100, qid % 20 = 0 as answered, nation
  from located l left join pk using (nation) left join lv using (nation)),
rep as (select qid, location, hazard, horizon_days, refusal,
  case when refusal is not null or peak is null then null when hazard = 'heatwave' and has_stat then case when peak >= l100 then 'SEVERE' when peak >= l50 then 'HIGH' when peak >= l10 then 'MODERATE' else 'LOW' end
    when hazard = 'heatwave' then case when peak < 35 then 'LOW' when peak < 40 then 'MODERATE' when peak < 45 then 'HIGH' else 'SEVERE' end
    when hazard = 'extreme_precip' then case when peak < 20 then 'LOW' when peak < 50 then 'MODERATE' when peak < 100 then 'HIGH' else 'SEVERE' end
    else case when peak < 40 then 'LOW' when peak < 62 then 'MODERATE' when peak < 88 then 'HIGH' else 'SEVERE' end end as risk_level,
  case when refusal is not null then 0.0::double else round(least(0.3 + case when has_stat then 0.25 else 0 end + case when answered then 0.1 else 0 end, 0.75)::double, 2) end as confidence,
  case when refusal is not null then null when has_stat then 3 else 1 end::int as n_drivers, case when refusal is not null then null when answered then 2 else 0 end::int as n_citations,
  case when refusal is null then case when answered then 'grounded' else 'ungrounded' end end as grounding_status from runs)"""

ORACLES = {
    "request_status": "select case when c_custkey % 7 = 0 then 401 when c_custkey % 11 = 0 or c_acctbal / 50 not between -90 and 90 or c_acctbal / 25 not between -180 and 180 or c_custkey % 20 not between 1 and 16 then 422 else 200 end as status, count(*) as n from customer group by 1",
    "scope_guard": f"with {_QUESTIONS} select qid, {_SCOPE} as out_of_scope from q",
    "hazard_classify": f"with {_PARSED} select qid, hazard0 as hazard, oos as out_of_scope from parsed",
    "horizon_extract": f"with {_PARSED} select qid, horizon_days from parsed",
    "place_extract": f"with {_PARSED} select qid, place from parsed",
    "geocode_first": f"with {_LOCATED} select qid, place, name, latitude, longitude, country from located",
    "region_lookup": """with p as (select c_custkey as id, c_custkey * 7 % 181 - 90 as lat, c_custkey * 13 % 361 - 180 as lon from customer),
r as (select *, case when lon > -180 and lon < 0 and lat > 10 and lat < 60 then 0 when lon > 0 and lon < 180 and lat > 10 and lat < 60 then 1 when lon > -180 and lon < 0 and lat > -60 and lat < -10 then 2
  when lon > 0 and lat > -60 and (lon < 100 and lat < -35 or lon < 50 and lat < -10) then 3 end as r from p)
select id, ['AAA', 'BBB', 'CCC', 'DDD'][r + 1] as acronym, case when r is not null then 'Region of the ' || ['North-West', 'North-East', 'South-West', 'South-East'][r + 1] end as region from r""",
    "input_validation": "select c_custkey, c_acctbal / 50 between -90 and 90 and c_acctbal / 25 between -180 and 180 as coordinates_ok, c_custkey % 20 between 1 and 16 as horizon_ok from customer",
    "evidence_questions": f"with {_LOCATED} select qid, 'How are ' || case hazard when 'heatwave' then 'hot extremes and extreme heat' when 'extreme_precip' then 'heavy precipitation and extreme rainfall' else 'mean wind speed and wind extremes' end || ' projected to change in intensity and frequency over ' || location || ' at higher global warming levels?' as question from located where refusal is null",
    "assess_nl": f"with {_RUNS} select * from rep",
    "report_text": f"""with {_RUNS},
t as (select r.qid, r.hazard, r.horizon_days, peak::varchar as peak, has_stat, answered, risk_level, n_blocks, printf('%.1f', peak / 3.6) as ms, '10yr=' || round(l10, 1)::varchar || ', 50yr=' || round(l50, 1)::varchar || ', 100yr=' || round(l100, 1)::varchar as levels
  from runs r join rep using (qid) left join summary s on s.location = r.nation where r.refusal is null)
select qid,
  case hazard when 'extreme_precip' then 'Peak daily rainfall of ' || peak || ' mm over ' || horizon_days || ' days.' when 'heatwave' then 'Peak daily max temperature of ' || peak || ' °C over ' || horizon_days || ' days.' else 'Peak daily wind of ' || peak || ' km/h (' || ms || ' m/s) over ' || horizon_days || ' days.' end
    || case when has_stat then ' ERA5 return levels (' || levels || ').' else '' end || case when answered then ' IPCC AR6: as assessed.' else '' end as summary,
  case hazard when 'extreme_precip' then 'precipitation=max daily ' || peak || ' mm' when 'heatwave' then 'temperature=max daily ' || peak || ' °C' else 'wind=max daily ' || peak || ' km/h (' || ms || ' m/s)' end
    || case when has_stat and hazard = 'heatwave' then '; climatology=' || n_blocks || '-yr ERA5 GEV (temperature_2m_max); severity_basis=forecast peak ' || peak || ' x vs GEV return levels (' || levels || ') -> ' || risk_level
      when has_stat then '; climatology=' || n_blocks || '-yr ERA5 GEV (wind_gusts_10m_max); severity_basis=absolute thresholds (forecast/climatology variable mismatch: wind_speed_10m_max vs wind_gusts_10m_max)' else '' end as drivers,
  case when answered then 'A p1, B p2' else '' end as citations from t""",
    "report_invariants": f"""with {_RUNS}, b as (select qid, hazard, risk_level, refusal, case when qid % 3 = 0 then 1.5 else confidence end as c, case when qid % 4 = 0 then 0 else horizon_days end as h from rep)
select qid, array_to_string(list_filter([case when (risk_level is null) = (refusal is null) then 'exactly_one_of_level_and_refusal' end, case when hazard is null and refusal is null then 'hazard_missing_without_refusal' end, case when h <= 0 then 'horizon_not_positive' end, case when c not between 0 and 1 then 'confidence_out_of_range' end], lambda x: x is not null), ',') as violations from b""",
    "report_checks": f"with {_RUNS} select qid, '' as failed from rep where refusal is null and risk_level is not null",
}
