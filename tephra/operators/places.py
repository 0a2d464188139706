"""Places: gazetteer lookup, point in region, and the free-text front door."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tephra.functions import text as t
from tephra.operators.retrieval import small

# FIXED VALUES: refusals of the front door.
SUPPORTED = "(supported: heatwave, extreme precipitation, wind)."


def valid_coordinates(lat: Column, lon: Column) -> Column:
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))


def valid_horizon(days: Column) -> Column:
    return F.coalesce(days.between(1, t.MAX_HORIZON), F.lit(False))


def geocode(queries: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """``queries`` (qid, place, …) with the gazetteer's first entry of that name; nulls where there is none.

    ``gazetteer`` has place, ord, name, latitude, longitude, country. Its best row of each name is chosen first, by a
    pre-aggregated minimum, so that no name's rows meet in one task.
    """
    best = gazetteer.groupBy("place").agg(F.min(F.struct("ord", "name", "latitude", "longitude", "country")).alias("g"))
    return queries.join(small(best), "place", "left").select(
        *queries.columns, "g.name", "g.latitude", "g.longitude", "g.country"
    )


def inside(lat: Column, lon: Column, ring: Column) -> Column:
    """Point strictly inside a ring of struct<lon, lat>, by the number of edges a ray to the east crosses."""
    n = F.size(ring)
    edge = lambda i: (ring[i], ring[F.pmod(i + 1, n)])

    def crosses(i):
        a, b = edge(i)
        straddles = (a["lat"] > lat) != (b["lat"] > lat)
        at = (b["lon"] - a["lon"]) * (lat - a["lat"]) / F.nullif(b["lat"] - a["lat"], F.lit(0.0)) + a["lon"]
        return straddles & (lon < at)

    def touches(i):
        a, b = edge(i)
        cross = (b["lon"] - a["lon"]) * (lat - a["lat"]) - (b["lat"] - a["lat"]) * (lon - a["lon"])
        return (cross == 0) & lon.between(
            F.least(a["lon"], b["lon"]), F.greatest(a["lon"], b["lon"])
        ) & lat.between(F.least(a["lat"], b["lat"]), F.greatest(a["lat"], b["lat"]))

    steps = F.sequence(F.lit(0), n - 1)
    crossed = F.size(F.filter(steps, crosses)) % 2 == 1
    return (n >= 3) & crossed & ~F.exists(steps, touches)


def region_of(points: DataFrame, regions: DataFrame) -> DataFrame:
    """``points`` (latitude, longitude, …) with acronym and region of the first region, by ord, that contains them.

    ``regions`` is a dimension (ord, acronym, name, ring) that travels whole, as one row; a point outside every region, on a
    boundary or without coordinates has nulls. Every point stays one row: regions are searched inside it.
    """
    packed = regions.agg(F.array_sort(F.collect_list(F.struct("ord", "acronym", "name", "ring"))).alias("all"))
    hit = F.get(F.filter("all", lambda r: inside(F.col("latitude"), F.col("longitude"), r["ring"])), F.lit(0))
    return points.join(F.broadcast(packed)).withColumn("hit", hit).select(
        *points.columns, F.col("hit.acronym").alias("acronym"), F.col("hit.name").alias("region")
    )


def parse(queries: DataFrame) -> DataFrame:
    """(qid, text) -> qid, text, hazard, out_of_scope, place, horizon_days."""
    return queries.select(
        "qid", "text", t.hazard_of("text").alias("hazard"), t.parsed_out_of_scope("text").alias("out_of_scope"),
        t.place_of("text").alias("place"), t.horizon_of("text").alias("horizon_days")
    )


def located(queries: DataFrame, gazetteer: DataFrame, regions: DataFrame) -> DataFrame:
    """Parsed questions with coordinates, a location label and the first refusal that applies, if any."""
    found = region_of(geocode(parse(queries), gazetteer), regions)
    label = t.location_label(
        F.col("name"), F.when(F.col("region").isNotNull(), F.format_string("%s (%s)", "region", "acronym")),
        F.col("country")
    )
    refusal = (
        F.when(F.col("out_of_scope").isNotNull(), F.concat("out_of_scope", F.lit(f" is not a supported hazard {SUPPORTED}")))
        .when(F.col("hazard").isNull(), f"could not identify a supported hazard in the question {SUPPORTED}")
        .when(F.col("place").isNull(), "could not identify a location in the question.")
        .when(F.col("name").isNull(), F.concat(F.lit("could not resolve the location: "), "place"))
    )
    return found.withColumns(
        {"refusal": refusal, "location": F.when(refusal.isNull(), label).otherwise(F.col("text"))}
    ).withColumn("hazard", F.when(F.col("refusal").isNull(), F.col("hazard")))
