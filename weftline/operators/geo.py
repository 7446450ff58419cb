"""Places: names to coordinates and countries to outlines, from tables that the user supplies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from weftline.registry import transform
from weftline.semantics import col, need

_TABLES: dict[str, DataFrame] = {}
ADDED = ["latitude", "longitude", "country", "iso2", "iso3"]


def set_gazetteer(places: DataFrame) -> None:
    """The table of places: ``kind`` (country or city), ``name``, ``alternates`` (array), ``country``, ``iso2``,
    ``iso3``, ``latitude``, ``longitude`` (a country's are its capital's), ``population``."""
    need(places, ["kind", "name", "alternates", "country", "iso2", "iso3", "latitude", "longitude", "population"])
    _TABLES["places"] = places


def set_contours(outlines: DataFrame) -> None:
    """The table of outlines: ``iso3, geometry`` (GeoJSON)."""
    need(outlines, ["iso3", "geometry"])
    _TABLES["contours"] = outlines


def place_key(name: Column) -> Column:
    """A name for comparison: trimmed, single blanks, small letters, without a leading article."""
    c = F.lower(F.trim(F.regexp_replace(name, r"[\s ]+", " ")))
    return F.regexp_replace(c, r"^the ", "")


@transform("geocode_location", df="DATAFRAME", column="COLUMN_NAME", scope="STRING")
def geocode_location(df: DataFrame, column: str, scope: str = "unknown", gazetteer: DataFrame | None = None) -> DataFrame:
    """``latitude, longitude, country, iso2, iso3`` of each name; null where it is unknown.

    Countries match by code or name, then cities by name and by other names; the larger population wins.
    ``scope`` country or city keeps to one kind. Distinct names are matched once and joined back.
    """
    need(df, [column], "Column")
    places = gazetteer if gazetteer is not None else _TABLES.get("places")
    if places is None:
        raise ValueError("no gazetteer: call set_gazetteer, or give one")
    if scope in ("country", "city"):
        places = places.where(F.col("kind") == scope)
    country = F.col("kind") == "country"
    spelled = F.concat(
        F.when(country, F.array(F.struct(F.lit(0).alias("rank"), F.col("iso2").alias("key")), F.struct(F.lit(1).alias("rank"), F.col("iso3").alias("key")), F.struct(F.lit(2).alias("rank"), F.col("name").alias("key")))).otherwise(F.array(F.struct(F.lit(4).alias("rank"), F.col("name").alias("key")))),
        F.transform(F.coalesce("alternates", F.array().cast("array<string>")), lambda a: F.struct(F.when(country, 3).otherwise(5).alias("rank"), a.alias("key"))),
    )
    keys = places.select(F.explode(spelled).alias("s"), *ADDED, "population").select(place_key(F.col("s.key")).alias("_k"), F.col("s.rank").alias("_r"), *ADDED, "population")
    best = keys.where("_k is not null and _k <> ''").groupBy("_k").agg(F.min_by(F.struct(*ADDED), F.struct("_r", (-F.coalesce("population", F.lit(0))).alias("p"), "iso3", "latitude")).alias("_place"))
    found = df.select(col(column).cast("string").alias("_name")).where("_name is not null").distinct().withColumn("_k", place_key(F.col("_name"))).join(best, "_k").select("_name", "_place")
    out = df.drop(*ADDED).join(found, col(column).cast("string") == found["_name"], "left")
    return out.select(*[col(c) for c in df.columns if c not in ADDED], *[F.col(f"_place.{c}").alias(c) for c in ADDED])


@transform("get_country_contours", df="DATAFRAME", column="COLUMN_NAME")
def get_country_contours(df: DataFrame, column: str, contours: DataFrame | None = None) -> DataFrame:
    """``geometry`` (GeoJSON) by the ISO3 code in a column; null where there is none."""
    need(df, [column], "Column")
    outlines = contours if contours is not None else _TABLES.get("contours")
    if outlines is None:
        raise FileNotFoundError("no outlines: call set_contours, or give them")
    o = outlines.groupBy(F.upper(F.trim("iso3")).alias("_iso3")).agg(F.first("geometry").alias("geometry"))
    return df.join(o, F.upper(F.trim(col(column).cast("string"))) == F.col("_iso3"), "left").drop("_iso3")
