"""From found places to the tables of stores, pages, judgements and operators; a stage without its table is skipped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical_key, nz, sanitize
from .judge import derived
from .master import bridged
from .writes import last_wins


def stored_places(places: DataFrame, brand: str) -> DataFrame:
    """Found places as stores of a brand: clean text, each id once, the last found; rows without an id all stay."""
    clean = places.withColumns({c: sanitize(c) for c in ("name", "address", "phone") if c in places.columns}).withColumns({"official_url": F.trim(nz("official_url")), "brand": F.lit(brand)})
    named = clean.where(nz("place_id") != "")
    return last_wins(named, ["place_id"], ["name", "address"]).unionByName(clean.where(nz("place_id") == ""))


def pages_of(stores: DataFrame, recorded: DataFrame) -> DataFrame:
    """Recorded pages (url, title, markdown, metadata map) of stores with a URL; the place is the one that the metadata name, else the store's."""
    met = stores.where(nz("official_url") != "").select("place_id", F.col("official_url").alias("url")).join(recorded, "url")
    return met.withColumn("place_id", F.coalesce(F.nullif(F.element_at("metadata", "place_id"), F.lit("")), F.col("place_id").cast("string"))).dropDuplicates(["url"])


def canonicalised(names: DataFrame, recorded: DataFrame | None = None) -> DataFrame:
    """name, canonical: as a recorded model wrote it (name, canonical), else its canonical key."""
    keyed = names.select("name").distinct().withColumn("key", canonical_key("name"))
    if recorded is None:
        return keyed.select("name", F.col("key").alias("canonical"))
    told = recorded.groupBy("name").agg(F.min("canonical").alias("canonical"))
    return keyed.join(told, "name", "left").select("name", F.coalesce(F.nullif(nz("canonical"), F.lit("")), "key").alias("canonical"))


def bake(places: DataFrame, brand: str, recorded_pages: DataFrame | None = None, recorded_judgements: DataFrame | None = None) -> dict[str, DataFrame]:
    """stores, and with recorded pages documents, and with recorded judgements (place_id and their fields) judgements and operator_stores."""
    out = {"stores": stored_places(places, brand)}
    if recorded_pages is not None:
        out["documents"] = pages_of(out["stores"], recorded_pages)
    if recorded_judgements is not None:
        judged = derived(recorded_judgements.join(out["stores"].select("place_id"), "place_id", "left_semi"))
        out["judgements"] = judged
        out["operator_stores"] = bridged(judged)
    return out
