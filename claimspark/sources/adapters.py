"""Adapters: how a source's landed body is fetched and what its events are.

A source names its adapter, or else its own id is the adapter's name. ``run`` fetches and parses a source through it: events, parked
rows and warnings, in the same columns for every adapter.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimspark.operators import listings, tabular
from claimspark.sources import formats

#: Columns of the events that every adapter gives.
EVENT = ("document", "source_event_key", "artist_name", "artist_external_id", "artist_location", "venue_name", "venue_external_id", "venue_location", "date", "start_time", "event_url", "time_defaulted")


class Parsed(NamedTuple):
    """events (EVENT), parked (document, reason, body), warnings (document, n, warning)."""

    events: DataFrame
    parked: DataFrame
    warnings: DataFrame


class Adapter(NamedTuple):
    """``fetch`` (spark, path) gives the landed rows, ``parse`` (rows, the run's date as yyyy-mm-dd) what they say."""

    fetch: Callable[[SparkSession, str], DataFrame]
    parse: Callable[[DataFrame, str], Parsed]


ADAPTERS: dict[str, Adapter] = {}


def register(name: str, adapter: Adapter) -> None:
    """Make an adapter known by a name; one of another name may be put in its place only under a new name."""
    if name in ADAPTERS:
        raise ValueError(f"adapter {name} is known already")
    ADAPTERS[name] = adapter


def adapter_of(source_id: str, adapter: str | None = None) -> Adapter:
    """The source's adapter, or that of its id; an error if neither is known."""
    name = adapter or source_id
    if name not in ADAPTERS:
        raise LookupError(f"no adapter {name}")
    return ADAPTERS[name]


def run(spark: SparkSession, source_id: str, path: str, run_date: str, adapter: str | None = None) -> Parsed:
    """Fetch and parse a source's landed files."""
    found = adapter_of(source_id, adapter)
    return found.parse(found.fetch(spark, path), run_date)


def fetched(name: str) -> Callable[[SparkSession, str], DataFrame]:
    """A fetch of landed files by one of the formats."""
    return lambda spark, path: formats.register(spark).read.format(name).option("path", path).load()


def listing(site: listings.Site = listings.Site()) -> Adapter:  # noqa: B008
    """Text listings: lines below day headers. A set of pages without one recognised line is an error, no empty snapshot."""

    def parse(rows: DataFrame, run_date: str) -> Parsed:
        found = listings.gate(listings.listed(rows, "document", "line", "body", int(run_date[:4]), site))
        events = listings.listed_events(found, site, ("document",))
        late = events.where("time_defaulted").groupBy("document").agg(F.count("*").alias("n"))
        warnings = late.select("document", "n", F.concat(F.col("n").cast("string"), F.lit(f" time(s) defaulted to {site.time}")).alias("warning"))
        return Parsed(events.select(*EVENT), listings.parked(found).select("document", "reason", "body"), warnings)

    return Adapter(fetched("listing"), parse)


def sheet(prefix: str = "sheet", location: str = "Staffordshire UK") -> Adapter:
    """Delimited sheets: rows with a readable date from the run's on."""

    def parse(rows: DataFrame, run_date: str) -> Parsed:
        marked = rows.withColumn("row_index", F.concat_ws("#", "document", F.col("row_index").cast("string")))
        found = tabular.normalised(marked, F.to_date(F.lit(run_date)), prefix, location).withColumn("document", F.regexp_extract("raw_row_ref", "^row:(.*)#[0-9]+$", 1))
        events = found.withColumnsRenamed({"start_time_defaulted": "time_defaulted", "town": "venue_location"})
        told = found.select("document", F.explode("warnings").alias("warning")).groupBy("document", "warning").agg(F.count("*").alias("n"))
        none = rows.where(F.lit(False)).select("document", F.lit("").alias("reason"), F.lit("").alias("body"))
        return Parsed(events.select(*EVENT), none, told.select("document", "n", "warning"))

    return Adapter(fetched("sheet"), parse)


register("listing", listing())
register("sheet", sheet())
