"""A delimited source: its alignment, normalised events, claims of three kinds of subjects, towns and regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimspark.functions import text, times

COLUMNS = ("date", "artist", "venue", "time", "genre", "url")
#: Towns in the order in which they are looked for; those of PARTS belong to the default town.
TOWNS = (
    "Stoke-on-Trent", "Newcastle-under-Lyme", "Hanley", "Burslem", "Longton", "Tunstall", "Fenton", "Kidsgrove", "Leek", "Stone", "Stafford", "Uttoxeter", "Cheadle", "Crewe", "Macclesfield",
    "Haslington", "Sandbach", "Congleton", "Nantwich", "Alsager", "Wilmslow", "Knutsford",
)
PARTS = ("Hanley", "Burslem", "Longton", "Tunstall", "Fenton")
DEFAULT_TOWN = "Stoke-on-Trent"
#: Towns of two regions in the order in which they are looked for; the second region is the default.
REGIONS = (
    ("Cheshire", ("Crewe", "Macclesfield", "Haslington", "Sandbach", "Congleton", "Nantwich", "Alsager", "Wilmslow", "Knutsford", "Audlem")),
    ("Staffordshire", (
        "Stoke-on-Trent", "Stone", "Leek", "Newcastle-under-Lyme", "Newcastle", "Stafford", "Uttoxeter", "Cheadle", "Biddulph", "Kidsgrove", "Ipstones", "Wyrley", "Burslem", "Hartshill",
        "Meir", "Forsbrook", "Sandyford", "Smallthorne",
    )),
)
#: Beginnings of the slugs of places whose events are special, or have several acts.
SPECIALIST, SEVERAL_ACTS = ("artisan-tap", "eleven"), ("the-rigger",)
#: A sheet's own notices.
NOTICES = "(?i)you can add|keep live music alive|@everyone"


def misaligned(first_line: Column) -> Column:
    """Whether a sheet's first column is an empty one that doesn't belong to it."""
    return first_line.rlike('^(,|"",)')


def realigned(rows: DataFrame) -> DataFrame:
    """Rows without their first column, six columns at most."""
    return rows.select(*rows.columns[1:7])


def preferred(*sources: DataFrame) -> DataFrame:
    """The first of several readings of a source that has rows at all (of equal columns)."""
    for rows in sources[:-1]:
        if not rows.isEmpty():
            return rows
    return sources[-1]


def town(venue: Column) -> Column:
    """struct(town, defaulted): the first town that the name holds."""
    return text.let(text.first_contained(venue, TOWNS), lambda found: F.struct(F.when(found.isin(*PARTS), F.lit(DEFAULT_TOWN)).otherwise(F.coalesce(found, F.lit(DEFAULT_TOWN))).alias("town"), found.isNull().alias("defaulted")))


def region(venue: Column) -> Column:
    """struct(region, city): by the towns of each region in turn, or else the name's last part after a comma in the default region."""
    cities = F.array(*(F.struct(F.lit(name).alias("region"), text.first_contained(venue, towns).alias("city")) for name, towns in REGIONS))
    other = F.struct(F.lit(REGIONS[-1][0]).alias("region"), text.trimmed(F.regexp_extract(venue, r",\s*([^,]+)$", 1)).alias("city"))
    return F.coalesce(F.try_element_at(F.filter(cities, lambda x: x["city"].isNotNull()), F.lit(1)), other)


def aliased(rows: DataFrame, clusters: DataFrame, venue: str = "venue_name") -> DataFrame:
    """``rows`` with canonical and trusted_id of their place, by slugs; ``clusters`` (variant, canonical, trusted_id) lists other names, the canonical ones too."""
    known = clusters.select(text.place_slug(text.trimmed(F.col("variant"))).alias("_slug"), "canonical", "trusted_id").groupBy("_slug").agg(F.max("canonical").alias("canonical"), F.max("trusted_id").alias("trusted_id"))
    return rows.withColumn("_slug", text.place_slug(text.trimmed(F.col(venue)))).join(known, "_slug", "left").drop("_slug")


def specialist(slug: Column) -> Column:
    return text.begins_with_any(slug, SPECIALIST)


def several_acts(slug: Column) -> Column:
    return text.begins_with_any(slug, SEVERAL_ACTS)


def additive(rows: DataFrame) -> DataFrame:
    """``rows`` (town_defaulted, trusted_id, venue_slug) with refusal: why an event mustn't be added without review, or null."""
    why = F.when(F.col("town_defaulted") & F.nullif(F.col("trusted_id"), F.lit("")).isNull(), "defaulted town without trusted place").when(specialist(F.col("venue_slug")), "specialist place")
    return rows.withColumn("refusal", why)


def _key(prefix: str, x: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(x, 256), 1, 12))


def normalised(rows: DataFrame, today: Column, prefix: str = "sheet", location: str = "Staffordshire UK") -> DataFrame:
    """Events of ``rows`` (row_index and COLUMNS): without artist or place, an unreadable or past date, and notices are left out.

    warnings says what was defaulted, in order; keys are digests of date, place and artist in lower case.
    """
    full = rows.select("row_index", *(text.trimmed(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in COLUMNS)).where("artist <> '' and venue <> ''")
    full = full.withColumns({"day": times.uk_date(F.col("date")), "artist_name": text.squeezed(F.col("artist")), "venue_name": text.squeezed(F.col("venue"))})
    full = full.where((F.col("day") >= today) & ~F.concat_ws(" ", "artist_name", "venue_name").rlike(NOTICES))
    full = full.withColumns({"_town": town(F.col("venue_name")), "_time": times.stage_time(F.col("time"))})
    low = lambda c: F.lower(F.col(c))
    late = F.when(F.col("_town.defaulted"), F.concat(F.lit(f"Town defaulted to {DEFAULT_TOWN} for '"), F.col("venue_name"), F.lit("'")))
    return full.select(
        _key(f"{prefix}-", F.concat_ws("|", F.col("day").cast("string"), low("venue_name"), low("artist_name"))).alias("source_event_key"), F.col("day").cast("string").alias("date"),
        F.col("_time.time").alias("start_time"), F.col("_time.defaulted").alias("start_time_defaulted"), "artist_name", _key(f"{prefix}-artist-", low("artist_name")).alias("artist_external_id"),
        F.lit(location).alias("artist_location"), "venue_name", _key(f"{prefix}-venue-", low("venue_name")).alias("venue_external_id"), F.col("_town.town").alias("town"),
        F.nullif(F.col("genre"), F.lit("")).alias("genre"), F.when(F.col("url").rlike("(?i)^https?://"), F.col("url")).alias("event_url"),
        F.concat(F.lit("row:"), F.col("row_index").cast("string")).alias("raw_row_ref"), F.array_compact(F.array(F.col("_time.warning"), late)).alias("warnings"),
    )


def claims(events: DataFrame, observation: str, source: str) -> DataFrame:
    """Twelve to fourteen claims of each event: of its artist, its place and itself (claim_id, subject_type, subject, predicate, value, is_object, source_event_key, evidence)."""
    artist, venue, event = (F.concat(F.lit(f"{k}:"), F.col(c)) for k, c in (("artist", "artist_external_id"), ("venue", "venue_external_id"), ("event", "source_event_key")))
    ref = lambda kind, key: F.to_json(F.struct(F.lit(f"{kind}-candidate").alias("type"), key.alias("key")))
    made = [
        ("artist", artist, "hasName", F.col("artist_name"), False), ("artist", artist, "hasGenre", F.col("genre"), False), ("venue", venue, "hasName", F.col("venue_name"), False),
        ("venue", venue, "locatedIn", F.col("town"), False), ("event", event, "hasPerformer", ref("artist", artist), True), ("event", event, "hasPerformerName", F.col("artist_name"), False),
        ("event", event, "occursAt", ref("venue", venue), True), ("event", event, "hasVenueName", F.col("venue_name"), False), ("event", event, "occursOn", F.col("date"), False),
        ("event", event, "startsAt", F.col("start_time"), False), ("event", event, "hasStatus", F.lit("scheduled"), False), ("event", event, "reportedBy", F.lit(source), False),
        ("event", event, "derivedFrom", F.lit(observation), False), ("event", event, "hasEventUrl", F.col("event_url"), False),
    ]
    row = lambda k, s, p, v, o: F.struct(F.lit(f"{k}-candidate").alias("subject_type"), s.alias("subject"), F.lit(p).alias("predicate"), v.alias("value"), F.lit(o).alias("is_object"))
    out = events.select("source_event_key", F.col("raw_row_ref").alias("evidence"), F.inline(F.filter(F.array(*(row(*m) for m in made)), lambda c: c["value"].isNotNull())))
    json = F.when(F.col("is_object"), F.col("value")).otherwise(text.json_string(F.col("value")))
    key = F.concat(F.lit("claim-"), F.substring(F.sha2(F.concat(F.lit(f"{observation}|"), F.col("subject"), F.lit("|"), F.col("predicate"), F.lit("|"), json), 256), 1, 24))
    return out.withColumns({"claim_id": key, "observation_id": F.lit(observation), "source_id": F.lit(source), "confidence": F.lit(0.9), "status": F.lit("active")})


def matching(events: DataFrame, words: str, most: int) -> DataFrame:
    """The first ``most`` events, in the order of their rows, whose artist and place hold the words in any case."""
    both = F.lower(F.concat_ws(" ", "artist_name", "venue_name"))
    at = F.regexp_extract("raw_row_ref", "([0-9]+)$", 1).cast("long")
    return events.where(F.contains(both, F.lit(words.lower()))).orderBy(at, "source_event_key").limit(most)


def run_report(projections: DataFrame, failures: DataFrame) -> DataFrame:
    """(action, n) of the projections' actions, and the number of exceptions as one of them."""
    counts = projections.groupBy("action").agg(F.count("*").alias("n"))
    return counts.unionByName(failures.agg(F.count("*").alias("n")).select(F.lit("exception").alias("action"), "n"))
