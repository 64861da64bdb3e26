"""Text listings: lines below day headers become events, or are parked with a reason; built-in expressions only.

What is peculiar to one site (aliases and flagged places, footers, the default place and time) is a parameter.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimspark.functions import text, times
from claimspark.operators import assess


class Site(NamedTuple):
    """Fixed values of a listing: patterns in the order in which they are tried, names of places, and defaults."""

    placeholders: tuple[str, ...] = (r"^reserved$", r"^reserved\s*-", "^closed$", "^live bands?$", "^tbc$", "^to be confirmed$")
    jams: tuple[str, ...] = ("jam$", r"jam\s*night$", r"blues\s*jam")
    generic: tuple[str, ...] = (r"open\s*mic", "karaoke", "^disco$", r"music\s*quiz", r"^quiz\s*night$", r"^jazz(\s*night)?$", "^football$")
    djs: tuple[str, ...] = (r"^dj\s+\w+$",)
    footers: tuple[str, ...] = ("recording my songs", "my bands", "contact", r"^[0-9]{5}\s+[0-9]{6}$", "email:")
    venue_search: str = "looking for a venue"
    venue_suffix: str = r"-\s*(branded|reserved)\b"
    aliases: tuple[tuple[str, str], ...] = ()
    flagged: tuple[str, ...] = ()
    time: str = "20:00"
    locality: str = ""
    region: str = ""


def any_of(x: Column, patterns: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | x.rlike(f"(?i){p}")
    return F.coalesce(out, F.lit(False))


def place(venue: Column, site: Site) -> Column:
    """The name by which a place is known."""
    if not site.aliases:
        return venue
    known = F.create_map(*[F.lit(x) for pair in site.aliases for x in pair])
    return F.coalesce(known[F.lower(text.trimmed(venue))], venue)


#: What :func:`classified` finds in a line.
FIELDS = ("artist", "venue", "time", "reason")


def classified(line: Column, site: Site = Site()) -> Column:  # noqa: B008
    """struct(artist, venue, time, reason) of a line: reason is null for an event, '' for a line that says nothing.

    Forms in order: a footer; ``artist - venue``; ``- venue``; ``artist at venue, time``; ``venue, time``. A time may end the artist
    of the first form (``artist from 8pm - venue``). Kinds of performers are told before kinds of places.
    """
    tail = lambda x, n: text.trimmed(F.substr(x, n))
    head = lambda x, n: text.trimmed(F.substr(x, F.lit(1), n - 1))
    blank = F.lit(None).cast("string")
    ends = r"(?i)\s+([0-9]{1,2}:?[0-9]{0,2}\s*(?:am|pm))\s*$"

    def row(artist: Column, venue: Column, time: Column, reason: Column) -> Column:
        return F.struct(artist.alias("artist"), venue.alias("venue"), time.alias("time"), reason.alias("reason"))

    def performer(artist: Column) -> Column:
        kinds = ((site.placeholders, "placeholder_performer"), (site.jams, "jam_night"), (site.generic, "generic_recurring"), (site.djs, "generic_dj"))
        return F.coalesce(*(F.when(any_of(artist, patterns), F.lit(kind)) for patterns, kind in kinds))

    def venue_kind(venue: Column) -> Column:
        flagged = any_of(venue, tuple(f"\\Q{v}\\E" for v in site.flagged))
        return F.coalesce(F.when(venue.rlike(f"(?i){site.venue_search}"), F.lit("placeholder_venue")), F.when(flagged, F.lit("venue_geocode_risk")))

    def timed(x: Column) -> Column:
        """Artist and time of what stands before a dash."""
        bare = text.trimmed(F.regexp_replace(text.trimmed(F.regexp_replace(x["artist"], ends, "")), r"(?i)\s+from$", ""))
        time = F.when(x["artist"].rlike(ends), F.coalesce(times.clock(F.regexp_extract(x["artist"], ends, 1)), F.lit("")))
        return row(F.when(x["artist"].rlike(ends), bare).otherwise(x["artist"]), x["venue"], time, blank)

    def dashed(x: Column) -> Column:
        kind = lambda y: row(y["artist"], y["venue"], y["time"], F.coalesce(performer(y["artist"]), venue_kind(y["venue"])))
        return F.when(x["artist"] == "", row(blank, x["venue"], blank, F.lit("venue_only"))).otherwise(text.let(timed(x), kind))

    def spoken(x: Column) -> Column:
        """``artist at venue, time``: kinds of performers are told before the time is cut off."""
        last = F.length(x["venue"]) - F.length(F.substring_index(x["venue"], ",", -1))
        parted = F.when(last > 1, row(x["artist"], head(x["venue"], last), times.clock(tail(x["venue"], last + 1)), blank)).otherwise(row(x["artist"], x["venue"], blank, blank))
        kind = lambda y: row(y["artist"], y["venue"], y["time"], venue_kind(y["venue"]))
        early = performer(x["artist"])
        return F.when(early.isNotNull(), row(x["artist"], x["venue"], blank, early)).otherwise(text.let(parted, kind))

    def form(x: Column) -> Column:
        t, dash, at, comma = x["t"], x["dash"], x["at"], x["comma"]
        nothing = row(blank, blank, blank, F.lit(""))
        pair = lambda n, skip: row(head(t, n), tail(t, n + skip), blank, blank)
        return (
            F.when(any_of(t, site.footers), nothing).when(dash > 1, text.let(pair(dash, 3), dashed)).when(F.startswith(t, F.lit("- ")), row(blank, tail(t, F.lit(3)), blank, F.lit("venue_only")))
            .when(at > 0, text.let(pair(at, 4), spoken)).when(comma > 1, row(blank, head(t, comma), times.clock(tail(t, comma + 1)), F.lit("venue_only"))).otherwise(nothing)
        )

    def late(x: Column) -> Column:
        """What is told only when artist and venue are known."""
        date_row = x["artist"].rlike(rf"(?i)^({'|'.join(times.DAYS)})\s+[0-9]{{1,2}}(st|nd|rd|th)\s+\w+")
        time_row = x["artist"].rlike(r"(?i)^[0-9]{1,2}([:.][0-9]{2})?\s*(am|pm)$")
        missing = F.nullif(x["artist"], F.lit("")).isNull() | F.nullif(x["venue"], F.lit("")).isNull()
        why = F.when(date_row, "footer_date_row").when(time_row, "time_not_artist").when(x["venue"].rlike(f"(?i){site.venue_suffix}"), "placeholder_venue_booking").when(missing, "")
        return F.struct(*(x[f].alias(f) for f in FIELDS[:3]), F.coalesce(x["reason"], why).alias("reason"))

    places = lambda t: F.struct(t.alias("t"), F.instr(t, " - ").alias("dash"), F.instr(F.lower(t), " at ").alias("at"), F.instr(t, ",").alias("comma"))
    return text.let(text.let(text.let(text.trimmed(line), places), form), late)


def listed(lines: DataFrame, document: str, line: str, body: str, year: int, site: Site = Site()) -> DataFrame:  # noqa: B008
    """(document, line, date, body, artist, venue, time, reason) of the lines below a readable day header.

    Headers themselves, lines before the first and below an unreadable one, footers and lines that say nothing are left out.
    """
    rows = lines.withColumn("_header", times.header_date(F.col(body), year))
    dated = assess.carry_forward(rows, document, line, F.col("_header"), "date").where("_header is null").drop("_header")
    found = dated.withColumn("_c", classified(F.col(body), site)).select(document, line, "date", body, "_c.*")
    return found.where("reason is null or reason <> ''")


def parked(found: DataFrame) -> DataFrame:
    """Lines that were set aside, with their reason."""
    return found.where("reason is not null").select("date", "reason", *(c for c in found.columns if c not in ("date", "reason", "artist", "venue", "time")))


def event_keys(date: Column, artist: Column, venue: Column) -> dict[str, Column]:
    """The listing's own keys of event, artist and venue."""
    act, room = text.slug(text.act_name(artist)), text.slug(venue)
    return {"source_event_key": F.concat_ws("_", date, act, room), "artist_external_id": F.concat(F.lit("artist_"), act), "venue_external_id": F.concat(F.lit("venue_"), room)}


def listed_events(found: DataFrame, site: Site = Site(), keep: tuple[str, ...] = ()) -> DataFrame:  # noqa: B008
    """The events among the lines, in the columns that claims are made of, with content_hash, time_defaulted, and ``keep`` of the lines' own."""
    rows = found.where("reason is null").withColumn("venue_canonical", place(F.col("venue"), site)).withColumn("time_defaulted", F.nullif(F.col("time"), F.lit("")).isNull())
    rows = rows.withColumn("start_time", F.when(F.col("time_defaulted"), F.lit(site.time)).otherwise(F.col("time")))
    body = F.to_json(F.struct("date", "artist", "venue", F.col("venue_canonical").alias("venueCanonical"), F.col("start_time").alias("time"), F.col("time_defaulted").alias("timeDefaulted")))
    keys = event_keys(F.col("date"), F.col("artist"), F.col("venue_canonical"))
    return rows.select(
        keys["source_event_key"].alias("source_event_key"), F.col("artist").alias("artist_name"), keys["artist_external_id"].alias("artist_external_id"), F.lit(site.region).alias("artist_location"),
        F.col("venue_canonical").alias("venue_name"), keys["venue_external_id"].alias("venue_external_id"), text.last_word(F.col("venue"), site.locality).alias("venue_location"),
        F.lit(None).cast("string").alias("venue_address"), "date", "start_time", *(F.lit(None).cast("string").alias(c) for c in ("end_time", "title", "event_url", "ticket_url", "admission_status", "price")),
        F.lit("confirmed").alias("status"), F.sha2(body, 256).alias("content_hash"), "time_defaulted", *keep,
    )


def gate(found: DataFrame) -> DataFrame:
    """``found``, or an error if it has no row at all: a page without one recognised line is no complete empty snapshot."""
    if found.isEmpty():
        raise ValueError("structural gate: no line was recognised")
    return found


def defaulted_warning(events: DataFrame, site: Site = Site()) -> DataFrame:  # noqa: B008
    """One row with the number of defaulted times and its warning, null if there are none."""
    n = F.count_if(F.col("time_defaulted"))
    return events.agg(n.alias("defaulted"), F.when(n > 0, F.concat(n.cast("string"), F.lit(f" time(s) defaulted to {site.time}"))).alias("warning"))
