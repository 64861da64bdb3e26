"""Enrichment: gaps, intake, gates before costly calls, merges of what is found, and write-back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimspark.functions import text
from claimspark.operators.assess import band
from claimspark.operators.reconcile import best_per_key

#: The controlled words for genres, artists and acts, and the wire values of the last two.
GENRES = (
    "Rock", "Rock n Roll", "Grunge", "Metal", "Punk", "Alternative", "New Wave", "Pop", "Indie", "Britpop", "Mod", "Blues", "R&B", "Country", "Americana", "Folk", "Soul", "Funk", "Motown",
    "Electronic", "Dance", "Jazz", "Classical", "Reggae", "Latin", "Other",
)
ARTIST_TYPES = {"Band": "band", "Solo Act": "solo", "Duo": "duo", "Trio": "trio", "Group": "group", "DJ": "dj", "Collective": "collective"}
ACT_TYPES = {"Originals": "originals", "Covers": "covers", "Tribute Act": "tribute"}
#: Fixed value: the least confidence of a match.
MATCH = 0.6
#: The price of a search and of a model call.
SEARCH_PRICE, CALL_PRICE = 0.005, 0.00025


def blank(x: str) -> Column:
    return text.present(F.col(x)).isNull()


def empty(x: str) -> Column:
    return F.size(F.coalesce(F.col(x), F.array().cast("array<string>"))) == 0


def artist_gaps() -> dict[str, Column]:
    """What an artist (genres, artist_type, act_type, bio, facebook_url, website_url) lacks."""
    return {
        "missing_genres": empty("genres"), "missing_artist_type": F.nullif(F.col("artist_type"), F.lit("")).isNull(), "missing_act_type": empty("act_type"),
        "missing_bio": blank("bio"), "missing_facebook": blank("facebook_url"), "missing_website": blank("website_url"),
    }


def social(urls: str = "social_urls") -> Column:
    """The first address of a place on the platform that is looked for."""
    return F.try_element_at(F.filter(F.coalesce(F.col(urls), F.array().cast("array<string>")), lambda u: F.contains(F.lower(u), F.lit("facebook"))), F.lit(1))


def venue_gaps() -> dict[str, Column]:
    """What a place (social_urls, website) lacks."""
    return {"missing_facebook": social().isNull(), "missing_website": blank("website")}


def _settled() -> Column:
    return F.coalesce(F.col("enrichment_status") == "high_confidence", F.lit(False))


def artist_needs() -> Column:
    """Any of genres, type and act is missing, and the artist isn't settled."""
    gaps = artist_gaps()
    return ~_settled() & (gaps["missing_genres"] | gaps["missing_artist_type"] | gaps["missing_act_type"])


def venue_needs() -> Column:
    """Both page and website are missing, and the place isn't settled; a validated one with a website is fine."""
    gaps = venue_gaps()
    fine = F.coalesce(F.col("validated"), F.lit(False)) & F.nullif(F.col("website"), F.lit("")).isNotNull()
    return ~_settled() & ~fine & gaps["missing_facebook"] & gaps["missing_website"]


def gap_statistics(artists: DataFrame, venues: DataFrame) -> DataFrame:
    """(entity, counter, n): total, each gap, high_confidence, and of places validated."""
    def counts(rows: DataFrame, entity: str, columns: dict[str, Column]) -> DataFrame:
        made = rows.agg(F.count("*").alias("total"), *(F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in columns.items()))
        pairs = F.array(*(F.struct(F.lit(c).alias("counter"), F.col(c).alias("n")) for c in ("total", *columns)))
        return made.select(F.lit(entity).alias("entity"), F.inline(pairs))

    both = counts(artists, "artist", {**artist_gaps(), "high_confidence": _settled()})
    return both.unionByName(counts(venues, "venue", {**venue_gaps(), "validated": F.col("validated"), "high_confidence": _settled()}))


def cells_of(radius: int, cells: DataFrame) -> DataFrame:
    """The cells (cell, radius: the least at which it counts) within ``radius``: lists of larger radii hold the smaller ones."""
    return cells.where(F.col("radius") <= radius).select("cell").distinct()


def events_in(events: DataFrame, cells: DataFrame, start: Column, end: Column) -> DataFrame:
    """Events (cell, date, ...) of these cells, from start to end inclusive."""
    return events.where(F.col("date").between(start, end)).join(cells, "cell", "left_semi")


def taking_part(entities: DataFrame, events: DataFrame, column: str) -> DataFrame:
    """Entities (id) that some event names in ``column``."""
    ids = events.select(F.nullif(F.col(column).cast("string"), F.lit("")).alias("_id")).where("_id is not null").distinct()
    return entities.join(ids, F.col("id").cast("string") == F.col("_id"), "left_semi")


def entity_counts(events: DataFrame) -> DataFrame:
    """One row: events, and how many distinct artists and places they name."""
    named = lambda c: F.count_distinct(F.nullif(F.col(c).cast("string"), F.lit("")))
    return events.agg(F.count("*").alias("events"), named("artist_id").alias("artists"), named("venue_id").alias("venues"))


def intake(artists: DataFrame, venues: DataFrame, all_of_them: bool = False) -> DataFrame:
    """(type, id, name, town, facebook_url, website) of the artists and places that need enrichment; empty texts are null."""
    full = lambda c: F.nullif(F.col(c), F.lit(""))
    a = artists if all_of_them else artists.where(artist_needs())
    v = venues if all_of_them else venues.where(venue_needs())
    a = a.select(F.lit("artist").alias("type"), F.col("id").cast("string").alias("id"), "name", F.col("location").alias("town"), full("facebook_url").alias("facebook_url"), full("website_url").alias("website"))
    return a.unionByName(v.select(F.lit("venue").alias("type"), F.col("id").cast("string").alias("id"), "name", full("city").alias("town"), social().alias("facebook_url"), full("website").alias("website")))


def page(rows: DataFrame, offset: int, limit: int, *order: str) -> DataFrame:
    """Rows from ``offset`` on in a total order; a limit of 0 is none."""
    out = rows.orderBy(*order).offset(offset)
    return out.limit(limit) if limit else out


def needs_rich(entities: DataFrame) -> Column:
    """Whether a search must go on: page not searched, not matched or unknown, no bio, or an artist without profile."""
    full = lambda c: F.nullif(F.col(c), F.lit("")).isNotNull()
    done = F.coalesce(F.col("facebook_searched"), F.lit(False)) & F.coalesce(F.col("facebook_status") == "matched", F.lit(False)) & full("facebook_url") & full("bio")
    return ~done | ((F.col("entity_type") == "artist") & ~F.coalesce(F.col("has_profile"), F.lit(False)))


def has_data() -> Column:
    """Whether there is anything to write back (facebook_status, facebook_url, bio, website, genres, artist_type, act_types)."""
    full = lambda c: F.nullif(F.col(c), F.lit("")).isNotNull()
    matched = F.coalesce(F.col("facebook_status") == "matched", F.lit(False)) & full("facebook_url")
    return matched | full("bio") | full("website") | ~empty("genres") | full("artist_type") | ~empty("act_types")


def named_by(entities: DataFrame, events: DataFrame) -> DataFrame:
    """Entities whose name some event has as its artist or its place, trimmed and in any case."""
    key = lambda c: F.lower(text.trimmed(F.col(c)))
    names = events.select(F.explode(F.array(key("artist_name"), key("venue_name"))).alias("_key")).distinct()
    return entities.join(names, key("name") == F.col("_key"), "left_semi")


def rich_targets(entities: DataFrame, eligible: DataFrame, events: DataFrame) -> DataFrame:
    """Entities worth a costly call: of a searched subject (subject_id) that is auto-enriched and has events to expand, with gaps, and named by these events.

    The subject itself (is_subject) need not be named. Cheap filters come first, so that nothing is called for the rest.
    """
    open_ = eligible.where("auto_enrich").select("subject_id").join(events.select("subject_id").distinct(), "subject_id", "left_semi")
    rows = entities.where(needs_rich(entities)).join(open_, "subject_id", "left_semi")
    key = lambda c: F.lower(text.trimmed(F.col(c)))
    names = events.select("subject_id", F.explode(F.array(key("artist_name"), key("venue_name"))).alias("_key")).distinct()
    named = rows.where("not is_subject").withColumn("_key", key("name")).join(names, ["subject_id", "_key"], "left_semi").drop("_key")
    return rows.where("is_subject").unionByName(named)


def applied(originals: DataFrame, results: DataFrame, values: list[str]) -> DataFrame:
    """Originals (index, ...) with ``values`` of the last result (index, seq, ...) of their index; results of unknown indexes are left out."""
    last = best_per_key(results.select("index", "seq", *values), ["index"], F.struct("seq"), F.struct(*values))
    last = last.select("index", F.lit(True).alias("_hit"), *(F.col(v).alias(f"_{v}") for v in values))
    out = originals.join(last, "index", "left")
    return out.select(*(F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in originals.columns))


def page_match(candidates: DataFrame) -> DataFrame:
    """(entity_id, status, url, confidence) from ranked candidates (entity_id, rank from 1, url, is_match, confidence).

    The first that matches well enough, or else the second; two or more without a match are ambiguous. A lone one that
    doesn't match is not found, and third ones aren't looked at.
    """
    good = F.col("is_match") & (F.col("confidence") >= MATCH)
    best = F.min_by(F.struct("url", "confidence"), F.when(good & (F.col("rank") <= 2), F.col("rank")))
    out = candidates.groupBy("entity_id").agg(F.count("*").alias("_n"), F.count_if(good & (F.col("rank") <= 2)).alias("_good"), best.alias("_best"))
    hit = F.col("_good") > 0
    status = F.when(hit, "matched").when(F.col("_n") > 1, "ambiguous").otherwise("not_found")
    return out.select("entity_id", status.alias("status"), F.when(hit, F.col("_best.url")).alias("url"), F.when(hit, F.col("_best.confidence")).otherwise(0.0).alias("confidence"))


def merged_enrichment() -> dict[str, Column]:
    """bio, genres, artist_type, act_types and confidence of a validator's columns (v_*), or where it has none of an extractor's (x_*)."""
    lists = lambda c, words: F.when(F.size(text.vocabulary(F.col(f"v_{c}"), words[0], words[1])) > 0, text.vocabulary(F.col(f"v_{c}"), *words)).otherwise(text.vocabulary(F.col(f"x_{c}"), *words))
    kind = lambda c: F.try_element_at(text.vocabulary(F.array(F.col(c)), tuple(ARTIST_TYPES), False), F.lit(1))
    return {
        "bio": F.coalesce(F.nullif(F.col("v_bio"), F.lit("")), F.nullif(F.col("x_bio"), F.lit(""))), "genres": lists("genres", (GENRES, True)),
        "artist_type": F.coalesce(kind("v_artist_type"), kind("x_artist_type")), "act_types": lists("act_types", (tuple(ACT_TYPES), False)),
        "confidence": F.greatest(F.coalesce("v_confidence", F.lit(0.0)), F.coalesce("x_confidence", F.lit(0.0))),
    }


def merged_evidence(rows: DataFrame, by: str) -> DataFrame:
    """Evidence (by, seq, source_url, ...) once for each address: the last one's columns at the first one's place."""
    last = best_per_key(rows, [by, "source_url"], F.struct("seq"), F.col("seq"))
    first = rows.groupBy(by, "source_url").agg(F.min("seq").alias("_first"))
    return last.drop("seq").join(first, [by, "source_url"]).withColumnRenamed("_first", "seq")


def evidence(responses: DataFrame, by: str, column: str) -> DataFrame:
    """(by, evidence_id, source_url, domain) of the distinct addresses under url or uri anywhere in JSON responses, by their first place.

    The id is made of the address.
    """
    found = F.regexp_extract_all(column, F.lit(r'"(?:url|uri)"\s*:\s*"(https?://[^"\\]+)"'), F.lit(1))
    rows = responses.select(by, F.posexplode(F.array_distinct(found)).alias("seq", "source_url"))
    return rows.select(by, "seq", F.concat(F.lit("ev_"), F.substring(F.sha1("source_url"), 1, 12)).alias("evidence_id"), "source_url", F.lower(F.regexp_extract("source_url", "^https?://([^/?#:]+)", 1)).alias("domain"))


def output_text(response: Column) -> Column:
    """A model response's text: its own field, or else the last text of its last output step with one."""
    steps = F.from_json(F.get_json_object(response, "$.steps"), "array<struct<type:string,content:array<struct<type:string,text:string>>>>")
    texts = F.flatten(F.transform(F.filter(steps, lambda s: s["type"] == "model_output"), lambda s: F.coalesce(s["content"], F.array().cast("array<struct<type:string,text:string>>"))))
    texts = F.filter(texts, lambda t: (t["type"] == "text") & t["text"].isNotNull())
    return F.coalesce(F.get_json_object(response, "$.output_text"), F.get_json_object(response, "$.outputText"), F.try_element_at(texts, F.lit(-1))["text"])


def usage(calls: DataFrame, by: str) -> DataFrame:
    """(by, searches, input_tokens, output_tokens, calls, cost): sums over a discovery's calls, and their estimated cost."""
    n = lambda c: F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(c)
    out = calls.groupBy(by).agg(n("searches"), n("input_tokens"), n("output_tokens"), F.count("*").alias("calls"))
    return out.withColumn("cost", cost(F.col("searches"), F.col("calls")))


def cost(searches: Column, calls: Column) -> Column:
    return searches * SEARCH_PRICE + calls * CALL_PRICE


def percent(share: Column) -> Column:
    """A share as whole percent, half away from zero."""
    return F.concat(F.round(share * 100, 0).cast("long").cast("string"), F.lit("%"))


def compared(results: DataFrame, providers: tuple[str, str]) -> DataFrame:
    """One row an entity with two providers' confidence, match, latency and cost side by side; a missing one is null."""
    pick = lambda p, c: F.max(F.when(F.col("provider") == p, F.col(c))).alias(f"{p}_{c}")
    return results.groupBy("entity_id").agg(*(pick(p, c) for p in providers for c in ("confidence", "status", "latency_ms", "cost")))


def notes() -> Column:
    """What was found, in words, or else a fixed sentence."""
    joined = lambda label, c: F.when(~empty(c), F.concat(F.lit(f"{label}: "), F.array_join(c, ", ")))
    parts = F.array(
        F.when(F.col("facebook_status") == "matched", F.concat(F.lit("Facebook: matched with "), percent(F.col("facebook_confidence")), F.lit(" confidence"))),
        F.when(F.nullif(F.col("bio"), F.lit("")).isNotNull(), "Bio: found"), joined("Genres", "genres"),
        F.when(F.nullif(F.col("artist_type"), F.lit("")).isNotNull(), F.concat(F.lit("Artist type: "), F.col("artist_type"))), joined("Act types", "act_types"),
    )
    return F.coalesce(F.nullif(F.array_join(F.array_compact(parts), "; "), F.lit("")), F.lit("Enrichment data found via Google Search"))


def write_back(entities: DataFrame, results: DataFrame) -> DataFrame:
    """``entities`` (type, id, ...) with enrichment_status, enrichment_date and enrichment_data of their result.

    Suppressed results and those without data change nothing. The status is the same at any confidence; artists get all
    suggestions, places page and website only.
    """
    full = lambda c: F.nullif(F.col(c), F.lit(""))
    many = lambda c: F.when(~empty(c), F.col(c))
    found_page = F.when(F.col("facebook_status") == "matched", F.col("facebook_url"))
    shared = (band(F.col("identity_confidence")).alias("confidence"), notes().alias("notes"), F.col("retrieved_at").alias("date"))
    artist = F.to_json(F.struct(found_page.alias("suggested_facebookUrl"), F.col("website").alias("suggested_websiteUrl"), full("bio").alias("suggested_bio"), many("genres").alias("suggested_genres"), full("artist_type").alias("suggested_artistType"), many("act_types").alias("suggested_actTypes"), *shared))
    venue = F.to_json(F.struct(F.col("website").alias("suggested_website"), found_page.alias("suggested_facebook"), *shared))
    good = results.where(~F.coalesce("suppressed", F.lit(False)) & has_data())
    good = good.select("type", "id", F.lit("high_confidence").alias("_status"), F.col("retrieved_at").alias("_date"), F.when(F.col("type") == "artist", artist).otherwise(venue).alias("_data"))
    out = entities.join(good, ["type", "id"], "left")
    put = lambda new, old: F.coalesce(F.col(new), F.col(old)).alias(old)
    rest = [c for c in entities.columns if c not in ("enrichment_status", "enrichment_date", "enrichment_data")]
    return out.select(*rest, put("_status", "enrichment_status"), put("_date", "enrichment_date"), put("_data", "enrichment_data"))


def patched() -> dict[str, Column]:
    """Seven fields of an existing artist (old_*) filled from a captured one (new_*) where they are missing; types as wire values."""
    keep = lambda c: F.coalesce(F.nullif(F.col(f"old_{c}"), F.lit("")), F.nullif(F.col(f"new_{c}"), F.lit("")))
    acts = F.array_compact(F.transform(F.col("new_act_type"), lambda x: text.wire_value(x, ACT_TYPES)))
    return {
        **{c: keep(c) for c in ("facebook_url", "location", "location_type", "bio")},
        "artist_type": F.coalesce(F.nullif(F.col("old_artist_type"), F.lit("")), text.wire_value(F.col("new_artist_type"), ARTIST_TYPES)),
        "act_type": F.when(~empty("old_act_type"), F.col("old_act_type")).otherwise(acts), "genres": F.when(~empty("old_genres"), F.col("old_genres")).otherwise(F.col("new_genres")),
    }


def discovery_results(found: DataFrame) -> DataFrame:
    """Results of a search in the shape of discovery results: its links as evidence with hosts, and the best confidence."""
    links = F.transform("evidence_urls", lambda u: F.struct(F.concat(F.lit("ev_"), F.substring(F.sha1(u), 1, 12)).alias("id"), u.alias("source_url"), F.lower(F.regexp_extract(u, "^https?://([^/?#:]+)", 1)).alias("source_domain")))
    return found.withColumn("evidence", links)


def prompt_targets(rows: DataFrame, by: str, order: str, columns: list[str]) -> DataFrame:
    """(by, targets): each group's rows as a JSON list of their index, from 0 in that order, and ``columns``."""
    ordered = F.sort_array(F.collect_list(F.struct(order, F.struct(*columns).alias("_row"))))
    listed = F.transform(ordered, lambda x, i: F.struct(i.alias("index"), *(x["_row"][c].alias(c) for c in columns)))
    return rows.groupBy(by).agg(F.to_json(listed).alias("targets"))
