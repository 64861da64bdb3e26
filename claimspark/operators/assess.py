"""Assessment: eligibility, dispositions, suppression, evaluation, parity, merging and capture identities."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimspark.functions.text import trimmed

#: Fixed value: days for which a commercial entity stays suppressed.
SUPPRESSED_DAYS = 270


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def eligibility(events: DataFrame, entity: str, venue: Column, admission: str) -> DataFrame:
    """(entity, free, paid, unknown, class, auto_enrich) by an ordered table of counts; unknown admissions don't count in ratios."""
    return _classified(events, entity, venue, admission).drop("_venue")


def _classified(events: DataFrame, entity: str, venue: Column, admission: str) -> DataFrame:
    n = lambda what: F.count_if(F.col(admission) == what)
    out = events.groupBy(entity).agg(F.bool_or(venue).alias("_venue"), n("FREE_CONFIRMED").alias("free"), n("PAID_CONFIRMED").alias("paid"), n("UNKNOWN").alias("unknown"))
    free, paid = F.col("free"), F.col("paid")
    kind = (
        F.when(F.col("_venue") & (paid >= 2) & (free == 0), "COMMERCIAL_TICKETING")
        .when((paid >= 3) & (ratio(paid, paid + free) >= 0.8) & (free == 0), "COMMERCIAL_TICKETING")
        .when((free >= 2) & (ratio(free, paid + free) >= 0.8), "GRASSROOTS_FREE")
        .when((free >= 1) & (paid == 0), "LIKELY_GRASSROOTS")
        .when((free > 0) & (paid > 0), "MIXED")
        .otherwise("UNKNOWN")
    )
    out = out.withColumn("class", kind)
    return out.withColumn("auto_enrich", F.col("class").isin("GRASSROOTS_FREE", "LIKELY_GRASSROOTS"))


def eligibility_decisions(events: DataFrame, entity: str, venue: Column, admission: str) -> DataFrame:
    """:func:`eligibility` with suppressed, suppression_days and ticketed_venue: commercial entities are suppressed for a fixed time."""
    out = _classified(events, entity, venue, admission)
    commercial = F.col("class") == "COMMERCIAL_TICKETING"
    columns = {"suppressed": commercial, "suppression_days": F.when(commercial, SUPPRESSED_DAYS).otherwise(0), "ticketed_venue": commercial & F.col("_venue")}
    return out.withColumns(columns).drop("_venue")


def suppressed_until(now: Column) -> Column:
    """The end of a suppression that begins now; null for entities that aren't suppressed."""
    return F.when(F.col("suppressed") & (F.col("suppression_days") > 0), now + F.make_dt_interval(F.col("suppression_days")))


def commercial_signals(events: DataFrame) -> DataFrame:
    """One row for each place of paid events (event_id, venue_name, town, admission, source_urls, admission_urls).

    Places go by name and town, trimmed and in lower case; the last event's spelling counts. evidence_urls are the
    distinct addresses of all its events, each where it came first. (name, town, ticketed, auto_enrich, scan_eligible,
    evidence_urls)
    """
    paid = events.where("admission = 'PAID_CONFIRMED'").withColumns({"_name": F.lower(trimmed("venue_name")), "_town": F.lower(trimmed(F.coalesce("town", F.lit(""))))})
    last = paid.groupBy("_name", "_town").agg(F.max_by(F.struct("venue_name", "town"), "event_id").alias("_last"))
    urls = F.concat(F.coalesce("source_urls", F.array().cast("array<string>")), F.coalesce("admission_urls", F.array().cast("array<string>")))
    first = paid.select("_name", "_town", "event_id", F.posexplode(urls).alias("_pos", "_url")).groupBy("_name", "_town", "_url").agg(F.min(F.struct("event_id", "_pos")).alias("_at"))
    listed = first.groupBy("_name", "_town").agg(F.transform(F.sort_array(F.collect_list(F.struct("_at", "_url"))), lambda x: x["_url"]).alias("evidence_urls"))
    out = last.join(listed, ["_name", "_town"], "left")
    flags = (F.lit(True).alias("ticketed"), F.lit(False).alias("auto_enrich"), F.lit(False).alias("scan_eligible"))
    return out.select(F.col("_last.venue_name").alias("name"), F.col("_last.town").alias("town"), *flags, F.coalesce("evidence_urls", F.array().cast("array<string>")).alias("evidence_urls"))


def disposition(admission: Column) -> Column:
    """struct(publish, enrich, expand): free events do all, paid ones publish only, unknown ones are held."""
    free, paid = admission == "FREE_CONFIRMED", admission == "PAID_CONFIRMED"
    return F.struct((free | paid).alias("publish"), free.alias("enrich"), free.alias("expand"))


def partitioned(events: DataFrame, admission: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(publishable, held, eligible for expansion), each with a column processing; the first and the last overlap."""
    done = events.withColumn("processing", disposition(F.coalesce(admission, F.lit("UNKNOWN"))))
    return done.where("processing.publish"), done.where("not processing.publish"), done.where("processing.expand")


def unsuppressed(entities: DataFrame, eligible: DataFrame, keys: list[str], now: Column) -> DataFrame:
    """Entities but those that are suppressed until after ``now``, or until a time that can't be read; an empty time is none."""
    held = F.col("suppressed") & F.nullif(F.col("suppressed_until"), F.lit("")).isNotNull() & ~F.coalesce(F.try_to_timestamp("suppressed_until") <= now, F.lit(False))
    return entities.join(eligible.where(held).select(*keys), keys, "left_anti")


def precision_recall(found: DataFrame, truth: DataFrame, by: list[str]) -> DataFrame:
    """tp, fp, fn, precision and recall of two sets of keys; an empty denominator gives 1."""
    f, t = found.distinct().withColumn("_f", F.lit(1)), truth.distinct().withColumn("_t", F.lit(1))
    both = f.join(t, [c for c in found.columns], "full_outer").groupBy(*by).agg(
        F.count_if(F.expr("_f = 1 and _t = 1")).alias("tp"), F.count_if(F.expr("_f = 1 and _t is null")).alias("fp"), F.count_if(F.expr("_f is null and _t = 1")).alias("fn"))
    part = lambda d: F.when(F.col("tp") + F.col(d) == 0, 1.0).otherwise(F.col("tp") / (F.col("tp") + F.col(d)))
    return both.withColumns({"precision": part("fp"), "recall": part("fn")})


#: Fields that say who and where an event is; a difference in another one is of its projection.
IDENTITY_FIELDS = ("source_native_id", "artist_name", "artist_external_id", "artist_location", "venue_name", "venue_external_id", "venue_location", "venue_address")


def parity(expected: DataFrame, actual: DataFrame, key: str, identity: list[str] | tuple[str, ...] = IDENTITY_FIELDS, allowed: DataFrame | None = None) -> DataFrame:
    """(path, expected, actual, classification, material) of every difference between two sets of events.

    Of equal keys the last row counts (there is no order: the greatest). An event on one side alone is one difference in
    projection at ``events.<key>``, with the whole event as its value; otherwise each field that differs is one at
    ``events.<key>.<field>``. Paths in ``allowed`` (path) are expected changes of the rules and not material.
    """
    fields = sorted(c for c in expected.columns if c != key)

    def wide(df: DataFrame, name: str) -> DataFrame:
        whole = F.struct(F.lit(True).alias("there"), *(F.col(c).cast("string").alias(c) for c in fields))
        return df.groupBy(key).agg(F.max(whole).alias(name))

    both = wide(expected, "e").join(wide(actual, "a"), key, "full_outer")
    alone = F.col("e").isNull() | F.col("a").isNull()
    path = F.concat(F.lit("events."), F.col(key).cast("string"))
    text = lambda x: F.when(F.col(x).isNotNull(), F.to_json(F.struct(*(F.col(f"{x}.{c}").alias(c) for c in fields))))
    row = lambda at, e, a, kind: F.struct(at.alias("path"), e.alias("expected"), a.alias("actual"), F.lit(kind).alias("classification"))
    each = F.array(*(row(F.concat(path, F.lit(f".{c}")), F.col(f"e.{c}"), F.col(f"a.{c}"), "IDENTITY_DIFFERENCE" if c in identity else "PROJECTION_DIFFERENCE") for c in fields))
    rows = F.when(alone, F.array(row(path, text("e"), text("a"), "PROJECTION_DIFFERENCE"))).otherwise(F.filter(each, lambda r: ~r["expected"].eqNullSafe(r["actual"])))
    return _material(both.select(F.inline(rows)), allowed)


def parity_artifacts(expected: DataFrame, actual: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """The same for two one-row artifacts (source_id, evidence_sha256, parked_by_reason, diff): their own differences.

    Another source, other counts of parked rows and another diff are defects; other evidence is a difference of the input.
    """
    kinds = {"sourceId": ("source_id", "DEFECT"), "evidenceSha256": ("evidence_sha256", "INPUT_DIFFERENCE"), "parkedByReason": ("parked_by_reason", "DEFECT"), "diff": ("diff", "DEFECT")}
    side = lambda df: df.select(*(F.col(c).cast("string").alias(c) for c, _ in kinds.values()))
    both = side(expected).select(F.struct("*").alias("e")).join(side(actual).select(F.struct("*").alias("a")), F.lit(True))
    rows = F.array(*(F.struct(F.lit(at).alias("path"), F.col(f"e.{c}").alias("expected"), F.col(f"a.{c}").alias("actual"), F.lit(kind).alias("classification")) for at, (c, kind) in kinds.items()))
    return _material(both.select(F.inline(F.filter(rows, lambda r: ~r["expected"].eqNullSafe(r["actual"])))), allowed)


def _material(rows: DataFrame, allowed: DataFrame | None) -> DataFrame:
    if allowed is None:
        return rows.withColumn("material", F.lit(True))
    rows = rows.join(allowed.select("path", F.lit(True).alias("_ok")).distinct(), "path", "left")
    kind = F.when(F.col("_ok"), "EXPECTED_RULE_CHANGE").otherwise(F.col("classification"))
    return rows.withColumns({"classification": kind, "material": F.col("_ok").isNull()}).drop("_ok").select("path", "expected", "actual", "classification", "material")


def parked_counts(parked: DataFrame, reason: str = "reason") -> DataFrame:
    """(reason, n), one row each; :func:`parked_map` has them as one map in the order of the reasons."""
    return parked.groupBy(reason).agg(F.count("*").alias("n"))


def parked_map(parked: DataFrame, reason: str = "reason") -> DataFrame:
    counts = parked_counts(parked, reason)
    return counts.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(reason), F.col("n"))))).alias("parked_by_reason"))


def capture_dedupe(captures: DataFrame, identity: Column, newest: Column) -> DataFrame:
    """Captures (id, ...) with identity and duplicate_of: of an identity that with the greatest ``newest`` (of equals the greatest id) is kept, the others point to it.

    A null identity is nobody's duplicate. Identities meet as one row each, so that none, however common, is one task.
    """
    out = captures.withColumn("identity", identity)
    kept = out.where("identity is not null").groupBy("identity").agg(F.max_by("id", F.struct(newest, "id")).alias("_kept"))
    out = out.join(kept, "identity", "left")
    return out.withColumn("duplicate_of", F.when(F.col("id") != F.col("_kept"), F.col("_kept"))).select(*captures.columns, "identity", "duplicate_of")


def fill_missing(old: str, new: str) -> Column:
    """The old value unless it is null or empty."""
    return F.coalesce(F.nullif(F.col(old), F.lit("")), F.col(new))


def fill_missing_list(old: str, new: str) -> Column:
    """The old list unless it is null or empty; an empty new one adds nothing."""
    return F.when(F.size(F.coalesce(F.col(old), F.array())) > 0, F.col(old)).otherwise(F.coalesce(F.when(F.size(new) > 0, F.col(new)), F.col(old)))


def band(confidence: Column) -> Column:
    return F.when(confidence >= 0.85, "HIGH").when(confidence >= 0.6, "MEDIUM").otherwise("LOW")


#: Lines that one group of carry_forward holds.
BLOCK = 4096


def carry_forward(lines: DataFrame, document: str, line: str, header: Column, name: str, block: int = BLOCK) -> DataFrame:
    """Lines with the last header at or before them; lines before the first are left out, as are those under an unreadable one ('').

    ``line`` is a whole number, once each in a document. Headers are carried within blocks of ``block`` numbers, and from block to
    block by the last header of each, so that no document, however long, is one group.
    """
    rows = lines.withColumns({"_head": header, "_block": F.floor(F.col(line) / block)})
    last = rows.groupBy(document, "_block").agg(F.max_by("_head", F.when(F.col("_head").isNotNull(), F.col(line))).alias("_last"))
    before = Window.partitionBy(document).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ahead = last.select(F.col(document).alias("_d"), F.col("_block").alias("_b"), F.last("_last", ignorenulls=True).over(before).alias("_ahead")).where("_ahead is not null")
    rows = rows.join(ahead, F.col(document).eqNullSafe(F.col("_d")) & (F.col("_block") == F.col("_b")), "left")
    order = Window.partitionBy(document, "_block").orderBy(line).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.withColumn(name, F.coalesce(F.last("_head", ignorenulls=True).over(order), F.col("_ahead")))
    return out.where(f"{name} is not null and {name} <> ''").select(*(c for c in lines.columns if c != name), name)


def expand(nodes: DataFrame, edges: DataFrame, hops: int, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(node, depth) of what lies within ``hops`` edges (src, dst) of ``nodes`` (node), each at its least depth.

    ``keep`` stores what a hop has reached (a checkpoint, say), so that the next one doesn't derive it again; without it the
    session's reliable checkpoint folder is used if there is one.
    """
    context = nodes.sparkSession.sparkContext
    keep = keep or ((lambda df: df.checkpoint()) if context.getCheckpointDir() else (lambda df: df))
    front = nodes.select("node").distinct().withColumn("depth", F.lit(0))
    reached = front = keep(front)
    for depth in range(1, hops + 1):
        step = front.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        front = keep(step.join(reached, "node", "left_anti").withColumn("depth", F.lit(depth)))
        reached = reached.unionByName(front)
    return reached
