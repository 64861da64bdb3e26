"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

Every document gets an exponential key, -ln(u) / w, with u from a digest of its id and text and w from its quality; the
documents of least key are a weighted sample without replacement. Each source's target is spent on complete epochs
first; what is left goes to the documents in order of their keys, by prefix sums. Prefix sums are taken in two steps
(bands of keys, then the rows of the one band that the budget ends in), so that no source, whatever its share of the
rows, meets in one task. A decision is a few numbers for each source, so texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimspark.llm.common import discard, materialise

#: Weights of the sources in their order, repeating.
WEIGHTS = (5, 2, 1)
#: A target stops at so many times its source's size.
MOST_EPOCHS = 3
#: Bands of keys in each source.
BANDS = 4096
#: Steps that fill what a document too large for the rest of the budget leaves.
FILLS = 3
SIGNS = "*$%#&!|"


def size_of(text: str = "text") -> F.Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def keyed(docs: DataFrame, seed: int) -> DataFrame:
    """``docs`` with _size, _key and _tie: words, sampling key, and a digest that orders equal keys."""
    text = F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(16**12)
    # Quality: 1 for text without signs, 0.1 where a quarter of the characters or more are signs.
    signs = F.length(text) - F.length(F.translate(text, SIGNS, ""))
    weight = F.greatest(F.lit(0.1), F.lit(1.0) - F.lit(4.0) * signs / F.greatest(F.length(text), F.lit(1)))
    return docs.withColumns({"_size": size_of(), "_key": F.round(-F.log(u) / weight, 9), "_tie": digest})


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) of (source, source_size), one row a source.

    Sources by code point, null last, weigh WEIGHTS; the whole of all sizes is shared by weight, no target above
    MOST_EPOCHS times its source's size. The level at which that holds is found in closed form: with sources by size to
    weight, it is the first at which the uncapped ones' share falls short of the next cap.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    out = sizes.withColumn("_w", weight.cast("double")).withColumn("_cap", (F.col("source_size") * MOST_EPOCHS).cast("double"))
    whole = Window.partitionBy()
    before = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    spent, heavy = F.coalesce(F.sum("_cap").over(before), F.lit(0.0)), F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    out = out.withColumn("_level", (F.sum("source_size").over(whole) - spent) / (F.sum("_w").over(whole) - heavy))
    level = F.max(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.col("_level"))).over(whole)
    # Of the levels that hold the first, which takes no source as capped that isn't, is the highest; none: all are capped.
    out = out.withColumn("_level", F.coalesce(level, F.lit(float("inf"))))
    return out.select("source", "source_size", F.least(F.col("_cap"), F.col("_level") * F.col("_w")).alias("target"))


def _band(key: F.Column) -> F.Column:
    """Bands that keys of any weight from 0.1 to 1 fill about evenly; it never falls as the key grows."""
    share = sum((F.lit(1.0) - F.exp(-key * w) for w in (1.0, 0.5, 0.25, 0.1)), F.lit(0.0)) / 4
    return F.floor(F.lit(BANDS) * share).cast("int")


def _same(a: str, b: str) -> F.Column:
    return F.col(a).eqNullSafe(F.col(b))


def _spend(rows: DataFrame, budget: DataFrame, able: F.Column) -> DataFrame:
    """(source, used, key, tie): how far, in order of key and tie, the able groups of ``rows`` fit into each source's ``left``.

    ``rows`` (source, _size, _key, _tie, _band), one for each digest; ``budget`` (source, left, ...). The cut is the last row whose prefix sum
    is within the budget; no row at all gives key null.
    """
    rows = rows.join(budget.withColumnRenamed("source", "_s"), _same("source", "_s"), "inner").where(able)
    bands = rows.groupBy("source", "_band", "left").agg(F.sum("_size").alias("sum"), F.max(F.struct("_key", "_tie")).alias("last"))
    order = Window.partitionBy("source").orderBy("_band")
    bands = bands.withColumn("upto", F.sum("sum").over(order))
    bands = materialise(bands, "bands")
    whole = bands.where("upto <= left").groupBy("source").agg(F.max("upto").alias("used"), F.max("last").alias("last"))
    part = bands.where("upto > left").groupBy("source").agg(F.min(F.struct("_band", (F.col("upto") - F.col("sum")).alias("start"))).alias("x"))
    part = part.select(F.col("source").alias("_p"), F.col("x._band").alias("_b"), F.col("x.start").alias("start"))
    inner = rows.join(part, _same("source", "_p") & (F.col("_band") == F.col("_b")))
    inner = inner.withColumn("upto", F.col("start") + F.sum("_size").over(Window.partitionBy("source").orderBy("_key", "_tie")))
    inner = inner.where("upto <= left").groupBy("source").agg(F.max("upto").alias("used"), F.max(F.struct("_key", "_tie")).alias("last"))
    both = whole.unionByName(inner).groupBy("source").agg(F.max("used").alias("used"), F.max("last").alias("last"))
    return both.select("source", "used", F.col("last._key").alias("key"), F.col("last._tie").alias("tie"))


def decisions(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is taken: a plan, and the digests that its cuts leave out.

    The plan is one row for each source: source_size, target, epochs, and the cuts of the fractional selection. Cut i
    (key_i, tie_i, from_i, size_i) takes the rows after the cut before it, up to (key_i, tie_i), of size_i words at most.
    Rows of one digest are equal and go in or stay out together, by the sum of their sizes: (source, _key, _tie) of the
    last table are those of repeated rows that the cut would take one by one, but that together were too large.
    """
    groups = rows.withColumn("_band", _band(F.col("_key"))).groupBy("source", "_band", "_key", "_tie")
    groups = materialise(groups.agg(F.sum("_size").alias("_size"), F.min("_size").alias("_least"), F.count("*").alias("_n")), "groups")
    plan = targets(groups.groupBy("source").agg(F.sum("_size").alias("source_size")))
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = plan.withColumn("left", F.col("target") - F.col("epochs") * F.col("source_size"))
    plan = materialise(plan.withColumn("key_0", F.lit(-1.0)).withColumn("tie_0", F.lit("")), "plan")
    for i in range(1, FILLS + 1):
        able = F.expr(f"(_key > key_{i - 1} or (_key = key_{i - 1} and _tie > tie_{i - 1})) and _size > 0 and _size <= left")
        cut = _spend(groups.drop("_least", "_n"), plan.select("source", "left", f"key_{i - 1}", f"tie_{i - 1}"), able).withColumnRenamed("source", "_c")
        plan = plan.join(cut, _same("source", "_c"), "left").withColumn(f"size_{i}", F.col("left"))
        plan = plan.withColumns({f"key_{i}": F.coalesce("key", f"key_{i - 1}"), f"tie_{i}": F.coalesce("tie", f"tie_{i - 1}"), "left": F.col("left") - F.coalesce("used", F.lit(0))})
        plan = materialise(plan.drop("_c", "used", "key", "tie"), "plan")
    out = groups.where("_n > 1").join(plan.withColumnRenamed("source", "_s"), _same("source", "_s")).where(_taken("_least") & ~_taken())
    return plan, materialise(out.select("source", "_key", "_tie"), "out")


def _taken(size: str = "_size") -> F.Column:
    """Whether one of the cuts takes what has this key, digest and size."""
    after = lambda i: f"(_key > key_{i} or (_key = key_{i} and _tie > tie_{i}))"
    return F.expr(" or ".join(f"({after(i - 1)} and not {after(i)} and {size} > 0 and {size} <= size_{i})" for i in range(1, FILLS + 1)))


def _decided(rows: DataFrame, decided: tuple[DataFrame, DataFrame]) -> DataFrame:
    """``rows`` with their source's decision and _copies, how often each is taken."""
    plan, out = decided
    out = out.select(F.col("source").alias("_o"), F.col("_key").alias("_ok"), F.col("_tie").alias("_ot"), F.lit(True).alias("_out"))
    rows = rows.join(plan.withColumnRenamed("source", "_s"), _same("source", "_s"), "left")
    if not out.isEmpty():
        rows = rows.join(out, _same("source", "_o") & (F.col("_key") == F.col("_ok")) & (F.col("_tie") == F.col("_ot")), "left")
    else:
        rows = rows.withColumn("_out", F.lit(None).cast("boolean"))
    return rows.withColumn("_copies", F.col("epochs") + (_taken() & F.col("_out").isNull()).cast("int"))


def mix(docs: DataFrame, seed: int = 17) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of each row of ``docs`` (doc_id, source, text).

    size counts words; target is its source's; copies is how often the mix takes the document, taken the words of that.
    A null source is one of its own, after all others. A null text has size 0: the fractional selection leaves
    it out and taken is 0. Equal rows (id and text) are chosen alike. Further columns are ignored; an empty table gives an empty
    one. What FILLS steps leave of a budget is left over; where documents are of very unlike sizes, some that aren't taken
    may still fit it.
    """
    rows = materialise(keyed(docs.select("doc_id", "source", "text"), seed).drop("text"), "keys")
    out = _decided(rows, decisions(rows)).withColumn("copies", F.col("_copies"))
    return out.select("doc_id", "source", F.col("_size").alias("size"), "source_size", "target", "copies", (F.col("copies") * F.col("_size")).alias("taken"))


def mixed(docs: DataFrame, seed: int = 17) -> DataFrame:
    """The rows of ``docs`` (doc_id, source, text and any others), all columns, as often as the mix takes them.

    Whole rows travel as one column, so that no name of theirs clashes. Null ids, sources and texts count as in :func:`mix`: a
    text without words comes as often as its source's complete epochs. Equal rows are taken alike; an empty table gives an empty one.
    """
    rows = docs.select("doc_id", "source", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    full = keyed(rows, seed).select("source", "_size", "_key", "_tie", "_row")
    taken = materialise(full.drop("_row"), "keys")
    out = _decided(full, decisions(taken))
    discard(taken)
    return out.where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select("_row.*")
