"""Keyed tables as folders of Parquet parts, with one commit log for all tables of a store.

A table is a run of parts, split by a hash of its key. A write makes new files for the parts that it changes only, and a list
file names the parts of the table as it is then. A commit names the list files of all tables: readers use the commit that was
there when they opened the store, so a transaction over several tables is seen whole or not at all. Commits are
numbered, and a number's file is created only if it isn't there. A writer that comes second goes on with the next number if no
table that it has read or written has changed since, and fails otherwise.

A table has as many parts as its rows need; when it outgrows them their number doubles. Every part has, for each indexed
column, the least and the greatest value and a Bloom filter, so that a lookup opens those parts only that may hold its keys.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from claimspark.operators.reconcile import best_per_key
from claimspark.sources.shared import kept, swept

#: Rows of a part before the table's parts double, commits that stay readable, and commits whose numbers stay taken.
PART_ROWS, VERSIONS, MARKS = 1 << 20, 3, 1000
#: A Bloom filter is bitmaps of so many bits, one for each BLOOM_ROWS rows; each value sets BLOOM_BITS bits of one bitmap.
BITMAP, BLOOM_ROWS, BLOOM_BITS = 32768, 3000, 3
INDEX = "folder string, column string, bitmaps int, low string, high string, bitmap int, bits binary"
#: Writers (of streams) whose last batch numbers a commit carries on.
WRITERS = 1000


class Conflict(RuntimeError):
    """Another writer changed a table that this one has read or written."""


class Store:
    """``indexes`` names the columns of each table that lookups go by; ``parts`` is the number that a new table begins with."""

    def __init__(self, spark: SparkSession, root: str, parts: int = 1, indexes: dict[str, list[str]] | None = None) -> None:
        self.spark, self.root, self.parts, self.indexes = spark, root.rstrip("/"), parts, indexes or {}

    def _path(self, *parts: str):  # noqa: ANN202
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _files(self):  # noqa: ANN202
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _load(self, *parts: str) -> dict:
        stream = self._files().open(self._path(*parts))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _save(self, value: dict, *parts: str) -> None:
        """Write a file that isn't there; an error if it is."""
        stream = self._files().create(self._path(*parts), False)
        stream.write(bytearray(json.dumps(value).encode()))
        stream.close()

    def _numbers(self) -> list[int]:
        files, marks = self._files(), self._path("commits")
        return sorted(int(s.getPath().getName()) for s in files.listStatus(marks) if s.getPath().getName().isdigit()) if files.exists(marks) else []

    def commits(self) -> list[int]:
        """Numbers of the commits that can be read, ascending."""
        return self._numbers()[-VERSIONS:]

    def state(self, number: int | None = None) -> tuple[int, dict]:
        """The last commit's number (-1 if there is none) and what it names, or those of commit ``number``."""
        found = [number] if number is not None else self.commits()
        return (found[-1], self._load("commits", f"{found[-1]:012d}")) if found else (-1, {"tables": {}, "writers": {}})

    def transaction(self) -> Transaction:
        return Transaction(self)

    def read(self, name: str, schema: str) -> DataFrame:
        """The table's current rows; none if it was never written."""
        return self.transaction().read(name, schema)

    def lookup(self, name: str, schema: str, column: str, values: Iterable[Any]) -> DataFrame:
        """The rows whose ``column`` is one of some ``values``: only parts that may hold one are opened."""
        return self.transaction().lookup(name, schema, column, values)

    def put_once(self, name: str, rows: DataFrame, keys: list[str], schema: str, strict: bool = False) -> DataFrame:
        """A transaction of :meth:`Transaction.put_once` alone."""
        with self.transaction() as change:
            return change.put_once(name, rows, keys, schema, strict)

    def upsert(self, name: str, rows: DataFrame, keys: list[str], schema: str) -> None:
        """A transaction of :meth:`Transaction.upsert` alone."""
        with self.transaction() as change:
            change.upsert(name, rows, keys, schema)

    def swap(self, name: str, rows: DataFrame, key: str, column: str, schema: str) -> DataFrame:
        """A transaction of :meth:`Transaction.swap` alone."""
        with self.transaction() as change:
            return change.swap(name, rows, key, column, schema)

    def forget(self) -> None:
        """Remove what the commit that has just become too old alone names. What an unfinished transaction has written stays.

        Its own file stays for MARKS commits more, so that no late writer takes its number.
        """
        found, files = self._numbers(), self._files()
        for number in found[:-MARKS]:
            files.delete(self._path("commits", f"{number:012d}"), False)
        if len(found) <= VERSIONS:
            return
        lists = lambda numbers: {(t, at) for n in numbers for t, at in self.state(n)[1]["tables"].items()}
        stay, go = lists(found[-VERSIONS:]), lists([found[-VERSIONS - 1]])
        there = {(t, at) for t, at in go if files.exists(self._path(t, at))}
        runs = lambda named: {(t, p["folder"].split("/")[0]) for t, at in named for p in self._load(t, at)["parts"].values()}
        for name, run in runs(there) - runs(stay):
            files.delete(self._path(name, run), True)
            files.delete(self._path(name, f"{run}.index"), True)
        for name, at in there - stay:
            files.delete(self._path(name, at), False)


class Transaction:
    """Reads of one commit, and changes that become the next one together. Later reads see the earlier changes.

    As a context it commits at the end, unless there was an error: then nothing of it is ever seen.
    """

    def __init__(self, store: Store) -> None:
        self.store, self.spark = store, store.spark
        self.number, self.base = store.state()
        self.seen: set[str] = set()
        self.changed: dict[str, dict] = {}
        self.writer: tuple[str, int] | None = None

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind: type | None, *_: object) -> None:
        if kind is None:
            self.commit()

    def once(self, writer: str, batch: int) -> bool:
        """Whether this batch of a writer wasn't committed yet; if so, the commit says that it is. Batches' numbers grow."""
        self.writer = (writer, batch)
        return self.base["writers"].get(writer, -1) < batch

    def _listed(self, name: str) -> dict:
        self.seen.add(name)
        if name in self.changed:
            return self.changed[name]
        at = self.base["tables"].get(name)
        return self.store._load(name, at) if at else {"n": self.store.parts, "keys": [], "parts": {}}

    def _opened(self, name: str, schema: str, folders: Iterable[str]) -> DataFrame:
        folders = sorted(set(folders))
        # A table without parts is known to be empty when a join with it is planned, so that no rows are dealt for it.
        return self.spark.read.schema(schema).parquet(*(f"{self.store.root}/{name}/{f}" for f in folders)) if folders else self.spark.createDataFrame([], schema).where("false")

    def read(self, name: str, schema: str) -> DataFrame:
        return self._opened(name, schema, (p["folder"] for p in self._listed(name)["parts"].values()))

    def lookup(self, name: str, schema: str, column: str, values: Iterable[Any]) -> DataFrame:
        values, listed = list(values), self._listed(name)
        kind = self._opened(name, schema, ()).schema[column].dataType
        wanted = [F.lit(v).cast(kind) for v in values]
        if not listed["parts"] or not values:
            return self._opened(name, schema, ())
        if listed["keys"] == [column]:
            at = {str(x) for x in self.spark.range(1).select(*(self._part([w], listed["n"]).alias(f"p{k}") for k, w in enumerate(wanted))).first()}
            folders = [p["folder"] for k, p in listed["parts"].items() if k in at]
        elif column in self.store.indexes.get(name, ()):
            current = {p["folder"] for p in listed["parts"].values()}
            index = self.spark.read.schema(INDEX).parquet(*(f"{self.store.root}/{name}/{run}.index" for run in sorted({f.split("/")[0] for f in current})))
            hit = F.lit(False)
            for w in wanted:
                within = (F.col("low") <= w.cast("string")) & (F.col("high") >= w.cast("string")) & (F.col("bitmap") == F.pmod(F.xxhash64(w), F.col("bitmaps")))
                for i in range(BLOOM_BITS):
                    byte = F.conv(F.hex(F.substring("bits", (_position(w, i) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
                    within = within & (F.getbit(byte, F.pmod(_position(w, i), F.lit(8)).cast("int")) == 1)
                hit = hit | within
            folders = [r[0] for r in index.where((F.col("column") == column) & hit).select("folder").distinct().collect() if r[0] in current]
        else:
            folders = [p["folder"] for p in listed["parts"].values()]
        return self._opened(name, schema, folders).where(F.col(column).isin(values))

    @staticmethod
    def _part(keys: list[Column | str], n: int) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")

    def change(self, name: str, keys: list[str], schema: str, touched: DataFrame, change: Callable[[DataFrame], DataFrame]) -> None:
        """Replace the parts that hold keys of ``touched`` by what ``change`` makes of their rows."""
        listed = self._listed(name)
        n, parts = listed["n"], dict(listed["parts"])
        # A row for each part.
        with swept(self.spark):
            new = {str(r[0]): r[1] for r in touched.select(self._part(keys, n).alias("p")).groupBy("p").count().collect()}
        if not new:
            return
        rows, hit, before = sum(p["rows"] for p in parts.values()) + sum(new.values()), set(new), n
        while rows > n * PART_ROWS:
            n *= 2
        if n > before:
            hit = {*new, *parts}
        now = self._opened(name, schema, (parts[p]["folder"] for p in hit if p in parts))
        run = uuid.uuid4().hex
        made = change(now).select(*now.columns).withColumn("_part", self._part(keys, n))
        # Parts of any size: large ones are dealt to several files, small ones share a task.
        with swept(self.spark):
            made.hint("rebalance", "_part").write.partitionBy("_part").parquet(f"{self.store.root}/{name}/{run}")
            parts = {p: v for p, v in parts.items() if p not in hit} | self._measured(name, schema, run)
        self.changed[name] = {"n": n, "keys": keys, "parts": parts}

    def _measured(self, name: str, schema: str, run: str) -> dict[str, dict]:
        """The parts of a run with their numbers of rows; their indexes are written."""
        root = f"{self.store.root}/{name}"
        types = self.spark.createDataFrame([], schema).schema
        rows = self.spark.read.option("basePath", f"{root}/{run}").schema(types.add("_part", IntegerType())).parquet(f"{root}/{run}")
        found = {str(p): n for p, n in rows.groupBy("_part").count().collect()}
        indexed = self.store.indexes.get(name, [])
        if indexed and found:
            each = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("text"), F.xxhash64(c).alias("hash")) for c in indexed))).alias("v")
            values = rows.select("_part", each).select("_part", "v.*").where("text is not null")
            ends = values.groupBy("_part", "column").agg(F.min("text").alias("low"), F.max("text").alias("high"), F.expr(f"int((count(*) + {BLOOM_ROWS - 1}) div {BLOOM_ROWS})").alias("bitmaps"))
            at = values.join(ends, ["_part", "column"]).select("_part", "column", "bitmaps", "low", "high", F.pmod("hash", "bitmaps").cast("int").alias("bitmap"), F.explode(F.array(*(_position_of("hash", i) for i in range(BLOOM_BITS)))).alias("bit"))
            bits = at.groupBy("_part", "column", "bitmaps", "low", "high", "bitmap").agg(F.bitmap_construct_agg("bit").alias("bits"))
            bits = bits.select(F.concat(F.lit(f"{run}/_part="), "_part").alias("folder"), "column", "bitmaps", "low", "high", "bitmap", "bits")
            bits.write.parquet(f"{root}/{run}.index")
        return {p: {"folder": f"{run}/_part={p}", "rows": n} for p, n in found.items()}

    def put_once(self, name: str, rows: DataFrame, keys: list[str], schema: str, strict: bool = False) -> DataFrame:
        """Add rows of new keys; the rows whose keys are taken are returned, or an error if ``strict``.

        Of rows that share a new key the least is put. Keys hold no null.
        """
        # Keys of whole tables are dealt: a part's file is far smaller than its rows, and its size would pass for a broadcast's.
        before = self.read(name, schema).select(*keys, F.lit(True).alias("_there")).hint("merge")
        best = best_per_key(rows, keys, F.struct(F.lit(0)), F.struct(*(F.col(c) for c in rows.columns)))
        marked = kept(best.join(before, keys, "left").select(*rows.columns, "_there"), "put")
        taken, new = marked.where("_there").select(*rows.columns), marked.where("_there is null").select(*rows.columns)
        if strict and not taken.isEmpty():
            raise ValueError(f"{name}: keys exist already")
        # Only new rows are put: those whose keys are taken may lie in parts that aren't touched.
        self.change(name, keys, schema, new, lambda now: now.unionByName(new.select(now.columns)))
        return taken

    def upsert(self, name: str, rows: DataFrame, keys: list[str], schema: str) -> None:
        """Replace rows of equal keys (which are unique in ``rows``, and not null), add the others."""
        rows = kept(rows, "upsert")
        self.change(name, keys, schema, rows, lambda now: now.join(rows.select(*keys).hint("merge"), keys, "left_anti").unionByName(rows.select(now.columns)))

    def swap(self, name: str, rows: DataFrame, key: str, column: str, schema: str) -> DataFrame:
        """Set ``column`` where it still is as expected (key, expected, new); (key, outcome): swapped or stale."""
        won = F.coalesce(F.col(column).eqNullSafe(F.col("expected")) & F.col("new").isNotNull(), F.lit(False))
        seen = self.read(name, schema).join(rows, key).select(key, won.alias("_hit"))
        outcome = kept(rows.select(key).join(seen, key, "left").select(key, F.when(F.col("_hit"), "swapped").otherwise("stale").alias("outcome")), "swap")

        def moved(now: DataFrame) -> DataFrame:
            hit = now.join(rows, key, "left").withColumn(column, F.when(won, F.col("new")).otherwise(F.col(column)))
            return hit.select(now.columns)

        self.change(name, [key], schema, rows.join(outcome.where("outcome = 'swapped'"), key, "left_semi"), moved)
        return outcome

    def commit(self) -> None:
        """Make all changes visible at once; an error if another writer's commit changed what this one has read or written."""
        if not self.changed and not self.writer:
            return
        tables = {}
        for name, listed in self.changed.items():
            tables[name] = f"list-{uuid.uuid4().hex}.json"
            self.store._save(listed, name, tables[name])
        number, now = self.number, self.base
        while True:
            last, then = self.store.state()
            if last != number:
                if any(then["tables"].get(t) != self.base["tables"].get(t) for t in self.seen):
                    raise Conflict(f"commit {last} changed what this one has seen")
                number, now = last, then
            writers = dict(now["writers"])
            if self.writer:
                name, batch = self.writer
                if writers.pop(name, -1) >= batch:
                    raise Conflict(f"batch {batch} of {name} is committed")
                writers[name] = batch
            value = {"tables": now["tables"] | tables, "writers": dict(list(writers.items())[-WRITERS:])}
            try:
                self.store._save(value, "commits", f"{number + 1:012d}")
                break
            except Exception:
                if self.store.state()[0] == number:
                    raise
        self.store.forget()


def _position_of(hashed: str, i: int) -> Column:
    """The bit, of a bitmap, that a value's hash sets for the i-th time."""
    return F.pmod(F.xxhash64(F.col(hashed), F.lit(i)), F.lit(BITMAP)).cast("long")


def _position(value: Column, i: int) -> Column:
    return F.pmod(F.xxhash64(F.xxhash64(value), F.lit(i)), F.lit(BITMAP)).cast("long")
