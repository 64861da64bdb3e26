"""Token ids in training order: fixed-stride binary shards whose global order is a keyed permutation.

Texts become sequences of LENGTH ids. A sequence's number is a hash of its document's id and text and of its place in the
text, so it doesn't depend on where the table lies, in what order, or how it is split for reading. Equal rows have equal
numbers, and which of them is which nobody can tell; only those that are more than a shard's number of records are told
apart by a count, so that they are dealt to all shards. A Feistel network over the key permutes the numbers;
equal ranges of what it gives are the shards, and range partitions gather them. How many sequences a shard has is known
only then: a second Feistel network, which walks the cycle until it is below that size, gives each its place, and the
shards' sizes in their order give every place its global slot. All texts are encoded once and moved once.

Records have one stride, so that place k of a shard is at byte k * stride, and a reader can go on anywhere.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimspark.llm import hashing
from claimspark.llm.common import materialise, shared_dir

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary cuts text before it merges bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LENGTH = 256
#: Sequences of a shard, about: their number is estimated from the texts' bytes.
SHARD = 1 << 14
BYTES_OF_ID = 3
KEY = 0x5EED5EED
ROUNDS = 6
#: Numbers before the first permutation are below this.
NUMBERS = 1 << 62
#: Copies of a much repeated row that one row stands for.
BLOCK = 1 << 10
#: Records that a task gathers before it sends them to their shards.
GATHERED = 1 << 15


def record_type(length: int = LENGTH) -> np.dtype:
    """A record: the document (if it has an id), the sequence's place in it, ids in use, ids (filled up with the end's)."""
    return np.dtype([("doc_id", "<i8"), ("has_id", "<i4"), ("seq", "<i4"), ("n", "<i4"), ("ids", "<u2", (length,))])


def feistel(number: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """The slots of numbers below ``n``: a permutation of range(n) that the key chooses."""
    half = max(1, -(-max(1, n - 1).bit_length() // 2))
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = [np.uint64(int.from_bytes(hashlib.sha256(f"{key}:{r}".encode()).digest()[:8], "little")) for r in range(ROUNDS)]
    out = number.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> shift, x & mask
        for k in keys:
            y = (right ^ k) * np.uint64(0x9E3779B97F4A7C15)
            y = (y ^ (y >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((y ^ (y >> np.uint64(32))) & mask)
        x = (left << shift) | right
        out[todo] = x
        todo = todo[x >= np.uint64(n)]
    return out.astype(np.int64)


def read_ranks(path: str = RANKS) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def _placed(docs: DataFrame, most: int) -> DataFrame:
    """(doc_id, text, at, first, copies) of each row, ``at`` a hash of it; of rows there more than ``most`` times, blocks of copies.

    Every such row takes ``most`` of all, so that what is broadcast has a ``most``-th of the table's rows at most.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("at", F.xxhash64(F.isnull("doc_id"), "doc_id", F.isnull("text"), "text"))
    often = docs.groupBy("at").count().where(F.col("count") > most).select("at")
    often = F.broadcast(materialise(often, "often"))
    single = docs.join(often, "at", "left_anti").select("doc_id", "text", "at", F.lit(0).cast("long").alias("first"), F.lit(1).cast("long").alias("copies"))
    # Copies are counted before the shuffle; a block of them is a row of its own again.
    block = max(1, min(most, BLOCK))
    many = docs.join(often, "at", "left_semi").groupBy("at", "doc_id").agg(F.first("text").alias("text"), F.count("*").alias("n"))
    many = many.select("doc_id", "text", "at", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {block}"))).alias("k"))
    many = many.select("doc_id", "text", "at", (F.col("k") * block).alias("first"), F.least(F.lit(block), F.col("n") - F.col("k") * block).alias("copies"))
    return single.unionByName(many.hint("rebalance"))


def _sequences(ids: list[bytes], at: np.ndarray, copy: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(number, row, seq, used, ids) of the sequences of texts whose ids, two bytes each, are given; ``ids`` one after the other."""
    count = np.array([len(x) // 2 for x in ids], np.int64)
    n = -(-count // length)
    row = np.repeat(np.arange(len(n)), n)
    seq = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    whole = hashing.mix(at.astype(np.uint64) + hashing.mix(hashing.mix(copy.astype(np.uint64))))
    number = hashing.mix(whole[row] + hashing.mix(seq.astype(np.uint64))) & np.uint64(NUMBERS - 1)
    return number, row, seq.astype(np.int32), np.minimum(length, count[row] - seq * length), np.frombuffer(b"".join(ids), np.uint16)


def _packed(records: list[tuple[np.ndarray, ...]], shards: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(shard, records, ids, data) of records (mixed, doc_id, has_id, seq, n, ids), one row for each shard, each column for itself."""
    mixed, doc, has, seq, n, ids = (np.concatenate(x) for x in zip(*records, strict=True))
    first = np.cumsum(n) - n
    # Equal ranges of the permuted numbers; 31 bits of them decide.
    shard = (mixed >> 31) * shards >> 31
    order = np.argsort(shard, kind="stable")
    edges = np.flatnonzero(np.diff(shard[order], prepend=-1))
    for a, b in zip(edges, np.append(edges[1:], len(order)), strict=True):
        pick = order[a:b]
        count = n[pick]
        upto = np.cumsum(count)
        used = ids[np.repeat(first[pick] - upto + count, count) + np.arange(upto[-1])]
        columns = (mixed[pick], doc[pick], has[pick].astype(np.int8), seq[pick], count.astype(np.int32), used)
        yield int(shard[pick[0]]), len(pick), len(used), pa.compress(b"".join(c.tobytes() for c in columns), "zstd", asbytes=True)


def _unpacked(data: bytes, n: int, m: int) -> list[np.ndarray]:
    kinds = ((np.int64, n), (np.int64, n), (np.int8, n), (np.int32, n), (np.int32, n), (np.uint16, m))
    sizes = np.cumsum([0, *(np.dtype(k).itemsize * size for k, size in kinds)])
    raw = pa.decompress(data, int(sizes[-1]), "zstd", asbytes=True)
    return [np.frombuffer(raw, k, size, int(at)) for (k, size), at in zip(kinds, sizes[:-1], strict=True)]


def _copies(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]]:
    """(doc_id, text, at, copy) of some rows at a time, each as often as it has copies."""
    copies = batch.column(4).to_numpy()
    row = np.repeat(np.arange(len(copies)), copies)
    copy = np.arange(len(row)) - np.repeat(np.cumsum(copies) - copies, copies) + batch.column(3).to_numpy()[row]
    for k in range(0, len(row), 256):
        part = batch.take(pa.array(row[k : k + 256]))
        yield part.column(0), part.column(1), part.column(2).to_numpy(), copy[k : k + 256]


def store(docs: DataFrame, folder: str, length: int = LENGTH, shard: int = SHARD, key: int = KEY) -> DataFrame:
    """Write ``docs`` (doc_id, text) as shards below ``folder``; (shard, path, records, first) of each, ``first`` its first slot.

    A shard is written under a name of its own and then renamed, so a task that is lost or run twice leaves whole shards
    only, of equal bytes.
    """
    spark = docs.sparkSession
    placed, vocabulary = _placed(docs, shard), read_ranks()
    end, kind = len(vocabulary), record_type(length)
    ranks = spark.sparkContext.broadcast(vocabulary)
    texts, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    shards = max(1, round((texts + size / BYTES_OF_ID / length) / shard))
    tasks = min(shards, 100_000)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encode, stop = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks.value, special_tokens={}).encode_ordinary, np.uint16(end).tobytes()
        held, gathered = [], 0

        def out() -> pa.RecordBatch:
            at, n, m, data = zip(*_packed(held, shards), strict=True)
            return pa.RecordBatch.from_arrays([pa.array([x * tasks // shards for x in at], pa.int32()), pa.array(at, pa.int64()), pa.array(n, pa.int32()), pa.array(m, pa.int64()), pa.array(data, pa.binary())], ["part", "shard", "n", "m", "data"])

        for batch in batches:
            for doc, text, at, copy in _copies(batch):
                number, row, seq, used, ids = _sequences([array("H", encode(x.as_py() or "")).tobytes() + stop for x in text], at, copy, length)
                valid = doc.is_valid().to_numpy(zero_copy_only=False)
                held.append((feistel(number, NUMBERS, key), doc.fill_null(0).to_numpy()[row], valid[row], seq, used, ids))
                gathered += len(row)
                if gathered >= GATHERED:
                    yield out()
                    held, gathered = [], 0
        if held:
            yield out()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root)
        at, held = -1, []

        def close() -> pa.RecordBatch:
            mixed, doc, has, seq, count, used = (np.concatenate(x) for x in zip(*held, strict=True))
            place = np.empty(len(mixed), np.int64)
            # Equal numbers are equal records, or else the rest of the record decides.
            place[np.lexsort((seq, doc, mixed))] = feistel(np.arange(len(mixed)), len(mixed), key ^ (at + 1))
            out = np.zeros(len(mixed), kind)
            out["doc_id"][place], out["has_id"][place], out["seq"][place], out["n"][place] = doc, has, seq, count
            out["ids"] = end
            which = np.repeat(place, count)
            out["ids"][which, np.arange(len(used)) - np.repeat(np.cumsum(count) - count, count)] = used
            part, path = f"{root}/.{uuid.uuid4().hex}", f"{root}/shard-{at:08d}.bin"
            with store.open_output_stream(part, compression=None) as stream:
                stream.write(out.data)
            store.move(part, path)
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([path]), pa.array([len(out)], pa.int64())], ["shard", "path", "records"])

        for batch in batches:
            for now, n, m, data in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                if now != at:
                    if held:
                        yield close()
                    at, held = now, []
                held.append(_unpacked(data, n, m))
        if held:
            yield close()

    sent = placed.mapInArrow(send, "part int, shard long, n int, m long, data binary")
    ranged = sent.repartitionById(tasks, "part").sortWithinPartitions("shard")
    made = materialise(ranged.mapInArrow(write, "shard long, path string, records long"), "shards")
    ranks.unpersist()
    # One row for each shard.
    return made.withColumn("first", F.sum("records").over(Window.orderBy("shard")) - F.col("records"))


def read(shards: DataFrame, folder: str, length: int = LENGTH, start: int = 0, ids: bool = False) -> DataFrame:
    """(slot, shard, byte_offset, doc_id, seq, n_tokens, ids_sha256) of the stored sequences from slot ``start`` on, with ``ids`` if asked for."""
    kind = record_type(length)
    schema = "slot long, shard long, byte_offset long, doc_id long, seq int, n_tokens int, ids_sha256 string" + ", ids array<int>" * ids
    names = [part.split()[0] for part in schema.split(", ")]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for at, path, n, first in (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)):
            k = max(0, start - first)
            with store.open_input_stream(path, compression=None) as stream:
                stream.read(k * kind.itemsize)
                while k < n:
                    rows = np.frombuffer(stream.read(min(1024, n - k) * kind.itemsize), kind)
                    if not len(rows):
                        raise ValueError(f"{path} ends before record {k}")
                    place = np.arange(k, k + len(rows))
                    raw = np.ascontiguousarray(rows["ids"]).tobytes()
                    stop = (np.arange(len(rows)) * length + rows["n"]) * 2
                    digests = [hashlib.sha256(raw[i * length * 2 : j]).hexdigest() for i, j in enumerate(stop.tolist())]
                    out = [pa.array(first + place), pa.array(np.full(len(rows), at)), pa.array(place * kind.itemsize), pa.array(rows["doc_id"].astype(np.int64), mask=rows["has_id"] == 0), pa.array(rows["seq"].astype(np.int32)), pa.array(rows["n"].astype(np.int32)), pa.array(digests)]
                    if ids:
                        out.append(pa.array([r[:m].astype(int).tolist() for r, m in zip(rows["ids"], rows["n"], strict=True)], pa.list_(pa.int32())))
                    yield pa.RecordBatch.from_arrays(out, names)
                    k += len(rows)

    wanted = shards.where(F.col("first") + F.col("records") > start).select("shard", "path", "records", "first")
    return wanted.repartition(max(1, min(wanted.count(), 10_000)), "shard").mapInArrow(task, schema)


def token_sequences(spark: SparkSession, docs: DataFrame, length: int = LENGTH, shard: int = SHARD, key: int = KEY) -> DataFrame:
    """Store ``docs`` (doc_id, text; further columns are ignored) and read the sequences back, one row each.

    Every row of ``docs``, a repeated one too, has at least one sequence: null and empty texts only the end's id. A null
    doc_id stays null. The same table gives the same slots, however it is split for reading; a table that isn't read
    from files as it is, is written first, and its numbers follow that. An empty table gives no shard and no rows.
    """
    folder = shared_dir(spark, "shards")
    return read(store(docs, folder, length, shard, key), folder, length)
