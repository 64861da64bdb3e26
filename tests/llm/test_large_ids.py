"""Ids above 2**53, and training orders that depend on the rows alone."""

import numpy as np
import pytest

from claimspark.llm import hashing, minhash, token_store, vector_codes, warc
from tests.llm.test_operators import docs_of, words

BIG = 2**53 + 1


@pytest.mark.parametrize("nulls", [0, 2])
def test_warc_keeps_large_ids(spark, nulls):
    rows = [(BIG, "u", "a"), (BIG + 2, "u", "a"), (BIG + 3, "u", "b"), (2**63 - 1, "u", "b"), (-(2**63), "u", "c")] + [(None, "u", "a")] * nulls
    got = warc.round_trip(spark, spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect()
    assert sorted(((r["page_id"], r["refers_to"]) for r in got), key=str) == sorted([(BIG, None), (BIG + 2, BIG), (BIG + 3, None), (2**63 - 1, BIG + 3), (-(2**63), None)] + [(None, BIG)] * nulls, key=str)


def test_other_operators_keep_large_ids(spark):
    ids = [BIG, BIG + 2, None, 2**63 - 1]
    docs = docs_of(spark, [(i, words(30, 4), "s") for i in ids])
    assert sorted((r["doc_id"] for r in token_store.token_sequences(spark, docs).collect()), key=str) == sorted(ids, key=str)
    assert {r["component_id"] for r in minhash.minhash_components(docs).collect()} == {BIG}
    vectors = spark.createDataFrame([(i, [0.5] * 8, 1) for i in ids], "vec_id long, embedding array<float>, label int")
    assert sorted((r["vec_id"] for r in vector_codes.compress(vectors).collect()), key=str) == sorted(ids, key=str)


def stored(spark, docs, **more):
    return sorted((r["slot"], r["doc_id"], r["seq"], r["ids_sha256"], r["shard"], r["byte_offset"]) for r in token_store.token_sequences(spark, docs, length=16, shard=32, **more).collect())


def test_the_same_rows_have_the_same_slots(spark, tmp_path):
    """A copy of the table elsewhere, in another order and in other files, has the order of the first one."""
    rows = [(k, words(20 + k, k), "c") for k in range(80)] + [(7, words(27, 7), "c")] * 150 + [(9, None, "c"), (9, "", "c")] * 3
    docs_of(spark, rows).repartition(3).write.parquet(f"{tmp_path}/a")
    docs_of(spark, rows[::-1]).repartition(7).write.parquet(f"{tmp_path}/b")
    one, two = (stored(spark, spark.read.parquet(f"{tmp_path}/{x}")) for x in "ab")
    assert one == two == stored(spark, docs_of(spark, rows)) and one != stored(spark, docs_of(spark, rows), key=5)
    # The much repeated row is dealt to all shards.
    hot = [r[4] for r in one if r[1] == 7 and r[2] == 0]
    assert len(hot) == 151 and max(map(hot.count, set(hot))) < 40


def test_slots_by_the_rule(spark):
    """The order recomputed: numbers by row and place, the first permutation's ranges, the second one within each."""
    rows = [(k, words(40 + k, k), "c") for k in range(90)]
    docs = docs_of(spark, rows)
    got = stored(spark, docs)
    at = {r["doc_id"]: r["at"] for r in docs.selectExpr("doc_id", "xxhash64(doc_id is null, doc_id, text is null, text) at").collect()}
    sequences = sorted({(r[1], r[2]) for r in got})
    size = sum(len(t) for _, t, _ in rows)
    shards = max(1, round((len(rows) + size / token_store.BYTES_OF_ID / 16) / 32))
    u = lambda x: np.array([x], np.int64).astype(np.uint64)
    by = {}
    for doc, seq in sequences:
        whole = hashing.mix(u(at[doc]) + hashing.mix(hashing.mix(u(0))))
        number = hashing.mix(whole + hashing.mix(u(seq))) & np.uint64(token_store.NUMBERS - 1)
        mixed = int(token_store.feistel(number, token_store.NUMBERS)[0])
        by.setdefault((mixed >> 31) * shards >> 31, []).append((mixed, doc, seq))
    slot = 0
    want = []
    for shard in sorted(by):
        group = sorted(by[shard])
        place = token_store.feistel(np.arange(len(group)), len(group), token_store.KEY ^ (shard + 1))
        want += [(slot + int(p), doc, seq, shard) for p, (_, doc, seq) in zip(place, group)]
        slot += len(group)
    assert sorted(want) == [(r[0], r[1], r[2], r[4]) for r in got]
