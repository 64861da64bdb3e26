"""Vector codes against the rule stated anew in plain integers."""

import hashlib
import math
import random

import pytest

from claimspark.llm import vector_codes

FIELDS = "vec_id long, embedding array<float>, label int, code int"


def plainly(rows):
    """The contract with Python integers; rows of (vec_id, embedding, label) of one width."""
    kept = [(i, [math.floor(4096 * c) for c in v], lab) for i, v, lab in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = len(kept[0][1]) // 8
    cut = [[v[p * size : (p + 1) * size] for _, v, _ in kept] for p in range(8)]
    books = [[list(x) for x in part[:16]] for part in cut]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    near = lambda x, book: min(range(len(book)), key=lambda e: (far(x, book[e]), e))
    for _ in range(6):
        for part, book in zip(cut, books):
            where = [near(x, book) for x in part]
            for e in range(len(book)):
                own = [x for x, w in zip(part, where) if w == e]
                if own:
                    book[e] = [sum(c) // len(own) for c in zip(*own)]
    codes = [[near(part[k], book) for part, book in zip(cut, books)] for k in range(len(kept))]
    errors = [sum(far(part[k], book[e]) for part, book, e in zip(cut, books, codes[k])) for k in range(len(kept))]
    labels = {lab: sum(e for e, (_, _, x) in zip(errors, kept) if x == lab) for lab in {r[2] for r in kept}}
    sha = hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()
    return sorted(((i, "".join(f"{e:02x}" for e in code), err, labels[lab], sha) for (i, _, lab), code, err in zip(kept, codes, errors)), key=str)


def ours(docs):
    return sorted((tuple(r) for r in vector_codes.compress(docs).collect()), key=str)


def single(x):
    import numpy as np

    return None if x is None else float(np.float32(x))


def made(n, width, seed, spread=1.0):
    r = random.Random(seed)
    return [(k, [single(r.gauss(0, spread)) for _ in range(width)], r.choice([None, 1, 2])) for k in range(n)]


@pytest.mark.parametrize("rows", [made(90, 16, 1), made(40, 8, 2), made(7, 24, 3), made(60, 16, 4, 1000.0)])
def test_against_the_rule(spark, rows):
    assert ours(spark.createDataFrame([(*r, 5) for r in rows], FIELDS)) == plainly(rows)


def test_nulls_ties_and_repeats(spark):
    rows = made(30, 8, 5)
    hot = rows[3][1]
    rows += [(100 + k, hot, 1) for k in range(40)] + [(3, hot, 2), (3, hot, 2), (None, rows[7][1], None), (None, rows[8][1], None)]
    rows += [(200, None, 1), (201, [None] + hot[1:], 1), (202, [float("nan")] + hot[1:], 1), (203, [float("-inf")] + hot[1:], None), (-1, [0.0] * 8, 9), (-2, [-0.0] * 8, 9)]
    assert ours(spark.createDataFrame([(*r, 5) for r in rows], FIELDS).repartition(7)) == plainly(rows)


def test_other_widths_and_empty_tables(spark):
    rows = made(20, 8, 6)
    odd = [(-5, [], 1), (500, [0.5] * 16, 1), (-6, [0.5] * 7, 1)]
    assert ours(spark.createDataFrame([(*r, 5) for r in rows + odd], FIELDS)) == plainly(rows)
    assert ours(spark.createDataFrame([], FIELDS)) == [] == ours(spark.createDataFrame([(1, None, 1, 1)], FIELDS))


def test_too_large_a_component_is_an_error(spark):
    with pytest.raises(Exception, match="op13"):
        ours(spark.createDataFrame([(1, [1e30] + [0.0] * 7, 1, 1)], FIELDS))


def test_decoding_gives_the_error(spark):
    rows = made(50, 16, 8)
    table = vector_codes.integers(spark.createDataFrame([(*r, 5) for r in rows], FIELDS))
    books = vector_codes.train(table)
    back = vector_codes.decode(vector_codes.encode(table, books), books).withColumnRenamed("v", "w")
    found = back.join(table, "vec_id").collect()
    assert len(found) == 50 and all(r.error == sum((a - b) ** 2 for a, b in zip(r.v, r.w)) for r in found)
