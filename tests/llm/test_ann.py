"""Near copies of one vector, more than rounding can tell apart."""

import numpy as np

from claimspark.llm import ann


def test_nearest_among_many_near_copies(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(200, 64)).astype(np.float32)
    x[1:150] = x[0] * rng.integers(1, 9, (149, 1)) * (1 + 3e-5 * rng.normal(size=(149, 64)))
    table = spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)], "vec_id long, embedding array<float>")
    got = ann.nearest_neighbours(table).where("query_id = 0").orderBy("rank").collect()
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    score = unit @ unit[0]
    score[0] = -9
    assert [r["vec_id"] for r in got] == np.argsort(-score)[:5].tolist()


def test_nothing_below_a_querys_floor_is_sent(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 16))
    table = spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)], "key long, v array<double>")
    queries = table.where("key % 500 = 0")
    floors = ann._floors(table, queries, 5)
    known = {r["key"]: r["floor"] for r in floors.collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert known and all(f <= np.sort(unit @ unit[k])[-6] for k, f in known.items())
    asked = ann._hashed(queries, True)
    sent = ann._ranked(ann._hashed(table, False), asked.join(floors, "key", "left"), 5).collect()
    assert all(r["high"] >= known[r["query"]] for r in sent if r["query"] in known)
    assert len(sent) < ann._ranked(ann._hashed(table, False), asked, 5).count()
