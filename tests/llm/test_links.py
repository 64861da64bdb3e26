"""Circulant MinHash beside brute force, and regions that must be divided again and again."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimspark.llm import jaccard_join, links, minhash
from claimspark.llm.common import materialise
from tests.llm.test_operators import brute_components, docs_of, mixture, words  # noqa: F401


def families(centres, members, seed, n=120):
    """Texts about some centres: those of one centre are like each other, above and below the threshold, others aren't."""
    r, rows = random.Random(seed), []
    for c in range(centres):
        base = words(n, seed * 1000 + c, 5000).split()
        for m in range(members):
            w = list(base)
            for at in r.sample(range(n), r.randint(0, 6)):
                w[at] = f"x{r.randrange(3)}"
            rows.append((len(rows), " ".join(w), "s"))
    return rows


def minhash_rows(df):
    rows = [tuple(r) for r in df.collect()]
    assert all(k == (i == c if None not in (i, c) else c is None) for i, _, c, k in rows)
    return sorted((r[:3] for r in rows), key=str)


@pytest.mark.parametrize(("k", "percent"), [(5, 85), (3, 80)])
def test_minhash_components(spark, mixture, k, percent):  # noqa: F811
    assert minhash_rows(minhash.minhash_components(docs_of(spark, mixture), k, percent)) == brute_components(mixture, k, percent)


def test_minhash_on_families_and_a_hot_group(spark):
    rows = families(6, 20, 3) + [(1000 + i, words(80, 5), "s") for i in range(60)] + [(2000, None, "s"), (2001, "", "s"), (2002, "one two", "s"), (2003, "ONE  two", "s"), (2002, "one two", "s"), (None, "one two", "s"), (None, " ", "s")]
    assert minhash_rows(minhash.minhash_components(docs_of(spark, rows).repartition(5))) == brute_components(rows, 5, 85)


def test_clashing_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c", 5, b"x", [1])], "doc_id long, text string, n long, node binary, bands array<int>")
    assert [tuple(r) for r in minhash.minhash_components(docs).collect()] == [(1, 1, 1, True)]
    assert minhash.minhash_components(docs_of(spark, [])).isEmpty()


def test_signatures_estimate_the_similarity():
    """Equal coordinates of two signatures are about as many as the similarity says, and the permutations lose nothing."""
    r = np.random.default_rng(5)
    x = r.integers(0, 2**63, 4000).astype(np.uint64)
    assert len(np.unique(minhash.permuted(x, minhash.FIRST))) == len(np.unique(x))
    for common in (900, 500, 100):
        both = np.concatenate([x[:1000], x[1000 - common : 2000 - common]])
        a, b = minhash.signatures(both, np.array([1000, 1000]), 1024)
        assert abs((a == b).mean() - common / (2000 - common)) < 0.06
    assert (minhash.signatures(x[:0], np.array([0, 0])) == 0).all()


def compared(monkeypatch):
    """Collects how many pairs of whole sets are asked for."""
    seen, plain = [], links._compare

    def counted(docs, k, percent, pairs, node, every=False):
        seen.append(pairs.count())
        return plain(docs, k, percent, pairs, node, every)

    monkeypatch.setattr(links, "_compare", counted)
    return seen


def one_region(spark, rows, k, percent):
    """All sets in one region, as if a shingle that all have were the rarest."""
    docs = docs_of(spark, rows)
    profile = minhash._profiles(docs.select("doc_id", "text"), k, percent)
    node = materialise(profile.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.first("prefix").alias("prefix")), "nodes")
    member = materialise(node.select(F.lit(1).cast("long").alias("s"), "node", "n", F.xxhash64("node").alias("pri"), F.lit(0).alias("pos")), "shared")
    return sorted(map(tuple, links.labelled(profile, node, links.classes(docs, k, percent, node, member)).collect()), key=str)


def test_clusters_are_compared_at_once(spark, monkeypatch):
    """No pair is made, and each set is sent once."""
    rows = families(6, 25, 9)
    seen = compared(monkeypatch)
    assert one_region(spark, rows, 3, 90) == brute_components(rows, 3, 90) and not seen


def classes_of(n, pairs):
    root = list(range(n))
    for _ in range(n):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_spanning_links():
    r = random.Random(4)
    for percent in (40, 60, 90):
        for _ in range(40):
            base = [r.sample(range(60), r.randint(1, 14)) for _ in range(5)]
            sets = [np.array(sorted({x for x in r.choice(base) if r.random() < 0.85} | {r.randrange(60)})) for _ in range(30)]
            every = [(a, b) for a in range(30) for b in range(a) if 100 * len({*sets[a]} & {*sets[b]}) >= percent * len({*sets[a]} | {*sets[b]})]
            found = links.spanning(sets, percent)
            assert {(max(p), min(p)) for p in found} <= set(every) and classes_of(30, found) == classes_of(30, every) and len(found) < 30


def test_regions_are_divided_until_they_are_small(spark, monkeypatch):
    """Fourteen families in one region: divided, it takes far fewer pairs, with the same result."""
    monkeypatch.setattr(links, "CLUSTER", 0)
    rows = families(14, 18, 7)
    want = brute_components(rows, 3, 90)
    seen = compared(monkeypatch)
    assert one_region(spark, rows, 3, 90) == want
    whole = sum(seen)
    seen.clear()
    monkeypatch.setattr(links, "PAIRS", 400)
    monkeypatch.setattr(links, "PIVOTS", 6)
    assert one_region(spark, rows, 3, 90) == want
    assert len(seen) > 3 and sum(seen) < 0.5 * whole and whole < len(rows) ** 2 / 2


def test_a_region_just_under_the_threshold(spark, monkeypatch):
    """All are about equally far from each other, so that no division helps: it ends after one, and the result is whole."""
    base, rows = words(100, 8, 5000).split(), []
    for i in range(40):
        w = list(base)
        for j in range(2):
            w[(11 * i + 37 * j) % 100] = f"y{i}-{j}"
        rows.append((i, " ".join(w), "s"))
    want = brute_components(rows, 3, 90)
    monkeypatch.setattr(links, "CLUSTER", 0)
    monkeypatch.setattr(links, "PAIRS", 100)
    seen = compared(monkeypatch)
    assert one_region(spark, rows, 3, 90) == want
    assert len(seen) <= 4 and seen[-1] <= len(rows) * (len(rows) - 1) / 2


def test_join_with_divided_regions(spark, monkeypatch):
    monkeypatch.setattr(links, "CLUSTER", 20)
    monkeypatch.setattr(links, "PAIRS", 8)
    rows = families(5, 12, 11) + [(500 + i, f"{words(40, 12)} {words(90, 100 + i, 30)}", "s") for i in range(20)]
    got = jaccard_join.jaccard_components(docs_of(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == brute_components(rows, 3, 90)


@pytest.mark.parametrize("percent", [60, 75, 80, 90, 97])
def test_linked_sets_share_a_run(spark, percent):
    """Pairs at the threshold itself, with what they don't share at the worst places of the order."""
    r, rows, pairs = random.Random(percent), [], 0
    for size in [*range(1, 60), 100, 211, 300]:
        for mode in range(6):
            least = -(-percent * size // 100)
            a = [size - least, 0, r.randint(0, size - least)][mode % 3]
            # As many as may lie in the other set alone: 100 * (size - a) >= percent * (size + b).
            b = max(0, 100 * (size - a) // percent - size)
            if not a + b or size - a < 1:
                continue
            odd, both = ["x"] * a + ["y"] * b, size - a
            r.shuffle(odd)
            if mode < 3:  # alternately, so that common ones follow each other as late as possible
                order = [z for i in range(max(len(odd), both)) for z in (["c"] if i < both else []) + odd[i : i + 1]]
            else:
                order = ["c"] * both + odd
                r.shuffle(order)
            x, y = ([i for i, z in enumerate(order) if z in "c" + own] for own in "xy")
            assert 100 * both >= percent * len(order)
            for own, other in ((x, "x"), (y, "y")):
                most = int(jaccard_join.window(np.array([len(own)]), percent)[0])
                rows.append((f"{pairs}{other}".encode(), len(own), own[:most]))
            pairs += 1
    node = spark.createDataFrame(rows, "node binary, n long, prefix array<long>")
    runs = {}
    for name, _, s in jaccard_join._runs(node, percent).collect():
        runs.setdefault(bytes(name), set()).add(s)
    assert pairs > 100 and all(runs[f"{i}x".encode()] & runs[f"{i}y".encode()] for i in range(pairs))


def test_shingles_shared_by_chance_chain_nothing(spark, monkeypatch):
    """A chain of texts, each with one rare shingle of the next, and one real pair: only that pair has regions."""
    own = [words(40, 900 + i, 10**6).split() for i in range(60)]
    rows = [(i, " ".join([*own[i], f"p{i} q r", *own[i][::-1], f"p{i + 1} q r"]), "s") for i in range(60)]
    rows.append((100, rows[7][1] + " more", "s"))
    seen, plain = [], jaccard_join.classes

    def counted(docs, k, percent, node, member):
        seen.extend(r["node"] for r in member.select("node").distinct().collect())
        return plain(docs, k, percent, node, member)

    monkeypatch.setattr(jaccard_join, "classes", counted)
    got = jaccard_join.jaccard_components(docs_of(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == brute_components(rows, 3, 90) and len(seen) == 2
