"""Operators against rules that are stated here anew: personal data, passages of a benchmark, scores, and the pipeline as a whole."""

import hashlib
import random
import re

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from claimspark.llm import decontaminate, mixing, pii, quality, queries

ROW = "doc_id long, text string, lang string, source string, n_chars long, target string, epochs string, `left` string, _size string, _row string"


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(d[::-1])) % 10 == 0


def base_by_the_contract(text):
    digits = lambda m: re.sub("[^0-9]", "", m)
    rules = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
    )
    found = sorted((m.start(), n, m.end(), kind) for n, (kind, pattern, good) in enumerate(rules) for m in re.finditer(pattern, text) if good(m.group()))
    return ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in found)


def test_base_spans_by_the_contract(spark):
    rng = random.Random(12)
    pieces = ["a@b.c", "x.y%z@host-1.org.", "@", "1.2.3.4", "1.2.3.256", "999.1.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (743) 555-3824", "+12", "+49 30 1234567 ", "é", " ", "\n", "12345678901234567890123", "0.0.0.00"]
    rows = [(k, "".join(rng.choices(pieces, k=rng.randint(0, 9)))) for k in range(500)] + [(900, None), (901, ""), (902, "1.2.3.4 " * 3000)]
    got = {r["doc_id"]: r["base_sha256"] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: hashlib.sha256(base_by_the_contract(text or "").encode()).hexdigest() for k, text in rows}


def test_op9_counts_base_spans_alone(spark, tmp_path):
    rows = [(1, "mail ann at example dot com or é a@b.cd"), (2, "call (555) 123-4567 (555) 987-6543"), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in queries.QUERIES["op9_personal_data"](spark, str(tmp_path)).collect()}
    assert [(r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for _, r in sorted(got.items())] == [(1, 0, 0, 0), (0, 0, 0, 0), (0, 0, 0, 0)]
    assert got[1]["all_email"] == 2 and got[2]["all_phone"] == 2 and got[2]["spans"].count("phone:") == 2


def bm25(query, item, items, k1=1.2, b=0.75):
    """Plain BM25 of an item for the distinct terms of a query."""
    mean = sum(map(len, items)) / len(items)
    out = 0.0
    for term in set(query):
        often = sum(term in other for other in items)
        tf = item.count(term)
        if tf:
            out += np.log(1 + (len(items) - often + 0.5) / (often + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(item) / mean))
    return out


@pytest.mark.parametrize("part", [4096, 7, 3])
def test_passages_by_plain_scoring(spark, part, monkeypatch):
    """Every window of every text against every item, without an index; parts of the index change nothing."""
    monkeypatch.setattr(decontaminate, "PART", part)
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(150)}"
    items = [[word() for _ in range(rng.choice([6, 20, 40, 70]))] for _ in range(30)]
    docs = []
    for k in range(24):
        text = [word() for _ in range(rng.randrange(300))]
        item = list(items[k % 30])
        for j in rng.sample(range(len(item)), k % 4):
            item[j] = "other"
        docs.append((k, text + item + [word() for _ in range(rng.randrange(90))]))
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.contaminated(spark.createDataFrame([(k, " ".join(w)) for k, w in docs], "doc_id long, text string"), bench).collect()}
    want = {}
    for k, text in docs:
        for n, item in enumerate(items):
            segment = 64 if len(item) <= 64 else 256
            cut = len(item) - max(1, len(item) // 4)
            for start in range(0, len(text), segment):
                window = text[start : start + 2 * segment]
                score = bm25(window, item, items) / bm25(item, item, items)
                grams = {tuple(item[i : i + 5]) for i in range(len(item) - 4)}
                share = len(grams & {tuple(window[i : i + 5]) for i in range(len(window) - 4)}) / len(grams)
                halves = all(len(set(p) & set(window)) >= 0.8 * len(set(p)) for p in (item[:cut], item[cut:]))
                if score >= 0.6 - 1e-9 and share >= 0.8 and halves and share > want.get((k, n), (0, 0))[0]:
                    want[k, n] = (share, score)
    assert {key: pytest.approx(score, rel=1e-4) for key, (_, score) in want.items()} == got and len(want) >= 10


def test_quality_score_is_exact(spark):
    net = quality.fit([], np.zeros(0, np.float32))
    rng = np.random.default_rng(3)
    net = net._replace(weight=rng.normal(0, 0.1, 2 * quality.FILTERS).astype("f4"), table=rng.normal(0, 0.3, net.table.shape).astype("f4"), bias=rng.normal(0, 0.1, quality.FILTERS).astype("f4"))
    for text in ("", "short", "word " * 300, "é" * 2000):
        # Runs may begin at every byte, and end in zeros behind the text.
        blocks = (len(text.encode()) + quality.WIDTH) // quality.BLOCK + 1
        data = np.zeros(blocks * quality.BLOCK + quality.WIDTH, np.uint8)
        data[: len(text.encode())] = np.frombuffer(text.encode(), np.uint8)
        value = sum(net.table[j][data[j : len(data) - quality.WIDTH + j]] for j in range(quality.WIDTH)).astype(float)
        value[blocks * quality.BLOCK - quality.WIDTH + 1 :] = -np.inf
        value = np.maximum(value + net.bias, 0)
        size, step = quality.CHUNK, quality.BLOCK * quality.STEP
        n = max(1, -(-(blocks - quality.PARTS) // quality.STEP) + 1)
        pooled = np.array([value[k * step : min(k * step + size, blocks * quality.BLOCK)].max(0) for k in range(n)])
        want = 1 / (1 + np.exp(-(np.concatenate([pooled.mean(0), pooled.max(0)]) @ net.weight + net.shift[0])))
        assert quality.score_texts([text], net)[0] == pytest.approx(want, abs=1e-4)


def test_no_labels_keep_all_rows(spark):
    docs = spark.createDataFrame([(1, "x", "en", "a", 1, "t", "e", "l", "s", "d"), (None, None, None, None, None, None, None, None, None, None)], ROW)
    for labels in ([], [(1, None)], [(2, 1), (2, 0)]):
        assert quality.kept(docs, spark.createDataFrame(labels, "doc_id long, quality int")).count() == 2


def test_mixed_leaves_clashing_columns_alone(spark):
    rows = [(k, "word " * (3 + k), "en", "ab"[k % 2], k, f"t{k}", f"e{k}", f"l{k}", f"s{k}", f"d{k}") for k in range(12)] + [(None, None, None, None, None, "t", "e", "l", "s", "d")]
    docs = spark.createDataFrame(rows, ROW)
    got = mixing.mixed(docs)
    assert got.schema == docs.schema and {tuple(r) for r in got.collect()} <= {tuple(r) for r in docs.collect()}
    plan = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect()}
    assert sorted(r["doc_id"] for r in got.where("doc_id is not null").collect()) == sorted(k for k, n in plan.items() if k is not None for _ in range(n))


def test_pipeline(spark, tmp_path):
    """All stages on a small corpus: nulls, empty and repeated rows, copies, a benchmark's passage, columns that clash; and an empty one."""
    rng = random.Random(9)
    good = lambda n: " ".join(rng.choice(["calm", "river", "stone", "under", "green", "table", "window", "morning"]) + str(rng.randrange(40)) for _ in range(n)) + "."
    junk = lambda n: " ".join("".join(rng.choice("$#%&*!|") for _ in range(6)) for _ in range(n))
    item = good(40)
    docs, labels = [], []
    for k in range(240):
        bad = k % 3 == 0
        docs.append((k, junk(80) if bad else good(90), "en", f"s{k % 3}"))
        labels.append((k, 0 if bad else 1, 0))
    copy = docs[1][1]
    docs += [(500, copy, "en", "s1"), (501, copy.replace("calm", "calm", 1) + " end", "en", "s2"), (502, good(60) + " " + item + " " + good(60), "en", "s1"), (None, good(70), "en", None), (503, None, "en", "s1"), (504, "", "en", "s1"), docs[2]]
    folder = tmp_path / "sf"
    table = spark.createDataFrame([(i, t, g, s, len(t or ""), "t", "e", "l", "z", "d") for i, t, g, s in docs], ROW)
    table.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    now, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, now, str(folder)).write.parquet(f"{tmp_path}/stage{k}")
        now = spark.read.parquet(f"{tmp_path}/stage{k}")
        assert now.columns == table.columns
        seen.append([r["doc_id"] for r in now.collect()])
    first, second, third, fourth = map(set, seen)
    clean = {k for k in range(240) if k % 3}
    assert len(clean & first) >= 0.95 * len(clean) and len({k for k in range(0, 240, 3)} & first) <= 4
    assert clean & first <= second and not {500, 501} & second and len(seen[1]) == len(set(seen[1])) and None in second
    assert second - third == {502} & second and fourth <= third
    shards = corpus_pipeline.run(spark, str(folder))
    assert {r["doc_id"] for r in shards.select("doc_id").distinct().collect()} == fourth
    empty = tmp_path / "none"
    table.where(F.lit(False)).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{empty}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{empty}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(empty)).isEmpty()
