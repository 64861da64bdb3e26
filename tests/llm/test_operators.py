"""Each training-data operator against brute force, with nulls, empty and long texts, ties, repeats and clashing columns."""

import base64
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from claimspark.llm import ann, chat, decontaminate, jaccard_join, mixing, pii, quality, token_count, token_store, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, _size string"


def docs_of(spark, rows):
    """Documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", "y") for i, t, s in rows], DOCS)


def words(n, seed, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def mixture(spark):
    """Copies, near copies, short, empty, null and long texts, null and repeated ids."""
    base = words(200, 1)
    near = [base.split() for _ in range(6)]
    for k, w in enumerate(near):
        w[10 * k + 5] = f"z{k}"
    rows = [(1, base, "a"), (2, base, "a"), *((10 + k, " ".join(w), "b") for k, w in enumerate(near))]
    rows += [(30, None, None), (31, "", "a"), (32, "one", "a"), (33, "One", "c"), (34, "one two", "c"), (35, "  ", "c"), (36, words(30_000, 2), "a")]
    rows += [(40 + k, words(60, 50 + k), "abc"[k % 3]) for k in range(12)] + [(40, words(60, 50), "a"), (None, words(60, 50), "a")]
    return rows


def brute_components(rows, k, percent):
    sets = []
    for _, text, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    least = {}
    for x, (i, *_) in enumerate(rows):
        if i is not None:
            least[find(x)] = min(i, least.get(find(x), i))
    return sorted(((i, len(sets[x]), least.get(find(x))) for x, (i, *_) in enumerate(rows)), key=str)


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_jaccard_components(spark, mixture, k, percent):
    got = jaccard_join.jaccard_components(docs_of(spark, mixture), k, percent).collect()
    assert sorted(map(tuple, got), key=str) == brute_components(mixture, k, percent)


def test_jaccard_chain_beside_a_centre(spark):
    """A chain of edits, whose ends don't link with the centre, is one component all the same."""
    w, rows = words(150, 9, 10_000).split(), []
    for i in range(40):
        w[(7 * i) % 150] = f"n{i}"
        rows.append((i, " ".join(w), "s"))
    got = jaccard_join.jaccard_components(docs_of(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == brute_components(rows, 3, 90)


def test_empty_tables(spark):
    none = docs_of(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert jaccard_join.jaccard_components(none).isEmpty() and mixing.mix(none).isEmpty() and quality.classify(none, labels).isEmpty()
    assert token_count.token_counts(none).isEmpty() and token_store.token_sequences(spark, none).isEmpty() and pii.find(none).isEmpty()
    assert decontaminate.contaminated(none, spark.createDataFrame([(1, "a b c")], "item_id long, text string")).isEmpty()
    assert ann.nearest_neighbours(spark.createDataFrame([], "vec_id long, embedding array<float>")).isEmpty()
    assert warc.round_trip(spark, spark.createDataFrame([], "page_id long, url string, html string")).isEmpty()
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).isEmpty()


def test_near_duplicates_keeps_one_of_each(spark, mixture):
    kept = jaccard_join.near_duplicates(docs_of(spark, mixture))
    assert kept.columns == docs_of(spark, []).columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(1) == 1 and not {2, 10, 15} & set(ids) and {30, 31, 35, 36} <= set(ids) and None in ids


def test_mixing(spark, mixture):
    got = mixing.mix(docs_of(spark, mixture)).toPandas()
    assert len(got) == len(mixture)
    assert (got["taken"] <= 3 * got["size"]).all() and (got["taken"] % got["size"].clip(lower=1) == 0).all()
    targets = got.groupby(got["source"].fillna("~"))[["target", "source_size"]].first()
    assert targets["target"].sum() == pytest.approx(got["size"].sum()) or (targets["target"] == 3 * targets["source_size"]).any()
    again = mixing.mix(docs_of(spark, mixture[::-1])).toPandas()
    order = ["doc_id", "size", "taken"]
    assert got[order].sort_values(order).fillna(-1).values.tolist() == again[order].sort_values(order).fillna(-1).values.tolist()
    mixed = mixing.mixed(docs_of(spark, mixture))
    assert mixed.columns == docs_of(spark, []).columns and mixed.count() == got["copies"].sum()


def test_mixing_targets_fill_up_to_the_caps(spark):
    sizes = {"a": 10, "b": 1000, "c": 5, "d": 400, None: 7}
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    weight = dict(zip(["a", "b", "c", "d", None], [5, 2, 1, 5, 2], strict=True))
    left, open_ = float(sum(sizes.values())), set(sizes)
    want = {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if level * weight[s] > 3 * sizes[s]]
        if not full:
            want |= {s: level * weight[s] for s in open_}
            break
        for s in full:
            want[s] = 3.0 * sizes[s]
            left -= want[s]
            open_.remove(s)
    assert got == pytest.approx(want)


def test_quality(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.classify(docs, labels).toPandas()
    assert len(got) == docs.count() and got["score"].between(0, 1).all() and (got["predicted"] == (got["score"] >= 0.7)).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in zip(got["doc_id"], got["held_out"], strict=True))
    known = got[got["held_out"]].merge(labels.toPandas(), on="doc_id")
    assert (known["predicted"] == known["quality"]).mean() > 0.85
    odd = docs_of(spark, [(1, None, "a"), (2, "", "a"), (None, "x", "a")])
    assert quality.kept(odd, labels).columns == odd.columns


def test_quality_covers_the_whole_text():
    """Runs at every place count, whatever the chunk or the neighbour in the batch."""
    net = quality.fit([], np.zeros(0, np.float32))
    rng = np.random.default_rng(0)
    net = net._replace(weight=rng.normal(size=2 * quality.FILTERS).astype("f4"), table=rng.normal(size=net.table.shape).astype("f4"))
    texts = ["", "a", words(900, 4), words(100_000, 5), "b" * 700, None]
    together = quality.score_texts(texts, net)
    assert together == pytest.approx(np.concatenate([quality.score_texts([t], net) for t in texts]), abs=1e-5)
    data = np.frombuffer((texts[2] + "\0" * quality.WIDTH).encode(), np.uint8)
    value = np.array([sum(net.table[j][data[i + j]] for j in range(quality.WIDTH)) for i in range(len(data) - quality.WIDTH + 1)])
    size = quality.BLOCK * quality.STEP
    n = max(1, -(-(-(-len(value) // quality.BLOCK) - quality.PARTS) // quality.STEP) + 1)
    pooled = np.array([np.maximum(value[i * size : i * size + quality.CHUNK].max(0), 0) for i in range(n)])
    want = 1 / (1 + np.exp(-(np.concatenate([pooled.mean(0), pooled.max(0)]) @ net.weight)))
    assert together[2] == pytest.approx(want, abs=0.05)


def greedy(word, pieces):
    n = 0
    while word:
        k = next((k for k in range(len(word), 0, -1) if word[:k] in pieces), 0)
        if not k:
            return 1
        word, n = word[k:], n + 1
    return n


def test_token_counts(spark):
    rng = random.Random(4)
    for _ in range(60):
        pieces = {bytes(rng.choices(b"abc", k=rng.randint(1, 5))) for _ in range(12)}
        automaton = token_count.build(pieces)
        for _ in range(60):
            word = bytes(rng.choices(b"abcd" if rng.random() < 0.2 else b"abc", k=rng.randint(0, 14)))
            assert token_count.length(word, automaton) == greedy(word, pieces), (word, pieces)
    marked = token_count.build([b"ab", b"##c", b"##cd", b"a"], b"##")
    assert [token_count.length(w, marked) for w in (b"ab", b"abcd", b"abc", b"aab", b"c")] == [1, 2, 2, 1, 1]
    got = token_count.token_counts(docs_of(spark, [(1, "AB ab\tx", "s"), (None, None, "s")]), [b"a", b"b"]).collect()
    assert [tuple(r) for r in got] == [(1, 3, 5), (None, 0, 0)]


def test_token_store_round_trip(spark, tmp_path):
    rows = [(1, words(500, 3), "a"), (1, words(500, 3), "a"), (None, "hello  two spaces\n\n x", "b"), (4, None, "b"), (5, "", "a")] + [(k, words(k, k), "c") for k in range(6, 60)]
    folder = f"file://{tmp_path}/shards"
    shards = token_store.store(docs_of(spark, rows), folder, length=16, shard=32)
    got = token_store.read(shards, folder, 16, ids=True).toPandas().sort_values("slot")
    first = got["shard"].map({r["shard"]: r["first"] for r in shards.collect()})
    assert got["slot"].tolist() == list(range(len(got))) and (got["byte_offset"] == (got["slot"] - first) * token_store.record_type(16).itemsize).all()
    assert got["shard"].is_monotonic_increasing and 8 <= got["shard"].value_counts().min() and got["shard"].value_counts().max() <= 128
    import tiktoken

    ranks = token_store.read_ranks()
    plain = tiktoken.Encoding("t", pat_str=token_store.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((str(i), [*plain.encode_ordinary(t or ""), len(ranks)]) for i, t, _ in rows)
    pieces = {}
    for r in got.itertuples():
        pieces.setdefault("None" if pd.isna(r.doc_id) else str(int(r.doc_id)), {}).setdefault(r.seq, []).append(list(r.ids))
    have = []
    for i, by in pieces.items():
        copies = len(by[0])
        have += [(i, [x for s in sorted(by) for x in by[s][min(c, len(by[s]) - 1)]]) for c in range(copies)]
    assert sorted(have) == want
    assert token_store.read(shards, folder, 16, start=40).count() == len(got) - 40


def test_token_slots_do_not_depend_on_splits(spark, tmp_path):
    rows = [(k % 40, words(30 + k, k), "c") for k in range(200)] + [(7, words(60, 1), "c")] * 100
    docs_of(spark, rows).repartition(3).write.parquet(f"{tmp_path}/docs")
    made = []
    for most in ("128m", "1k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
        got = token_store.token_sequences(spark, spark.read.parquet(f"{tmp_path}/docs"), length=16, shard=32)
        made.append(sorted((r["slot"], r["doc_id"], r["seq"], r["ids_sha256"]) for r in got.collect()))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
    assert made[0] == made[1] and [r[0] for r in made[0]] == list(range(len(made[0])))


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 100, 1000, 4097):
        assert sorted(token_store.feistel(np.arange(n), n)) == list(range(n))
    assert (token_store.feistel(np.arange(1000), 1000) != token_store.feistel(np.arange(1000), 1000, 7)).any()


def test_decontamination(spark):
    items = [(k, f"{words(30, 100 + k, 3000)}. {words(12, 200 + k, 3000)}") for k in range(50)] + [(90, None), (91, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    filler = lambda n, s: words(n, s, 3000)
    changed = items[7][1].split()
    changed[20] = "changed"
    rows = [(1, f"{filler(500, 1)} {items[3][1]} {filler(700, 2)}", "a"), (2, items[5][1].upper(), "a"), (3, filler(5000, 3), "a"), (4, items[3][1].rpartition(". ")[0], "a")]
    rows += [(5, f"{filler(90, 5)}\n{' '.join(changed)}", "a"), (6, None, "a"), (7, "", "a"), (None, items[1][1], "a"), (8, filler(30_000, 8) + " " + items[9][1], "a")]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs_of(spark, rows), bench).collect()}
    assert got == {(1, 3), (2, 5), (5, 7), (None, 1), (8, 9)}
    clean = decontaminate.clean(docs_of(spark, rows), bench)
    assert sorted(r["doc_id"] for r in clean.collect()) == [3, 4, 6, 7] and clean.columns == docs_of(spark, []).columns


def test_wand_finds_all_above_the_threshold():
    rng = random.Random(1)
    index = decontaminate.build([(k, words(20, k, 60)) for k in range(300)])
    for _ in range(40):
        query = sorted(rng.sample(range(len(index.terms)), 25))
        full = np.zeros(300)
        for t in query:
            full[index.places[t]] += index.gains[t]
        for least in (0.3, 0.6):
            assert sorted(i for i, _ in decontaminate.wand(index, query, least)) == np.flatnonzero(full >= least - 1e-9).tolist()


def test_personal_data(spark):
    rng, parts = random.Random(2), ["a.b@x.org", "me@mail", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "4111111111111112", "+1 (743) 555-3824", "+1 2", "é", "x@y.z@q.rs", "call (743) 555-3824", "word", "\n"]
    texts = [" ".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(400)] + ["".join(rng.choices("a@.1 +-x", k=30)) for _ in range(400)]
    for text, (base, every) in zip(texts, pii.spans_of(texts, pii.field()), strict=True):
        want = sorted((m.start(), n, m.end(), kind) for n, (kind, p) in enumerate((("email", pii.EMAIL), ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")), ("card", pii.CARD), ("phone", pii.PHONE))) for m in p.finditer(text) if pii.RULES[kind](m.group()))
        assert base == [(s, e, kind) for s, _, e, kind in want] and set(base) <= set(every)
    got = pii.find(docs_of(spark, [(1, None, "a"), (2, "mail ann at example dot com or é a@b.cd", "a")])).collect()
    assert got[0]["spans"] == "" and got[0]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[1]["n_email"] == 2 and got[1]["base_sha256"] == hashlib.sha256(b"email:33:39").hexdigest()
    assert pii.masked(docs_of(spark, [(2, "é a@b.cd!", "a"), (3, None, "a")])).select("text").collect() == [("é <email>!",), (None,)]


def test_field_on_held_out_rows():
    """Labels of lines that another seed makes."""
    field, rows = pii.field(), pii.labelled_table(seed=99, rows=200)
    text = "\n".join(" ".join(w for w, _ in row) for row in rows).encode()
    data = np.frombuffer(text, np.uint8)
    w = pii.hashing.words(data, np.array([0, len(data)]))
    count = np.array([len(r) for r in rows])
    label = pii.viterbi(pii.emissions(pii.features(data, w), field), np.concatenate(([0], np.cumsum(count)[:-1])), count, field)
    gold = np.array([pii.KINDS.index(k) + 1 if k else 0 for row in rows for _, k in row])
    assert (label == gold).mean() > 0.95


def test_warc(spark):
    rows = [(5, "http://e.org/ a", "<p>é</p>", 1), (2, None, "<p>é</p>", 1), (3, "u", None, 1), (4, "u", "", 1), (6, "u", "x" * 300_000, 1), (None, "u", "<p>é</p>", 1), (7, "u", "a\r\n\r\nb", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record_type int")
    got = {r["page_id"]: r for r in warc.round_trip(spark, pages, texts=True).collect()}
    assert len(got) == len(rows)
    for i, _, html, _ in rows:
        data = (html or "").encode()
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
    assert {i: r["refers_to"] for i, r in got.items()} == {2: None, 5: 2, None: 2, 3: None, 4: 3, 6: None, 7: None}
    assert got[7]["html"] == "a\r\n\r\nb" and got[6]["html"] == "x" * 300_000
    with pytest.raises(ValueError):
        warc.parse(next(warc.members(iter([warc.record(1, "u", b"abc", None)]))).replace(b"abc", b"abd"))


def test_nearest_neighbours(spark, sf):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 64)).astype(np.float32)
    x[100:160] = x[100]
    rows = [(k, [float(v) for v in row]) for k, row in enumerate(x)]
    rows += [(1000, None), (1050, [0.0] * 64), (1100, [float("nan")] * 64), (1150, [1.0, None]), (None, [1.0] * 64), (1200, [1.0, 2.0])]
    table = spark.createDataFrame([(a, b, "c") for a, b in rows], "vec_id long, embedding array<float>, rank string")
    got = ann.nearest_neighbours(table).toPandas()
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hits = 0
    for q in range(0, 900, 50):
        score = unit @ unit[q]
        score[q] = -9
        want = np.lexsort((np.arange(900), -np.round(score, 9)))[:5]
        have = got[got["query_id"] == q].sort_values("rank")
        assert have["rank"].tolist() == [1, 2, 3, 4, 5] and have["score"].is_monotonic_decreasing
        assert have["score"].tolist() == pytest.approx(score[have["vec_id"]].tolist())
        hits += len(set(want) & set(have["vec_id"]))
    assert hits / (18 * 5) >= 0.9
    assert got[got["query_id"] == 100]["vec_id"].tolist() == [101, 102, 103, 104, 105] and not got["query_id"].isin([1000, 1050, 1100, 1150]).any()


def cheapest(roles):
    """Least cost by plain search over all ways."""
    best = {chat.START: 0.0}
    for role in roles:
        after = {}
        for a, cost in best.items():
            for x, b, more, _ in chat.choices(role):
                if x == a:
                    after[b] = min(after.get(b, 1e9), cost + more)
        best = after
    return min(cost + chat.END[s] for s, cost in best.items())


def test_chat_repair(spark):
    rng = random.Random(3)
    rows = [(conv, k, rng.choice(["user", "assistant", "system", "tool", None]), f"t{k}") for conv in (1, 2, None) for k in range(150)] + [(3, 0, "user", None)]
    got = chat.format_chats(spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, action string")).toPandas()
    assert len(got) == len(rows)
    for conv in (1, 2, None, 3):
        part = got[got["conv_id"].isna() if conv is None else got["conv_id"] == conv].sort_values("place")
        given = [chat.known(r) for c, _, r, _ in rows if c == conv]
        text = "".join(part["rendered"])
        turns = re.findall(r"<\|im_start\|>(\w+)\n(.*?)<\|im_end\|>\n", text, re.S)
        order = [r for r, _ in turns]
        assert "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in turns) == text
        rest = order[1:] if order[0] == "system" else order
        assert rest == ["user", "assistant"] * (len(rest) // 2) and len(rest) >= 2
        relabelled = sum(a != b for a, b in zip(given, part["role"], strict=True))
        merged = part["action"].str.contains("merge").sum()
        cost = relabelled * chat.RELABEL + merged * chat.MERGE + (len(turns) - (len(given) - merged)) * chat.INSERT
        assert cost == cheapest(given)
