"""Token alignment against rules stated anew: common ends, all pairs of a group, counts by plain dictionaries."""

import hashlib
import json
import random
from collections import Counter, defaultdict

import pytest

from claimspark.llm import alignment
from claimspark.llm.common import table


def letters():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    for k, b in enumerate(sorted(set(range(256)) - set(plain))):
        out[chr(256 + k)] = b
    return out


@pytest.fixture(scope="module")
def plainly():
    """A function from texts to the contract's rows."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    byte = Tokenizer.from_file(alignment.BYTE_FILE)
    byte.encode_special_tokens = True
    piece = SentencePieceProcessor(model_file=alignment.PIECE_FILE)
    to_byte = letters()

    def groups(text):
        whole = f" {text}".encode()
        a, b = byte.encode(f" {text}", add_special_tokens=False).ids, piece.encode(text)
        bytes_a = [bytes(to_byte[c] for c in byte.id_to_token(x)) for x in a]
        bytes_b = [bytes([int(p[3:5], 16)]) if piece.is_byte(x) else p.replace("▁", " ").encode() for x in b for p in [piece.id_to_piece(x)]]
        if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            return None
        ends = []
        for tokens in (bytes_a, bytes_b):
            ends.append([sum(map(len, tokens[: k + 1])) for k in range(len(tokens))] if len(tokens) < 500 else __import__("numpy").cumsum(list(map(len, tokens))).tolist())
        both = sorted(set(ends[0]) & set(ends[1]))
        where = {e: k for k, e in enumerate(both)}
        out = [([], []) for _ in both]
        import bisect

        for side, (ids, at) in enumerate(zip((a, b), ends)):
            for x, e in zip(ids, at):
                out[bisect.bisect_left(both, e)][side].append(x)
        assert len(where) == len(out)
        return out

    def rows(texts):
        found = [groups(t) if t else None for t in texts]
        held = Counter()
        for g in found:
            held.update({(x, y) for a, b in g or () for x in a for y in b})
        top = defaultdict(int)
        for (x, _), n in held.items():
            top[x] = max(top[x], n)
        out = []
        for g in found:
            if g is None:
                out.append((0, 0, 0, 0, 0, 0, ""))
                continue
            links = [(x, y) for a, b in g for x in a for y in b]
            written = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
            out.append((sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(links), sum(held[k] == top[k[0]] for k in links), sum(held[k] for k in links), hashlib.sha256(written.encode()).hexdigest()))
        return out

    return rows


def ours(docs, **more):
    return [tuple(r) for r in alignment.align(docs, **more).orderBy("doc_id").collect()]


ODD = [
    None, "", " ", "a", "  two  spaces \n\t x ", "<|endoftext|> and <s> </s> <unk> <0x41>", "naïve café 東京タワー 🙂🙂 مرحبا", "a▁b", "x" * 700, " " * 900, "é" * 300, "don't we'll I'M '9 it''s",
    "﻿bom  nbsp　wide \x00nul\x85next", "12345 67,890 3.14 ½", "word " * 40, "word " * 40,
]


def test_odd_texts(spark, plainly):
    texts = ODD + [" ".join(random.Random(k).choices(["Größe", "der", "straße", "qu'il", "été", "==>", "0x1f", "\n\n", "\t", "naïveté", "日本語", "…"], k=60)) for k in range(30)]
    docs = spark.createDataFrame([(k, t, k) for k, t in enumerate(texts)], "doc_id long, text string, n_links int")
    assert ours(docs) == [(k, *r) for k, r in enumerate(plainly(texts))]


def test_whole_table(spark, plainly):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    found = docs.select("doc_id", "text").orderBy("doc_id").collect()
    assert ours(docs) == [(r.doc_id, *x) for r, x in zip(found, plainly([r.text for r in found]))]


def test_cuts_and_rare_pairs_change_nothing(spark, plainly, monkeypatch):
    """Pieces of 40 characters, few texts a call, three pairs broadcast, and partial counts passed on early."""
    texts = [r.text for r in table(spark, "/root/testdata/sf0.001", "documents").limit(40).collect()] + ODD
    want = [(k, *r) for k, r in enumerate(plainly(texts))]
    for name, value in (("PIECE", 40), ("CALL_TEXTS", 3), ("CALL_CHARS", 200), ("HOT", 3), ("HELD", 50), ("WIDE", 5), ("ROWS", 7)):
        monkeypatch.setattr(alignment, name, value)
    # Workers import the module anew, so what they use is held against the same values here.
    t = alignment.Tokenizers(alignment.BYTE_FILE, alignment.PIECE_FILE)
    found = alignment.Aligner(t).texts(texts)
    assert [(x.n_a, x.n_b, x.n_groups, x.n_links, x.digest.hexdigest()) if x else (0, 0, 0, 0, "") for x in found] == [(w[1], w[2], w[3], w[4], w[7]) for w in want]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert ours(docs) == want


def test_stretches_are_jumped_exactly():
    r = random.Random(3)
    for _ in range(300):
        a, b = (sorted({*r.sample(range(1, 60), r.randint(0, 40)), 60}) for _ in "ab")
        if r.random() < 0.5:
            b = sorted({*a, *r.sample(range(1, 60), 3)})
        both, seen = sorted(set(a) & set(b)), []
        for i, n, j in zip(*alignment.runs(a, b)):
            assert n or a[i] != b[j]
            seen += a[i : i + n] or [next(x for x in a[i:] if x in set(b))]
        assert seen == both


def test_null_ids_and_repeats(spark):
    docs = spark.createDataFrame([(None, "one two"), (5, "one two"), (5, "one two"), (7, None)], "doc_id long, text string")
    found = sorted((tuple(r) for r in alignment.align(docs).collect()), key=str)
    assert len(found) == 4 and {r[6] for r in found} == {0, 3 * found[0][4] if found[0][4] else 3 * found[1][4]}


def test_the_quick_encoder_is_the_same():
    """Every token is made of the two that its merge names, so merging by ranks gives what merging by the list gives."""
    t = alignment.Tokenizers(alignment.BYTE_FILE, alignment.PIECE_FILE)
    with open(alignment.BYTE_FILE, encoding="utf-8") as f:
        merges = json.load(f)["model"]["merges"]
    to_byte, tokens = letters(), t.byte_tokens
    ranks = {x: k for k, x in enumerate(tokens[:50256])}
    for k, m in enumerate(merges):
        left, right = (bytes(to_byte[c] for c in x) for x in (m if isinstance(m, list) else m.split(" ")))
        parts = [bytes([x]) for x in left + right]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: (ranks.get(parts[i] + parts[i + 1], 1 << 30), i))
            if ranks.get(parts[best] + parts[best + 1], 1 << 30) >= 256 + k:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        assert parts == [left, right], k
    assert t._quick is not None
