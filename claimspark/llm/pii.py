"""Personal data: four base patterns, and a linear-chain conditional random field that adds what they don't cover.

The field labels every word of every text: features are hashes of the word's shape, of the word and its neighbours, and
counts of digits. It is trained by gradient ascent on a small labelled table (generated below), and decoded by Viterbi
for all lines of a batch at once. Its spans count where they keep the rules of their kind and touch no base span.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from claimspark.llm import hashing

KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A match takes whole runs of digits, so that one can begin only where a run does.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]+")
#: Rows of the feature table.
BUCKETS = 1 << 14


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(DIGITS.findall(text))


RULES: dict[str, Callable[[str], bool]] = {
    "email": lambda m: True,
    "ip": lambda m: all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m.split("."))),
    "card": lambda m: 14 <= len(d := digits_of(m)) <= 19 and luhn(d),
    "phone": lambda m: 10 <= len(digits_of(m)) <= 15,
}


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns in code points, by start and then kind as listed."""
    found = []
    for order, (kind, pattern, need) in enumerate((("email", EMAIL, "@"), ("ip", IP, "."), ("card", CARD, ""), ("phone", PHONE, "+"))):
        if need in text:
            found += [(m.start(), order, m.end(), kind) for m in _matches(kind, pattern, text) if RULES[kind](m.group())]
    return [(start, end, kind) for start, _, end, kind in sorted(found)]


def _matches(kind: str, pattern: re.Pattern, text: str) -> Iterator[re.Match]:
    """``finditer``; for addresses it begins at the run of letters before each @, where alone one can begin."""
    if kind != "email":
        yield from pattern.finditer(text)
        return
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and (c := text[start - 1]).isascii() and (c.isalnum() or c in "._%+-"):
            start -= 1
        m = pattern.match(text, start) if start < at else None
        if m:
            yield m
            done = m.end()
        at = text.find("@", max(at + 1, done))


class Field(NamedTuple):
    emit: np.ndarray  # features x labels
    move: np.ndarray  # labels x labels
    first: np.ndarray


LABELS = len(KINDS) + 1
FEATURES = 6
CLASS = np.full(256, 1, np.uint8)
CLASS[65:91], CLASS[48:58] = 2, 3
for _k, _c in enumerate(b"@.-+()[]{}:,;*$%#&!|_/\\'\"<>=~"):
    CLASS[_c] = 4 + _k


def features(data: np.ndarray, w: hashing.Words) -> np.ndarray:
    """Rows of the feature table for each word (words x FEATURES): shape, word, digits, and its neighbours' words and shape."""
    kind = CLASS[data]
    n = len(data)
    inside = np.zeros(n + 1, np.int32)
    np.add.at(inside, w.start, 1)
    np.add.at(inside, w.end, -1)
    change = np.ones(n, bool)
    change[1:] = kind[1:] != kind[:-1]
    change[w.start] = True
    change &= np.cumsum(inside[:-1]) > 0
    runs = np.flatnonzero(change)
    first = np.searchsorted(runs, w.start)
    place = np.arange(len(runs)) - np.repeat(first, np.diff(np.append(first, len(runs))))
    power = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(int(place.max()), hashing.BASE))))
    shape = hashing.mix(np.add.reduceat(hashing.BYTE[kind[runs]] * power[place], first))
    digits = np.add.reduceat(np.append((kind == 3).astype(np.int64), 0), np.stack([w.start, w.end], 1).ravel())[::2]
    level = np.digitize(digits, (1, 3, 5, 7, 10, 14, 20)).astype(np.uint64)
    side = lambda x, k: np.concatenate((x[1:], x[:1])) if k > 0 else np.concatenate((x[-1:], x[:-1]))
    parts = (shape + level, w.hash, level, side(w.hash, -1), side(w.hash, 1), side(shape, 1))
    return np.stack([(hashing.mix(p + np.uint64(0x1234567 * (j + 1))) >> np.uint64(50)).astype(np.int64) for j, p in enumerate(parts)], 1)


def emissions(rows: np.ndarray, field: Field) -> np.ndarray:
    out = field.emit[rows[:, 0]]
    for j in range(1, FEATURES):
        out = out + field.emit[rows[:, j]]
    return out


def viterbi(score: np.ndarray, begin: np.ndarray, count: np.ndarray, field: Field) -> np.ndarray:
    """The best labels of words that lie in sequences of ``count`` words from ``begin`` on; all sequences step together."""
    order = np.argsort(-count, kind="stable")
    begin, count = begin[order], count[order]
    back = np.zeros((len(score), LABELS), np.int8)
    label = np.zeros(len(score), np.int8)
    best = field.first + score[begin]
    end = best.copy()
    for t in range(1, int(count[0]) if len(count) else 0):
        live = int(np.searchsorted(-count, -t, "left"))
        both = best[:live, :, None] + field.move
        come = both.argmax(1)
        best = np.take_along_axis(both, come[:, None], 1)[:, 0] + score[begin[:live] + t]
        back[begin[:live] + t] = come
        end[:live] = best
    now = end.argmax(1)
    for t in range(int(count[0]) - 1 if len(count) else -1, -1, -1):
        live = int(np.searchsorted(-count, -t, "left"))
        at = begin[:live] + t
        label[at] = now[:live]
        now[:live] = back[at, now[:live]]
    return label


def labelled_table(seed: int = 3, rows: int = 400) -> list[list[tuple[str, str]]]:
    """A small table of labelled lines: (word, kind or "") made from templates by a seeded generator."""
    rng = np.random.default_rng(seed)
    number = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    pick = lambda x: x[int(rng.integers(len(x)))]
    words = "the of and reason then under than table river stone at is on dot version page chapter room total price".split()
    filler = lambda: [(pick(words) + pick(["", "", ",", ".", "!!", "***", "$$$"]), "") for _ in range(int(rng.integers(0, 5)))]
    name = lambda: pick(["ann", "joe", "kim.lee", "max", "mira", "sales", "info"]) + pick(["", "", number(2)])
    host = lambda: pick(["example", "mail", "post", "corp"])
    tail = lambda: pick(["com", "org", "net"])
    made: dict[str, Callable[[], list[tuple[str, str]]]] = {
        "email": lambda: [(x, "email") for x in pick([[f"{name()}", "at", host(), "dot", tail()], [name(), "(at)", host(), "(dot)", tail()], [f"{name()}(at){host()}.{tail()}"], [f"{name()}[at]{host()}[dot]{tail()}"]])],
        "ip": lambda: [(pick(["[{}]", "({})", "{}:80", "ip:{}"]).format(".".join(str(rng.integers(1, 255)) for _ in range(4))), "ip")],
        "card": lambda: [(x, "card") for x in pick([[number(4), number(4), number(4), number(4)], [".".join(number(4) for _ in range(4))], ["/".join(number(4) for _ in range(4))], [number(16)]])],
        "phone": lambda: [(x, "phone") for x in pick([[f"({number(3)})", f"{number(3)}-{number(4)}"], [f"{number(3)}-{number(3)}-{number(4)}"], [f"{number(3)}.{number(3)}.{number(4)}"], ["+1", f"({number(3)})", f"{number(3)}-{number(4)}"], [f"00{number(2)}", number(3), number(7)]])],
        "": lambda: [(x, "") for x in pick([[f"{number(4)}-{number(2)}-{number(2)}"], ["Version", f"{number(1)}.{number(1)}."], [f"${number(3)}.{number(2)}"], [f"{number(40)}"], [number(5)], [f"{number(2)}:{number(2)}"], ["token", "=", f'"{hashlib.sha1(number(9).encode()).hexdigest()}"'], ["at", "the", "dot"], [f"v{number(1)}.{number(1)}.{number(2)}.{number(4)}"]])],
    }
    cue = {"email": ["mail", "write", "contact"], "ip": ["host", "from", "server"], "card": ["card", "visa", "paid"], "phone": ["call", "tel", "phone:"], "": ["of", "on"]}
    table = []
    for _ in range(rows):
        kind = pick([*made, ""])
        table.append([*filler(), *([(pick(cue[kind]), "")] if rng.random() < 0.6 else []), *made[kind](), *filler()])
    return [row for row in table if row]


def train(table: list[list[tuple[str, str]]], steps: int = 150, rate: float = 0.5, shrink: float = 1e-3) -> Field:
    """Maximum likelihood by forward-backward sums over all rows at once (Adagrad)."""
    text = "\n".join(" ".join(word for word, _ in row) for row in table).encode()
    data = np.frombuffer(text, np.uint8)
    w = hashing.words(data, np.array([0, len(data)]))
    rows = features(data, w)
    gold = np.array([KINDS.index(kind) + 1 if kind else 0 for row in table for _, kind in row])
    count = np.array([len(row) for row in table])
    begin = np.concatenate(([0], np.cumsum(count)[:-1]))
    long = int(count.max())
    at = np.minimum(begin[:, None] + np.arange(long), len(gold) - 1)
    real = np.arange(long) < count[:, None]
    params = [np.zeros((BUCKETS, LABELS)), np.zeros((LABELS, LABELS)), np.zeros(LABELS)]
    sums = [np.full_like(p, 1e-3) for p in params]
    one = np.eye(LABELS)[gold]
    pairs = real[:, 1:].ravel()
    move_gold = np.zeros((LABELS, LABELS))
    np.add.at(move_gold, (gold[at[:, :-1]].ravel()[pairs], gold[at[:, 1:]].ravel()[pairs]), 1)
    for _ in range(steps):
        field = Field(*params)
        score = emissions(rows, field)[at]
        alpha, beta = np.zeros((*at.shape, LABELS)), np.zeros((*at.shape, LABELS))
        alpha[:, 0] = field.first + score[:, 0]
        for t in range(1, long):
            step = np.logaddexp.reduce(alpha[:, t - 1, :, None] + field.move, 1) + score[:, t]
            alpha[:, t] = np.where(real[:, t, None], step, alpha[:, t - 1])
        for t in range(long - 2, -1, -1):
            step = np.logaddexp.reduce(field.move + (score[:, t + 1] + beta[:, t + 1])[:, None], 2)
            beta[:, t] = np.where(real[:, t + 1, None], step, 0)
        whole = np.logaddexp.reduce(alpha[:, -1], 1)
        share = np.exp(alpha + beta - whole[:, None, None])[real]
        grad = np.zeros_like(params[0])
        for j in range(FEATURES):
            np.add.at(grad, rows[:, j], one - share)
        both = np.exp(alpha[:, :-1, :, None] + field.move + (score[:, 1:] + beta[:, 1:])[:, :, None] - whole[:, None, None, None])
        move = move_gold - both[real[:, 1:]].sum(0)
        first = one[begin].sum(0) - np.exp(alpha[:, 0] + beta[:, 0] - whole[:, None]).sum(0)
        for p, g, s in zip(params, (grad, move, first), sums, strict=True):
            g = g / len(table) - shrink * p
            s += g * g
            p += rate * g / np.sqrt(s)
    return Field(*(p.astype(np.float32) for p in params))


@lru_cache(1)
def field() -> Field:
    return train(labelled_table())


EDGE = "\"'`.,;:!?*$%#&|()[]{}<>"
ADDED: dict[str, re.Pattern] = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+\s*(?:@|[\[(]at[\])]|\bat\b)\s*[A-Za-z0-9-]+(?:\s*(?:\.|[\[(]dot[\])]|\bdot\b)\s*[A-Za-z0-9-]+)+", re.ASCII),
    "ip": re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9.])"),
    "card": re.compile(r"(?<![0-9])[0-9]{4}(?:[./ -]?[0-9]{4}){2}[./ -]?[0-9]{1,4}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9+])(?:\([0-9]{2,4}\)|[0-9]{2,5})(?:[ ./-]?[0-9]{2,7}){1,4}(?![0-9])"),
}


#: Phone numbers that follow each other with one separator between; a number is some runs of digits of such a chain.
CHAIN = re.compile(r"(?<![0-9+])(?:\([0-9]{2,4}\)|[0-9]+)(?:[ ./-]?[0-9]+)*")
WORD = re.compile(r"\s+")


def phones_in(text: str, start: int, end: int, free: Callable[[int, int], bool]) -> Iterator[tuple[int, int]]:
    """The numbers of one chain: of all ways to part it the one that covers most digits, those of whole words first."""
    runs = [m.span() for m in DIGITS.finditer(text, start, end)]
    head = lambda i: start if i == 0 else runs[i][0]
    tail = lambda j: end if j == len(runs) - 1 else runs[j][1] + (j == 0 and text[start] == "(")
    # best[i]: (digits of whole words, digits) from run i on, and the end of the number that begins there.
    best: list[tuple[int, int]] = [(0, 0)] * (len(runs) + 1)
    upto = [0] * len(runs)
    for i in range(len(runs) - 1, -1, -1):
        best[i] = best[i + 1]
        n = 0
        for j in range(i, len(runs)):
            n += runs[j][1] - runs[j][0]
            if n > 15:
                break
            s, e = head(i), tail(j)
            if n < 10 or not ADDED["phone"].fullmatch(text, s, e) or not re.search(r"[()./-]", text[s:e]) or not free(s, e):
                continue
            whole = (i == 0 or text[s - 1] == " ") and (j == len(runs) - 1 or text[e] == " ")
            value = (best[j + 1][0] + n * whole, best[j + 1][1] + n)
            if value > best[i]:
                best[i], upto[i] = value, j + 1
    i = 0
    while i < len(runs):
        if upto[i]:
            yield head(i), tail(upto[i] - 1)
        i = upto[i] or i + 1


def added_spans(text: str, guesses: list[tuple[int, int, str]], taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """What in the field's runs of words (start, end, kind) keeps its kind's form and rules and touches no span of ``taken``.

    Both lists are ordered by their starts; runs don't overlap. A run may hold several; after one that fails the search
    goes on behind its first word.
    """
    out = []
    starts, ends = [s for s, _, _ in taken], list(accumulate((e for _, e, _ in taken), max))

    def free(start: int, end: int) -> bool:
        before = bisect_left(starts, end)
        return not before or ends[before - 1] <= start

    for start, end, kind in guesses:
        if kind == "phone":
            out += [(s, e, kind) for m in CHAIN.finditer(text, start, end) for s, e in phones_in(text, *m.span(), free)]
            continue
        while m := ADDED[kind].search(text, start, end):
            if RULES[kind](m.group()) and free(*m.span()):
                out.append((*m.span(), kind))
                start = m.end()
            else:
                gap = WORD.search(text, m.start(), m.end())
                start = gap.end() if gap else m.end()
    return out


def guessed(data: np.ndarray, at: np.ndarray, f: Field) -> dict[int, list[tuple[int, int, str]]]:
    """Of each document in ``data`` with any: the runs of equally labelled words, as byte offsets in the document."""
    w = hashing.words(data, at)
    if not len(w.hash):
        return {}
    score = emissions(features(data, w), f)
    # Sequences are lines: a word after a line feed, or the first of a text, begins one.
    feeds = np.concatenate(([0], np.cumsum(data == 10)))
    new = np.ones(len(w.start), bool)
    new[1:] = feeds[w.start[1:]] > feeds[w.start[:-1]]
    new[w.first[:-1][w.first[:-1] < len(new)]] = True
    begin = np.flatnonzero(new)
    label = viterbi(score, begin, np.diff(np.append(begin, len(new))), f)
    hits = np.flatnonzero(label)
    if not len(hits):
        return {}
    cut = np.ones(len(hits), bool)
    cut[1:] = (np.diff(hits) > 1) | (label[hits[1:]] != label[hits[:-1]]) | new[hits[1:]]
    heads = np.flatnonzero(cut)
    tails = np.append(heads[1:], len(hits)) - 1
    doc = np.searchsorted(w.first, hits[heads], "right") - 1
    out: dict[int, list[tuple[int, int, str]]] = {}
    for d, a, b in zip(doc.tolist(), hits[heads].tolist(), hits[tails].tolist(), strict=True):
        out.setdefault(d, []).append((int(w.start[a] - at[d]), int(w.end[b] - at[d]), KINDS[label[a] - 1]))
    return out


def spans_of(texts: list[str], f: Field) -> list[tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]]:
    """(base, all) spans of each text."""
    out = []
    for row, end, data, at in hashing.slices(pa.array(texts, pa.string())):
        guesses = guessed(data, at, f)
        for d, text in enumerate(texts[row:end]):
            base = base_spans(text) if "@" in text or re.search(r"[0-9]", text) else []
            more = []
            if d in guesses:
                # Bytes of the text before each place that begin a code point.
                point = np.concatenate(([0], np.cumsum((data[at[d] : at[d + 1]] & 0xC0) != 0x80)))
                more = added_spans(text, [(int(point[a]), int(point[b]), kind) for a, b, kind in guesses[d]], base)
            out.append((base, sorted((*base, *more), key=lambda s: (s[0], KINDS.index(s[2])))))
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, base_email, base_ip, base_card, base_phone) of each row of ``docs`` (doc_id, text).

    n_ columns and spans are of all spans, base and added; base_ columns are of the base spans alone, base_sha256 their
    digest (of the empty string if there are none). A null text is empty; null ids stay; further columns are ignored; an empty table gives an
    empty one.
    """
    model = docs.sparkSession.sparkContext.broadcast(field())
    names = ["doc_id", *(f"n_{kind}" for kind in KINDS), "base_sha256", "spans", *(f"base_{kind}" for kind in KINDS)]
    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL(", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, " + ", ".join(f"base_{k} long" for k in KINDS)).fields])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                found = spans_of([x or "" for x in part.column(1).to_pylist()], model.value)
                counts, of_base = ([pa.array([sum(s[2] == kind for s in each[j]) for each in found], pa.int64()) for kind in KINDS] for j in (1, 0))
                digest = pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found])
                yield pa.RecordBatch.from_arrays([part.column(0), *counts, digest, pa.array([joined(every) for _, every in found]), *of_base], names)

    return docs.select("doc_id", "text").mapInArrow(task, schema)


def masked(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of its texts replaced by its kind in angle brackets; null texts stay null."""
    model = docs.sparkSession.sparkContext.broadcast(field())
    place = docs.columns.index("text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).to_pylist()
            out = []
            for text, (_, spans) in zip(texts, spans_of([x or "" for x in texts], model.value), strict=True):
                done, parts = 0, []
                for start, end, kind in spans:
                    if start >= done:
                        parts += [text[done:start], f"<{kind}>"]
                    done = max(done, end)
                out.append(None if text is None else "".join((*parts, text[done:])))
            yield batch.set_column(place, "text", pa.array(out, pa.string()))

    return docs.mapInArrow(task, docs.schema)
