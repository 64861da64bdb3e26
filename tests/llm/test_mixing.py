"""The fractional selection with repeated rows."""

import collections

from claimspark.llm import mixing
from tests.llm.test_operators import docs_of, words


def left_over(spark, rows):
    """(words left over, words of the smallest group of equal rows not taken) of each source."""
    got = mixing.mix(docs_of(spark, rows)).toPandas()
    text = collections.defaultdict(int)
    for row in got.itertuples():
        text[row.source, row.doc_id, row.copies] += row.size
    plan = got.groupby("source")[["target", "source_size"]].first()
    epochs = {s: int(p.target // p.source_size) for s, p in plan.iterrows()}
    out = {}
    for source, p in plan.iterrows():
        small = [n for (s, _, copies), n in text.items() if s == source and n and copies == epochs[source]]
        out[source] = (p.target - got[got["source"] == source]["taken"].sum(), min(small, default=float("inf")))
    return out


def test_repeated_rows_do_not_stall_the_fills(spark):
    """Groups of equal rows, each of whose rows fits what is left though the group doesn't."""
    rows = [(1000 * s + k, words(20 + k % 7, 1000 * s + k), "abc"[s]) for s in range(3) for k in range(30)]
    rows += [(1000 * s + 500 + k, words(15, 7000 + 100 * s + k), "abc"[s]) for s in range(3) for k in range(6) for _ in range(25)]
    found = left_over(spark, rows)
    assert all(0 <= rest < small for rest, small in found.values()), found
