"""Near duplicates by row, with repeated and null ids."""

from claimspark.llm import jaccard_join
from tests.llm.test_operators import brute_components, docs_of, mixture, words  # noqa: F401


def test_near_duplicates_goes_by_row(spark):
    """Rows that share an id, or have none, are told apart by their texts, whatever their order."""
    base, other = words(200, 71), words(200, 72)
    near = " ".join(["changed", *base.split()[1:]])
    # 5 is there twice with unlike texts, one a near copy of 1; three rows without id are copies, as are two of 9.
    rows = [(1, base, "a"), (5, near, "a"), (5, other, "b"), (None, words(90, 73), "c"), (None, words(90, 73), "d"), (None, words(90, 73), "d"), (None, base, "a"), (None, words(90, 74), "a"), (9, words(80, 75), "a"), (9, words(80, 75), "a")]
    rows += [(6, "", "a"), (6, None, "a"), (6, " ", "a"), (None, "", "a")]
    want = sorted([(1, base), (5, other), (None, words(90, 73)), (None, words(90, 74)), (9, words(80, 75)), (6, ""), (6, None), (6, " "), (None, "")], key=str)
    runs = [jaccard_join.near_duplicates(docs_of(spark, x).repartition(3), all_without_id=False).collect() for x in (rows, rows[::-1])]
    assert [sorted(((r["doc_id"], r["text"]) for r in run), key=str) for run in runs] == [want, want]
    assert sorted(map(str, runs[0])) == sorted(map(str, runs[1]))


def test_near_duplicates_beside_brute_force(spark, mixture):
    kept = jaccard_join.near_duplicates(docs_of(spark, mixture), all_without_id=False).collect()
    found = brute_components([(k, text, source) for k, (_, text, source) in enumerate(mixture)], 5, 80)
    assert len(kept) == len({low for _, _, low in found})
