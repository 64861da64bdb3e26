"""Chat repair against an exhaustive search over legal chats, and over any number of partitions."""

import itertools
import random

import pytest

from claimspark.llm import chat

ROLES = ["user", "assistant", "system", "tool", None]
TABLE = "conv_id long, turn long, role string, text string, action string"


def legal(n):
    """All legal chats of ``n`` turns at most."""
    for system in (False, True):
        for pairs in range(n // 2 + 1):
            found = ["system"] * system + ["user", "assistant"] * pairs
            if pairs or not system:
                yield found


def exhaustive(roles):
    """Least cost by aligning the turns with every legal chat: 2 a changed role, 1 a turn merged into the one before, 3 an added turn."""
    best = 10**9
    for target in legal(2 * len(roles) + 3):
        for places in itertools.combinations_with_replacement(range(len(target)), len(roles)):
            cost = sum(2 * (target[p] != r) for p, r in zip(places, roles, strict=True))
            cost += len(roles) - len(set(places)) + 3 * (len(target) - len(set(places)))
            best = min(best, cost)
    return best


@pytest.mark.parametrize("roles", [c for n in (1, 2, 3) for c in itertools.product(["user", "assistant", "system", "tool"], repeat=n)][::3])
def test_cost_is_the_least_of_all(roles):
    best, _ = chat.forward([chat.CODE.get(r, chat.OTHER) for r in roles], chat.BEGIN)
    assert min(b + e for b, e in zip(best, chat.END, strict=True)) == exhaustive(list(roles))


def test_cuts_change_nothing(spark):
    rng = random.Random(7)
    rows = [(1, k, rng.choice(ROLES), f"t{k}", "x") for k in range(600)] + [(None, k, rng.choice(ROLES), None, "x") for k in range(40)]
    rows += [(c, k, rng.choice(ROLES), "s" * (k % 3), "x") for c in range(2, 30) for k in range(rng.randrange(1, 9))] + [(5, 0, "user", "same", "x")] * 20
    before, made = spark.conf.get("spark.sql.shuffle.partitions"), []
    for n in (1, 2, 7):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = chat.format_chats(spark.createDataFrame(rows, TABLE))
        made.append(sorted(map(tuple, got.collect()), key=str))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert made[0] == made[1] == made[2] and len(made[0]) == len(rows)
    for conv in {r[0] for r in rows}:
        assert sorted(r[1] for r in made[0] if r[0] == conv) == list(range(sum(r[0] == conv for r in rows)))


def test_ids_of_other_types(spark):
    got = chat.format_chats(spark.createDataFrame([("a", "1", "assistant", "x"), ("b", None, None, "y")], "conv_id string, turn string, role string, text string")).collect()
    assert {(r["conv_id"], r["turn"], r["role_in"]) for r in got} == {("a", "1", "assistant"), ("b", None, None)}
