"""Agreement of any number of raters against brute force."""

import random
from itertools import combinations

import pytest

from tidemark.operators import aggregate


def made(n_items, n_raters, seed, share=0.5):
    rnd = random.Random(seed)
    rows = []
    for i in range(n_items):
        for r in range(n_raters):
            if rnd.random() < share:
                rows += [(i if i % 7 else None, i % 3, f"r{r}", rnd.choice([0, 1, None]))] * rnd.choice([1, 1, 2])
    return [*rows, (1000, 0, None, 1)]


def kappa(a, b):
    n = len(a)
    agree, pa, pb = sum(x == y for x, y in zip(a, b)) / n, sum(a) / n, sum(b) / n
    chance = pa * pb + (1 - pa) * (1 - pb)
    return None if chance >= 1 else (agree - chance) / (1 - chance)


def wide(rows):
    items = sorted({(i, j) for i, j, _, _ in rows}, key=str)
    of = {}
    for i, j, r, v in rows:
        if r is not None:
            of.setdefault(r, {}).setdefault((i, j), []).append(v or 0)
    return items, {r: [max(own.get(x, [0])) for x in items] for r, own in of.items()}


@pytest.mark.parametrize("block", [3, 1000])
def test_pairs_of_raters(spark, block):
    rows = made(60, 12, 1) + [(i, 0, "none", 0) for i in range(5)]
    df = spark.createDataFrame(rows, "i int, j int, rater string, present int").repartition(5)
    got = {(r.rater_a, r.rater_b): (r.kappa, r.n) for r in aggregate.rater_agreement(df, ["i", "j"], "rater", "present", block).collect()}
    items, of = wide(rows)
    assert len(got) == len(list(combinations(of, 2)))
    for (a, b), (k, n) in got.items():
        want = kappa(of[a], of[b])
        assert a < b and n == len(items) and (k is None if want is None else abs(k - want) < 0.00051)


def test_five_hundred_raters(spark):
    rows = made(40, 500, 2, 0.3)
    df = spark.createDataFrame(rows, "i int, j int, rater string, present int")
    got = aggregate.rater_agreement(df, ["i", "j"], "rater", "present").collect()
    _, of = wide(rows)
    assert len(got) == 500 * 499 // 2
    for r in got[::997]:
        assert abs(r.kappa - kappa(of[r.rater_a], of[r.rater_b])) < 0.00051


def test_raters_against_people(spark):
    rows = made(50, 5, 3)
    people = [(i if i % 7 else None, i % 3, random.Random(i).choice([0, 1, None])) for i in range(0, 80, 2)]
    df = spark.createDataFrame(rows, "i int, j int, rater string, present int")
    human = spark.createDataFrame(people, "i int, j int, present int")
    got = {r.rater_a: (r.kappa, r.n) for r in aggregate.human_agreement(df, human, ["i", "j"], "rater", "present").collect()}
    items, of = wide(rows)
    label = {}
    for i, j, v in people:
        if v is not None:
            label[i, j] = max(v, label.get((i, j), 0))
    at = [k for k, x in enumerate(items) if x in label]
    truth = [label[items[k]] for k in at]
    assert set(got) == set(of)
    for r, (k, n) in got.items():
        assert n == len(at) and abs(k - kappa([of[r][x] for x in at], truth)) < 0.00051
    assert aggregate.human_agreement(df, human.where("false"), ["i", "j"], "rater", "present").count() == 0
    assert aggregate.rater_agreement(df.where("false"), ["i", "j"], "rater", "present").count() == 0
