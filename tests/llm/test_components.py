"""Components by one task, and by rounds of contraction before it, against plain union-find."""

import random

import pytest

from attestor.llm import components


def plain(pairs):
    of = {x: x for p in pairs for x in p}
    for _ in of:
        before = dict(of)
        for a, b in pairs:
            of[a] = of[b] = min(of[a], of[b])
        if of == before:
            return of
    return of


def links(seed):
    draw = random.Random(seed)
    chain, star = [(i, i + 1) for i in range(-40, 40)], [(10**12, 10**12 + draw.randrange(1, 500)) for _ in range(60)]
    loose = [(draw.randrange(5000, 5200), draw.randrange(5000, 5200)) for _ in range(90)]
    made = [p if draw.random() < 0.5 else p[::-1] for p in chain + star + loose if p[0] != p[1]]
    draw.shuffle(made)
    return made + made[:9]


@pytest.mark.parametrize("most", [1 << 14, 30, 0])
def test_roots_are_the_smallest_nodes(spark, monkeypatch, most):
    monkeypatch.setattr(components, "SETTLED", most)
    pairs = links(most) if most else [(1, 9), (9, 4), (3, 8)]
    got = components.roots(spark.createDataFrame([*pairs, (7000, 7000)], "a long, b long")).collect()
    assert dict(got) == plain(pairs) and len(got) == len(plain(pairs))


def test_no_links_give_no_nodes(spark):
    assert components.roots(spark.createDataFrame([], "a long, b long")).collect() == []


def test_few_links_take_few_jobs(spark):
    """Each job of a round leaves plans and compiled code with the driver."""
    tracker, name = spark.sparkContext.statusTracker(), "components-jobs"
    table = spark.createDataFrame(links(1), "a long, b long")
    spark.sparkContext.setJobGroup(name, name)
    try:
        components.roots(table)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(tracker.getJobIdsForGroup(name)) <= 6
