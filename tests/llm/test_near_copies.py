"""The pipeline's near-copy stage against brute force over all pairs of texts."""

import itertools
import random

import pytest

from attestor.llm import near_copies

import corpus_pipeline


def sets_of(text, shingle=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))}


def brute_roots(made):
    sets, root = [sets_of(t) for t in made], list(range(len(made)))
    links = [(a, b) for a, b in itertools.combinations(range(len(made)), 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    moved = True
    while moved:
        moved = False
        for a, b in links:
            if root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                moved = True
    return root, links


def copies():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    prose = lambda n: rng.choices(vocabulary, k=n)
    made = [prose(rng.randint(1, 80)) for _ in range(40)]
    for _ in range(12):  # near copies on both sides of 0.8
        base = prose(rng.randint(10, 300))
        made.append(base)
        for share in (0.005, 0.01, 0.02, 0.03, 0.05):
            made.append([f"n{rng.random()}" if rng.random() < share else w for w in base])
    chain = prose(120)  # links along the chain, not across it
    for k in range(12):
        made.append(chain[2 * k : 2 * k + 90])
    common, passage = prose(60), prose(30)
    made += [[*common[:k], f"x{k}", *common[k + 1 :]] for k in range(60)]  # one large group
    made += [[*prose(40), *passage, *prose(40)] for _ in range(40)] + [[*passage, f"y{k}"] for k in range(30)]
    made = [" ".join(w) for w in made]
    made += [made[50].upper(), made[50].replace(" ", "\n"), "", None, " \t", "one", "ONE", "one two", "a b c d", "a b c d e", "a b c d e f"]
    rng.shuffle(made)
    return made


@pytest.mark.parametrize("common", [20, 0, 1000])
def test_stage_keeps_one_of_each_component(spark, monkeypatch, common):
    monkeypatch.setattr(near_copies, "COMMON", common)
    made = copies()
    root, links = brute_roots(made)
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").repartition(3)
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns and len(links) > 500
    assert sorted(r["doc_id"] for r in kept.collect()) == [d for d in range(len(made)) if root[d] == d]


def test_repeated_and_null_ids(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(30)) for c in "ab")
    rows = [(1, one), (1, one), (1, two), (2, two), (None, one), (3, f"{one} tail"), (3, "other words of the same id")]
    kept = near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept) == sorted([(0, one), (1, one), (1, two), (3, "other words of the same id")])


def test_a_large_group_needs_about_one_comparison_a_set(spark, monkeypatch):
    rng, compared = random.Random(3), []
    base = [f"w{rng.randrange(4000)}" for _ in range(150)]
    made = [[*base[:k], f"x{i}", *base[k + 1 :]] for i, k in enumerate(rng.choices(range(150), k=120))]
    inner = near_copies._compared
    monkeypatch.setattr(near_copies, "_compared", lambda pairs, *rest: (compared.append(pairs.count()), inner(pairs, *rest))[1])
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(made)], "doc_id long, text string")
    assert near_copies.near_copies(docs).select("root").distinct().count() == 1
    assert sum(compared) < 2 * len(made)
