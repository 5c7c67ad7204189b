"""A large group of texts around one text, most of them no near copies of each other: few are compared, none is missed."""

import itertools
import random

from attestor.llm import components, near_copies


def test_a_large_loose_group_needs_few_comparisons(spark, monkeypatch):
    rng, made, compared = random.Random(11), [], []
    base = [f"w{rng.randrange(4000)}" for _ in range(150)]
    for _ in range(300):  # one to nine changed words: similarities of 0.95 down to 0.3
        made.append(list(base))
        for at in rng.sample(range(150), rng.randint(1, 9)):
            made[-1][at] = f"x{rng.random()}"
    texts = [" ".join(w) for w in made]
    inner = near_copies._compared
    monkeypatch.setattr(near_copies, "_compared", lambda pairs, *rest: (compared.append(pairs.count()), inner(pairs, *rest))[1])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r["doc_id"]: r["root"] for r in near_copies.near_copies(docs).collect()}

    sets = [set(near_copies.shingles(t).tolist()) for t in texts]
    close = [(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    root = {r["node"]: r["root"] for r in components.roots(spark.createDataFrame(close, "a long, b long")).collect()}
    groups = lambda of: sorted(sorted(d for d in of if of[d] == r) for r in set(of.values()))
    assert groups(found) == groups({d: root.get(d, d) for d in range(len(texts))})
    assert len(groups(found)) > 50
    # fuzzy hashing asks for two comparisons a set at most; all that prefix filtering leaves is compared
    assert sum(compared[:2]) <= 2 * len(texts) and sum(compared) < 12 * len(texts), compared
