"""Fuzzy hashing by itself finds most near copies of the pipeline's stage; the rest is left to prefix filtering."""

import random

import numpy as np
from pyspark.sql import functions as F

from attestor.llm import components, golay, near_copies


def test_words_within_two_bits_share_a_near_key():
    words = np.random.default_rng(5).integers(0, 1 << 23, 300)
    flips = np.array([1 << i | 1 << j for i in range(23) for j in range(i, 23)])
    one, other = (golay.near_keys(w.ravel()) for w in np.broadcast_arrays(words[:, None], words[:, None] ^ flips))
    assert ((one[:, :, None] == other[:, None, :]) & (one[:, :, None] >= 0)).any(axis=(1, 2)).all()


def test_golay_keys_alone_meet_most_near_copies(spark, monkeypatch):
    rng, made = random.Random(9), []
    for _ in range(150):  # one to four changed words of 150: similarities of 0.95 to 0.8
        base = [f"w{rng.randrange(4000)}" for _ in range(150)]
        made.append(base)
        for k in range(1, 5):
            made.append(list(base))
            for at in rng.sample(range(150), k):
                made[-1][at] = f"x{rng.random()}"
    sets = [near_copies.shingles(" ".join(w)) for w in made]
    pairs = {(a, b) for g in range(0, len(sets), 5) for a in range(g, g + 5) for b in range(a + 1, g + 5)}
    close = {(a, b) for a, b in pairs if 1.8 * len(np.intersect1d(sets[a], sets[b])) >= 0.8 * (len(sets[a]) + len(sets[b]))}
    rows = spark.createDataFrame([(i, near_copies.fuzzy(s).tolist()) for i, s in enumerate(sets)], "sid long, fuzzy array<long>")
    met = {(r["a"], r["b"]) for r in near_copies.golay_pairs(rows).collect()}
    assert len(close) > 300 and len(met - pairs) < 20
    root = {r["node"]: r["root"] for r in components.roots(spark.createDataFrame(sorted(met & close), "a long, b long")).collect()}
    assert sum(root.get(a, a) == root.get(b, b) for a, b in close) > 0.85 * len(close)

    # in the stage they decide before prefix filtering is asked, which has only the others to verify; sids order the sets otherwise there
    asked, verified = [], near_copies._verified
    monkeypatch.setattr(near_copies, "_verified", lambda pairs, *rest: (asked.append(pairs.count()), verified(pairs, *rest))[1])
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(made)], "doc_id long, text string")
    near_copies.near_copies(docs).agg(F.count("*")).collect()
    assert len(asked) == 3 and abs(asked[0] - len(met)) < 0.05 * len(met) and asked[1] < 0.5 * asked[0]
