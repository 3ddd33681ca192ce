"""The near-duplicate stage against brute force."""

import random

import pytest

ringsets = pytest.importorskip("trackloom.llm.ringsets")


def shingles(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize("cap", [1, 16])
def test_the_stage_leaves_one_of_each_group_of_edited_copies(spark, cap):
    import corpus_pipeline

    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(5000)}"
    notice = [word() for _ in range(60)]
    texts = [None, "", " ", "two words", "Two  words"]
    for g in range(12):
        base = [word() for _ in range(rng.choice((12, 120, 300)))] + notice * (g % 2)
        for _ in range(rng.choice((1, 4, 40))):
            copy = list(base)
            for _ in range(rng.randrange(0, 9)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    sets, label = [shingles(t) for t in texts], list(range(len(texts)))
    near = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    assert any(sets[i] != sets[j] for i, j in near)
    while any(label[i] != label[j] for i, j in near):
        for i, j in near:
            label[i] = label[j] = min(label[i], label[j])
    gone = [r.key for r in ringsets.later_copies(docs.select(docs.doc_id.alias("key"), "text"), cap).collect()]
    assert sorted(gone) == sorted(set(range(len(texts))) - set(label))
    if cap == 16:
        assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, None).collect()) == sorted(set(label))


def test_every_similar_pair_shares_a_viable_key():
    import numpy as np

    rng = np.random.default_rng(7)
    for n in [*range(1, 60), 100, 300, 1000]:
        for _ in range(6):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            gone = rng.integers(0, max(1, n // 8 + 1))
            b = np.unique(np.concatenate((a[gone:], rng.integers(0, 1 << 63, rng.integers(0, max(1, n // 8 + 1)), dtype=np.uint64))))
            if not len(b) or 5 * len(np.intersect1d(a, b)) < 4 * len(np.union1d(a, b)) or len(a) == len(b) == len(np.intersect1d(a, b)):
                continue
            frequent = np.sort(rng.choice(a, n // 2, replace=False)) if n % 2 else np.zeros(0, np.uint64)
            doc, token, chain = ringsets.keys([a, b], frequent)
            held = {int(t): int(c) for d, t, c in zip(doc, token, chain) if d == 0}
            met = [held[int(t)] ^ int(c) for d, t, c in zip(doc, token, chain) if d == 1 and int(t) in held]
            assert any(all(bin(x & (1 << 16 * k) - 1).count("1") <= k for k in range(1, ringsets.CHAIN + 1)) for x in met), n


def test_crowded_keys_pass_on_a_pair_about_once(spark):
    rng = random.Random(11)
    base, rows, sets = [rng.getrandbits(63) for _ in range(120)], [], []
    for key in range(40):
        held = {t: sum(1 << b for b in rng.sample(range(48), rng.choice((0, 0, 1, 3)))) for t in base if rng.random() < 0.6}
        sets.append((key % 7, held))
        rows += [(t, key, chain, key % 7, 100, [0] * ringsets.SKETCH) for t, chain in held.items()]
    hot = spark.createDataFrame(rows, "token long, key long, chain long, component long, n long, sketch array<long>").repartition(3)
    viable = lambda x: all(bin(x & (1 << 16 * k) - 1).count("1") <= k for k in range(1, ringsets.CHAIN + 1))
    met = {(a, b): sum(viable(sets[a][1][t] ^ sets[b][1][t]) for t in sets[a][1].keys() & sets[b][1].keys()) for b in range(40) for a in range(b) if sets[a][0] != sets[b][0]}
    got = [(r.key_a, r.key_b) for r in ringsets.across(hot).collect()]
    assert set(got) == {p for p, n in met.items() if n}
    assert 10 * len(set(got)) < sum(met.values()) and len(got) < 2 * len(set(got))


def test_the_stage_links_fingerprints_first(spark, monkeypatch):
    import corpus_pipeline
    from trackloom.llm import simhash

    rng = random.Random(2)
    texts, far = [], lambda a, b: bin(simhash.fingerprint(a.encode()) ^ simhash.fingerprint(b.encode())).count("1")
    for g in range(6):
        base = [f"w{rng.randrange(9000)}" for _ in range(3000)]
        texts.append(" ".join(base))
        texts.append(" ".join([*base[:-1], f"edited{g}"]))
    near = [(i, i + 1) for i in range(0, 12, 2) if far(texts[i], texts[i + 1]) <= simhash.DISTANCE]
    assert len(near) > 3
    # One fingerprint, but other words: the check on the sets keeps these apart.
    texts += ["ab " * 900 + " ".join(f"{c}{i}" for i in range(60)) for c in "xy"]
    assert far(texts[-2], texts[-1]) <= simhash.DISTANCE
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    whole = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, None).collect()}
    assert whole == {*range(0, 12, 2), 12, 13}
    members = ringsets.members
    monkeypatch.setattr(ringsets, "members", lambda rows, often: members(rows.limit(0), often))  # the later step finds nothing
    alone = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, None).collect()}
    assert alone == set(range(14)) - {b for _, b in near}
