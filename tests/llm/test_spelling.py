"""Spelling variants against brute force over all pairs of words, and the query against a plain replay of its contract."""

import itertools
import random
import re
import zlib
from collections import Counter

import pytest

from trackloom.llm import queries, spelling


def edits(w, letters):
    for i in range(len(w) + 1):
        for c in letters:
            yield w[:i] + c + w[i:]
            if i < len(w):
                yield w[:i] + c + w[i + 1 :]
        if i < len(w):
            yield w[:i] + w[i + 1 :]


def brute(counts, times=10):
    """``word: (form, root, n, n_near, form_n)``; near words are found by trying every edit."""
    letters = sorted(set("".join(counts)))
    near = {w: {x for x in edits(w, letters) if x != w and x in counts} for w in counts}
    form = {}
    for w, some in near.items():
        best = min(some, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= times * counts[w] else None
    out = {}
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None)
    return out


def replay(rows):
    """Counted words of op13's contract."""
    total = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            if doc_id is not None and (h := zlib.crc32(f"{doc_id}:{w}".encode())) % 31 == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1 :]
            total[w] += 1
    return {w: n for w, n in total.items() if len(w) >= 7 and n >= 2}


def vocabulary(seed, size=250):
    """Words with many near ones: few letters, common beginnings and ends, repeated letters, chains of ever commoner forms."""
    rnd = random.Random(seed)
    words = {"aaaaaaa", "aaaaaaaa", "aaaaaaab", "baaaaaaa", "aaaaaaaaa", "abababab", "abababa", "bababab", "zzzzzzzzzzzzzzz"}
    while len(words) < size:
        base = rnd.choice(["inter", "", "über", "aaaa"]) + "".join(rnd.choices("abé", k=rnd.randrange(3, 9))) + rnd.choice(["", "ation", "aaaa"])
        words |= {w for w in [base, *rnd.sample(list(edits(base, "abé")), 3)] if len(w) >= 7}
    return {w: rnd.choice([2, 3, 5, 20, 30, 300, 4000]) for w in sorted(words)}


@pytest.mark.parametrize("settings", [{}, {"listed": 3}, {"places": 1, "frequent": 10**6}, {"short": 2, "long": 2}, {"short": 4, "long": 5, "listed": 10, "places": 2}])
def test_groups_are_those_of_brute_force(spark, settings):
    counts = vocabulary(len(str(settings)))
    got = spelling.group(spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3), **settings).collect()
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == brute(counts) and len(got) == len(counts)


def test_pairs_are_all_pairs_at_one_edit(spark):
    counts = vocabulary(4, 120)
    got = [(r.word, r.other) for r in spelling.near_pairs(spark.createDataFrame(list(counts.items()), "word string, n long"), listed=20).collect()]
    want = {(a, b) for a, b in itertools.combinations(sorted(counts), 2) if spelling.near(a, b)}
    assert set(got) == want and len(got) == len(want)
    with pytest.raises(ValueError, match="shorter by two"):
        spelling.near_pairs(spark.createDataFrame([("abcdefg", 1)], "word string, n long"), long=6)


def test_long_words(spark, monkeypatch):
    rnd = random.Random(8)
    words = set()
    for size in (62, 63, 64, 65, 71, 72, 73, 130):
        base = "".join(rnd.choices("ab", k=size))
        words |= {base, *rnd.sample(list(edits(base, "abc")), 40), *("c" * (size + k) for k in range(3))}
    # Lists of many words whose other half differs.
    words |= {"a" * 70 + "".join(rnd.choices("ab", k=6)) for _ in range(40)}
    counts = dict.fromkeys(words, 2)
    got = [(r.word, r.other) for r in spelling.near_pairs(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()]
    want = {(a, b) for a, b in itertools.combinations(sorted(counts), 2) if spelling.near(a, b)}
    assert set(got) == want and len(got) == len(want)


def test_near_is_one_edit():
    words = ["".join(w) for n in range(1, 5) for w in itertools.product("ab", repeat=n)]
    for a, b in itertools.product(words, repeat=2):
        assert spelling.near(a, b) == (a != b and b in set(edits(a, "ab")))


def test_query_equals_a_replay_of_its_contract(spark, tmp_path):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(None, "Wörterbuch wörterbuch WÖRTERBUCH"), (3, None), (3, ""), (4, " ".join(["x" * 300_000 + "y", "z" + "x" * 300_000 + "y"] * 2)), (5, "seventy ÷seventy× seventeen9seventeen"), (5, "seventy ÷seventy× seventeen9seventeen")]
    spark.createDataFrame([(t, i, 1, "r") for i, t in rows], "text string, doc_id long, n int, word string").write.parquet(f"{tmp_path}/documents.parquet")
    counts = replay(rows)
    long = [w for w in counts if len(w) > 1000]
    want = brute({w: n for w, n in counts.items() if w not in long}) | {w: (None, w, 2, 1, None) for w in long}
    assert len(long) == 2
    got = queries.op13_spelling_variants(spark, str(tmp_path)).collect()
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == want and len(got) == len(want)
    assert any(v[0] for v in want.values())


def test_empty_table(spark):
    assert spelling.group(spelling.vocabulary(spark.createDataFrame([], "doc_id long, text string"))).collect() == []
