"""Periodic runs against brute force over all periods, and the query against a plain replay of its contract."""

import hashlib
import random
import zlib
from fractions import Fraction

import pytest

from trackloom.llm import periodic, queries


def brute(words, least=24, exponent=3):
    """Maximal stretches of each period from the smallest on; one inside a stretch of a divisor's period is no run of its own."""
    found = []
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            size = i - start + q
            if i > start and size >= max(least, exponent * q) and not any(s <= start and start + size <= s + n and q % p == 0 for s, n, p in found):
                found.append((start, size, q))
            i += i == start
    return sorted(found, key=lambda r: (r[0], r[2]))


def replay(doc_id, text):
    """The columns of op11 for one document."""
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    gone = {i for s, size, p in runs for i in range(s + p, s + size)}
    digest = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, digest("".join(f"{s},{size},{p}\n" for s, size, p in runs).encode()), digest(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def _words(rnd):
    n, kinds = rnd.choice([0, 1, 5, 23, 24, 30, 60, 120]), rnd.choice([1, 2, 2, 3, 5])
    words = [rnd.randrange(kinds) for _ in range(n)]
    if n > 5 and rnd.random() < 0.6:
        a, p = rnd.randrange(n), rnd.randrange(1, n // 2 + 1)
        words = [w if i < a else words[min(n - 1, a + (i - a) % p)] for i, w in enumerate(words)]
    return words


@pytest.mark.parametrize(("least", "exponent"), [(24, 3), (6, 2), (4, 4), (1, 2)])
@pytest.mark.parametrize("few", [1, 16])
def test_runs_are_those_of_brute_force(monkeypatch, least, exponent, few):
    monkeypatch.setattr(periodic, "FEW", few)
    rnd = random.Random(least + few)
    rows = [_words(rnd) for _ in range(150)]
    texts = [" ".join(map(str, w)).encode() for w in rows]
    for words, (_, found) in zip(rows, periodic.of_texts(texts, least, exponent), strict=True):
        assert list(map(tuple, found.T.tolist())) == brute(words, least, exponent)


def test_texts_sorted_together_stay_apart(monkeypatch):
    texts = [b"a " * 30, b"a b " * 20, b"a", b"", b"a " * 24]
    expected = [[(0, 30, 1)], [(0, 40, 2)], [], [], [(0, 24, 1)]]
    for chunk in (1, 40, 1 << 16):
        monkeypatch.setattr(periodic, "CHUNK", chunk)
        assert [list(map(tuple, f.T.tolist())) for _, f in periodic.of_texts(texts)] == expected


def test_query_equals_a_replay_of_its_contract(spark, tmp_path):
    rnd = random.Random(5)
    ids = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 10 == 0][:60] + list(range(40))
    texts = [" \t".join(map(str, _words(rnd))) for _ in ids]
    rows = list(zip(ids, texts, strict=True)) + [(None, "x " * 40), (7, None), (7, "y z " * 30), (8, ""), (9, " \n "), (10, "ä\x00 b " * 25), (None, None)]
    spark.createDataFrame([(t, i, "own", 1) for i, t in rows], "text string, doc_id long, runs string, _row int").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r)[:8] for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect()]
    order = lambda r: tuple((x is None, x) for x in r)
    assert sorted(got, key=order) == sorted((replay(i, t) for i, t in rows), key=order)


def test_empty_table_and_very_long_texts(spark):
    assert periodic.find(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    texts = ["a " * 500_000, " ".join(map(str, range(3000))) + " " + "p q r " * 200_000, "x" * 2_000_000]
    rows = periodic.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id", "n_words", "n_runs", "start", "length", "period").orderBy("doc_id").collect()
    assert [tuple(r) for r in rows] == [(0, 500_000, 1, 0, 500_000, 1), (1, 603_000, 1, 3000, 600_000, 3), (2, 1, 0, None, None, None)]


def test_collapsed_text_keeps_first_periods(spark):
    row = periodic.find(spark.createDataFrame([(1, "go " + "a b c " * 10 + "end")], "doc_id long, text string")).first()
    assert row.collapsed == "go a b c end" and [tuple(r) for r in row.runs] == [(1, 30, 3)]
    with pytest.raises(ValueError, match="two periods"):
        periodic.find(spark.range(1).selectExpr("id doc_id", "'' text"), exponent=1)
