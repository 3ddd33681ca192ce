"""Runs of words that repeat with a period, found by a Kruskal pass over longest common prefixes.

Sort the suffixes of a text and take the longest common prefixes (LCP) of neighbours as edges. Edges are added from the
largest LCP down; each class of suffixes joined so far keeps its positions in order. When classes join at LCP ``l``,
positions ``i`` and ``j`` of the new class that now lie next to each other agree for exactly ``l`` words, so with ``j - i = d``
not above ``l`` the words from ``i`` on have period ``d`` for ``l + d`` words.

* Each run is found by its first two occurrences: a position between them that agreed with both as long would give the
  run a smaller period (Fine and Wilf), so they are neighbours when they meet.
* No multiple of the smallest period is found, since positions one period apart meet at a larger LCP and lie between.
* A pair whose words just before agree starts inside of a run that an earlier pair has found.

A run of at least ``exponent`` periods and ``least`` words has ``l >= least - l / (exponent - 1)``, so edges below that are never
added, and a text in which no window of so many words occurs twice is not sorted at all.
"""

import hashlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LEAST = 24
EXPONENT = 3
#: Words of texts that are sorted together. A longer text is sorted alone.
CHUNK = 1 << 16
#: The smaller of two classes goes in place by place below this share of the larger one; else both are merged.
FEW = 16

_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)


def least_lcp(least=LEAST, exponent=EXPONENT):
    """Smallest LCP of the first two occurrences of a run: ``l + d >= least`` and ``l >= (exponent - 1) * d``."""
    return max(1, -(-least * (exponent - 1) // exponent))


def _ranks(words):
    """Ranks of the suffixes by their first 1, 2, 4, ... words, until all differ."""
    n = len(words)
    rank = np.unique(words, return_inverse=True)[1].astype(np.int32)
    levels = [rank]
    width = 1
    while int(levels[-1].max()) < n - 1:
        rank = levels[-1].astype(np.int64)
        key = rank * (n + 1)
        key[: n - width] += rank[width:] + 1
        levels.append(np.unique(key, return_inverse=True)[1].astype(np.int32))
        width *= 2
    return levels


def _lcp(levels, i, j):
    """Words in which the suffixes at ``i`` and ``j`` agree."""
    n = len(levels[0])
    i, j, length = i.copy(), j.copy(), np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = np.flatnonzero(np.maximum(i, j) < n)
        same = inside[levels[k][i[inside]] == levels[k][j[inside]]]
        # An equal rank at the end of the text would be an equal suffix, and suffixes are of different lengths.
        i[same] += 1 << k
        j[same] += 1 << k
        length[same] += 1 << k
    return length


def _meetings(position, near, lcp, most=1):
    """Neighbours ``i, j, l`` that arise as the edges ``position, near`` are added by decreasing ``lcp``, where ``most * (j - i)`` is not above ``l``."""
    nodes = np.unique(np.concatenate((position, near)))
    parent = list(range(len(nodes)))
    members = [[p] for p in nodes.tolist()]
    order = np.argsort(-lcp, kind="stable")
    a, b = np.searchsorted(nodes, position[order]).tolist(), np.searchsorted(nodes, near[order]).tolist()
    found = []

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y, length in zip(a, b, lcp[order].tolist(), strict=True):
        x, y = root(x), root(y)
        if len(members[x]) < len(members[y]):
            x, y = y, x
        large, small = members[x], members[y]
        parent[y], members[y] = x, None
        fresh = set(small)
        # Neighbours count only once all positions are in: between two of them a smaller period may lie.
        if len(small) * FEW < len(large):
            for p in small:
                insort(large, p)
            for p in small:
                at = bisect_left(large, p)
                if at and (q := large[at - 1]) not in fresh and (p - q) * most <= length:
                    found.append((q, p, length))
                if at + 1 < len(large) and (q := large[at + 1]) not in fresh and (q - p) * most <= length:
                    found.append((p, q, length))
        else:
            large.extend(small)
            large.sort()  # two ordered stretches: linear
            found.extend((p, q, length) for p, q in zip(large, large[1:], strict=False) if (q - p) * most <= length and (p in fresh) != (q in fresh))
    return found


def runs(words, least=LEAST, exponent=EXPONENT):
    """``start, length, period`` arrays, by start and period, of the runs of an array of word numbers."""
    none = np.zeros((3, 0), np.int64)
    deep = least_lcp(least, exponent)
    if len(words) < least:
        return none
    levels = _ranks(words)
    suffix = np.argsort(levels[-1])
    lcp = _lcp(levels, suffix[:-1], suffix[1:])
    deep_ones = np.flatnonzero(lcp >= deep)
    if not len(deep_ones):
        return none
    found = _meetings(suffix[deep_ones], suffix[deep_ones + 1], lcp[deep_ones], exponent - 1)
    if not found:
        return none
    i, j, length = np.array(found, np.int64).T
    period = j - i
    first = (i == 0) | (words[i - 1] != words[j - 1])
    fits = first & (length + period >= least)
    start, length, period = i[fits], (length + period)[fits], period[fits]
    order = np.lexsort((period, start))
    return np.stack((start[order], length[order], period[order]))


def _repeats_window(words, doc, wide):
    """Numbers of documents in which a window of ``wide`` words may occur twice: by hashes, so never one too few."""
    n = len(words) - wide + 1
    if n <= 1:
        return np.zeros(0, np.int64)
    h = (words.astype(_U) + _U(1)) * _ODD
    h ^= h >> _U(31)
    done, out, at = 0, np.zeros(n, _U), 1
    power, left = h.copy(), wide
    # Windows of 1, 2, 4, ... words from halves; those that make up ``wide`` are put together.
    while left:
        if left & 1:
            out = (out ^ power[done : done + n]) * _ODD
            out ^= out >> _U(29)
            done += at
        left >>= 1
        if left:
            power = (power[:-at] * _ODD) + (power[at:] ^ (power[at:] >> _U(32)))
            at *= 2
    inside = np.flatnonzero(doc[:n] == doc[wide - 1 : wide - 1 + n])
    key = out[inside] ^ (doc[inside].astype(_U) * _U(0xD6E8FEB86659FD93))
    order = np.argsort(key)
    again = key[order][1:] == key[order][:-1]
    return np.unique(doc[inside[order[1:][again]]])


def of_texts(texts, least=LEAST, exponent=EXPONENT):
    """For each text (bytes) its words and its runs as in :func:`runs`."""
    known, split, sizes, numbers = {}, [], [], []
    for t in texts:
        w = t.split()
        split.append(w)
        sizes.append(len(w))
        numbers.extend([known.setdefault(x, len(known)) for x in w])
    words, sizes = np.array(numbers, np.int64), np.array(sizes, np.int64)
    doc, begin = np.repeat(np.arange(len(texts)), sizes), np.cumsum(sizes) - sizes
    out = [(w, np.zeros((3, 0), np.int64)) for w in split]
    held, total = [], 0

    def solve():
        # One array for several texts: a number of its own after each text keeps runs inside.
        flat = np.concatenate([np.append(words[begin[d] : begin[d] + sizes[d]], len(known) + k) for k, d in enumerate(held)])
        ends = np.cumsum(sizes[held] + 1)
        start, length, period = runs(flat, least, exponent)
        of = np.searchsorted(ends, start, side="right")
        for k, d in enumerate(held):
            m = of == k
            out[d] = (split[d], np.stack((start[m] - (ends[k] - sizes[d] - 1), length[m], period[m])))

    for d in _repeats_window(words, doc, least_lcp(least, exponent)).tolist():
        if held and total + sizes[d] > CHUNK:
            solve()
            held, total = [], 0
        held.append(d)
        total += int(sizes[d])
    if held:
        solve()
    return out


def kept_words(n, found):
    """Which of ``n`` words stay: all but those that some run contains after its first period."""
    start, length, period = found
    turn = np.zeros(n + 1, np.int64)
    np.add.at(turn, start + period, 1)
    np.add.at(turn, start + length, -1)
    return np.cumsum(turn[:-1]) == 0


def _best(found):
    """Place of the run of greatest length / period; ties to the smallest start, then period. Compared as exact fractions."""
    start, length, period = found.tolist()
    best = 0
    for k in range(1, len(start)):
        if length[k] * period[best] > length[best] * period[k]:  # they come by start and period
            best = k
    return best


_OUT = "n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_SCHEMA = pa.schema([(c.split(" ", 1)[0], pa.string() if c.endswith("string") else pa.int64()) for c in _OUT.split(", ")[:8]] + [("runs", pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))), ("collapsed", pa.string())])


def _find(least, exponent):
    def row(words, found):
        start, length, period = found
        listed = list(zip(start.tolist(), length.tolist(), period.tolist(), strict=True))
        lead = dict.fromkeys(("start", "length", "period", "exponent_milli"))
        if listed:
            s, n, p = listed[_best(found)]
            lead = {"start": s, "length": n, "period": p, "exponent_milli": 1000 * n // p}
            keep = kept_words(len(words), found)
            words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
        collapsed = b" ".join(words)
        digest = hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in listed).encode()).hexdigest()
        return {"n_runs": len(listed), **lead, "runs_sha256": digest, "collapsed_sha256": hashlib.sha256(collapsed).hexdigest(), "runs": [{"start": s, "length": n, "period": p} for s, n, p in listed], "collapsed": collapsed.decode()}

    def solve(ids, texts):
        rows = [{"n_words": len(w)} | row(w, f) for w, f in of_texts(texts, least, exponent)]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64())] + [pa.array([r[f.name] for r in rows], f.type) for f in _SCHEMA], schema=pa.schema([("_row", pa.int64()), *_SCHEMA]))

    def run(batches):
        ids, texts, held = [], [], 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                ids.append(i), texts.append(t or b"")
                held += len(texts[-1])
                if held >= 1 << 20:
                    yield solve(ids, texts)
                    ids, texts, held = [], [], 0
        if ids:
            yield solve(ids, texts)

    return run


def find(docs: DataFrame, doc_id="doc_id", text="text", least=LEAST, exponent=EXPONENT) -> DataFrame:
    """``doc_id, n_words, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256, runs, collapsed`` for every row.

    A run is a stretch of words of smallest period ``period`` that no neighbouring word extends, of at least ``least`` words and
    ``exponent`` (2 or more) periods. The columns ``start`` to ``exponent_milli`` describe the run of most periods (ties: smallest start, then
    period; null without runs); ``runs`` lists all by start and period. ``collapsed`` is the text without the words that
    a run contains after its first period, joined by one space.

    Null and blank texts have no words. Every row is a text of its own, whatever its doc_id (null and repeated ones stay as they are);
    other columns are not read. A text is worked on in one task, in memory proportional to it.
    """
    if exponent < 2:
        raise ValueError("runs of under two periods are not found")
    slim = docs.select(F.col(doc_id).cast("long").alias("_row"), F.col(text).cast("string").alias("_text"))
    return slim.mapInArrow(_find(least, exponent), f"_row long, {_OUT}").withColumnRenamed("_row", "doc_id")


def planted(docs: DataFrame, doc_id="doc_id", text="text") -> DataFrame:
    """``doc_id, text`` with texts made periodic from some place on in a tenth of the documents, by the CRC-32 of the decimal doc_id.

    With ``h`` the CRC-32, ``g = h div 10`` and ``n`` words: if ``h`` ends in 0 and there are words, each word from ``a = g mod n`` on becomes
    the word ``a + (i - a) mod p`` with ``p = 1 + (n - a) div (3 + g mod 8)``. A row without doc_id stays as it is.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), F.crc32(F.col(doc_id).cast("long").cast("string").cast("binary")).alias("_h"))
    chosen = F.when(F.col("_h") % 10 == 0, common.words(F.col("text")))
    rows = rows.withColumn("_w", chosen).withColumn("_n", F.size("_w")).withColumn("_g", F.expr("_h div 10"))
    rows = rows.withColumn("_a", F.when(F.col("_n") > 0, F.expr("int(_g % _n)")))
    rows = rows.withColumn("_p", F.expr("int(1 + (_n - _a) div (3 + _g % 8))"))
    tail = F.transform(F.sequence(F.lit(0), F.col("_n") - F.col("_a") - 1), lambda i: F.element_at("_w", F.col("_a") + i % F.col("_p") + 1))
    changed = F.when(F.col("_a").isNotNull(), F.array_join(F.concat(F.slice("_w", F.lit(1), F.col("_a")), tail), " "))
    return rows.select("doc_id", F.coalesce(changed, "text").alias("text"))
