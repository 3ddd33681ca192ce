"""Pigeonring filtering of shingle sets: the similarity form of the near-duplicate operator.

A set of shingles is a sparse bit vector, and a Jaccard similarity of at least 4/5 says that two sets of a
and b members differ in at most t = (a + b) / 9 places. The vectors are cut into segments by a hash of the
shingle, laid on a ring. If two sets differ in at most t places, some segment starts a chain in which
the differences of the first l segments sum to at most l * t / segments; with more than t segments that is
l - 1 at most: the first segment is equal and forms the join key, and the next ones prune.

t depends on the sizes, so sets meet in size groups: group k holds the sizes of level k and of the next,
and levels grow by 5/4, so every similar pair meets in the group of its smaller set's level.  Weak segments,
those without a shingle that is not frequent, make poor keys. A set leaves them out if it has at most
as many of them as there are segments to spare: exactly (segments - differences) starts are viable (the cycle
lemma on 1 - difference), one more than that at least, so some viable start is not weak.

Candidates are checked by parity sketches, a lower bound of the difference of two sets, and by the sets
themselves at last; of a crowded key all members meet a few pivots first, and later only pairs that
are not in one component yet are compared, and these all are. Two sets often share many crowded keys; each set
carries the first few of its own, which tell at any other key that a pair has met already.
"""

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

SEED = 42
SHINGLE = 5
PAIR_CAP = 16
#: Rounds in which each crowded key meets a pivot.
PIVOTS = 2
#: Crowded keys that a set carries, to pass on a pair once rather than for each key that it shares.
FIRST = 8
#: Segments that are checked after the key; each has a parity sketch of 16 bits.
CHAIN = 4
#: One text in so many is sampled for frequent shingles; one seen so often in the sample is frequent; so many are listed at most. They only save time.
SAMPLE = 16
FREQUENT = 3
MOST_FREQUENT = 200_000
#: 64-bit words of a set's parity sketch.
SKETCH = 8
#: Shingles handled at once.
CHUNK = 1 << 18

_U = np.uint64
_M1, _M2, _M3 = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9)


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct XXH64 of a text's shingles; a text of fewer words is one shingle, one without words none."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(SHINGLE, len(words))
    n = len(words) - k + 1
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[k - 1 :].tolist(), strict=True)), np.uint64, n))


def levels(most: int) -> np.ndarray:
    """Least sizes of the levels, up to one beyond ``most``."""
    out = [1]
    while out[-1] <= most:
        out.append(out[-1] * 5 // 4 + 1)
    return np.array([*out, out[-1] * 5 // 4 + 1], np.int64)


def segments(most: np.ndarray) -> np.ndarray:
    """Segments of a group by the largest size of its level, and those to spare: t + 1 of them, and a tenth of t + 3 more."""
    t = most // 4
    spare = -(-t // 10) + 3
    return t + 1 + spare, spare


def _mix(h):
    h = (h ^ (h >> _U(33))) * _M2
    h = (h ^ (h >> _U(29))) * _M3
    return h ^ (h >> _U(32))


def keys(sets: list, frequent: np.ndarray):
    """``set, token, chain`` arrays: the keys of each set in both of its groups, and the sketches of the segments after each."""
    size = np.array([len(s) for s in sets], np.int64)
    edges = levels(int(size.max(initial=1)))
    level = np.searchsorted(edges, size, side="right") - 1
    members = np.concatenate(sets) if sets else np.zeros(0, _U)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, members), len(frequent) - 1)
        rare = frequent[at] != members
    else:
        rare = np.ones(len(members), bool)
    owner = np.repeat(np.arange(len(sets)), size)
    place, side = _mix(members * _M1), (members >> _U(9)) & _U(15)
    out = []
    for lower in (0, 1):  # in the group of its own level, then as a larger set in the group below
        use = size >= 4 if lower == 0 else level >= 1
        group = level - lower
        n_seg, spare = segments(edges[np.maximum(group, 0) + 1] - 1)
        use &= (n_seg - spare) > 1  # where no difference is allowed equal sets alone are similar
        n_seg = np.where(use, n_seg, 0)
        first = np.cumsum(n_seg) - n_seg
        total = int(n_seg.sum())
        if not total:
            continue
        mine = use[owner]
        o, m = owner[mine], members[mine]
        seg = first[o] + (place[mine] % n_seg[o].astype(_U)).astype(np.int64)
        order = np.argsort(seg, kind="stable")
        seg = seg[order]
        new = np.flatnonzero(np.concatenate(([True], seg[1:] != seg[:-1])))
        held = seg[new]
        content, sketch, strong = np.zeros(total, _U), np.zeros(total, _U), np.zeros(total, bool)
        content[held] = np.add.reduceat(_mix(m[order]), new)
        sketch[held] = np.bitwise_xor.reduceat(_U(1) << side[mine][order], new)
        strong[held] = np.logical_or.reduceat(rare[mine][order], new)
        doc = np.repeat(np.arange(len(sets)), n_seg)
        index = np.arange(total) - first[doc]
        weak = np.bincount(doc[~strong], minlength=len(sets))
        chain = np.zeros(total, _U)
        for j in range(CHAIN):
            after = first[doc] + (index + 1 + j) % n_seg[doc]
            chain |= np.where(n_seg[doc] > j + 1, sketch[after], _U(0)) << _U(16 * j)
        token = _mix(content + index.astype(_U) * _M1 + (group[doc] + 1).astype(_U) * _M2)
        keep = strong | (weak > spare)[doc]
        out.append((doc[keep], token[keep], chain[keep]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, _U)
    doc, token, chain = map(np.concatenate, zip(*out, strict=True))
    order = np.argsort(doc, kind="stable")
    return doc[order], token[order], chain[order]


def sketch(s: np.ndarray) -> np.ndarray:
    """Parity of the shingles in each of 64 * SKETCH cells: sketches differ in at most as many bits as the sets in members."""
    cells = np.bincount((s >> np.uint64(20)).astype(np.int64) % (64 * SKETCH), minlength=64 * SKETCH) & 1
    return np.packbits(cells.astype(np.uint8), bitorder="little").view("<i8")


def _longs(lists):
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in lists], dtype=np.int64))).astype(np.int32)
    flat = np.concatenate(lists) if lists else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64), pa.int64()))


def _sets(b):
    return [shingles(t) for t in b.column(1).cast(pa.binary()).to_pylist()]


def sets(rows: DataFrame) -> DataFrame:
    """``key, s``: the shingles of each row (``key, text``)."""

    def run(batches):
        for b in common.pieces(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), _longs(_sets(b))], ["key", "s"])

    return rows.mapInArrow(run, "key long, s array<long>")


def frequent(rows: DataFrame) -> np.ndarray:
    """Frequent shingles of a sample, sorted; MOST_FREQUENT at most."""
    sample = sets(rows.filter(F.pmod(F.xxhash64("key"), F.lit(SAMPLE)) == 0)).select(F.explode("s").alias("s"))
    found = sample.groupBy("s").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "s").limit(MOST_FREQUENT).select("s").collect()
    return np.sort(np.array([r.s for r in found], np.int64).view(np.uint64))


def signatures(rows: DataFrame) -> DataFrame:
    """``key, same, n, sketch`` of each row (``key, text``); ``same`` is a digest of the set."""

    def run(batches):
        for b in common.pieces(batches):
            found = _sets(b)
            same = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(same, pa.binary()), pa.array([len(s) for s in found], pa.int64()), _longs([sketch(s) for s in found])], ["key", "same", "n", "sketch"])

    return rows.mapInArrow(run, "key long, same binary, n long, sketch array<long>")


def members(rows: DataFrame, often) -> DataFrame:
    """``token, key, chain`` of every key that a row (``key, text``) has."""
    shared = rows.sparkSession.sparkContext.broadcast(often)  # at most MOST_FREQUENT

    def run(batches):
        for b in common.pieces(batches):
            ids, some, held = b.column(0).to_numpy(), [], 0
            for i, t in enumerate(b.column(1).cast(pa.binary()).to_pylist()):
                some.append((i, shingles(t)))
                held += len(some[-1][1])
                if held >= CHUNK or i == len(ids) - 1:
                    doc, token, chain = keys([s for _, s in some], shared.value)
                    owner = ids[[i for i, _ in some]][doc] if len(doc) else ids[:0]
                    yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(owner), pa.array(chain.view(np.int64))], ["token", "key", "chain"])
                    some, held = [], 0

    return rows.mapInArrow(run, "token long, key long, chain long")


def _viable(a="chain_a", b="chain_b"):
    """Chain budgets of a pair with equal first segments: the next l segments differ in at most l places."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    x = a.bitwiseXOR(b)
    fits = F.lit(True)
    for l in range(1, CHAIN + 1):
        part = (1 << 16 * l) - 1 if l < 4 else -1
        fits = fits & (F.bit_count(x.bitwiseAND(F.lit(part).cast("long"))) <= l)
    return fits


def _alike():
    """What sizes and sketches allow."""
    bits = sum((F.bit_count(F.get("sketch_a", F.lit(i)).bitwiseXOR(F.get("sketch_b", F.lit(i)))) for i in range(SKETCH)), F.lit(0))
    return (5 * F.col("n_a") >= 4 * F.col("n_b")) & (5 * F.col("n_b") >= 4 * F.col("n_a")) & (9 * bits <= F.col("n_a") + F.col("n_b"))


def _met():
    """That a pair with equal ``token`` has a viable chain at a smaller token, too, which both sets carry."""
    chain = lambda s, x: F.element_at(f"chains_{s}", F.array_position(f"first_{s}", x).cast("int"))
    return F.exists(F.array_intersect("first_a", "first_b"), lambda x: (x < F.col("token")) & _viable(chain("a", x), chain("b", x)))


def _side(df, s, *columns):
    """``df`` as one side of a pair."""
    return df.select(*columns, *[F.col(c).alias(f"{c}_{s}") for c in ("key", "n", "sketch", "chain", "component", "first", "chains") if c in df.columns and c not in columns])


def across(hot: DataFrame) -> DataFrame:
    """``key_a, key_b`` of rows with equal ``token`` and different ``component`` that chains, sizes and sketches allow.

    All is looked at inside the join, which passes on a pair at the smallest of the tokens that allow it, as far as both sets carry these.
    """
    first = hot.groupBy("key").agg(F.slice(F.array_sort(F.collect_list(F.struct("token", "chain"))), 1, FIRST).alias("f")).select("key", F.col("f.token").alias("first"), F.col("f.chain").alias("chains"))
    hot = common.checkpoint(hot.join(common.small(first), "key"))
    left, right = _side(hot, "a", "token"), _side(hot, "b", "token").withColumnRenamed("token", "token_b")
    return left.join(right, (F.col("token") == F.col("token_b")) & (F.col("key_a") < F.col("key_b")) & (F.col("component_a") != F.col("component_b")) & _viable() & _alike() & ~_met()).select("key_a", "key_b")


def verified(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Edges ``a, b`` of the pairs (``key_a, key_b``; a checkpoint) whose sets of shingles are similar; ``rows``: ``key, text``."""
    need = pairs.select(F.explode(F.array("key_a", "key_b")).alias("key")).distinct()
    held = common.checkpoint(sets(rows.join(common.small(need), "key", "left_semi")))

    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(9 * both >= 4 * (len(x) + len(y)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(held.select(F.col("key").alias("key_a"), F.col("s").alias("x")), "key_a").join(held.select(F.col("key").alias("key_b"), F.col("s").alias("y")), "key_b")
    return common.checkpoint(both.select("key_a", "key_b", "x", "y").mapInArrow(run, "a long, b long"))


def _across(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components of ``edges``."""
    label = common.small(common.components(edges))
    for s in ("a", "b"):
        pairs = pairs.join(label.select(F.col("node").alias(f"key_{s}"), F.col("component").alias(f"c_{s}")), f"key_{s}", "left")
    return pairs.filter(F.coalesce("c_a", "key_a") != F.coalesce("c_b", "key_b")).select("key_a", "key_b")


def links(found: DataFrame, rows: DataFrame, often, pair_cap=PAIR_CAP, near=None) -> DataFrame:
    """Edges ``a, b`` whose components are those of all similar pairs among ``rows`` (``key, text``), one row for each set; ``found``: their :func:`signatures`.

    Pairs ``near`` (``key_a, key_b``) are candidates, too; of the pairs of a set they are looked at first.
    """
    short = found.select("key", "n", "sketch")
    # One exchange by token: what no other set shares ends there.
    shared = members(rows, often).withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("token"))).filter("size > 1")
    shared = common.checkpoint(shared)

    cold = shared.filter(F.col("size") <= pair_cap).drop("size")
    pairs = _side(cold, "a", "token").join(_side(cold, "b", "token"), "token").filter(F.col("key_a") < F.col("key_b")).filter(_viable()).select("key_a", "key_b")
    hot = shared.filter(F.col("size") > pair_cap).drop("size")
    for i in range(PIVOTS):
        pivot = hot.groupBy("token").agg(F.min_by(F.struct("key", "chain"), F.xxhash64("key", F.lit(i))).alias("p")).select("token", F.col("p.key").alias("key_a"), F.col("p.chain").alias("chain_a"))
        pairs = pairs.unionAll(_side(hot, "b", "token").join(pivot, "token").filter(F.col("key_a") != F.col("key_b")).filter(_viable()).select("key_a", "key_b"))
    pairs = pairs.withColumn("late", F.lit(True))
    if near is not None:
        pairs = pairs.unionAll(near.withColumn("late", F.lit(False)))
    # Distinct pairs of those with fitting sizes and sketches.
    pairs = pairs.groupBy(F.least("key_a", "key_b").alias("key_a"), F.greatest("key_a", "key_b").alias("key_b")).agg(F.min("late").alias("late"))
    pairs = common.checkpoint(pairs.join(_side(short, "a"), "key_a").join(_side(short, "b"), "key_b").filter(_alike()).select("key_a", "key_b", "late"))

    # A pair for each set first; then only those that are not in one component yet.
    some = common.checkpoint(pairs.groupBy("key_b").agg(F.min(F.struct("late", "key_a")).alias("p")).select("p.key_a", "key_b"))
    edges = verified(some, rows)
    others = common.checkpoint(_across(pairs.join(some, ["key_a", "key_b"], "left_anti"), edges))
    edges = common.checkpoint(edges.unionAll(verified(others, rows)))

    # What is left of the crowded keys: pairs across components.
    label = common.components(edges).withColumnRenamed("node", "key")
    hot = hot.join(common.small(label), "key", "left").withColumn("component", F.coalesce("component", "key"))
    several = hot.groupBy("token").agg((F.min("component") < F.max("component")).alias("_more")).filter("_more").select("token")
    hot = common.checkpoint(hot.join(common.small(several), "token", "left_semi").join(short, "key"))
    rest = across(hot).distinct().join(pairs, ["key_a", "key_b"], "left_anti")
    return edges.unionAll(verified(common.checkpoint(rest), rows))


def later_copies(rows: DataFrame, pair_cap=PAIR_CAP, near=None) -> DataFrame:
    """``key`` of every row (``key, text``, keys unique) whose group of similar texts holds a smaller key.

    Groups are components of pairs with a Jaccard similarity of at least 4/5. Rows without words form one group.
    ``near`` gives pairs ``key_a, key_b`` of rows (``key, text``) with different sets, to be looked at first.
    """
    found = common.checkpoint(signatures(rows))
    first = common.checkpoint(found.groupBy("same").agg(F.min("key").alias("key")).select("key"))
    copies = common.checkpoint(found.select("key").join(common.small(first), "key", "left_anti"))
    once = common.small(copies)
    left = rows.join(once, "key", "left_anti")
    edges = links(found.join(once, "key", "left_anti"), left, frequent(rows), pair_cap, near and near(left))
    return copies.unionAll(common.components(edges).filter("node <> component").select(F.col("node").alias("key")))
