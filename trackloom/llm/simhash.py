"""Near-duplicates by SimHash: fingerprints, links within a Hamming distance, components.

Links are found by pigeonring filtering.  The 64 bits are cut into ``SEGMENTS`` segments laid on
a ring.  If two fingerprints differ in at most ``t`` bits, some segment starts a chain in which the
differences of the first ``l`` segments sum to at most ``l * t / SEGMENTS`` for every ``l``.  While
that budget is under 1 the segments must agree, so they form the join key (with 5 segments and t = 2:
two consecutive ones, 25 or 26 bits); the longer budgets prune pairs before the full check.

A bucket of more than ``PAIR_CAP`` fingerprints is never expanded to pairs.  There each member sends its
variants outside the key instead, near ones of up to t // 2 flipped bits and far ones of up to the rest.  A
near and a far variant that agree are at most t bits apart, and any two members within t share such a
one, so tying each variant's members to a near one keeps every component.

Texts that are alike but not nearly equal (a similarity of 0.8, say) have fingerprints so far apart that no radius
both catches them and prunes. :func:`keep_first` therefore has two steps unless a distance is asked for: links of
fingerprints first, each checked on the shingle sets; then the same filter on the sets themselves (:mod:`ringsets`), which
adds the similar pairs out of the radius. Of each text's candidates the check takes those of the first step first, and of
the others only such as are not in one component by then.
"""

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, ringsets

SEED = 42
SHINGLE = 3
DISTANCE = 2
SEGMENTS = 5
PAIR_CAP = 32
#: Beyond this distance variants would be too many, and all buckets are expanded to pairs.
MOST_VARIED = 4


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """SimHash of one text: bit set if it is set in over half of the shingles' XXH64; 0 without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    n = len(words) - k + 1
    h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[k - 1 :].tolist(), strict=True)), np.uint64, n)
    ones = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id="doc_id", text="text") -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a long) for every row; a null text has no words."""

    def run(batches):
        for b in common.pieces(batches):
            texts = b.column(1).cast(pa.binary()).to_pylist()
            fps = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, fp long")


def segment_masks(segments=SEGMENTS):
    """Bit masks of the segments, as signed 64-bit numbers."""
    edges = [64 * i // segments for i in range(segments + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def chain_key_length(distance, segments):
    """Segments that must agree at the start of a viable chain: all l with l * distance / segments < 1."""
    return max(1, -(-segments // distance) - 1) if distance else segments


def links(fps: DataFrame, distance=DISTANCE, segments=None, pair_cap=PAIR_CAP) -> DataFrame:
    """Edges ``a, b`` between distinct values of ``fp`` whose components are those of all links within ``distance``.

    Pairs from small buckets are links themselves; from large ones come ties, each again within
    ``distance``. With ``pair_cap`` None, or a distance beyond MOST_VARIED, all buckets give pairs.
    """
    segments = segments or max(SEGMENTS, distance + 1)
    pair_cap = None if distance > MOST_VARIED else pair_cap
    masks = segment_masks(segments)
    length = chain_key_length(distance, segments)
    key_masks = []
    for i in range(segments):
        m = 0
        for j in range(length):
            m |= masks[(i + j) % segments]
        key_masks.append(m)
    rows = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("start"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(key_masks)])).alias("c")).select("fp", "c.start", "c.key")
    sizes = common.checkpoint(rows.groupBy("start", "key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"))
    cold, hot = rows, None
    if pair_cap is not None:
        crowded = common.small(sizes.filter(F.col("size") > pair_cap).drop("size"))
        cold, hot = rows.join(crowded, ["start", "key"], "left_anti"), rows.join(crowded, ["start", "key"])
        sizes = sizes.filter(F.col("size") <= pair_cap)
    cold = common.checkpoint(cold.join(common.small(sizes.drop("size")), ["start", "key"], "left_semi"))

    a, b = cold.select("start", "key", F.col("fp").alias("a")), cold.select("start", "key", F.col("fp").alias("b"))
    pairs = a.join(b, ["start", "key"]).filter("a < b")
    x = F.col("a").bitwiseXOR(F.col("b"))
    bits = [F.bit_count(x.bitwiseAND(F.lit(m))) for m in masks]
    viable = F.lit(False)
    for i in range(segments):
        chain, spent = F.col("start") == i, F.lit(0)
        for l in range(1, segments + 1):
            spent = spent + bits[(i + l - 1) % segments]
            if l > length:
                chain = chain & (spent <= l * distance // segments)
        viable = viable | chain
    pairs = pairs.filter(viable).filter(F.bit_count(x) <= distance).select("a", "b")
    if hot is None or not distance:
        return pairs.distinct()

    def variants(mask):
        """``flip, near``: values to flip outside ``mask``; near ones have at most distance // 2 bits."""
        free = [(1 << i) - (1 << 64 if i == 63 else 0) for i in range(64) if not mask >> i & 1]
        for k in range(distance - distance // 2 + 1):
            for some in combinations(free, k):
                yield (sum(some), k <= distance // 2)

    kind = "start int, flip long, near boolean"
    table = fps.sparkSession.createDataFrame([(i, *v) for i, m in enumerate(key_masks) for v in variants(m)], kind)  # as large as the masks
    near = hot.join(F.broadcast(table), "start").select("start", F.col("fp").bitwiseXOR(F.col("flip")).alias("v"), "near", "fp")
    ties = near.groupBy("start", "v").agg(F.min(F.when(F.col("near"), F.col("fp"))).alias("a"), F.min("fp").alias("_least"), F.max("fp").alias("_most")).filter("a is not null and _least < _most")
    ties = near.join(ties, ["start", "v"]).filter("a <> fp").select(F.least("a", "fp").alias("a"), F.greatest("a", "fp").alias("b"))
    return pairs.unionByName(ties).distinct()


#: Documents of one fingerprint from which its class counts as hot.
HOT = 100_000


def near_duplicates(docs: DataFrame, doc_id="doc_id", text="text", distance=DISTANCE) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``.

    ``component_id`` is the smallest doc_id reachable over links, itself included. Rows with null or empty
    text have fingerprint zero and link like any other.  Repeated rows each get a row.  A null doc_id never becomes a
    component's id unless all ids of it are null.
    """
    fps = common.checkpoint(fingerprints(docs, doc_id, text))
    classes = common.checkpoint(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")))
    label = common.components(links(classes.select("fp"), distance))
    joined = common.checkpoint(classes.join(common.small(label), classes.fp == label.node).select("fp", "rep", "n", "component"))
    least = joined.groupBy("component").agg(F.min("rep").alias("component_id"))
    linked = joined.join(common.small(least), "component").select("fp", "n", "component_id")
    alone = classes.filter("n > 1").join(common.small(linked.select("fp")), "fp", "left_anti").select("fp", "n", F.col("rep").alias("component_id"))
    # Fingerprints of one document and without links name that document; only the others are looked up.
    found = common.checkpoint(linked.unionAll(alone))
    hot, cold = common.small(found.filter(F.col("n") > HOT).drop("n")), common.small(found.filter(F.col("n") <= HOT).drop("n"))
    rows = fps.join(hot, "fp").unionByName(fps.join(hot, "fp", "left_anti").join(cold, "fp", "left").withColumn("component_id", F.coalesce("component_id", "doc_id")))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def close(docs: DataFrame, doc_id="doc_id", text="text", distance=DISTANCE) -> DataFrame:
    """``key_a, key_b``: pairs of rows whose components are those of all fingerprints within ``distance``; ids unique, not null.

    Of rows with one fingerprint each is paired with the first; first rows are paired as :func:`links` ties their fingerprints.
    """
    fps = common.checkpoint(fingerprints(docs, doc_id, text))
    classes = common.checkpoint(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")))
    found = links(classes.select("fp"), distance)
    for s in ("a", "b"):
        found = found.join(classes.select(F.col("fp").alias(s), F.col("rep").alias(f"key_{s}")), s)
    several = classes.filter("n > 1")
    hot, cold = common.small(several.filter(F.col("n") > HOT).drop("n")), common.small(several.filter(F.col("n") <= HOT).drop("n"))
    same = fps.join(hot, "fp").unionAll(fps.join(hot, "fp", "left_anti").join(cold, "fp")).filter("doc_id <> rep")
    return found.select("key_a", "key_b").unionAll(same.select(F.col("rep").alias("key_a"), F.col("doc_id").alias("key_b")))


def keep_first(docs: DataFrame, doc_id="doc_id", text="text", distance=None) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: the one of smallest doc_id, ties by text; all columns as they are.

    Groups are components of pairs whose sets of five-word shingles have a Jaccard similarity of at least 0.8: those with
    fingerprints within DISTANCE are linked (:func:`close`), and all others. With ``distance`` groups are those of
    :func:`near_duplicates`. Rows without words, null texts too, form one group. Of repeated rows one stays; a null doc_id
    comes first. An empty table stays empty.
    """
    key = common.fresh(docs, "_key")
    rows = common.keyed(docs, key, doc_id, text)
    texts = rows.select(F.col(key).alias("key"), F.col(text).alias("text"))
    if distance is None:
        gone = ringsets.later_copies(texts, near=lambda rows: close(rows, "key"))
    else:
        gone = near_duplicates(texts, "key", "text", distance).filter("doc_id <> component_id").select(F.col("doc_id").alias("key"))
    gone = common.checkpoint(gone.withColumnRenamed("key", key))
    return rows.join(common.small(gone), key, "left_anti").drop(key)
