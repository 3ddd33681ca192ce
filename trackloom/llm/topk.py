"""Exact top-k search by inner product in three phases with a uniform threshold.

A score is the sum of partial scores over ``PARTS`` groups of components, so each group holds a list of
its own.  Rows are laid in blocks, long vectors first, and queries go out to them:

1. The first block of each task takes the best rows of each of its local lists and scores these in full; the
   k-th best score gathered for a query is reached by k rows and so a safe cutoff.
2. The cutoff goes to all blocks.  A score at the cutoff has a partial score of cutoff / PARTS at least, so the
   others are not collected.  By the lengths of a block's vectors (Cauchy and Schwarz) a block is left
   out for the queries that it cannot serve, and a list that cannot hold such a partial score is not looked through.
3. Collected rows are resolved exactly; those that reach the cutoff are ranked.

The cutoff bounds what is sent and ranked. How much arithmetic it saves rests on the lengths of the vectors: none
where all are as long.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

K = 5
PARTS = 4
SCALE = 256
#: Bytes in a block of candidates and of queries, and rows at most: a pair's scores take 8 bytes each.
ROW_BYTES, ROW_BLOCK = 2 << 20, 4096
QUERY_BYTES, QUERY_BLOCK = 256 << 10, 512
#: Blocks of queries in one broadcast (at most CHUNK_BLOCKS * QUERY_BYTES), and blocks whose best a task holds.
CHUNK_BLOCKS = 128
HELD_BLOCKS = 64

_BLOCK = "dim int, block long, nth int, ids binary, values binary"


def integers(vectors: DataFrame, vec_id="vec_id", embedding="embedding", scale=SCALE) -> DataFrame:
    """``vec_id, v`` with v = floor(scale * x) as doubles; vectors with null or non-finite components are left out."""
    x = F.transform(F.col(embedding), lambda e: common.let(e.cast("double") * scale, lambda y: F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)))
    sound = F.forall(F.col(embedding), lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf")))
    return vectors.filter(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull()).filter(sound).select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("v"))


def _blocks(rows: DataFrame, most: int, most_bytes: int) -> DataFrame:
    """Blocks of vectors of one length, as bytes; ``nth`` counts a task's blocks of that length."""

    def run(batches):
        held, count = {}, {}

        def out(dim):
            ids, vectors = map(np.concatenate, held.pop(dim))
            count[dim] = count.get(dim, -1) + 1
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([int(ids[0])], pa.int64()), pa.array([count[dim]], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([vectors.tobytes()], pa.binary())], ["dim", "block", "nth", "ids", "values"])

        for b in batches:
            ids, lists = b.column(0).to_numpy(), b.column(1)
            lengths, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(zero_copy_only=False)
            start = np.cumsum(lengths) - lengths
            for dim in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == dim)
                size = max(1, min(most, most_bytes // (8 * dim + 8)))
                for i in range(0, len(at), size):
                    some = at[i : i + size]
                    group = held.setdefault(dim, ([], []))
                    group[0].append(ids[some]), group[1].append(flat[start[some][:, None] + np.arange(dim)])
                    if sum(map(len, group[0])) >= size:
                        yield out(dim)
        for dim in list(held):
            yield out(dim)

    return rows.mapInArrow(run, _BLOCK)


def _arrays(ids, values, dim):
    ids = np.frombuffer(ids, np.int64)
    return ids, np.frombuffer(values, np.float64).reshape(len(ids), dim)


def _cuts(dim, parts):
    return [(dim * p // parts, dim * (p + 1) // parts) for p in range(parts) if dim * p // parts < dim * (p + 1) // parts] or [(0, 0)]


def _typed(q, v):
    """Both sides in numbers that hold every inner product exactly: doubles, 64-bit integers or integers of any size."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(1, q.shape[-1])
    if most < 2.0**53:
        return q, v
    if most < 2.0**62:
        return q.astype(np.int64), v.astype(np.int64)
    if not (np.isfinite(q).all() and np.isfinite(v).all()):
        raise OverflowError("a scaled component is beyond a double")
    return (np.array([[int(x) for x in row] for row in a.tolist()], object).reshape(a.shape) for a in (q, v))


def _pairs(batches):
    """Query ids, queries, cutoffs, ids and vectors of each pair of blocks."""
    for b in batches:
        for row in b.to_pylist():
            q_ids, q = _arrays(row["q_ids"], row["q_values"], row["dim"] + 1)
            yield row["q_block"], q_ids, q[:, :-1], q[:, -1], *_arrays(row["ids"], row["values"], row["dim"])


def _scored(query, vec, score):
    """A batch of scores; one that does not fit a long raises."""
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(query, np.int64)), pa.array(np.asarray(vec, np.int64)), pa.array(np.asarray(score).astype(np.int64))], ["query_id", "vec_id", "score"])


def _best(k, query, vec, score):
    """The k best of each query among scored pairs, ties to the smaller vec_id."""
    down = np.unique(-score, return_inverse=True)[1] if score.dtype == object else -score
    order = np.lexsort((vec, down, query))
    query, vec, score = query[order], vec[order], score[order]
    rank = np.arange(len(order)) - np.searchsorted(query, query)
    return query[rank < k], vec[rank < k], score[rank < k]


def _gather(k, parts):
    """Phase 1: full scores of the rows that lead a local list; a task keeps the k best of each query."""

    def run(batches):
        held = {}
        for block, q_ids, q, _, ids, v in _pairs(batches):
            q, v = _typed(q, v)
            most = min(k + 1, len(ids))
            first = (lambda p: np.argsort(-p, axis=1, kind="stable")) if q.dtype == object else (lambda p: np.argpartition(-p, most - 1, axis=1))
            lead = np.concatenate([first(q[:, s:e] @ v[:, s:e].T)[:, :most] for s, e in _cuts(q.shape[1], parts)], axis=1)
            key = np.unique(np.repeat(np.arange(len(q)), lead.shape[1]) * len(ids) + lead.ravel())
            row, col = key // len(ids), key % len(ids)
            other = q_ids[row] != ids[col]
            row, col = row[other], col[other]
            score = (q[row] * v[col]).sum(axis=1)
            if score.dtype == object:  # only a cutoff comes of these: too small ones may go, too large ones may be lowered
                fits = score >= -(1 << 63)
                row, col, score = row[fits], col[fits], np.minimum(score[fits], (1 << 63) - 1)
            got = q_ids[row], ids[col], score.astype(np.int64)
            if block in held:
                got = tuple(map(np.concatenate, zip(held[block], got, strict=True)))
            held[block] = _best(k, *got)
            if len(held) > HELD_BLOCKS:
                yield _scored(*held.pop(next(iter(held))))
        for got in held.values():
            yield _scored(*got)

    return run


def _collect(k, parts):
    """Phases 2 and 3: rows with a partial score at the uniform threshold, resolved; the k best at the cutoff remain."""

    def run(batches):
        for _, q_ids, q, cutoff, ids, v in _pairs(batches):
            cuts = _cuts(q.shape[1], parts)
            length = lambda a: np.stack([np.linalg.norm(a[:, s:e], axis=1) for s, e in cuts])
            slack = 1 + 1e-9  # lengths are rounded
            with np.errstate(over="ignore"):
                reach = length(q) * length(v).max(axis=1, keepdims=True) * slack  # of each list, for each query
            live = np.flatnonzero(~(reach.sum(axis=0) < cutoff))
            if not len(live):
                continue
            reach, cutoff, q_ids = reach[:, live], cutoff[live], q_ids[live]
            limit = cutoff / len(cuts)
            limit = limit - 1e-6 * np.abs(np.where(np.isfinite(limit), limit, 0))
            q, v = _typed(q[live], v)
            partial = [q[:, s:e] @ v[:, s:e].T for s, e in cuts]
            hit = np.zeros((len(live), len(ids)), bool)
            for p, far in zip(partial, reach, strict=True):
                may = np.flatnonzero(~(far < limit))
                hit[may] |= (p[may] >= limit[may, None]).astype(bool)
            row, col = np.nonzero(hit & (q_ids[:, None] != ids))
            score = sum(p[row, col] for p in partial)  # all parts of a collected row: its whole score
            top = (score >= cutoff[row]).astype(bool)
            yield _scored(*_best(k, q_ids[row[top]], ids[col[top]], score[top]))

    return run


def _meet(candidates, queries, fn):
    """Every block of queries against every block of rows: queries go out by broadcasts of bounded size."""
    found = None
    chunks = -(-max(queries.count(), 1) // CHUNK_BLOCKS)
    order = F.pmod(F.xxhash64("block"), F.lit(chunks))
    for i in range(chunks):
        part = queries.filter(order == i).select((F.col("dim") - 1).alias("dim"), F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("values").alias("q_values"))
        got = candidates.join(F.broadcast(part), "dim").mapInArrow(fn, "query_id long, vec_id long, score long")
        found = got if found is None else found.unionAll(got)
    return found


def search(vectors: DataFrame, is_query, k=K, vec_id="vec_id", embedding="embedding", scale=SCALE, parts=PARTS) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k best other rows, ties to the smaller vec_id.

    ``is_query`` is a condition on the column vec_id. Vectors that are null, or hold a null or non-finite component
    take no part, nor do rows without a vec_id; vectors meet only those of their length, empty ones too (score 0). Of rows
    that share a query's vec_id and length the smallest vector asks; as candidates all count. Scores are exact
    whatever the size of the components; one of the k best that does not fit a long raises.
    """
    rows = integers(vectors, vec_id, embedding, scale)
    # Long vectors come first in their task, so that the first blocks give high cutoffs and the last ones may be left out.
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    candidates = common.checkpoint(_blocks(rows.withColumn("_l", length).sortWithinPartitions(F.desc("_l")).drop("_l"), ROW_BLOCK, ROW_BYTES))
    asked = rows.filter(is_query).groupBy("vec_id", F.size("v").alias("_dim")).agg(F.min("v").alias("v"))
    asked = common.checkpoint(asked)

    def blocks(cutoff):
        cut = asked.join(cutoff, ["vec_id", "_dim"], "left")
        return common.checkpoint(_blocks(cut.select("vec_id", F.concat("v", F.array(F.coalesce("cutoff", F.lit(float("-inf"))))).alias("v")), QUERY_BLOCK, QUERY_BYTES))

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    none = asked.limit(0).select("vec_id", "_dim", F.lit(0.0).alias("cutoff"))
    lists = _meet(candidates.filter("nth = 0"), blocks(none), _gather(k, parts))
    kth = lists.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") == k)
    # As a double the cutoff may round up; it is lowered by more than that.
    kth = kth.select(F.col("query_id").alias("vec_id"), (F.col("score").cast("double") - F.abs(F.col("score").cast("double")) * 2.0**-50).alias("cutoff"))
    # A vec_id with vectors of several lengths asks for each, but ranks them together: its cutoff holds for all.
    lists = _meet(candidates, blocks(asked.select("vec_id", "_dim").join(kth, "vec_id")), _collect(k, parts))
    return lists.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
