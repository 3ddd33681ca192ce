"""Figures over all pairs of rows of vectors that no pair row leaves a task for."""

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..store import checkpoint
from .enrich import BLOCK, _block_pairs, _blocks, _by_squares, _closest, _dealt, _euclidean, _once, _ranked, _triangle_of

#: Bits of a distance that the first pass counts by (sign, exponent and six bits behind the point), and that each later one adds.
FIRST, MORE = 18, 10
#: Distances of a wanted range that are listed in place of another pass.
LISTED = 4096


#: Cells that are counted in one array; more are sorted.
CELLS = 1 << 20


def _counted(group, digit, wanted=None, n=None):
    """Columns ``group, wanted, digit, n`` of equal cells, their ``n`` (1 each) added."""
    wanted = np.zeros(len(group), np.int64) if wanted is None else wanted
    if not len(group):
        return group, wanted, digit, np.zeros(0, np.int64)
    low, wide, groups = digit.min(), int(digit.max() - digit.min()) + 1, int(group.max()) + 1
    if n is None and (int(wanted.max()) + 1) * groups * wide <= CELLS:
        found = np.bincount((wanted * groups + group) * wide + (digit - low))
        cell = np.flatnonzero(found)
        place, digit = np.divmod(cell, wide)
        wanted, group = np.divmod(place, groups)
        return group, wanted, digit + low, found[cell]
    order = np.lexsort((digit, wanted, group))
    group, wanted, digit = group[order], wanted[order], digit[order]
    new = np.ones(len(group), bool)
    new[1:] = (group[1:] != group[:-1]) | (wanted[1:] != wanted[:-1]) | (digit[1:] != digit[:-1])
    first = np.flatnonzero(new)
    return group[first], wanted[first], digit[first], np.diff(np.append(first, len(group))) if n is None else np.add.reduceat(n[order], first)


def _added(group, wanted, digit, n):
    return _counted(group, digit, wanted, n)


def _labelled(df, label, key, vector):
    """Sorted labels, and blocks of rows whose label's number rides in front of their vector."""
    rows = df.filter(F.col(label).isNotNull())
    names = sorted(r[0] for r in rows.select(label).distinct().collect())  # classes
    code = F.array_position(F.array(*[F.lit(x) for x in names]) if names else F.array().cast("array<string>"), F.col(label)) - 1
    rows = rows.select(F.col(key).alias("key"), F.concat(F.array(code.cast("double")), F.col(vector).cast("array<double>")).alias("v"))
    return names, _dealt(_blocks(rows, "key", "v"))


def pooled_quantile(df: DataFrame, label="species", level=0.5, key="id", vector="embedding") -> DataFrame:
    """``sp_i, sp_j, n, d``: an exact quantile of the Euclidean distances of all pairs of rows, pooled by the labels of both.

    A radix selection: the bits of a distance order as it does, so passes over the pairs count by the leading bits, and only within the
    range that holds the wanted rank by the next ones, until few enough distances share a range to be listed. Tasks send
    counts by labels and range, and recompute their distances in each pass (three of them up to some millions of rows), so
    neither memory nor disk grows with the pairs. The labels are classes: two rows for each pair of them reach the driver between passes.

    Rows with a null in key, vector or label have no pairs; vectors meet those of their length. The quantile lies between ranks as ``percentile`` does.
    """
    names, blocks = _labelled(df, label, key, vector)
    classes = len(names)

    def cells(ki, x, kj, y, same):
        """Class pair and bits of each distance."""
        d = _euclidean(x[:, 1:], y[:, 1:])
        a, b = x[:, 0].astype(np.int64), y[:, 0].astype(np.int64)
        group, bits = np.minimum.outer(a, b) * classes + np.maximum.outer(a, b), d.view(np.int64)
        keep = ki[:, None] < kj[None, :] if same else slice(None)
        return group[keep].ravel(), bits[keep].ravel()

    def count(prefixes, above, shift):
        """Counts by the bits from ``shift`` on, of the distances whose bits from ``above`` on are a prefix of their class pair."""

        def pairs(*block):
            group, bits = cells(*block)
            if prefixes is None:
                yield _counted(group, bits >> shift)
                return
            for w, known in enumerate(prefixes):
                m = known[group] == bits >> above
                yield _counted(group[m], bits[m] >> shift, np.full(m.sum(), w))

        found = _triangle_of(blocks, pairs, "group long, wanted long, digit long, n long", _added)
        return found.groupBy("group", "wanted", "digit").agg(F.sum("n").alias("n"))

    def chosen(counts, ranks):
        """The range that holds each wanted rank: ``group, wanted, digit, n, rank`` (within the range), from (group, wanted, rank)."""
        before = F.sum("n").over(Window.partitionBy("group", "wanted").orderBy("digit")) - F.col("n")
        placed = counts.withColumn("before", before).join(F.broadcast(ranks), ["group", "wanted"])  # two rows a pair of classes
        return placed.filter("before <= rank and rank < before + n").select("group", "wanted", "digit", "n", (F.col("rank") - F.col("before")).alias("rank")).collect()

    spark = df.sparkSession
    first = checkpoint(count(None, 0, 64 - FIRST))
    totals = {r.group: r.n for r in first.groupBy("group").agg(F.sum("n").alias("n")).collect()}
    frame = lambda rows: spark.createDataFrame(rows, "group long, wanted long, rank long")
    place = {g: level * (n - 1) for g, n in totals.items()}
    ranks = [(g, w, int(f(p))) for g, p in place.items() for w, f in enumerate((np.floor, np.ceil))]
    twice = first.drop("wanted").withColumn("wanted", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))))
    state, shift = chosen(twice, frame(ranks)), 64 - FIRST
    while shift:
        above, shift = shift, 0 if max((r.n for r in state), default=0) <= LISTED else max(0, shift - MORE)
        prefixes = np.full((2, classes * classes), -1, np.int64)
        for r in state:
            prefixes[r.wanted, r.group] = r.digit
        state = chosen(count(prefixes, above, shift), frame([(r.group, r.wanted, r.rank) for r in state]))
    value = {(r.group, r.wanted): float(np.int64(r.digit).view(np.float64)) for r in state}
    out = []
    for g, p in place.items():
        low, high = value[g, 0], value[g, 1]
        share = p - np.floor(p)
        out.append((names[g // classes], names[g % classes], totals[g], float((1 - share) * low + share * high)))
    kind = df.schema[label].dataType.simpleString()
    return spark.createDataFrame(out, f"sp_i {kind}, sp_j {kind}, n long, d double")


def pooled_mean(df: DataFrame, label="species", key="id", vector="embedding") -> DataFrame:
    """``sp_i, sp_j, n, d``: the mean Euclidean distance of all pairs of rows, pooled by the labels of both.

    Tasks send sums by labels. Rows with a null in key, vector or label have no pairs; vectors meet those of their length.
    """
    names, blocks = _labelled(df, label, key, vector)
    classes = len(names)

    def pairs(ki, x, kj, y, same):
        i, j = np.argsort(x[:, 0], kind="stable"), np.argsort(y[:, 0], kind="stable")
        (a, first), (b, second) = (np.unique(v, return_index=True) for v in (x[i, 0].astype(np.int64), y[j, 0].astype(np.int64)))
        pooled = lambda v: np.add.reduceat(np.add.reduceat(v, first, axis=0), second, axis=1).ravel()
        keep = (ki[i][:, None] < kj[j][None, :] if same else np.ones((len(i), len(j)), bool)).astype(float)
        d = _by_squares(x[i, 1:], y[j, 1:])
        yield _summed((np.minimum.outer(a, b) * classes + np.maximum.outer(a, b)).ravel(), pooled(keep), pooled(np.where(keep > 0, d, 0.0)))

    sums = _triangle_of(blocks, pairs, "group long, n double, d double", _summed).groupBy("group").agg(F.sum("n").cast("long").alias("n"), F.sum("d").alias("d")).filter("n > 0")
    named = lambda c: F.element_at(F.array(*[F.lit(x) for x in names]) if names else F.array().cast("array<string>"), (c + 1).cast("int"))
    kind = df.schema[label].dataType
    return sums.select(named(F.floor(F.col("group") / max(1, classes))).cast(kind).alias("sp_i"), named(F.col("group") % max(1, classes)).cast(kind).alias("sp_j"), "n", (F.col("d") / F.col("n")).alias("d"))


def _summed(group, *amounts):
    """Amounts added by group."""
    group, at = np.unique(group, return_inverse=True)
    return group, *[np.bincount(at, weights=v, minlength=len(group)) for v in amounts]


def stress(df: DataFrame, other, key="id", vector="embedding") -> DataFrame:
    """``stress``: squared differences of the distances of all pairs in two vector columns, as a share of the squared distances in the first.

    Tasks compute both distances and send two sums. Rows with a null in one of the columns have no pairs.
    """
    whole = lambda c: F.col(c).cast("array<double>")
    # Both vectors ride in one array, after the length of the first.
    rows = df.select(F.col(key).alias("key"), F.concat(F.array(F.size(vector).cast("double")), whole(vector), whole(other)).alias("v"))

    def pairs(ki, x, kj, y, same):
        changes, squares = 0.0, 0.0
        for size in np.intersect1d(x[:, 0], y[:, 0]).astype(int).tolist():
            i, j = np.flatnonzero(x[:, 0] == size), np.flatnonzero(y[:, 0] == size)
            keep = ki[i][:, None] < kj[j][None, :] if same else np.ones((len(i), len(j)), bool)
            d, e = (_by_squares(x[i, s], y[j, s])[keep] for s in (slice(1, 1 + size), slice(1 + size, None)))
            changes, squares = changes + float(((e - d) ** 2).sum()), squares + float((d**2).sum())
        yield [changes], [squares]

    added = lambda *sums: [[float(v.sum())] for v in sums]
    sums = _triangle_of(_dealt(_blocks(rows, "key", "v")), pairs, "changes double, squares double", added)
    return sums.agg(F.try_divide(F.sum("changes"), F.sum("squares")).alias("stress"))


# Nearest rows by an index of pivots.

#: Rows that serve as pivots at most.
PIVOTS = 32
#: Part by which a bound is lowered against rounding.
SLACK = 1e-9


def metric_blocks(df: DataFrame, key="id", vector="embedding", block=BLOCK, pivots=PIVOTS, k=None) -> DataFrame:
    """``_size, block, low, high, reach, _rows``: vectors in blocks of neighbours, each with the least and greatest distance of its rows to every pivot.

    ``reach``: the largest distance of a row to its ``k``-th nearest other row in the block, infinite if a row has fewer (or without ``k``).

    Pivots are the rows of smallest hashes. Rows are laid out by their nearest pivot and the distance to it, by a range exchange, and
    cut into blocks where they lie, so however many rows a pivot has, no task gathers them. A block ends with its pivot's rows once it is a quarter full.
    """
    rows = df.select(F.col(key).cast("long").alias("k"), F.col(vector).cast("array<double>").alias("v")).filter(F.col("k").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull()))
    chosen = {}
    for r in rows.orderBy(F.xxhash64("k"), "k").limit(pivots).collect():
        chosen.setdefault(len(r.v), []).append(r.v)
    chosen = {size: np.array(v) for size, v in chosen.items()}

    def far(x):
        """Distances to the pivots of the vectors' length; one column of zeros without any, which bounds nothing."""
        return _euclidean(x, chosen[x.shape[1]]) if x.shape[1] in chosen and x.shape[1] else np.zeros((len(x), 1))

    def place(batches):
        for b in batches:
            lists = b.column(1)
            sizes, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(zero_copy_only=False)
            start = np.cumsum(sizes) - sizes
            cell, r = np.zeros(len(sizes), np.int32), np.zeros(len(sizes))
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                d = far(flat[start[at][:, None] + np.arange(size)])
                cell[at], r[at] = d.argmin(axis=1), d.min(axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), lists, pa.array(sizes.astype(np.int32)), pa.array(cell), pa.array(r)], ["k", "v", "_size", "_cell", "_r"])

    laid = rows.mapInArrow(place, "k long, v array<double>, _size int, _cell int, _r double")
    order = ["_size", "_cell", "_r", "k"]
    spread = max(laid.sparkSession.sparkContext.defaultParallelism, int(laid.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def cut(batches):
        part, count, held = TaskContext.get().partitionId(), 0, None

        def made(table):
            nonlocal count
            x = np.array(table["v"].to_pylist(), float).reshape(table.num_rows, -1)
            d = far(x)
            count += 1
            keys = table["k"].to_numpy()
            reach = np.inf
            if k is not None:
                i, _, near = _best(x, x, keys, keys, k)
                if (np.bincount(i, minlength=len(x)) >= k).all():
                    reach = float(near.max(initial=0.0))
            out = pa.table({"_size": pa.array([x.shape[1]], pa.int32()), "block": pa.array([(part << 32) + count]), "low": pa.array([d.min(axis=0).tolist()]), "high": pa.array([d.max(axis=0).tolist()]), "reach": pa.array([reach], pa.float64()),
                            "_rows": pa.array([[{"k": i, "v": v} for i, v in zip(keys.tolist(), x.tolist(), strict=True)]], pa.list_(pa.struct([("k", pa.int64()), ("v", pa.list_(pa.float64()))])))})
            return out.to_batches()

        for b in [*batches, None]:
            if b is not None:
                t = pa.Table.from_batches([b])
                held = t if held is None else pa.concat_tables([held, t])
            while held is not None and held.num_rows and (b is None or held.num_rows > block):
                sizes, cells = held["_size"].to_numpy()[:block], held["_cell"].to_numpy()[:block]
                ends = np.flatnonzero((cells[1:] != cells[:-1]) | (sizes[1:] != sizes[:-1])) + 1
                other = ends[sizes[ends] != sizes[0]]
                end = int(other[0]) if len(other) else len(cells)
                full = ends[(ends >= block // 4) & (ends < end)]
                end = int(full[0]) if len(full) else end
                yield from made(held.slice(0, end))
                held = held.slice(end)

    return checkpoint(laid.repartitionByRange(spread, *order).sortWithinPartitions(*order).mapInArrow(cut, "_size int, block long, low array<double>, high array<double>, reach double, _rows array<struct<k:long,v:array<double>>>"))


def _best(x, y, kx, ky, k):
    """Rows of ``x``, places in ``y`` and distances of the ``k`` nearest others: screened by squares, with a margin for their rounding, then measured."""
    centre = y.mean(axis=0)
    a, b = x - centre, y - centre
    na, nb = (a * a).sum(axis=1), (b * b).sum(axis=1)
    square = na[:, None] + nb[None, :] - 2 * a @ b.T
    square[kx[:, None] == ky[None, :]] = np.inf
    most = min(k, len(y))
    edge = np.partition(square, most - 1, axis=1)[:, most - 1]
    i, j = np.nonzero((square <= (edge + 1e-12 * (na + nb.max()) * max(1, x.shape[1]))[:, None]) & np.isfinite(square))
    d = np.sqrt(((x[i] - y[j]) ** 2).sum(axis=1))
    order = np.lexsort((ky[j], d, i))
    i, j, d = i[order], j[order], d[order]
    keep = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[keep], j[keep], d[keep]


def _sides(blocks, *columns):
    """Both sides of :func:`metric_blocks`, dealt out, with their bounds and some columns."""
    return [blocks.select(*[F.col(c).alias(f"{c}_{s}") for c in ("_size", "block", "low", "high", "reach")], *[F.col(c).alias(f"{n}{c}") for c in columns]) for s, n in (("a", "_left"), ("b", "_right"))]


def _within(most=None):
    """Whether a pair of blocks is met (once, each block with itself, too) and may hold rows within the larger reach, or within ``most``."""
    apart = lambda x, y: F.array_max(F.zip_with(f"low_{x}", f"high_{y}", lambda p, q: p - q))
    reach = F.greatest("reach_a", "reach_b") if most is None else F.lit(float(most))
    a, b = F.col("block_a"), F.col("block_b")
    return (F.col("_size_a") == F.col("_size_b")) & _once(a, b) & ((a == b) | (F.greatest(apart("a", "b"), apart("b", "a")) * (1 - SLACK) <= reach))


def block_pairs(blocks: DataFrame, most=None) -> DataFrame:
    """``a, b``: pairs of :func:`metric_blocks` (a < b) of which one may hold rows within the other's reach, or within ``most`` for all blocks.

    By the triangle inequality two blocks whose distances to some pivot are further apart than the larger reach have nothing for each other.
    """
    left, right = _sides(blocks)
    met = left.hint("shuffle_replicate_nl").join(right, _within(most)).filter("block_a <> block_b")
    return met.select(F.least("block_a", "block_b").alias("a"), F.greatest("block_a", "block_b").alias("b"))


def _compared(blocks, most, fn, schema, merge=None):
    """``fn`` of the pairs of blocks that are :func:`_within`."""
    left, right = _sides(_dealt(blocks), "_rows")
    left, right = left.withColumnRenamed("_left_rows", "_left"), right.withColumnRenamed("_right_rows", "_right")
    return _block_pairs(left, right, _within(most), fn, schema, merge, F.col("block_a") == F.col("block_b"))


def close_rows(df: DataFrame, most, key="id", vector="embedding", block=BLOCK, pivots=PIVOTS) -> DataFrame:
    """``i, j, d``: pairs i < j of rows of vectors of one length whose Euclidean distance is at most ``most``; exact.

    The threshold form of a distance matrix: its size follows from the close pairs, and pairs of blocks that the pivots show to be too far
    apart are not compared. Rows with a null in key or vector, or with one key, have no pairs.
    """
    def compare(ki, x, kj, y, alone):
        centre = y.mean(axis=0)
        a, b = x - centre, y - centre
        na, nb = (a * a).sum(axis=1), (b * b).sum(axis=1)
        square = na[:, None] + nb[None, :] - 2 * a @ b.T
        # Screened by squares with a margin for their rounding, then measured.
        near = square <= most * most + 1e-12 * (na[:, None] + nb[None, :]) * max(1, x.shape[1])
        near &= ki[:, None] < kj[None, :] if alone else ki[:, None] != kj[None, :]
        i, j = np.nonzero(near)
        d = np.sqrt(((x[i] - y[j]) ** 2).sum(axis=1))
        i, j, d = i[d <= most], j[d <= most], d[d <= most]
        yield np.minimum(ki[i], kj[j]), np.maximum(ki[i], kj[j]), d

    return _compared(metric_blocks(df, key, vector, block, pivots), most, compare, "i long, j long, d double")


def nearest_rows(df: DataFrame, k, key="id", vector="embedding", block=BLOCK, pivots=PIVOTS) -> DataFrame:
    """``id, other, d``: each row's k nearest other rows by Euclidean distance, exact, ties to the smaller key.

    Pairs of blocks that the pivots show to be too far apart (:func:`block_pairs`) are not compared; of the others a task passes on
    k rows for each of its rows at most. How many pairs are left out rests on the vectors: most in few dimensions or in clusters, none
    where all rows are about equally far from each other. Rows that share a key are never each other's neighbours; rows with a null in key or vector have none.
    """
    def compare(ki, x, kj, y, same):
        i, j, d = _best(x, y, ki, kj, k)
        yield ki[i], kj[j], d
        if not same:
            i, j, d = _best(y, x, kj, ki, k)
            yield kj[i], ki[j], d

    near = _compared(metric_blocks(df, key, vector, block, pivots, k), None, compare, "id long, other long, d double", partial(_closest, k))
    return _ranked(near, k, "id", "other")
