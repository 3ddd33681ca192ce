"""Near-duplicate vectors by cross-polytope hashing.

A vector is turned by a few fast Hadamard rotations with random signs; its hash is the vertex of the cross-polytope (an axis and a
sign) that lies nearest. A table joins the hashes of ``ROTATIONS`` turns, and each turn is probed at its ``PROBES`` nearest
vertices, so a vector lies in ``PROBES ** ROTATIONS`` buckets of each of ``TABLES`` tables. Vectors that share a bucket are candidates,
and their cosine is computed in double precision.

* Equal vectors are one class from the start; only one of them is hashed.
* A bucket of many classes is dealt out as pairs of blocks, so no task holds more than two blocks of it.
* The buckets of a table are a product of vertex sets, hence two vectors' codes alone tell the first bucket that they share: there,
  and only there, their link counts. No pair leaves a task; what leaves is a class's number of links and one edge to the smallest
  class that it is tied to inside the task. So a crowd of near copies costs arithmetic, not rows.

With the default numbers a pair in 64 dimensions at the threshold of 0.9 shares a bucket with a probability of 0.99, one at 0.95
with 0.9995; in 768 dimensions 8 tables do the same (:func:`meeting` measures it).
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

COSINE = 0.9
TABLES = 4
ROTATIONS = 2
PROBES = 2
SEED = 20240311
#: Classes of one bucket that meet in one task; more are dealt out as pairs of blocks of so many.
BLOCK = 512
#: Rows of a cell that is compared pair by pair together with others; larger ones are compared by products of matrices.
SMALL = 32
#: Pairs that are compared at once.
PAIRS = 1 << 17
#: Rows are looked up by the vectors of classes of more than a (HOT-th of all) copies by a broadcast of at most HOT rows.
HOT = 1000

_CODED = "rep long, size long, dim int, codes binary, buckets array<struct<nth:int,bucket:long>>, values binary"


def _padded(dim):
    """Power of two that holds ``dim``, 8 at least so that vectors of few dimensions are turned too."""
    return max(8, 1 << (dim - 1).bit_length())


def hadamard(x):
    """Rows of ``x`` times the Hadamard matrix, by sums and differences; the length of a row is a power of two."""
    n = x.shape[1]
    half = 1
    while half < n:
        x = x.reshape(len(x), -1, 2, half)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2).reshape(len(x), n)
        half *= 2
    return x


def codes(x, tables=TABLES, rotations=ROTATIONS, probes=PROBES, seed=SEED):
    """Nearest vertices of each row: an array of rows x tables x rotations x probes, nearest first; axis * 2 + sign."""
    wide = _padded(x.shape[1])
    signs = np.random.default_rng([seed, x.shape[1]]).choice([-1.0, 1.0], (tables, rotations, 3, wide))
    laid = np.zeros((len(x), wide))
    laid[:, : x.shape[1]] = x
    out = np.empty((len(x), tables, rotations, probes), np.uint32)
    for t in range(tables):
        for r in range(rotations):
            y = laid
            for s in signs[t, r]:
                y = hadamard(y * s)
            axis = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :probes]
            out[:, t, r] = 2 * axis + (np.take_along_axis(y, axis, 1) < 0)
    return out


def _buckets(code, dim):
    """Number of each bucket in its table, rows x tables x buckets, from ``codes``."""
    n, tables, rotations, probes = code.shape
    out = np.zeros((n, tables, 1), np.int64)
    for r in range(rotations):
        out = (out[:, :, :, None] * (2 * _padded(dim)) + code[:, :, r, None, :]).reshape(n, tables, -1)
    return out


def meeting(cosine, dim, pairs=4000, **settings):
    """Share of random pairs at a cosine that share a bucket: the recall that the settings are chosen by."""
    rng = np.random.default_rng(7)
    a = unit(rng.normal(size=(pairs, dim)))
    b = rng.normal(size=(pairs, dim))
    b = unit(b - (a * b).sum(1, keepdims=True) * a)
    x, y = (codes(v, **settings) for v in (a, cosine * a + np.sqrt(1 - cosine**2) * b))
    return float((x[..., :, None] == y[..., None, :]).any((-1, -2)).all(-1).any(-1).mean())


def unit(x):
    """Rows of length 1; a row's largest component is brought to 1 first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _code(settings):
    """Codes and buckets of each class; its vector goes on as bytes of its own type."""

    def run(batches):
        for b in batches:
            reps, sizes, lists = b.column(0), b.column(1), b.column(2)
            lengths, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(zero_copy_only=False)
            start = np.cumsum(lengths) - lengths
            for dim in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == dim)
                x = flat[start[at][:, None] + np.arange(dim)]
                code = codes(unit(x.astype(np.float64)), **settings)
                bucket = _buckets(code, dim)
                rows = [[{"nth": t, "bucket": v} for t, some in enumerate(tables) for v in some] for tables in bucket.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [reps.take(pa.array(at)), sizes.take(pa.array(at)), pa.array(np.full(len(at), dim), pa.int32()), pa.array([c.tobytes() for c in code], pa.binary()),
                     pa.array(rows, pa.list_(pa.struct([("nth", pa.int32()), ("bucket", pa.int64())]))), pa.array([v.tobytes() for v in x], pa.binary())],
                    ["rep", "size", "dim", "codes", "buckets", "values"],
                )

    return run


def _first_shared(code, i, j, nth, bucket, dim):
    """Whether the bucket of table ``nth`` (both for each pair) is the first one that rows ``i`` and ``j`` share."""
    own = np.ones(len(i), bool)
    for t in range(int(nth.max(initial=0))):
        later = np.flatnonzero(own & (nth > t))
        same = code[i[later], t][..., :, None] == code[j[later], t][..., None, :]
        own[later] &= ~same.any((-1, -2)).all(-1)
    least = np.zeros(len(i), np.int64)
    for r in range(code.shape[2]):
        a, b = code[i, nth, r], code[j, nth, r]
        same = (a[:, :, None] == b[:, None, :]).any(-1)
        least = least * (2 * _padded(dim)) + np.where(same, a, np.iinfo(np.int32).max).min(axis=1).astype(np.int64)
    return own & (least == bucket)


def _smallest(n, edges):
    """Smallest reachable row of each of ``n`` rows along ``edges``, a list of array pairs."""
    label = np.arange(n)
    while True:
        before = label.copy()
        for i, j in edges:
            low = np.minimum(label[i], label[j])
            np.minimum.at(label, i, low)
            np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            return label


def _unpacked(rows, settings):
    """Unit vectors and codes of rows of one length."""
    dim, values = rows["dim"][0].as_py(), rows["values"].to_pylist()
    x = np.frombuffer(b"".join(values), np.float32 if len(values[0]) == 4 * dim else np.float64).reshape(len(values), dim)
    code = np.frombuffer(b"".join(rows["codes"].to_pylist()), np.uint32).reshape(len(values), settings["tables"], settings["rotations"], settings["probes"])
    return dim, unit(x.astype(np.float64)), code


def _found(reps, sizes, pairs):
    """Rows to send for pairs of places that link: representative, links and the smallest one it is tied to."""
    links, down = np.zeros(len(reps), np.int64), np.argsort(reps, kind="stable")
    place = np.empty(len(reps), np.int64)
    place[down] = np.arange(len(reps))  # labels are places in the order of representatives
    for i, j in pairs:
        np.add.at(links, i, sizes[j])
        np.add.at(links, j, sizes[i])
    tied = _smallest(len(reps), [(place[i], place[j]) for i, j in pairs])
    m = np.flatnonzero(links)
    return pa.RecordBatch.from_arrays([pa.array(reps[m]), pa.array(links[m]), pa.array(reps[down[tied[place[m]]]])], ["rep", "links", "tied"])


def _crowded(rows, cosine, settings):
    """Links of one pair of blocks, or of one block within itself, by products of matrices."""
    reps, sizes, side = (rows[c].to_numpy() for c in ("rep", "size", "side"))
    dim, x, code = _unpacked(rows, settings)
    nth, bucket = rows["nth"][0].as_py(), rows["bucket"][0].as_py()
    alone = rows["x"][0].as_py() == rows["y"][0].as_py()
    left, right = (np.arange(len(reps)),) * 2 if alone else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    pairs, step = [], max(1, PAIRS // max(1, len(right)))
    for k in range(0, len(left), step):
        some = left[k : k + step]
        i, j = np.nonzero(x[some] @ x[right].T >= cosine)
        i, j = some[i], right[j]
        if alone:
            i, j = i[i < j], j[i < j]
        own = _first_shared(code, i, j, np.full(len(i), nth), bucket, dim)
        pairs.append((i[own], j[own]))
    return _found(reps, sizes, pairs)


def _few(rows, cell, cosine, settings):
    """Links of many small cells at once, pair by pair; ``cell`` numbers the rows' cells, which lie together."""
    reps, sizes, nth, bucket = (rows[c].to_numpy() for c in ("rep", "size", "nth", "bucket"))
    dim, x, code = _unpacked(rows, settings)
    # Row i pairs with the later rows of its cell.
    end = np.searchsorted(cell, cell, side="right")
    later = end - np.arange(len(cell)) - 1
    i = np.repeat(np.arange(len(cell)), later)
    j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(later) - later, later)
    pairs = []
    for k in range(0, len(i), PAIRS):
        a, b = i[k : k + PAIRS], j[k : k + PAIRS]
        near = np.einsum("ij,ij->i", x[a], x[b]) >= cosine
        a, b = a[near], b[near]
        own = _first_shared(code, a, b, nth[a], bucket[a], dim)
        pairs.append((a[own], b[own]))
    return _found(reps, sizes, pairs)


def _cells(cosine, settings, small):
    """Cells of a partition sorted by cell: small ones together, crowded ones one by one."""
    names = ("dim", "nth", "bucket", "x", "y")

    def solve(rows, turn):
        size = np.diff(turn)
        cell = np.repeat(np.arange(len(size)), size)
        single_block = rows["x"].to_numpy() == rows["y"].to_numpy()
        dims = rows["dim"].to_numpy()
        few = (size[cell] > 1) & (size[cell] <= small) & single_block
        for dim in np.unique(dims[few]).tolist():
            m = np.flatnonzero(few & (dims == dim))
            yield _few(rows.take(pa.array(m)), cell[m], cosine, settings)
        for c in np.unique(cell[(size[cell] > 1) & ~few]).tolist():
            yield _crowded(rows.slice(int(turn[c]), int(size[c])), cosine, settings)

    def run(batches):
        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            keys = [held[c].to_numpy() for c in names]
            turn = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            if len(turn):
                yield from solve(held.slice(0, int(turn[-1])), np.concatenate(([0], turn)))
                held = held.slice(int(turn[-1]))
        if held is not None and held.num_rows > 1:
            yield from solve(held, np.array([0, held.num_rows]))

    return run


def links(classes: DataFrame, cosine=COSINE, tables=TABLES, rotations=ROTATIONS, probes=PROBES, seed=SEED, block=BLOCK, small=SMALL) -> DataFrame:
    """``rep, links, tied``, several rows for a class: shares of its number of links (weighted by ``size``) and a smaller class it is tied to.

    ``classes`` has ``rep`` (long, unique), ``size`` (long) and ``v`` (arrays of different finite vectors, none zero).
    """
    if not 1 <= rotations <= 3:
        raise ValueError("one to three rotations make a bucket's number")
    settings = {"tables": tables, "rotations": rotations, "probes": probes, "seed": seed}
    coded = common.checkpoint(classes.select("rep", "size", "v").mapInArrow(_code(settings), _CODED))
    key = ["dim", "nth", "bucket"]
    spread = coded.select("rep", "size", "dim", "codes", "values", F.inline("buckets"))
    # Of these there are at most rows / block.
    crowded = coded.select("dim", F.inline("buckets")).groupBy(key).count().filter(F.col("count") > block).select(*key, F.ceil(F.col("count") / block).cast("int").alias("n"))
    spread = spread.join(common.small(common.checkpoint(crowded)), key, "left").withColumn("n", F.coalesce("n", F.lit(1)))
    own = F.pmod(F.xxhash64("rep"), F.col("n")).cast("int")
    spread = spread.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    spread = spread.select("rep", "size", *key, "codes", "values", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    cell = [*key, "x", "y"]
    return spread.repartition(*cell).sortWithinPartitions(*cell).mapInArrow(_cells(cosine, settings, small), "rep long, links long, tied long")


def near_duplicates(vectors: DataFrame, cosine=COSINE, vec_id="vec_id", embedding="embedding", **settings) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors``.

    Two rows link if their vectors have a cosine of ``cosine`` (above 0) or more and one length; every link reported is one, and nearly all are
    found (see the module). ``component_id`` is the smallest vec_id reachable along links, itself included; ``kept`` says that it is the row's own.

    Vectors that are null, empty, zero, or hold a null or non-finite component link with nothing. Rows that share a vec_id are vectors of
    their own, as are rows without one; these never name a component, so one of such rows alone has a null component_id and is kept. Other
    columns are not read.
    """
    if cosine <= 0:
        raise ValueError("vectors at a right angle or beyond are no near-duplicates")
    kind = vectors.schema[embedding].dataType.elementType.simpleString()
    number = "float" if kind == "float" else "double"
    # Adding zero turns -0.0 into 0.0.
    value = F.transform(F.col(embedding).cast(f"array<{number}>"), lambda x: x + F.lit(0).cast(number))
    slim = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), value.alias("v"))
    rows = common.checkpoint(common.keyed(slim, "_k", "vec_id", "v"))
    sound = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    classes = common.checkpoint(rows.filter(sound).groupBy("v").agg(F.min("_k").alias("rep"), F.count("*").alias("size")))
    found = common.checkpoint(links(classes, cosine, **settings))
    sums = found.groupBy("rep").agg(F.sum("links").alias("links"))
    tied = common.components(found.filter("rep <> tied").select(F.col("rep").alias("a"), F.col("tied").alias("b"))).withColumnRenamed("node", "rep")
    info = classes.join(sums, "rep", "left").join(tied, "rep", "left")
    info = info.select("v", "rep", "size", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    info = common.checkpoint(info)
    # Copies look their class up by the vector: hot ones by a broadcast of at most HOT rows, the others, of at most total / HOT copies, by a shuffle.
    total = rows.count()
    several = info.filter("size > 1").select("v", "rep", "n_links", "component", "size")
    hot, rest = (several.filter(c).drop("size") for c in (F.col("size") * HOT > total, F.col("size") * HOT <= total))
    names = ["rep", "n_links", "component"]
    single = info.filter("size = 1").select(*names)
    out = rows.join(single.select(F.col("rep").alias("_k"), *(F.col(c).alias(f"a_{c}") for c in names)), "_k", "left")
    open_rows = out.filter(F.col("a_rep").isNull() & sound)
    done = out.filter(F.col("a_rep").isNotNull() | ~sound).select("vec_id", "_k", F.col("a_n_links").alias("n_links"), F.col("a_component").alias("component"))
    looked = open_rows.select("vec_id", "_k", "v").join(F.broadcast(hot), "v", "left")
    known, unknown = looked.filter("rep is not null").select(*done.columns), looked.filter("rep is null").select("vec_id", "_k", "v")
    out = done.unionAll(known).unionAll(unknown.join(rest.select("v", *names[1:]), "v").select(*done.columns))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component", "_k").alias("_c"), "_k")
    if not rows.filter(~F.col("vec_id").eqNullSafe(F.col("_k"))).limit(1).count():
        return out.select("vec_id", "n_links", F.col("_c").alias("component_id"), (F.col("_c") == F.col("_k")).alias("kept"))
    out = common.checkpoint(out)
    named = out.groupBy("_c").agg(F.min("vec_id").alias("component_id"))
    return out.join(named, "_c").select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
