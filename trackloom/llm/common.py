"""What several operators need: checkpoints, size-checked broadcasts, distributed ranks, components."""

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store import checkpoint, running_start  # noqa: F401

#: Characters that separate words in most operators, for trimming, and the same as a pattern.
SPACES = " \t\n\x0b\f\r"
SPACES_RE = r"[\x20\x09-\x0D]+"
#: Rows that leave by a broadcast at most; more are matched by a shuffle.
BROADCAST_ROWS = 250_000
#: Bytes of a record batch that a Python function works on at once.
PIECE_BYTES = 1 << 20


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it holds at most ``most`` rows; else left to a shuffled join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def pieces(batches, most: int = PIECE_BYTES):
    """All rows of the record batches in order, cut so that about ``most`` bytes, or one row, are held as Python objects at once.

    Spark's batches hold 10,000 rows whatever their size, and what a worker has once taken for one it keeps for later stages.
    """
    for b in batches:
        rows = max(1, b.num_rows * most // max(1, b.nbytes))
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
        b = None
    pa.default_memory_pool().release_unused()


def let(value, body):
    """``body`` of a value that is computed once, for use inside larger expressions."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text):
    """Words between ASCII white space as an array; null and blank text give an empty array."""
    body = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, SPACES_RE))


#: Columns of :func:`text_hashes`.
TEXT_HASHES = ["_hash0", "_hash1"]


def text_hashes(text):
    """Two 64-bit hashes of a text, which order rows that tie in all else without moving their texts."""
    return [F.xxhash64(F.lit(k), text).alias(name) for k, name in enumerate(TEXT_HASHES)]


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keyed(docs: DataFrame, key, doc_id="doc_id", text="text") -> DataFrame:
    """``docs`` with a long column ``key`` (a :func:`fresh` name) that no two rows share and that orders rows as their doc_id does.

    It is the doc_id itself where that is unique and not null; else rows are numbered by doc_id (null
    first), then text.
    """
    rows = docs.withColumn(key, F.col(doc_id).cast("long"))
    if rows.groupBy(key).count().filter(F.col(key).isNull() | (F.col("count") > 1)).limit(1).count():
        packed = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"), F.struct("*").alias("_row"))
        rows = running_start(packed, ["_id", "_text"]).select(F.col("_start").alias(key), "_row.*")
    return rows


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest reachable node) for every node of ``edges`` (``a, b``).

    Labels spread along the edges and then jump to their own label's label, so the number of
    rounds follows the logarithm of a chain's length in practice.  Each round is checkpointed.
    """
    both = checkpoint(edges.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionAll(edges.select(F.col("b").alias("src"), F.col("a").alias("dst"))).distinct())
    label = checkpoint(both.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("component")).withColumnRenamed("src", "node"))
    while True:
        # Broadcast while they are few, labels spare the hub of a giant component from being one task's key.
        known = small(label)
        around = both.join(known, both.dst == known.node).groupBy("src").agg(F.min("component").alias("near"))
        spread = label.join(around, label.node == around.src).select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        parent = small(label.select(F.col("node").alias("p"), F.col("component").alias("up")))
        new = checkpoint(spread.join(parent, F.col("component") == F.col("p")).select("node", "old", F.least("component", "up").alias("component")))
        label = new.select("node", "component")
        if not new.filter("component <> old").limit(1).count():
            return label
