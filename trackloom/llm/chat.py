"""Chat formatting with minimum-cost role repair.

A dynamic program over the automaton of legal turns (an optional system turn, then user and assistant
in alternation, the assistant last) chooses for each turn a label and whether it opens a turn, merges
with the one before, or needs an empty turn inserted first.  A turn is a matrix of costs from
state to state, and stretches of turns compose in the (min, +) algebra.  So a conversation is cut into
parts of ``PART`` turns: parts become matrices, matrices are composed level by level, entry
and exit states come back down, and every part renders on its own, however long the conversation is.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

PART = 512
ROLES = ("system", "user", "assistant")
#: Other names that roles go by (fixed values).
ALIASES = {"human": "user", "prompter": "user", "bot": "assistant", "gpt": "assistant", "model": "assistant"}
MERGE, INSERT, RELABEL = 1, 2, 3
NEVER = 1 << 40
#: States: nothing said yet, or the role that spoke last.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Legal successions; the roles to insert make another succession legal.
_LEGAL = {(START, SYSTEM), (START, USER), (SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
_INSERTED = {(START, ASSISTANT): USER, (SYSTEM, ASSISTANT): USER, (USER, USER): ASSISTANT, (ASSISTANT, ASSISTANT): USER}
#: Empty turns that end a conversation legally from each state.
_CLOSING = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}
_NAMES = ("", *ROLES)
#: What could be read as a marker inside a text; it gets a backslash more, which a reader takes off again.
_MARKER = re.compile(r"<(\\*)\|(end|system|user|assistant)\|>")


def escaped(text):
    """A text without markers: ``<|end|>`` becomes ``<\\|end|>``, and one that has backslashes there gets one more."""
    return _MARKER.sub(r"<\\\1|\2|>", text)


def role_state(role):
    name = str(role or "").strip().lower()
    name = ALIASES.get(name, name)
    return _NAMES.index(name) if name in ROLES else None


def step(before, label, role):
    """Cost and inserted role of giving ``label`` to a turn of ``role`` after state ``before``; merging where that is possible."""
    cost = 0 if label == role else RELABEL
    if before == label:
        return cost + MERGE, None
    if (before, label) in _LEGAL:
        return cost, None
    if (before, label) in _INSERTED:
        return cost + INSERT, _INSERTED[before, label]
    return NEVER, None


#: Cost matrices of a turn by its role's state; the last one is for unknown roles.
TURN = np.array([[[step(s, t, r)[0] if t else NEVER for t in range(4)] for s in range(4)] for r in (SYSTEM, USER, ASSISTANT, None)])


def compose(matrices):
    """(min, +) product of matrices in order."""
    out = matrices[0]
    for m in matrices[1:]:
        out = np.minimum((out[:, :, None] + m[None, :, :]).min(axis=1), NEVER)
    return out


def states(matrices, entry, last):
    """States between the matrices on a cheapest way from ``entry`` to ``last``; ties to the smaller state, from the end on."""
    cost = [np.where(np.arange(4) == entry, 0, NEVER)]
    for m in matrices:
        cost.append((cost[-1][:, None] + m).min(axis=0))
    way = [last]
    for c, m in zip(cost[-2::-1], matrices[::-1], strict=True):
        way.append(int((c + m[:, way[-1]]).argmin()))
    return way[::-1]


def _turn_matrices(roles):
    return [TURN[3 if r is None else r - 1] for r in map(role_state, roles)]


def render(roles, texts, entry, last, closes):
    """Rendered turns of one part, and what was done to them."""
    way = states(_turn_matrices(roles), entry, last)
    out, done = [], {"n_out": 0, "n_merged": 0, "n_relabelled": 0, "n_inserted": 0, "cost": 0}

    def opens(state, before):
        out.append(("<|end|>\n" if before else "") + f"<|{_NAMES[state]}|>\n")
        done["n_out"] += 1

    for role, text, before, label in zip(roles, texts, way, way[1:], strict=False):
        cost, inserted = step(before, label, role_state(role))
        done["cost"] += cost
        done["n_relabelled"] += role_state(role) != label
        if inserted:
            opens(inserted, before)
            done["n_inserted"] += 1
            before = inserted
        if before == label:
            done["n_merged"] += 1
            out.append("\n")
        else:
            opens(label, before)
        out.append(escaped(text or ""))
    if closes:
        before = way[-1]
        for state in _CLOSING[before]:
            opens(state, before)
            done["n_inserted"] += 1
            done["cost"] += INSERT
            before = state
        out.append("<|end|>\n")
    return "".join(out), done


def _groups(batches, keys):
    """Columns, as lists by name, of each stretch of equal ``keys`` in a sorted stream of batches."""
    held, last = None, None
    for b in batches:
        if not b.num_rows:
            continue
        columns = dict(zip(b.schema.names, (c.to_pylist() for c in b.columns), strict=True))
        key = list(zip(*(columns[k] for k in keys), strict=True))
        cuts = [0, *(i for i in range(1, len(key)) if key[i] != key[i - 1]), len(key)]
        for a, e in zip(cuts, cuts[1:], strict=False):
            part = {n: c[a:e] for n, c in columns.items()}
            if held is not None and key[a] == last:
                held = {n: held[n] + part[n] for n in held}
                continue
            if held is not None:
                yield held
            held, last = part, key[a]
    if held is not None:
        yield held


def _batch(rows, names, kinds):
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def _sliced(found, names, kinds, size=1000):
    """Rows as batches of bounded size."""
    rows = []
    for r in found:
        rows.append(r)
        if len(rows) >= size:
            yield _batch(rows, names, kinds)
            rows = []
    if rows:
        yield _batch(rows, names, kinds)


_NODE = (["conv", "node", "matrix"], [pa.int64(), pa.int64(), pa.list_(pa.int64())])


def _dealt(df: DataFrame, *by):
    """Rows of a part together and in order.

    The number of tasks is set, as small rows may mean much work. The hash keeps this exchange apart from
    those of joins on the same keys: Spark would drop it as a repetition of theirs, and then let go of
    their partitioning when it changes the join at run time.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, F.xxhash64(*by[:2])).sortWithinPartitions(*by)


def _composed(nodes: DataFrame) -> DataFrame:
    """One level up: matrices of up to PART consecutive nodes composed."""

    def run(batches):
        yield from _sliced(((g["conv"][0], g["up"][0], compose([np.array(m).reshape(4, 4) for m in g["matrix"]]).ravel().tolist()) for g in _groups(batches, ["conv", "up"])), *_NODE)

    up = _dealt(nodes.withColumn("up", F.floor(F.col("node") / PART)), "conv", "up", "node")
    return up.mapInArrow(run, "conv long, node long, matrix array<long>")


def _spread(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """One level down: entry and exit states of nodes from those of the nodes above."""

    def run(batches):
        def found():
            for g in _groups(batches, ["conv", "up"]):
                way = states([np.array(m).reshape(4, 4) for m in g["matrix"]], g["entry"][0], g["exit"][0])
                yield from zip(g["conv"], g["node"], way[:-1], way[1:], strict=True)

        yield from _sliced(found(), ["conv", "node", "entry", "exit"], [pa.int64(), pa.int64(), pa.int32(), pa.int32()])

    up = nodes.withColumn("up", F.floor(F.col("node") / PART)).join(above.withColumnRenamed("node", "up"), ["conv", "up"])
    return _dealt(up, "conv", "up", "node").mapInArrow(run, "conv long, node long, entry int, exit int")


def repair(turns: DataFrame, conv_id="conv_id", turn="turn", role="role", text="text") -> DataFrame:
    """``conv_id, part, n_turns, n_out, n_merged, n_relabelled, n_inserted, cost, rendered``: one row for each part of PART turns.

    Turns are in order of ``turn``, then role and text; a conversation's text is its parts' in order. Null texts
    are empty turns, unknown or null roles are relabelled, repeated rows are turns of their own, and rows with
    null conv_id form one conversation. Markers inside a text are escaped (:func:`escaped`), so the result reads back
    as the legal turns it was built of. :func:`joined` puts long conversations together.
    """
    rows = turns.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    rows = common.running_start(rows, ["turn", "role", "text"], by="conv_id")
    rows = rows.withColumns({"node": F.floor(F.col("_start") / PART), "none": F.col("conv_id").isNull(), "conv": F.coalesce("conv_id", F.lit(0))})
    # A null conversation takes an id of its own below all parts' ids: its parts are numbered from a negative start.
    rows = common.checkpoint(rows.withColumn("node", F.when(F.col("none"), F.col("node") - (1 << 50)).otherwise(F.col("node"))))

    def matrices(batches):
        yield from _sliced(((g["conv"][0], g["node"][0], compose(_turn_matrices(g["role"])).ravel().tolist()) for g in _groups(batches, ["conv", "node"])), *_NODE)

    slim = _dealt(rows.select("conv", "node", "_start", "role"), "conv", "node", "_start")
    levels = [common.checkpoint(slim.mapInArrow(matrices, "conv long, node long, matrix array<long>"))]
    ends = levels[0].groupBy("conv", (F.col("node") < 0).alias("none")).agg(F.max("node").alias("last"))
    while levels[-1].groupBy("conv", F.col("node") < 0).count().filter("count > 1").limit(1).count():
        levels.append(common.checkpoint(_composed(levels[-1])))

    # At the top, the exit is the state with the least cost, closing turns included.
    closing = F.array(*[F.lit(INSERT * len(_CLOSING[s])).cast("long") for s in range(4)])
    totals = F.zip_with(F.slice("matrix", 1, 4), closing, lambda a, b: a + b)  # from START, the first row
    way = levels[-1].select("conv", "node", F.lit(START).alias("entry"), (F.array_position(totals, F.array_min(totals)) - 1).cast("int").alias("exit"))
    for nodes in levels[-2::-1]:
        way = common.checkpoint(_spread(nodes, way))

    def rendered(batches):
        def found():
            for g in _groups(batches, ["conv", "node"]):
                said, done = render(g["role"], g["text"], g["entry"][0], g["exit"][0], g["closes"][0])
                yield (g["conv"][0], g["none"][0], g["node"][0], len(g["role"]), *done.values(), said)

        yield from _sliced(found(), ["conv", "none", "node", "n_turns", "n_out", "n_merged", "n_relabelled", "n_inserted", "cost", "rendered"], [pa.int64(), pa.bool_(), *[pa.int64()] * 7, pa.string()])

    way = way.withColumn("none", F.col("node") < 0).join(ends, ["conv", "none"]).withColumn("closes", F.col("node") == F.col("last")).drop("none", "last")
    out = _dealt(rows.join(way, ["conv", "node"]), "conv", "node", "_start")
    out = out.select("conv", "none", "node", "role", "text", "entry", "exit", "closes").mapInArrow(rendered, "conv long, none boolean, node long, n_turns long, n_out long, n_merged long, n_relabelled long, n_inserted long, cost long, rendered string")
    part = F.when(F.col("none"), F.col("node") + (1 << 50)).otherwise(F.col("node"))
    return out.select(F.when(~F.col("none"), F.col("conv")).alias("conv_id"), part.alias("part"), "n_turns", "n_out", "n_merged", "n_relabelled", "n_inserted", "cost", "rendered")


def joined(repaired: DataFrame) -> DataFrame:
    """``conv_id, n_turns, n_out, n_merged, n_relabelled, n_inserted, cost, rendered``: one row for each conversation of :func:`repair`.

    A whole conversation has to fit in one row; parts have no such bound.
    """
    counts = ("n_turns", "n_out", "n_merged", "n_relabelled", "n_inserted", "cost")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "rendered"))), lambda p: p["rendered"]), "")
    return repaired.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in counts], text.alias("rendered"))
