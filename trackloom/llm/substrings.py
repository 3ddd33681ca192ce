"""Exact substring deduplication: bytes of windows that also start earlier are removed.

A radix sort of suffixes from the most significant digit on, cut off at the window length, whose equal
groups are the repeated windows. Suffixes that cannot share a group are thinned out before:

1. In each window the k-gram with the smallest hash is its anchor.  Equal windows have equal anchors at equal
   offsets, so windows can only meet under their anchor's k-gram.  Consecutive windows with one anchor
   form a run; the exchange by k-gram holds one row for each run, about 3 % of the bytes.  Runs
   whose k-gram occurs once end here; of runs with equal bytes all but the first repeat in full, and if
   a k-gram has only equal runs, the first one repeats nothing.
2. The other runs send their bytes. Their windows are sorted by digits of eight bytes, from the front and through
   byte ``window``: after each digit only windows that still share a group go on to the next (:func:`repeats`).
3. Of k-grams with more than ``TOGETHER`` different runs windows are dealt out first, by a hash of the window in place
   of its digits, so that no task gets all windows of a common k-gram.

Each task first resolves what repeats inside its own rows and sends at most ``SENT`` runs for a k-gram and
one row for a window hash, so a passage that a third of all documents share gives a group no larger
than the number of tasks.  k-grams, equal runs and dealt-out windows are told apart by two 64-bit hashes.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

WINDOW = 100
GRAM = 32
#: Runs with different bytes that a task sends for one k-gram; more go straight to the last pass.
SENT = 8
#: Bytes hashed at once, and bytes whose runs a task gathers before it resolves and sends them.
CHUNK = 2 << 20
GATHER = 48 << 20

_U = np.uint64
_rng = np.random.default_rng(20240229)
_TABLE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = int(_rng.integers(1 << 40, 1 << 62)) * 8 + 5
_INVERSE = pow(_BASE, -1, 1 << 64)
_C1, _C2 = _U(0xFF51AFD7ED558CCD), _U(0xC4CEB9FE1A85EC53)


def _mix(h):
    h = (h ^ (h >> _U(33))) * _C1
    h = (h ^ (h >> _U(29))) * _C2
    return h ^ (h >> _U(32))


class Hasher:
    """Hashes of any stretch of a byte array from prefix sums of a polynomial modulo 2**64."""

    def __init__(self):
        self.power = self.inverse = np.zeros(0, _U)

    def load(self, data):
        n = len(data)
        if len(self.power) < n + 1:
            self.power = np.multiply.accumulate(np.concatenate(([_U(1)], np.full(n, _BASE % (1 << 64), _U))))
            self.inverse = np.multiply.accumulate(np.concatenate(([_U(1)], np.full(n, _INVERSE, _U))))
        self.prefix = np.zeros(n + 1, _U)
        np.cumsum(_TABLE[data] * self.power[:n], out=self.prefix[1:])

    def stretch(self, start, end):
        return (self.prefix[end] - self.prefix[start]) * self.inverse[start]

    def all(self, k):
        n = len(self.prefix) - k
        return (self.prefix[k:] - self.prefix[:n]) * self.inverse[:n]


def runs(texts, hasher, window=WINDOW, gram=GRAM):
    """Runs of windows with one anchor: document index, first start, count, k-gram hash, hash of all bytes."""
    lengths = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(lengths) - lengths
    data = np.frombuffer(b"".join(texts), np.uint8)
    empty = np.zeros(0, np.int64)
    if len(data) < window:
        return empty, empty, empty, empty.view(_U), empty.view(_U)
    hasher.load(data)
    h = _mix(hasher.all(gram))
    least = (h & _U(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=_U)
    width, wide = 1, window - gram + 1
    while 2 * width <= wide:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if wide > width:
        least = np.minimum(least[: len(least) - (wide - width)], least[wide - width :])
    anchor = (least & _U(0xFFFFFFFF)).astype(np.int64)  # of the window that starts here
    doc = np.repeat(np.arange(len(texts)), lengths)
    valid = doc[: len(anchor)] == doc[window - 1 : window - 1 + len(anchor)]
    turn = np.ones(len(anchor) + 1, bool)
    turn[1:-1] = (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1])
    first = np.flatnonzero(turn[:-1] & valid)
    last = np.flatnonzero(turn[1:] & valid)
    at = anchor[first]
    count = last - first + 1
    whole = _mix(hasher.stretch(first, last + window) + count.astype(_U) * _C1 + (at - first).astype(_U) * _C2)
    return doc[first], first - begin[doc[first]], count, h[at], whole


#: Kinds of rows: a task's first run of its bytes (CANDIDATE, or HOT if the task has more than SENT
#: runs for the k-gram), windows that repeat for certain (DONE), and runs sent to the last pass (FINE).
CANDIDATE, HOT, DONE, FINE = 0, 1, 2, 3
#: Runs of one k-gram that are compared in one group by their bytes; beyond, window hashes are.
TOGETHER = 64

_RUN = pa.schema([("key", pa.int64()), ("span", pa.int64()), ("id", pa.int64()), ("pack", pa.int64())])
_WINDOWS = pa.schema([("key", pa.int64()), ("part", pa.int64()), ("id", pa.int64()), ("at", pa.int64()), ("n", pa.int64()), ("done", pa.bool_()), ("bytes", pa.binary())])
_FOUND = pa.schema([("id", pa.int64()), ("pack", pa.int64())])


def _pack(at, n, kind):
    """First start, number of windows and kind in one long, to be read as unsigned; texts are under 2 GB, so each fits in 31 bits."""
    return (np.asarray(at, np.int64) << 33) | (np.asarray(n, np.int64) << 2) | kind


def _unpack(pack):
    pack = np.asarray(pack, np.int64).view(_U)
    return (pack >> _U(33)).astype(np.int64), ((pack >> _U(2)) & _U(0x7FFFFFFF)).astype(np.int64), (pack & _U(3)).astype(np.int64)


def _new(*columns):
    """Where a row of sorted columns differs from the one before."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def _joined(ids, at, n):
    """Neighbouring stretches of windows of one document made one; the input is sorted by (id, at)."""
    if not len(ids):
        return ids, at, n
    new = _new(ids)
    new[1:] |= at[1:] != (at + n)[:-1]
    first = np.flatnonzero(new)
    return ids[first], at[first], np.add.reduceat(n, first)


def _resolve(ids, at, n, key, span, window):
    """Rows to exchange for one task's runs: what repeats here is DONE, the rest are candidates."""
    order = np.lexsort((at, ids, span, key))
    ids, at, n, key, span = (x[order] for x in (ids, at, n, key, span))
    new_key = _new(key)
    first = _new(key, span)
    group = np.cumsum(new_key) - 1
    rank = np.cumsum(first) - 1
    rank -= rank[np.flatnonzero(new_key)][group]  # of the run among the different ones of its k-gram
    hot = np.bincount(group, first)[group] > SENT
    kind = np.where(hot, HOT, CANDIDATE)
    kind[rank >= SENT] = FINE
    again = np.lexsort((at[~first], ids[~first]))
    done = _joined(ids[~first][again], at[~first][again], n[~first][again])
    # What needs no meeting with other rows is dealt out by its place.
    alone = _mix((done[0].astype(_U) * _C2) ^ done[1].astype(_U))
    fine = kind == FINE
    key = np.where(fine, _mix((ids.astype(_U) * _C2) ^ at.astype(_U)), key)
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key[first].view(np.int64), span[first].view(np.int64), ids[first], _pack(at, n, kind)[first])], schema=_RUN)
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (alone.view(np.int64), np.zeros(len(alone), np.int64), done[0], _pack(done[1], done[2], DONE))], schema=_RUN)


def _chunks(batches, size=None):
    """Lists of ids and texts as bytes, cut at about ``size`` bytes."""
    ids, texts, held = [], [], 0
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
            ids.append(i), texts.append(t or b"")
            held += len(texts[-1])
            if held >= (size or CHUNK):
                yield ids, texts
                ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def _first_pass(window, gram):
    def run(batches):
        hasher, kept, held = Hasher(), [], 0
        for ids, texts in _chunks(batches):
            doc, at, n, key, span = runs(texts, hasher, window, gram)
            kept.append((np.array(ids, np.int64)[doc], at, n, key, span))
            held += sum(map(len, texts))
            if held >= GATHER:
                yield from _resolve(*map(np.concatenate, zip(*kept, strict=True)), window)
                kept, held = [], 0
        if kept:
            yield from _resolve(*map(np.concatenate, zip(*kept, strict=True)), window)

    return run


def _cut_out(window, gram):
    """Rows for the last pass from documents and their runs: whole bytes (few runs share the k-gram) or window hashes."""

    def emit(rows, hasher):
        ids, at, n, kind, part = zip(*rows, strict=True)
        ids, at, n, kind = (np.array(x, np.int64) for x in (ids, at, n, kind))
        doc, _, count, key, _ = runs(part, hasher, window, gram)  # each stretch is one run
        assert len(doc) == len(part) and (count == n).all()
        few = np.flatnonzero(kind != FINE)
        yield pa.RecordBatch.from_arrays([pa.array(key[few].view(np.int64)), pa.array(np.zeros(len(few), np.int64)), pa.array(ids[few]), pa.array(at[few]), pa.array(n[few]), pa.array(np.zeros(len(few), bool)), pa.array([part[i] for i in few], pa.binary())], schema=_WINDOWS)
        many = np.flatnonzero(kind == FINE)
        if not len(many):
            return
        begin = np.cumsum([len(p) for p in part])
        row, j = np.repeat(many, n[many]), ragged_count(n[many])
        start = (begin - [len(p) for p in part])[row] + j
        part_hash = _mix(hasher.stretch(start, start + window))
        wid, wat, wkey = ids[row], at[row] + j, key[row]
        order = np.lexsort((wat, wid, part_hash, wkey))
        first = np.zeros(len(order), bool)
        first[order] = _new(wkey[order], part_hash[order])
        m = np.flatnonzero(first)
        yield pa.RecordBatch.from_arrays([pa.array(wkey[m].view(np.int64)), pa.array(part_hash[m].view(np.int64)), pa.array(wid[m]), pa.array(wat[m]), pa.array(np.ones(len(m), np.int64)), pa.array(np.zeros(len(m), bool)), pa.nulls(len(m), pa.binary())], schema=_WINDOWS)
        m = np.flatnonzero(~first)
        m = m[np.lexsort((wat[m], wid[m]))]
        did, dat, dn = _joined(wid[m], wat[m], np.ones(len(m), np.int64))
        alone = _mix((did.astype(_U) * _C2) ^ dat.astype(_U)).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(alone), pa.array(alone), pa.array(did), pa.array(dat), pa.array(dn), pa.array(np.ones(len(did), bool)), pa.nulls(len(did), pa.binary())], schema=_WINDOWS)

    def run(batches):
        hasher, rows, held = Hasher(), [], 0
        for b in batches:
            for i, t, packs in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), strict=True):
                at, n, kind = _unpack(packs)
                for a, c, k in zip(at.tolist(), n.tolist(), kind.tolist(), strict=True):
                    if k != DONE:
                        rows.append((i, a, c, k, t[a : a + c + window - 1]))
                        held += c + window
                if held >= CHUNK:
                    yield from emit(rows, hasher)
                    rows, held = [], 0
        if rows:
            yield from emit(rows, hasher)

    return run


def ragged_count(counts):
    """0, 1, ... for each count, one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


#: Bytes of a digit.
DIGIT = 8


def repeats(data, start, group, window):
    """Which suffixes (places ``start`` in ``data``, in the order that counts as earlier) have their first ``window`` bytes, within
    their ``group``, from an earlier one: a radix sort by digits from the front.

    After each digit the suffixes of one group lie together, ordered by the bytes so far; groups of one are done.
    """
    again = np.zeros(len(start), bool)
    # Every place's next eight bytes as a number that orders as they do; a last digit is cut to the window.
    padded = np.concatenate((data, np.zeros(DIGIT, np.uint8)))
    live = np.lexsort((np.arange(len(start)), group))
    at, label = start[live], group[live]
    for depth in range(0, window, DIGIT):
        wide = min(DIGIT, window - depth)
        digit = np.zeros(len(at), _U)
        for i in range(wide):
            digit = (digit << _U(8)) | padded[at + depth + i]
        order = np.lexsort((digit, label))  # stable: earlier ones stay first
        live, at, label, digit = live[order], at[order], label[order], digit[order]
        new = _new(label, digit)
        label = np.cumsum(new)
        several = np.bincount(label)[label] > 1
        live, at, label = live[several], at[several], label[several]
        if not len(live):
            return again
    again[live] = ~_new(label)
    return again


def _last_pass(window):
    """Windows that an earlier row of the sorted partition holds too, as ``id, pack``."""

    def few(ids, at, n, key, part):
        data = np.frombuffer(b"".join(part), np.uint8)
        size = np.array([len(p) for p in part], np.int64)
        row, j = np.repeat(np.arange(len(part)), n), ragged_count(n)
        start = (np.cumsum(size) - size)[row] + j
        m = np.flatnonzero(repeats(data, start, key[row], window))  # rows come in the order of documents and places
        m = m[np.lexsort((at[row[m]] + j[m], ids[row[m]]))]
        return _joined(ids[row[m]], at[row[m]] + j[m], np.ones(len(m), np.int64))

    def run(batches):
        held, seen = None, (None, None)
        for table in _with_end(batches):
            if table is None:
                blocks = [held] if held is not None and held.num_rows else []
                held = None
            else:
                table = pa.Table.from_batches([table])
                blocks = []
                done, bare = table["done"].to_numpy(), table["bytes"].is_null().to_numpy()
                key, part = table["key"].to_numpy(), table["part"].to_numpy()
                ids, at, n = (table[c].to_numpy() for c in ("id", "at", "n"))
                yield pa.RecordBatch.from_arrays([pa.array(ids[done]), pa.array(_pack(at[done], n[done], DONE))], schema=_FOUND)
                m = np.flatnonzero(bare & ~done)
                if len(m):
                    new = _new(key[m], part[m])
                    new[0] = (key[m[0]], part[m[0]]) != seen
                    seen = (key[m[-1]], part[m[-1]])
                    again = m[~new]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[again]), pa.array(_pack(at[again], n[again], DONE))], schema=_FOUND)
                whole = table.filter(pa.array(~bare))
                if whole.num_rows:
                    held = whole if held is None else pa.concat_tables([held, whole])
                    last = held["key"][held.num_rows - 1].as_py()
                    cut = int(np.searchsorted(held["key"].to_numpy(), last))
                    blocks, held = ([held.slice(0, cut)] if cut else []), held.slice(cut)
            for b in blocks:
                got = few(*(b[c].to_numpy() for c in ("id", "at", "n")), b["key"].to_numpy(), b["bytes"].to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(got[0]), pa.array(_pack(got[1], got[2], DONE))], schema=_FOUND)

    return run


def _with_end(batches):
    yield from batches
    yield None


def _remove(window):
    """Digest of each document without its repeated windows."""

    def run(batches):
        for b in batches:
            ids, size, gone, spans, digest = b.column(0), [], [], [], []
            for t, known, found in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                t = t or b""
                at, n, kind = _unpack((known or []) + (found or []))
                at, end = at[kind == DONE], (at + n + window - 1)[kind == DONE]
                kept, here, removed, count = [], 0, 0, 0
                if len(at):
                    order = np.argsort(at, kind="stable")
                    at, end = at[order], np.maximum.accumulate(end[order])
                    first = np.flatnonzero(np.concatenate(([True], at[1:] > end[:-1])))
                    for a, e in zip(at[first].tolist(), end[np.append(first[1:], len(at)) - 1].tolist(), strict=True):
                        kept.append(t[here:a])
                        here, removed, count = e, removed + e - a, count + 1
                kept.append(t[here:])
                size.append(len(t)), gone.append(removed), spans.append(count)
                digest.append(hashlib.sha256(b"".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([ids, pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string())], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def repeated_windows(docs: DataFrame, window=WINDOW, gram=GRAM) -> DataFrame:
    """First two digits: ``id, packs`` with the runs of each document that repeat or go on to the last pass."""
    rows = docs.mapInArrow(_first_pass(window, gram), "key long, span long, id long, pack long")
    flag, live = F.col("pack").bitwiseAND(F.lit(3)), F.col("pack").bitwiseAND(F.lit(3)) < DONE
    by_key = Window.partitionBy("key")
    order = Window.partitionBy("key", "span").orderBy((~live).cast("int"), "id", F.shiftrightunsigned("pack", 2))
    rows = rows.withColumns({
        "_hot": (F.max(F.when(live, flag)).over(by_key) == HOT) | (F.count(F.when(live, 1)).over(by_key) > TOGETHER),
        "_many": F.min(F.when(live, F.col("span"))).over(by_key) < F.max(F.when(live, F.col("span"))).over(by_key),
    }).withColumn("_rank", F.row_number().over(order))
    kind = F.when(~live, flag).when(F.col("_rank") > 1, DONE).when(F.col("_hot"), FINE).when(F.col("_many"), HOT).otherwise(CANDIDATE)
    rows = rows.withColumn("kind", kind).filter(F.col("kind") != CANDIDATE)
    pack = F.col("pack").bitwiseAND(F.lit(-4)).bitwiseOR(F.col("kind"))
    return rows.groupBy("id").agg(F.collect_list(pack).alias("packs"))


def deduplicate(docs: DataFrame, doc_id="doc_id", text="text", window=WINDOW, gram=GRAM) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row of ``docs``.

    A byte goes if a ``window``-byte string that covers it also starts earlier: in a document of smaller
    doc_id, or earlier in the same one. Null texts are empty; texts shorter than a window keep
    all. Rows that share a doc_id, or have none, count as documents of their own, a null id first and
    ties in the order of their texts.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    clash = docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null").limit(1).count()
    if clash:
        docs = common.running_start(docs, ["doc_id", "text"]).withColumnRenamed("_start", "id")
        names, docs = docs.select("id", "doc_id"), docs.select("id", "text")
    else:
        docs = docs.withColumnRenamed("doc_id", "id")
    docs = docs.filter("id is not null")  # holds; so said, both joins below share one exchange of the texts
    known = common.checkpoint(repeated_windows(docs, window, gram))
    dealt = docs.join(known.hint("shuffle_hash"), "id", "left")
    open_runs = docs.join(known.filter(F.exists("packs", lambda p: p.bitwiseAND(F.lit(3)) != DONE)).hint("shuffle_hash"), "id")
    windows = open_runs.select("id", "text", "packs").mapInArrow(_cut_out(window, gram), "key long, part long, id long, at long, n long, done boolean, bytes binary")
    windows = windows.repartition("key", "part").sortWithinPartitions("key", "part", "id", "at")
    found = windows.mapInArrow(_last_pass(window), "id long, pack long").groupBy("id").agg(F.collect_list("pack").alias("found"))
    out = dealt.join(found.hint("shuffle_hash"), "id", "left").select("id", "text", "packs", "found")
    out = out.mapInArrow(_remove(window), "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    if clash:
        return names.join(out, "id").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    return out.withColumnRenamed("id", "doc_id")
