"""Python functions hold a piece of a record batch at once, so a worker stays small for the stages that follow."""

import pytest

pa = pytest.importorskip("pyarrow")
common = pytest.importorskip("trackloom.llm.common")


class Taken:
    """Stands for a table; gives the function that would run in its tasks."""

    def __init__(self, spark):
        self.sparkSession = spark

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run


def batch(sizes):
    return pa.RecordBatch.from_arrays([pa.array(range(len(sizes)), pa.int64()), pa.array([None if n is None else f"word{n} " * (n // 8) for n in sizes], pa.string())], ["key", "text"])


def test_pieces_keep_all_rows_in_order():
    whole = [batch([80, None, 0, 800_000] * 9), batch([]), batch([5_000_000]), batch([8] * 3)]
    found = list(common.pieces(iter(whole), 1 << 20))
    assert pa.Table.from_batches(found).equals(pa.Table.from_batches(whole))
    assert max(b.num_rows for b in found) <= 5 and max(b.nbytes for b in found if b.num_rows > 1) < 3 << 20


@pytest.mark.parametrize("name", ["fingerprints", "sets", "signatures", "members", "round_trip"])
def test_no_function_holds_a_whole_batch(spark, name):
    import numpy as np

    from trackloom.llm import bpe, queries, ringsets, simhash

    table = Taken(spark)
    run = {
        "fingerprints": lambda: simhash.fingerprints(table),
        "sets": lambda: ringsets.sets(table),
        "signatures": lambda: ringsets.signatures(table),
        "members": lambda: ringsets.members(table, np.zeros(0, np.uint64)),
        "round_trip": lambda: bpe.round_trip(table, queries.tokenizer("byte_bpe_50k.json")),
    }[name]()
    rows = 2400
    texts = [" ".join(f"w{(i * 7 + j) % 977}" for j in range(400)) for i in range(rows)]
    whole = pa.RecordBatch.from_arrays([pa.array(range(rows), pa.int64()), pa.array(texts)], ["key", "text"])
    most = rows * common.PIECE_BYTES // whole.nbytes + 1
    held, keys = [], []
    for b in run(iter([whole])):
        own = b.column(1 if name == "members" else 0).to_pylist()
        held.append(len(set(own)))
        keys += own
    assert list(dict.fromkeys(keys)) == list(range(rows))
    assert max(held) <= most < rows
