"""Blocks of the mix in their output shards."""

import collections
import math
import struct

import pytest
import xxhash

mixing = pytest.importorskip("trackloom.llm.mixing")
from trackloom.llm import sharding  # noqa: E402


def test_blocks_carry_the_shards_that_their_slots_drew(spark):
    options = {"shards": 1, "shard_slots": 8, "block": 16}
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i * 7 % 90)), ("a", "b", None)[i % 3]) for i in range(120)], "doc_id long, text string, source string").repartition(4)
    size = {r.doc_id: r.size for r in mixing.mix(docs, **options).collect()}
    found = {s: mixing.pack(docs, seed=s, **options).collect() for s in (1, 2)}
    for seed, rows in found.items():
        held = collections.defaultdict(list)
        taken = collections.Counter()
        for r in rows:
            held[r.shard].append(r.position)
            for p in r.pieces:
                assert 0 <= p.start < p.stop <= size[p.doc_id]
                taken[p.doc_id] += p.stop - p.start
        assert len(held) > 1 and all(sorted(v) == list(range(len(v))) for v in held.values())
        assert taken == collections.Counter({r.doc_id: r.taken for r in mixing.mix(docs, seed=seed, **options).collect() if r.taken})
        # The query's shards are those of the blocks; taken words follow from them, document by document.
        by_shard = collections.Counter()
        for r in rows:
            for p in r.pieces:
                by_shard[p.doc_id, r.shard] += p.stop - p.start
        mixed = mixing.mix(docs, seed=seed, **options).collect()
        assert by_shard == collections.Counter({(r.doc_id, x.shard): x.words for r in mixed for x in r.shards})
        assert all(r.taken == sum(x.words for x in r.shards) for r in mixed)
    other = mixing.mix(docs, **options | {"shard_slots": 20}).collect()
    first = mixing.mix(docs, **options).collect()
    assert {r.doc_id: r.target for r in other} == {r.doc_id: r.target for r in first}
    assert {r.doc_id: r.shards for r in other} != {r.doc_id: r.shards for r in first}
    draw = {s: collections.Counter((r.shard, r.source) for r in rows) for s, rows in found.items()}
    assert draw[1] != draw[2]


def hashed(*values):
    """Spark's xxhash64 of longs, ints (given as ``(x,)``) and strings; nulls are passed over."""
    seed = 42
    for v in values:
        if v is not None:
            seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<i", v[0]) if isinstance(v, tuple) else struct.pack("<q", v), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def permuted(i, n, *seed):
    a = math.isqrt(n - 1) + 1
    b = -(-n // a)
    while True:
        left, right = divmod(i, b)
        for k in range(6):
            if k % 2 == 0:
                left = (left + hashed(right, (k,), *seed) % a) % a
            else:
                right = (right + hashed(left, (k,), *seed) % b) % b
        i = left * b + right
        if i < n:
            return i


def replay(rows, weights=(3, 1, 2), share=1.5, most=2, block=256, shards=8):
    """``(doc_id, text): words by shard`` for each row, in plain Python: water level, blocks, draw, permutation and cut."""
    sources = collections.defaultdict(list)
    for doc_id, text, source in rows:
        n, body = len((text or "").split()), text or ""
        sources[source].append(((doc_id is not None, doc_id), n, hashed((0,), body), hashed((1,), body), text))
    names = sorted(sources, key=lambda s: (s is None, s))
    size = {s: sum(r[1] for r in sources[s]) for s in names}
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, open_ones, left = {}, set(names), share * sum(size.values())
    while open_ones:
        level = left / sum(weight[s] for s in open_ones)
        full = {s for s in open_ones if most * size[s] <= weight[s] * level}
        if not full:
            target |= {s: weight[s] * level for s in open_ones}
            break
        target |= {s: most * size[s] for s in full}
        left, open_ones = left - sum(target[s] for s in full), open_ones - full
    plan, every = {}, 0
    for s in names:
        words = min(math.floor(target[s] + 0.5), most * size[s])
        passes, rest = divmod(words, size[s]) if size[s] else (0, 0)
        full, blocks = size[s] // block, -(-size[s] // block)
        last = min(-(-rest // block), blocks)
        plan[s] = full, blocks, passes * blocks + last, rest - min(last - 1, full) * block if rest else None
        every += plan[s][2]
    out = collections.Counter()
    seed = (mixing.SEED,)
    for s in names:
        full, blocks, slots, cut = plan[s]
        draw = sorted(hashed(seed, s, k) % shards for k in range(slots))
        stretches, here = [], 0
        for key, n, *_, text in sorted(sources[s]):
            stretches.append((here, here + n, key[1], text))
            here += n
        for slot, shard in enumerate(draw):
            nth = slot % blocks
            hit = permuted(nth, full, seed, s) if nth < full else full
            upto = cut if slot == slots - 1 and cut is not None else block if nth < full else size[s] - full * block
            for a, b, doc_id, text in stretches:
                words = min(b, hit * block + upto) - max(a, hit * block)
                if words > 0:
                    out[doc_id, text, shard] += words
    return out


def tied_rows():
    rows = [(i % 40 if i % 11 else None, " ".join(f"w{j}" for j in range(i * 37 % 190)), ("a", "b", None, "d")[i % 4]) for i in range(160)]
    return rows + [(5, None, "a"), (5, "", "b"), (None, "one two", None)]


def test_the_mix_is_a_plain_replay_of_draw_permutation_and_cut(spark):
    rows = tied_rows()
    for block in (16, 256):
        text = spark.createDataFrame([(*r, r[1]) for r in rows], "doc_id long, text string, source string, own string").repartition(4)
        got = collections.Counter()
        for r in mixing.mix(text, block=block, keep=["own"]).collect():
            for x in r.shards:
                got[r.doc_id, r.own, x.shard] += x.words
        want = replay(rows, block=block)
        assert got == want and len({k[2] for k in want}) == 8


def test_ties_in_doc_id_do_not_depend_on_the_layout(spark):
    found = []
    for parts in (1, 3, 7):
        docs = spark.createDataFrame(tied_rows(), "doc_id long, text string, source string").coalesce(1).repartition(parts)
        mixed = collections.Counter((r.doc_id, r.size, r.taken, str(r.shards)) for r in mixing.mix(docs).collect())
        sharded = collections.Counter(tuple(r) for r in sharding.shard(docs).collect())
        packed = collections.Counter((r.shard, r.position, r.source, r.block, str(r.pieces)) for r in mixing.pack(docs, block=16).collect())
        found.append((mixed, sharded, packed))
    assert found[0] == found[1] == found[2]
