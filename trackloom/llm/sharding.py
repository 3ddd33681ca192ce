"""Sharding by jump consistent hashing, in DataFrame expressions only.

The law is ``key``: the key and the shard count decide the shard, and one more shard takes rows only
into itself.  No ring table exists; the jumps follow a 64-bit linear congruential generator, kept in
three limbs (22, 22 and 20 bits) because SQL arithmetic raises on overflow.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Fixed multiplier of the published generator; the increment is 1.
MULTIPLIER = 2862933555777941757
SHARDS = 8
#: Jumps that are tried. The number of jumps for n shards is about ln(n) + Poisson noise, so this bound
#: is out of reach; a key beyond it raises.
MOST_JUMPS = 128
_LIMB, _TOP = (1 << 22) - 1, (1 << 20) - 1


def _limbs(x: Column):
    return x.bitwiseAND(F.lit(_LIMB)), F.shiftrightunsigned(x, 22).bitwiseAND(F.lit(_LIMB)), F.shiftrightunsigned(x, 44)


def jump_hash(key: Column, shards: int) -> Column:
    """Shard 0 .. shards-1 of a 64-bit key, as int. A null key is taken as key 0."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    m0, m1, m2 = MULTIPLIER & _LIMB, MULTIPLIER >> 22 & _LIMB, MULTIPLIER >> 44
    long = lambda v: F.lit(v).cast("long")
    k0, k1, k2 = _limbs(F.coalesce(key.cast("long"), long(0)))

    def step(s, _):
        p0 = s["k0"] * m0 + 1
        p1 = s["k0"] * m1 + s["k1"] * m0 + F.shiftrightunsigned(p0, 22)
        p2 = s["k0"] * m2 + s["k1"] * m1 + s["k2"] * m0 + F.shiftrightunsigned(p1, 22)
        n0, n1, n2 = p0.bitwiseAND(long(_LIMB)), p1.bitwiseAND(long(_LIMB)), p2.bitwiseAND(long(_TOP))
        high = F.shiftleft(n2, 11).bitwiseOR(F.shiftrightunsigned(n1, 11))  # the state's upper 31 bits
        jump = F.floor((s["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / (high + 1).cast("double"))).cast("long")
        moved = F.struct(s["j"].alias("b"), jump.alias("j"), n0.alias("k0"), n1.alias("k1"), n2.alias("k2"))
        return F.when(s["j"] < shards, moved).otherwise(s)

    start = F.struct(long(-1).alias("b"), long(0).alias("j"), k0.alias("k0"), k1.alias("k1"), k2.alias("k2"))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(min(shards, MOST_JUMPS))), start, step)
    return F.when(end["j"] >= shards, end["b"]).otherwise(F.raise_error(F.lit("more jumps than MOST_JUMPS"))).cast("int")


def shard(docs: DataFrame, shards=SHARDS, doc_id="doc_id", text="text") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row.

    size: UTF-8 bytes of the text plus 1; a null text has no bytes, size 1 and the CRC of nothing, 0.
    slot: gapless from 0 in each shard, by doc_id, then size, CRC and a 128-bit hash of the text, so rows that share a doc_id have the same slots
    however they are dealt out; equal rows take slots of their own. A null doc_id is sharded as key 0 and comes first in its
    shard. Only these few columns are exchanged, no text.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        jump_hash(F.col(doc_id), shards).alias("shard"),
        jump_hash(F.col(doc_id), shards + 1).alias("grown_shard"),
        *common.text_hashes(body),
    )
    return common.running_start(common.checkpoint(rows), ["doc_id", "size", "text_crc32", *common.TEXT_HASHES], by="shard").select("doc_id", "size", "text_crc32", "law", "shard", F.col("_start").alias("slot"), "grown_shard")
