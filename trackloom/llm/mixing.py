"""Mixing sources to target weights, in DataFrame expressions only.

Each source's words, documents in order of doc_id (ties by size and text), are packed into blocks of ``BLOCK`` words, the last one shorter.  A
source has as many slots as its target holds blocks; of the last slot's block only the words that the target
still lacks are taken.  Every slot draws an output shard, which gives each shard multinomial counts of the
sources under the condition that the sources' totals are exact.  A shard's slots of a source are
consecutive numbers; a pseudorandom permutation of the source's full blocks maps slot numbers to blocks (the short
one comes last), once through all blocks before any repeats, and the blocks are joined to the documents they
cover by index. What a document gives is summed up by shard.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Weights of the sources in code point order, repeating; share of all words to take; repeats allowed.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_REPEATS = 2
#: Words in a block.
BLOCK = 256
#: Output shards at least, slots in one at most (on average), and slots that one row of the draw expands to.
SHARDS = 8
SHARD_SLOTS = 65_536
DRAW = 4_096
SEED = 20240229
#: Steps that bring a permuted index back into range (see :func:`permuted`).
MOST_WALK = 32


def permuted(i: Column, n: Column, *seed) -> Column:
    """Image of 0 <= i < n under a pseudorandom permutation of 0 .. n-1.

    A Feistel network over pairs (left < a, right < b) with a = ceil(sqrt(n)) and b = ceil(n / a) permutes
    0 .. ab-1; images of n and above walk on until they fall below n. At most ab - n < a indices lie
    above, so that many steps suffice, and for large n MOST_WALK do but for a chance below n**-8, which raises.
    """
    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    b = F.ceil(n.cast("double") / a.cast("double")).cast("long")

    def network(x):
        def half(s, k):
            left = F.struct(F.pmod(s["l"] + F.pmod(F.xxhash64(s["r"], k, *seed), a), a).alias("l"), s["r"].alias("r"))
            right = F.struct(s["l"].alias("l"), F.pmod(s["r"] + F.pmod(F.xxhash64(s["l"], k, *seed), b), b).alias("r"))
            return F.when(k % 2 == 0, left).otherwise(right)

        start = F.struct(F.floor(x / b).cast("long").alias("l"), (x % b).alias("r"))
        end = F.aggregate(F.array(*[F.lit(k) for k in range(6)]), start, half)
        return common.let(end, lambda s: s["l"] * b + s["r"])

    def walk(x):
        steps = F.sequence(F.lit(1), F.least(F.greatest(a * b - n, F.lit(1)), F.lit(MOST_WALK)).cast("int"))
        return F.aggregate(steps, x, lambda y, _: F.when(y < n, y).otherwise(network(y)))

    found = common.let(network(i), lambda x: F.when(x < n, x).otherwise(walk(x)))
    return common.let(found, lambda x: F.when(x < n, x).otherwise(F.raise_error(F.lit("a permuted index stayed out of range")).cast("long")))


def targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST_REPEATS) -> DataFrame:
    """``source, source_size, target`` from one row for each source (``source, source_size``).

    Targets are in proportion to the weights until they reach ``most`` times the source; the excess is
    shared again by weight until none is above. Each round is one aggregate over the sources.
    """
    ranked = common.running_start(sizes.withColumn("_last", F.col("source").isNull().cast("int")), ["_last", "source"])
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_start") % len(weights) + 1).cast("int"))
    ranked = common.checkpoint(ranked.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * float(most)).alias("cap")))
    total = (ranked.agg(F.sum("source_size")).first()[0] or 0) * share
    level = 0.0  # words for each unit of weight, as far as a source's cap lets it
    while True:
        capped = F.col("cap") <= F.col("weight") * level
        spent, open_weight = ranked.agg(F.coalesce(F.sum(F.when(capped, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0.0))).first()
        new = (total - spent) / open_weight if open_weight else level
        if new <= level * (1 + 1e-12):
            break
        level = new
    return ranked.select("source", "source_size", F.least("cap", F.col("weight") * level).alias("target"))


def mix(docs: DataFrame, doc_id="doc_id", text="text", source="source", weights=WEIGHTS, share=SHARE, most=MOST_REPEATS, block=BLOCK, seed=SEED, shards=SHARDS, shard_slots=SHARD_SLOTS, keep=(), with_pieces=False, packed=False) -> DataFrame:
    """``doc_id, size, source_size, target, taken, shards`` (and the columns ``keep``) for every row.

    taken: words that the mix takes of the document, repeats counted; 0 to ``most`` times its size. ``shards``: how
    many of them each output shard drew, as sorted structs of shard and words. A null
    text has no words; null sources form one source, the last. Rows that repeat a doc_id are
    documents of their own. The same rows and seed give the same result, however they are dealt out: rows that share a doc_id are ordered
    by size and a 128-bit hash of the text. There are ``shards`` output shards, more if each would have over ``shard_slots`` slots. ``with_pieces`` adds the stretches of words taken, as structs of
    start, stop and layer (the first or the second time). ``packed`` returns the blocks themselves (see :func:`pack`).
    """
    rows = common.checkpoint(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.size(common.words(F.col(text))).cast("long").alias("size"), *common.text_hashes(F.coalesce(F.col(text), F.lit(""))), *[F.col(c) for c in keep]))
    rows = common.checkpoint(common.running_start(rows, ["doc_id", "size", *common.TEXT_HASHES], F.col("size"), by="source").drop(*common.TEXT_HASHES))
    plan = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    whole = lambda c: c.cast("long")
    plan = plan.withColumns({"full": whole(F.floor(F.col("source_size") / block)), "blocks": whole(F.ceil(F.col("source_size").cast("double") / block)), "_words": F.least(whole(F.round("target")), F.col("source_size") * most)})
    plan = plan.withColumns({"_passes": F.coalesce(whole(F.floor(F.try_divide("_words", "source_size"))), F.lit(0).cast("long"))}).withColumn("_rest", F.col("_words") - F.col("_passes") * F.col("source_size"))
    # The rest of a target: full blocks, the last one cut, or all of them and a part of the short one.
    last = F.least(whole(F.ceil(F.col("_rest").cast("double") / block)), F.col("blocks"))
    plan = plan.withColumn("_last", last).withColumns({"slots": F.col("_passes") * F.col("blocks") + F.col("_last"), "cut": F.when(F.col("_rest") > 0, F.col("_rest") - F.least(F.col("_last") - 1, F.col("full")) * block)})
    plan = common.checkpoint(plan.drop("_words", "_passes", "_rest", "_last"))
    every = plan.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    shards = max(shards, -(-every // shard_slots))
    # Lots are few small rows that grow to many: their number, not their size, says how to deal them out.
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, every // (64 * DRAW) + 1)

    # Slots draw their shards; what is kept of the draw is a count for each source and shard.
    lots = plan.filter("slots > 0").select("source", "slots", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / DRAW))).alias("lot"))
    lots = lots.repartition(tasks, "source", "lot")
    drawn = lots.select("source", F.explode(F.sequence(F.col("lot") * DRAW, F.least(F.col("slots"), (F.col("lot") + 1) * DRAW) - 1)).alias("draw"))
    counts = drawn.select("source", F.pmod(F.xxhash64(F.lit(seed), "source", "draw"), F.lit(shards)).alias("shard")).groupBy("source", "shard").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    held = Window.partitionBy("shard")
    ahead = held.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumns({"first": F.coalesce(F.sum("n").over(before), F.lit(0)), "ahead": F.coalesce(F.sum("n").over(ahead), F.lit(0)), "held": F.sum("n").over(held)})

    # A shard's slots, in lots again, and the blocks that they take, up to a word.
    named = common.small(plan.select(F.col("source").alias("_s"), "full", "blocks", "slots", "cut", "source_size"))
    lots = counts.select("source", "shard", "first", "ahead", "held", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / DRAW))).alias("lot")).repartition(tasks, "source", "first", "lot")
    slots = lots.select("source", "shard", "first", "ahead", "held", F.explode(F.sequence(F.col("first") + F.col("lot") * DRAW, F.col("first") + F.least(F.col("n"), (F.col("lot") + 1) * DRAW) - 1)).alias("slot"))
    slots = slots.join(named, F.col("source").eqNullSafe(F.col("_s")))
    # A shard's blocks of all sources are shuffled among its positions.
    position = permuted(F.col("ahead") + F.col("slot") - F.col("first"), F.col("held"), F.lit(seed), F.col("shard"))
    nth = F.pmod("slot", "blocks")
    hit = F.when(nth < F.col("full"), permuted(F.least(nth, F.col("full") - 1), F.greatest(F.col("full"), F.lit(1).cast("long")), F.lit(seed), F.col("source"))).otherwise(F.col("full"))
    upto = F.when((F.col("slot") == F.col("slots") - 1) & F.col("cut").isNotNull(), F.col("cut")).when(nth < F.col("full"), F.lit(block)).otherwise(F.col("source_size") - F.col("full") * block)
    hits = slots.select("source", "shard", position.alias("position"), hit.alias("hit"), whole(upto).alias("upto"))

    # Documents by the blocks that they reach into.
    rows = rows.join(common.small(plan.withColumnRenamed("source", "_s")), F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("_row", F.monotonically_increasing_id())
    rows = common.checkpoint(rows)
    parts = rows.filter("size > 0").select("_row", "doc_id", "source", "_start", "size", F.explode(F.sequence(F.floor(F.col("_start") / block), F.floor((F.col("_start") + F.col("size") - 1) / block))).alias("block"))
    start, stop = F.greatest(F.lit(0), F.col("block") * block - F.col("_start")), F.least(F.col("size"), (F.col("block") + 1) * block - F.col("_start"))
    parts = parts.select("_row", "doc_id", F.col("source").alias("_s"), "block", (F.col("_start") + start - F.col("block") * block).alias("at"), start.alias("start"), stop.alias("stop"))
    on = (F.col("block") == F.col("hit")) & F.col("source").eqNullSafe(F.col("_s"))
    if packed:
        held = parts.groupBy("_s", "block").agg(F.sort_array(F.collect_list(F.struct("at", "_row", "doc_id", "start", "stop"))).alias("pieces"))  # at most ``block`` words
        cut = F.transform(F.filter("pieces", lambda x: x["at"] < F.col("upto")), lambda x: F.struct(x["doc_id"].alias("doc_id"), x["start"].alias("start"), F.least(x["stop"], x["start"] + F.col("upto") - x["at"]).alias("stop")))
        return hits.join(held, on).select("shard", "position", "source", "block", cut.alias("pieces"))
    uses = hits.groupBy("source", "hit").agg(F.sort_array(F.collect_list(F.struct("upto", "shard")), False).alias("uses"))  # at most ``most`` of a block
    got = parts.join(uses, on).select("_row", "at", "start", "stop", F.posexplode("uses").alias("layer", "use"))
    got = got.withColumn("stop", F.least(F.col("stop"), F.col("start") + F.col("use.upto") - F.col("at"))).filter("stop > start")
    pieces = [F.collect_list(F.struct("start", "stop", (F.col("layer") + 1).alias("layer"))).alias("pieces")] if with_pieces else []
    got = got.groupBy("_row", F.col("use.shard").alias("shard")).agg(F.sum(F.col("stop") - F.col("start")).alias("words"), *pieces)
    got = got.groupBy("_row").agg(F.sum("words").alias("taken"), F.sort_array(F.collect_list(F.struct("shard", "words"))).alias("shards"), *[F.sort_array(F.flatten(F.collect_list("pieces"))).alias("pieces")] * with_pieces)
    out = rows.join(got, "_row", "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), F.coalesce("shards", F.array().cast("array<struct<shard:bigint,words:bigint>>")).alias("shards"), *keep, *["pieces"] * with_pieces)


def pack(docs: DataFrame, **options) -> DataFrame:
    """``shard, position, source, block, pieces``: the mix as blocks, a row for each slot, in the shard that it drew.

    Positions of a shard are 0 .. its slots - 1. ``pieces`` are the stretches of words (doc_id, start, stop) of a
    block in order. All blocks hold ``block`` words, but the last one of a source and the one that completes its target.
    Options are those of :func:`mix`, whose docstring says what becomes of nulls, ties and repeated rows.
    """
    return mix(docs, packed=True, **options)


def take(docs: DataFrame, doc_id="doc_id", text="text", source="source", n_chars="n_chars", **options) -> DataFrame:
    """The mixed documents, with the columns of ``docs``: a row for each pass over a document, its text the words taken in that pass.

    The first pass holds the words that are taken at all, the second those taken twice. White space
    before a word stays with it. Documents of which nothing is taken, such as those without words, are gone; ``n_chars``
    follows the text. Repeated rows are documents of their own; rows without a doc_id come first in their source.
    """
    key = common.fresh(docs, "_key")
    rows = common.keyed(docs, key, doc_id, text).select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.col(source).alias("_source"), F.struct(*docs.columns).alias("_row"))
    plan = mix(rows, "_key", "_text", "_source", with_pieces=True, **options).filter("taken > 0").select(F.col("doc_id").alias("_key"), F.col("pieces").alias("_pieces"))
    words = F.regexp_extract_all(F.col("_text"), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    passes = F.sequence(F.lit(1), F.array_max(F.transform("_pieces", lambda p: p["layer"])))
    rows = rows.join(plan.select("_key", "_pieces", F.explode(passes).alias("_pass")), "_key")
    pieces = F.filter("_pieces", lambda p: p["layer"] == F.col("_pass"))
    cut = common.let(words, lambda w: F.flatten(F.transform(pieces, lambda p: F.slice(w, (p["start"] + 1).cast("int"), (p["stop"] - p["start"]).cast("int")))))
    rows = rows.select("_row", F.ltrim(F.array_join(cut, "")).alias("_text"))
    length = F.char_length("_text")
    made = {text: F.col("_text")} | ({n_chars: length.cast(docs.schema[n_chars].dataType)} if n_chars in docs.columns else {})
    return rows.select(*[made.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
