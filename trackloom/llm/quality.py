"""Quality rules with risk-controlled thresholds, in DataFrame expressions only.

Features of every text come from one pass.  Cutoffs are learned from labelled documents, a stratum
at a time: a fifth of a stratum's labelled documents proposes levels, each with a cutoff for some of the rules (the same
high quantile of its good documents, times a factor, plus a margin); the others, the holdout, test them.  A document falls at a level if any
rule rejects it there, and what is tested is this joint verdict: a level is certified if the exact binomial
probability of so few false rejections among the holdout's good documents, were the true rate
``risk``, is at most ``delta`` divided by the number of strata (Bonferroni).  Within a stratum levels are tested in fixed
sequence, the loosest first and until one fails, which needs no further correction. The first levels leave out the rules whose values have
heavy tails, of which few documents say little.  So with probability 1 - delta all certified strata reject at most a share ``risk`` of
their good documents.

All labelled documents together are one more stratum, with its share of ``delta``. Its cutoffs hold for strata that have labelled good
documents but certify no level of their own, mostly for want of documents (with 228 in the holdout and none rejected the first level of
five strata passes). For those the bound is on good documents of all strata taken together, not on each of them.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 8
#: Limit of a stratum's false-rejection rate, and of the chance that any stratum exceeds it.
RISK = 0.02
DELTA = 0.05
#: Levels, in the order of the tests: the share of the proposing good documents that each rule's cutoff keeps, a factor on that cutoff and a
#: margin added to it (a cutoff of zero has no other way to loosen), and how many of the rules take part.
LEVELS = (
    (1.0, 3.0, 0.1, 3), (1.0, 2.0, 0.05, 3), (1.0, 2.0, 0.05, 4), (1.0, 1.5, 0.02, 4), (1.0, 2.0, 0.05, 5), (1.0, 1.5, 0.02, 5), (1.0, 1.2, 0.01, 5),
    (1.0, 1.0, 0.0, 5), (0.999, 1.0, 0.0, 5), (0.998, 1.0, 0.0, 5), (0.996, 1.0, 0.0, 5), (0.993, 1.0, 0.0, 5), (0.99, 1.0, 0.0, 5), (0.985, 1.0, 0.0, 5), (0.98, 1.0, 0.0, 5),
)
#: One in so many labelled documents proposes.
PROPOSING = 5
#: Rules: a value above the cutoff is rejected. Those with heavy tails come last.
RULES = {
    "symbols": "try_divide(n_symbols, word_chars)",
    "long_words": "try_divide(word_chars, n_words)",
    "short_words": "try_divide(n_words, word_chars)",
    "duplicate_lines": "try_divide(n_dup_lines, n_words)",
    "repeats": "try_divide(n_repeat_words, n_words)",
}
#: More strata than this are joined by a shuffle instead of a broadcast.
BROADCAST_STRATA = 10_000


def _repeated_words(words, n=WINDOW):
    """Words inside n-word windows that occur twice or more in the array."""

    def windows(h):
        return F.slice(h, 1, F.size(h) - (n - 1))

    def pairwise(h, gap):
        return F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + gap)))

    def covered(h):
        marked = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def places(s):
            again = F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]))
            return F.array_sort(F.transform(again, lambda x: x["i"]))

        def total(p):
            return F.aggregate(F.transform(p, lambda x, i: F.when(i == 0, n).otherwise(F.least(F.lit(n), x - F.get(p, i - 1)))), F.lit(0).cast("long"), lambda a, x: a + x)

        return common.let(common.let(marked, places), total)

    def counted(h):
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h))

    if n != 8:
        raise ValueError("windows of eight words are built by doubling")
    one = F.transform(words, lambda w: F.xxhash64(w))
    eight = common.let(common.let(common.let(one, lambda h: pairwise(h, 1)), lambda h: pairwise(h, 2)), lambda h: pairwise(h, 4))
    return F.when(F.size(words) < n, F.lit(0).cast("long")).otherwise(common.let(common.let(eight, windows), counted))


def features(docs: DataFrame, doc_id="doc_id", text="text", keep=()) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed`` and the columns ``keep``."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), *[F.col(c) for c in keep], body.alias("_text"))
    lines = F.transform(F.filter(F.split("_text", "\n"), lambda l: F.btrim(l, F.lit(common.SPACES)) != ""), lambda l: F.xxhash64(l))
    symbols = (F.char_length("_text") - F.char_length(F.regexp_replace("_text", r"[#*$%&|<>]", ""))).cast("long")
    duplicates = common.let(lines, lambda l: (F.size(l) - F.size(F.array_distinct(l))).cast("long"))
    facts = common.let(
        common.words(F.col("_text")),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeated_words(w).alias("n_repeat_words")),
    )
    # Exploding an array of one struct keeps later filters and projections from computing the features again.
    every = common.let(facts, lambda f: F.struct(f["n_words"].alias("n_words"), f["word_chars"].alias("word_chars"), symbols.alias("n_symbols"), duplicates.alias("n_dup_lines"), f["n_repeat_words"].alias("n_repeat_words")))
    rows = rows.select("doc_id", *keep, F.explode(F.array(every)).alias("_facts")).select("doc_id", *keep, "_facts.*")
    return rows.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def log_binomial_cdf(x, n, p):
    """Logarithm of P(X <= x) for X ~ Binomial(n, p) and x <= n p, summed exactly from its largest term."""

    def step(s, k):
        back = k.cast("double") * (1 - p) / ((n - k + 1).cast("double") * p)  # term k - 1 over term k
        return F.struct((s["c"] + F.ln((n - k + 1).cast("double") / k.cast("double"))).alias("c"), (1 + s["s"] * back).alias("s"))

    start = F.struct(F.lit(0.0).alias("c"), F.lit(1.0).alias("s"))
    s = F.aggregate(F.when(x >= 1, F.sequence(F.lit(1).cast("long"), x)).otherwise(F.array().cast("array<bigint>")), start, step)
    return s["c"] + x * F.log(F.lit(p)) + (n - x) * F.log(F.lit(1 - p)) + F.ln(s["s"])


def certify(labelled: DataFrame, stratum: str, risk=RISK, delta=DELTA) -> DataFrame:
    """``stratum, rule, cutoff, pooled`` from labelled rows (features, ``good``, ``holdout``); one row for each rule and stratum at most.

    ``pooled``: the cutoffs are those of all strata together, as the stratum certifies none of its own.
    """
    good = labelled.filter("good = 1").select(stratum, "holdout", F.array(*[F.expr(e) for e in RULES.values()]).alias("values"))
    # Every document stands in its own stratum and in that of all documents.
    own, pooled = F.struct(F.lit(False).alias("all"), F.col(stratum).alias("name")), F.struct(F.lit(True).alias("all"), F.lit(None).cast(good.schema[stratum].dataType).alias("name"))
    good = common.checkpoint(good.select("holdout", "values", F.explode(F.array(own, pooled)).alias("_p")))
    quantiles = [F.percentile_approx(F.get("values", F.lit(i)), [level[0] for level in LEVELS], 10_000) for i in range(len(RULES))]
    proposed = good.filter("not holdout").groupBy("_p").agg(F.array(*quantiles).alias("cuts"))
    levels = F.array(*[F.struct(F.lit(factor).alias("factor"), F.lit(margin).alias("margin"), F.lit(rules).alias("rules")) for _, factor, margin, rules in LEVELS])
    loosened = F.transform("cuts", lambda c, i: F.zip_with(c, levels, lambda x, l: F.when(i < l["rules"], x * l["factor"] + l["margin"])))
    proposed = common.checkpoint(proposed.withColumn("cuts", loosened))
    strata = max(proposed.count(), 1)
    held = good.filter("holdout").join(common.small(proposed, BROADCAST_STRATA), "_p")

    def falls(level):
        above = F.zip_with("values", "cuts", lambda v, c: F.coalesce(v > F.get(c, F.lit(level)), F.lit(False)))
        return F.exists(above, lambda x: x)

    seen = held.groupBy("_p").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.count_if(falls(i)) for i in range(len(LEVELS))]).alias("fallen"))
    # Beyond x = n risk the probability is about a half or more, never within delta.
    passes = F.transform("fallen", lambda x: F.when(x <= F.col("n") * risk, log_binomial_cdf(F.least(x, F.floor(F.col("n") * risk)), F.col("n"), risk) <= F.log(F.lit(delta / strata))).otherwise(False))
    seen = seen.select("_p", F.array_position(F.concat(passes, F.array(F.lit(False))), F.lit(False)).cast("int").alias("_stop")).filter("_stop > 1")
    chosen = proposed.join(seen, "_p").select("_p", F.transform("cuts", lambda c: F.get(c, F.col("_stop") - 2)).alias("cut"))
    chosen = common.checkpoint(chosen)
    fallback = chosen.filter("_p.all").agg(F.max("cut").alias("_all"))  # one row
    named = good.filter("not _p.all").select("_p").distinct().join(chosen, "_p", "left").crossJoin(F.broadcast(fallback))
    cut = F.explode(F.arrays_zip(F.array(*map(F.lit, RULES)).alias("rule"), F.coalesce("cut", "_all").alias("cutoff")))
    named = named.select(F.col("_p.name").alias(stratum), F.col("cut").isNull().alias("pooled"), cut.alias("r"))
    return named.select(stratum, F.col("r.rule").alias("rule"), F.col("r.cutoff").alias("cutoff"), "pooled").filter("cutoff is not null")


def assess(docs: DataFrame, labels: DataFrame, doc_id="doc_id", text="text", stratum="lang", risk=RISK, delta=DELTA) -> DataFrame:
    """Features of every row, ``base_failed`` and ``kept``.

    A row is kept unless the base rules fail it or one of its values lies above its stratum's
    certified cutoffs. Null texts are empty (and fail, having no words); null strata form one stratum;
    values without a denominator pass. Of several labels for a doc_id the worst counts; rows
    that repeat a doc_id are judged alike but each by its own text. Without labels, or for a stratum without labelled good documents,
    only the base rules hold.
    """
    rows = common.checkpoint(features(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(stratum).alias("_stratum")), keep=["_stratum"]))
    return judge(rows, learn(rows, labels, risk, delta)).drop("_stratum")


def learn(rows: DataFrame, labels: DataFrame, risk=RISK, delta=DELTA) -> DataFrame:
    """``_s, _cut``: each stratum's certified cutoffs as a map by rule, from features (with ``_stratum``) and labels."""
    marks = labels.filter("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("good"))
    labelled = rows.join(marks, "doc_id").withColumn("holdout", F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 8), 16, 10).cast("long") % PROPOSING > 0)
    cutoffs = common.checkpoint(certify(labelled, "_stratum", risk, delta).groupBy("_stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("_cut")))
    return common.small(cutoffs.withColumnRenamed("_stratum", "_s"), BROADCAST_STRATA)


def judge(rows: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Feature rows with the verdict ``kept``."""
    rows = rows.join(cutoffs, F.col("_stratum").eqNullSafe(F.col("_s")), "left")
    out = F.lit(False)
    for rule, value in RULES.items():
        out = out | F.coalesce(F.expr(value) > F.try_element_at("_cut", F.lit(rule)), F.lit(False))
    return rows.withColumn("kept", ~F.col("base_failed") & ~out).drop("_s", "_cut")


def keep_good(docs: DataFrame, labels: DataFrame, doc_id="doc_id", text="text", stratum="lang", risk=RISK, delta=DELTA) -> DataFrame:
    """``docs`` without the rows that :func:`assess` rejects, all columns as they are.

    Features are computed once; texts stay where they are while the rejected rows are few enough for a broadcast. Nulls, ties,
    repeated rows and an empty table are taken as in :func:`assess`.
    """
    key = common.fresh(docs, "_key")
    rows = common.keyed(docs, key, doc_id, text)
    facts = common.checkpoint(features(rows.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(stratum).alias("_stratum"), F.col(key).alias("_key")), keep=["_stratum", "_key"]))
    gone = common.checkpoint(judge(facts, learn(facts, labels, risk, delta)).filter("not kept").select(F.col("_key").alias(key)))
    return rows.join(common.small(gone), key, "left_anti").drop(key)
