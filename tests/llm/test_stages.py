"""Pipeline stages on empty tables, clashing columns, ties and very long texts; the whole pipeline against plain replays."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

pytest.importorskip("trackloom.llm.queries")
import corpus_pipeline as pipeline  # noqa: E402
from trackloom.llm import bpe, common, licenses, mixing, quality, queries, secrets, sharding, simhash, substrings  # noqa: E402

SMALL = "/root/testdata/sf0.001"
CLASH = ["_key", "_row", "_text", "_stratum", "key", "row", "size", "taken", "component_id", "fp", "_start", "kept"]


@pytest.fixture(scope="module")
def odd(spark):
    """Documents whose other columns are named like the operators' own, with ties and repeated and null rows."""
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").limit(40).collect()]
    rows += [(7, "tie " * 30, "en", "src0", 120)] * 3 + [(None, None, None, None, None), (None, "some words of a row without an id " * 4, "de", None, 9), (900, "", "en", "src0", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    return df.withColumns({c: F.lit(i) for i, c in enumerate(CLASH)})


@pytest.mark.parametrize("name, stage", pipeline.STAGES[:-1])
def test_stages_keep_columns_and_take_empty_tables(spark, odd, name, stage):
    out = stage(spark, odd, SMALL)
    assert out.columns == odd.columns
    rows = out.collect()
    assert rows and all([r[c] for c in CLASH] == list(range(len(CLASH))) for r in rows)
    nothing = stage(spark, odd.filter("doc_id < 0"), SMALL)
    assert nothing.columns == odd.columns and nothing.count() == 0
    assert not [c for c in stage(spark, odd.select("doc_id", "text", "lang", "source"), SMALL).columns if c.startswith("_")]


def test_the_last_stage_takes_an_empty_table(spark, odd):
    assert pipeline.encode(spark, odd.filter("doc_id < 0"), SMALL).count() == 0


def test_every_stage_does_what_its_query_says(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    key = lambda df: collections.Counter((r.doc_id, r.text) for r in df.collect())
    kept = {r.doc_id for r in quality.assess(docs, spark.read.parquet(f"{SMALL}/labels.parquet")).filter("kept").collect()}
    good = common.checkpoint(pipeline.quality_rules(spark, docs, SMALL))
    assert key(good) == key(docs.filter(F.col("doc_id").isin(list(kept))))
    first = common.checkpoint(pipeline.near_duplicates(spark, good, SMALL))
    shingles = {}
    for r in good.collect():
        w = (r.text or "").encode().lower().split()
        shingles[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in shingles}
    near = [(a, b) for a in shingles for b in shingles if a < b and 5 * len(shingles[a] & shingles[b]) >= 4 * len(shingles[a] | shingles[b])]
    while any(label[a] != label[b] for a, b in near):
        for a, b in near:
            label[a] = label[b] = min(label[a], label[b])
    assert {r.doc_id for r in first.collect()} == set(label.values())
    masked = common.checkpoint(pipeline.secret_scans(spark, first, SMALL))
    text = {r.doc_id: r.text for r in first.collect()}
    spans = {r.doc_id: r.spans for r in secrets.find(first, queries.tokenizer("byte_bpe_50k.tiktoken")).collect()}
    for r in masked.collect():
        want, here = "", 0
        for _, a, b in sorted((int(a), int(a), int(b)) for _, a, b in (s.split(":") for s in spans[r.doc_id].split(",") if s)):
            if a >= here:
                want += text[r.doc_id][here:a] + "[secret]"
            here = max(here, b)
        assert r.text == want + text[r.doc_id][here:] and r.n_chars == len(r.text)
    mixed = common.checkpoint(pipeline.source_mix(spark, masked, SMALL))
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    taken = collections.Counter()
    for r in mixed.collect():
        taken[r.doc_id] += words(r.text)
    assert taken == collections.Counter({r.doc_id: r.taken for r in mixing.mix(masked).collect() if r.taken})


def test_very_long_texts(spark):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choices("etaoinshrdlu", k=rng.randrange(2, 9))) for _ in range(5000)]
    long = " ".join(rng.choices(vocabulary, k=500_000))
    rows = [(1, long), (2, "x" * 2_000_000), (3, long[:1000] + " " + "ab " * 200_000), (4, "short text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s")})
    want = {i: len(t.split()) for i, t in rows}
    assert {r.doc_id: r.n_words for r in licenses.scan(docs).collect()} == want
    assert {r.doc_id: r.size for r in mixing.mix(docs).collect()} == want
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r.doc_id: (r.n_words, r.base_failed) for r in quality.assess(docs, labels).collect()} == {1: (want[1], False), 2: (1, True), 3: (want[3], True), 4: (2, True)}
    assert simhash.near_duplicates(docs).count() == 4 and simhash.keep_first(docs).count() == 4
    assert {r.doc_id: r.size for r in sharding.shard(docs).collect()} == {i: len(t) + 1 for i, t in rows}
    gone = {r.doc_id: r.n_removed for r in substrings.deduplicate(docs).collect()}
    assert gone[1] == 0 and gone[2] == 2_000_000 - 1 and gone[4] == 0 and gone[3] >= 599_000
    assert sum(r.n_random + r.n_assign for r in secrets.find(docs, queries.tokenizer("byte_bpe_50k.tiktoken")).collect()) == 0
    back = bpe.decode(bpe.encode(docs.filter("doc_id <> 2"), queries.tokenizer("byte_bpe_50k.json")), queries.tokenizer("byte_bpe_50k.json"))
    assert all(r.text == r.decoded for r in back.collect())
