"""From raw documents to token ids: quality rules, near-duplicates, secrets, source mix, encoding.

Each stage takes ``(spark, docs, sf_dir)`` and works on all documents its predecessor kept; all but the
last return the columns of ``documents``.
"""

from trackloom.llm import bpe, common, mixing, quality, secrets, simhash
from trackloom.llm.queries import tokenizer


def quality_rules(spark, docs, sf_dir):
    """Documents that the base rules and the risk-controlled cutoffs keep."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark, docs, sf_dir):
    """One document of each group of near-duplicates (five-word shingles, Jaccard similarity 0.8 or more)."""
    return simhash.keep_first(docs)


def secret_scans(spark, docs, sf_dir):
    """Documents with their secrets masked."""
    return secrets.mask(docs, tokenizer("byte_bpe_50k.tiktoken"))


def source_mix(spark, docs, sf_dir):
    """The words that the mix takes, a row for each pass over a document."""
    return mixing.take(docs)


def encode(spark, docs, sf_dir):
    """Token ids of every text, with digests of the ids and of the text they decode to."""
    return bpe.round_trip(docs, tokenizer("byte_bpe_50k.json"), with_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_duplicates),
    ("secret scans", secret_scans),
    ("source mix", source_mix),
    ("bpe", encode),
]

#: The stages use hashes and a tokenizer that SQL does not have.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``; each result is written to the checkpoint folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = common.checkpoint(docs)
    return docs
