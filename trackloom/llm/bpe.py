"""Byte-level BPE by batched numpy merge rounds.

The symbols of many different words lie in one flat array.  A round looks every adjacent pair up by
binary search in the sorted pair keys, takes each word's pair of lowest rank, leftmost first, and
merges it in all words at once; words without a mergeable pair drop out.  A document's ids are
then gathered word by word from the merged table.
"""

import hashlib
import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Classes of the splitting pattern (contractions, letters, numbers, the rest, white space) for
#: characters up to U+024F; texts with others are split by the library's own pre-tokenizer, whose
#: Unicode tables decide. Fixed values of the byte-level vocabulary.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
NUMBERS = "0-9²³¹¼½¾"
WHITE = "\t-\r \x85\xa0"
PATTERN = f" ?[{LETTERS}]+|'(?:[stmd]|re|ve|ll)| ?[{NUMBERS}]+| ?[^{WHITE}{LETTERS}{NUMBERS}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
BEYOND = "[^\x00-ɏ]"
#: Words whose merges a worker remembers at most, and words merged at once.
CACHE_WORDS = 500_000
BATCH_WORDS = 50_000


def byte_alphabet():
    """The printable character that stands for each byte: itself, or the next one from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, free = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in table:
            table[b] = chr(free)
            free += 1
    return table


def load_tables(path):
    """Arrays that drive the merges, from a tokenizer file; they are bounded by the vocabulary."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, added = spec["model"]["vocab"], {t["content"]: t["id"] for t in spec["added_tokens"]}
    char = byte_alphabet()
    back = {c: b for b, c in char.items()}
    merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    left = np.array([vocab[a] for a, _ in merges], np.int64)
    right = np.array([vocab[b] for _, b in merges], np.int64)
    merged = np.array([vocab[a + b] for a, b in merges], np.int64)
    keys = left << 32 | right
    order = np.argsort(keys, kind="stable")
    size = max(max(vocab.values()), max(added.values(), default=0)) + 1
    pieces = [b""] * size
    for token, i in (vocab | added).items():
        pieces[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
    return {"bytes": np.array([vocab[char[b]] for b in range(256)], np.int64), "keys": keys[order], "rank": order, "merged": merged[order], "pieces": pieces, "added": added, "path": str(path)}


def merge_words(words: list[bytes], t) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all words in one array, and the number of each word's tokens."""
    flat = t["bytes"][np.frombuffer(b"".join(words), np.uint8)]
    lengths = np.array([len(w) for w in words], np.int64)
    word = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(flat))
    none = len(t["keys"])
    # For each symbol: the pair it starts, as index into the sorted keys, and that pair's rank.
    at, rank = np.zeros(len(flat), np.int64), np.full(len(flat), none)

    def look_up(i):
        i = i[i < len(flat) - 1]
        rank[i] = none
        i = i[word[i] == word[i + 1]]
        pair = flat[i] << 32 | flat[i + 1]
        found = np.searchsorted(t["keys"], pair)
        found[found == none] = 0
        at[i] = found
        rank[i] = np.where(t["keys"][found] == pair, t["rank"][found], none)

    look_up(np.arange(len(flat)))
    out_ids, out_word, out_place = [], [], []
    while len(flat):
        first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        lowest = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(flat))))
        done = lowest == none
        if done.any():
            out_ids.append(flat[done]), out_word.append(word[done]), out_place.append(place[done])
        # In a run of overlapping equal pairs, every second one from its start merges.
        i = np.flatnonzero((rank == lowest) & ~done)
        if len(i):
            fresh = np.concatenate(([True], np.diff(i) > 1))
            i = i[(i - np.maximum.accumulate(np.where(fresh, i, 0))) % 2 == 0]
            flat[i] = t["merged"][at[i]]
        keep = ~done
        keep[i + 1] = False
        moved = (np.cumsum(keep) - 1)[i]
        flat, word, place, at, rank = flat[keep], word[keep], place[keep], at[keep], rank[keep]
        if len(flat):
            rank[-1] = none
        changed = np.zeros(len(flat) + 1, bool)  # the last entry takes the place before the first
        changed[moved] = changed[moved - 1] = True
        look_up(np.flatnonzero(changed[:-1]))
    if not out_ids:
        return np.zeros(0, np.int64), lengths
    ids, word, place = np.concatenate(out_ids), np.concatenate(out_word), np.concatenate(out_place)
    return ids[np.argsort(place, kind="stable")], np.bincount(word, minlength=len(words))


def ragged(starts, counts):
    """Indices start, start + 1, ... of each (start, count), one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


class _Numbers(dict):
    """Numbers words in the order in which they are met."""

    def __missing__(self, word):
        n = self[word] = len(self)
        return n


class Codec:
    """Encoder and decoder of one worker; remembers the merges of words it has met."""

    def __init__(self, tables):
        self.t = tables
        self.split, self.beyond = re.compile(PATTERN).findall, re.compile(BEYOND).search
        self.special = re.compile("(" + "|".join(re.escape(x) for x in sorted(tables["added"], key=len, reverse=True)) + ")") if tables["added"] else None
        self.piece_bytes = np.frombuffer(b"".join(tables["pieces"]), np.uint8)
        self.piece_len = np.array([len(p) for p in tables["pieces"]], np.int64)
        self.piece_start = np.cumsum(self.piece_len) - self.piece_len
        self.clear()

    def clear(self):
        self.known, self.learned = _Numbers(), 0
        self.ids, self.start, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def split_words(self, text):
        if not self.beyond(text):
            return self.split(text)
        from tokenizers import pre_tokenizers

        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        return [text[a:b] for _, (a, b) in level.pre_tokenize_str(text)]

    def numbers(self, text):
        """Word numbers of a text; an added token's is -1 - id."""
        number, added = self.known.__getitem__, self.t["added"]
        if not any(x in text for x in added):
            found = self.split_words(text)
            return np.fromiter(map(number, found), np.int64, len(found))
        out = []
        for part in self.special.split(text):
            out += [-1 - added[part]] if part in added else map(number, self.split_words(part))
        return np.array(out, np.int64)

    def learn(self):
        """Merge the words met since the last call."""
        fresh = [w.encode() for w in itertools.islice(self.known, self.learned, None)]
        self.learned = len(self.known)
        for i in range(0, len(fresh), BATCH_WORDS):
            ids, counts = merge_words(fresh[i : i + BATCH_WORDS], self.t)
            starts = len(self.ids) + np.cumsum(counts) - counts
            self.ids, self.start, self.count = np.concatenate((self.ids, ids)), np.concatenate((self.start, starts)), np.concatenate((self.count, counts))

    def encode_batch(self, texts):
        """One array of ids for each text."""
        if len(self.known) > CACHE_WORDS:
            self.clear()
        numbers = [self.numbers(t or "") for t in texts]
        self.learn()
        out = []
        for n in numbers:
            if len(n) and n.min() < 0:
                parts = [np.array([-1 - x]) if x < 0 else self.ids[self.start[x] : self.start[x] + self.count[x]] for x in n.tolist()]
                out.append(np.concatenate(parts))
            else:
                out.append(self.ids[ragged(self.start[n], self.count[n])])
        return out

    def decode_bytes(self, ids):
        """Bytes that the ids stand for; invalid UTF-8 becomes U+FFFD as in the library."""
        raw = self.piece_bytes[ragged(self.piece_start[ids], self.piece_len[ids])].tobytes()
        return raw.decode("utf-8", "replace").encode()


#: Texts of one batch; merges of their new words are done together.
CHARS_AT_ONCE = 4_000_000


def _groups(texts):
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= CHARS_AT_ONCE:
            yield texts[at : i + 1]
            at, size = i + 1, 0
    if at < len(texts):
        yield texts[at:]


def _shared_tables(spark, path):
    return spark.sparkContext.broadcast(load_tables(path))


def encode(docs: DataFrame, path, text="text", ids="ids") -> DataFrame:
    """``docs`` with an array<int> column of token ids; a null text gives an empty array."""
    tables = _shared_tables(docs.sparkSession, path)

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = Codec(tables.value)
        for s in batches:
            yield pd.Series([x.astype(np.int32) for g in _groups(s.tolist()) for x in codec.encode_batch(g)], dtype=object)

    return docs.withColumn(ids, run(F.col(text)))


def decode(rows: DataFrame, path, ids="ids", text="decoded") -> DataFrame:
    """``rows`` with the text that a column of ids stands for; null ids give an empty text."""
    tables = _shared_tables(rows.sparkSession, path)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = Codec(tables.value)
        for s in batches:
            yield pd.Series([codec.decode_bytes(np.asarray([] if x is None else x, np.int64)).decode() for x in s])

    return rows.withColumn(text, run(F.col(ids)))


def round_trip(docs: DataFrame, path, doc_id="doc_id", text="text", with_ids=False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` (and ``ids``): encodes each text and decodes the ids again.

    One pass without an exchange. Each row, repeated or not, gets a row. A null text counts as empty:
    no tokens, digests of nothing.
    """
    tables = _shared_tables(docs.sparkSession, path)
    kinds = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()} | ({"ids": pa.list_(pa.int32())} if with_ids else {})

    def run(batches):
        codec = Codec(tables.value)
        for b in common.pieces(batches):
            rows = []
            for g in _groups(b.column(1).to_pylist()):
                for ids in codec.encode_batch(g):
                    rows.append((len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(codec.decode_bytes(ids)).hexdigest(), *[ids.astype(np.int32)] * with_ids))
            columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)]], ["doc_id", *kinds])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)
