"""Secret scans: fixed patterns, and random strings exposed by their token efficiency.

Written words and names come out of a BPE vocabulary in long tokens; random strings fall into short
ones.  A candidate run of key characters with a low number of characters per token is taken as a
secret, after known digests and identifiers are excluded.
"""

import base64
import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Fixed base patterns; a match is kept from the given number of characters on (of group 2 for ASSIGN).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ASSIGN_LEAST = 8
# A run matches from its first possible place to its end, so a least length in the pattern drops exactly the short matches.
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "random")

#: Candidates of the token test: runs of key characters, from this many on.
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
RUN_LEAST = 20
#: Parts of a run between separators, long enough to be candidates of their own: a readable prefix does not hide a key.
PART = re.compile(r"(?<![A-Za-z0-9+])[A-Za-z0-9+]{20,}")
#: Characters per token up to which a candidate counts as random.
EFFICIENCY = 2.0
#: Characters that are encoded at once: the time of a merge grows faster than a run's length.
PIECE = 4096
#: Lengths in hex digits of known digests (MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512).
DIGESTS = (32, 40, 56, 64, 96, 128)
ALL_HEX = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)\Z")
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\Z")
#: Identifiers: parts of letters or of digits, joined by - _ / or = (names, paths, dates, numbered names).
IDENTIFIER = re.compile(r"[A-Za-z]*\d{0,6}(?:[-_/=+]+(?:[A-Za-z]+\d{0,6}|\d+))*[-_/=+]*\Z")

#: The pattern that splits text before the merges of the rank files (fixed value of the vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Scanner:
    """Finds the spans of one text; holds the vocabulary of one worker."""

    def __init__(self, ranks: bytes, efficiency=EFFICIENCY):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.encode = tiktoken.Encoding("scan", pat_str=PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self.efficiency = efficiency

    def tokens(self, run):
        return sum(len(self.encode(run[i : i + PIECE])) for i in range(0, len(run), PIECE))

    def is_random(self, run):
        """The token test of a candidate."""
        if run.isalpha():
            # Letters alone: only those of mixed case.
            return not (run.islower() or run.isupper()) and len(run) <= self.efficiency * self.tokens(run)
        if not (any(c.isdigit() for c in run) and any(c.isalpha() for c in run)):
            return False
        if UUID.match(run) or ALL_HEX.match(run) and len(run) in DIGESTS or IDENTIFIER.match(run):
            return False
        return len(run) <= self.efficiency * self.tokens(run)

    def base(self, text):
        """(start, kind index, end) of the base patterns, in code points."""
        found = []
        low = text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
        if any(k in low for k in ("passw", "secret", "token", "apikey", "api_key")):
            found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
        if "AKIA" in text:
            found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
        return found

    def scan(self, text):
        """All spans of a text as sorted (start, kind index, end)."""
        found = self.base(text)
        if any(len(w) >= RUN_LEAST for w in text.split()):
            found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
            taken = sorted((a, b) for a, _, b in found)
            ends = list(accumulate((b for _, b in taken), max))
            # A base span meets (x, y) if the furthest end of those that start before y lies beyond x.
            free = lambda x, y: not ((i := bisect_left(taken, (y,))) and ends[i - 1] > x)
            for m in RUN.finditer(text):
                if self.is_random(m[0]):
                    spans = [m.span()]
                else:
                    spans = [p.span() for p in PART.finditer(text, *m.span()) if p[0] != m[0] and self.is_random(p[0])]
                # Text that a base pattern holds already is not reported again.
                found += [(x, 3, y) for x, y in spans if free(x, y)]
        return sorted(found)


def _said(spans):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find(docs: DataFrame, ranks_path, doc_id="doc_id", text="text", efficiency=EFFICIENCY) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random`` for every row.

    Spans are ``kind:start:end`` by start, then kind, in code points with an exclusive end. A null or
    empty text has none (the digest is that of nothing). Every row, repeated or not, is scanned whole.
    """
    with open(ranks_path, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())  # bounded by the vocabulary

    def run(batches):
        scanner = Scanner(ranks.value, efficiency)
        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                spans = scanner.scan(t or "")
                kinds = [k for _, k, _ in spans]
                base = _said(x for x in spans if x[1] < 3)
                rows.append((kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(base.encode()).hexdigest(), _said(spans), kinds.count(3)))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long")


def mask(docs: DataFrame, ranks_path, text="text", n_chars="n_chars", efficiency=EFFICIENCY) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by ``[secret]`` (overlapping spans by one).

    Null stays null, an empty text empty; ``n_chars`` follows. Every row, repeated or not, stays and is masked by itself.
    """
    with open(ranks_path, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = Scanner(ranks.value, efficiency)
        for s in batches:
            yield s.map(lambda t: t if t is None else masked(t, scanner.scan(t)))

    out = docs.withColumn(text, run(F.col(text)))
    if n_chars in docs.columns:
        out = out.withColumn(n_chars, F.char_length(text).cast(docs.schema[n_chars].dataType))
    return out


def masked(text, spans, mark="[secret]"):
    out, here = [], 0
    for a, _, b in spans:
        if a >= here:
            out += [text[here:a], mark]
        here = max(here, b)
    return "".join([*out, text[here:]])
