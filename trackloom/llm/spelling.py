"""Spelling variants: words one edit apart, found through an index of grams of variable length.

1. Words are counted, and all grams of ``SHORT`` to ``LONG`` symbols of the different words (with ``^`` before and ``$`` after). Only frequent
   grams make the dictionary; there are at most ``FREQUENT`` of a length, as the bound is a share of all places.
2. From each place of a word starts one gram: the shortest one that is not frequent, the word's last symbol or ``LONG`` symbols ending it
   at the latest. So a gram follows from its own symbols alone, and a word that has the symbols has the gram.
3. An edit at one place affects the grams that cover it. The largest number of different grams over one code point of a word bounds
   how many of its grams a near word can lack; call it its bound. Ordered from rare to frequent, the first ``bound + 1`` grams of two near words
   have one in common, so only these short lists are merged. (As words have seven code points or more, and grams at most five symbols, the
   first or the last gram survives any edit: near words do share grams.)
4. Two words of a list whose common gram is not touched differ either after it, then all up to its end is equal, or before it. Within a
   list words are therefore set side by side by that equal part, and matched by the rest with one code point wiped out or left out;
   what matches is verified. The work is linear in the list, whatever it holds.
5. A list of more than ``LISTED`` words is not kept together but dealt out by its words with one code point wiped or left out, so a gram
   that very many words have is no task's burden; a group then holds no more words than there are letters and places.

Words of more than ``LENGTHY`` code points have more grams than are worth listing: of two near ones the first or the second half of the shorter one is
equal, which is their list; inside of it they are matched by pieces.
"""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Code points of the shortest word.
LEAST = 7
#: Symbols of the shortest and longest gram.
SHORT, LONG = 3, 5
#: Grams of a length that are frequent at most, and places that a frequent gram has at least.
FREQUENT, PLACES = 20_000, 16
#: Words in a frequent gram's list; more are dealt out. Other lists hold one in ``FREQUENT`` of all places at most.
LISTED = 2000
#: Code points of a word that is listed by its grams at most, and of a piece of a longer one.
LENGTHY, PIECE = 64, 8
#: Different words or grams that a task counts before it sends them on.
HELD = 200_000

def _counted(counts, first, second):
    return pa.RecordBatch.from_arrays([pa.array(list(counts.keys()), pa.string()), pa.array(list(counts.values()), pa.int64())], [first, second])


def _count_words(spoil, least):
    pattern = re.compile(f"[a-zÀ-ÿ]{{{least},}}")

    def run(batches):
        total = Counter()
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if not text:
                    continue
                found = Counter(pattern.findall(text.lower().decode(errors="replace")))  # bytes lower A-Z only
                if spoil and doc_id is not None:
                    for word in list(found):
                        h = zlib.crc32(f"{doc_id}:{word}".encode())
                        if h % spoil == 0:
                            n, k = found.pop(word), h % len(word)
                            if len(word) > least:
                                total[word[:k] + word[k + 1 :]] += n
                total.update(found)
                if len(total) >= HELD:
                    yield _counted(total, "word", "n")
                    total = Counter()
        if total:
            yield _counted(total, "word", "n")

    return run


def vocabulary(docs: DataFrame, doc_id="doc_id", text="text", spoil=None, least=LEAST, occurrences=2) -> DataFrame:
    """``word, n``: words of ``least`` code points or more that occur ``occurrences`` times in all texts.

    A word is a maximal run of ``A-Z``, ``a-z`` and U+00C0 to U+00FF; A-Z are lower-cased. With ``spoil`` a word of a document loses the code point
    ``h % length`` if ``h``, the CRC-32 of ``doc_id:word``, is a multiple of ``spoil`` (a row without doc_id loses none). Null texts have no words.
    """
    slim = docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string"))
    counts = slim.mapInArrow(_count_words(spoil, least), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= occurrences)


def _count_grams(short, long):
    def run(batches):
        total = Counter()
        for b in batches:
            for word in b.column(0).to_pylist():
                w = f"^{word}$"
                for size in range(short, long + 1):
                    total.update(w[p : p + size] for p in range(len(w) - size + 1))
                if len(total) >= HELD:
                    yield _counted(total, "gram", "places")
                    total = Counter()
        if total:
            yield _counted(total, "gram", "places")

    return run


def dictionary(words: DataFrame, short=SHORT, long=LONG, frequent=FREQUENT, places=PLACES) -> dict:
    """Frequent grams and their numbers of places: more than ``places``, and so many that at most ``frequent`` grams of a length have them."""
    total = words.agg(F.sum(F.length("word") + 2)).first()[0] or 0
    counts = words.select("word").mapInArrow(_count_grams(short, long), "gram string, places long").groupBy("gram").agg(F.sum("places").alias("places"))
    return dict(counts.filter(F.col("places") > max(places, total // frequent)).collect())


def grams(word, frequent, short=SHORT, long=LONG):
    """``gram, start`` from each place of ``^word$``."""
    w = f"^{word}$"
    out = []
    for p in range(len(w) - short + 1):
        end = p + short
        while end < len(w) and end - p < long and w[p:end] in frequent:
            end += 1
        out.append((w[p:end], p))
    return out


def rare_grams(word, frequent, short=SHORT, long=LONG):
    """The grams of which two near words share one: the rarest ones, one more than an edit can affect; with their first starts."""
    first, cover = {}, [set() for _ in range(len(word) + 2)]
    for g, p in grams(word, frequent, short, long):
        first.setdefault(g, p)
        for i in range(p, p + len(g)):
            cover[i].add(g)
    bound = max(map(len, cover[1:-1]))
    order = sorted(first, key=lambda g: (frequent.get(g, 0), zlib.crc32(g.encode()), g))
    return [(g, first[g]) for g in order[: bound + 1]]


def _halves(word):
    """Lists of a long word: for the length of the shorter one of a pair, its own or one less, the digest of either half."""
    names = set()
    for m in (len(word), len(word) - 1):
        if m >= LENGTHY:
            for side, half in (("<", word[: m // 2]), (">", word[len(word) - m // 2 :])):
                names.add(f"{side}{m}:{hashlib.blake2b(half.encode(), digest_size=16).hexdigest()}")
    return names


def _index(frequent, short, long, listed):
    """Rows ``list, word, n``: a word under its rare grams, or under its forms with one code point changed where a list is too long."""
    known = frequent

    def run(batches):
        frequent = known.value
        for b in batches:
            lists, words, counts = [], [], []
            for word, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rare = rare_grams(word, frequent, short, long) if len(word) <= LENGTHY else []
                names = {g for g, _ in rare if frequent.get(g, 0) <= listed} | _halves(word)
                if any(frequent.get(g, 0) > listed for g, _ in rare):  # the same forms serve all of a word's long lists
                    names |= {word[:i] + "?" + word[i + 1 :] for i in range(len(word))} | {"-" + word[:i] + word[i + 1 :] for i in range(len(word))} | {"-" + word}
                lists.extend(names), words.extend([word] * len(names)), counts.extend([n] * len(names))
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.string()), pa.array(words, pa.string()), pa.array(counts, pa.int64())], ["list", "word", "n"])

    return run


def near(a, b):
    """Whether two words differ by exactly one inserted, deleted or replaced code point."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i, most = 0, min(len(a), len(b))
    while i < most and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def _matches(words, gram, short, long, frequent):
    """Pairs of places in ``words``, all of which have ``gram``, that are near with the gram untouched."""
    sides = defaultdict(list)
    for k, word in enumerate(words):
        w = f"^{word}$"
        for g, p in grams(word, frequent, short, long):
            if g == gram:
                end = p + len(g)
                sides[(True, w[:end])].append((w[end:], k))
                sides[(False, w[p:])].append((w[:p], k))
    return _one_edit(sides)


def _one_edit(sides):
    """Pairs of places whose rests, under one of the equal parts that are the keys of ``sides``, match with one code point wiped or left out."""
    found = set()
    for rests in sides.values():
        if len(rests) < 2:
            continue
        wiped, whole = defaultdict(list), defaultdict(list)
        for rest, k in rests:
            whole[rest].append(k)
            for i in range(len(rest)):
                wiped[(i, rest[:i], rest[i + 1 :])].append(k)
        for some in wiped.values():
            if len(some) > 1:
                found.update(combinations(sorted(some), 2))
        for rest, k in rests:
            for i in range(len(rest)):
                found.update((min(k, j), max(k, j)) for j in whole.get(rest[:i] + rest[i + 1 :], ()))
    return found


def _long_matches(words, m):
    """Pairs of places in ``words``, of ``m`` or ``m + 1`` code points, that are equal but for one piece and near inside of it."""

    def digests(parts):
        h = hashlib.blake2b(digest_size=16)
        out = [h.digest()]
        for part in parts:
            h.update(part.encode("utf-32-le"))
            out.append(h.copy().digest())
        return out

    sides = defaultdict(list)
    pieces = m // PIECE
    for k, word in enumerate(words):
        over = len(word) - m
        before = digests(word[PIECE * j : PIECE * (j + 1)] for j in range(pieces - 1))
        # Piece j ends where the shorter word's does, counted from the end; the last one takes what is left.
        ends = [PIECE * (j + 1) + over for j in range(pieces - 1)] + [len(word)]
        after = digests(word[a:b][::-1] for a, b in zip(ends[-2::-1], ends[:0:-1], strict=True))[::-1]
        for j in range(pieces):
            sides[(j, before[j], after[j])].append((word[PIECE * j : ends[j]], k))
    return _one_edit(sides)


def _merge(frequent, short, long):
    """Verified pairs of the lists of a partition sorted by list."""
    known = frequent

    def pairs(name, words, counts):
        if len(words) < 2:
            return
        if "?" in name or name[0] == "-":
            some = combinations(range(len(words)), 2) if "?" in name else ((i, j) for i in [k for k, w in enumerate(words) if w == name[1:]] for j in range(len(words)) if j != i)
        elif name[0] in "<>":
            some = _long_matches(words, int(name[1:].split(":")[0]))
        else:
            some = _matches(words, name, short, long, known.value)
        for i, j in some:
            if near(words[i], words[j]):
                yield words[i], counts[i], words[j], counts[j]

    def run(batches):
        name, words, counts, out = None, [], [], []

        def sent():
            a, m, b, n = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(m, pa.int64()), pa.array(b, pa.string()), pa.array(n, pa.int64())], ["word", "n", "other", "other_n"])

        for b in batches:
            for key, word, n in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if key != name:
                    out.extend(pairs(name, words, counts))
                    if len(out) >= 20_000:
                        yield sent()
                        out = []
                    name, words, counts = key, [], []
                words.append(word), counts.append(n)
        out.extend(pairs(name, words, counts))
        if out:
            yield sent()

    return run


def near_pairs(words: DataFrame, short=SHORT, long=LONG, listed=LISTED, frequent=FREQUENT, places=PLACES) -> DataFrame:
    """``word, n, other, other_n``, a row for each pair of ``words`` (``word, n``; different words of 7 letters or more) that are one edit apart.

    Of a word's many near words none is left out: with 90 letters a word of ``m`` code points has at most ``90 * (2 * m + 1)``.
    """
    if not short <= long <= LEAST - 2:
        raise ValueError("grams are shorter by two than the shortest word, so that the first and the last one share no letter")
    # The dictionary is bounded by its construction: ``frequent`` grams of each length.
    known = words.sparkSession.sparkContext.broadcast(dictionary(words, short, long, frequent, places))
    lists = words.select("word", "n").mapInArrow(_index(known, short, long, listed), "list string, word string, n long")
    lists = lists.repartition("list").sortWithinPartitions("list")
    return lists.mapInArrow(_merge(known, short, long), "word string, n long, other string, other_n long").select(
        F.least("word", "other").alias("word"), F.when(F.col("word") < F.col("other"), F.col("n")).otherwise(F.col("other_n")).alias("n"),
        F.greatest("word", "other").alias("other"), F.when(F.col("word") < F.col("other"), F.col("other_n")).otherwise(F.col("n")).alias("other_n"),
    ).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """``word, form, root``: the end of each chain ``word -> form``; chains have no cycles. Each round follows chains twice as far."""
    reached = common.checkpoint(forms.select("word", "form", F.col("form").alias("root")))
    while True:
        up = reached.select(F.col("word").alias("root"), F.col("root").alias("above"))
        longer = common.checkpoint(reached.join(up, "root", "left").select("word", "form", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")))
        reached = longer.drop("moved")
        if not longer.filter("moved").limit(1).count():
            return reached


def group(words: DataFrame, times=10, **settings) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every row of ``words`` (``word, n``; see :func:`vocabulary`).

    ``n_near`` counts the words one edit away. ``form`` is the most frequent of them (ties: the first in code-point order) if it occurs at least ``times`` as
    often as the word, else null; ``root`` is where forms lead to in the end, the word itself without one.
    """
    words = common.checkpoint(words.select("word", "n"))
    pairs = common.checkpoint(near_pairs(words, **settings))
    both = pairs.unionAll(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("down"), F.col("other").alias("form"))).alias("best"))
    rows = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.col("best.form").alias("form"), (-F.col("best.down")).alias("form_n"))
    fits = F.col("form_n") >= times * F.col("n")
    rows = common.checkpoint(rows.withColumns({"form": F.when(fits, F.col("form")), "form_n": F.when(fits, F.col("form_n"))}))
    ends = roots(rows.filter("form is not null")).select("word", "root")
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
