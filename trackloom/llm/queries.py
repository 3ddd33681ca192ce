"""Queries of the training-data operators over the given tables."""

import os
import re

import public_tokenizers
from pyspark.sql import functions as F

from . import bpe, chat, licenses, mixing, periodic, quality, secrets, sharding, simhash, spelling, substrings, topk, vectors


def tokenizer(name):
    """Path of a public tokenizer file: in the folder TOKENIZER_DIR if it is set, else where its package keeps it. Files are never copied."""
    folder = os.environ.get("TOKENIZER_DIR")
    return f"{folder}/{name}" if folder else public_tokenizers.path(name)



def _read(spark, sf_dir, table):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_simhash_dedup(spark, sf_dir):
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op2_sharding(spark, sf_dir):
    return sharding.shard(_read(spark, sf_dir, "documents"))


def op3_substring_dedup(spark, sf_dir):
    return substrings.deduplicate(_read(spark, sf_dir, "documents"))


def op4_chat_repair(spark, sf_dir):
    return chat.repair(_read(spark, sf_dir, "conversations"))


def op5_bpe(spark, sf_dir):
    return bpe.round_trip(_read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op6_quality(spark, sf_dir):
    return quality.assess(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op7_secrets(spark, sf_dir):
    return secrets.find(_read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"))


def op8_topk(spark, sf_dir):
    return topk.search(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_licenses(spark, sf_dir):
    return licenses.scan(_read(spark, sf_dir, "documents"))


def op10_mixing(spark, sf_dir):
    return mixing.mix(_read(spark, sf_dir, "documents"))


def op11_periodic_runs(spark, sf_dir):
    found = periodic.find(periodic.planted(_read(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "n_words")


def op12_embedding_near_dedup(spark, sf_dir):
    return vectors.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op13_spelling_variants(spark, sf_dir):
    return spelling.group(spelling.vocabulary(_read(spark, sf_dir, "documents"), spoil=31))


def queries():
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}


def _license_sql():
    """Diagonal voting by strings and self-joins, over the same fixed templates."""
    words = [(label, re.findall("[a-z0-9]+", text.lower())) for label, text in licenses.TEMPLATES]
    k = licenses.GRAM
    table = ", ".join(f"({t}, '{label}', {len(w) - k + 1}, {i}, '{' '.join(w[i : i + k])}')" for t, (label, w) in enumerate(words) for i in range(len(w) - k + 1))
    phrase = " UNION ALL ".join(f"SELECT doc_id, i - 1 AS pos, '{label}' AS label FROM x WHERE {' AND '.join(f'w{j} = {chr(39)}{v}{chr(39)}' for j, v in enumerate(text.split()))}" for text, label in licenses.PHRASES)
    order = lambda s: f"({s}.share, {s}.size, -{s}.start, -{s}.stop, -{s}.template)"
    return f"""
        WITH t(template, label, size, place, g) AS (VALUES {table}),
        d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
        x AS (SELECT doc_id, i, w[i] AS w0, w[i+1] AS w1, w[i+2] AS w2, w[i+3] AS w3 FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
        b AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS base FROM ({phrase}) GROUP BY doc_id),
        h AS (SELECT doc_id, template, label, size, place, i - 1 AS pos, i - 1 - place AS diagonal FROM x JOIN t ON concat_ws(' ', w0, w1, w2) = g AND w2 IS NOT NULL),
        c AS (SELECT DISTINCT doc_id, template, diagonal FROM h),
        s AS (SELECT DISTINCT doc_id, template, label, size, share, start, stop FROM (SELECT c.doc_id, c.template, c.diagonal, label, size, count(DISTINCT place) / size AS share, min(pos) AS start, max(pos) + {k} AS stop
              FROM c JOIN h ON h.doc_id = c.doc_id AND h.template = c.template AND h.diagonal BETWEEN c.diagonal - {licenses.NEAR} AND c.diagonal + {licenses.NEAR} GROUP BY c.doc_id, c.template, c.diagonal, label, size)),
        v AS (SELECT doc_id, list(DISTINCT label) AS more FROM s WHERE share >= {licenses.LEAST} AND NOT EXISTS (SELECT 1 FROM s o WHERE o.doc_id = s.doc_id AND o.share >= {licenses.LEAST} AND o.start < s.stop AND o.stop > s.start AND {order("o")} > {order("s")}) GROUP BY doc_id),
        m AS (SELECT doc_id, max(share) AS score FROM s GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, first_word, last_word, array_to_string(list_sort(coalesce(base, [])), ',') AS base_labels,
               array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(more, [])))), ',') AS labels, coalesce(score, 0.0) AS score
        FROM d LEFT JOIN b USING (doc_id) LEFT JOIN v USING (doc_id) LEFT JOIN m USING (doc_id)"""


def _quality_sql():
    """Features, levels and exact binomial tests; the cutoffs of a level are the values at its rank among the proposing good documents."""
    levels, rules = ", ".join(f"({i}, {keep}, {factor}, {margin}, {n})" for i, (keep, factor, margin, n) in enumerate(quality.LEVELS, 1)), len(quality.RULES)
    word = "[^\\x20\\x09-\\x0D]"
    ratio = lambda a, b: f"CASE WHEN {b} <> 0 THEN {a} / {b} END"
    values = ", ".join(ratio(*e.removeprefix("try_divide(").removesuffix(")").split(", ")) for e in quality.RULES.values())
    return f"""
        WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '{word}+') AS w FROM documents),
        y AS (SELECT doc_id, unnest(w) AS y, unnest(range(1, len(w) + 1)) AS i FROM d WHERE len(w) >= {quality.WINDOW}),
        i AS (SELECT doc_id, i, concat_ws(' ', {", ".join(f"lead(y, {j}) OVER u" for j in range(quality.WINDOW))}) AS y, lead(i, {quality.WINDOW - 1}) OVER u AS stop FROM y WINDOW u AS (PARTITION BY doc_id ORDER BY i)),
        r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, y) AS n FROM i WHERE stop IS NOT NULL) WHERE n > 1),
        c AS (SELECT doc_id, sum(gap) AS n FROM (SELECT doc_id, least({quality.WINDOW}, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i), {quality.WINDOW})) AS gap FROM r) GROUP BY doc_id),
        l AS (SELECT doc_id, list_filter(string_split(x, chr(10)), lambda y: regexp_matches(y, '{word}')) AS l FROM d),
        f AS (SELECT doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
              CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words FROM d JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)),
        v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, [{values}] AS v FROM f),
        q AS (SELECT doc_id, min(quality) AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
        m AS (SELECT coalesce('of ' || lang, 'none') AS s, v, CAST(concat('0x', substr(md5(CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) % {quality.PROPOSING} > 0 AS holdout FROM v JOIN q USING (doc_id) WHERE good = 1),
        g AS (SELECT * FROM m UNION ALL SELECT 'all', v, holdout FROM m),
        o AS (SELECT s, k, list_sort(list(v[k])) AS o FROM g, range(1, {rules + 1}) t(k) WHERE NOT holdout AND v[k] IS NOT NULL GROUP BY s, k),
        p AS (SELECT s, k, level, o[CAST(greatest(1, ceil(keep * len(o))) AS BIGINT)] * factor + margin AS cut FROM o JOIN (VALUES {levels}) l(level, keep, factor, margin, active) ON k <= active),
        h AS (SELECT row_number() OVER () AS id, s, v FROM g WHERE holdout),
        e AS (SELECT id, h.s, level, max(CASE WHEN v[k] > cut THEN 1 ELSE 0 END) AS falls FROM h JOIN p ON h.s = p.s GROUP BY ALL),
        n AS (SELECT s, level, count(*) AS n, sum(falls) AS x FROM e GROUP BY ALL),
        b AS (SELECT s, level, x <= n * {quality.RISK} AND ln((SELECT sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln({quality.RISK}) + (n - k) * ln(1 - {quality.RISK}))) FROM range(0, CAST(x + 1 AS BIGINT)) t(k)))
              <= ln({quality.DELTA} / (SELECT count(*) FROM (SELECT DISTINCT s FROM g WHERE NOT holdout))) AS passed FROM n),
        a AS (SELECT s, max(level) AS level FROM (SELECT s, level, bool_and(passed) OVER (PARTITION BY s ORDER BY level) AS passed FROM b) WHERE passed GROUP BY s),
        y1 AS (SELECT a.s, list(cut ORDER BY k) AS cuts, list(k ORDER BY k) AS ks FROM a JOIN p ON a.s = p.s AND a.level = p.level GROUP BY a.s),
        z AS (SELECT d.s, coalesce(own.cuts, pool.cuts) AS cuts, coalesce(own.ks, pool.ks) AS ks FROM (SELECT DISTINCT s FROM m) d LEFT JOIN y1 own ON own.s = d.s LEFT JOIN y1 pool ON pool.s = 'all')
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND NOT coalesce(list_bool_or(list_transform(ks, lambda k, j: coalesce(v[k] > cuts[j], false))), false) AS kept
        FROM v LEFT JOIN z ON z.s = coalesce('of ' || v.lang, 'none')"""


#: Rows ``t (t)`` with the table of CRC-32, and the CRC of the text ``_x`` given ``t``, in SQL.
_CRC_TABLE = "t AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, " + "list_reduce(list_prepend(i, range(8)), lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)" + " AS v FROM range(256) r(i)))"


def _crc(x):
    byte = f"CAST(concat('0x', substr(hex(encode({x})), CAST(2 * k + 1 AS BIGINT), 2)) AS BIGINT)"
    bytes_ = f"list_transform(range(CAST(octet_length(encode({x})) AS BIGINT)), lambda k: {byte})"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bytes_}), lambda c, b: xor(c // 256, t[CAST(xor(c, b) % 256 AS BIGINT) + 1])), 4294967295)"


def _periodic_sql():
    """Equal words a period apart, in stretches; those inside a stretch of a divisor's period are none of their own."""
    return f"""
        WITH {_CRC_TABLE},
        d AS (SELECT doc_id, w, len(w) AS n, h // 10 AS g, h % 10 = 0 AND len(w) > 0 AS hit FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, {_crc("CAST(doc_id AS VARCHAR)")} AS h FROM documents, t)),
        e AS (SELECT *, g % n AS a, 1 + (n - g % n) // (3 + g % 8) AS p FROM d WHERE hit),
        x AS (SELECT doc_id, n, i, w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1] AS y FROM (SELECT *, unnest(range(n)) AS i FROM e)
              UNION ALL SELECT doc_id, n, i, w[i + 1] FROM (SELECT *, unnest(range(n)) AS i FROM d WHERE NOT hit)),
        q AS (SELECT b.doc_id, b.i AS i, c.i - b.i AS q FROM x b JOIN x c ON b.doc_id = c.doc_id AND b.y = c.y AND c.i > b.i AND 3 * (c.i - b.i) <= b.n),
        s AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS size FROM (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM q) GROUP BY doc_id, q, k HAVING count(*) + q >= greatest(24, 3 * q)),
        r AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s o WHERE o.doc_id = s.doc_id AND o.q < s.q AND s.q % o.q = 0 AND o.start <= s.start AND o.start + o.size >= s.start + s.size)),
        k AS (SELECT doc_id, string_agg(y, ' ' ORDER BY i) AS kept FROM x WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = x.doc_id AND x.i >= r.start + r.q AND x.i < r.start + r.size) GROUP BY doc_id),
        l AS (SELECT doc_id, count(*) AS n_runs, string_agg(concat(start, ',', size, ',', q, chr(10)), '' ORDER BY start, q) AS listed FROM r GROUP BY doc_id),
        f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CAST(size AS DOUBLE) / q DESC, start, q) AS rank FROM r) WHERE rank = 1)
        SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, start, size AS length, f.q AS period, 1000 * size // f.q AS exponent_milli,
               sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256, n AS n_words
        FROM d LEFT JOIN l USING (doc_id) LEFT JOIN f USING (doc_id) LEFT JOIN k USING (doc_id)"""


def _spelling_sql():
    """Words that share a form with one letter wiped, or of which one is the other without a letter."""
    return f"""
        WITH RECURSIVE {_CRC_TABLE},
        o AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS w FROM documents) WHERE length(w) >= 7 GROUP BY doc_id, w),
        h AS (SELECT w, n, {_crc("concat(CAST(doc_id AS VARCHAR), ':', w)")} AS h FROM o, t),
        c AS (SELECT CASE WHEN h % 31 = 0 THEN concat(substr(w, 1, CAST(h % length(w) AS BIGINT)), substr(w, CAST(h % length(w) + 2 AS BIGINT))) ELSE w END AS w, n FROM h),
        v AS (SELECT w, CAST(sum(n) AS BIGINT) AS n FROM c WHERE length(w) >= 7 GROUP BY w HAVING sum(n) >= 2),
        p AS (SELECT w, n, i, concat(substr(w, 1, CAST(i AS BIGINT)), '?', substr(w, CAST(i + 2 AS BIGINT))) AS wiped, concat(substr(w, 1, CAST(i AS BIGINT)), substr(w, CAST(i + 2 AS BIGINT))) AS less FROM (SELECT w, n, unnest(range(length(w))) AS i FROM v)),
        e AS (SELECT a.w AS w, a.n AS n, b.w AS o, b.n AS m FROM p a JOIN p b ON a.wiped = b.wiped AND a.w <> b.w
              UNION SELECT p.w, p.n, v.w, v.n FROM p JOIN v ON p.less = v.w UNION SELECT v.w, v.n, p.w, p.n FROM p JOIN v ON p.less = v.w),
        b AS (SELECT w, count(*) AS n_near, max(m) AS most FROM e GROUP BY w),
        f AS (SELECT e.w, any_value(e.n) AS n, min(e.o) AS o, any_value(e.m) AS m FROM e JOIN b ON b.w = e.w AND e.m = b.most GROUP BY e.w),
        g AS (SELECT w, o AS form, m AS form_n FROM f WHERE m >= 10 * n),
        r AS (SELECT w, form AS up FROM g UNION ALL SELECT r.w, g.form FROM r JOIN g ON g.w = r.up),
        z AS (SELECT w, up AS root FROM r WHERE up NOT IN (SELECT w FROM g))
        SELECT v.w AS word, form, coalesce(root, v.w) AS root, n, coalesce(n_near, 0) AS n_near, form_n FROM v LEFT JOIN b ON b.w = v.w LEFT JOIN g ON g.w = v.w LEFT JOIN z ON z.w = v.w"""


def oracle_sql():
    return {
        "op11_periodic_runs": _periodic_sql(),
        "op13_spelling_variants": _spelling_sql(),
        "op3_substring_dedup": """
            WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
            w AS (SELECT doc_id, substr(h, CAST(2 * i + 1 AS BIGINT), 200) AS s, i FROM (SELECT doc_id, h, unnest(range(greatest(len(h) // 2 - 99, 0))) AS i FROM d)),
            r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM w) WHERE k > 1),
            n AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS fresh FROM r),
            g AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM n),
            p AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM g GROUP BY doc_id, span),
            q AS (SELECT p.doc_id, a, b, substr(h, CAST(2 * coalesce(lag(b) OVER (PARTITION BY p.doc_id ORDER BY a), 0) + 1 AS BIGINT), CAST(2 * (a - coalesce(lag(b) OVER (PARTITION BY p.doc_id ORDER BY a), 0)) AS BIGINT)) AS kept FROM p JOIN d USING (doc_id)),
            k AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans, max(b) AS tail, string_agg(kept, '' ORDER BY a) AS kept FROM q GROUP BY doc_id)
            SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
                   sha256(unhex(concat(coalesce(kept, ''), substr(h, CAST(2 * coalesce(tail, 0) + 1 AS BIGINT))))) AS kept_sha256
            FROM d LEFT JOIN k USING (doc_id)""",
        "op6_quality": _quality_sql(),
        "op9_licenses": _license_sql(),
        "op12_embedding_near_dedup": """
            WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL
                       AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
            u AS (SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS n FROM v),
            p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_inner_product(a.v, b.v) / (a.n * b.n) >= 0.9),
            r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
            c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
            k AS (SELECT a, count(*) AS n FROM p GROUP BY a)
            SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
            FROM embeddings JOIN c ON c.a = vec_id LEFT JOIN k ON k.a = vec_id""",
        "op8_topk": """
            WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
                       WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
            s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
                  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
            r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
            SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    }
