"""License scans by diagonal voting, in DataFrame expressions only.

The hashes of all rolling word k-grams of all documents are joined to the positions of the same k-grams in
license templates.  A match votes for its diagonal, document position minus template
position; the votes of a template are summed by diagonal and its neighbours (a few inserted
or dropped words apart), so a span is never much longer than its template, and a span is verified by the
share of the template's k-grams that it holds.  Of overlapping spans the best names the license.

Templates are the notices below or a table of whole license texts. Long texts are cut into pieces, each a template of
its own, so a license that lacks its title or a paragraph is still found by the others.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Fixed base phrases and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Templates: public license texts and the notices by which texts name their license, with their labels (fixed texts).
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2"),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    ("gpl-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("agpl-3.0", "licensed under the GNU Affero General Public License, version 3"),
    ("lgpl-3.0", "licensed under the GNU Lesser General Public License, version 3"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nd-4.0", "Licensed under CC BY-ND 4.0"),
    ("cc-by-nc-sa-4.0", "Licensed under CC BY-NC-SA 4.0"),
    ("cc-by-4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa-4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc-4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
)
GRAM = 3
#: Diagonals at most this far apart vote together; the share of a template's k-grams from which a span counts.
NEAR = 3
LEAST = 0.8
#: Words of a piece of a template, at most.
PIECE = 150
#: Cells of the table that tells in a scan which k-grams no template holds: eight for each k-gram of a template, within these bounds.
CELLS, MOST_CELLS = 1 << 15, 1 << 20
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text):
    """Lower-case words of letters, digits and non-ASCII characters as an array; null gives an empty one.

    ``lower`` also maps letters beyond A-Z; those stay word characters, so words and their places hold.
    """
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def grams(words, k=GRAM):
    """Hashes of all rolling k-grams of an array of words."""
    one = F.slice(F.transform(words, lambda w, i: F.xxhash64(*[F.get(words, i + j) for j in range(k)])), 1, F.greatest(F.size(words) - (k - 1), F.lit(0)))
    return F.when(F.size(words) < k, F.array().cast("array<bigint>")).otherwise(one)


def template_grams(spark, templates=TEMPLATES, k=GRAM, piece=PIECE) -> DataFrame:
    """``gram, template, label, place, size`` of all pieces of the templates, in order of the templates.

    ``templates`` are pairs of a label and a text, or a DataFrame with the columns label and text (other columns are
    ignored, equal rows count once, rows with a null label or text not at all), taken in order of label and text. A text of over ``piece`` words
    is cut into pieces of nearly equal size that share k-1 words, so each of its k-grams is in one piece.
    """
    if isinstance(templates, DataFrame):
        rows = templates.select(F.col("label").cast("string").alias("label"), F.col("text").cast("string").alias("text")).dropna().distinct()
        rows = common.running_start(rows, ["label", "text"]).withColumnRenamed("_start", "number")
    else:
        rows = spark.createDataFrame([(i, label, text) for i, (label, text) in enumerate(templates)], "number long, label string, text string")
    n = F.size("w") - (k - 1)
    each = F.ceil(n / F.ceil(n / piece)).cast("int")
    cut = rows.select("number", "label", words(F.col("text")).alias("w")).filter(n > 0).withColumn("each", each)
    cut = cut.select("number", "label", "each", "w", F.explode(F.sequence(F.lit(0), F.ceil(n / F.col("each")).cast("int") - 1)).alias("part"))
    cut = cut.select((F.col("number") * (1 << 20) + F.col("part")).alias("template"), "label", grams(F.slice("w", F.col("part") * F.col("each") + 1, F.col("each") + (k - 1)), k).alias("g"))
    return cut.select("template", "label", F.size("g").alias("size"), F.posexplode("g").alias("place", "gram"))


def _finder(phrase):
    return lambda flat: _phrase(flat, phrase)


def _phrase(flat, phrase):
    """Places of a phrase in words that are each set off by two spaces: how many, first and last."""
    mark = " " + "  ".join(phrase.split()) + " "
    places = F.size(F.split(flat, mark)).cast("long") - 1
    count = lambda part: F.size(F.array_remove(F.split(part, " +"), "")).cast("long")
    last = count(flat) - count(F.substring_index(flat, mark, -1)) - len(phrase.split())
    return F.when(F.contains(flat, F.lit(mark)), F.struct(places.alias("n"), count(F.substring_index(flat, mark, 1)).alias("first"), last.alias("last")))


def votes(hits: DataFrame, table: DataFrame, k=GRAM) -> DataFrame:
    """``row, label, template, start, stop, share, best``: what the diagonals of ``hits`` (``row, at, gram``) say, in words.

    A diagonal's votes are those of its neighbours too; share is the part of the template's k-grams among
    them. A span is its document's ``best`` at its place if its share is at least LEAST and no overlapping span has a larger
    one (or as large a one of a longer template).
    """
    line = Window.partitionBy("row", "template").orderBy("diagonal").rangeBetween(-NEAR, NEAR)
    met = hits.join(table, "gram").groupBy("row", "template", "label", "size", (F.col("at") - F.col("place")).cast("long").alias("diagonal"))
    met = met.agg(F.collect_set("place").alias("places"), F.min("at").alias("_start"), F.max("at").alias("_stop"))
    held = F.size(F.array_distinct(F.flatten(F.collect_list("places").over(line))))
    spans = met.select("row", "label", "template", "size", F.min("_start").over(line).alias("start"), (F.max("_stop").over(line) + k).alias("stop"), (held / F.col("size")).alias("share")).distinct()
    longest = table.agg(F.max("size")).first()[0] or 0
    around = Window.partitionBy("row").orderBy(F.col("start").cast("long")).rangeBetween(-(longest + k + 2 * NEAR), longest + k + 2 * NEAR)
    order = lambda x: F.struct(x["share"], x["size"], -x["start"], -x["stop"], -x["template"])
    own = F.struct("start", "stop", "share", "size", "template")
    beaten = lambda near: F.exists(near, lambda x: (x["start"] < F.col("stop")) & (x["stop"] > F.col("start")) & (order(x) > order(F.col("_own"))))
    spans = spans.withColumn("_own", own).withColumn("_near", F.collect_list(F.when(F.col("share") >= LEAST, F.col("_own"))).over(around))
    return spans.select("row", "label", "template", "start", "stop", "share", ((F.col("share") >= LEAST) & ~beaten(F.col("_near"))).alias("best"))


def scan(docs: DataFrame, doc_id="doc_id", text="text", templates=TEMPLATES, k=GRAM, piece=PIECE) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` for every row.

    ``templates``, ``piece``: as in :func:`template_grams`. labels: those of base phrases, and of each span's best template; of
    templates that fit a span equally the first in their order. score: the largest share of a template's k-grams that neighbouring diagonals of the text hold, whether it is enough for a label or not, so a base phrase outside of
    any notice scores low. A null text has no words. Rows are scanned each by itself, whatever ids they share. Texts are
    read once; what goes on are the facts of a row and its places of k-grams that templates may hold.
    """
    spark = docs.sparkSession
    table = common.checkpoint(template_grams(spark, templates, k, piece))
    many = min(MOST_CELLS, max(CELLS, 1 << (8 * table.count()).bit_length()))
    cells = bytearray(many)
    for r in table.select(F.pmod("gram", F.lit(many)).alias("cell")).distinct().collect():  # as many as the table has cells, at most
        cells[r.cell] = 1
    held = lambda gram: F.substring(F.lit(cells), F.pmod(gram, F.lit(many)).cast("int") + 1, 1) == F.lit(bytearray([1]))
    places = lambda g: F.transform(F.filter(F.transform(g, lambda x, i: F.when(held(x), F.struct(i.alias("at"), x.alias("gram")))), lambda x: x.isNotNull()), lambda x: x)
    facts = lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.concat(F.lit(" "), F.array_join(w, "  "), F.lit(" ")).alias("flat"), common.let(grams(w, k), places).alias("hits"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.explode(F.array(common.let(words(F.col(text)), facts))).alias("_w"))
    rows = rows.select("doc_id", "_w.n_words", "_w.hits", *[common.let(F.col("_w.flat"), _finder(p)).alias(f"_p{i}") for i, (p, _) in enumerate(PHRASES)])
    found = [F.col(f"_p{i}") for i in range(len(PHRASES))]
    total = sum((F.coalesce(p["n"], F.lit(0).cast("long")) for p in found), F.lit(0).cast("long"))
    base = F.array_sort(F.array_compact(F.array(*[F.when(p.isNotNull(), label) for p, (_, label) in zip(found, PHRASES, strict=True)])))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_words", "hits", total.alias("n_base"), F.array_min(F.array(*[p["first"] for p in found])).alias("first_word"), F.array_max(F.array(*[p["last"] for p in found])).alias("last_word"), base.alias("_base"))
    rows = common.checkpoint(rows)
    voted = votes(rows.select("row", F.explode("hits").alias("h")).select("row", "h.at", "h.gram"), common.small(table), k)
    voted = voted.groupBy("row").agg(F.collect_set(F.when(F.col("best"), F.col("label"))).alias("_more"), F.max("share").alias("_share"))
    rows = rows.drop("hits").join(voted, "row", "left")
    every = F.array_sort(F.array_distinct(F.concat("_base", F.coalesce("_more", F.array().cast("array<string>")))))
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("_base", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), F.coalesce("_share", F.lit(0.0)).alias("score"))
