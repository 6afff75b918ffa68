"""License scan: phrases that name a license, and text blocks that hold most of a license notice.

Phrases (``PHRASES``) are found wherever their words stand one after another. Notices (``TEMPLATES``)
are found by an exact set-similarity join between text blocks and templates: a block matches if it
holds at least ``THRESHOLD`` of a template's distinct words.

* A block is a window of 16, 64 or 512 words that begins at every half of its size. A template is
  sought in the smallest blocks that are twice as long as itself, so every passage of its length lies
  whole in one block.
* The words of all templates are ordered by the number of blocks of all documents that hold them,
  rarest first. A block that holds ``o`` of a template's ``t`` words holds one of the template's
  first ``t - o + 1`` (its prefix), and that one is among the block's own first ``b - o + 1``, if the
  block has ``b`` template words. Blocks and templates are joined on the words of their prefixes.
* Length filter: a document, and then a block, must have enough words of some template. Position
  filter: the words that follow a common word in both orders must still reach ``o``.
* Pairs that pass are verified by intersecting the sets.

Everything is DataFrame functions. The text is read once: what the join needs (one narrow row a
document, with the word sets of the few blocks that pass the length filter) is written to the shared
folder, numbered there, and joined back by that number, so equal texts don't meet in one key. Templates
are at most ``MOST`` (checked), so their side is broadcast and a common notice is no hot key.

Only A-Z are lower-cased; a word is a run of digits, letters a-z and characters beyond ASCII. Null
texts count as empty: no words, no labels, score 0. Long texts are scanned whole, whatever their
length. Repeated rows are reported each for itself; an empty table gives no rows; extra columns are
ignored. The score of a document is 1 if it holds a phrase, else the largest share of a template that
one of its blocks holds (0 if none matches).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlens.llm.common import literal_rows, stored, text_or_empty

THRESHOLD = 0.9
#: Words of a block, by the length of the templates that are sought in it.
SIZES = (16, 64, 512)
#: Templates, at most: their words and prefixes are sent to every task.
MOST = 1000

# Phrases and their labels; license notices (public texts) and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
TEMPLATES = [
    ("mit", "released under the MIT license"),
    ("apache", "licensed under the Apache License, Version 2.0"),
    ("gpl", "licensed under the GNU General Public License, version 3"),
    ("cc-by", "licensed under CC BY 4.0"),
    ("cc-by-nc", "licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "licensed under CC BY-SA 4.0"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
            "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
            "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
            "option) any later version."),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is "
               "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
               "See the License for the specific language governing permissions and limitations under the License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
            "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
            "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
            "conditions: The above copyright notice and this permission notice shall be included in all copies or "
            "substantial portions of the Software."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met: Redistributions of source code must retain the above copyright notice, this "
            "list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above "
            "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
            "materials provided with the distribution."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies."),
]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text in order."""
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), GAP), "")


def plain_words(text: str) -> list[str]:
    """The same of an ASCII template text."""
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def needed(distinct: int, threshold: float) -> int:
    """Words that a block must share with a template of so many distinct words."""
    return max(1, math.ceil(round(threshold * distinct, 9)))


def phrase_places(words: Column, phrase: str) -> Column:
    """Starts (from 0) of a phrase's words one after another."""
    parts = phrase.split()
    last = F.size(words) - len(parts)

    def stands(i: Column) -> Column:
        out = F.lit(True)
        for k, part in enumerate(parts):
            out = out & (F.element_at(words, (i + k + 1).cast("int")) == part)
        return out

    none = F.array().cast("array<int>")
    held = F.array_contains(words, parts[0])
    for part in parts[1:]:
        held = held & F.array_contains(words, part)
    return F.when((last >= 0) & held, F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), stands)).otherwise(none)


def strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


class Templates:
    """The templates with the sizes of their sets; ``order`` is set once the words have been counted."""

    def __init__(self, templates: list[tuple[str, str]], threshold: float):
        if not 0 < len(templates) <= MOST or not 0 < threshold <= 1:
            raise ValueError(f"license scan: 1 to {MOST} templates and a threshold above 0, at most 1")
        self.rows = []
        for n, (label, text) in enumerate(templates):
            words = plain_words(text)
            size = next((s for s in SIZES if 2 * len(words) <= s), None)
            if not words or size is None:
                raise ValueError(f"license scan: a template of {len(words)} words")
            distinct = sorted(set(words))
            self.rows.append((n, label, size, distinct, needed(len(distinct), threshold)))
        self.words = sorted({w for r in self.rows for w in r[3]})

    def may_match(self, words: Column, size: int | None = None) -> Column:
        """Length filter: whether a set of words is large enough for some template (of one block size)."""
        out = F.lit(False)
        for _, _, s, distinct, least in self.rows:
            if size is None or s == size:
                out = out | (F.size(F.array_intersect(words, strings(distinct))) >= least)
        return out

    def prefixes(self, order: list[str]) -> list[tuple]:
        """``word, template, label, size, place, n_words, least``: the words of each template's prefix."""
        rank = {w: i for i, w in enumerate(order)}
        out = []
        for n, label, size, distinct, least in self.rows:
            for place, w in enumerate(sorted(distinct, key=rank.get)[:len(distinct) - least + 1], 1):
                out.append((w, n, label, size, place, len(distinct), least))
        return out


def blocks_of(words: Column, templates: Templates) -> Column:
    """``size, start, words`` of the blocks that pass the length filter: their template words, distinct."""
    parts = []
    vocabulary = strings(templates.words)
    n = F.size(words)
    for size in sorted({r[2] for r in templates.rows}):
        half = size // 2
        starts = F.sequence(F.lit(0), F.greatest(n - half - 1, F.lit(0)), F.lit(half))  # the last block reaches the end
        made = F.transform(starts, lambda s: F.struct(
            F.lit(size).alias("size"), s.cast("long").alias("start"),
            F.array_intersect(F.slice(words, s + 1, F.lit(size)), vocabulary).alias("words")))
        parts.append(F.filter(made, lambda b: templates.may_match(b["words"], size)))
    return F.concat(*parts)


def scanned(docs: DataFrame, templates: Templates, phrases: dict[str, str], id_col: str, text_col: str) -> DataFrame:
    """One narrow numbered row a document: phrase places and the blocks that pass the length filter."""
    words = docs.select(F.col(id_col).alias("doc"), words_of(text_or_empty(text_col)).alias("w"))
    places = words.select("doc", "w", *[phrase_places(F.col("w"), p).alias(f"p{i}") for i, p in enumerate(phrases)],
                          F.array_intersect("w", strings(templates.words)).alias("held"))
    every = F.flatten(F.array(*[F.col(f"p{i}") for i in range(len(phrases))])) if phrases else F.array().cast("array<int>")
    labels = F.array(*[F.when(F.size(f"p{i}") > 0, F.lit(label)) for i, label in enumerate(phrases.values())]) \
        if phrases else F.array().cast("array<string>")
    none = F.array().cast("array<struct<size:int,start:bigint,words:array<string>>>")
    return stored(places.select(
        F.monotonically_increasing_id().alias("row"), "doc", F.size("w").cast("long").alias("n_words"),
        every.alias("places"), F.array_sort(F.array_distinct(F.array_compact(labels))).alias("base"),
        F.when(templates.may_match(F.col("held")), blocks_of(F.col("w"), templates)).otherwise(none).alias("blocks")), "licenses")


def matches(rows: DataFrame, templates: Templates) -> DataFrame:
    """``row, template, label, size, start, overlap, containment``: every block and template that match."""
    blocks = rows.select("row", F.explode("blocks").alias("b")).select("row", "b.size", "b.start", "b.words")
    seen = blocks.select(F.explode("words").alias("word")).groupBy("word").count().collect()  # words of templates only
    count = {r["word"]: r["count"] for r in seen}
    order = sorted(templates.words, key=lambda w: (count.get(w, 0), w))
    prefixes = literal_rows(rows.sparkSession, templates.prefixes(order),
                            "word string, template int, label string, of int, place int, n int, least int")
    texts = literal_rows(rows.sparkSession, [(r[0], r[3]) for r in templates.rows], "template int, t array<string>")
    # of an intersection the order is that of its first side: the block's words, rarest first
    ordered = blocks.withColumn("words", F.array_intersect(strings(order), "words"))
    smallest = {s: min(r[4] for r in templates.rows if r[2] == s) for s in {r[2] for r in templates.rows}}
    least = F.coalesce(*[F.when(F.col("size") == s, F.lit(n)) for s, n in smallest.items()])
    own = ordered.withColumn("b", F.size("words")).select(
        "row", "size", "start", "words", "b", F.posexplode(F.slice("words", F.lit(1), F.greatest(F.col("b") - least + 1, F.lit(0)))))
    met = own.join(F.broadcast(prefixes), (F.col("col") == F.col("word")) & (F.col("size") == F.col("of")))  # MOST templates
    passed = met.where((F.col("pos") <= F.col("b") - F.col("least"))  # in the block's prefix for this template
                       & (F.least(F.col("n") - F.col("place"), F.col("b") - F.col("pos") - 1)
                          + F.least(F.col("place"), F.col("pos") + 1) >= F.col("least")))
    pairs = passed.groupBy("row", "size", "start", "template", "label").agg(
        F.first("words").alias("words"), F.first("n").alias("n"), F.first("least").alias("least"))
    return pairs.join(F.broadcast(texts), "template") \
        .withColumn("overlap", F.size(F.array_intersect("words", "t"))).where(F.col("overlap") >= F.col("least")) \
        .select("row", "template", "label", "size", "start", "overlap", (F.col("overlap") / F.col("n")).alias("containment"))


def license_blocks(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, label, template, first_word, n_words, overlap, containment`` of every matching text block."""
    known = Templates(TEMPLATES if templates is None else templates, threshold)
    rows = scanned(docs, known, {}, id_col, text_col)
    return matches(rows, known).join(rows.select("row", "doc"), "row").select(
        F.col("doc").alias(id_col), "label", "template", F.col("start").alias("first_word"),
        F.col("size").alias("n_words"), "overlap", "containment")


def license_report(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD,
                   phrases: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_words, n_base, first_word, last_word, base_labels, labels, score, n_blocks`` of every row."""
    known = Templates(TEMPLATES if templates is None else templates, threshold)
    rows = scanned(docs, known, PHRASES if phrases is None else phrases, id_col, text_col)
    found = matches(rows, known).groupBy("row").agg(F.collect_set("label").alias("more"), F.count("*").alias("n_blocks"),
                                                    F.max("containment").alias("share"))  # at most one label a template
    more = F.coalesce("more", F.array().cast("array<string>"))
    return rows.drop("blocks").join(found, "row", "left").select(
        F.col("doc").alias(id_col), "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", more)), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
        F.coalesce("n_blocks", F.lit(0)).cast("long").alias("n_blocks"))
