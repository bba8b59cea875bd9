"""Licence scans: phrases in whole texts, and an exact set-similarity join of text blocks with licence templates.

A block is a paragraph (lines between blank ones, so hard wraps don't matter). Of a paragraph of more than 2 * RUN words, each
run of 2 * RUN words that starts at a multiple of RUN is a block, so that any passage of up to RUN words is in one of them
and words that stand far apart make no notice. Templates have RUN words at most.

The words of templates are put in one global order, rarest in the corpus first. A block can only hold the share CONTAINMENT
of a template's distinct words if it has one of the template's first |T| - need + 1 words in that order (prefix filter), has
at least `need` of the words (length filter), and if the first such word leaves enough of the template's words behind it
(positional filter). Blocks that pass are verified on their whole word sets, so the join finds every block and template that
qualify. Licences of one family share most of their words; a template therefore also names words that a block must have, and
words of its siblings that it must not have.

Texts are tokenised once; what is kept of them are counts, places of phrases and each block's words of the templates.
Only templates are broadcast (a list in code, bounded by its length); only counts of their words reach the driver.

Edge cases: a null text is empty; texts without words have no labels and score 0. Rows that repeat a doc_id share the labels
that the join finds in any of them. Very long texts are blocks of bounded size. Ties need no order, as all labels are kept.
An empty table gives an empty result. Other columns, whatever their names, are left out.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import fast_lower, saved

#: What separates words once A-Z are lower-cased, and a word before that.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
TOKEN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BLANK = r"\n[ \t\r\x0B\x0C]*\n"
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
CONTAINMENT = 0.8
RUN = 160


@dataclass(frozen=True)
class Template:
    text: str
    must: str = ""
    without: str = ""


#: The licences' own wordings and short notices, each with the words that tell it from its siblings.
TEMPLATES = {
    "apache-2.0": Template("licensed under the apache license version 2 0", "apache license 2"),
    "apache-2.0-header": Template(
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind "
        "either express or implied see the license for the specific language governing permissions and limitations under the license",
        "apache license compliance governing",
    ),
    "apache-notice": Template("released under the apache license", "apache license"),
    "agpl-notice": Template("licensed under the gnu affero general public license", "gnu affero license"),
    "bsd": Template("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution binary permitted conditions"),
    "bsd-disclaimer": Template(
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and "
        "fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages "
        "including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract "
        "strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
        "contributors merchantability exemplary procurement",
    ),
    "bsd-notice": Template("released under the bsd license", "bsd license"),
    "cc-by-nc": Template("licensed under cc by nc 4 0", "cc by nc"),
    "cc-by-nd": Template("licensed under cc by nd 4 0", "cc by nd"),
    "cc-by-sa": Template("licensed under cc by sa 4 0", "cc by sa"),
    "cc0": Template("to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "waived copyright neighboring"),
    "gpl-3.0-or-later": Template(
        "you can redistribute it and or modify it under the terms of the gnu general public license either version 3 of the license or any later version", "gnu general public license 3 later", "lesser library affero"
    ),
    "gpl-notice": Template("licensed under the gnu general public license", "gnu general public license", "lesser library affero"),
    "isc": Template(
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        "permission fee granted notice copies",
    ),
    "lgpl-notice": Template("licensed under the gnu lesser general public license", "gnu lesser license"),
    "lgpl-or-later": Template(
        "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or any later version",
        "gnu lesser public license later",
    ),
    "mit-disclaimer": Template(
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with "
        "the software or the use or other dealings in the software",
        "merchantability noninfringement dealings",
    ),
    "mit-grant": Template(
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction", "permission granted charge restriction"
    ),
    "mit-notice": Template("released under the mit license", "mit license"),
    "mit-permission": Template(
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including "
        "without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to "
        "the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "granted charge restriction sublicense furnished",
    ),
    "mpl-2.0": Template("this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license 2"),
    "all-rights-reserved": Template("copyright all rights reserved", "copyright rights reserved"),
    "unlicense": Template("this is free and unencumbered software released into the public domain", "unencumbered public domain"),
}


def tokens_of(text: str) -> list[str]:
    return sorted(set(re.findall(TOKEN, text.lower())))


def need_of(size: int, containment: float = CONTAINMENT) -> int:
    return ceil(containment * size - 1e-9)


def _listed(words) -> Column:
    return F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")


def _places(words: Column, phrase: str) -> Column:
    """Starts of the phrase among words."""
    parts = phrase.split(" ")

    def at(i: Column) -> Column:
        fits = F.get(words, i) == parts[0]
        for j, p in enumerate(parts[1:], 1):
            fits = fits & F.coalesce(F.get(words, i + j) == p, F.lit(False))
        return fits

    every = F.array_contains(words, parts[0])
    for p in parts[1:]:
        every = every & F.array_contains(words, p)
    found = F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0))), at)
    return F.when(every, found).otherwise(F.array().cast("array<int>"))


def blocks_of(paragraphs: Column) -> Column:
    """Word lists of paragraphs as word lists of blocks."""
    runs = lambda p: F.transform(F.sequence(F.lit(0), F.size(p) - RUN - 1, F.lit(RUN)), lambda i: F.slice(p, i + 1, 2 * RUN))
    return F.flatten(F.transform(paragraphs, lambda p: F.when(F.size(p) > 2 * RUN, runs(p)).otherwise(F.array(p))))


def tokenised(docs: DataFrame, templates: dict[str, Template] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """docs (doc_id, text) as doc_id, n_words, n_base, first_word, last_word, found (labels of phrases), held (each block's distinct words of the templates)."""
    vocabulary = sorted({w for t in templates.values() for w in (*tokens_of(t.text), *t.must.split(), *t.without.split())})
    text = fast_lower(F.coalesce("text", F.lit("")))
    words = F.transform(F.split(text, BLANK), lambda p: F.array_remove(F.split(p, SEPARATOR), ""))
    own = docs.select("doc_id", words.alias("_p")).withColumn("_w", F.flatten("_p"))
    own = own.withColumn("_at", F.array(*[_places(F.col("_w"), p) for p in phrases]))
    every = F.flatten("_at")
    labels = F.filter(F.array(*[F.when(F.size(F.get("_at", F.lit(i))) > 0, F.lit(x)) for i, x in enumerate(phrases.values())]), lambda x: x.isNotNull())
    held = F.filter(F.transform(blocks_of(F.col("_p")), lambda b: F.array_intersect(b, _listed(vocabulary))), lambda b: F.size(b) > 0)
    return own.select(
        "doc_id", F.size("_w").cast("long").alias("n_words"), F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"),
        labels.alias("found"), held.alias("held"),
    )


def template_join(rows: DataFrame, templates: dict[str, Template] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """rows (doc_id, held) of tokenised(). Every (doc_id, block, template, overlap, size) such that the block holds at least the share containment of the template's distinct words, and no word or lack that rules it out."""
    spark = rows.sparkSession
    sets = {name: tokens_of(t.text) for name, t in templates.items()}
    need = {name: need_of(len(s), containment) for name, s in sets.items()}
    held = rows.select("doc_id", F.posexplode("held").alias("block", "words"))
    counts = {r.word: r.n for r in held.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a word of the templates
    order = {w: (counts.get(w, 0), w) for s in sets.values() for w in s}
    prefix = [(w, name, i) for name, s in sets.items() for i, w in enumerate(sorted(s, key=order.get)[: len(s) - need[name] + 1])]
    prefixes = spark.createDataFrame(prefix, "word string, template string, at int")
    whole = [(n, sets[n], len(sets[n]), need[n], t.must.split(), t.without.split()) for n, t in templates.items()]
    whole = spark.createDataFrame(whole, "template string, tokens array<string>, size int, need int, must array<string>, without array<string>")
    hits = held.withColumn("word", F.explode(F.array_intersect("words", _listed(sorted({p[0] for p in prefix})))))
    hits = hits.join(F.broadcast(prefixes), "word").join(F.broadcast(whole), "template")
    hits = hits.where((F.size("words") >= F.col("need")) & (F.col("size") - F.col("at") >= F.col("need")))
    told = (F.size(F.array_except("must", "words")) == 0) & ~F.arrays_overlap("without", "words")
    hits = hits.where(told).withColumn("overlap", F.size(F.array_intersect("words", "tokens")))
    return hits.where("overlap >= need").select("doc_id", "block", "template", "overlap", "size").distinct()


def scan(docs: DataFrame, templates: dict[str, Template] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (1 for a phrase, else the best containment found, else 0)."""
    own = saved(tokenised(docs, templates), "licence-words")
    found = template_join(own, templates, containment).groupBy("doc_id").agg(F.collect_set("template").alias("_more"), F.max(F.col("overlap") / F.col("size")).alias("_best"))
    own = own.drop("held").join(found, "doc_id", "left")
    every = F.concat("found", F.coalesce("_more", F.array().cast("array<string>")))
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    score = F.when(F.size("found") > 0, 1.0).otherwise(F.coalesce("_best", F.lit(0.0)))
    return own.select("doc_id", "n_words", "n_base", "first_word", "last_word", joined(F.col("found")).alias("base_labels"), joined(every).alias("labels"), score.alias("score"))
