r"""License scans: base phrases, and an exact set-similarity join of text blocks with license templates.

A block of a template of n words is any ceil((1 + SLACK) * n) consecutive words of a text, whatever lines they stand on; it and the
template are compared as sets of words. A block meets the template if it contains at least `threshold` of the template's
words. Words outside all templates can't count, so texts keep the places of template tokens alone. Tokens are ordered by
their frequency over all texts, rarest first. With c = ceil(threshold * |T|), a block that meets T shares a
token of T's first |T| - c + 1 tokens (prefix filter): places of such tokens are joined with an index of those prefixes. Of what stands within
a block's reach of the place, tokens of T that are not before the shared one must be c at least (positional
filter), which also bounds the set's size (length filter). Blocks that begin at each of the candidates' tokens are then verified by counting; a
block that meets T meets it from its first token of T on, so no other starts are needed. The templates are a fixed table of
bounded size, so the join needs no shuffle whatever the corpus; all of it is DataFrame operations.

A null text is empty; rows equal in doc_id and text have equal results; long texts cost time in proportion; an empty table gives
an empty table; only doc_id and text are read.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, materialize

#: Phrases and their labels, as the contract names them.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notices that publicly known licenses ask for, lower case, words alone.
TEMPLATES = {
    "mit-notice": "released under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "mit-warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "apache-2-notice": "licensed under the apache license version 2 0",
    "apache-2-header": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "cc-by-nc-4": "licensed under cc by nc 4 0",
    "gpl-3": "this work is licensed under the gnu general public license version 3",
    "gpl-header": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted",
    "bsd-warranty": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "reserved": "all rights reserved",
}
#: Words that a block may have beyond the template's, as a share of them.
SLACK = 0.25
THRESHOLD = 0.9
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same before A-Z are lower case.
_RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_RAW_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(c: Column) -> Column:
    return F.filter(F.split(lower_ascii(c), _GAP), lambda w: w != "")


def _places(words: Column, phrase: str) -> Column:
    """Starts of the phrase, words counted from 0."""
    parts = phrase.split()
    steps = F.sequence(F.lit(0), F.size(words) - len(parts))

    def here(i):
        hit = F.get(words, i) == parts[0]
        for k, p in enumerate(parts[1:], 1):
            hit = hit & (F.get(words, i + k) == p)
        return hit

    return F.when(F.size(words) >= len(parts), F.filter(steps, here)).otherwise(F.array().cast("array<int>"))


def base_places(docs: DataFrame) -> DataFrame:
    """doc_id, th, n_words, n_base, first_word, last_word, base (labels) of every row."""
    text = F.coalesce("text", F.lit(""))
    hint = "(?i)" + "|".join(_RAW_GAP.join(p.split()) for p in PHRASES)
    words = F.when(text.rlike(hint), words_of(text)).otherwise(F.array().cast("array<string>"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), F.regexp_count(text, F.lit(_RAW_WORD)).cast("long").alias("n_words"), words.alias("w"))
    at = [_places(F.col("w"), p).alias(f"p{k}") for k, p in enumerate(PHRASES)]
    rows = rows.select("doc_id", "th", "n_words", *at)
    every = F.concat(*(F.col(f"p{k}") for k in range(len(PHRASES))))
    base = F.filter(F.array(*(F.when(F.size(f"p{k}") > 0, F.lit(label)) for k, label in enumerate(PHRASES.values()))), lambda x: x.isNotNull())
    return rows.select("doc_id", "th", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"), base.alias("base"))


def block_words(template: str) -> int:
    """Words of a block for the template."""
    return ceil((1 + SLACK) * len(template.split()))


def template_blocks(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, th, block (its first word, from 0), template, containment of every block that begins at a token of the template and meets it."""
    sets = {name: sorted(set(t.split())) for name, t in templates.items()}
    need = {name: ceil(threshold * len(s) - 1e-9) for name, s in sets.items()}
    vocabulary = sorted(set().union(*sets.values()))
    known = F.create_map(*(x for k, t in enumerate(vocabulary) for x in (F.lit(t), F.lit(k))))
    words = words_of(F.col("text"))
    # two bounds that a text must meet, so that most texts end here
    enough = F.size(F.array_intersect(F.split(lower_ascii(F.col("text")), _GAP), F.array(*map(F.lit, vocabulary)))) >= min(need.values())
    numbered = F.transform(words, lambda w, i: F.struct(i.alias("at"), known[w].alias("token")))
    texts = docs.where(F.col("text").isNotNull() & enough).select("doc_id", F.xxhash64("text").alias("th"), F.filter(numbered, lambda x: x["token"].isNotNull()).alias("hits"))
    texts = materialize(texts, "tokens")
    counts = dict(texts.select(F.explode(F.array_distinct("hits.token")).alias("token")).groupBy("token").count().collect())  # a row for each template token at most
    rank = {k: r for r, k in enumerate(sorted(range(len(vocabulary)), key=lambda k: (counts.get(k, 0), k)))}
    index = []
    for name, s in sets.items():
        t = sorted(rank[vocabulary.index(x)] for x in s)
        index += [(name, t, need[name], block_words(templates[name]), t[k]) for k in range(len(t) - need[name] + 1)]
    prefixes = sorted({row[-1] for row in index})
    table = F.broadcast(docs.sparkSession.createDataFrame(index, "template string, t array<int>, need int, reach int, token int"))
    widest = max(map(block_words, templates.values()))
    ranks = F.array(*(F.lit(rank[k]) for k in range(len(vocabulary))))
    hits = F.transform("hits", lambda x: F.struct(x["at"].alias("at"), F.get(ranks, x["token"]).alias("token")))
    ranked = texts.select("doc_id", "th", hits.alias("hits"))
    seeds = F.filter(F.transform("hits", lambda x, i: F.struct(i.alias("i"), x["at"].alias("at"), x["token"].alias("token"))), lambda x: F.array_contains(F.array(*map(F.lit, prefixes)), x["token"]))
    around = lambda i: F.slice("hits", F.greatest(i - widest + 2, F.lit(1)), F.least(i, F.lit(widest - 1)) + widest)
    near = ranked.select("doc_id", "th", F.explode(F.transform(seeds, lambda x: F.struct(x["at"].alias("at"), x["token"].alias("token"), around(x["i"]).alias("around")))).alias("x")).select("doc_id", "th", "x.*")
    found = near.join(table, "token")
    inside = F.filter("around", lambda x: (x["at"] > F.col("at") - F.col("reach")) & (x["at"] < F.col("at") + F.col("reach")) & F.array_contains("t", x["token"]))
    found = found.withColumn("block", inside)
    found = found.where(F.size(F.array_distinct(F.filter(F.col("block.token"), lambda x: x >= F.col("token")))) >= F.col("need"))
    shared = lambda a: F.size(F.array_distinct(F.transform(F.filter("block", lambda x: (x["at"] >= a) & (x["at"] < a + F.col("reach"))), lambda x: x["token"])))
    starts = F.filter("block", lambda x: x["at"] <= F.col("at"))  # blocks from here on hold the place
    met = F.explode(F.transform(starts, lambda x: F.struct(x["at"].alias("first"), shared(x["at"]).alias("shared"))))
    out = found.select("doc_id", "th", "template", "need", F.size("t").alias("size"), met.alias("m")).where(F.col("m.shared") >= F.col("need"))
    return out.select("doc_id", "th", F.col("m.first").alias("block"), "template", (F.col("m.shared") / F.col("size")).alias("containment")).distinct()


def license_scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score (the best containment; 1 with a base phrase) of every row."""
    docs = docs.select("doc_id", "text")
    met = template_blocks(docs, templates, threshold).groupBy(F.col("doc_id").alias("d"), F.col("th").alias("h")).agg(F.collect_set("template").alias("met"), F.max("containment").alias("best"))
    base = base_places(docs)
    joined = base.join(met, base.doc_id.eqNullSafe(met.d) & (base.th == met.h), "left")
    every = F.array_union("base", F.coalesce("met", F.array().cast("array<string>")))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0)))
    return joined.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("base"), ",").alias("base_labels"), F.array_join(F.array_sort(every), ",").alias("labels"), score.alias("score"))
