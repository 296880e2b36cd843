r"""Licence scan with a positional rare-token index, in DataFrame expressions only.

Licence templates are short word sequences.  Their postings (word -> template,
position) leave out function words.  For each document:

1. of each template the licence words it has are ranked by inverse document
   frequency, which is counted over all documents, and the RARE highest of each
   template are looked up; no template here has more, so none loses postings to
   another licence of the same file;
2. each place of such a word, less the word's position in a template, is a
   place where the template would start; starts that two or more different
   words agree on are candidates (an intersection of postings by relative
   position);
3. a candidate counts if all mandatory key phrases of its template stand near
   it and enough template words stand at their own places.

Base phrases are found at all their places, whatever the ranking.

There is no shuffle but for the document frequencies (one row for each licence
word and task); all else happens inside the document's row, so neither a
licence that a third of all files carry nor a very long file gathers rows.

Defined results: null and empty texts have no words, no places and score 0;
equal rows get equal rows; an empty table gives an empty result; other columns
pass through ``license_scan`` unless they carry a result's name.

Words: A-Z lower-cased, then runs of digits, a-z and code points past ASCII.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm.common import table

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases of the base result and their labels.
BASE_PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Label, template, mandatory key phrases.
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("hereby granted free of charge", "person obtaining a copy")),
    ("apache", "licensed under the apache license version 2 0", ("apache license",)),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at", ("in compliance with the license",)),
    ("gpl", "this work is licensed under the gnu general public license version 3", ("general public license",)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("free software", "gnu general public license")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("source and binary forms", "conditions are met")),
    ("mpl", "this source code form is subject to the terms of the mozilla public license", ("mozilla public license",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("this software for any purpose", "hereby granted")),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software", "public domain")),
    ("cc", "this work is licensed under a creative commons attribution license", ("creative commons",)),
)
#: Words that are not indexed.
FUNCTION_WORDS = frozenset("a an and any are as at by can following for form forms in is it may met not of on or that the this to under use with without work you".split())
#: Words of each template to look up.
RARE = 12
NEAR = 4
#: A start is packed with its template into one number: template * TEMPLATE + SHIFT + start.
TEMPLATE, SHIFT = 1 << 40, 1 << 20
LEAST_SHARE = 0.6


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, for texts that are then compared with ASCII words only.

    lower() also changes other letters, which alters no ASCII word; the two
    code points whose lower case has ASCII letters take the slower way.
    """
    risky = F.contains(text, F.lit("İ")) | F.contains(text, F.lit("K"))
    return F.when(risky, F.translate(text, string.ascii_uppercase, string.ascii_lowercase)).otherwise(F.lower(text))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORDS), F.lit(0))


def _texts(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _vocabulary(templates, base_phrases) -> list[str]:
    texts = [t for _, t, _ in templates] + [p for p, _ in base_phrases]
    return sorted({w for t in texts for w in t.split()} - FUNCTION_WORDS)


def rarity(docs: DataFrame, vocabulary: list[str]) -> dict[str, float]:
    """Inverse document frequency of each licence word over all documents."""
    seen = docs.select(F.explode(F.array_intersect(words_of(F.col("text")), _texts(vocabulary))).alias("word"))
    counts = {r.word: r.n for r in seen.groupBy("word").agg(F.count("*").alias("n")).collect()}
    total = docs.count()
    return {w: math.log((total + 1) / (counts.get(w, 0) + 0.5)) for w in vocabulary}


def license_scan(docs: DataFrame, templates=TEMPLATES, base_phrases=BASE_PHRASES, rare: int = RARE) -> DataFrame:
    """docs with n_words, n_base, first_word, last_word, base_labels, labels, score and found.

    found holds (template, start, share) of each verified place.  The text stays
    only if it is among the columns of docs, as it must be.
    """
    vocabulary = _vocabulary(templates, base_phrases)
    idf = rarity(docs, vocabulary)
    postings = {
        w: [(t, i) for t, (_, text, _) in enumerate(templates) for i, x in enumerate(text.split()) if x == w]
        for w in vocabulary
    }
    by_rarity = [sorted(set(text.split()) & set(vocabulary), key=lambda w: (-idf[w], w)) for _, text, _ in templates]
    postings_map = F.create_map(
        *[
            x
            for w in vocabulary
            if postings[w]
            for x in (F.lit(w), F.array(*[F.lit(t * TEMPLATE + SHIFT - i).cast("bigint") for t, i in postings[w]]))
        ]
    )
    template_words = F.array(*[_texts(text.split()) for _, text, _ in templates])
    key_phrases = F.array(*[_texts(keys) for _, _, keys in templates])
    template_labels = _texts([label for label, _, _ in templates])

    results = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "found")
    clean = docs.drop(*results)
    tokens = clean.withColumn("__words", words_of(F.col("text")))
    present = tokens.withColumn("__present", F.array_intersect("__words", _texts(vocabulary)))

    words, n = F.col("__words"), F.size("__words")
    places = F.sequence(F.lit(0), n - 1)

    def base_starts(phrase: str) -> Column:
        parts = phrase.split()
        has = F.lit(True)
        for p in parts:
            has = has & F.array_contains("__present", p)

        def here(i):
            same = F.lit(True)
            for k, p in enumerate(parts):
                same = same & F.get(words, i + k).eqNullSafe(F.lit(p))
            return same

        return F.when(has, F.filter(places, here)).otherwise(F.array().cast("array<int>"))

    def starts_of(word):
        at = F.filter(places, lambda i: F.get(words, i) == word)
        return F.flatten(
            F.transform(at, lambda i: F.transform(postings_map[word], lambda p: i.cast("bigint") + p))
        )

    looked_up = F.array_distinct(
        F.flatten(F.array(*[F.slice(F.array_intersect(_texts(own), F.col("__present")), 1, rare) for own in by_rarity if own]))
    )
    # A start counts once for a word, however many places of the word point to it; starts of two words stand twice.
    starts = F.sort_array(F.flatten(F.transform(looked_up, lambda w: F.array_distinct(starts_of(w)))))
    agreed = F.array_distinct(F.filter("__starts", lambda x, i: F.get(F.col("__starts"), i + 1) == x))

    def judged(packed):
        at = F.floor(packed / F.lit(TEMPLATE)).cast("int")
        c = {"template": at, "start": (packed - at.cast("bigint") * F.lit(TEMPLATE) - F.lit(SHIFT)).cast("int")}
        text = F.element_at(template_words, c["template"] + 1)
        begin = F.greatest(c["start"] - NEAR, F.lit(0))
        near = F.concat(F.lit(" "), F.array_join(F.slice(words, begin + 1, F.size(text) + 2 * NEAR), " "), F.lit(" "))
        same = F.filter(F.sequence(F.lit(0), F.size(text) - 1), lambda k: F.get(words, c["start"] + k) == F.get(text, k))
        verified = F.forall(F.element_at(key_phrases, c["template"] + 1), lambda p: F.contains(near, F.concat(F.lit(" "), p, F.lit(" "))))
        share = F.size(same).cast("double") / F.size(text)
        return F.struct(c["template"].alias("template"), c["start"].alias("start"), F.when(verified, share).otherwise(F.lit(0.0)).alias("share"))

    out = present.withColumn("__bases", F.array(*[base_starts(p) for p, _ in base_phrases]))
    out = out.withColumn("__starts", F.when(F.size("__present") > 1, starts))
    out = out.withColumn("__agreed", F.when(F.size("__starts") > 1, agreed).otherwise(F.array().cast("array<bigint>")))
    out = out.withColumn("found", F.filter(F.transform("__agreed", judged), lambda c: c["share"] >= LEAST_SHARE))
    base_named = F.flatten(
        F.array(*[F.when(F.size(F.get("__bases", F.lit(i))) > 0, F.array(F.lit(label))).otherwise(F.array().cast("array<string>")) for i, (_, label) in enumerate(base_phrases)])
    )
    method_named = F.transform("found", lambda c: F.element_at(template_labels, c["template"] + 1))
    every = F.flatten("__bases")
    return (
        out.withColumn("n_words", n.cast("bigint"))
        .withColumn("n_base", F.size(every).cast("bigint"))
        .withColumn("first_word", F.array_min(every).cast("bigint"))
        .withColumn("last_word", F.array_max(every).cast("bigint"))
        .withColumn("base_labels", F.array_join(F.array_sort(F.array_distinct(base_named)), ","))
        .withColumn("labels", F.array_join(F.array_sort(F.array_distinct(F.concat(base_named, method_named))), ","))
        .withColumn(
            "score",
            F.when(F.size(every) > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("found", lambda c: c["share"])), F.lit(0.0))),
        )
        .drop("__words", "__present", "__bases", "__starts", "__agreed")
    )


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = license_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scanned.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
