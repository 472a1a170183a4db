"""Licence scans by a positional rare-token index, in DataFrame functions alone.

Words are runs of characters other than ASCII marks and white space, A-Z lower-cased.  A template is a notice or a passage
of a licence; its words are indexed by place.  The number of documents that hold each template word is counted over the
whole table, and every template is represented by its ``RARE`` words of highest IDF.  In a file, every word of the index is
looked up wherever it stands; each posting votes, with its IDF, for the place where the template would have to begin.
A template that gathers ``SHARE`` of its IDF at one place is a candidate, and its label is reported if each of its mandatory
key phrases stands in the text.  So a template that stands in the text word by word is found, however many others do.

What is broadcast is the index of the templates: some 250 postings, whatever the corpus.  Nothing is shuffled but
the document counts of the template words.  A file is read once for the counts and once for the scan.

Defined results: null and empty text have no word (counts 0, null places, no label, score 0); a very long text is
scanned whole; repeated rows give repeated results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str) -> list[str]:
    return re.sub(_GAP, " ", text.translate(str.maketrans(_UPPER, _LOWER))).split()

# The base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Fixed values: (label, notice or passage, phrases that must stand in the text).
NOTICES = [
    ("afl-3.0", "Licensed under the Academic Free License version 3.0", ["academic free license version 3 0"]),
    ("agpl-3.0", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or", ["gnu affero general public license"]),
    ("agpl-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", ["gnu affero general public license version 3"]),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ["apache license version 2 0"]),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", ["apache org licenses license 2 0"]),
    ("apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION", ["apache license version 2 0 january 2004"]),
    ("apache-2.0", "SPDX-License-Identifier: Apache-2.0", ["spdx license identifier apache 2 0"]),
    ("artistic-2.0", "The Artistic License 2.0 Copyright (c) 2000-2006, The Perl Foundation.", ["the artistic license 2 0"]),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that", ["redistribution and use in source and binary forms"]),
    ("bsd-3-clause", "may be used to endorse or promote products derived from this software without specific prior written permission", ["redistribution and use in source and binary forms", "endorse or promote products derived from this software"]),
    ("bsd-3-clause", "SPDX-License-Identifier: BSD-3-Clause", ["spdx license identifier bsd 3 clause"]),
    ("bsl-1.0", "Distributed under the Boost Software License, Version 1.0.", ["boost software license version 1 0"]),
    ("bsl-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ["any person or organization obtaining a copy of the software"]),
    ("cc-by-4.0", "licensed under CC BY 4.0", ["cc by 4 0"]),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", ["creative commons attribution 4 0 international license"]),
    ("cc-by-nc-4.0", "licensed under CC BY-NC 4.0", ["cc by nc 4 0"]),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ["creative commons attribution noncommercial 4 0"]),
    ("cc-by-sa-4.0", "licensed under CC BY-SA 4.0", ["cc by sa 4 0"]),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ["creative commons attribution sharealike 4 0"]),
    ("cc0-1.0", "has waived all copyright and related or neighboring rights to this work", ["related or neighboring rights"]),
    ("cc0-1.0", "has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law", ["dedicated the work to the public domain"]),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", ["eclipse public license 2 0"]),
    ("epl-2.0", "under the terms of the Eclipse Public License v. 2.0 which is available at", ["eclipse public license v 2 0"]),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2", ["gnu general public license version 2"]),
    ("gpl-2.0", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version", ["gnu general public license as published by the free software foundation either version 2 of the license"]),
    ("gpl-2.0", "under the terms of the GNU General Public License version 2 as published by the Free Software Foundation", ["gnu general public license version 2 as published by"]),
    ("gpl-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc.", ["gnu general public license version 2"]),
    ("gpl-2.0", "GNU GENERAL PUBLIC LICENSE Version 2", ["gnu general public license version 2"]),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3", ["gnu general public license version 3"]),
    ("gpl-3.0", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", ["gnu general public license as published by the free software foundation either version 3 of the license"]),
    ("gpl-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc.", ["gnu general public license version 3"]),
    ("gpl-3.0", "GNU GENERAL PUBLIC LICENSE Version 3", ["gnu general public license version 3"]),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee is hereby granted"]),
    ("lgpl", "under the terms of the GNU Lesser General Public License", ["gnu lesser general public license"]),
    ("lgpl", "GNU LESSER GENERAL PUBLIC LICENSE Version", ["gnu lesser general public license version"]),
    ("mit-notice", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", ["permission is hereby granted free of charge"]),
    ("mit-notice", "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so", ["sublicense and or sell copies of the software"]),
    ("mit-reference", "released under the MIT license", ["mit license"]),
    ("mit-reference", "licensed under the MIT license", ["mit license"]),
    ("mit-reference", "SPDX-License-Identifier: MIT", ["spdx license identifier mit"]),
    ("mpl-2.0", "subject to the terms of the Mozilla Public License, v. 2.0", ["mozilla public license"]),
    ("mpl-2.0", "Mozilla Public License Version 2.0", ["mozilla public license version 2 0"]),
    ("ofl-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1.", ["sil open font license version 1 1"]),
    ("proprietary", "Copyright. All rights reserved.", ["all rights reserved"]),
    ("unlicense", "This is free and unencumbered software released into the public domain", ["unencumbered software released into the public domain"]),
    ("wtfpl", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE", ["you want to public license"]),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", ["authors be held liable for any damages arising from the use of this software"]),
]
#: (label, words, phrases), by number.
TEMPLATES = [(label, words_of(notice), phrases) for label, notice, phrases in NOTICES]
#: Words of highest IDF that stand for a template.
RARE = 6
#: Share of a template's IDF that must agree on one place.
SHARE = 0.7


def spaced(text: Column) -> Column:
    """The words of a text with a blank before and after each; one blank if there is none."""
    plain = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.regexp_replace(F.concat(F.lit(" "), plain, F.lit(" ")), _GAP, " ")


def _blanks(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")


def rare_words(docs: DataFrame, text: str = "text") -> list[dict[str, float]]:
    """Of each template, its RARE words of highest IDF over all documents (ties by word).  At most one row a template word comes to the driver."""
    vocabulary = sorted({w for _, notice, _ in TEMPLATES for w in notice})
    words = F.split(spaced(docs[text]), " ")
    counts = (
        docs.select(F.explode(F.concat(F.array(F.lit("")), F.array_intersect(words, F.array(*map(F.lit, vocabulary))))).alias("word"))
        .groupBy("word")
        .count()
    )
    seen = {r["word"]: r["count"] for r in counts.collect()}
    n = seen.get("", 0)  # one entry a document
    idf = {w: math.log((n + 1) / (seen.get(w, 0) + 1)) + 1e-6 for w in vocabulary}
    return [dict(sorted(((w, idf[w]) for w in set(notice)), key=lambda x: (-x[1], x[0]))[:RARE]) for _, notice, _ in TEMPLATES]


def _postings(rare: list[dict[str, float]]) -> dict[str, list[tuple[int, int, float]]]:
    """word -> (template, place in the template, IDF); the first place of each rare word."""
    out: dict[str, list[tuple[int, int, float]]] = {}
    for t, words in enumerate(rare):
        for w, idf in words.items():
            out.setdefault(w, []).append((t, TEMPLATES[t][1].index(w), idf))
    return out


def _any_of(words: list[str]) -> str:
    """A pattern of any of these words, branching at their first letter."""
    by_letter: dict[str, list[str]] = {}
    for w in words:
        by_letter.setdefault(w[0], []).append(w[1:])
    return "|".join(f"{first}(?:{'|'.join(sorted(rest, reverse=True))})" for first, rest in sorted(by_letter.items()))


def _candidates(words: Column, rare: list[dict[str, float]]) -> Column:
    """array of (template, share of its IDF that agrees on one place), shares of SHARE and more."""
    postings = _postings(rare)
    entries = [
        F.struct(F.lit(w).alias("key"), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(place).cast("long").alias("at"), F.lit(x).alias("x")) for t, place, x in p]).alias("value"))
        for w, p in sorted(postings.items())
    ]
    index = F.map_from_entries(F.array(*entries))
    indexed = F.array(*[F.lit(w) for w in sorted(postings)])
    totals = F.array(*[F.lit(sum(x.values())) for x in rare])
    placed = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.cast("long").alias("i"))), lambda p: F.array_contains(indexed, p["w"]))

    votes = F.flatten(
        F.transform(placed, lambda p: F.transform(F.element_at(index, p["w"]), lambda e: F.struct(e["t"].alias("t"), (p["i"] - e["at"]).alias("at"), e["x"].alias("x"))))
    )
    # Votes in order of template and place: a running sum, kept whenever it reaches the share.
    start = F.struct(F.lit(-1).alias("t"), F.lit(0).cast("long").alias("at"), F.lit(0.0).alias("x"), F.lit(None).cast("array<struct<t:int,share:double>>").alias("found"))

    def add(state: Column, vote: Column) -> Column:
        same = (state["t"] == vote["t"]) & (state["at"] == vote["at"])
        x = F.when(same, state["x"]).otherwise(F.lit(0.0)) + vote["x"]
        share = F.least(x / F.element_at(totals, vote["t"] + 1), F.lit(1.0))
        kept = F.coalesce(state["found"], F.array().cast("array<struct<t:int,share:double>>"))
        found = F.when(share >= SHARE - 1e-12, F.array_append(kept, F.struct(vote["t"].alias("t"), share.alias("share")))).otherwise(kept)
        return F.struct(vote["t"].alias("t"), vote["at"].alias("at"), x.alias("x"), found.alias("found"))

    return F.coalesce(F.aggregate(F.array_sort(votes), start, add)["found"], F.array().cast("array<struct<t:int,share:double>>"))


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (the largest share of a verified template)."""
    rare = rare_words(docs, text)
    words_of_index = sorted({w for x in rare for w in x})
    base = "|".join(BASE)
    back = "|".join(x[::-1] for x in BASE)
    rows = docs.select(docs[doc_id].alias("doc_id"), spaced(docs[text]).alias("s"))
    rows = rows.withColumn("n_words", F.greatest(_blanks(F.col("s")) - 1, F.lit(0).cast("long")))
    rows = rows.withColumn("n_base", F.regexp_count("s", F.lit(f" (?:{base})(?= )")).cast("long"))
    turned = F.reverse("s")
    ends = F.regexp_instr(turned, F.lit(f" (?:{back})(?= )"))
    length = _blanks(F.regexp_extract(turned, f" ({back})(?= )", 1)) + 1
    has_base = F.col("n_base") > 0
    rows = rows.withColumns(
        {
            "first_word": F.when(has_base, _blanks(F.substr("s", F.lit(1), F.regexp_instr("s", F.lit(f" (?:{base})(?= )")))) - 1),
            "last_word": F.when(has_base, F.col("n_words") - (_blanks(F.substr(turned, F.lit(1), ends)) - 1) - length),
            "base": F.filter(F.array(*[F.when(F.contains("s", F.lit(f" {x} ")), F.lit(label)) for x, label in sorted(BASE.items(), key=lambda b: b[1])]), F.isnotnull),
        }
    )
    looked_up = F.rlike("s", F.lit(f" (?:{_any_of(words_of_index)}) "))
    rows = rows.withColumn("found", F.when(looked_up, _candidates(F.split(F.trim("s"), " "), rare)))
    phrases = F.array(*[F.array(*[F.lit(f" {p} ") for p in own]) for _, _, own in TEMPLATES])
    rows = rows.withColumn("found", F.filter("found", lambda f: F.forall(F.element_at(phrases, f["t"] + 1), lambda p: F.contains(F.col("s"), p))))
    labels = F.transform("found", lambda f: F.element_at(F.array(*[F.lit(label) for label, _, _ in TEMPLATES]), f["t"] + 1))
    none = F.array().cast("array<string>")
    return rows.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.concat_ws(",", "base").alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.array_distinct(F.concat("base", F.coalesce(labels, none))))).alias("labels"),
        F.round(F.coalesce(F.array_max(F.transform("found", lambda f: f["share"])), F.lit(0.0)), 6).alias("score"),
    )


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))
