"""License scans by a positional rare-token index.

Templates (licence notices, one-line ones and whole ones) are indexed by word: word -> (template, position).  Each file is looked
up by its licence words of highest IDF, counted over all files, and by the words of key phrases that it has in full; a posting
and an occurrence name a template and a shift, and shifts that two of those words agree on are aligned with the template
word by word.  A template is found where its mandatory key phrase stands in place and words of at least ``SHARE`` of its
IDF weight do.  As the words of its key phrase are always looked up, and all words of a template whose key is a single word, no
file with many licences loses one.

All of it is expressions within a row: no shuffle but the word counts, of which the vocabulary's size reaches the
driver.  Rows without the words of any key phrase skip the alignment.

Defined results: null and empty texts have no words, places or labels and score 0; repeated rows are scanned each; texts of
any length are scanned whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

# fixed values: the phrases whose places are counted, and their labels
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    key: str  # must stand inside the text, in place

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def key_at(self) -> int:
        key, words = self.key.split(), self.words
        return next(i for i in range(len(words)) if words[i : i + len(key)] == key)


# fixed values: notices as their licences give them, without what the author fills in
MIT_TEXT = """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the
software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute
sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions
the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other
liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings
in the software"""
BSD_TEXT = """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the
documentation and or other materials provided with the distribution"""
ISC_TEXT = """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above
copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard
to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct
indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or
other tortious action arising out of or in connection with the use or performance of this software"""
APACHE_TEXT = """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a
copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under
the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific
language governing permissions and limitations under the license"""
GPL_TEXT = """this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the
free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be
useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public
license for more details you should have received a copy of the gnu general public license along with this program"""
MPL_TEXT = """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you
can obtain one at http mozilla org mpl 2 0"""
UNLICENSE_TEXT = """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or
distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"""
ZLIB_TEXT = """this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages
arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to
alter it and redistribute it freely subject to the following restrictions"""

TEMPLATES = [
    Template("mit", "released under the mit license", "mit license"),
    Template("mit", "licensed under the mit license", "mit license"),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        "permission is hereby granted free of charge",
    ),
    Template("apache", "licensed under the apache license version 2 0", "apache license"),
    Template("gpl", "licensed under the gnu general public license version 3", "gnu general public license"),
    Template("gpl", "redistribute it and or modify it under the terms of the gnu general public license", "gnu general public license"),
    Template("lgpl", "under the terms of the gnu lesser general public license", "lesser general public license"),
    Template("agpl", "under the terms of the gnu affero general public license", "affero general public license"),
    Template("mpl", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistribution and use in source and binary forms",
    ),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose", "permission to use copy modify"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    Template("mit", MIT_TEXT, "permission is hereby granted free of charge"),
    Template("bsd", BSD_TEXT, "redistribution and use in source and binary forms"),
    Template("isc", ISC_TEXT, "permission to use copy modify"),
    Template("apache", APACHE_TEXT, "apache license"),
    Template("gpl", GPL_TEXT, "gnu general public license"),
    Template("mpl", MPL_TEXT, "mozilla public license"),
    Template("unlicense", UNLICENSE_TEXT, "free and unencumbered software"),
    Template("zlib", ZLIB_TEXT, "provided as is without any express or implied warranty"),
]
RARE_WORDS = 8  # of a file's licence words are looked up
SHARE = 0.7
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words, with A-Z in lower case."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BREAKS), "")


def vocabulary(templates: list[Template]) -> list[str]:
    return sorted({w for t in templates for w in t.words} | {w for p, _ in BASE for w in p.split()})


def strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def place_of(words: Column, phrase: str) -> Column:
    """Where the phrase's words stand consecutively."""
    first, *others = phrase.split()

    def here(word: Column, at: Column) -> Column:
        found = word == first
        for i, other in enumerate(others, 1):
            found = found & F.get(words, at + i).eqNullSafe(F.lit(other))
        return F.when(found, at)

    return F.filter(F.transform(words, here), lambda x: x.isNotNull())


def idf(words: DataFrame, templates: list[Template]) -> dict[str, float]:
    """ln((1 + files) / (1 + files with the word)) of each licence word, over all files; a row per word comes back."""
    vocab = vocabulary(templates)
    seen = words.select(F.explode(F.concat(F.array(F.lit("")), F.array_intersect(strings(vocab), "words"))).alias("word"))
    counts = {r["word"]: r["count"] for r in seen.groupBy("word").count().collect()}
    files = counts.get("", 0)
    return {w: math.log((1 + files) / (1 + counts.get(w, 0))) + 1e-9 for w in vocab}


def has(words: tuple[str, ...]) -> Column:
    """Whether a file has all these words."""
    out = F.lit(True)
    for w in words:
        out = out & F.array_contains("present", w)
    return out


def aligned(words: Column, present: Column, templates: list[Template], weight: dict[str, float]) -> Column:
    """array<struct<label, share>> of the templates found in place."""
    keys = sorted({tuple(sorted(set(t.key.split()))) for t in templates})
    vocab = vocabulary(templates)
    weights = F.create_map(*[F.lit(x) for w in vocab for x in (w, weight[w])])
    postings = F.create_map(
        *[
            x
            for w in vocab
            for x in (
                F.lit(w),
                F.array(*[F.struct(F.lit(t).alias("t"), F.lit(q).alias("q")) for t, y in enumerate(templates) for q, z in enumerate(y.words) if z == w])
                if any(w in y.words for y in templates)
                else F.array().cast("array<struct<t: int, q: int>>"),
            )
        ]
    )
    book = F.array(
        *[
            F.struct(
                F.lit(t.label).alias("label"),
                strings(t.words).alias("words"),
                F.lit(t.key_at).alias("key_at"),
                F.lit(t.key_at + len(t.key.split())).alias("key_end"),
                F.lit(sum(weight[w] for w in t.words)).alias("total"),
            )
            for t in templates
        ]
    )
    ranked = F.array_sort(F.transform(present, lambda w: F.struct((-weights[w]).alias("first"), w.alias("word"))))
    rare = F.transform(F.slice(ranked, 1, RARE_WORDS), lambda s: s["word"])
    none = F.array().cast("array<string>")
    always = [F.when(has(k), strings(list(k))).otherwise(none) for k in keys]
    # a key of one word gives a shift that nothing else confirms, unless the template's other words are looked up too
    alone = [(tuple(set(t.key.split())), sorted(set(t.words))) for t in templates if len(set(t.key.split())) == 1]
    always += [F.when(has(k), F.array_intersect(strings(w), present)).otherwise(none) for k, w in alone]
    rare = F.array_distinct(F.concat(rare, *always))
    single = F.array(*[F.lit(i) for i, t in enumerate(templates) if len(t.words) == 1]).cast("array<int>")
    spots = F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("at")))

    def within(rare: Column) -> Column:
        hits = F.filter(spots, lambda s: F.array_contains(rare, s["word"]))
        shifts = F.array_sort(
            F.flatten(
                F.transform(hits, lambda s: F.transform(postings[s["word"]], lambda p: F.struct(p["t"].alias("t"), (s["at"] - p["q"]).alias("shift"))))
            )
        )
        return F.transform(F.array(shifts), agreed)[0]

    def agreed(shifts: Column) -> Column:
        # sorted, so a shift that two words name has an equal neighbour; a template of one word has no second
        twice = F.array_distinct(F.filter(shifts, lambda s, i: s.eqNullSafe(F.get(shifts, i + 1)) | F.array_contains(single, s["t"])))
        return F.filter(F.transform(twice, scored), lambda s: s.isNotNull())

    def scored(s: Column) -> Column:
        def compare(t: Column) -> Column:
            same = F.transform(t["words"], lambda w, q: F.get(words, s["shift"] + q).eqNullSafe(w))
            in_place = F.transform(t["words"], lambda w, q: F.when(F.get(words, s["shift"] + q).eqNullSafe(w), weights[w]).otherwise(0.0))
            share = F.aggregate(in_place, F.lit(0.0), lambda a, x: a + x) / t["total"]
            key = F.forall(F.slice(same, t["key_at"] + 1, t["key_end"] - t["key_at"]), lambda x: x)
            found = F.struct(t["label"].alias("label"), F.least(share, F.lit(1.0)).alias("share"))
            return F.when(key & (share >= SHARE), found)

        return F.transform(F.array(F.get(book, s["t"])), compare)[0]

    return F.transform(F.array(rare), within)[0]


def scan(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", templates: list[Template] | None = None) -> DataFrame:
    """Per document row: id, n_words, n_base, first_word, last_word, base_labels, labels (sorted arrays), score."""
    templates = TEMPLATES if templates is None else templates
    read = documents.select(F.col(doc_id).alias("id"), words_of(F.col(text).cast("string")).alias("words"))
    weight = idf(read, templates)
    rows = read.withColumn("present", F.array_intersect(strings(vocabulary(templates)), "words"))
    keys = sorted({tuple(sorted(set(t.key.split()))) for t in templates} | {tuple(sorted(set(p.split()))) for p, _ in BASE})
    maybe = has(keys[0])
    for k in keys[1:]:
        maybe = maybe | has(k)
    places = F.array(
        *[
            F.struct(F.lit(label).alias("label"), F.when(has(tuple(p.split())), place_of(F.col("words"), p)).otherwise(F.array().cast("array<int>")).alias("at"))
            for p, label in BASE
        ]
    )
    none = F.array().cast("array<struct<label: string, share: double>>")
    rows = rows.select(
        "id",
        F.size("words").cast("long").alias("n_words"),
        places.alias("places"),
        F.when(maybe, aligned(F.col("words"), F.col("present"), templates, weight)).otherwise(none).alias("found"),
    )
    at = F.flatten(F.transform("places", lambda p: p["at"]))
    base = F.array_sort(F.transform(F.filter("places", lambda p: F.size(p["at"]) > 0), lambda p: p["label"]))
    rows = rows.select("id", "n_words", at.alias("at"), base.alias("base_labels"), "found")
    best = F.coalesce(F.array_max(F.transform("found", lambda f: f["share"])), F.lit(0.0))
    return rows.select(
        "id",
        "n_words",
        F.size("at").cast("long").alias("n_base"),
        F.array_min("at").cast("long").alias("first_word"),
        F.array_max("at").cast("long").alias("last_word"),
        "base_labels",
        F.array_sort(F.array_union("base_labels", F.transform("found", lambda f: f["label"]))).alias("labels"),
        F.when(F.size("at") > 0, F.lit(1.0)).otherwise(best).alias("score"),
    )
