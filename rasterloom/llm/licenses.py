"""Licence scan by a positional rare-token index, with DataFrame functions only.

The index holds the words of licence notices with their places. One pass over the texts keeps, for each file, the places
of index words, the base phrases and the notices' key phrases. Words are ranked by their document frequencies over all
files. A notice is looked up by the word of highest IDF in its mandatory key phrase: without it there is no such phrase,
so no other word can find more. Each place of that word gives the notice a shift. Where the key phrase stands at that
shift, word for word, all the notice's postings are held against the file's places there, and it is confirmed if several
agree. The score is the share of the notice's IDF that does.

Nulls and edges: a null text is empty; a file without words has no places, no labels and score 0; null ids and
repeated rows are kept, each row on its own; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import materialise
from rasterloom.llm.decontam import tokens

# Base phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
# Notices as (label, mandatory key phrase, words). Public licence texts, lower case.
NOTICES = (
    ("mit", "mit license", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "apache license version 2 0", "licensed under the apache license version 2 0"),
    ("apache", "in compliance with the license", "you may not use this file except in compliance with the license"),
    ("gpl", "gnu general public license", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "gnu general public license", "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("cc-by-nc", "cc by nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "attribution noncommercial", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "for any purpose with or without fee", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mit", "this permission notice shall be included", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "warranties of merchantability fitness for a particular purpose and noninfringement", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("bsd", "redistributions of source code must retain", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "endorse or promote products derived from this software", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("apache", "unless required by applicable law or agreed to in writing software", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("gpl", "distributed in the hope that it will be useful", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl", "received a copy of the gnu general public license", "you should have received a copy of the gnu general public license along with this program"),
    ("lgpl", "gnu lesser general public license", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "gnu affero general public license", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("isc", "author disclaims all warranties with regard to this software", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("mpl", "copy of the mpl was not distributed with this file", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("unlicense", "free and unencumbered software", "this is free and unencumbered software released into the public domain"),
    ("zlib", "in no event will the authors be held liable", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("bsl", "boost software license", "distributed under the boost software license version 1 0"),
    ("cc0", "cc0 1 0 universal", "creative commons cc0 1 0 universal public domain dedication"),
    ("cc-by", "creative commons attribution 4 0 international", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "attribution sharealike", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
)
# Words of the notices that are too common to look up.
COMMON = ("a", "and", "any", "are", "as", "by", "for", "in", "is", "it", "may", "not", "of", "or", "that", "the", "this", "to", "under", "with", "you")
#: How many index words must agree on a shift.
AGREE = 3


def postings() -> list[tuple[int, str, int]]:
    """(notice, word, place)."""
    return [(i, w, at) for i, (_, _, text) in enumerate(NOTICES) for at, w in enumerate(text.split()) if w not in COMMON]


def _key(i: int) -> tuple[int, list[str]]:
    """The place of a notice's key phrase in it, and its words."""
    words, key = NOTICES[i][2].split(), NOTICES[i][1].split()
    return next(at for at in range(len(words)) if words[at : at + len(key)] == key), key


def _phrase(words: str, at: Column, phrase: list[str]) -> Column:
    """The phrase's words stand in the column `words` from place `at` on."""
    here = at >= 0
    for i, w in enumerate(phrase):
        here = here & F.coalesce(F.get(words, F.greatest(at, F.lit(0)) + i) == w, F.lit(False))
    return here


def _stands(phrase: list[str], lead: int = 0):
    return lambda i: _phrase("words", i - lead, phrase)


def _keyed(key: int):
    return lambda i: F.struct(F.lit(key).alias("key"), i.alias("at"))


def _back(lead: int):
    return lambda i: i - lead


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, places, base_labels, labels, score): places of base phrases; labels of base and confirmed notices."""
    spark = docs.sparkSession
    vocabulary = sorted({w for _, w, _ in postings()})
    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("t"))
    split = plain.select("doc_id", F.explode(F.array(tokens("t"))).alias("words"))
    n = F.size("words")
    at = F.when(n > 0, F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get("words", i).isin(vocabulary))).otherwise(F.array().cast("array<int>"))
    seen = split.select("doc_id", "words", F.explode(F.array(at)).alias("at"))
    base = [F.filter("at", _stands(p.split())) for p, _ in BASE]
    # A key phrase begins at an index word or at a common one; either way its notice's shift tells where.
    keys = sorted({tuple(k) for _, k in map(_key, range(len(NOTICES)))})
    lead = [next(j for j, w in enumerate(k) if w not in COMMON) for k in keys]
    held = [F.transform(F.filter("at", _stands(list(k), j)), _back(j)) for k, j in zip(keys, lead)]
    files = seen.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        *[b.alias(f"base{i}") for i, b in enumerate(base)],
        F.transform("at", lambda i: F.struct(i.alias("at"), F.get("words", i).alias("word"))).alias("hits"),
        F.flatten(F.array(*[F.transform(h, _keyed(k)) for k, h in enumerate(held)])).alias("keys"),
    )
    files, _ = materialise(files.withColumn("file", F.monotonically_increasing_id()), "files")

    hits = files.select("file", F.explode("hits").alias("h")).select("file", "h.word", "h.at")
    words = hits.select("file", "word").distinct()
    frequency = words.groupBy("word").agg(F.count("*").alias("df"))  # no more rows than the index has words
    total = files.agg(F.count("*").alias("n"))
    weight = F.broadcast(frequency.crossJoin(F.broadcast(total)).select("word", F.log((F.col("n") + 1) / F.col("df")).alias("idf")))
    index = spark.createDataFrame(postings(), "notice int, word string, place int")
    in_index = index.select("notice", "word").distinct().join(weight, "word", "left").groupBy("notice").agg(F.sum(F.coalesce("idf", F.lit(0.0))).alias("full"), F.count("*").alias("n_index"))
    places = [(i, keys.index(tuple(k)), p) for i, (p, k) in enumerate(map(_key, range(len(NOTICES))))]
    need = spark.createDataFrame([(*p, NOTICES[p[0]][0]) for p in places], "notice int, key int, place int, label string").join(in_index, "notice")
    # Of each notice, the rarest word of its key phrase; a word that no file has is the rarest of all.
    of_keys = spark.createDataFrame([(i, w, at) for i, (p, k) in enumerate(map(_key, range(len(NOTICES)))) for at, w in enumerate(NOTICES[i][2].split()) if p <= at < p + len(k) and w not in COMMON], "notice int, word string, place int")
    ranked = of_keys.join(weight, "word", "left").groupBy("notice").agg(F.expr("max_by(struct(word, place), struct(coalesce(idf, double('infinity')), word, place))").alias("a"))
    shifts = hits.join(F.broadcast(ranked.select("notice", "a.word", "a.place")), "word").select("file", "notice", (F.col("at") - F.col("place")).alias("shift"))
    key = files.select("file", F.explode("keys").alias("k")).select("file", "k.key", F.col("k.at").alias("key_at"))
    stands = key.join(F.broadcast(need.select("notice", "key", F.col("place").alias("key_place"))), "key").select("file", "notice", (F.col("key_at") - F.col("key_place")).alias("shift")).distinct()
    shifts = shifts.join(stands, ["file", "notice", "shift"])
    due = shifts.join(F.broadcast(index), "notice").select("file", "notice", "shift", "word", (F.col("shift") + F.col("place")).alias("at"))
    agree = due.join(hits, ["file", "word", "at"]).join(weight, "word")
    found = agree.groupBy("file", "notice", "shift", "word").agg(F.first("idf").alias("idf")).groupBy("file", "notice", "shift").agg(F.count("*").alias("n"), F.sum("idf").alias("idf"))
    confirmed = found.join(F.broadcast(need), "notice").where(F.col("n") >= F.least(F.lit(AGREE), F.col("n_index")))
    share = F.when(F.col("full") > 0, F.least(F.lit(1.0), F.col("idf") / F.col("full"))).otherwise(F.lit(0.0))
    named = confirmed.groupBy("file").agg(F.collect_set("label").alias("confirmed"), F.max(share).alias("score"))

    places = F.concat(*[f"base{i}" for i in range(len(BASE))])
    labels = F.array_compact(F.array(*[F.when(F.size(f"base{i}") > 0, F.lit(l)) for i, (_, l) in enumerate(BASE)]))
    out = files.join(named, "file", "left").select("doc_id", "n_words", F.array_sort(places).alias("places"), F.array_sort(labels).alias("base_labels"), F.coalesce("confirmed", F.array().cast("array<string>")).alias("confirmed"), F.coalesce("score", F.lit(0.0)).alias("score"))
    return out.select("doc_id", "n_words", "places", "base_labels", F.array_sort(F.array_union("base_labels", "confirmed")).alias("labels"), "score")
