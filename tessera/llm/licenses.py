"""License scans by a positional index of rare words, in DataFrame functions only.

1. Every text becomes words (digits, letters and characters beyond ASCII,
   A-Z in lower case). Document frequencies of the license vocabulary over all
   documents give each word's IDF.
2. Each template (a paragraph of a license) has up to ``RARE`` words of highest
   IDF. A file that holds all words of a template's key phrase looks up those of
   them that it has in the template's postings. Postings that agree on the
   relative position support one placement. Every template is looked up for
   itself, so no template's words crowd out those of another.
3. A placement counts if the template's key phrase stands where it has to. Its
   score is the share found in place of the IDF of the template's rare words,
   whether the file has them or not. Equal scores all count.

Base phrases are counted at all places and always give their label. Null
counts as empty: no words and no labels. Texts are scanned whole, whatever
their length. Words of equal IDF are ranked by code point. Every row has its
own result, also with repeated or null ids. An empty table gives no rows.
Further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialize

#: Rare words of each template; every occurrence of them in a file is used.
RARE = 16
LEAST_SCORE = 0.6

# Base phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
# Paragraphs and notices of well-known licenses, as label, words, and the key phrase that has to be there.
TEMPLATES = (
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "permission is hereby granted"),
    ("apache", "licensed under the apache license version 2 0", "apache license"),
    ("apache", "you may not use this file except in compliance with the license", "except in compliance with the license"),
    ("gpl", "this work is licensed under the gnu general public license version 3", "gnu general public license"),
    ("gpl", "under the terms of the gnu general public license as published by the free software foundation", "gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
    ("mit", "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions", "modify merge publish distribute sublicense"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "all copies or substantial portions of the software"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "unless required by applicable law or agreed to in writing"),
    ("apache", "see the license for the specific language governing permissions and limitations under the license", "governing permissions and limitations under the license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "gnu general public license as published"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", "gnu affero general public license"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistributions of source code must retain"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "redistributions in binary form must reproduce"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "endorse or promote products derived from this software"),
    ("mpl", "if a copy of the mpl was not distributed with this file you can obtain one at", "copy of the mpl was not distributed"),
    ("isc", "provided that the above copyright notice and this permission notice appear in all copies", "permission notice appear in all copies"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", "anyone is free to copy modify publish use compile"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "in no event will the authors be held liable"),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", "alter it and redistribute it freely"),
    ("boost", "distributed under the boost software license version 1 0", "boost software license"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", "eclipse public license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "waived all copyright and related or neighboring rights"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0 international"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial"),
)

_VOCABULARY = sorted({w for _, words, _ in TEMPLATES for w in words.split()})


def words(text: Column) -> Column:
    """The words of a text, A-Z in lower case."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), ascii_uppercase, ascii_lowercase), F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), 1)


def _array(values: list[str]) -> Column:
    return F.array(*(F.lit(v) for v in values))


def _base_places(words_col: str) -> Column:
    """(at, size, label) of every place of a base phrase."""
    w = F.col(words_col)

    def at(x: Column, i: Column) -> Column:
        out = F.lit(None).cast("struct<at: int, size: int, label: string>")
        for phrase, label in BASE:
            parts = phrase.split()
            same = x == parts[0]
            for k, part in enumerate(parts[1:], 1):
                same = same & F.coalesce(F.get(w, i + k) == part, F.lit(False))
            out = F.when(same, F.struct(i.alias("at"), F.lit(len(parts)).alias("size"), F.lit(label).alias("label"))).otherwise(out)
        return out

    return F.array_compact(F.transform(w, at))


def _postings(spark) -> DataFrame:
    """(word, template, label, place, key_at, key) of every word of every template."""
    rows = []
    for t, (label, text, key) in enumerate(TEMPLATES):
        parts, key_parts = text.split(), key.split()
        key_at = next(i for i in range(len(parts)) if parts[i : i + len(key_parts)] == key_parts)
        rows += [(w, t, label, i, key_at, key_parts) for i, w in enumerate(parts)]
    return F.broadcast(spark.createDataFrame(rows, "word string, template int, label string, place int, key_at int, key array<string>"))


def _looked_up(spark, frequency: DataFrame, total: int) -> DataFrame:
    """(template, key, asked, rare) of every template: its words of highest IDF as (idf, word), and the IDF of all their places."""
    places = spark.createDataFrame([(t, key.split(), w, n) for t, (_, text, key) in enumerate(TEMPLATES) for w, n in sorted(Counter(text.split()).items())], "template int, key array<string>, word string, n int")
    idf = F.log1p(F.lit(float(total)) / F.coalesce("df", F.lit(1)))
    ranked = places.join(frequency, "word", "left").groupBy("template", "key").agg(F.sort_array(F.collect_list(F.struct((-idf).alias("low"), "word", "n"))).alias("words"))
    rare = F.transform(F.slice("words", 1, RARE), lambda w: F.struct((-w["low"]).alias("idf"), w["word"].alias("word"), w["n"].alias("n")))
    asked = F.aggregate("rare", F.lit(0.0), lambda s, r: s + r["idf"] * r["n"])
    return F.broadcast(ranked.select("template", "key", rare.alias("rare")).select("template", "key", "rare", asked.alias("asked")))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_words, base (places), labels (of the method), placements (label, at, score) and score."""
    spark = docs.sparkSession
    split = docs.select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("words"))
    split = split.select("id", F.size("words").cast("long").alias("n_words"), F.array_intersect(_array(_VOCABULARY), "words").alias("known"), "words")
    # Only files with all words of some base or key phrase can have a place of one.
    phrases = F.array(*(_array(sorted(set(p.split()))) for p in sorted({p for p, _ in BASE} | {key for _, _, key in TEMPLATES})))
    possible = F.exists(phrases, lambda p: F.forall(p, lambda w: F.array_contains("known", w)))
    split = split.select("id", "n_words", "known", F.when(possible, F.col("words")).alias("words"))
    read = materialize(split.withColumn("row", F.monotonically_increasing_id()), "words")
    frequency = read.select(F.explode("known").alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    total = read.count()
    files = read.where(F.col("words").isNotNull())
    # A placement needs its key phrase, so a template lacking one of the key's words can't have any.
    held = files.select("row", "known").join(_looked_up(spark, frequency, total), F.size(F.array_except("key", "known")) == 0)
    lookups = held.select("row", "template", "asked", F.explode(F.filter("rare", lambda r: F.array_contains("known", r["word"]))).alias("r"))
    lookups = materialize(lookups.select("row", "template", "asked", "r.word", "r.idf"), "lookups")
    # Occurrences of the words looked up, with all postings of the templates that ask for them.
    wanted = lookups.groupBy("row").agg(F.collect_set("word").alias("wanted"))
    places = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("at"), w.alias("word"))), lambda o: F.array_contains("wanted", o["word"]))
    occurrences = files.join(wanted, "row").select("row", F.explode(places).alias("o")).select("row", "o.at", "o.word")
    supported = occurrences.join(lookups, ["row", "word"]).join(_postings(spark), ["template", "word"])
    supported = supported.groupBy("row", "template", "label", "key_at", "key", "asked", (F.col("at") - F.col("place")).alias("start")).agg(F.sum("idf").alias("found"))
    placed = supported.withColumn("score", F.col("found") / F.col("asked")).where(F.col("score") >= LEAST_SCORE)
    checked = placed.join(files.select("row", "words"), "row").where((F.col("start") + F.col("key_at") >= 0) & (F.slice("words", F.greatest(F.col("start") + F.col("key_at") + 1, F.lit(1)), F.size("key")) == F.col("key")))
    best = checked.groupBy("row").agg(F.sort_array(F.collect_set("label")).alias("labels"), F.sort_array(F.collect_list(F.struct("label", F.col("start").alias("at"), F.round("score", 6).alias("score")))).alias("placements"), F.max("score").alias("score"))
    placements = "array<struct<label: string, at: int, score: double>>"
    found = files.select("id", "row", "n_words", _base_places("words").alias("base")).join(best, "row", "left")
    columns = ["id", "n_words", "base", F.coalesce("labels", F.array().cast("array<string>")).alias("labels"), F.coalesce("placements", F.array().cast(placements)).alias("placements"), F.least(F.coalesce("score", F.lit(0.0)), F.lit(1.0)).alias("score")]
    none = read.where(F.col("words").isNull()).select("id", "n_words", F.array().cast("array<struct<at: int, size: int, label: string>>").alias("base"), F.array().cast("array<string>").alias("labels"), F.array().cast(placements).alias("placements"), F.lit(0.0).alias("score"))
    return found.select(*columns).unionByName(none).withColumnRenamed("id", id_col)
