"""License scans by a positional rare-token index, DataFrame functions only.

The templates are clauses of licence texts, each with a mandatory key phrase. One pass
over the corpus keeps each file's word count and the key phrases' words in it, and the
words themselves only of files that hold all words of some key phrase. The document
frequencies of these words over the whole corpus rank them. A file's postings are the
places of the ``PROBES`` words with the highest IDF of each template; a place minus the
word's place in the template is an offset, and only offsets that all of a template's
probes agree on are looked at: there the key phrase must stand, word by word, and the
share of the clause's words that stand in place is the match.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import Scratch, ascii_lower, table

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The phrases that are asked for, and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Clauses of public licence texts and notices as (label, clause, key phrase within it).
CLAUSES = (
    ("agpl", "GNU Affero General Public License", "Affero General Public License"),
    ("agpl", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "terms of the GNU Affero General Public License"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", "Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at", "except in compliance with the License"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.", "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND"),
    ("artistic-2.0", "This package is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0", "terms of the Artistic License"),
    ("boost-1.0", "Distributed under the Boost Software License, Version 1.0", "Boost Software License"),
    ("boost-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software", "accompanying documentation covered by this license"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Redistribution and use in source and binary forms"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Redistributions of source code must retain"),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", "Redistributions in binary form must reproduce"),
    ("bsd", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.", "COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS"),
    ("bsd-3", "may be used to endorse or promote products derived from this software without specific prior written permission", "endorse or promote products derived"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution", "Creative Commons Attribution"),
    ("cc-by-4.0", "Licensed under CC BY 4.0", "CC BY 4.0"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", "CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", "CC BY-SA 4.0"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "waived all copyright and related or neighboring rights"),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "Eclipse Public License"),
    ("gpl-2.0", "This work is licensed under the GNU General Public License version 2", "General Public License version 2"),
    ("gpl-2.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version", "either version 2 of the License"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License version 3", "General Public License version 3"),
    ("gpl-3.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "either version 3 of the License"),
    ("gpl-notice", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.", "distributed in the hope that it will be useful"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "copy, modify, and/or distribute this software"),
    ("lgpl", "GNU Lesser General Public License", "Lesser General Public License"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "terms of the GNU Lesser General Public License"),
    ("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so", "Permission is hereby granted, free of charge"),
    ("mit-text", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "included in all copies or substantial portions"),
    ("mit-text", "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.", "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", "Mozilla Public License"),
    ("ofl-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1", "SIL Open Font License"),
    ("unlicense", "This is free and unencumbered software released into the public domain.", "free and unencumbered software"),
    ("unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", "Anyone is free to copy, modify, publish, use, compile, sell"),
    ("wtfpl", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE", "YOU WANT TO PUBLIC LICENSE"),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "In no event will the authors be held liable"),
    ("zlib", "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.", "origin of this software must not be misrepresented"),
)
#: A clause gives its label if at least this share of its words stands in place; its key phrase always must.
ENOUGH = 0.6
#: The key phrase's words whose postings are intersected.
PROBES = 3


def _words(text: str) -> list[str]:
    return re.sub(GAP, " ", text.lower()).split()


def _templates() -> list[tuple[str, list[str], list[str], int]]:
    """(label, words, key phrase, the key phrase's place in the words)."""
    rows = [(label, phrase.split(), phrase.split()) for phrase, label in BASE.items()] + [(label, _words(clause), _words(key)) for label, clause, key in CLAUSES]
    return [(label, words, key, next(k for k in range(len(words)) if words[k : k + len(key)] == key)) for label, words, key in rows]


TEMPLATES = _templates()
KEY_WORDS = sorted({w for _, _, key, _ in TEMPLATES for w in key})


def probes(key: list[str], key_at: int, seen: dict[str, int]) -> list[tuple[str, int]]:
    """(word, place in the template) of the key phrase's words in the fewest documents, each word once; ties by place."""
    first = {w: k for k, w in reversed(list(enumerate(key)))}
    return [(w, key_at + k) for w, k in sorted(first.items(), key=lambda e: (seen.get(e[0], 0), e[1]))[:PROBES]]


def _offsets(key: list[str], key_at: int, chosen: list[tuple[str, int]]) -> Column:
    """Where in the file a template starts: the offsets that its probes' postings agree on and where its key phrase stands."""
    starts = lambda w, at: F.transform(F.filter("postings", lambda e: e["word"] == w), lambda e: e["place"] - at)
    offsets = [starts(w, at) for w, at in chosen]
    stands = lambda o: F.when(o + key_at >= 0, F.slice("words", o + key_at + 1, len(key)) == F.array(*map(F.lit, key))).otherwise(False)
    return F.filter(reduce(F.array_intersect, offsets), stands)


def _share(words: list[str], offsets: Column) -> Column:
    """The largest share of a template's words at one of the offsets; 0.0 without offsets."""
    listed = F.array(*map(F.lit, words))
    here = lambda o: F.size(F.filter(F.sequence(F.lit(0), F.lit(len(words) - 1)), lambda k: F.coalesce(F.get("words", o + k) == F.get(listed, k), F.lit(False))))
    return F.coalesce(F.array_max(F.transform(offsets, lambda o: here(o) / F.lit(float(len(words))))), F.lit(0.0))


def license_scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: a row a row of ``docs``.

    Null text is empty. Without a place, first_word and last_word are null;
    without a label, labels are empty. Places of a phrase may overlap, all count.
    score is the largest share of a template's words in place (base phrases are
    templates too), 0 if no key phrase stands. Ids (null, repeated) are carried along,
    each row for itself; other columns don't matter, whatever their names. Words with equal
    document frequencies are probed in the phrase's order, which changes no result. A text
    and its words must fit a task; only files with all words of a key phrase keep theirs.
    """
    scratch = Scratch(docs.sparkSession, "license")
    clean = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.trim(F.regexp_replace(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), GAP, " ")).alias("clean"))
    n_words = F.when(F.col("clean") == "", 0).otherwise(F.octet_length("clean") - F.octet_length(F.replace("clean", F.lit(" "), F.lit(""))) + 1)
    words = clean.select("doc_id", n_words.cast("long").alias("n_words"), F.split("clean", " ").alias("words"))
    found = words.withColumn("hits", F.array_intersect("words", F.array(*map(F.lit, KEY_WORDS))))
    holds = lambda key: reduce(lambda a, b: a & b, [F.array_contains("hits", w) for w in dict.fromkeys(key)])
    whole = reduce(lambda a, b: a | b, (holds(key) for _, _, key, _ in TEMPLATES))
    files = scratch.write(found.select("doc_id", "n_words", "hits", F.when(whole, F.col("words")).alias("words")), "files")
    seen = {r["word"]: r["n"] for r in files.select(F.explode("hits").alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}  # at most the key phrases' words

    chosen = [probes(key, at, seen) for _, _, key, at in TEMPLATES]
    rare = F.array_intersect("hits", F.array(*map(F.lit, sorted({w for c in chosen for w, _ in c}))))
    postings = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("place"))), lambda e: F.array_contains("rare", e["word"]))
    index = files.withColumn("rare", rare).withColumn("postings", postings)
    offsets = index.select("doc_id", "n_words", "words", *[F.when(holds(key), _offsets(key, at, c)).alias(f"o_{k}") for k, ((_, _, key, at), c) in enumerate(zip(TEMPLATES, chosen, strict=True))])
    out = offsets.select(
        "doc_id", "n_words",
        *[F.col(f"o_{k}").alias(f"base_{k}") for k in range(len(BASE))],
        F.array(*[F.struct(F.lit(label).alias("label"), _share(w, F.col(f"o_{k}")).alias("share")) for k, (label, w, _, _) in enumerate(TEMPLATES)]).alias("shares"),
    )
    every = F.flatten(F.array(*[F.coalesce(f"base_{k}", F.array().cast("array<int>")) for k in range(len(BASE))]))
    named = lambda a: F.coalesce(F.array_join(F.array_sort(F.array_distinct(a)), ","), F.lit(""))
    base_labels = F.filter(F.array(*[F.when(F.size(f"base_{k}") > 0, F.lit(label)) for k, label in enumerate(BASE.values())]), lambda x: x.isNotNull())
    labels = F.transform(F.filter("shares", lambda s: s["share"] >= ENOUGH), lambda s: s["label"])
    out = out.withColumn("places", every)
    return out.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"),
        named(base_labels).alias("base_labels"), named(labels).alias("labels"), F.coalesce(F.array_max(F.transform("shares", lambda s: s["share"])), F.lit(0.0)).alias("score"),
    )


def op4_license_scan(spark, sf_dir):
    return license_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _sql() -> str:
    listed = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    key_places = lambda key: f"(CASE WHEN contains(joined, ' {' '.join(key)} ') THEN list_filter(range(len(words)), lambda i: words[i + 1:i + {len(key)}] = {listed(key)}) ELSE [] END)"
    share = lambda words, key, at: (
        f"coalesce(list_max(list_transform({key_places(key)}, lambda i: len(list_filter(range({len(words)}), lambda k: i + k >= {at} AND words[i + k - {at} + 1] = {listed(words)}[k + 1])) / {float(len(words))}::DOUBLE)), 0.0)"
    )
    base = [key_places(p.split()) for p in BASE]
    shares = ", ".join(f"{{'label': '{label}', 'share': {share(words, key, at)}}}" for label, words, key, at in TEMPLATES)
    base_labels = ", ".join(f"CASE WHEN len({b}) > 0 THEN '{label}' END" for b, label in zip(base, BASE.values(), strict=True))
    return f"""
WITH v AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
w AS (SELECT *, ' ' || array_to_string(words, ' ') || ' ' AS joined FROM v),
s AS (SELECT doc_id, len(words)::BIGINT AS n_words, {" || ".join(base)} AS places, list_filter([{base_labels}], lambda x: x IS NOT NULL) AS bl, [{shares}] AS shares FROM w)
SELECT doc_id, n_words, len(places)::BIGINT AS n_base, list_min(places)::BIGINT AS first_word, list_max(places)::BIGINT AS last_word,
  array_to_string(list_sort(list_distinct(bl)), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_transform(list_filter(shares, lambda x: x.share >= {ENOUGH}), lambda x: x.label))), ',') AS labels,
  list_max(list_transform(shares, lambda x: x.share))::DOUBLE AS score
FROM s
"""


OP4_SQL = _sql()
