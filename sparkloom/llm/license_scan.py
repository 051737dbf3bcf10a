"""License scans: a positional rare-token index over licence templates.

A template is a run of words with mandatory key phrases.  The index has, for each
template, the two words of its key phrases that are rarest in the corpus
(highest IDF over all documents), with their offsets: a posting is (template, offset).  As a match
needs all mandatory words, these are the highest-IDF licence words of any file that holds the template.
A file's words are looked up once, for all templates together; a hit turns its postings into
(template, start) pairs, the pairs of a template's first and second word are intersected, which leaves the starts
where both stand in their relative position, and each start left is verified word by word against the mandatory phrases
and scored by the share of template words that stand in place.  Templates are data, so their number and
length do not change the plan.  All steps are built-in array expressions over one row; the only
shuffle is the count of documents per licence word (a row per word and task).

Defined results: a null or wordless text has no words and no places; texts of any
length are scanned whole; a template may begin before a text does, if its key phrases are there; of two equal places of a label
both count; repeated rows are scanned alike; other columns are
ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm._rows import carry, fenced

#: Separators of words once A-Z are in lower case: all ASCII but digits and letters.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """A licence text as words; ``keys`` are (offset, count) runs that must stand there."""

    label: str
    words: tuple[str, ...]
    keys: tuple[tuple[int, int], ...]
    base: bool = False


def template(label: str, text: str, *keys: str, base: bool = False) -> Template:
    """A template from plain text; without ``keys`` all of it is mandatory."""
    words = text.split()
    runs = []
    for key in keys or (text,):
        part = key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(part)] == part)
        runs.append((at, len(part)))
    return Template(label, tuple(words), tuple(runs), base)


#: The three base phrases, then well-known licence wordings (fixed values: the licences' own words).
TEMPLATES: tuple[Template, ...] = (
    template("mit", "under the mit license", base=True),
    template("apache-2", "apache license version 2", base=True),
    template("cc-by-nc", "cc by nc", base=True),
    template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "hereby granted free of charge"),
    template("gpl-3", "gnu general public license version 3"),
    template("gpl-2", "gnu general public license version 2"),
    template("lgpl", "gnu lesser general public license"),
    template("agpl-3", "gnu affero general public license"),
    template("mpl-2", "mozilla public license version 2", "mozilla public license"),
    template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee", "permission to use copy modify"),
    template("unlicense", "free and unencumbered software released into the public domain", "unencumbered software"),
    template("cc-by", "creative commons attribution"),
    template("cc-by-sa", "cc by sa"),
    template("cc0", "cc0 public domain dedication", "cc0 public domain"),
    template("epl", "eclipse public license"),
    template("proprietary", "all rights reserved"),
    template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without "
        "restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software "
        "is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and "
        "noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from "
        "out of or in connection with the software or the use or other dealings in the software",
        "without restriction including without limitation the rights", "merge publish distribute sublicense",
    ),
    template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice "
        "appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
        "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action "
        "of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
        "for any purpose with or without fee", "the author disclaims all warranties",
    ),
    template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain "
        "the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the "
        "following disclaimer in the documentation and or other materials provided with the distribution",
        "redistribution and use in source and binary forms", "the following conditions are met",
    ),
    template(
        "apache-2",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org "
        "licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of "
        "any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
        "licensed under the apache license version 2", "except in compliance with the license",
    ),
    template(
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version "
        "3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of "
        "merchantability or fitness for a particular purpose see the gnu general public license for more details",
        "you can redistribute it and or modify it", "as published by the free software foundation",
    ),
    template(
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is "
        "granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
        "permission is granted to anyone to use this software", "alter it and redistribute it freely",
    ),
    template(
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or "
        "as a compiled binary for any purpose commercial or non commercial and by any means",
        "unencumbered software released into the public domain", "copy modify publish use compile sell or distribute",
    ),
    template(
        "boost-1",
        "boost software license version 1 0 permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by "
        "this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software",
        "boost software license version 1",
    ),
)


def words_of(text: Column) -> Column:
    """Words of a text with A-Z in lower case.

    ``lower`` also maps one letter beyond ASCII into it, the Kelvin sign; that
    letter is put out of reach first so that only A-Z change within ASCII.
    """
    plain = F.lower(F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("K"), F.lit("ĸ")))
    return F.array_remove(F.split(plain, BREAK), "")


def _mandatory(t: Template) -> dict[int, str]:
    return {i: t.words[i] for at, n in t.keys for i in range(at, at + n)}


def document_counts(df: DataFrame, text_col: str, templates: Sequence[Template]) -> dict[str, int]:
    """For each mandatory licence word the number of all documents that have it.

    The result has at most as many rows as the templates have words.
    """
    vocabulary = sorted({w for t in templates for w in _mandatory(t).values()})
    found = df.select(F.explode(F.array_intersect(words_of(F.col(text_col)), F.array(*map(F.lit, vocabulary)))).alias("w"))
    return dict.fromkeys(vocabulary, 0) | {r["w"]: r["n"] for r in found.groupBy("w").agg(F.count("*").alias("n")).collect()}


def _postings(templates: Sequence[Template], counts: dict[str, int]) -> dict[str, list[dict[str, int]]]:
    """Word to postings (template, offset, part): each template's two rarest mandatory words, or its only one twice."""
    out: dict[str, list[dict[str, int]]] = {}
    for n, t in enumerate(templates):
        offsets: dict[str, list[int]] = {}
        for i, w in _mandatory(t).items():
            offsets.setdefault(w, []).append(i)
        rare = sorted(offsets, key=lambda w: (counts.get(w, 0), w))
        for part, w in enumerate((rare[0], rare[min(1, len(rare) - 1)])):
            out.setdefault(w, []).extend({"t": n, "o": o, "part": part} for o in offsets[w])
    return out


def _constant(value: object, kind: str) -> Column:
    """A value as one folded literal, however large."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def scan(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", templates: Sequence[Template] = TEMPLATES, coverage: float = 0.6) -> DataFrame:
    """Per input row: id, word count and ``matches`` of (label, base, at, coverage)."""
    none = F.array().cast("array<struct<label:string,base:boolean,at:bigint,coverage:double>>")
    out = carry(df, __id=F.col(id_col), __words=words_of(F.col(text_col)))
    w = F.col("__words")
    if not templates:
        return out.select(F.col("__id").alias(id_col), F.size(w).cast("long").alias("n_words"), none.alias("matches"))
    postings = _postings(templates, document_counts(df, text_col, templates))
    rare = sorted(postings)
    told = [{"label": t.label, "base": t.base, "words": t.words, "must": sorted(_mandatory(t))} for t in templates]
    every = _constant(told, "array<struct<label:string,base:boolean,words:array<string>,must:array<int>>>")
    lists = _constant([postings[x] for x in rare], "array<array<struct<t:int,o:int,part:int>>>")
    words = _constant(rare, "array<string>")
    # Files without any of the index's words end here.
    looked_up = F.filter(F.transform(w, lambda x, i: F.struct(x.alias("w"), i.alias("at"))), lambda p: p["w"].isin(rare))
    out = out.withColumn("__hits", F.when(F.arrays_overlap(w, words), looked_up))
    pairs = F.flatten(
        F.transform("__hits", lambda h: F.transform(F.element_at(lists, F.array_position(words, h["w"]).cast("int")), lambda q: F.struct(q["part"].alias("part"), q["t"].alias("t"), (h["at"] - q["o"]).alias("at"))))
    )
    out = out.withColumn("__pairs", pairs).drop("__hits")
    part = lambda k: F.transform(F.filter("__pairs", lambda p: p["part"] == k), lambda p: F.struct(p["t"].alias("t"), p["at"].alias("at")))
    out = out.withColumn("__starts", F.when(F.size("__pairs") > 0, F.array_sort(F.array_intersect(part(0), part(1))))).drop("__pairs")
    t_of = lambda c: F.element_at(every, c["t"] + 1)
    must = lambda c: F.forall(t_of(c)["must"], lambda i: F.coalesce(F.get(w, c["at"] + i) == F.get(t_of(c)["words"], i), F.lit(False)))
    out = out.withColumn("__starts", F.filter("__starts", must))

    def told_of(c: Column) -> Column:
        t = t_of(c)
        there = F.size(F.filter(F.transform(t["words"], lambda x, i: F.coalesce(F.get(w, c["at"] + i) == x, F.lit(False))), lambda x: x))
        return F.struct(t["label"].alias("label"), t["base"].alias("base"), c["at"].cast("long").alias("at"), (there / F.size(t["words"])).alias("coverage"))

    good = F.filter(F.transform("__starts", told_of), lambda m: m["coverage"] >= coverage)
    return out.select(F.col("__id").alias(id_col), F.size(w).cast("long").alias("n_words"), F.coalesce(good, none).alias("matches"))


def license_scan(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """One row per input row: word count, base places, labels and the best coverage."""
    m = F.col("matches")
    out = scan(df, text_col, id_col, templates)
    out = out.withColumn("__base", F.filter(m, lambda x: x["base"])).withColumn("__at", F.transform("__base", lambda x: x["at"]))
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda x: x["label"]))), ",")
    found = out.select(
        id_col,
        "n_words",
        F.size("__base").cast("long").alias("n_base"),
        F.array_min("__at").alias("first_word"),
        F.array_max("__at").alias("last_word"),
        joined(F.col("__base")).alias("base_labels"),
        joined(m).alias("labels"),
        F.coalesce(F.array_max(F.transform(m, lambda x: x["coverage"])), F.lit(0.0)).alias("score"),
    )
    return fenced(found)
