"""License scan: phrases that name a license, and license texts by diagonal voting.

All rolling four-word hashes of all texts are joined to the positions that the same four
words have in templates; the first and the last word of each must be equal too, so in a run of
matches every word is compared. A match votes for its diagonal, the difference of the two
positions; a copied passage puts all its votes on one. Diagonals a few words apart, as
inserted or dropped words make them, are merged, and a merged run of votes is a span if it
covers enough of its template, is dense enough in the document, and is verified against the
words of every rival: each template of another license, and the template itself with another
number. Of the matches that a rival has not, a span must hold half (``rivals``).

Everything is DataFrame expressions and joins. Only matches leave the tasks that read
texts, at most one per word and template position. The template side has ``GRAMS_BOUND`` rows
at most, which bounds its broadcast.

Defined results. Null and empty texts have no words, no labels and score 0. Repeated rows
get the same result each. An empty table gives no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnwork.llm.common import ascii_lower

K = 4
GRAMS_BOUND = 20_000
#: Diagonals so many words apart are one.
NEAR = 3
#: Shares of a template's grams that a span must hold, and of a span's grams that must match.
COVERED, DENSE = 0.6, 0.5
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases, and the wording of public license notices.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
TEMPLATES = {
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files (the Software), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, "
        "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included "
        "in all copies or substantial portions of the Software.",
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this "
        "file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed "
        "to in writing, software distributed under the License is distributed on an AS IS "
        "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the "
        "terms of the GNU General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version.",
    ),
    "cc-by-nc-4.0": ("Licensed under CC BY-NC 4.0.",),
    "cc-by-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "cc-by-sa-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 "
        "International License.",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with "
        "or without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met: Redistributions of source "
        "code must retain the above copyright notice, this list of conditions and the following "
        "disclaimer.",
    ),
}
#: Passages that the full texts of licenses begin with, and notices of further licenses.
OPENINGS = {
    "gpl-3.0": (
        "The licenses for most software and other practical works are designed to take away your "
        "freedom to share and change the works. By contrast, the GNU General Public License is "
        "intended to guarantee your freedom to share and change all versions of a program--to make "
        "sure it remains free software for all its users.",
    ),
    "gpl-2.0": (
        "The licenses for most software are designed to take away your freedom to share and change "
        "it. By contrast, the GNU General Public License is intended to guarantee your freedom to "
        "share and change free software--to make sure the software is free for all its users.",
        "This program is free software; you can redistribute it and/or modify it under the terms of "
        "the GNU General Public License as published by the Free Software Foundation; either "
        "version 2 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU General Public License, version 2.",
    ),
    "lgpl-2.1": (
        "This license, the Lesser General Public License, applies to some specially designated "
        "software packages--typically libraries--of the Free Software Foundation and other authors "
        "who decide to use it.",
        "The licenses for most software are designed to take away your freedom to share and change "
        "it. By contrast, the GNU General Public Licenses are intended to guarantee your freedom to "
        "share and change free software--to make sure the software is free for all its users.",
        "This library is free software; you can redistribute it and/or modify it under the terms of "
        "the GNU Lesser General Public License as published by the Free Software Foundation; either "
        "version 2.1 of the License, or (at your option) any later version.",
    ),
    "lgpl-3.0": (
        "This version of the GNU Lesser General Public License incorporates the terms and conditions "
        "of version 3 of the GNU General Public License, supplemented by the additional permissions "
        "listed below.",
        "This program is free software: you can redistribute it and/or modify it under the terms of "
        "the GNU Lesser General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU Lesser General Public License, version 3.",
    ),
    "agpl-3.0": (
        "The GNU Affero General Public License is a free, copyleft license for software and other "
        "kinds of works, specifically designed to ensure cooperation with the community in the case "
        "of network server software.",
        "The licenses for most software and other practical works are designed to take away your "
        "freedom to share and change the works. By contrast, our General Public Licenses are "
        "intended to guarantee your freedom to share and change all versions of a program--to make "
        "sure it remains free software for all its users.",
        "This program is free software: you can redistribute it and/or modify it under the terms of "
        "the GNU Affero General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU Affero General Public License, version 3.",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy "
        "of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to "
        "copy, modify, publish, use, compile, sell, or distribute this software, either in source code "
        "form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "zlib": (
        "Permission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely, subject to the following restrictions",
    ),
    "mit-0": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files (the Software), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, "
        "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so. THE SOFTWARE IS PROVIDED",
    ),
    "ecl-2.0": (
        "Licensed under the Educational Community License, Version 2.0 (the License); you may not "
        "use this file except in compliance with the License. You may obtain a copy of the License "
        "at http://opensource.org/licenses/ECL-2.0 Unless required by applicable law or agreed to "
        "in writing, software distributed under the License is distributed on an AS IS BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
}
KNOWN = {label: TEMPLATES.get(label, ()) + OPENINGS.get(label, ()) for label in TEMPLATES | OPENINGS}


def license_words(text: Column) -> Column:
    """Lower-cased maximal runs of ASCII letters, digits and characters beyond ASCII."""
    text = F.coalesce(text, F.lit(""))
    # On text of ASCII alone the two are the same, and lower is faster.
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(ascii_lower(text))
    return F.array_remove(F.split(low, SEPARATORS), "")


def _grams(words: Column) -> Column:
    """Hashes of all runs of ``K`` words, with the first and last word of each."""
    every = F.transform(
        words,
        lambda w, i: F.struct(
            F.xxhash64(w, *(F.get(words, i + j) for j in range(1, K))).alias("gram"),
            w.alias("first"),
            F.get(words, i + (K - 1)).alias("last"),
        ),
    )
    return F.slice(every, F.lit(1), F.greatest(F.size(words) - (K - 1), F.lit(0)))


def phrase_places(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``h`` (of the text), ``n_words``, ``n_base``, ``first_word``,
    ``last_word`` and ``base`` (labels) of every row."""
    words = docs.select(
        "doc_id", F.xxhash64("text").alias("h"), license_words(F.col("text")).alias("_words")
    )
    lined = words.select(
        "doc_id",
        "h",
        F.size("_words").cast("long").alias("n_words"),
        F.concat(F.lit(" "), F.array_join("_words", " "), F.lit(" ")).alias("_line"),
    )
    any_phrase = f" (?:{'|'.join(PHRASES)})(?= )"
    counted = lined.select(
        "*", F.regexp_count("_line", F.lit(any_phrase)).cast("long").alias("n_base")
    )

    def blanks(text: Column) -> Column:
        return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")

    first = F.get(F.split("_line", any_phrase, 2), F.lit(0))
    last = F.regexp_extract("_line", f"(?s)^(.*){any_phrase}", 1)
    found = F.col("n_base") > 0
    labels = F.array(
        *(F.when(F.contains("_line", F.lit(f" {p} ")), F.lit(label)) for p, label in PHRASES.items())
    )
    return counted.select(
        "doc_id",
        "h",
        "n_words",
        "n_base",
        F.when(found, blanks(first)).alias("first_word"),
        F.when(found, blanks(last)).alias("last_word"),
        F.when(found, F.array_compact(labels)).otherwise(F.array().cast("array<string>")).alias("base"),
    )


def _numbered(templates: dict[str, tuple[str, ...]]) -> list[tuple[int, str, str]]:
    """Number, label and text of every template."""
    pairs = [(label, text) for label, texts in templates.items() for text in texts]
    return [(i, label, text) for i, (label, text) in enumerate(pairs)]


def rivals(templates: dict[str, tuple[str, ...]]) -> list[tuple[int, list[list[int]]]]:
    """For every template, by number: per rival, the positions of grams that the rival has not.

    Rivals are the templates of other labels, and the template with one of its numbers
    changed. Where a rival has no more than ``2 * COVERED - 1`` of the grams, any span that
    covers enough holds half of the others, and the rival is left out.
    """

    def grams(words: list[str]) -> list[tuple[str, ...]]:
        return [tuple(words[at : at + K]) for at in range(len(words) - K + 1)]

    numbered = [
        (i, label, [w for w in re.split(SEPARATORS, re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w])
        for i, label, text in _numbered(templates)
    ]
    out = []
    for i, label, words in numbered:
        own = grams(words)
        others = [other for _, name, other in numbered if name != label]
        others += [["" if w == d else w for w in words] for d in sorted(set(filter(str.isdigit, words)))]
        telling = []
        for other in others:
            has = set(grams(other))
            lacks = [at for at, gram in enumerate(own) if gram not in has]
            if len(own) - len(lacks) > (2 * COVERED - 1) * len(own):
                telling.append(lacks)
        out.append((i, telling))
    return out


def template_grams(spark, templates: dict[str, tuple[str, ...]]) -> DataFrame:
    """``gram``, ``template`` (number), ``label``, ``at`` and ``total`` (grams of it)."""
    rows = _numbered(templates)
    if sum(len(text.split()) for _, _, text in rows) > GRAMS_BOUND:
        raise ValueError("templates are too long to be broadcast")
    texts = spark.createDataFrame(rows, "template int, label string, text string")
    grams = texts.select("template", "label", license_words(F.col("text")).alias("_words")).select(
        "template", "label", _grams(F.col("_words")).alias("_grams")
    )
    return grams.select(
        "template", "label", F.size("_grams").alias("total"), F.posexplode("_grams").alias("at", "_gram")
    ).select("template", "label", "total", "at", "_gram.*")


def license_spans(docs: DataFrame, templates: dict[str, tuple[str, ...]] = KNOWN) -> DataFrame:
    """``doc_id``, ``h``, ``label``, ``start``, ``end`` (words) and ``score`` of each span."""
    words = docs.select(
        "doc_id", F.xxhash64("text").alias("h"), license_words(F.col("text")).alias("_words")
    )
    grams = words.select("doc_id", "h", _grams(F.col("_words")).alias("_grams")).select(
        "doc_id", "h", F.posexplode_outer("_grams").alias("place", "_gram")
    ).select("doc_id", "h", "place", "_gram.*")
    # explode_outer: explode adds a filter on the array, which would move below the words
    # and cut them again for every gram.
    votes = (
        grams.join(F.broadcast(template_grams(docs.sparkSession, templates)), ["gram", "first", "last"])
        .select("doc_id", "h", "template", "label", "total", "at", "place")
        .distinct()
    )
    diagonals = votes.groupBy(
        "doc_id", "h", "template", "label", "total", (F.col("place") - F.col("at")).alias("diagonal")
    ).agg(
        F.collect_set("at").alias("ats"),  # one template's positions
        F.min("place").alias("low"),
        F.max("place").alias("high"),
    )
    own = Window.partitionBy("doc_id", "h", "template").orderBy("diagonal")
    runs = diagonals.withColumn(
        "_new",
        F.coalesce((F.col("diagonal") - F.lag("diagonal").over(own) > NEAR).cast("int"), F.lit(1)),
    ).withColumn("_run", F.sum("_new").over(own))
    spans = runs.groupBy("doc_id", "h", "template", "label", "total", "_run").agg(
        F.array_distinct(F.flatten(F.collect_list("ats"))).alias("ats"),
        F.min("low").alias("start"),
        (F.max("high") + K).alias("end"),
    )
    matched = F.size("ats")
    score = matched / F.col("total")
    dense = matched >= DENSE * (F.col("end") - F.col("start") - (K - 1))
    table = docs.sparkSession.createDataFrame(rivals(templates), "template int, rivals array<array<int>>")
    told = F.forall("rivals", lambda r: 2 * F.size(F.array_intersect(r, "ats")) >= F.size(r))
    enough = spans.where((score >= COVERED) & dense)
    return enough.join(F.broadcast(table), "template").where(told).select(
        "doc_id", "h", "label", "start", "end", score.alias("score")
    )


def licenses(docs: DataFrame) -> DataFrame:
    """A row per document with its phrases, labels (base and both) and score.

    The score is the best span's share of its template, or 0.5 for a phrase alone.
    """
    found = (
        license_spans(docs)
        .groupBy(F.col("doc_id").alias("_id"), F.col("h").alias("_h"))
        .agg(F.collect_set("label").alias("more"), F.max("score").alias("best"))
    )
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h"))
    none = F.array().cast("array<string>")
    return (
        phrase_places(docs)
        .join(found, same, "left")
        .select(
            "doc_id",
            "n_words",
            "n_base",
            "first_word",
            "last_word",
            F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
            F.array_join(
                F.array_sort(F.array_union("base", F.coalesce("more", none))), ","
            ).alias("labels"),
            F.greatest(
                F.coalesce("best", F.lit(0.0)), F.when(F.col("n_base") > 0, 0.5).otherwise(0.0)
            ).alias("score"),
        )
    )
