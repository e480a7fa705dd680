"""License scans in DataFrame functions alone: sparse TF-IDF cosine to templates, then inheritance from ancestor directories.

Texts and templates are runs of terms (a-z and 0-9, A-Z lower-cased), so comment signs and line breaks do not matter.  A template
is a title, a notice or a telling sentence of a licence.  Candidates are windows over the whole text, each as long as a template
and laid so that one of the template's telling terms is where the template has it: a template is found in a line of its own, in
the middle of prose, or wrapped over many lines.  Window and template are bags of terms; a term weighs its count times the inverse
document frequency over the templates, and terms of no template weigh as the rarest, so foreign words lower the cosine.

Of the windows with a cosine of ``SIMILARITY`` or more the one that explains most is a file's own licence, by the cosine times the
length of the template's vector: a whole notice goes before a mention.  A reservation of rights counts only where no licence does.
Telling terms are the ``TELLING`` rarest of a template; texts with none of them are passed over.

A file without a licence takes that of the nearest ancestor directory with a licence file: the different directories are joined
to the licensed ones by each of their ancestor paths, then files to directories.  Templates are a constant of this module; their
weights are literals in the plan, and texts are scored in their own rows, so texts are never exchanged.

Defined results: a null or empty text has no licence of its own; a null path is a file in the root directory; ties between
templates go to the higher cosine and then the first, ties between licence files of one directory to the higher cosine;
repeated rows are scanned each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, source_table

#: Public licence wording, by SPDX name.
TEMPLATES = {
    "AGPL-3.0": [
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Apache License Version 2.0, January 2004",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    ],
    "Artistic-1.0": ["The Artistic License Preamble The intent of this document is to state the conditions under which a Package may be copied"],
    "BSD-2-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted", "BSD 2-Clause License"],
    "BSD-3-Clause": [
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "BSD 3-Clause License",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "Creative Commons Attribution 4.0 International"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "Creative Commons Attribution-NonCommercial 4.0 International"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "Creative Commons Attribution-ShareAlike 4.0 International"],
    "CC0-1.0": ["CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal"],
    "GPL-1.0": [
        "GNU GENERAL PUBLIC LICENSE Version 1, February 1989",
        "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 1, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU General Public License, version 2.",
    ],
    "GPL-3.0": [
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU General Public License, version 3.",
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "ISC License"],
    "LGPL-2.0": [
        "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991",
        "under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "LGPL-2.1": [
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": [
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "MIT License",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    ],
    "MPL-1.1": ['The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except in compliance with the License.', "Mozilla Public License Version 1.1"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Mozilla Public License Version 2.0"],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "All-Rights-Reserved": ["All rights reserved."],
}
#: No licence: it counts only where no template of another name is found.
RESERVATION = "All-Rights-Reserved"
SIMILARITY, TELLING = 0.8, 3
#: A path whose last part begins so is a licence file.
FILE_NAMES = r"(?i)^(licen[cs]e|copying|copyright|unlicense)"
_TERM = "[^a-z0-9]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Packed windows: the template, and from this bit on down the place of the first term.
_PLACE = 40


def terms(text: str) -> list[str]:
    return [t for t in re.split(_TERM, text.translate(str.maketrans(_UPPER, _LOWER))) if t]


class Template:
    """A template's ``name``, ``terms``, term weights (a unit vector), and the vector's length before it was scaled."""

    def __init__(self, name: str, words: list[str], idf: dict[str, float]):
        self.name, self.terms = name, words
        vector = {t: n * idf[t] for t, n in Counter(words).items()}
        self.length = math.sqrt(sum(x * x for x in vector.values()))
        self.weight = {t: x / self.length for t, x in vector.items()}

    def telling(self, idf: dict[str, float]) -> list[str]:
        """The rarest terms among templates, longer ones first, as short ones are often common words."""
        return sorted(self.weight, key=lambda t: (-round(idf[t], 9), -len(t), t))[:TELLING]


@lru_cache(maxsize=1)
def templates() -> tuple[dict[str, float], float, list[Template]]:
    """(weight of each term, weight of terms of no template, templates)."""
    bags = [(name, terms(t)) for name, texts in TEMPLATES.items() for t in texts]
    seen = Counter(t for _, words in bags for t in set(words))
    idf = {t: math.log((1 + len(bags)) / (1 + n)) + 1 for t, n in seen.items()}
    return idf, math.log(1 + len(bags)) + 1, [Template(name, words, idf) for name, words in bags]


def _constant(values: dict[str, float]) -> Column:
    return F.create_map(*(F.lit(x) for t, v in sorted(values.items()) for x in (t, float(v))))


def _score(words: Column, number: Column) -> Column:
    """The cosine of a bag of terms that is not empty and a template."""
    idf, rare, known = templates()
    weight, rarest = _constant({t: x * x for t, x in idf.items()}), F.lit(rare * rare)

    def add(run: Column, t: Column) -> Column:
        # sorted terms: the square of n + 1 equal terms exceeds that of n by 2 n + 1
        n = F.when(run["last"] == t, run["n"] + 1).otherwise(F.lit(0.0))
        return F.struct(t.alias("last"), n.alias("n"), (run["sum"] + (2 * n + 1) * F.coalesce(F.try_element_at(weight, t), rarest)).alias("sum"))

    empty = F.struct(F.lit("").alias("last"), F.lit(0.0).alias("n"), F.lit(0.0).alias("sum"))
    norm = F.aggregate(F.sort_array(words), empty, add, lambda run: F.sqrt(run["sum"]))
    shares = F.array(*(_constant({t: x * idf[t] for t, x in k.weight.items()}) for k in known))
    dot = F.aggregate(words, F.lit(0.0), lambda a, t: a + F.coalesce(F.try_element_at(F.get(shares, number), t), F.lit(0.0)))
    return F.round(dot / norm, 9)


def with_license(rows: DataFrame, text: str, out: str, similarity: float = SIMILARITY) -> DataFrame:
    """Adds ``out``, struct(mass, score, order, license) of the window of the column ``text`` that explains most, or null."""
    own = [c for c in rows.columns if c != out]
    idf, _, known = templates()
    telling = [k.telling(idf) for k in known]
    places: dict[str, list[int]] = {}
    for n, k in enumerate(known):
        for place, t in enumerate(k.terms):
            if t in telling[n]:
                places.setdefault(t, []).append((n << _PLACE) - place)
    words = F.split(F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _LOWER), _TERM)
    rows = rows.select(*own, words.alias("__t"))
    some = F.arrays_overlap("__t", F.array(*map(F.lit, sorted(places))))
    rows = rows.select(*own, F.when(some, F.filter("__t", lambda t: t != "")).alias("__t"))
    laid = F.create_map(*(x for t, at in sorted(places.items()) for x in (F.lit(t), F.array(*(F.lit(a).cast("long") for a in at)))))
    term = lambda i: F.get(F.col("__t"), i)
    anchors = F.filter(F.sequence(F.lit(0), F.size("__t") - 1), lambda i: term(i).isin(sorted(places)))
    windows = F.array_distinct(F.flatten(F.transform(anchors, lambda i: F.transform(F.element_at(laid, term(i)), lambda a: a + i))))
    rows = rows.select(*own, "__t", F.when(F.col("__t").isNotNull(), windows).alias("__w"))
    sizes, lengths, names = (F.array(*map(F.lit, x)) for x in ([len(k.terms) for k in known], [0.0 if k.name == RESERVATION else k.length for k in known], [k.name for k in known]))

    def judged(w: Column) -> Column:
        # a window may begin before the text, so the template is what the place is nearest to
        number = F.shiftright(w + F.lit(1 << (_PLACE - 1)), _PLACE).cast("int")
        begin = (w - F.shiftleft(number.cast("long"), _PLACE)).cast("int")
        end = F.least(begin + F.get(sizes, number), F.size("__t"))
        first = F.greatest(begin, F.lit(0))
        score = _score(F.slice("__t", first + 1, end - first), number)
        return F.struct(score.alias("score"), number.alias("number"))

    good = F.filter(F.transform("__w", judged), lambda x: x["score"] >= similarity)
    ranked = F.transform(good, lambda x: F.struct(F.round(x["score"] * F.get(lengths, x["number"]), 6).alias("mass"), x["score"].alias("score"), (-x["number"]).alias("order"), F.get(names, x["number"]).alias("license")))
    return rows.select(*own, F.array_max(ranked).alias(out))


def directory(path: Column) -> Column:
    """The part before the last slash; the root directory is the empty string."""
    return F.regexp_extract(path, "(?s)^(.*)/[^/]*$", 1)


def scan(files: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, path, own_license, own_score, license, license_source ('own', 'inherited' or null), license_dir."""
    rows = files.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"), F.col(text_col).cast("string").alias("text"))
    named = F.regexp_extract("path", "(?s)([^/]*)$", 1).rlike(FILE_NAMES)
    found = with_license(rows, "text", "own", similarity).select("doc_id", "path", directory(F.col("path")).alias("dir"), named.alias("named"), "own")
    found = saved(found, "licenses")
    licensed = found.filter("named and own is not null").groupBy("dir").agg(F.max(F.struct("own.score", "own.mass", "own.order", "own.license")).alias("given"))
    parts = F.split("dir", "/")
    ancestors = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))
    above = found.filter("own is null").select("dir").distinct().select("dir", F.explode(ancestors).alias("up"))
    nearest = above.join(licensed.withColumnRenamed("dir", "up"), "up").groupBy("dir").agg(F.max(F.struct(F.length("up").alias("depth"), "up", F.col("given.license").alias("license"))).alias("near"))
    met = found.join(nearest, "dir", "left").withColumn("near", F.when(F.col("own").isNull(), F.col("near")))
    source = F.when(F.col("own").isNotNull(), F.lit("own")).when(F.col("near").isNotNull(), F.lit("inherited"))
    return met.select("doc_id", "path", F.col("own.license").alias("own_license"), F.col("own.score").alias("own_score"), F.coalesce("own.license", "near.license").alias("license"), source.alias("license_source"), F.when(F.col("own").isNull(), F.col("near.up")).alias("license_dir"))


def document_paths(docs: DataFrame) -> DataFrame:
    """Documents as files: source/thousand/hundred/doc_id.txt, of each hundred ids the first being source/thousand/LICENSE and
    each other tenth source/thousand/hundred/LICENSE."""
    part = lambda n: F.coalesce(F.floor(F.col("doc_id") / n).cast("string"), F.lit(""))
    name = F.when(F.col("doc_id") % 100 == 0, F.lit("LICENSE")).when(F.col("doc_id") % 10 == 0, F.concat(part(100), F.lit("/LICENSE"))).otherwise(F.concat(part(100), F.lit("/"), part(1), F.lit(".txt")))
    return docs.select("doc_id", "text", F.concat_ws("/", F.coalesce("source", F.lit("")), part(1000), name).alias("path"))


def op10_licenses(spark, sf_dir: str) -> DataFrame:
    return scan(document_paths(source_table(spark, sf_dir, "documents")))
