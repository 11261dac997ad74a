"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest directory.

Candidates are the sentences of a text that speak of a licence, read twice: line by line, and with the
lines of a paragraph joined after their comment marks are taken off, so that wrapped headers and whole
licence texts count. A candidate's weighted words are joined with the templates' by word and summed; a
template above the threshold names a licence, and a file may have several. A candidate must have the
template's versions and just its modifiers (lesser, non-commercial, an exception...), however close they
are otherwise, and one that says of something that it is not under a licence is none. Files without one take those
of the nearest directory above that holds a licence file, by joins of paths with the directories above
them. DataFrame functions only.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import checkpoints

#: Sentences of notices and licence texts by SPDX id; fixed values.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", "Apache License 2.0"),
    ("Apache-2.0", "You may not use this file except in compliance with the License"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "The MIT License"),
    ("MIT", "MIT License"),
    ("MIT", "Licensed under the MIT license"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("GPL-1.0-or-later", "GNU General Public License"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "GNU General Public License version 3, 29 June 2007"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, either version 3 of the License, or any later version"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("GPL-2.0", "This program is free software under the terms of the GNU General Public License, version 2"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", "GNU General Public License version 2, June 1991"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("LGPL-3.0", "GNU Lesser General Public License version 3, 29 June 2007"),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version"),
    ("LGPL-2.1", "GNU Lesser General Public License version 2.1, February 1999"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3"),
    ("AGPL-3.0", "GNU Affero General Public License version 3, 19 November 2007"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted under this license"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("ISC", "Licensed under the ISC License"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("Unlicense", "This is free and unencumbered software released into the public domain under the Unlicense"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal license"),
    ("CC0-1.0", "Creative Commons CC0 1.0 Universal"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "Licensed under the Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "Licensed under the Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "Licensed under the Creative Commons Attribution-NonCommercial 4.0 International License"),
]
#: Ids that an SPDX line may name, with the licence of each; fixed values.
SPDX = {
    "Apache-2.0": "Apache-2.0", "MIT": "MIT", "ISC": "ISC", "Unlicense": "Unlicense", "MPL-2.0": "MPL-2.0", "BSD-2-Clause": "BSD-2-Clause", "BSD-3-Clause": "BSD-3-Clause", "CC0-1.0": "CC0-1.0",
    "CC-BY-4.0": "CC-BY-4.0", "CC-BY-SA-4.0": "CC-BY-SA-4.0", "CC-BY-NC-4.0": "CC-BY-NC-4.0", "GPL-2.0": "GPL-2.0", "GPL-2.0-only": "GPL-2.0", "GPL-2.0-or-later": "GPL-2.0", "GPL-3.0": "GPL-3.0",
    "GPL-3.0-only": "GPL-3.0", "GPL-3.0-or-later": "GPL-3.0", "LGPL-2.1-only": "LGPL-2.1", "LGPL-2.1-or-later": "LGPL-2.1", "LGPL-3.0-only": "LGPL-3.0", "LGPL-3.0-or-later": "LGPL-3.0", "AGPL-3.0-only": "AGPL-3.0",
    "AGPL-3.0-or-later": "AGPL-3.0",
}
# Families of licences that differ in versions and modifiers alone: names, prose and ids of each by rule.
_GNU = [("GPL", "GNU General Public License", ("1.0", "2.0", "3.0")), ("LGPL", "GNU Library General Public License", ("2.0",)), ("LGPL", "GNU Lesser General Public License", ("2.1", "3.0")), ("AGPL", "GNU Affero General Public License", ("1.0", "3.0"))]
_OTHERS = [("MPL", "Mozilla Public License", ("1.0", "1.1", "2.0")), ("EPL", "Eclipse Public License", ("1.0", "2.0")), ("EUPL", "European Union Public Licence", ("1.1", "1.2")), ("BSL", "Boost Software License", ("1.0",)), ("Apache", "Apache License", ("1.1", "2.0")), ("OSL", "Open Software License", ("3.0",)), ("CDDL", "Common Development and Distribution License", ("1.0", "1.1")), ("Artistic", "Artistic License", ("1.0", "2.0"))]
_COMMONS = [("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")]


def _by_rule() -> list[tuple[str, str]]:
    out = []
    for short, name, versions in _GNU + _OTHERS:
        for v in versions:
            own, plain = f"{short}-{v}", v.removesuffix(".0")
            out += [(own, f"Licensed under the {name}, version {x}") for x in dict.fromkeys((plain, v))] + [(own, f"{name} v{v}"), (own, f"{name} version {plain}"), (own, f"Licensed under {short} {v}")]
            out += [(own, f"SPDX-License-Identifier: {own}{end}") for end in (("", "-only", "-or-later") if (short, name, versions) in _GNU else ("",))]
    for short, name in _COMMONS:
        for v, kind in (("4.0", "International"), ("3.0", "Unported")):
            own = f"CC-{short}-{v}"
            out += [(own, f"Licensed under CC {short} {v}"), (own, f"Licensed under the Creative Commons {name} {v} {kind} License"), (own, f"This work is licensed under a Creative Commons {name} {v} {kind} License"), (own, f"SPDX-License-Identifier: {own}")]
    for v in ("2.0", "3.0"):
        for end in ("", "-only", "-or-later"):
            out.append((f"GPL-{v}-with-classpath-exception", f"SPDX-License-Identifier: GPL-{v}{end} WITH Classpath-exception-2.0"))
    return out


TEMPLATES += [(name, f"SPDX-License-Identifier: {key}") for key, name in SPDX.items()]
TEMPLATES = list(dict.fromkeys(TEMPLATES + _by_rule()))
#: Words that make another licence of one, by what they come to; fixed values. Those of the second table only count beside a word of the third.
MODIFIERS = {"lesser": "lesser", "lgpl": "lesser", "affero": "affero", "agpl": "affero", "noncommercial": "nc", "sharealike": "sa", "noderivatives": "nd", "noderivs": "nd", "exception": "exception", "exceptions": "exception", "classpath": "classpath"}
BESIDE = {"nc": "nc", "sa": "sa", "nd": "nd", "library": "lesser"}
COMPANY = ["cc", "commons", "gnu"]
VERSION = r"^v?[0-9]{1,2}([.][0-9]{1,2})?$"
#: Names a family; a candidate that has a version is one of its members.
GENERIC = "GPL-1.0-or-later"
NEGATED = r"(?i)(^|[^a-z])not (been |be )?(released|licen[sc]ed|under|covered|distributed under|available under)"
#: A licence whose text holds the other one's.
LARGER = {"BSD-2-Clause": "BSD-3-Clause", "GPL-1.0-or-later": "L?GPL-[123].[01]|AGPL-[13].0|GPL-[23].0-with-classpath-exception"}
THRESHOLD = 0.75
CUE = r"[Ll][Ii][Cc][Ee][Nn][CcSs][Ee]|[Pp]ermission is hereby|[Pp]ermission to use|free software|SPDX|[Rr]edistribution and use|[Nn]either the name of|public domain|unencumbered|CC0|[Cc]reative [Cc]ommons"
#: What stands before the words of a comment's line.
MARKS = r"(^|\n)[ \t]*(//+!?|#+|/?[*]+/?|--+|;+|%+|<!--|[.][.])?[ \t]*"
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|unlicense|notice)(-[a-z0-9]+([.][0-9]+)*)?([.](txt|md|rst|html?))?$"
_WORD = r"[a-z0-9.]*[a-z0-9]"


def _terms(text: str) -> list[str]:
    return re.findall(_WORD, text.lower())


def template_weights(templates: list[tuple[str, str]]) -> tuple[list[tuple[str, int, str, float]], dict[str, float], float]:
    """Rows (license, template, word, weight; a template's weights have length one), each word's idf, and that of a word in no template."""
    bags = [Counter(_terms(t)) for _, t in templates]
    n, df = len(bags), Counter(w for b in bags for w in b)
    idf = {w: math.log((1 + n) / (1 + d)) + 1 for w, d in df.items()}
    rows = []
    for i, ((name, _), bag) in enumerate(zip(templates, bags, strict=True)):
        norm = math.sqrt(sum((c * idf[w]) ** 2 for w, c in bag.items()))
        rows += [(name, i, w, c * idf[w] / norm) for w, c in bag.items()]
    return rows, idf, math.log(1 + n) + 1


def decisive(text: str) -> tuple[list[str], list[str]]:
    """The versions and the modifiers that a sentence has, sorted."""
    terms = set(_terms(text))
    beside = BESIDE if terms & set(COMPANY) else {}
    return sorted({t.removeprefix("v").removesuffix(".0") for t in terms if re.search(VERSION, t)}), sorted({(MODIFIERS | beside)[t] for t in terms if t in MODIFIERS or t in beside})


def _lower(value: Column) -> Column:
    return F.translate(value, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: An SPDX line may name several licences.
OPERATORS = r" +(OR|AND) +[(]?"


def _sentences(text: Column) -> Column:
    """Ended by a line's end or by a full stop and white space."""
    return F.split(F.regexp_replace(text, r"([.!?])[ \t\r\n]+", "$1\n"), r"\n")


def _notices(text: Column) -> Column:
    """Sentences of the lines and of the paragraphs that speak of a licence."""
    bare = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), MARKS, "$1")
    paragraphs = F.transform(F.split(bare, r"\n\n+"), lambda p: F.regexp_replace(p, r"[ \t\n]+", " "))
    both = F.filter(F.concat(_sentences(text), F.flatten(F.transform(paragraphs, _sentences))), lambda s: s.rlike(CUE))
    each = F.transform(both, lambda s: F.when(s.contains("SPDX"), F.split(F.regexp_replace(s, OPERATORS, "\nSPDX-License-Identifier: "), "\n")).otherwise(F.array(s)))
    return F.array_distinct(F.flatten(each))


def notices(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """files (path, text) to (path, license, score): of each path all licences with a template that reaches the threshold, with the best score of each.

    Of one sentence only its best template counts, and ties with it; an SPDX line is one for each licence. A licence whose text is part of
    another found one's is left out (``LARGER``).
    """
    spark: SparkSession = files.sparkSession
    rows, idf, unseen = template_weights(templates)
    weights = F.broadcast(spark.createDataFrame(rows, "license string, template int, word string, weight double"))  # the templates are a parameter
    own_idf = F.broadcast(spark.createDataFrame(list(idf.items()), "word string, idf double"))
    spoken = files.filter(F.col("path").isNotNull() & F.col("text").rlike(CUE))
    said = spoken.select("path", F.explode_outer(_notices(F.col("text"))).alias("notice")).filter(F.col("notice").isNotNull() & ~F.col("notice").rlike(NEGATED))
    bags = said.select("path", F.xxhash64("notice").alias("notice"), F.explode_outer(F.regexp_extract_all(_lower(F.col("notice")), F.lit(_WORD), F.lit(0))).alias("word")).filter("word IS NOT NULL")
    counted = bags.groupBy("path", "notice", "word").agg(F.count("*").alias("n"))
    weighed = counted.join(own_idf, "word", "left").withColumn("w", F.col("n") * F.coalesce("idf", F.lit(unseen)))
    word, named = F.col("word"), lambda table: F.coalesce(*[F.when(F.col("word") == k, v) for k, v in table.items()])
    version = F.regexp_replace(F.regexp_replace(F.when(word.rlike(VERSION), word), "^v", ""), "[.]0$", "")
    norms = weighed.groupBy("path", "notice").agg(
        F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.collect_set(version).alias("versions"), F.collect_set(named(MODIFIERS)).alias("always"),
        F.collect_set(named(BESIDE)).alias("beside"), F.bool_or(word.isin(COMPANY)).alias("company"),
    )
    modifiers = F.array_sort(F.array_union("always", F.when(F.col("company"), F.col("beside")).otherwise(F.array().cast("array<string>"))))
    norms = norms.select("path", "notice", "norm", "versions", modifiers.alias("modifiers"))
    marks = [(i, *decisive(text), name == GENERIC) for i, (name, text) in enumerate(templates)]
    marks = F.broadcast(spark.createDataFrame(marks, "template int, need array<string>, own array<string>, generic boolean"))
    agrees = (F.size(F.array_except("need", "versions")) == 0) & (F.col("own") == F.col("modifiers")) & ~(F.col("generic") & (F.size("versions") > 0))
    dots = weighed.join(weights, "word").groupBy("path", "notice", "license", "template").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    scored = dots.join(norms, ["path", "notice"]).join(marks, "template").filter(agrees).select("path", "notice", "license", F.round(F.col("dot") / F.col("norm"), 6).alias("score")).filter(F.col("score") >= threshold)
    named = scored.groupBy("path", "notice").agg(F.max("score").alias("score"), F.collect_set(F.struct("license", "score")).alias("all"))
    told = named.select("path", F.explode("all").alias("t"), "score").filter(F.col("t.score") == F.col("score"))
    best = told.groupBy("path", F.col("t.license").alias("license")).agg(F.max("t.score").alias("score"))
    every = best.groupBy("path").agg(F.collect_list(F.struct("license", "score")).alias("all"))  # at most one entry for each licence of the templates
    names = F.array_join("all.license", " ")
    smaller = [F.lit(False)] + [(F.col("a.license") == small) & F.col("names").rlike(f"(^| )({larger})( |$)") for small, larger in LARGER.items()]
    within = smaller[0]
    for s in smaller[1:]:
        within = within | s
    return every.select("path", names.alias("names"), F.explode("all").alias("a")).filter(~within).select("path", "a.*")


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def _together(found: DataFrame, *by: str) -> DataFrame:
    """One row for each path (or folder): the best licence, and all of them, sorted and joined by commas."""
    best = F.min_by(F.struct("license", "score", *[c for c in ("path",) if c not in by]), F.struct(-F.col("score"), "license", "path")).alias("best")
    return found.groupBy(*by).agg(best, F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"))


def scan(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """files (path, text) to one row for each distinct path: path, license, score, licenses, origin and source.

    license is the one with the best score (ties to the lesser name), licenses are all that the file
    names. origin is ``own`` where the file itself bears a notice and ``inherited`` where the nearest
    directory above it, its own first, has a licence file with one; source is the path of the notice, and
    a directory's licences are those of all its licence files. Other paths have nulls. Texts of repeated
    paths count together. Null paths are left out, null and empty texts have no notice, other columns are
    ignored.
    """
    checkpoints.ensure(files.sparkSession)
    every = notices(files, templates, threshold).checkpoint()
    own = _together(every, "path").select("path", "best.license", "best.score", "licenses").checkpoint()
    name = F.regexp_extract("path", "[^/]*$", 0)
    holders = every.filter(name.rlike(LICENCE_FILE)).withColumn("folder", _folder(F.col("path")))
    grants = _together(holders, "folder").select("folder", F.struct("best.license", "best.score", "licenses", F.col("best.path").alias("source")).alias("grant")).checkpoint()
    paths = files.select("path").filter("path IS NOT NULL").distinct()
    known = paths.join(own, "path", "left")
    folders = known.filter("license IS NULL").select(_folder(F.col("path")).alias("folder")).distinct()
    parts = F.split("folder", "/")
    ups = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    above = folders.select("folder", F.explode(F.array_distinct(F.when(F.col("folder") == "", F.array(F.lit(""))).otherwise(ups))).alias("up"))
    met = above.join(grants.withColumnRenamed("folder", "up"), "up").groupBy("folder").agg(F.max_by("grant", F.length("up")).alias("grant"))
    out = known.withColumn("folder", _folder(F.col("path"))).join(met, "folder", "left")
    inherited = F.col("license").isNull() & F.col("grant").isNotNull()
    return out.select(
        "path",
        F.coalesce("license", "grant.license").alias("license"),
        F.coalesce("score", "grant.score").alias("score"),
        F.coalesce("licenses", "grant.licenses").alias("licenses"),
        F.when(F.col("license").isNotNull(), "own").when(inherited, "inherited").alias("origin"),
        F.when(F.col("license").isNotNull(), F.col("path")).otherwise(F.col("grant.source")).alias("source"),
    )
