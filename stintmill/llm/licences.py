"""Operator 6: licence scans by sparse TF-IDF cosine, with inheritance from the nearest directory.

Segments are lines, runs of neighbouring lines that speak of licences, and whole licence files. They and
the templates are sparse TF-IDF vectors; a term's document frequency is that among all lines of the corpus.
A segment's licence is the template of the largest cosine, if that is large enough and no version number
speaks against it; an SPDX tag names its licence itself. A file without a licence of its own takes that of
the licence file in its own directory or else in the nearest directory above, found by joining every
ancestor path. DataFrame functions only.

Which lines can reach the least cosine is told exactly: by the Cauchy-Schwarz inequality a segment that has
none of a template's heaviest terms, so many that the rest has less than ``least`` of the template's norm,
stays under it. Only lines with such a term of some template are taken apart.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, table
from .linking import bitmap, crowded, maybe_in, spread_join

# Licences by SPDX identifier, with statements and text passages by which projects name them.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license. See LICENSE in the project root for license information."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", "Licensed under the ISC License."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-2-Clause", "Licensed under the 2-Clause BSD License (Simplified BSD)."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the License); you may not use this file except in compliance with the License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("EPL-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("EUPL-1.2", "Licensed under the European Union Public Licence, version 1.2 (EUPL)."),
    ("CDDL-1.0", "The contents of this file are subject to the terms of the Common Development and Distribution License (CDDL) version 1.0."),
    ("Artistic-2.0", "Licensed under the Artistic License 2.0."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt"),
    ("Zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
    ("PostgreSQL", "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph appear in all copies. PostgreSQL License"),
    ("OFL-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1."),
    ("MS-PL", "Licensed under the Microsoft Public License (Ms-PL)."),
    ("WTFPL", "Do What The Fuck You Want To Public License. Everyone is permitted to copy and distribute verbatim or modified copies of this license document"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright to the public domain under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
)
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|unlicense)[^/]*$"
TERM = r"[a-z]+|[0-9]+(?:\.[0-9]+)*"
VERSION = r"\b(?:version|v|gpl|lgpl|agpl|mpl|epl|by|sa|nc|nd|cc0|apache|license|licence)[ .,-]*([0-9]+(?:\.[0-9]+)*)"
SPDX = r"(?i)SPDX-License-Identifier:\s*\(?([A-Za-z0-9.+-]+)"


def templates(spark: SparkSession, rows=TEMPLATES) -> DataFrame:
    return spark.createDataFrame([(n, name, text) for n, (name, text) in enumerate(rows)], "template int, licence string, text string")


def _version(text: str) -> list[str]:
    return sorted({re.sub(r"(\.0)+$", "", v) for v in re.findall(VERSION, text.lower())})


class Weights:
    """Of a bounded list of templates: terms with idf, weights, and the terms of which one is needed."""

    def __init__(self, rows: list, df: dict[str, int], n: int, least: float):
        counts = [Counter(re.findall(TERM, r.text.lower())) for r in rows]
        self.idf = {t: math.log(1 + max(1, n) / max(1, df.get(t, 0))) for c in counts for t in c}
        #: a word that no template has says as much as their words do on average
        self.other = sum(self.idf.values()) / max(1, len(self.idf))
        self.entries, needed = [], set()
        for r, c in zip(rows, counts, strict=True):
            w = {t: (1 + math.log(k)) * self.idf[t] for t, k in c.items()}
            norm = math.sqrt(sum(x * x for x in w.values()))
            self.entries += [(t, r.template, x / norm) for t, x in w.items()]
            rest = norm * norm
            for t, x in sorted(w.items(), key=lambda e: (-e[1], e[0])):
                if rest < (least * norm) ** 2 * (1 - 1e-9):
                    break
                needed.add(t)
                rest -= x * x
        self.needed = sorted(needed)


def line_frequencies(files: DataFrame, vocabulary: list[str]) -> tuple[dict[str, int], int]:
    """In how many lines of the corpus each term of a bounded list stands, and the number of lines."""
    line = F.explode(F.split("text", "\n")).alias("line")
    terms = F.array_intersect(F.regexp_extract_all(F.lower("line"), F.lit(TERM), F.lit(0)), F.array(*map(F.lit, vocabulary)))
    rows = files.select(line).where("line <> ''").select(F.explode(F.concat(terms, F.array(F.lit("")))).alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()
    found = {r.t: r.n for r in rows}
    return found, found.pop("", 0)


def segments(files: DataFrame, needed: list[str]) -> DataFrame:
    """Staged (path, segment) from (path, text): lines with a needed term or an SPDX tag, runs of neighbours among them, licence files."""
    whole = files.where(F.col("path").rlike(LICENCE_FILE)).select("path", F.col("text").alias("segment"))
    cue = r"(?i)(?<![a-z])(?:" + "|".join(re.escape(t) for t in needed) + r")(?![a-z])|spdx-license"
    lines = files.where(F.col("text").rlike(cue)).select("path", F.xxhash64("text").alias("r"), F.posexplode(F.split("text", "\n")).alias("pos", "segment"))
    lines = staged(lines.where(F.col("segment").rlike(cue)), "cue-lines")
    nth = F.row_number().over(Window.partitionBy("path", "r").orderBy("pos"))
    runs = lines.dropDuplicates(["path", "r", "pos"]).withColumn("run", F.col("pos") - nth).groupBy("path", "r", "run").agg(F.sort_array(F.collect_list(F.struct("pos", "segment"))).alias("parts"))
    runs = runs.where(F.size("parts") > 1).select("path", F.array_join(F.col("parts.segment"), "\n").alias("segment"))
    every = whole.unionByName(lines.select("path", "segment")).unionByName(runs)
    return staged(every.select("path", F.btrim("segment", F.lit(" \t\r\n")).alias("segment")).where("segment <> ''").withColumn("s", F.xxhash64("segment")), "segments")


def matched(found: DataFrame, known: DataFrame, weights: Weights, least: float) -> DataFrame:
    """(s, licence, score): for each distinct segment (s, segment) its best template, if of cosine >= least.

    idf is ln(1 + lines / df); tf is 1 + ln(count). A template that names a version is none for a
    segment that names other ones only. Ties go to the first template. Template tables are broadcast:
    their size is that of the list of templates.
    """
    spark = known.sparkSession
    idf = spark.createDataFrame(list(weights.idf.items()), "term string, idf double")
    entries = spark.createDataFrame(weights.entries, "term string, template int, v double")
    versions = [(r.template, r.licence, _version(r.text)) for r in known.collect()]
    versions = spark.createDataFrame(versions, "template int, licence string, versions array<string>")
    words = F.explode(F.regexp_extract_all(F.lower("segment"), F.lit(TERM), F.lit(0)))
    terms = found.select("s", words.alias("term")).groupBy("s", "term").agg(F.count("*").alias("tf")).join(F.broadcast(idf), "term", "left")
    terms = staged(terms.withColumn("w", (1 + F.log("tf")) * F.coalesce("idf", F.lit(weights.other))).drop("tf", "idf"), "segment-terms")
    norms = terms.groupBy("s").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = terms.join(F.broadcast(entries), "term").groupBy("s", "template").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    near = dots.join(norms, "s").withColumn("score", F.col("dot") / F.col("norm")).where(F.col("score") >= least - 1e-12)
    said = F.array_distinct(F.transform(F.regexp_extract_all(F.lower("segment"), F.lit(VERSION), F.lit(1)), lambda v: F.regexp_replace(v, r"(\.0)+$", "")))
    near = near.join(F.broadcast(versions), "template").join(found.select("s", said.alias("said")), "s")
    near = near.where("size(said) = 0 or size(versions) = 0 or arrays_overlap(said, versions)")
    best = near.groupBy("s").agg(F.max_by(F.struct("licence", "score"), F.struct("score", -F.col("template"))).alias("best")).select("s", "best.*")
    # an SPDX tag says itself what it is, whatever else its segment says
    names = sorted({r.licence for r in known.select("licence").distinct().collect()})
    tag = F.regexp_replace(F.lower(F.regexp_extract("segment", SPDX, 1)), r"(-only|-or-later|\+)$", "")
    named = found.where(F.col("segment").rlike(SPDX)).select("s", tag.alias("tag"))
    named = named.join(F.broadcast(spark.createDataFrame([(n.lower(), n) for n in names], "tag string, licence string")), "tag").select("s", "licence", F.lit(1.0).alias("score"))
    return named.unionByName(best.join(named, "s", "left_anti"))


def ancestors(path: str) -> F.Column:
    """The directories above a path, from its own up to the root (''), as (dir, depth)."""
    parts = F.split(path, "/")
    return F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.struct(F.array_join(F.slice(parts, 1, n), "/").alias("dir"), n.alias("depth"))))


def scan(files: DataFrame, known: DataFrame, least: float = 0.6) -> DataFrame:
    """(path, licence, score, via, origin) for every row of files (path, text).

    ``via`` is "own" (a header of the file, or the file itself), "inherited" (from the licence file
    ``origin``), or null where nothing is found. A file's own best segment wins over inheritance;
    of licence files in one directory the first path with a licence counts. Null texts have no
    segments; rows with a null path come back without a licence; rows that share a path share it.
    Whole texts are read, of any length.
    """
    paths = staged(files.select("path"), "paths")
    files, rows = files.where("path is not null").select("path", "text"), known.collect()
    vocabulary = sorted({t for r in rows for t in re.findall(TERM, r.text.lower())})
    weights = Weights(rows, *line_frequencies(files, vocabulary), least)
    said = segments(files, weights.needed)
    # the same statement in many files is one segment
    once = staged(said.groupBy("s").agg(F.min("segment").alias("segment"), F.count("*").alias("n")), "distinct-segments")
    hits = spread_join(said.select("path", "s").distinct(), matched(once, known, weights, least), crowded(once, "s"), "s", "path")
    own = staged(hits.groupBy("path").agg(F.max_by(F.struct("licence", "score"), F.struct("score", "licence")).alias("own")), "own-licences")
    own = own.select("path", "own.licence", "own.score")
    folder = F.regexp_replace(F.regexp_extract("path", r"^(.*/)?[^/]*$", 1), "/$", "")
    holders = own.where(F.col("path").rlike(LICENCE_FILE)).withColumn("dir", folder)
    holders = staged(holders.groupBy("dir").agg(F.min(F.struct("path", "licence", "score")).alias("holder")), "holders")
    # only ancestors that may hold a licence file are shuffled
    up = paths.where("path is not null").distinct().select("path", ancestors("path").alias("up")).select("path", "up.dir", "up.depth")
    up = maybe_in(up.withColumn("_k", F.xxhash64("dir")), "_k", bitmap(holders.select(F.xxhash64("dir").alias("_k")), "_k")).drop("_k")
    # below a licence file of the root lie all paths, so the directories with many are spread
    up = staged(up, "paths-below")
    below = staged(up.groupBy("dir").agg(F.count("*").alias("n")), "directory-sizes")
    near = spread_join(up, holders, crowded(below, "dir"), "dir", "path").groupBy("path").agg(F.max_by("holder", "depth").alias("holder"))
    given = own.select("path", "licence", "score", F.lit("own").alias("via"), F.col("path").alias("origin")).unionByName(
        near.join(own, "path", "left_anti").select("path", "holder.licence", "holder.score", F.lit("inherited").alias("via"), F.col("holder.path").alias("origin"))
    )
    return paths.join(given, "path", "left").select("path", "licence", "score", "via", "origin")


def document_path(source: str = "source", doc_id: str = "doc_id") -> F.Column:
    """A place in a tree for a document: source / thousands / hundreds / tens / file.

    Documents of a round number are the LICENSE file of the largest directory that begins with them.
    """
    i = F.col(doc_id)
    step = lambda n: F.expr(f"cast({doc_id} div {n} as string)")
    root = F.coalesce(F.col(source), F.lit("none"))
    name = F.concat(F.lit("LICENSE-"), i.cast("string"))
    return (
        F.when(i % 1000 == 0, F.concat_ws("/", root, step(1000), name))
        .when(i % 100 == 0, F.concat_ws("/", root, step(1000), step(100), name))
        .when(i % 10 == 0, F.concat_ws("/", root, step(1000), step(100), step(10), name))
        .otherwise(F.concat_ws("/", root, step(1000), step(100), step(10), F.concat(i.cast("string"), F.lit(".txt"))))
    )


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    files = docs.select(document_path().alias("path"), "text")
    out = scan(files, templates(spark))
    return out.select(F.regexp_extract("path", r"([0-9]+)(?:\.txt)?$", 1).cast("long").alias("doc_id"), "path", "licence", "score", "via", "origin")
