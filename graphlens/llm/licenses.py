"""Licences of files: TF-IDF cosine of licence-like lines, of headers (runs of lines in the
wording of licences) and of whole licence files to templates, then inheritance
from the nearest ancestor directory that has a licence file, in DataFrame functions only.

A file without licence lines, or with null or empty text, inherits; without a licensed
ancestor its licence is null and its origin ``none``. Very long texts are read whole, and only
their licence-like parts are weighed. Equal scores go to the template
first by name; several licence files in one directory to the best score, then the least
path. Repeated rows are judged alike, each by itself; an empty table gives no rows. Only a path
and a text are read, whatever the other columns are called.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.llm.common import Scratch, let

_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. {}"
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
)
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
#: Fixed wordings of headers and licence notices.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License CC BY 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC0-1.0", "dedicated to the public domain under the CC0 1.0 Universal public domain dedication"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    *((f"GPL-{n}.0", f"This program is free software{mark} you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation{mark2} either version {n} of the License, or (at your option) any later version.") for n, mark, mark2 in ((2, ";", ";"), (3, ":", ","))),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MIT", "MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    *((name, _BSD.format(end)) for name, end in (("BSD-2-Clause", ""), ("BSD-3-Clause", _BSD_NAMES))),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    *((x, f"SPDX-License-Identifier: {x}") for x in ("Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "ISC", "Unlicense", "MIT", "MPL-2.0")),
    *((x, f"SPDX-License-Identifier: {x}-{kind}") for x in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0") for kind in ("only", "or-later")),
)
CUES = r"(?i)licen[sc]|copyright|permission is hereby|redistribution and use|public domain|spdx|creative commons"


def terms(line: Column) -> Column:
    return F.regexp_extract_all(F.lower(line), F.lit(WORD), F.lit(0))


def lines_of(text: Column) -> Column:
    """Trimmed lines that hold a licence cue."""
    return F.when(
        F.coalesce(text, F.lit("")).rlike(CUES),
        F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x.rlike(CUES)),
    ).otherwise(F.array().cast("array<string>"))


#: What begins a comment line, or a line within one, and what ends it.
MARK, TAIL = r"^\s*(?:/\*+|\*+/?|//+|#+|;+|--+|<!--|%+|\"{3}|'{3})\s*", r"\s*(?:\*+/|-->)?\s*$"
WORD = r"[a-z0-9][a-z0-9+.-]*[a-z0-9+]|[a-z0-9]"
#: Share of a line's words, or of a file's lines, that are of the templates' wording in a header or a licence file.
LIKE = 0.6
#: Names of licence files.
NAMES = r"(?i)(?:^|/)(?:un)?(?:licen[sc]es?|copying|notice)(?:[.-][^/]*)?$"
#: Words of a block from which on it says more than a single line.
LONG = 30


def wording(templates) -> Column:
    return F.array(*(F.lit(w) for w in sorted({w for _, t in templates for w in re.findall(WORD, t.lower())})))


def licence_lines(text: Column, templates) -> Column:
    """The lines without comment marks; those that are not in the wording of licences are one control
    character, those without a word are empty."""
    bare = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, MARK, ""), TAIL, "")))
    known = wording(templates)

    def tagged(x: Column) -> Column:
        return let(F.array_distinct(terms(x)), lambda ws: F.when(F.size(ws) == 0, "").when(F.size(F.array_intersect(ws, known)) >= LIKE * F.size(ws), x).otherwise("\x01"))

    return F.transform(bare, tagged)


def blocks_of(lines: Column) -> Column:
    """Runs of licence lines, over empty ones, that hold a cue, each as one line."""
    runs = F.split(F.array_join(lines, "\n"), "\n?(?:\x01\n?)+")
    return F.filter(F.transform(runs, lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x.rlike(CUES))


def weights(lines: DataFrame, templates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Unit TF-IDF vectors (hash of the line, term, w) and (name, wording, term, w).

    Document frequencies come from all occurrences of all licence lines (``lines``: line,
    n) and the templates. Lines are distinct, so a common one is weighed once.
    """
    words = lines.select(F.xxhash64("line").alias("line"), "n", F.explode(terms(F.col("line"))).alias("term")).groupBy("line", "n", "term").agg(F.count("*").alias("tf"))
    known = templates.select("name", "wording", F.explode(terms(F.col("wording"))).alias("term")).groupBy("name", "wording", "term").agg(F.count("*").alias("tf"))
    total = lines.agg(F.sum("n").alias("t")).crossJoin(templates.agg(F.count("*").alias("k"))).select((F.coalesce("t", F.lit(0)) + F.col("k")).alias("total"))
    df = words.select("term", "n").union(known.select("term", F.lit(1).cast("long"))).groupBy("term").agg(F.sum("n").alias("df"))
    idf = df.crossJoin(F.broadcast(total)).select("term", (F.log((F.col("total") + 1) / (F.col("df") + 1)) + 1).alias("idf"))

    def unit(rows: DataFrame, keys: list[str]) -> DataFrame:
        rows = rows.join(idf, "term").withColumn("w", (1 + F.log("tf")) * F.col("idf"))
        norms = rows.groupBy(*keys).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
        return rows.join(norms, keys).select(*keys, "term", (F.col("w") / F.col("norm")).alias("w"))

    return unit(words, ["line"]), unit(known, ["name", "wording"])


def template_table(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    return spark.createDataFrame(list(templates), "name string, wording string")


def scan(files: DataFrame, path_column: str = "path", text_column: str = "text", least: float = 0.6, templates=TEMPLATES) -> DataFrame:
    """(path, own, score, n_lines, license, origin, license_dir) for each row of ``files``.

    ``own`` is the template most like all licence lines of a licence file together, else a block of ``LONG``
    words or more, else one of the file's licence lines or blocks, by cosine, if that is at least
    ``least``; n_lines counts such lines. A file is a licence file of its directory by its name, or
    if it opens with no comment and ``LIKE`` of its lines, with ``LONG`` words, are in the wording of licences; files without an own licence take that of the
    nearest directory upwards that has one. Inheritance is settled once for each directory, so the
    number of files in one does not matter.
    """
    spark, store = files.sparkSession, Scratch(files.sparkSession, "licenses")
    text = F.coalesce(F.col(text_column), F.lit(""))
    named, cued = F.coalesce(F.col(path_column).rlike(NAMES), F.lit(False)), text.rlike(CUES)
    none = F.array().cast("array<string>")
    rows = files.select(F.col(path_column).alias("path"), lines_of(text).alias("found"), text.alias("text"), cued.alias("cued"), named.alias("named"))
    rows = rows.withColumn("lines", F.when(F.col("cued"), licence_lines(F.col("text"), templates)).otherwise(none))
    worded = lambda x: (x != "") & (x != "\x01")
    plain = F.zip_with(F.split("text", "\n"), F.col("lines"), lambda raw, x: worded(x) & ~raw.rlike(MARK))  # a header's lines are comments
    written = F.array_join(F.filter("lines", worded), " ")
    head = F.get(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), F.lit(0))
    extent = (F.size(F.filter(plain, lambda x: x)) >= LIKE * F.size(F.filter("lines", lambda x: x != ""))) & (F.size(terms(written)) >= LONG) & ~head.rlike(MARK)
    rows = rows.withColumn("is_file", F.col("cued") & (F.col("named") | extent))
    squeezed = F.trim(F.regexp_replace(written, r"\s+", " "))
    rows = store.table(
        rows.select("path", "found", "is_file", blocks_of(F.col("lines")).alias("blocks"), F.when(F.col("is_file"), squeezed).alias("whole")).withColumn("row", F.monotonically_increasing_id()),
        "rows",
    )
    every = F.array_union(F.array_union("found", "blocks"), F.when(F.col("whole").isNull(), none).otherwise(F.array("whole")))
    each = rows.select("row", "path", "is_file", F.explode(F.transform(every, lambda x: F.struct(
        x.alias("line"), F.coalesce(F.col("is_file") & (x == F.col("whole")), F.lit(False)).alias("top"), F.array_contains("found", x).alias("single")
    ))).alias("x")).select("row", "path", "is_file", "x.*")
    lines = each.groupBy("line").agg(F.count("*").alias("n"))
    ours, theirs = weights(lines, template_table(spark, templates))
    cosine = ours.join(theirs.withColumnRenamed("w", "w2"), "term").groupBy("line", "name", "wording").agg(F.sum(F.col("w") * F.col("w2")).alias("cosine"))
    best = cosine.groupBy("line").agg(F.min(F.struct((-F.round("cosine", 6)).alias("minus"), "name")).alias("b")).select(
        "line", F.col("b.name").alias("name"), (-F.col("b.minus")).alias("cosine")
    ).where(F.col("cosine") >= least)
    best = store.table(best, "best")
    long = F.when(F.col("top"), 0).when(F.size(terms(F.col("line"))) >= LONG, 1).otherwise(2)
    keyed = each.select("row", "path", "is_file", "single", long.alias("order"), F.xxhash64("line").alias("key"))
    own = keyed.join(best.withColumnRenamed("line", "key"), "key").groupBy("row", "path", "is_file").agg(
        F.min(F.struct("order", (-F.col("cosine")).alias("minus"), "name")).alias("b"), F.sum(F.col("single").cast("long")).alias("n_lines"),
    )
    own = store.table(own.select("row", "path", F.col("b.name").alias("own"), (-F.col("b.minus")).alias("score"), "is_file", "n_lines"), "own")

    up = lambda d: F.when(F.instr(d, "/") > 0, F.regexp_replace(d, "/[^/]*$", ""))
    licensed = own.where("is_file").groupBy(up(F.col("path")).alias("dir")).agg(
        F.min(F.struct((-F.col("score")).alias("minus"), "path", "own")).alias("b")
    ).select("dir", F.col("b.own").alias("license")).where("dir is not null")
    dirs = rows.select(up(F.col("path")).alias("start")).where("start is not null").distinct()
    pieces = F.split("start", "/")
    chain = dirs.withColumn("depth", F.explode(F.sequence(F.lit(1), F.size(pieces)))).withColumn("dir", F.array_join(F.slice(pieces, F.lit(1), F.col("depth")), "/"))
    nearest = chain.join(licensed, "dir").groupBy("start").agg(F.max(F.struct("depth", "license", "dir")).alias("b")).select(
        "start", F.col("b.license").alias("inherited"), F.col("b.dir").alias("from_dir")
    )
    joined = rows.select("row", "path", F.size("found").alias("candidates")).join(own.drop("path"), "row", "left").join(nearest, up(F.col("path")) == F.col("start"), "left")
    return joined.select(
        "path", "own", "score", F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce("own", "inherited").alias("license"),
        F.when(F.col("own").isNotNull() & F.col("is_file"), "licence_file").when(F.col("own").isNotNull(), "header").when(F.col("inherited").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(F.col("own").isNull(), F.col("from_dir")).alias("license_dir"),
    )


def corpus_paths(documents: DataFrame) -> DataFrame:
    """The documents as files of a tree: <source>/<thousand>/<ten>/<doc_id>, where ids
    divisible by 100 stand in <source> itself and those by 10 one level below it. Documents that
    open with a licence line are the licence files of their folders, LICENSE.<doc_id>."""
    n = F.col("doc_id")
    source = F.coalesce(F.col("source"), F.lit("none"))
    opens = F.coalesce(F.substring_index(F.ltrim("text"), "\n", 1).rlike(CUES), F.lit(False))
    name = F.concat(F.when(opens, "LICENSE.").otherwise(""), F.coalesce(n.cast("string"), F.lit("null")))
    place = F.when(F.coalesce(n % 100 == 0, F.lit(True)), F.concat_ws("/", source, name)).when(n % 10 == 0, F.concat_ws("/", source, F.floor(n / 1000), name)).otherwise(
        F.concat_ws("/", source, F.floor(n / 1000), F.floor(n / 10), name)
    )
    return documents.select(place.alias("path"), "text")
