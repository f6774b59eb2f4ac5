"""Licence scans: TF-IDF cosine to templates, then inheritance from directories.

Every line and every paragraph of every text, and every licence file as a whole, is
compared with notice templates as sparse TF-IDF vectors; document frequencies come from all texts. A file
without a licence of its own takes that of the nearest ancestor directory that holds a
licence file, found by joining paths. All of it is DataFrame operations.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, splittable, written

#: Notices by licence: fixed values.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("proprietary", "All rights reserved."),
    ("proprietary", "Copyright. All rights reserved."),
)
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice)([-._].*)?$"
THRESHOLD = 0.6
#: What separates tokens.
GAP = "[^a-z0-9]+"
#: What separates paragraphs: a line without tokens, and all such lines after it.
BREAK = "\n[^a-z0-9\n]*\n[^a-z0-9]*"


def tokens(text: str) -> list[str]:
    return [x for x in re.split(GAP, text.lower()) if x]


def _tokens(text: Column) -> Column:
    """Of a text in small letters."""
    return F.filter(F.split(text, GAP), lambda x: x != "")


def idf(n: int, df: int) -> float:
    return math.log((1 + n) / (1 + df)) + 1


class Weights:
    """Unit template vectors, and which tokens a text must share one of to come near."""

    def __init__(self, n: int, df: dict[str, int], templates: tuple[tuple[str, str], ...], threshold: float):
        self.templates = templates
        self.vocabulary = sorted({t for _, text in templates for t in tokens(text)})
        self.idf = {t: idf(n, df.get(t, 0)) for t in self.vocabulary}
        self.n = n
        self.threshold = threshold
        self.vectors: list[dict[str, float]] = []
        needed: set[str] = set()
        for _, text in templates:
            own: dict[str, float] = {}
            for t in tokens(text):
                own[t] = own.get(t, 0.0) + self.idf[t]
            size = math.sqrt(sum(w * w for w in own.values()))
            unit = {t: w / size for t, w in own.items()}
            self.vectors.append(unit)
            # Without any of the heaviest tokens the cosine stays below the threshold.
            rest = 1.0
            for t, w in sorted(unit.items(), key=lambda x: (-x[1], x[0])):
                if math.sqrt(max(0.0, rest)) < threshold * (1 - 1e-9):
                    break
                needed.add(t)
                rest -= w * w
        self.needed = sorted(needed)


def _map(pairs: dict[str, float]) -> Column:
    keys = sorted(pairs)
    return F.map_from_arrays(F.array(*(F.lit(k) for k in keys)), F.array(*(F.lit(float(pairs[k])) for k in keys)))


def _adding(weights: Column):
    return lambda a, t: a + F.coalesce(F.element_at(weights, t), F.lit(0.0))


def _best(hopeful: DataFrame, counts: DataFrame, w: Weights) -> DataFrame:
    """(_row, _best) of ``_hopeful`` units: struct(cosine, template) of the template nearest to
    any of a row's token arrays."""
    # Tokens of no template weigh by their own document frequency.
    odd = hopeful.select("_row", "_at", F.explode("o").alias("token")).groupBy("_row", "_at", "token").agg(F.count("*").alias("tf"))
    heavy = F.log((1.0 + F.lit(w.n)) / (1.0 + F.col("df"))) + 1.0
    odd = odd.join(splittable(counts), "token").groupBy("_row", "_at").agg(F.sum(F.pow(F.col("tf") * heavy, F.lit(2.0))).alias("odd"))
    own = hopeful.join(splittable(odd), ["_row", "_at"], "left")
    own = own.select("_row", "dots", F.sqrt(F.col("square") + F.coalesce("odd", F.lit(0.0))).alias("norm"))
    # Rounded, so that ties don't hang on the order of sums; ties go to the first template.
    found = F.transform("dots", lambda d, j: F.struct(F.round(F.when(F.col("norm") > 0, d / F.col("norm")).otherwise(0.0), 9).alias("cosine"), (-j).alias("template")))
    return own.select("_row", F.array_max(found).alias("_best")).groupBy("_row").agg(F.max("_best").alias("_best"))


def _hopeful(units: DataFrame, w: Weights) -> DataFrame:
    """(_row, _at, o, dots, square) of the ``units`` (_row, _at, t) that may reach the threshold:
    tokens of no template, products with the templates, the square of the known tokens' length.

    No token weighs less than 1, as none is in more texts than there are, so the length of all
    the others is at least that of their counts. One step a column of intermediate results, so
    that nothing is computed twice.
    """
    weight = _map(w.idf)
    known = lambda t: F.map_contains_key(weight, t)
    own = units.select("_row", "_at", F.filter("t", known).alias("m"), F.filter("t", lambda t: ~known(t)).alias("o"))
    square = F.aggregate(
        F.array_distinct("m"),
        F.lit(0.0),
        lambda a, d: a + F.pow(F.size(F.filter("m", lambda x: x == d)).cast("double") * F.element_at(weight, d), F.lit(2.0)),
    )
    dots = [F.aggregate("m", F.lit(0.0), _adding(_map({t: x * w.idf[t] for t, x in vector.items()}))) for vector in w.vectors]
    own = own.select("_row", "_at", "o", F.array(*dots).alias("dots"), square.alias("square"))
    # Written, as the optimizer would compute all of it again in the filter.
    own = written(own, "units")
    # At least one of each, so that counting them suffices.
    least = F.sqrt(F.col("square") + F.size("o"))
    out = own.where(F.array_max("dots") >= (w.threshold - 1e-6) * least)
    out._tessera_path = own._tessera_path  # for ``discard``
    return out


def frequencies(files: DataFrame, text_col: str) -> DataFrame:
    """(token, df): number of texts that hold each token; the empty token stands for all texts."""
    held = F.array_distinct(F.array_append(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), GAP), F.lit("")))
    return files.select(F.explode(held).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def scan(
    files: DataFrame,
    path_col: str = "path",
    text_col: str = "text",
    templates: tuple[tuple[str, str], ...] = TEMPLATES,
    threshold: float = THRESHOLD,
    licence_file: str = LICENCE_FILE,
) -> DataFrame:
    """``files`` without its text and with licence, similarity, via and inherited_from.

    A file's own licence is that of the template nearest to any of its lines or paragraphs,
    or to the whole of a licence file, if the cosine reaches ``threshold``; via is then 'own'. Else
    it is the licence of the nearest ancestor directory, its own included, with a licence
    file that has one ('inherited'; of several the most similar, then the smallest path).
    Else all four are null. Null and empty texts have no licence of their own; null paths
    inherit none; repeated rows stay; an empty table gives an empty one. Columns of
    ``files`` by the new names are replaced.
    """
    new = ("licence", "similarity", "via", "inherited_from")
    kept = [c for c in files.columns if c != text_col and c not in new]
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    path = F.col(f"`{path_col}`").cast("string")
    first = Weights(0, {}, templates, threshold)
    counts = written(frequencies(files.select(text.alias("text")), "text"), "frequencies")
    df = {r["token"]: r["df"] for r in counts.where(F.col("token").isin(["", *first.vocabulary])).collect()}  # a row a token
    w = Weights(df.pop("", 0), df, templates, threshold)
    needed = F.array(*(F.lit(t) for t in w.needed))
    named = F.coalesce(F.element_at(F.split(path, "/"), -1).rlike(licence_file), F.lit(False))
    low = F.lower(text)
    near = lambda x: F.arrays_overlap(x, needed)
    lines = F.transform(F.split(low, "\n"), _tokens)
    # A paragraph of one line is that line.
    wrapped = F.transform(F.filter(F.split(low, BREAK), lambda x: x.contains("\n")), _tokens)
    units = F.concat(F.filter(F.concat(lines, wrapped), near), F.when(named, F.array(_tokens(low))).otherwise(F.expr("array()")))
    units = F.when(near(F.split(low, GAP)), units)
    names = F.array(*(F.lit(n) for n, _ in templates))
    # Written, as several plans read it and none should compare texts again.
    units_ = written(files.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("_kept"), path.alias("_path"), named.alias("_named"), units.alias("_units"), F.monotonically_increasing_id().alias("_row")), "lines")
    hopeful = _hopeful(units_.select("_row", F.posexplode("_units").alias("_at", "t")), w)
    best = _best(hopeful, counts, w)
    own = written(units_.drop("_units").join(splittable(best), "_row", "left").drop("_row"), "licences")
    discard(units_)
    discard(hopeful)
    discard(counts)
    own = own.withColumn("_own", F.when(F.col("_best.cosine") >= threshold, F.element_at(names, 1 - F.col("_best.template"))))
    # A licence file speaks for its directory.
    directory = F.regexp_replace("_path", "/?[^/]*$", "")
    held = own.where("_named and _own is not null and _path is not null").groupBy(directory.alias("dir")).agg(
        F.min_by(F.struct("_own", "_path"), F.struct(-F.col("_best.cosine"), F.col("_path"))).alias("speaks"),
    )
    held = splittable(held.select("dir", "speaks"))
    parts = F.split("_path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    asks = own.where("_own is null and _path is not null").select("_path").distinct()
    asks = asks.select("_path", F.posexplode(above).alias("depth", "dir"))
    heirs = asks.join(held, "dir").groupBy("_path").agg(F.max_by("speaks", "depth").alias("_from"))
    heirs = splittable(heirs.select(F.col("_path").alias("_heir"), "_from"))
    out = own.join(heirs, (F.col("_path") == F.col("_heir")) & F.col("_own").isNull(), "left")
    return out.select(
        *(F.col(f"_kept.`{c}`") for c in kept),
        F.coalesce("_own", "_from._own").alias("licence"),
        F.when(F.col("_own").isNotNull(), F.col("_best.cosine")).alias("similarity"),
        F.when(F.col("_own").isNotNull(), "own").when(F.col("_from").isNotNull(), "inherited").alias("via"),
        F.col("_from._path").alias("inherited_from"),
    )
