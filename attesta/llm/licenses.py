"""License scans: sparse TF-IDF cosine to templates, then inheritance along paths.

Units of comparison are the lines of a file and runs of 2, 4 and 8 lines (headers), and the whole file, of any length (licence
files). Terms are runs of ASCII letters and digits, lower case, weighted tf * idf, with idf = ln((N + 1) / (df + 1)) + 1 over all N
files. A unit whose cosine to a template reaches ``threshold`` carries that licence; a file carries that of its best unit (ties: first name).
A file is a licence file if its name says so or if units that carry a licence hold at least half of its words.
A file without a licence of its own inherits that of the licence files in the nearest ancestor directory that has one
(best cosine, then first name).

Only units with an anchor term are scored: a template's anchors are all its terms but the commonest, as many as cannot
reach the threshold alone; so the filter loses nothing. Runs of lines are laid out only around lines with an anchor. Template vocabulary
and anchors are bounded by the templates; they reach the driver and are broadcast. Nulls: a null text has no licence of its own; a null
path has no directory. Repeated rows keep their rows: files are told apart by path and text. Empty tables give no rows. Other columns of
any name are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, table

THRESHOLD = 0.6
#: Lines of a run.
RUNS = (2, 4, 8)


def bag(counts: str) -> str:
    """A text as its terms in order of name, ``term*n`` for one that comes n times; the order of terms does not matter here."""
    return " ".join(t for x in counts.split() for t in [x.split("*")[0]] * int((x.split("*") + ["1"])[1]))


TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("proprietary", "All rights reserved."),
    # full texts
    ("MIT", bag("a*2 above action all an and*5 any*3 arising as associated authors be*2 but charge claim conditions connection contract copies*2 copy*2 copyright*2 damages deal dealings distribute do documentation event express files fitness following for*2 free from furnished granted hereby holders implied in*6 included including*2 is*4 kind liability liable limitation limited merchantability merge modify no noninfringement not notice*2 obtaining of*8 or*9 other*2 otherwise out particular permission*2 permit person persons portions provided publish purpose restriction rights sell shall*2 so software*9 subject sublicense substantial the*14 this*2 to*8 tort use*2 warranties warranty whether whom with without*3")),
    ("BSD-3-Clause", bag("1 2 3 a above*2 advised and*9 any*4 are*3 arising as be*2 binary*2 business but*2 by caused code conditions*3 consequential contract contributors*3 copyright*5 damage damages data derived direct disclaimed disclaimer*2 distribution documentation endorse even event exemplary express fitness following*3 for*2 form forms from goods holder*2 holders however if implied*2 in*6 incidental including*3 indirect interruption is*2 its liability*2 liable limited*2 list*2 loss materials may merchantability met modification must*2 name names negligence neither no nor not*2 notice*2 of*13 on or*11 other otherwise out particular permission permitted possibility prior procurement products profits promote provided*3 purpose redistribution redistributions*2 reproduce retain services shall software*3 source*2 special specific strict substitute such that the*15 theory this*5 to*3 tort use*3 used warranties*2 way whether with*2 without*2 written")),
)


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")


def vectors(files: DataFrame, templates=TEMPLATES) -> tuple[DataFrame, DataFrame, float]:
    """(template, license, term, weight) with unit vectors, (term, idf) of the template vocabulary, and the idf of any other term."""
    spark = files.sparkSession
    raw = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(templates)], "template int, license string, text string")
    tf = raw.select("template", "license", F.explode(terms(F.col("text"))).alias("term")).groupBy("template", "license", "term").agg(F.count(F.lit(1)).alias("tf"))
    vocabulary = sorted({r["term"] for r in tf.select("term").distinct().collect()})
    held = F.array_intersect(terms(F.col("text")), F.array(*[F.lit(t) for t in vocabulary]))
    df = {r["term"]: r["df"] for r in files.select(F.explode(held).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()}
    total = files.count()
    n = F.lit(float(total + 1))
    idf = spark.createDataFrame([(t, df.get(t, 0)) for t in vocabulary], "term string, df long").select("term", (F.log(n / (F.col("df") + 1)) + 1).alias("idf"))
    w = tf.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norm = Window.partitionBy("template")
    return w.select("template", "license", "term", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(norm))).alias("weight")), idf, n


def anchors(vecs: DataFrame, idf: DataFrame, threshold: float) -> list[str]:
    """Terms one of which a unit must have to reach the threshold with any template: all but the commonest of each template, as long as
    a unit of those alone cannot."""
    light = Window.partitionBy("template").orderBy("idf", "term").rowsBetween(Window.unboundedPreceding, 0)
    rest = vecs.join(F.broadcast(idf), "term").withColumn("upto", F.sum(F.col("weight") * F.col("weight")).over(light))
    return sorted({r["term"] for r in rest.where(F.col("upto") >= threshold * threshold - 1e-9).select("term").distinct().collect()})


def units(text: Column, look: str) -> Column:
    """Array of (start, lines, line): the whole text (start and lines 0), each line with a match of ``look``, and each run of lines that
    holds such a line."""
    every = F.split(text, "\n")
    kind = "array<struct<start:int,lines:int,line:string>>"
    hit = F.filter(F.transform(every, lambda s, i: F.when(F.lower(s).rlike(look), i)), lambda i: i.isNotNull())
    made = [F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("lines"), text.alias("line"))).cast(kind)]
    for n in (1, *RUNS):
        start = F.array_distinct(F.flatten(F.transform(hit, lambda i: F.sequence(F.greatest(i - (n - 1), F.lit(0)), F.least(i, F.greatest(F.size(every) - n, F.lit(0)))))))
        if n > 1:
            start = F.when(F.size(every) >= n, start).otherwise(F.array().cast("array<int>"))
        made.append(F.transform(start, lambda i: F.struct(i.alias("start"), F.lit(n).alias("lines"), F.array_join(F.slice(every, i + 1, n), "\n").alias("line"))).cast(kind))
    return F.concat(*made)


def matches(files: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """file (key), n_file (its terms), start, lines (0: the whole file), n_terms, license, score of the units that carry a licence. ``files``
    has file and text."""
    vecs, idf, n = vectors(files, templates)
    vecs, idf = cut(vecs), cut(idf)
    found = anchors(vecs, idf, threshold)
    keys = F.array(*[F.lit(t) for t in found])
    # a quick look for anchors in the raw line spares most lines the cut into terms
    look = f"(?<![a-z0-9])(?:{'|'.join(found)})(?![a-z0-9])"
    unit = files.where(F.lower("text").rlike(look)).select("file", F.size(terms(F.col("text"))).alias("n_file"), F.explode(units(F.col("text"), look)).alias("u"))
    key = ["file", "n_file", "start", "lines"]
    unit = unit.select("file", "n_file", "u.start", "u.lines", terms(F.col("u.line")).alias("terms")).where(F.arrays_overlap("terms", keys))
    tf = unit.select(*key, F.size("terms").alias("n_terms"), F.explode("terms").alias("term")).groupBy(*key, "n_terms", "term").agg(F.count(F.lit(1)).alias("tf"))
    tf = tf.join(F.broadcast(idf), "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.log(n) + 1))
    # a unit's terms become one row: what it shares with the templates' terms, and its length
    held = F.collect_list(F.when(F.col("idf").isNotNull(), F.struct("term", "w")))
    one = tf.groupBy(*key, "n_terms").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), held.alias("held"))
    dot = one.select(*key, "n_terms", "norm", F.explode("held").alias("h")).select(*key, "n_terms", "norm", "h.term", "h.w").join(F.broadcast(vecs), "term")
    got = dot.groupBy(*key, "n_terms", "norm", "template", "license").agg(F.sum(F.col("w") * F.col("weight")).alias("dot")).withColumn("score", F.round(F.col("dot") / F.col("norm"), 9))
    best = got.where(F.col("score") >= threshold).groupBy(*key, "n_terms").agg(F.min(F.struct((-F.col("score")).alias("neg"), "license")).alias("best"))
    return best.select(*key, "n_terms", F.col("best.license").alias("license"), (-F.col("best.neg")).alias("score"))


def folder(path: Column) -> Column:
    """Directory of a path, '' at the top, null for a null path."""
    return F.regexp_extract(path, "^(.*)/", 1)


def scan(files: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, path, license, score, origin (own, inherited, none), from_dir of each row of ``files`` (doc_id, path, text)."""
    key = F.unhex(F.md5(F.concat_ws("\n", F.coalesce("path", F.lit("")), F.coalesce("text", F.lit("")))))
    keyed = files.select("doc_id", "path", "text", key.alias("file"))
    unit = cut(matches(keyed.where(F.col("text").isNotNull()).select("file", "text"), templates, threshold))
    own = unit.groupBy("file").agg(F.min(F.struct((-F.col("score")).alias("neg"), "license")).alias("best"), F.greatest(F.sum(F.when(F.col("lines") == 1, F.col("n_terms")).otherwise(0)), F.max(F.when(F.col("lines") > 1, F.col("n_terms")).otherwise(0))).alias("covered"), F.max(F.when(F.col("lines") == 0, True)).alias("whole"), F.first("n_file").alias("n"))
    # only files with a licence of their own can be licence files; their texts stay where they are
    named = F.regexp_extract("path", "([^/]*)$", 1).rlike(r"(?i)^(license|licence|copying|notice)(\.[a-z]+)?$")
    of = own.join(keyed.select("file", "path").distinct(), "file").where(named | F.coalesce("whole", F.lit(False)) | (2 * F.col("covered") >= F.col("n")))
    of = of.where(F.col("path").isNotNull()).groupBy(folder(F.col("path")).alias("dir")).agg(F.min("best").alias("dir_best"))
    # path joins: each directory of the table meets its ancestors; directories, not files, are exploded
    dirs = keyed.where(F.col("path").isNotNull()).select(folder(F.col("path")).alias("at")).distinct()
    steps = F.split("at", "/")
    up = dirs.select("at", F.explode(F.transform(F.sequence(F.lit(0), F.size(steps)), lambda i: F.array_join(F.slice(steps, 1, i), "/"))).alias("dir")).distinct()
    near = up.join(of, "dir").groupBy("at").agg(F.max_by(F.struct("dir", "dir_best"), F.length("dir")).alias("near"))
    out = keyed.select("doc_id", "path", "file", folder(F.col("path")).alias("at")).join(own.select("file", "best"), "file", "left").join(near, "at", "left")
    mine, got = F.col("best").isNotNull(), F.col("near").isNotNull()
    pick = F.when(mine, F.col("best")).otherwise(F.col("near.dir_best"))
    return out.select(
        "doc_id", "path", pick["license"].alias("license"), (-pick["neg"]).alias("score"),
        F.when(mine, "own").when(got, "inherited").otherwise("none").alias("origin"),
        F.when(~mine, F.col("near.dir")).alias("from_dir"),
    )


def op8_license_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce(F.col("source"), F.lit("unknown")), F.floor(F.col("doc_id") / 64).cast("string"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return scan(docs.select("doc_id", path.alias("path"), "text"))
