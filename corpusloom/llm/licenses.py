"""Licences of files: sparse TF-IDF cosine of notices to templates, then inheritance from the nearest directory. SQL only.

Lines that speak of a licence are picked from whole texts and compared, as distinct lines, with the templates; document
frequencies are counted over all such lines. Lines, paragraphs, runs of paragraphs that speak of a licence, and licence files as a whole
are also compared with full texts, headers and SPDX forms, whose own frequencies weigh the terms. A licence file speaks for its directory and what lies below it, unless a nearer
directory or the file itself says otherwise.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import text_of
from corpusloom.llm.licence_templates import texts

THRESHOLD = 0.5
#: Notices as their licences ask for them; fixed public texts, one or more for a licence.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("MIT", "Released under the MIT License"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-4.0", "Licensed under a Creative Commons Attribution 4.0 International License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms are permitted under the BSD 3-Clause License"),
    ("MPL-2.0", "Subject to the terms of the Mozilla Public License, v. 2.0"),
)

#: What lines about a licence hold, and how licence files are named.
SPEAKS = r"(?i)licen[sc]|copyright|spdx|creative commons|redistribution and use"
LICENCE_FILE = r"(?i)^(licen[sc]e|copying|notice|unlicense)([.-].*)?$"


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z]+|[0-9]+(?:\.[0-9]+)*"), 0)


def notices(files: DataFrame) -> DataFrame:
    """``(path, line)``: distinct lines of each text that speak of a licence."""
    lines = F.array_distinct(F.filter(F.split(F.col("text"), "\n"), lambda x: x.rlike(SPEAKS)))
    return files.where(F.col("text").rlike(SPEAKS)).select("path", F.explode(lines).alias("line"))


def line_licences(lines: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``(line, licence, score)`` for the distinct lines that reach ``threshold``; ties go to the first licence by name."""
    spark = lines.sparkSession
    distinct = lines.groupBy("line").agg(F.count("*").alias("n"))
    terms = distinct.select("line", "n", F.explode(_terms(F.col("line"))).alias("term")).groupBy("line", "n", "term").agg(
        F.count("*").alias("tf")
    )
    frequency = terms.groupBy("term").agg(F.sum("n").alias("df"))
    total = distinct.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    idf = frequency.crossJoin(F.broadcast(total)).select(
        "term", (F.log((F.col("total") + 1) / (F.col("df") + 1)) + 1).alias("idf")
    )
    given = spark.createDataFrame([(k, name, text) for k, (name, text) in enumerate(templates)], "k int, licence string, body string")
    # The templates are a fixed list, so what is broadcast does not grow with the files.
    wanted = given.select("k", "licence", F.explode(_terms(F.col("body"))).alias("term")).groupBy("k", "licence", "term").agg(
        F.count("*").alias("tf")
    ).join(idf, "term", "left").crossJoin(F.broadcast(total)).select(
        "k", "licence", "term", (F.col("tf") * F.coalesce("idf", F.log(F.col("total") + 1) + 1)).alias("template_weight")
    )
    norms = wanted.groupBy("k").agg(F.sqrt(F.sum(F.pow("template_weight", F.lit(2)))).alias("template_norm"))
    wanted = wanted.join(norms, "k")
    weighted = terms.join(idf, "term").select("line", "term", (F.col("tf") * F.col("idf")).alias("weight"))
    lengths = weighted.groupBy("line").agg(F.sqrt(F.sum(F.pow("weight", F.lit(2)))).alias("norm"))
    scores = weighted.join(F.broadcast(wanted), "term").groupBy("line", "k", "licence", "template_norm").agg(
        F.sum(F.col("weight") * F.col("template_weight")).alias("dot")
    ).join(lengths, "line").select("line", "licence", F.round(F.col("dot") / (F.col("norm") * F.col("template_norm")), 9).alias("score"))
    best = scores.groupBy("line").agg(F.min(F.struct((-F.col("score")).alias("order"), "licence")).alias("best"))
    return best.select("line", F.col("best.licence").alias("licence"), (-F.col("best.order")).alias("score")).where(
        F.col("score") >= threshold
    )


def passages(files: DataFrame) -> DataFrame:
    """``(path, passage)``: lines, paragraphs and runs of paragraphs that speak of a licence; of licence files also the whole text."""
    speaks = lambda x: x.rlike(SPEAKS)
    text = F.translate(F.col("text"), "\u0001", "\n")
    # Lines without letters and digits, such as those that only go on with a comment, end a paragraph.
    paragraphs = F.filter(F.split(text, r"\n[^\p{L}\p{N}\n]*+\n"), lambda x: x.rlike(r"[\p{L}\p{N}]"))
    runs = F.split(F.array_join(F.transform(paragraphs, lambda x: F.when(speaks(x), F.concat(x, F.lit("\n"))).otherwise("\u0001")), ""), "\u0001+")
    whole = F.when(F.regexp_extract("path", "[^/]*$", 0).rlike(LICENCE_FILE), F.array("text")).otherwise(F.expr("cast(array() as array<string>)"))
    found = F.array_distinct(F.concat(F.filter(F.split("text", "\n"), speaks), F.filter(paragraphs, speaks), F.transform(F.filter(runs, speaks), F.trim), whole))
    return files.where(F.col("text").rlike(SPEAKS)).select("path", F.explode(found).alias("passage"))


def passage_licences(keys: DataFrame, templates: tuple[tuple[str, str], ...] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``(key, licence, score)`` for the ``(key, passage)`` that reach ``threshold``, a key a row; ties go to the first by name.

    Terms weigh by the number of templates that hold them; those that none holds weigh most, so that other words count against a
    passage. A passage whose known terms alone cannot reach the threshold meets no template.
    """
    templates = texts() if templates is None else templates
    given = keys.sparkSession.createDataFrame([(k, *row) for k, row in enumerate(templates)], "k int, licence string, body string")
    held = given.select("k", "licence", F.explode(_terms(F.col("body"))).alias("term")).groupBy("k", "licence", "term").agg(F.count("*").alias("tf"))
    idf = held.groupBy("term").agg((F.log(F.lit(len(templates) + 1.0) / (F.count("*") + 1)) + 1).alias("idf"))
    wanted = held.join(idf, "term").withColumn("template_weight", F.col("tf") * F.col("idf"))
    norms = wanted.groupBy("k").agg(F.sqrt(F.sum(F.pow("template_weight", F.lit(2)))).alias("template_norm"))
    wanted = wanted.join(norms, "k").select("k", "licence", "term", (F.col("template_weight") / F.col("template_norm")).alias("template_weight"))
    terms = keys.select("key", F.explode(_terms(F.col("passage"))).alias("term")).groupBy("key", "term").agg(F.count("*").alias("tf"))
    weighted = terms.join(F.broadcast(idf), "term", "left").select(
        "key", "term", F.col("idf").isNotNull().alias("known"), (F.col("tf") * F.coalesce("idf", F.lit(math.log(len(templates) + 1) + 1))).alias("weight")
    )
    square = F.pow("weight", F.lit(2))
    lengths = weighted.groupBy("key").agg(F.sqrt(F.sum(square)).alias("norm"), F.sqrt(F.sum(F.when(F.col("known"), square))).alias("reach"))
    near = lengths.where(F.col("reach") >= (threshold - 1e-6) * F.col("norm")).select("key", "norm")
    scores = weighted.join(near, "key").join(F.broadcast(wanted), "term").groupBy("key", "k", "licence").agg(
        (F.sum(F.col("weight") * F.col("template_weight")) / F.max("norm")).alias("score")
    ).select("key", "licence", F.round("score", 9).alias("score")).where(F.col("score") >= threshold)
    best = scores.groupBy("key").agg(F.min(F.struct((-F.col("score")).alias("order"), "licence")).alias("best"))
    return best.select("key", F.col("best.licence").alias("licence"), (-F.col("best.order")).alias("score"))


def _marked(named: DataFrame, threshold: float) -> DataFrame:
    found = passages(named).select("path", "passage", F.sha2("passage", 256).alias("key"))
    keys = found.groupBy("key").agg(F.first("passage").alias("passage"))
    return found.select("path", "key").join(passage_licences(keys, threshold=threshold), "key").select("path", "licence", "score")


def _directory(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def scan(files: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``(path, licence, score, origin)``, one row for each row of ``files(path, text)``.

    ``origin`` is ``own`` (a notice in the text), the directory the licence comes from, or null without one. Of several notices, or
    licence files in a directory, the best score decides, then the name. Null texts count as empty, null paths as the empty
    one, which lies in the root and owns what its rows say together; repeated paths likewise share their notices.
    """
    named = files.select(F.coalesce("path", F.lit("")).alias("path"), text_of().alias("text"))
    lines = notices(named)
    marked = lines.join(line_licences(lines, templates, threshold), "line").select("path", "licence", "score").unionByName(_marked(named, threshold))
    best = F.min(F.struct((-F.col("score")).alias("order"), "licence"))
    own = marked.groupBy("path").agg(best.alias("own"))
    spoken = own.where(F.regexp_extract("path", "[^/]*$", 0).rlike(LICENCE_FILE)).select(
        _directory(F.col("path")).alias("directory"), F.col("own.licence").alias("licence"), (-F.col("own.order")).alias("score")
    ).groupBy("directory").agg(best.alias("given"))
    # Directories, not files, meet their ancestors: their number does not follow that of the files in a hot one.
    directories = named.select(_directory(F.col("path")).alias("directory")).distinct()
    parts = F.split("directory", "/")
    ancestors = directories.select("directory", F.explode(F.sequence(F.lit(0), F.size(parts))).alias("depth")).select(
        "directory", "depth", F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/").alias("ancestor")
    )
    nearest = ancestors.join(spoken.withColumnRenamed("directory", "ancestor"), "ancestor").groupBy("directory").agg(
        F.max(F.struct("depth", "ancestor", "given")).alias("near")
    )
    rows = named.select("path", _directory(F.col("path")).alias("directory"))
    found = rows.join(own, "path", "left").join(nearest, "directory", "left")
    has = F.col("own").isNotNull()
    return found.select(
        "path", F.coalesce("own.licence", "near.given.licence").alias("licence"),
        F.coalesce(-F.col("own.order"), -F.col("near.given.order")).alias("score"),
        F.when(has, "own").otherwise(F.col("near.ancestor")).alias("origin"),
    )


def document_files(docs: DataFrame) -> DataFrame:
    """``documents`` as files: ``source/lang/thousand/name``; a text that ends in a notice plays its directory's licence file."""
    number = F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))
    ends = F.element_at(F.split(text_of(), "\n"), -1).rlike(SPEAKS)
    return docs.select(
        "doc_id", F.concat_ws(
            "/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")),
            F.coalesce((F.col("doc_id") / 1000).cast("long").cast("string"), F.lit("none")),
            F.concat(F.when(ends, "LICENSE-").otherwise("doc-"), number),
        ).alias("path"), "text",
    )
