"""Problem 3: generated, minified, vendored and blob files, by belief propagation over directory trees."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.llm.common import columns_or_null, newest, stored, struct_of

LABELS = ("handwritten", "generated", "minified", "vendored", "blob")
PRIOR = (2.0, 0.0, 0.0, 0.0, 0.0)

#: Log-probability of an entry's label (column) given that of its directory (row).  A directory of
#: third-party code holds nothing written by hand; other labels only make their like more probable.
COMPATIBLE = tuple(
    tuple(math.log(p) for p in row)
    for row in (
        (0.80, 0.05, 0.04, 0.07, 0.04),
        (0.25, 0.69, 0.02, 0.02, 0.02),
        (0.30, 0.02, 0.64, 0.02, 0.02),
        (1e-26, 0.02, 0.04, 0.92, 0.02),
        (0.40, 0.05, 0.05, 0.05, 0.45),
    )
)

#: Names of directories that package managers and build tools fill.
VENDOR_DIRS = frozenset("vendor vendored third_party thirdparty third-party 3rdparty node_modules bower_components jspm_packages site-packages dist-packages external externals deps godeps pods carthage".split())
GENERATED_DIRS = frozenset("gen generated autogen auto_generated __generated__ _generated generated-sources generated_src".split())
MINIFIED_DIRS = frozenset("dist min minified".split())

# --- evidence of a text ----------------------------------------------------------------------------

_COMMENT_HEAD = re.compile(r"\A(?:\s|#![^\n]*\n|['\"]use strict['\"];?|<\?xml[^>]*>|<!--[\s\S]*?-->|/\*[\s\S]*?(?:\*/|\Z)|(?://|#|--|;|%)[^\n]*(?:\n|\Z)|\"\"\"[\s\S]*?(?:\"\"\"|\Z)|'''[\s\S]*?(?:'''|\Z))+")
_GENERATED = re.compile(
    r"(?i)@generated\b|<auto-?generated\b|\bauto-?generated (?:file|code|by|from)|\bautogenerated\b|\bgenerated (?:file|code)\b[^\n]*\bdo not\b|\bcode generated\b|\bgenerated (?:by|from|with|using)\b|\b(?:automatically|machine)[ -](?:created|generated|produced|written)\b"
    r"|\bdo not (?:edit|modify|change)\b|\bmanual changes will be (?:lost|overwritten)|\bedit the (?:template|source|schema|generator)\b[^\n]*\b(?:instead|not)\b|\bproduced (?:from|by)\b[^\n]*\b(?:regenerate|schema|idl|proto)\b|\bregenerate with\b|\boutput of [\w-]*(?:gen|codegen|compiler|generator)\b"
    r"|\b(?:automatisch|maschinell) (?:erzeugt|generiert|erstellt)\b|\bnicht (?:bearbeiten|(?:ver)?ändern)\b|\bne pas (?:modifier|éditer)\b|\b(?:fichier )?(?:généré|produit) (?:automatiquement )?par\b|\bgenerado (?:automáticamente )?por\b|\bno (?:editar|modificar)\b|\bgenerato (?:automaticamente )?da\b"
)
_BY_HAND = re.compile(r"(?i)\b(?:kept|written|edited|maintained) by hand\b|\bhand-?(?:written|maintained|edited)\b|\bused to be generated\b|\bno longer generated\b|\bnot (?:a )?(?:vendored|generated|minified)\b|\bwritten here\b")
_THIRD_PARTY = re.compile(
    r"(?im)^[\W_]*[\w@/.+-]+ v?\d+\.\d+(?:\.\d+)*\b[^\n]{0,20}(?:copyright|\(c\)|©)[^\n]*|released under the [^\n]*licen[cs]e|^\W*@license\b|\blicensed under the (?:mit|apache|bsd|isc|mpl|gpl|lgpl)\b|\bpermission is hereby granted, free of charge|\bredistribution and use in source and binary forms|\bspdx-license-identifier:|\bvendored from\b|\bcopied from\b[^\n]*\bv?\d+\.\d+|\b(?:imported|bundled) from [\w./@-]+ v?\d+\.\d+"
)
_BASE64 = re.compile(r"[A-Za-z0-9+/]{60,}={0,2}")
_NUMBERS = re.compile(r"(?:[-+]?(?:0[xX][0-9a-fA-F]+|\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)[fFlLuU]*\s*[,;\s]\s*){8,}")
_HEX = re.compile(r"(?:\\x[0-9a-fA-F]{2}){12,}|(?:[0-9a-fA-F]{2}[ ,]){24,}|[0-9a-f]{96,}")
_COUNTER = re.compile(r"[A-Za-z_\])](\d{1,4})\b(?!\.\d)|\(\s*(\d{1,4}),")


def evidence(text: str) -> tuple:
    """(characters, characters in dense lines, characters in data runs, code lines, counted lines,
    marks of generation, marks of third parties, marks of hand work) of one record."""
    head_match = _COMMENT_HEAD.match(text)
    head = head_match[0] if head_match else ""
    by_hand = bool(_BY_HAND.search(head))
    generated = bool(_GENERATED.search(re.sub(r"(?i)\bregenerate the\b", "", head))) and not by_hand
    third = bool(_THIRD_PARTY.search(head)) and not by_hand
    data = sum(m.end() - m.start() for p in (_BASE64, _NUMBERS, _HEX) for m in p.finditer(text)) if len(text) > 80 else 0
    dense = lines = counted = 0
    last, series = -2, 0
    for line in text.split("\n"):
        s = line.strip()
        if not s:
            continue
        lines += 1
        n = len(s)
        if n > 150:
            spaces = s.count(" ")
            marks = sum(map(s.count, "{}();=,:.[]&|?!+-"))
            if spaces < 0.08 * n and marks > 0.12 * n and not (_BASE64.search(s) or _NUMBERS.search(s)):
                dense += n
        if n < 200:
            m = _COUNTER.search(s)
            if m:
                value = int(m[1] or m[2])
                if value in (last, last + 1):
                    series += 1
                    counted += 1 if series > 1 else 0
                    if series == 1:
                        counted += 2
                else:
                    series = 0
                last = value
    return len(text), dense, min(data, len(text)), lines, min(counted, lines), int(generated), int(third), int(by_hand)


_FIELDS = ("chars", "dense", "data", "code_lines", "counted", "generated", "third", "by_hand")


@F.pandas_udf(struct_of(**{f: "long" for f in _FIELDS}))
def _evidence(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in parts:
        yield pd.DataFrame([evidence(t) if t else (0,) * len(_FIELDS) for t in texts], columns=list(_FIELDS), dtype="int64")


def _line_hashes(text: Column, least: int = 24) -> Column:
    """Hashes of the lines that say something (trimmed, of at least ``least`` characters)."""
    return F.transform(F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: F.length(x) >= least), lambda x: F.xxhash64(x))


def upstream_overlap(told: DataFrame, upstream: DataFrame) -> DataFrame:
    """project_id, file_path, matched: lines of a file (chunks with ``lines``) that one known third-party file has too, most of any.

    A line counts 1 / the number of packages that have it, so that what many packages share says little and the
    versions of one package don't weaken each other."""
    known = columns_or_null(upstream, upstream_id="string", package_name="string", text="string")
    known = known.select("upstream_id", F.coalesce("package_name", "upstream_id").alias("_package"), F.explode(F.array_distinct(_line_hashes(F.col("text")))).alias("_line")).distinct()
    weight = known.groupBy("_line").agg((1.0 / F.countDistinct("_package")).alias("_w"))
    known = stored(known.join(weight, "_line").select("_line", "upstream_id", "_w").distinct())
    lines = told.select("project_id", "file_path", F.explode("lines").alias("_line"))
    return lines.join(known, "_line").groupBy("project_id", "file_path", "upstream_id").agg(F.sum("_w").alias("matched")).groupBy("project_id", "file_path").agg(F.max("matched").alias("matched"))


def file_evidence(chunks: DataFrame, upstream: DataFrame) -> DataFrame:
    """One row for each file: summed evidence of its newest chunks."""
    c = columns_or_null(chunks, chunk_id="string", project_id="string", file_path="string", language="string", start_line="int", ingested_at="timestamp_ntz", text="string").where("project_id is not null and file_path is not null")
    lines = F.coalesce(_line_hashes(F.col("text")), F.array().cast("array<bigint>"))
    told = c.select("project_id", "file_path", "language", "chunk_id", "ingested_at", lines.alias("lines"), _evidence("text").alias("e")).select("*", "e.*").drop("e")
    told = stored(newest(told, ["chunk_id"], "ingested_at"))  # read twice below, by columns; the texts are scanned once
    matched = upstream_overlap(told, upstream)
    sums = [F.sum(f).alias(f) for f in ("chars", "dense", "data", "lines", "counted")] + [F.max(f).alias(f) for f in ("generated", "third", "by_hand")]
    files = told.withColumn("said", F.size("lines").cast("long")).withColumnRenamed("lines", "_lines").withColumnRenamed("code_lines", "lines")
    files = files.groupBy("project_id", "file_path").agg(F.max(F.lower("language")).alias("language"), F.sum("said").alias("said"), *sums)
    return files.join(matched, ["project_id", "file_path"], "left").withColumn("matched", F.coalesce("matched", F.lit(0.0)))


def _own(files: DataFrame) -> list[Column]:
    """Log-likelihoods of the labels from a file's own text and name."""
    name = F.lower(F.element_at(F.split("file_path", "/"), -1))
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    prose = F.coalesce(F.col("language").isin("markdown", "rst", "text", "sql", "yaml", "toml", "ini"), F.lit(False))
    is_data_file = F.coalesce(F.col("language").isin("json", "yaml", "xml", "csv"), F.lit(False))
    on = lambda condition, weight: F.when(condition, F.lit(float(weight))).otherwise(F.lit(0.0))
    copied = share("matched", "said")
    dense, data, counted = share("dense", "chars"), share("data", "chars"), share("counted", "lines")
    plain = (dense < 0.3) & (data < 0.4) & (counted < 0.4)
    return [
        F.lit(PRIOR[0]) + on(F.col("by_hand") > 0, 8) + on(plain, 3) + on(prose & plain, 4),
        F.lit(PRIOR[1]) + on((F.col("generated") > 0) & (F.col("by_hand") == 0), 9) + on((counted >= 0.4) & (F.col("lines") >= 6), 7) + on(name.rlike(r"(_pb2(_grpc)?\.pyi?|\.pb\.\w+|\.g\.\w+|\.gen\.\w+|_generated\.\w+|\.generated\.\w+|_gen\.go|\.designer\.cs)$"), 6),
        F.lit(PRIOR[2]) + on(dense >= 0.5, 9) + on((dense >= 0.25) & (dense < 0.5), 3) + on(name.rlike(r"[.-]min\.(js|css|mjs)$"), 7) + on(name.rlike(r"[.-][0-9a-f]{6,}\.(js|css)$"), 2),
        F.lit(PRIOR[3]) + on(plain, 3) + on(F.col("third") > 0, 9) + on((copied >= 0.5) & (F.col("matched") >= 4), 9) + on((copied >= 0.25) & (copied < 0.5) & (F.col("matched") >= 4), 6),
        F.lit(PRIOR[4]) + on((data >= 0.5) & ~is_data_file, 9) + on((data >= 0.4) & (data < 0.5) & ~is_data_file, 3),
    ]


def _dir_own(last: Column) -> list[Column]:
    low = F.lower(last)
    on = lambda condition, weight: F.when(condition, F.lit(float(weight))).otherwise(F.lit(0.0))
    return [F.lit(3.0), on(low.isin(*GENERATED_DIRS), 10) - 4, on(low.isin(*MINIFIED_DIRS), 8) - 4, on(low.isin(*VENDOR_DIRS), 60), F.lit(-6.0)]


def _message(vector: Column, matrix) -> Column:
    """log of the sums over a vector of log-probabilities, one for each row of the matrix.

    Arrays and lambdas keep the generated code small, and terms are added up in one pass."""
    rows = F.array(*[F.array(*[F.lit(x) for x in row]) for row in matrix])
    add = lambda a, t: F.greatest(a, t) + F.log1p(F.exp(-F.abs(a - t)))
    return F.transform(rows, lambda row: F.reduce(F.zip_with(row, vector, lambda a, b: a + b), F.lit(-1e300), add))


def _up(vector: Column) -> Column:
    """Message of an entry to its directory."""
    return _message(vector, COMPATIBLE)


def _down(vector: Column) -> Column:
    """Message of a directory, given its belief without the entry, to the entry."""
    return _message(vector, tuple(zip(*COMPATIBLE)))


def _plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def _minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def _summed(rows: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Vectors added up by key, partially before the shuffle."""
    sums = rows.groupBy(*keys).agg(*[F.sum(F.col(vector)[i]).alias(f"_{i}") for i in range(len(LABELS))])
    return sums.select(*keys, F.array(*[f"_{i}" for i in range(len(LABELS))]).alias(vector))


def classify_files(chunks: DataFrame, upstream: DataFrame) -> DataFrame:
    """project_id, file_path, label, confidence of every file in ``chunks``.

    Evidence of a file: marks in its leading comment, dense lines, runs of data, series of counted
    names, its own name, and lines shared with a known third-party file.  Evidence of a directory: its
    name.  Sum-product messages run from the files to the roots of the projects and back, one level of
    directories at a time, so that a file's label also follows from its directory and its siblings.
    Messages of a directory's entries are summed by partial aggregation: no directory is collected.

    There is a step up and down for each level of directories present.  The newest row of a chunk_id counts; null and empty texts add no evidence; rows with a null project or path are left
    out; an empty table gives no rows; ties go to the first of LABELS.
    """
    files = file_evidence(chunks, upstream)
    parts = F.split("file_path", "/")
    depth = F.size(parts) - 1
    files = files.select("project_id", "file_path", F.concat_ws("/", F.slice(parts, 1, F.greatest(depth, F.lit(0)))).alias("dir"), depth.alias("depth"), F.array(*[c.cast("double") for c in _own(files)]).alias("own"))
    files = stored(files.withColumn("up", _up(F.col("own"))))

    # messages of files to their directories; the directories of all levels
    sent = stored(_summed(files, ["project_id", "dir", "depth"], "up"))
    deepest = sent.agg(F.max("depth")).first()[0]
    if deepest is None:
        return files.select("project_id", "file_path", F.lit(None).cast("string").alias("label"), F.lit(None).cast("double").alias("confidence"))
    parent = F.when(F.col("dir").contains("/"), F.regexp_replace("dir", "/[^/]*$", "")).otherwise("")
    levels: dict[int, DataFrame] = {}
    below: DataFrame | None = None
    for level in range(deepest, -1, -1):
        at = sent.where(F.col("depth") == level).select("project_id", "dir", "up")
        if below is not None:
            at = _summed(at.unionByName(below), ["project_id", "dir"], "up")
        last = F.element_at(F.split("dir", "/"), -1)
        at = at.select("project_id", "dir", _plus(F.col("up"), F.array(*[c.cast("double") for c in _dir_own(last)])).alias("belief"))
        levels[level] = at = stored(at.withColumn("up", _up(F.col("belief"))))
        below = at.select("project_id", parent.alias("dir"), "up")

    # beliefs of directories, from the roots down
    beliefs = [levels[0].select("project_id", "dir", "belief")]
    for level in range(1, deepest + 1):
        above = beliefs[-1].select("project_id", F.col("dir").alias("_parent"), F.col("belief").alias("_above"))
        here = levels[level].withColumn("_parent", parent).join(above, ["project_id", "_parent"])
        beliefs.append(stored(here.select("project_id", "dir", _plus(F.col("belief"), _down(_minus(F.col("_above"), F.col("up")))).alias("belief"))))
    dirs = reduce(DataFrame.unionByName, beliefs)

    # and down to the files
    joined = files.join(dirs, ["project_id", "dir"])
    scored = joined.select("project_id", "file_path", _plus(F.col("own"), _down(_minus(F.col("belief"), F.col("up")))).alias("_s"))
    best = F.array_max("_s")
    label = F.element_at(F.array(*[F.lit(x) for x in LABELS]), F.array_position("_s", best).cast("int"))
    total = _message(F.col("_s"), [(0.0,) * len(LABELS)])[0]
    return scored.select("project_id", "file_path", label.alias("label"), F.round(F.exp(best - total), 4).alias("confidence"))
