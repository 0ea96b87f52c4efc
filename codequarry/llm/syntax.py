"""Problem 1: source files that do not parse."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm import grammars
from codequarry.llm.common import columns_or_null, newest, struct_of


@F.pandas_udf(struct_of(**{"parses": "boolean", "parses_as": "array<string>"}))
def _examine(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for languages, texts in parts:
        rows = [(None, None) if language not in grammars.LANGUAGES or text is None else grammars.examine(language, text) for language, text in zip(languages, texts)]
        yield pd.DataFrame({"parses": pd.array([r[0] for r in rows], dtype="boolean"), "parses_as": [r[1] for r in rows]})


def check_syntax(modules: DataFrame, source_files: DataFrame) -> DataFrame:
    """One row for each (project_id, file_path) of ``modules``: language, status, parses_as.

    Every file is parsed by all grammars, in the order of a ranking by tokens; ``parses_as`` lists those that
    accept it, best ranked first.  Its language is the one given (where that is null, the one its path's
    ending stands for): if that isn't among them but another is, the ending is wrong; if none is, the file is corrupt.

    Status: ``ok``, ``wrong_language``, ``corrupt``; ``unsupported`` for a language without a
    grammar; ``missing`` where there is no content (no row in ``source_files``, or null content).
    An empty text is parsed like any other (valid Python, invalid JSON).  Of several rows for a
    file the newest counts; rows with a null project or path are left out; other columns are
    ignored.
    """
    m = columns_or_null(modules, project_id="string", file_path="string", language="string").groupBy("project_id", "file_path").agg(F.max(F.lower("language")).alias("language"))
    ending = F.lower(F.regexp_extract("file_path", r"\.([A-Za-z0-9]+)$", 1))
    known = F.create_map(*[F.lit(x) for pair in grammars.ENDINGS.items() for x in pair])
    m = m.withColumn("language", F.coalesce("language", F.try_element_at(known, ending)))
    s = newest(columns_or_null(source_files, project_id="string", file_path="string", ingested_at="timestamp_ntz", content="string"), ["project_id", "file_path"], "ingested_at").drop("ingested_at")
    found = m.join(s, ["project_id", "file_path"], "left").withColumn("_r", _examine("language", "content"))
    status = (
        F.when(F.col("content").isNull(), "missing").when(F.col("_r.parses").isNull(), "unsupported").when(F.col("_r.parses"), "ok")
        .when(F.size("_r.parses_as") > 0, "wrong_language").otherwise("corrupt")
    )
    return found.where("project_id is not null and file_path is not null").select("project_id", "file_path", "language", status.alias("status"), F.col("_r.parses_as").alias("parses_as"))


def broken_rates(checked: DataFrame) -> DataFrame:
    """Files, broken files and their share for each project_id and language (of files with a verdict)."""
    broken = F.col("status").isin("wrong_language", "corrupt")
    seen = checked.where(F.col("status").isin("ok", "wrong_language", "corrupt"))
    return seen.groupBy("project_id", "language").agg(
        F.count("*").alias("files"), F.sum(broken.cast("long")).alias("broken"), F.sum((F.col("status") == "wrong_language").cast("long")).alias("wrong_language"), F.round(F.avg(broken.cast("double")), 6).alias("broken_rate")
    )
