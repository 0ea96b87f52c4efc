"""The registry of projects and reports on their files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codequarry.functions import tables as t
from codequarry.functions import text as tx
from codequarry.operators.search import newest_by


def listed(projects: DataFrame) -> DataFrame:
    """Newest state of each project; ``position`` by update, newest first, within its status."""
    p = newest_by(projects, ["project_id"], "updated_at")
    return p.withColumn("position", F.row_number().over(Window.partitionBy("status").orderBy(F.col("updated_at").desc_nulls_last(), "project_id")))


def find_existing(projects: DataFrame, wanted: DataFrame) -> DataFrame:
    """request_id, project_id: the newest project that hasn't failed, by URL, else by name and type.

    ``wanted``: request_id, source_url, project_name, source_type."""
    p = newest_by(projects, ["project_id"], "updated_at").where(F.coalesce(F.col("status"), F.lit("")) != "failed")
    url = lambda c: F.regexp_replace(c, "/+$", "")
    newest = F.max(F.struct(F.col("created_at"), F.col("project_id")))
    by_url = p.where("source_url is not null").groupBy(url("source_url").alias("_u")).agg(newest.alias("_a"))
    by_name = p.groupBy("project_name", "source_type").agg(newest.alias("_b"))
    w = wanted.withColumn("_u", url("source_url")).join(by_url, "_u", "left").join(by_name, ["project_name", "source_type"], "left")
    return w.select("request_id", F.coalesce("_a.project_id", "_b.project_id").alias("project_id"))


def update_status(projects: DataFrame, changes: DataFrame) -> DataFrame:
    """``changes``: project_id, status, file_count, chunk_count, error_msg, updated_at; counts left null become 0."""
    c = changes.select("project_id", *[F.col(x).alias(f"_{x}") for x in ("status", "file_count", "chunk_count", "error_msg", "updated_at")], F.lit(True).alias("_hit"))
    j = projects.join(c, "project_id", "left")
    new = {"status": F.col("_status"), "file_count": F.coalesce("_file_count", F.lit(0)), "chunk_count": F.coalesce("_chunk_count", F.lit(0)), "error_msg": F.col("_error_msg"), "updated_at": F.col("_updated_at")}
    return j.select(*[F.when(F.col("_hit"), new[x]).otherwise(F.col(x)).alias(x) if x in new else F.col(x) for x in projects.columns])


def search_names(projects: DataFrame, part: str) -> DataFrame:
    return newest_by(projects, ["project_id"], "updated_at").where(F.contains(F.lower("project_name"), F.lit(part.lower())))


def superseded(projects: DataFrame) -> DataFrame:
    """Projects of a name of which there is a newer one."""
    p = newest_by(projects, ["project_id"], "updated_at")
    return p.withColumn("_r", F.row_number().over(Window.partitionBy("project_name").orderBy(F.col("created_at").desc_nulls_last(), "project_id"))).where("_r > 1").drop("_r")


def files_by_language(files: DataFrame, first: int = 10) -> DataFrame:
    g = files.select("project_id", F.coalesce("language", F.lit("")).alias("language"), "file_path").distinct()
    g = g.withColumn("_r", F.row_number().over(Window.partitionBy("project_id", "language").orderBy("file_path")))
    return g.groupBy("project_id", "language").agg(F.count("*").alias("files"), F.array_join(F.sort_array(F.collect_list(F.when(F.col("_r") <= first, F.col("file_path")))), ", ").alias("first_files"))


def keep_files(files: DataFrame) -> DataFrame:
    """Files worth reading: size, at least ten characters without surrounding space, known language, no skipped directory."""
    size = F.coalesce(F.octet_length("content"), F.lit(0))
    text = F.length(F.regexp_replace(F.coalesce("content", F.lit("")), r"^\s+|\s+$", ""))
    return files.where(size.between(t.MIN_BYTES, t.MAX_BYTES) & (text >= t.MIN_CHARACTERS) & tx.language_of(F.col("file_path")).isNotNull() & ~tx.in_skipped_directory(F.col("file_path")))


def file_priority(path: Column, language: Column) -> Column:
    low = F.lower(path)
    dirs = F.slice(F.split(low, "/"), 1, F.greatest(F.size(F.split(low, "/")) - 1, F.lit(0)))
    name = F.element_at(F.split(low, "/"), -1)
    return (
        F.when(F.exists(dirs, lambda d: d.isin(t.LARGE_REPO_SKIP)), 99).when(name.isin(t.LARGE_REPO_ENTRY), 1).when(F.split(low, "/")[0].isin(t.LARGE_REPO_CORE) & (F.size(dirs) > 0), 2)
        .when(name.isin(t.LARGE_REPO_BUILD), 3).when(~F.coalesce(language, F.lit("")).isin("markdown", "rst", "text"), 4).when(language.isin("markdown", "rst"), 7).otherwise(5)
    )


def cap_large(files: DataFrame, most: int = 300) -> DataFrame:
    """The ``most`` files of a project to look at first: by priority, then path."""
    f = files.withColumn("priority", file_priority(F.col("file_path"), F.col("language")))
    return f.withColumn("rank", F.row_number().over(Window.partitionBy("project_id").orderBy("priority", "file_path"))).where(F.col("rank") <= most)


def sizes(files: DataFrame) -> DataFrame:
    g = files.groupBy("project_id").agg(F.sum("file_size_bytes").alias("bytes"))
    return g.select("project_id", "bytes", tx.size_class(F.col("bytes") / 1024).alias("_s")).select("project_id", "bytes", "_s.*")
