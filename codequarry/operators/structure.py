"""Structural questions to the module graph, answered for all projects or questions at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codequarry.functions import text as tx
from codequarry.operators import graph


def _stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]+)?$", 1)


def _first(rows: DataFrame, keys: list[str], value: str, most: int, name: str) -> DataFrame:
    """``keys`` and the first ``most`` distinct values of each as an array; a window's limit is applied before the shuffle."""
    ranked = rows.select(*keys, value).distinct().withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(value))).where(F.col("_r") <= most)
    return ranked.groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias(name))


def _none() -> Column:
    return F.array().cast("array<string>")


def all_edges(modules: DataFrame) -> DataFrame:
    """Import and inheritance edges of the graph in one table, repeats kept."""
    return graph.resolve_imports(modules).unionByName(graph.resolve_inheritance(modules).where("source <> target"))


def is_entry() -> Column:
    return F.coalesce("is_entry_point", F.lit(False)) | (F.size("entry_points") > 0)


def entry_answers(modules: DataFrame, edges: DataFrame, files: int = 8, most: int = 4) -> DataFrame:
    """Where does it start?  project_id, position, file_path, details, classes, imports (stems): the first entry files of a project by path, with the first of each list."""
    m = modules.where(is_entry()).select("project_id", "file_path", F.slice("entry_points", 1, most).alias("details"), F.slice("classes", 1, most).alias("classes"))
    m = m.withColumn("position", F.row_number().over(Window.partitionBy("project_id").orderBy("file_path"))).where(F.col("position") <= files)
    imports = _first(edges.where("edge_type = 'import'").select("project_id", F.col("source").alias("file_path"), "target"), ["project_id", "file_path"], "target", most, "_i")
    found = m.join(imports, ["project_id", "file_path"], "left")
    return found.select("project_id", "position", "file_path", "details", "classes", F.coalesce(F.transform("_i", _stem), _none()).alias("imports"))


def dependency_answers(modules: DataFrame, edges: DataFrame, names: DataFrame, most: int = 8) -> DataFrame:
    """What does a module depend on, and what on it?  ``names``: project_id, name.

    project_id, name, file_path (null where no file has the name), imports_from, imported_by, inherits_from."""
    asked = names.select("project_id", "name").distinct()
    found = graph.find_file(modules, asked)
    e = edges.where("edge_type = 'import'")
    key = ["project_id", "file_path"]
    out = _first(e.select("project_id", F.col("source").alias("file_path"), "target"), key, "target", most, "imports_from")
    into = _first(e.select("project_id", F.col("target").alias("file_path"), "source"), key, "source", most, "imported_by")
    bases = modules.groupBy(*key).agg(F.first("inherits_from", True).alias("inherits_from"))
    rows = asked.join(found, ["project_id", "name"], "left").join(out, key, "left").join(into, key, "left").join(bases, key, "left")
    return rows.select("project_id", "name", "file_path", *[F.coalesce(c, _none()).alias(c) for c in ("imports_from", "imported_by", "inherits_from")])


def overview(modules: DataFrame, edges: DataFrame, entries: int = 4, imported: int = 4) -> DataFrame:
    """How is it organised?  One row for each project: modules, classes, functions, dependencies, languages (most files first), entry_points and core_modules (most imported first)."""
    m = modules.groupBy("project_id").agg(F.count("*").alias("modules"), F.sum(F.size("classes")).alias("classes"), F.sum(F.size("functions")).alias("functions"))
    by_language = modules.groupBy("project_id", F.coalesce("language", F.lit("")).alias("_l")).agg(F.count("*").alias("_n"))
    languages = by_language.groupBy("project_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("_n")).alias("n"), F.col("_l").alias("l")))).alias("_l"))
    starts = _first(modules.where(is_entry()), ["project_id"], "file_path", entries, "entry_points")
    top = graph.top_in_degree(edges, imported).groupBy("project_id").agg(F.sort_array(F.collect_list(F.struct("rank", "target", "imports"))).alias("_t"))
    n = edges.groupBy("project_id").agg(F.count("*").alias("dependencies"))
    out = m.join(languages, "project_id", "left").join(starts, "project_id", "left").join(top, "project_id", "left").join(n, "project_id", "left")
    return out.select(
        "project_id", "modules", "classes", "functions", F.coalesce("dependencies", F.lit(0)).alias("dependencies"), F.transform("_l", lambda x: F.concat((-x["n"]).cast("string"), F.lit(" "), x["l"])).alias("languages"),
        F.coalesce("entry_points", _none()).alias("entry_points"), F.coalesce(F.transform("_t", lambda x: F.concat(x["target"], F.lit(" "), x["imports"].cast("string"))), _none()).alias("core_modules"),
    )


def summary_text(modules: DataFrame, edges: DataFrame) -> DataFrame:
    """project_id, summary: the overview, most complex modules and component groups as text."""
    o = overview(modules, edges, 5, 3)
    complex_ = graph.most_complex(modules, 3).groupBy("project_id").agg(F.sort_array(F.collect_list(F.struct("rank", "file_path"))).alias("_c"))
    groups = graph.component_groups(modules).withColumn("_r", F.row_number().over(Window.partitionBy("project_id").orderBy("component"))).where("_r <= 6")
    groups = groups.groupBy("project_id").agg(F.sort_array(F.collect_list(F.concat("component", F.lit(": "), F.col("files").cast("string")))).alias("_g"))
    name = lambda p: F.element_at(F.split(p, "/"), -1)
    line = lambda title, c: F.when(F.size(c) > 0, F.concat(F.lit(f"{title}: "), F.array_join(c, ", ")))
    head = F.concat(F.col("modules").cast("string"), F.lit(" modules ("), F.array_join("languages", ", "), F.lit("), "), F.col("classes").cast("string"), F.lit(" classes, "), F.col("functions").cast("string"), F.lit(" functions"))
    rows = o.join(complex_, "project_id", "left").join(groups, "project_id", "left")
    return rows.select("project_id", F.concat_ws("\n", head, line("Entry points", F.transform("entry_points", name)), line("Most imported", F.transform("core_modules", name)), line("Most complex", F.transform("_c", lambda x: name(x["file_path"]))), line("Components", F.col("_g"))).alias("summary"))


def gate(questions: DataFrame, modules: DataFrame) -> DataFrame:
    """``questions`` (project_id, question) that ask about architecture, of projects with a graph, with their ``route``."""
    asked = questions.where(tx.is_architecture_question(F.col("question"))).withColumn("route", tx.architecture_route(F.col("question")))
    return asked.join(modules.select("project_id").distinct(), "project_id", "left_semi")
