"""Source trees and archives as tables of files."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codequarry.functions import tables as t
from codequarry.functions import text as tx

FILES = "project_id string, file_path string, relative_path string, language string, file_size_bytes long, line_count int, encoding string, content string"
MAX_MEMBERS, MAX_UNPACKED = 5000, 500 * 1024 * 1024


def ignore_pattern(line: str) -> tuple[str, bool] | None:
    """(expression on relative paths, whether it takes files back in) of one line of an ignore file."""
    line = line.rstrip("\n").rstrip()
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line.lstrip("!")
    only_dir, rooted = line.endswith("/"), "/" in line.rstrip("/")
    out = "".join(".*" if p == "**" else "[^/]*" if p == "*" else "[^/]" if p == "?" else p if p.startswith("[") else re.escape(p) for p in re.findall(r"\*\*/?|\*|\?|\[[^\]]*\]|[^*?\[]+", line.strip("/").replace("**/", "**")))
    return ("^" if rooted else "(^|/)") + out + ("/" if only_dir else "(/|$)"), negated


def ignored(path: Column, lines: list[str]) -> Column:
    """Whether an ignore file leaves the path out; the last pattern that matches decides."""
    out = F.lit(False)
    for parsed in map(ignore_pattern, lines):
        if parsed:
            out = F.when(path.rlike(parsed[0]), F.lit(not parsed[1])).otherwise(out)
    return out


def decode(raw: bytes) -> tuple[str, str]:
    """(text, encoding): UTF-8, else what a detector is sure of (if one is installed), else UTF-8 with replacements."""
    try:
        return raw.decode("utf-8"), "utf-8"
    except UnicodeDecodeError:
        pass
    try:
        import chardet

        guess = chardet.detect(raw)
        if guess["encoding"] and guess["confidence"] > 0.7:
            return raw.decode(guess["encoding"]), guess["encoding"]
    except (ImportError, UnicodeDecodeError, LookupError):
        pass
    return raw.decode("utf-8", "replace"), "utf-8-replaced"


def looks_binary(raw: bytes) -> bool:
    head = raw[:8192]
    return head.count(0) > len(head) * 0.10


_DECODED = T.StructType([T.StructField("content", T.StringType()), T.StructField("encoding", T.StringType())])


@F.pandas_udf(_DECODED)
def _decoded(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for raws in parts:
        yield pd.DataFrame([(None, None) if r is None or looks_binary(r) else decode(r) for r in raws], columns=["content", "encoding"])


def as_table(raw: DataFrame) -> DataFrame:
    """``raw``: project_id, file_path, length, bytes -> FILES, with the cheap filters before any byte is read."""
    kept = raw.where(F.col("length").between(t.MIN_BYTES, t.MAX_BYTES) & ~tx.in_skipped_directory(F.col("file_path"))).withColumn("language", tx.language_of(F.col("file_path"))).where("language is not null")
    d = kept.withColumn("_d", _decoded("bytes")).select("project_id", "file_path", "language", F.col("length").cast("long").alias("file_size_bytes"), "_d.*")
    d = d.where(F.length(F.regexp_replace("content", r"^\s+|\s+$", "")) >= t.MIN_CHARACTERS)
    return d.select("project_id", "file_path", F.col("file_path").alias("relative_path"), "language", "file_size_bytes", tx.line_count(F.col("content")).alias("line_count"), "encoding", "content")


def read_tree(spark: SparkSession, root: str, project_id: str, ignore: list[str] | None = None) -> DataFrame:
    """The text files of a directory tree."""
    b = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = F.lit(re.sub(r"/+$", "", root.split(":", 1)[-1] if root.startswith("file:") else root) + "/")
    path = F.regexp_replace("path", "^file:/+", "/")
    relative = F.substring(path, F.instr(path, base) + F.length(base), F.length(path))
    raw = b.select(F.lit(project_id).alias("project_id"), relative.alias("file_path"), "length", F.col("content").alias("bytes"))
    return as_table(raw.where(~ignored(F.col("file_path"), ignore)) if ignore else raw)


def zip_members(data: bytes) -> list[tuple[str, int, bytes]]:
    """(path, length, bytes) of an archive's files, a single root folder taken off.  Raises ValueError for a bad archive, too many
    members, too much content, or a member that points outside."""
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise ValueError("not an archive") from e
    infos = [i for i in z.infolist() if not i.is_dir()]
    if not infos or len(infos) > MAX_MEMBERS or sum(i.file_size for i in infos) > MAX_UNPACKED:
        raise ValueError("empty, or more than the limits allow")
    names = [i.filename.replace("\\", "/") for i in infos]
    if any(n.startswith("/") or posixpath.normpath(n).startswith("..") for n in names):
        raise ValueError("a member points outside the archive")
    real = [(n, i) for n, i in zip(names, infos) if not n.startswith("__MACOSX/") and not n.endswith(".DS_Store")]
    roots = {n.split("/", 1)[0] for n, _ in real}
    cut = len(next(iter(roots))) + 1 if len(roots) == 1 and all("/" in n for n, _ in real) else 0
    return [(posixpath.normpath(n[cut:]), i.file_size, z.read(i)) for n, i in real]


def read_zips(spark: SparkSession, pattern: str) -> DataFrame:
    """The text files of archives; project_id is the archive's name.  A bad archive gives no rows; ``zip_errors`` names it."""
    b = spark.read.format("binaryFile").load(pattern)
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.zip$", "")
    return as_table(unpacked(b.select(name.alias("project_id"), "content")))


def unpacked(archives: DataFrame) -> DataFrame:
    """project_id, file_path, length, bytes of the members of archives (project_id, content); a bad archive gives no rows."""

    def unpack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for project, data in zip(part["project_id"], part["content"]):
                try:
                    rows = zip_members(data)
                except ValueError:
                    continue
                yield pd.DataFrame([(project, n, size, raw) for n, size, raw in rows], columns=["project_id", "file_path", "length", "bytes"])

    return archives.select("project_id", "content").mapInPandas(unpack, "project_id string, file_path string, length long, bytes binary")


def archived(files: DataFrame, root: str) -> DataFrame:
    """project_id, archive: every file (project_id, file_path, bytes) in an archive of its own, under a root folder."""

    def pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for project, path, raw in zip(part["project_id"], part["file_path"], part["bytes"]):
                buffer = io.BytesIO()
                with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr(f"{root}/{path}", raw)
                out.append((project, buffer.getvalue()))
            yield pd.DataFrame(out, columns=["project_id", "archive"])

    return files.select("project_id", "file_path", "bytes").mapInPandas(pack, "project_id string, archive binary")


def zip_errors(spark: SparkSession, pattern: str) -> DataFrame:
    def check(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for path, data in zip(part["path"], part["content"]):
                try:
                    zip_members(data)
                except ValueError as e:
                    out.append((path, str(e)))
            yield pd.DataFrame(out, columns=["path", "error"])

    return spark.read.format("binaryFile").load(pattern).select("path", "content").mapInPandas(check, "path string, error string")


def write_partitioned(df: DataFrame, folder: str) -> None:
    """Writes a keyed table with a partition for each project and replaces only the projects in ``df``."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project_id").parquet(folder)
