"""Chunkers: sliding window, Markdown headings, definition starts, syntax trees."""

from __future__ import annotations

import ast
import re
import textwrap
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codequarry.functions import tables as t
from codequarry.functions import text as tx

MIN_CHUNK, MIN_DEFINITION, OVERSIZE, OVERSIZE_SIZE, OVERSIZE_OVERLAP = 30, 10, 4000, 1500, 150
_BLANK = r"^\s*$"


def chunk_id(project: Column, path: Column, index: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", project, path, index.cast("string")), 256), 1, 12)


def _newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def sliding(files: DataFrame, size: int = 500, overlap: int = 50) -> DataFrame:
    """Windows of ``size`` characters at steps of size - overlap, up to the first blank one.

    ``files``: project_id, file_path, language, content.  Text is stripped; counts are of the window as cut."""
    step = max(1, size - overlap)
    f = files.where("content is not null and content <> ''")
    n = F.length("content")
    starts = F.sequence(F.lit(0), n - 1, F.lit(step))
    f = f.select("project_id", "file_path", "language", "content", F.transform(starts, lambda s: F.substring(F.col("content"), s + 1, F.lit(size))).alias("_w"))
    f = f.withColumn("_blank", F.array_position(F.transform("_w", lambda w: w.rlike(_BLANK)), True))
    f = f.withColumn("_w", F.when(F.col("_blank") > 0, F.slice("_w", 1, (F.col("_blank") - 1).cast("int"))).otherwise(F.col("_w")))
    x = f.select("project_id", "file_path", "language", "content", F.posexplode("_w").alias("chunk_index", "_t"))
    start_line = _newlines(F.substring("content", F.lit(1), F.col("chunk_index") * step)) + 1
    return x.select(
        chunk_id(F.col("project_id"), F.col("file_path"), F.col("chunk_index")).alias("chunk_id"), "project_id", "file_path", "language", "chunk_index", F.regexp_replace("_t", r"^\s+|\s+$", "").alias("text"),
        start_line.alias("start_line"), (start_line + _newlines(F.col("_t"))).alias("end_line"), F.lit("block").alias("chunk_type"), F.length("_t").alias("char_count"), tx.token_estimate(F.col("_t")).alias("token_count"),
    )


_MARK = "\x01"


def markdown(files: DataFrame) -> DataFrame:
    """Sections from heading to heading; a non-blank preamble is section 0; blank ones are left out without renumbering."""
    f = files.where(F.col("content").isNotNull() & ~F.col("content").rlike(_BLANK))
    marked = F.regexp_replace("content", r"(?m)^(#{1,6}[ \t]+\S)", _MARK + "$1")
    parts = F.split(marked, _MARK)
    # a text that starts with a heading has an empty piece before it
    parts = F.when(parts[0].rlike(_BLANK) & (F.size(parts) > 1), F.slice(parts, 2, F.size(parts))).otherwise(parts)
    skipped = F.when(F.split(marked, _MARK)[0].rlike(_BLANK) & (F.size(F.split(marked, _MARK)) > 1), _newlines(F.split(marked, _MARK)[0])).otherwise(0)
    x = f.select("project_id", "file_path", "language", parts.alias("_p"), skipped.alias("_skipped")).select("*", F.posexplode("_p").alias("chunk_index", "_t"))
    before = F.aggregate(F.slice("_p", F.lit(1), F.col("chunk_index")), F.lit(0), lambda a, p: a + _newlines(p))
    start = before + F.col("_skipped") + 1
    title = F.trim(F.regexp_extract("_t", r"^#{1,6}[ \t]+([^\n]*)", 1))
    return x.where(~F.col("_t").rlike(_BLANK)).select(
        chunk_id(F.col("project_id"), F.col("file_path"), F.col("chunk_index")).alias("chunk_id"), "project_id", "file_path", "language", "chunk_index", F.regexp_replace("_t", r"^\s+|\s+$", "").alias("text"), title.alias("title"),
        start.alias("start_line"), F.lit("heading").alias("chunk_type"),
    )


_CHUNK = T.ArrayType(T.StructType([
    T.StructField("chunk_index", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("start_line", T.IntegerType()), T.StructField("end_line", T.IntegerType()), T.StructField("chunk_type", T.StringType()),
    T.StructField("function_name", T.StringType()), T.StructField("class_name", T.StringType()), T.StructField("decorators", T.ArrayType(T.StringType())), T.StructField("docstring", T.StringType()), T.StructField("return_type", T.StringType()), T.StructField("is_async", T.BooleanType()),
]))


def _row(index, text, start, end, kind, function="", cls="", decorators=(), docstring="", returns="", is_async=False):
    return {"chunk_index": index, "text": text, "start_line": start, "end_line": end, "chunk_type": kind, "function_name": function, "class_name": cls, "decorators": list(decorators), "docstring": docstring, "return_type": returns, "is_async": is_async}


def by_definition_starts(text: str, language: str, size: int) -> list[dict]:
    """From each start of a definition to the next; short ones are left out, long ones cut at three sizes."""
    pattern = t.DEFINITION_STARTS.get(language)
    starts = [m.start() for m in re.finditer(pattern, text, re.M)] if pattern else []
    lines, out = text.splitlines(), []
    for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(text)])):
        body = text[a:b].strip()
        if len(body) < MIN_CHUNK:
            continue
        line = text.count("\n", 0, a) + 1
        first = lines[line - 1].strip() if line <= len(lines) else ""
        kind, function, cls = "block", "", ""
        if m := re.search(t.CLASS_NAME, first):
            kind, cls = "class", m[1]
        elif m := re.search(t.FUNCTION_NAME, first) or re.search(t.GENERIC_NAME, first):
            kind, function = "function", m[1]
        out.append(_row(i, body[: size * 3], line, text.count("\n", 0, b) + 1, kind, function, cls))
    return out


def _windows(text: str, size: int, overlap: int) -> list[tuple[int, str]]:
    out = []
    for i, at in enumerate(range(0, len(text), max(1, size - overlap))):
        piece = text[at : at + size]
        if not piece.strip():
            break
        out.append((i, piece))
    return out


def _emit(out: list[dict], index: int, text: str, start: int, end: int, kind: str, **more) -> None:
    if len(text) <= OVERSIZE:
        out.append(_row(index, text, start, end, kind, **more))
        return
    for i, piece in _windows(text, OVERSIZE_SIZE, OVERSIZE_OVERLAP):
        line = start + text.count("\n", 0, i * (OVERSIZE_SIZE - OVERSIZE_OVERLAP))
        out.append(_row(index * 100 + i, piece.strip(), line, min(end, line + piece.count("\n")), kind, **more))


def by_python_tree(text: str) -> list[dict]:
    """Classes, their methods, and all other functions of a Python module, in line order; nothing where it doesn't parse."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    methods = {id(f): c.name for c in ast.walk(tree) if isinstance(c, ast.ClassDef) for f in c.body if isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef))}
    nodes, seen, found = [n for n in ast.walk(tree) if isinstance(n, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef))], set(), []
    for n in nodes:
        if (n.name, n.lineno) not in seen:
            seen.add((n.name, n.lineno))
            found.append(n)
    lines, out = text.splitlines(), []
    for i, n in enumerate(sorted(found, key=lambda n: n.lineno)):
        body = textwrap.dedent("\n".join(lines[n.lineno - 1 : n.end_lineno]))
        if len(body.strip()) < MIN_DEFINITION:
            continue
        is_class = isinstance(n, ast.ClassDef)
        kind = "class" if is_class else "method" if id(n) in methods else "function"
        _emit(out, i, body, n.lineno, n.end_lineno, kind, function="" if is_class else n.name, cls=n.name if is_class else methods.get(id(n), ""), decorators=[ast.unparse(d) for d in n.decorator_list], docstring=(ast.get_docstring(n) or "")[:200], returns="" if is_class or n.returns is None else ast.unparse(n.returns), is_async=isinstance(n, ast.AsyncFunctionDef))
    return out


_TOKENS = re.compile(r"//[^\n]*|/\*[\s\S]*?\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`|[{}]")
_NOT_NAMES = r"(?!(?:if|for|while|switch|catch|return|function|else|do|try|new|throw)\b)"
#: language -> definition headers (pattern, kind); the first named group is the name.
_HEADERS = {
    "javascript": [(r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)", "class"), (r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)", "function"), (r"^[ \t]*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*(?::\s*[^=]+)?=>", "function"), (rf"^[ \t]+(?:(?:public|private|protected|static|async|get|set)\s+)*{_NOT_NAMES}(\w+)\s*\([^)]*\)\s*(?::\s*[^{{\n]+)?\{{", "method")],
    "java": [(r"^[ \t]*(?:(?:public|private|protected|static|final|abstract)\s+)*(?:class|interface|enum|record)\s+(\w+)", "class"), (rf"^[ \t]*(?:(?:public|private|protected|static|final|abstract|synchronized)\s+)+(?:<[^>]+>\s+)?(?:[\w<>\[\],.?]+\s+)?{_NOT_NAMES}(\w+)\s*\([^)]*\)\s*(?:throws\s+[\w,\s.]+)?\{{", "method")],
    "go": [(r"^func\s+\([^)]*\)\s*(\w+)\s*\(", "method"), (r"^func\s+(\w+)\s*[\[(]", "function"), (r"^type\s+(\w+)\s+(?:struct|interface)\b", "class")],
}
_HEADERS["typescript"] = _HEADERS["javascript"]


def by_braces(text: str, language: str) -> list[dict]:
    """Definitions from their header to the matching brace (strings and comments are passed over); one for each start line."""
    braces, stack, closes = [], [], {}
    for m in _TOKENS.finditer(text):
        if m[0] == "{":
            stack.append(m.start())
            braces.append(m.start())
        elif m[0] == "}" and stack:
            closes[stack.pop()] = m.start()
    found: dict[int, tuple] = {}
    for pattern, kind in _HEADERS.get(language, []):
        for m in re.finditer(pattern, text, re.M):
            start = m.start() + len(m[0]) - len(m[0].lstrip())
            line = text.count("\n", 0, start) + 1
            open_at = next((b for b in braces if b >= m.end() - 1), None)
            if line not in found and open_at in closes:
                found[line] = (start, closes[open_at] + 1, kind, m[1])
    out: list[dict] = []
    for i, (line, (a, b, kind, name)) in enumerate(sorted(found.items())):
        body = textwrap.dedent(text[text.rfind("\n", 0, a) + 1 : b]).strip()
        if len(body) >= MIN_DEFINITION:
            _emit(out, i, body, line, text.count("\n", 0, b) + 1, kind, function="" if kind == "class" else name, cls=name if kind == "class" else "")
    return out


def definitions(files: DataFrame, size: int = 1500, prefer_tree: bool = True) -> DataFrame:
    """Definition chunks of source files: by syntax tree or braces, else by definition starts.  Files without any give no row."""

    @F.pandas_udf(_CHUNK)
    def cut(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, languages in parts:
            out = []
            for text, language in zip(texts, languages):
                rows: list[dict] = []
                if text and text.strip():
                    if prefer_tree:
                        rows = by_python_tree(text) if language == "python" else by_braces(text, language)
                    rows = rows or by_definition_starts(text, language, size)
                out.append([r for r in rows if r["text"].strip()])
            yield pd.Series(out, dtype=object)

    x = files.select("project_id", "file_path", "language", F.explode(cut("content", "language")).alias("_c")).select("project_id", "file_path", "language", "_c.*")
    # ids from path, line and index: the oversize numbering can't collide
    key = F.concat_ws("/", F.col("start_line").cast("string"), F.col("chunk_index").cast("string"))
    return x.select(chunk_id(F.col("project_id"), F.col("file_path"), key).alias("chunk_id"), "*", F.length("text").alias("char_count"), tx.token_estimate(F.col("text")).alias("token_count"))


def chunk_files(files: DataFrame, size: int = 500, overlap: int = 50) -> DataFrame:
    """The router: Markdown by headings, code by definitions, and windows for all files that gave no chunk."""
    names = ["chunk_id", "project_id", "file_path", "language", "chunk_index", "text", "start_line", "chunk_type"]
    prose = F.coalesce(F.col("language").isin("markdown", "rst", "mdx"), F.lit(False))
    heads, code = markdown(files.where(prose)).select(names), definitions(files.where(~prose)).select(names)
    rest = files.where(~prose).join(code.select("project_id", "file_path").distinct(), ["project_id", "file_path"], "left_anti")
    return reduce(DataFrame.unionByName, [heads, code, sliding(rest, size, overlap).select(names)])


def strategy(language: Column) -> Column:
    return F.when(language == "python", "AST (Python)").when(language.isin("javascript", "typescript", "java", "go"), "AST (braces)").when(language.isin("markdown", "rst"), "Markdown headings").when(language.isin(*t.DEFINITION_STARTS), "Function-aware").otherwise("Sliding window")
