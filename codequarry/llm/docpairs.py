"""Problem 5: functions paired with their documentation."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm.common import columns_or_null, newest, struct_of
from codequarry.llm.grammars import ENDINGS

MIN_WORDS = 4

# --- islands: documentation, annotations, signatures, balanced bodies; everything else is water --------

_COMMENT = r"/\*[\s\S]*?(?:\*/|\Z)|//[^\n]*"
_STRING = r"\"\"\"[\s\S]*?\"\"\"|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`"
_BALANCE = re.compile(rf"{_COMMENT}|{_STRING}|[(){{}}\[\]]")
_WORD_MODS = r"(?:(?:public|private|protected|internal|static|final|abstract|synchronized|native|default|override|readonly|async|get|set|export|declare|virtual|inline|extern|unsafe|pub|open|suspend)\s+)*"
#: Signature islands; the group ``name`` is the function's name.
_SIGNATURES = {
    "javascript": re.compile(
        r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\b\s*\*?\s*(?P<a>[\w$]*)\s*(?:<[^>(]*>)?\s*\("
        r"|^[ \t]*(?:export\s+)?(?:default\s+)?(?:const|let|var)\s+(?P<b>[\w$]+)\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:function\b|\(|[\w$]+\s*=>|<)"
        rf"|^[ \t]*{_WORD_MODS}\*?(?P<c>(?!(?:if|for|while|switch|catch|return|function|await|throw|new|super|do|else|try|with|typeof)\b)[#\w$]+)\s*(?:<[^>(\n]*>)?\s*\((?=[^\n]*(?:\{{|,|\)|$))"
        r"|^[ \t]*(?:(?:public|private|protected|static|readonly)\s+)*(?P<d>[#\w$]+)\s*[:=]\s*(?:async\s*)?(?:function\b|\([^()\n]*\)\s*(?::[^=\n]+)?=>|[\w$]+\s*=>)", re.M),
    "java": re.compile(rf"^[ \t]*{_WORD_MODS}(?:<[^(\n]*?>\s+)?(?:(?!return\b|new\b|throw\b|else\b)[\w.]+(?:<[^()\n]*>)?(?:\[\])*\s+)?(?P<a>(?!(?:if|for|while|switch|catch|return|synchronized|try|new|throw|super|this|do|else)\b)\w+)\s*\(", re.M),
    "go": re.compile(r"^func\s*(?:\([^)]*\)\s*)?(?P<a>\w+)\s*(?:\[[^\]]*\])?\s*\(", re.M),
    "python": re.compile(r"^[ \t]*(?:async\s+)?def\s+(?P<a>\w+)\s*(?:\[[^\]]*\])?\(", re.M),
    "other": re.compile(rf"^[ \t]*{_WORD_MODS}(?:(?:fn|fun|func|function|sub|def)\s+(?P<a>\w+)|(?:[\w:<>*&~]+\s+)+[*&]?(?P<b>(?!(?:if|for|while|switch|catch|return)\b)[\w:]+)\s*\()", re.M),
}
_SIGNATURES["typescript"] = _SIGNATURES["javascript"]
_ANNOTATION = re.compile(r"[ \t]*(?:@[\w.$]+(?:\([^()]*(?:\([^()]*\)[^()]*)*\))?|#\[[^\]]*\]|\[[A-Z]\w*(?:\([^)]*\))?\])[ \t]*(?:\n|$)")


def _balanced_end(text: str, at: int) -> int:
    """End of the first {...} body that opens outside parentheses at or after ``at``; without a body the end of the line."""
    depth = 0
    for m in _BALANCE.finditer(text, at):
        t = m[0]
        if t in "([{":
            depth += 1
        elif t in ")]}" and depth:
            depth -= 1
            if not depth and t == "}":
                return m.end()
    end = text.find("\n", at)
    return len(text) if depth or end < 0 else end


def _indented_end(text: str, at: int) -> int:
    indent = len(re.match(r"[ \t]*", text[at:])[0])
    end = len(text)
    for m in re.finditer(r"\n([ \t]*)(?=\S)", text[at:]):
        if len(m[1]) <= indent and text[at + m.end()] not in "#)]}" and not re.match(r"(?:\"\"\"|''')", text[at + m.end() :]):
            head_done = re.search(r":[ \t]*(?:#[^\n]*)?\n", text[at : at + m.start() + 1])
            if head_done:
                return at + m.start()
    return end


_PREFIXED = r"(?:[rRuU]?)"
_PY_DOC = re.compile(rf"(?:\s|#[^\n]*\n|\\\n)*(?P<lit>(?:{_PREFIXED}(?:\"\"\"(?:[^\\]|\\.)*?(?:\"\"\"|\Z)|'''(?:[^\\]|\\.)*?(?:'''|\Z)|\"(?!\"\")(?:[^\"\\\n]|\\.)*\"|'(?!'')(?:[^'\\\n]|\\.)*')[ \t]*)+)(?P<next>;|#|\n|\Z)", re.S)
_PY_PART = re.compile(rf"{_PREFIXED}(\"\"\"|'''|\"|')((?:[^\\]|\\.)*?)(?:\1|\Z)", re.S)


def python_doc(text: str, at: int) -> str | None:
    """Docstring of the function whose parameter list opens at ``at`` (place of the parenthesis)."""
    depth, end = 0, None
    for m in re.finditer(r"#[^\n]*|\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|[(){}\[\]:]", text[at:]):
        t = m[0]
        if t in "([{":
            depth += 1
        elif t in ")]}":
            depth -= 1
        elif t == ":" and not depth:
            end = at + m.end()
            break
    if end is None:
        return None
    m = _PY_DOC.match(text, end)
    if not m:
        return None
    parts = []
    for p in _PY_PART.finditer(m["lit"]):
        try:
            parts.append(ast.literal_eval(p[0]) if "\\" in p[0] and "r" not in p[0][:2].lower() else p[2])
        except (SyntaxError, ValueError):
            parts.append(p[2])
    return "".join(parts)


def comment_above(text: str, header: int) -> list[str]:
    """Comments that stand directly above the header (annotations may lie between), in order, without marks."""
    above = text[:header]
    while True:  # annotation islands
        line = above.rstrip(" \t")
        if not line.endswith("\n") and line:
            break
        last = line[:-1].rfind("\n") + 1 if line else 0
        if line and _ANNOTATION.fullmatch(line[last:]):
            above = line[:last]
            continue
        break
    found: list[str] = []
    while True:
        body = above.rstrip(" \t")
        if body and not body.endswith("\n"):
            if not body.endswith("*/"):
                break
        elif body:
            body = body[:-1].rstrip(" \t\r")
        if body.endswith("*/"):
            start = body.rfind("/*")
            if start < 0 or body[body.rfind("\n", 0, start) + 1 : start].strip():
                break
            found.insert(0, re.sub(r"(?m)^[ \t]*\*+(?!/)[ \t]?", "", re.sub(r"\A/\*+!?|\*+/\Z", "", body[start:])))
            above = body[:start]
            above = above.rstrip(" \t")
            continue
        last = body.rfind("\n") + 1
        m = re.match(r"[ \t]*(?://+!?|#(?!\[|!))(.*)", body[last:])
        if not m or not body:
            break
        found.insert(0, m[1])
        above = body[:last]
    return found


# --- what counts as documentation ----------------------------------------------------------------------

_LICENCE = re.compile(r"(?i)\bcopyright\b|\(c\)\s*\d{4}|©|\bspdx-|all rights reserved|licen[cs]ed (?:under|to)|governed by (?:the|an?) [\w\s-]*licen[cs]e|permission is hereby granted|redistribution and use")
_DIRECTIVE = re.compile(r"(?i)\A\s*(?:eslint|tslint|jshint|prettier|istanbul|ts-|@ts-|nolint|noqa|pylint|go:|\+build|noinspection|checkstyle|sonar|region|endregion|c8 ignore|#\s*type:|todo\b|fixme\b|xxx\b|hack\b)")
_TAG = re.compile(r"\A\s*(?:[@\\](?:param|params|arg|argument|return|returns|throws?|exception|raises?|type|template|tparam|yields?|property|prop|see|since|author|deprecated|override|inheritdoc|example|default|module|class|memberof|private|public|protected|static|async|name|function|method|callback|typedef|todo|version|link)\b|:(?:param|parameter|arg|argument|key|keyword|type|rtype|returns?|raises?|except|exception|var|ivar|cvar|meta)\b)", re.I)
_SECTION = re.compile(r"\A\s*(?:Args|Arguments|Parameters|Params|Returns?|Raises|Yields?|Throws|Attributes|Keyword Args|Other Parameters)\s*:?\s*\Z")
_CODE_LINE = re.compile(
    r"[;{}]\s*\Z|\A\s*[})\]]|:=|\A\s*(?:if|for|while|switch|elif)\b.*[:{(]\s*\Z|\A\s*(?:return|throw|import|from|const|let|var|final|try|else|raise|defer|go|await|yield|package|func|def|class)\b.*[;=({)]|\A\s*[\w.\[\]\"'$]+\s*[-+*/]?=\s*\S|\A\s*[\w.$]+(?:\.[\w$]+)*\(.*\)\s*\Z"
    r"|\A\s*(?:return|break|continue|pass)(?:\s+[\w.]+)?\s*\Z|\A\s*(?:\}\s*)?(?:else|try|finally|catch)\b.*\{?\s*\Z(?<=[{:])"
)
_WORDS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_A-Za-z]+")


def name_words(name: str) -> set[str]:
    return {w.lower() for w in _CAMEL.findall(name or "")} | ({name.lower()} if name else set())


def description(raw: str) -> str:
    """Documentation without parameter tags, licence notices, directives, separators and disabled code."""
    kept: list[str] = []
    lines = raw.replace("\r\n", "\n").split("\n")
    text_lines = [x for x in lines if x.strip()]
    if text_lines and sum(bool(_CODE_LINE.search(x)) for x in text_lines) * 2 > len(text_lines):
        return ""
    if _LICENCE.search(raw):
        return ""
    in_tag, tag_indent, in_section = False, 0, False
    for line in lines:
        indent = len(line) - len(line.lstrip())
        if not line.strip():
            in_tag = in_section = False
            continue
        if _TAG.match(line):
            in_tag, tag_indent = True, indent
            continue
        if _SECTION.match(line):
            in_section, tag_indent = True, indent
            continue
        if (in_tag or in_section) and indent > tag_indent:
            continue
        in_tag = in_section = False
        if not _DIRECTIVE.match(line):
            kept.append(line.strip())
    return re.sub(r"<[^<>\n]+>|\{@\w+ ([^}]*)\}", r" \1 ", "\n".join(kept)).strip()


def is_real(text: str, name: str) -> bool:
    """At least four words that are not words of the function's own name."""
    own, count = name_words(name), 0
    for w in _WORDS.findall(text):
        if w.lower() not in own and not all(p.lower() in own for p in _CAMEL.findall(w)):
            count += 1
            if count >= MIN_WORDS:
                return True
    return False


def pair(text: str, language: str, name: str) -> tuple[str, str, str] | None:
    """(name, code, description) of the function the record holds, or None without real documentation."""
    pattern = _SIGNATURES.get(language, _SIGNATURES["other"])
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    covered = [m.span() for m in re.finditer(_COMMENT, text)] if language != "python" else []
    chosen = None
    for m in pattern.finditer(text):
        if any(a <= m.start() + len(m[0]) - len(m[0].lstrip()) < b for a, b in covered):
            continue
        found = next((g for g in m.groupdict().values() if g), "")
        if chosen is None:
            chosen = (m, found)
        if not name or found == name:
            chosen = (m, found)
            break
    if chosen is None:
        return None
    m, found = chosen
    start = text.rfind("\n", 0, m.start()) + 1
    if language == "python":
        doc = python_doc(text, m.end() - 1)
        raw = doc or ""
        end = _indented_end(text, m.start())
    else:
        raw = "\n".join(comment_above(text, start))
        end = _balanced_end(text, m.end() - 1)
    said = description(raw)
    if not said or not is_real(said, found or name):
        return None
    return found or name, text[start:end], said


@F.pandas_udf(struct_of(name="string", code="string", description="string"))
def _pair(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for texts, languages, names in parts:
        rows = [(None, None, None) if t is None else pair(t, lang or "other", n or "") or (None, None, None) for t, lang, n in zip(texts, languages, names)]
        yield pd.DataFrame(rows, columns=["name", "code", "description"], dtype="string")


def doc_pairs(chunks: DataFrame, with_code: bool = True) -> DataFrame:
    """chunk_id, project_id, file_path, language, name, class_name, code, description of every function or
    method record with real documentation.

    Python: the docstring; other languages: the comment directly above the header, annotations between
    them allowed.  Real means at least four words outside the function's name once parameter tags,
    licence notices, separators, directives and disabled code are left out.  The newest row of a
    chunk_id counts; a null or empty function_name is read from the signature; a null language is
    taken from the path's ending; null texts and records without a signature give no row.
    ``with_code=False`` leaves code and description null, so that no text is shuffled.
    """
    c = columns_or_null(chunks, chunk_id="string", project_id="string", file_path="string", language="string", chunk_type="string", function_name="string", class_name="string", ingested_at="timestamp_ntz", text="string")
    known = F.create_map(*[F.lit(x) for p in ENDINGS.items() for x in p])
    c = c.withColumn("language", F.coalesce(F.lower("language"), F.try_element_at(known, F.lower(F.regexp_extract("file_path", r"\.([A-Za-z0-9]+)$", 1)))))
    wanted = F.col("chunk_type").isin("function", "method")
    c = c.withColumn("_p", _pair(F.when(wanted, F.col("text")), "language", "function_name"))
    c = c.select("chunk_id", "project_id", "file_path", "language", "class_name", "ingested_at", F.col("_p.name").alias("name"), *[(F.col(f"_p.{x}") if with_code else F.lit(None).cast("string")).alias(x) for x in ("code", "description")], F.col("_p.description").isNotNull().alias("_real"))
    return newest(c, ["chunk_id"], "ingested_at", tie=["_real", "name", "file_path"]).where("_real").select("chunk_id", "project_id", "file_path", "language", "name", "class_name", "code", "description")
