"""Problem 4: splitting oversized items at natural boundaries."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm.common import TYPES, columns_or_null, newest
from pyspark.sql import types as T

PROSE = frozenset("markdown md mdx rst text txt".split())
_HEADING = re.compile(r"(#{1,6})[ \t]+\S")
_ITEM = re.compile(r"[ \t]*(?:[-*+]|\d{1,3}[.)])[ \t]")
_CLOSES = re.compile(r"[ \t]*(?:[)}\]]|</|end\b|else\b|elif\b|except\b|finally\b|catch\b)")
_OPENS = re.compile(r"[ \t]*(?:@|//|/\*|#|(?:export |public |private |protected |static |async |abstract |final )*(?:def|class|function|func|type|interface|enum|struct)\b)")
_SENTENCE = re.compile(r"(?<=[.!?;])[ \t]+(?=\S)|(?<=[;{}])(?=\S)")
_WORD = re.compile(r"(?<=[\s,;(){}\[\]>])(?=\S)")


def boundaries(text: str, prose: bool) -> list[tuple[int, int]]:
    """(position, level) of every line start but the first: the outline of the text as a tree, level 0
    being nearest to the root.  Prose: headings, paragraphs, list items by indent, lines.  Code and
    markup: lines by indent, those after a blank line or opening a definition above the others."""
    found, at, blank, fenced = [], 0, False, False
    for line in text.splitlines(keepends=True):
        if not line.strip():
            blank = True
        else:
            indent = len((lead := line[: len(line) - len(line.lstrip())]).expandtabs(4)) if line[0] in " \t" else 0
            if prose:
                heading = None if fenced else _HEADING.match(line)
                level = len(heading[1]) if heading else 10 if blank and not indent else 12 + indent if _ITEM.match(line) else 10**6 if blank else 10**6 + 4
                if line.lstrip().startswith(("```", "~~~")):
                    fenced = not fenced
                    level = 10 if fenced else 10**6 + 9
                elif fenced:
                    level = 10**6 + 9
            else:
                level = 2 * indent + (0 if blank or _OPENS.match(line) else 1)
                if _CLOSES.match(line):
                    level += 8
            if at:
                found.append((at, level))
            blank = False
        at += len(line)
    return found


def _fine(text: str, lo: int, hi: int, limit: int) -> list[tuple[int, int]]:
    """Pieces of a span without line starts: at sentence ends, else between words, else anywhere."""
    pieces = []
    while hi - lo > limit:
        window_end = lo + limit
        cut = 0
        for pattern in (_SENTENCE, _WORD):
            for m in pattern.finditer(text, lo + 1, min(hi, window_end + 1)):
                if lo < m.end() <= window_end:
                    cut = m.end()
            if cut > lo + limit // 3:
                break
        cut = cut if cut > lo else window_end
        pieces.append((lo, cut))
        lo = cut
    return [*pieces, (lo, hi)]


def pack(text: str, limit: int, prose: bool) -> list[tuple[int, int]]:
    """Consecutive spans of at most ``limit`` characters that cover the text."""
    marks = boundaries(text, prose)
    places = [p for p, _ in marks]

    def node(lo: int, hi: int) -> list[tuple[int, int]]:
        if hi - lo <= limit:
            return [(lo, hi)]
        inside = marks[bisect_right(places, lo) : bisect_left(places, hi)]
        if not inside:
            return _fine(text, lo, hi, limit)
        top = min(level for _, level in inside)
        edges = [lo, *(p for p, level in inside if level == top), hi]
        pieces: list[tuple[int, int]] = []
        open_to_merge = False
        for a, b in zip(edges, edges[1:]):
            if b - a > limit:
                pieces += node(a, b)
                open_to_merge = True  # its last piece may take the next siblings along
            elif open_to_merge and b - pieces[-1][0] <= limit:
                pieces[-1] = (pieces[-1][0], b)
            else:
                pieces.append((a, b))
                open_to_merge = True
        return pieces

    return node(0, len(text))


def split(text: str, size: int, overlap: int, prose: bool = False) -> list[tuple[int, int]]:
    """Spans (start, end) of the pieces, each of at most ``size`` characters; every piece but the first
    starts at the natural boundary nearest to ``overlap`` characters before the end of the piece before."""
    size = max(1, size)
    overlap = min(max(0, overlap), size - 1)
    cores = pack(text, size - overlap, prose)
    if not overlap or len(cores) < 2:
        return cores
    lines = [p for p, _ in boundaries(text, prose)]
    out = [cores[0]]
    for (before, _), (lo, hi) in zip(cores, cores[1:]):
        target, least = lo - overlap, max(hi - size, before + 1, out[-1][0] + 1)
        near = lines[bisect_left(lines, least) : bisect_right(lines, lo)]
        best = min(near, key=lambda p: abs(p - target), default=None)
        if best is None or abs(best - target) > overlap // 2:
            words = [m.end() for m in _WORD.finditer(text, max(0, least - 1), lo) if least <= m.end()]
            best = min(words, key=lambda p: abs(p - target), default=max(least, target))
        out.append((best, hi))
    return out


_SPANS = T.ArrayType(T.StructType([T.StructField(n, TYPES["int"]) for n in ("start", "end", "line", "last")]))


@F.pandas_udf(_SPANS)
def _spans(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for texts, sizes, overlaps, prose in parts:
        out = []
        for text, size, overlap, is_prose in zip(texts, sizes, overlaps, prose):
            if text is None:
                out.append(None)
                continue
            rows, at, line = [], 0, 0
            for s, e in split(text, int(size), int(overlap), bool(is_prose)):
                line += text.count("\n", at, s) if s >= at else -text.count("\n", s, at)
                at = s
                rows.append({"start": s, "end": e, "line": line, "last": line + text.count("\n", s, max(s, e - 1))})
            out.append(rows)
        yield pd.Series(out, dtype=object)


def project_settings(settings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(newest settings of each project, the one row of defaults ``*``); nulls are kept."""
    rows = newest(columns_or_null(settings, project_id="string", chunk_size="int", chunk_overlap="int", updated_at="timestamp_ntz"), ["project_id"], "updated_at")
    default = rows.where("project_id = '*'").agg(F.max("chunk_size").alias("_size"), F.max("chunk_overlap").alias("_overlap"))
    return rows.where("project_id <> '*'").select("project_id", "chunk_size", "chunk_overlap"), default


def split_oversized(chunks: DataFrame, settings: DataFrame, default_size: int = 1800, default_overlap: int = 150) -> DataFrame:
    """Pieces of every chunk that is longer than its project's chunk_size, counted in code points.

    Columns: chunk_id, project_id, chunk_size, chunk_overlap, piece_no (from 1), start_char, end_char
    (0-based, end excluded), start_line, end_line, piece.  A chunk within the limit gives no row.
    The text is read as a tree (headings, paragraphs and lists in prose; indentation in code); sibling
    subtrees are merged up to the limit and only oversized nodes are opened.  Pieces cover the text;
    each has at most chunk_size characters.  An overlap of the size or more counts as one less than the size.

    The newest row of a chunk_id counts; null settings are taken from row ``*`` and, where that is
    null or missing, from the parameters; a null start_line counts as 1; null texts give no row; a
    size under 1 counts as 1.
    """
    own, default = project_settings(settings)
    c = columns_or_null(chunks, chunk_id="string", project_id="string", language="string", start_line="int", ingested_at="timestamp_ntz", text="string")
    c = c.join(own, "project_id", "left").join(F.broadcast(default))  # one row of defaults
    c = c.withColumn("chunk_size", F.greatest(F.lit(1), F.coalesce("chunk_size", "_size", F.lit(default_size)))).withColumn("chunk_overlap", F.coalesce("chunk_overlap", "_overlap", F.lit(default_overlap)))
    over = F.when(F.length("text") > F.col("chunk_size"), F.col("text"))
    c = c.withColumn("_spans", _spans(over, "chunk_size", "chunk_overlap", F.coalesce(F.lower("language").isin(*PROSE), F.lit(False))))
    c = newest(c, ["chunk_id"], "ingested_at", tie=["project_id", "_spans", "start_line"])
    c = c.where("_spans is not null").select("*", F.posexplode("_spans").alias("_no", "_s"))
    first = F.coalesce("start_line", F.lit(1))
    return c.select(
        "chunk_id", "project_id", "chunk_size", "chunk_overlap", (F.col("_no") + 1).alias("piece_no"), F.col("_s.start").alias("start_char"), F.col("_s.end").alias("end_char"),
        (first + F.col("_s.line")).alias("start_line"), (first + F.col("_s.last")).alias("end_line"), F.substring("text", F.col("_s.start") + 1, F.col("_s.end") - F.col("_s.start")).alias("piece"),
    )
