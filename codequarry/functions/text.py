"""Scalar functions on text columns, all built from JVM expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from codequarry.functions import tables as t


def _lookup(key: Column, mapping: dict) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), key)


def contains_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def tokenize_code(text: Column) -> Column:
    """Lower-case words of code: camel case and punctuation split, two characters or more, not all digits.  Null gives an empty array."""
    s = F.regexp_replace(F.coalesce(text, F.lit("")), r"([a-z])([A-Z])", "$1 $2")
    s = F.regexp_replace(s, r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    s = F.lower(F.regexp_replace(s, r"[^a-zA-Z0-9]", " "))
    return F.filter(F.split(s, " +"), lambda w: (F.length(w) >= 2) & ~w.rlike(r"^[0-9]+$"))


def identifiers(text: Column) -> Column:
    """Distinct lower-case identifiers and their camel-case parts."""
    raw = F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([\p{L}\p{N}_]+)"), 1), lambda w: w.rlike("^[a-zA-Z_][a-zA-Z0-9_]*$"))
    parts = F.transform(raw, lambda i: F.regexp_extract_all(F.lower(F.regexp_replace(i, r"([a-z])([A-Z])", "$1 $2")), F.lit(r"([a-z]+)"), 1))
    return F.array_distinct(F.concat(F.transform(raw, lambda i: F.lower(i)), F.flatten(parts)))


def path_score(path: Column) -> Column:
    """File name first, then the first tier of which any part occurs in the path, else 0.5."""
    low = F.lower(F.regexp_replace(F.coalesce(path, F.lit("")), r"\\", "/"))
    tiers = F.lit(0.5)
    for dirs, score in reversed(t.PATH_TIERS):
        tiers = F.when(contains_any(low, dirs), F.lit(score)).otherwise(tiers)
    return F.coalesce(_lookup(F.element_at(F.split(low, "/"), -1), t.FILENAME_SCORES), tiers)


def chunk_type_score(chunk_type: Column) -> Column:
    return F.coalesce(_lookup(chunk_type, t.CHUNK_TYPE_SCORES), F.lit(0.4))


def _name_words(name: Column) -> Column:
    return F.regexp_extract_all(F.lower(name), F.lit(r"([a-z]+)"), 1)


def exact_identifier_score(tokens: Column, function_name: Column, class_name: Column, text: Column) -> Column:
    """Share of the query tokens found in the names, else 0.7 times the share among the identifiers of the first 500 characters."""
    names = F.lower(F.concat(F.coalesce(function_name, F.lit("")), F.lit(" "), F.coalesce(class_name, F.lit(""))))
    words, n = _name_words(names), F.size(tokens)
    in_name = F.size(F.filter(tokens, lambda w: F.array_contains(words, w) | F.contains(names, w)))
    code = identifiers(F.substring(F.coalesce(text, F.lit("")), 1, 500))
    in_code = F.size(F.filter(tokens, lambda w: F.array_contains(code, w)))
    one = F.lit(1.0)
    return (
        F.when(n == 0, F.lit(0.0)).when(in_name > 0, F.least(one, in_name / n)).when(in_code > 0, F.least(F.lit(0.7), F.lit(0.7) * in_code / n)).otherwise(F.lit(0.0))
    )


def name_score(tokens: Column, function_name: Column, class_name: Column) -> Column:
    """Share of the meaningful query tokens that are words of the name, else half the share that are parts of it."""
    first = F.trim(F.when(F.coalesce(function_name, F.lit("")) != "", function_name).otherwise(F.coalesce(class_name, F.lit(""))))
    low, words = F.lower(first), _name_words(first)
    useful = F.filter(tokens, lambda w: ~w.isin(t.NAME_STOP_WORDS) & (F.length(w) > 2))
    n = F.size(useful)
    exact = F.size(F.filter(useful, lambda w: F.array_contains(words, w)))
    part = F.size(F.filter(useful, lambda w: F.contains(low, w)))
    return F.when((n == 0) | (first == ""), F.lit(0.0)).when(exact > 0, F.least(F.lit(1.0), exact / n)).when(part > 0, F.least(F.lit(0.5), F.lit(0.5) * part / n)).otherwise(F.lit(0.0))


def _plain_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([a-z_][a-z0-9_]*)"), 1)


def keywords(text: Column) -> Column:
    """Distinct words of a question that aren't stop words and have more than two characters."""
    return F.array_distinct(F.filter(_plain_words(text), lambda w: ~w.isin(t.KEYWORD_STOP_WORDS) & (F.length(w) > 2)))


def fallback_keywords(text: Column, most: int = 5) -> Column:
    """The first words, in order and with repeats, that another stop list leaves."""
    return F.slice(F.filter(_plain_words(text), lambda w: ~w.isin(t.FALLBACK_STOP_WORDS) & (F.length(w) > 2)), 1, most)


def is_vague(text: Column) -> Column:
    q = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    short = (F.size(F.filter(F.split(q, r"\s+"), lambda w: w != "")) <= 4) & contains_any(q, t.VAGUE_WORDS)
    return reduce(lambda a, b: a | b, [q.rlike(p) for p in t.VAGUE_STARTS]) | short


def is_architecture_question(text: Column) -> Column:
    return contains_any(F.lower(F.coalesce(text, F.lit(""))), t.ARCHITECTURE_KEYWORDS)


def question_type(text: Column) -> Column:
    q = F.lower(F.coalesce(text, F.lit("")))
    return F.when(contains_any(q, t.EXPLAIN_KEYWORDS), "explain").when(contains_any(q, t.DESIGN_KEYWORDS), "architecture").otherwise("general")


def architecture_route(text: Column) -> Column:
    q = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit("general")
    for name, words in reversed(t.ROUTES):
        out = F.when(contains_any(q, words), name).otherwise(out)
    return out


def module_mentioned(text: Column) -> Column:
    """A PascalCase name that isn't a question word, else the stem of a file name, else a quoted word, else null."""
    names = F.filter(F.regexp_extract_all(text, F.lit(r"\b([A-Z][a-z0-9]+(?:[A-Z][A-Za-z0-9]*)+|[A-Z][A-Za-z0-9]{2,})\b"), 1), lambda w: ~F.lower(w).isin("what", "which", "where", "how", "who", "when", "why", "show", "does", "the", "explain", "describe", "list", "find", "tell", "give"))
    file = F.regexp_extract(text, r"([A-Za-z0-9_\-]+)\.(?:py|js|ts|go|java)\b", 1)
    quoted = F.regexp_extract(text, r"[\"'`]([^\"'`]+)[\"'`]", 1)
    return F.coalesce(F.get(names, F.lit(0)), F.nullif(file, F.lit("")), F.nullif(quoted, F.lit("")))


def module_name(path: Column, language: str = "python") -> Column:
    """Dotted module of a Python path, slashed one of a JavaScript path; leading source folders are taken off in turn."""
    p = F.regexp_replace(path, r"\\", "/")
    for prefix in ("src/", "app/", "lib/", "backend/") if language == "python" else ("src/", "app/", "lib/"):
        p = F.when(F.startswith(p, F.lit(prefix)), F.substring(p, F.lit(len(prefix) + 1), F.length(p))).otherwise(p)
    if language == "python":
        return F.regexp_replace(F.regexp_replace(p, "/", "."), r"\.py$", "")
    return F.regexp_replace(F.regexp_replace(p, r"\.js$", ""), r"\.ts$", "")


def language_of(path: Column) -> Column:
    """Language by skip lists, ending, file name and stem; null where the file is left out."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    ext = F.regexp_extract(name, r"[^.](\.[^.]+)$", 1)
    stem = F.when(ext != "", F.substring(name, F.lit(1), F.length(name) - F.length(ext))).otherwise(name)
    known = F.coalesce(_lookup(ext, t.EXTENSIONS), _lookup(name, t.FILENAMES), _lookup(stem, t.FILENAMES))
    return F.when(name.isin(t.SKIP_FILENAMES) | ext.isin(t.SKIP_EXTENSIONS), F.lit(None).cast("string")).otherwise(known)


def in_skipped_directory(path: Column) -> Column:
    """Whether a directory of the path is in the skip list or hidden."""
    dirs = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return F.exists(dirs, lambda d: F.lower(d).isin(t.SKIP_DIRECTORIES) | F.startswith(d, F.lit(".")))


def line_count(text: Column) -> Column:
    """Lines as an editor counts them: a last line end opens no new line, an empty text has none."""
    s = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), r"\n\z", "")
    return F.when(text == "", 0).otherwise(F.size(F.split(s, "\n")))


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")


def repo_parts(url: Column) -> Column:
    """struct(owner, repo, branch) of a repository URL; nulls where it is none."""
    u = F.regexp_replace(F.trim(url), "/+$", "")
    pattern = r"^(?i:(?:https?://)?(?:www\.)?github\.com/)([^/\s]+)/([^/\s]+)(?:/tree/([^/\s]+).*)?$"
    owner, repo, branch = (F.regexp_extract(u, pattern, i) for i in (1, 2, 3))
    repo = F.regexp_replace(repo, r"\.git$", "")
    valid = owner.rlike(r"^[A-Za-z0-9-]{1,39}$") & repo.rlike(r"^[A-Za-z0-9._-]{1,100}$")
    none = F.lit(None).cast("string")
    return F.struct(F.when(valid, F.lower(owner)).otherwise(none).alias("owner"), F.when(valid, repo).otherwise(none).alias("repo"), F.when(valid, F.nullif(branch, F.lit(""))).otherwise(none).alias("branch"))


def size_class(kilobytes: Column) -> Column:
    """struct(size, minutes, is_large, megabytes)."""
    k = kilobytes
    return F.struct(
        F.when(k < 10_000, "small").when(k < 50_000, "medium").when(k < 150_000, "large").otherwise("very_large").alias("size"),
        F.when(k < 10_000, 1).when(k < 50_000, 2).when(k < 150_000, 5).otherwise(10).alias("minutes"), (k > 50_000).alias("is_large"), F.round(k / 1024, 1).alias("megabytes"),
    )


def error_class(message: Column) -> Column:
    m = F.lower(message)
    out = F.when(message.isNull() | (message == ""), F.lit(None).cast("string")).otherwise("other")
    for name, words in reversed(t.ERRORS):
        out = F.when(contains_any(m, words), name).otherwise(out)
    return out


def architecture_hints(path: Column) -> Column:
    """Aggregate: labels for what any of a group's paths hints at, in fixed order."""
    low = F.lower(path)
    return F.array_compact(F.array(*[F.when(F.bool_or(contains_any(low, words)), F.lit(label)) for words, label in t.HINTS]))


def tags(raw: Column) -> Column:
    return F.filter(F.transform(raw, lambda x: F.lower(F.trim(x))), lambda x: x != "")


def collection_name(project_id: Column, kind: str = "code", most: int = 50) -> Column:
    return F.concat(F.lit("cm_"), F.substring(F.regexp_replace(project_id, r"[^a-zA-Z0-9_-]", "_"), 1, most), F.lit(f"_{kind}"))


def embedding_text(language: Column, path: Column, function_name: Column, class_name: Column, text: Column) -> Column:
    """What is embedded for a chunk: language, path and name before the text."""
    name = F.when(F.coalesce(function_name, F.lit("")) != "", function_name).otherwise(F.nullif(class_name, F.lit("")))
    return F.concat(F.concat_ws(" ", language, path, F.when(name.isNotNull(), F.concat(F.lit("["), name, F.lit("]")))), F.lit("\n"), text)


def truncated(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def readable_bytes(n: Column) -> Column:
    unit = F.least(F.greatest(F.floor(F.log(1024.0, F.greatest(n, F.lit(1)))), F.lit(0)), F.lit(3)).cast("int")
    return F.when(n == 0, "0 B").otherwise(F.concat(F.round(n / F.pow(F.lit(1024.0), unit), 1).cast("string"), F.lit(" "), F.element_at(F.array(*[F.lit(x) for x in ("B", "KB", "MB", "GB")]), unit + 1)))


def time_ago(then: Column, now: Column) -> Column:
    """Minutes, hours or days since a time, in words."""
    minutes = F.timestamp_diff("MINUTE", then, now)
    return (
        F.when(minutes < 1, "just now").when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m ago"))).when(minutes < 1440, F.concat(F.floor(minutes / 60).cast("string"), F.lit("h ago")))
        .otherwise(F.concat(F.floor(minutes / 1440).cast("string"), F.lit("d ago")))
    )
