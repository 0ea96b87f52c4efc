"""Prompts as columns, and answers from an injected generator."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _section(title: str, body: Column) -> Column:
    """A titled part of a prompt; null, and so left out, where the body is null or empty."""
    return F.when(F.coalesce(body, F.lit("")) != "", F.concat(F.lit(f"## {title}\n"), body))


def chat_prompt(question: Column, context: Column, history: Column | None = None, memories: Column | None = None, architecture: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    parts = [_section(t, none if c is None else c) for t, c in (("Conversation", history), ("Project memories", memories), ("Architecture", architecture), ("Code", context), ("Question", question))]
    return F.concat_ws("\n\n", *parts)


def explain_prompt(code: Column, language: Column) -> Column:
    return F.concat_ws("\n\n", F.concat(F.lit("Explain this "), F.coalesce(language, F.lit("code")), F.lit(":")), code)


def wrapped_context(context: Column, chunks: Column, truncated: Column) -> Column:
    """The assembled context with its head, and a note where the budget cut it."""
    note = F.when(truncated, F.lit("\n(more matches were left out for length)")).otherwise("")
    return F.concat(F.lit("Relevant code ("), chunks.cast("string"), F.lit(" parts):\n\n"), F.coalesce(context, F.lit("")), note)


def plain_summary(name: Column, files: Column, languages: Column, hints: Column) -> Column:
    """Summary of a project without a generator: ``languages`` and ``hints`` are arrays."""
    listed = lambda c, n, other: F.when(F.size(c) > 0, F.array_join(F.slice(c, 1, n), ", ")).otherwise(other)
    return F.concat(name, F.lit(": "), files.cast("string"), F.lit(" files in "), listed(languages, 6, "unknown"), F.lit("; "), listed(hints, 6, "standard structure"))


def stub(prompts: pd.Series) -> list[str]:
    """Stands in for a model: the size of the prompt, which is the same on every run."""
    return [f"[{len(p)} characters]" if isinstance(p, str) else "" for p in prompts]


def answer(rows: DataFrame, prompt: str = "prompt", generator: Callable[[pd.Series], list[str]] = stub) -> DataFrame:
    """``rows`` with a column ``answer``; the generator gets batches of prompts in the workers."""

    @F.pandas_udf(T.StringType())
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(generator(part), dtype=object)

    return rows.withColumn("answer", run(F.col(prompt)))
