"""Project memories and chat sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codequarry.functions import text as tx

MAX_MESSAGES, SESSION_SECONDS = 10, 3600


def list_memories(memories: DataFrame, memory_type: str | None = None) -> DataFrame:
    """Newest first within each project, as ``position``."""
    m = memories if memory_type is None else memories.where(F.col("memory_type") == memory_type)
    return m.withColumn("position", F.row_number().over(Window.partitionBy("project_id").orderBy(F.col("created_at").desc_nulls_last(), "id")))


def search_memories(memories: DataFrame, queries: DataFrame, k: int = 3, threshold: float = 0.30, memory_type: str | None = None) -> DataFrame:
    from codequarry.operators.search import vector_topk

    m = memories if memory_type is None else memories.where(F.col("memory_type") == memory_type)
    return vector_topk(m.select("id", "embedding"), queries, k, threshold)


def injected(memories: DataFrame) -> DataFrame:
    """query_id, memory_text: lines ``[Type Title (title)]: content`` in order of rank."""
    line = F.concat(F.lit("["), F.initcap(F.regexp_replace("memory_type", "_", " ")), F.when(F.coalesce("title", F.lit("")) != "", F.concat(F.lit(" ("), F.col("title"), F.lit(")"))).otherwise(""), F.lit("]: "), F.col("content"))
    return memories.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", line.alias("l")))), lambda x: x["l"]), "\n").alias("memory_text"))


def last_messages(messages: DataFrame, most: int = MAX_MESSAGES) -> DataFrame:
    """The last messages of each session (session_id, seq, role, content), oldest first as ``place``."""
    w = Window.partitionBy("session_id")
    m = messages.withColumn("_r", F.row_number().over(w.orderBy(F.desc("seq")))).where(F.col("_r") <= most)
    return m.withColumn("place", F.row_number().over(w.orderBy("seq"))).drop("_r")


def history(messages: DataFrame, most: int = MAX_MESSAGES, width: int = 300) -> DataFrame:
    """session_id, history: role and shortened content of the last messages, one line each."""
    line = F.concat(F.when(F.col("role") == "user", "User: ").otherwise("Assistant: "), tx.truncated(F.col("content"), width))
    return last_messages(messages, most).groupBy("session_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", line.alias("l")))), lambda x: x["l"]), "\n").alias("history"))


def expired(messages: DataFrame, now: Column, seconds: int = SESSION_SECONDS) -> DataFrame:
    """session_id, last_active, messages, is_expired."""
    g = messages.groupBy("session_id").agg(F.max("ts").alias("last_active"), F.count("*").alias("messages"))
    return g.withColumn("is_expired", F.timestamp_diff("SECOND", F.col("last_active"), now) > seconds)


def export_markdown(messages: DataFrame) -> DataFrame:
    """session_id, markdown: one section for each message that is no error."""
    part = F.concat(F.lit("## "), F.initcap("role"), F.lit("\n\n"), F.col("content"))
    m = messages.where("role in ('user', 'assistant') and content is not null")
    return m.groupBy("session_id").agg(F.concat(F.lit("# Conversation\n\n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", part.alias("p")))), lambda x: x["p"]), "\n\n---\n\n")).alias("markdown"))


def export_html(messages: DataFrame) -> DataFrame:
    escape = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    part = F.concat(F.lit('<section class="'), F.col("role"), F.lit('"><pre>'), escape(F.col("content")), F.lit("</pre></section>"))
    m = messages.where("role in ('user', 'assistant') and content is not null")
    return m.groupBy("session_id").agg(F.concat(F.lit("<html><body>"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", part.alias("p")))), lambda x: x["p"]), ""), F.lit("</body></html>")).alias("html"))
