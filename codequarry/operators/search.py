"""Vector search, embedding, cache and upsert."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def newest_by(df: DataFrame, keys: list[str], by: str) -> DataFrame:
    """The newest row of each key (null is oldest); ties go to the least hash of the row.  The upsert of a keyed table is ``newest_by(old union new)``."""
    kept = [c for c, kind in df.dtypes if c != by and not kind.startswith("map")]
    order = Window.partitionBy(*keys).orderBy(F.col(by).desc_nulls_last(), F.xxhash64(*kept))
    return df.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``table`` with ``rows`` put over it by key; rows of the new table win, and of repeated keys there the least by hash."""
    old = table.join(rows.select(key).distinct(), key, "left_anti")
    new = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64(*rows.columns)))).where("_rank = 1").drop("_rank")
    return old.unionByName(new)


def remove_project(table: DataFrame, project_id: str) -> DataFrame:
    return table.where(~F.col("project_id").eqNullSafe(project_id))


def collection_stats(table: DataFrame) -> DataFrame:
    """project_id, collection, rows."""
    from codequarry.functions.text import collection_name

    return table.groupBy("project_id").agg(F.count("*").alias("rows")).select("project_id", collection_name(F.col("project_id")).alias("collection"), "rows")


def _scorer(queries, dim: int, k: int):
    """Top k of each query among the rows of a batch: a product of matrices, and only k rows a query leave the batch."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, matrix = queries.value
        for part in parts:
            part = part[[v is not None and len(v) == dim for v in part["embedding"]]]
            if not len(part):
                continue
            x = np.stack(part["embedding"].to_numpy()).astype(np.float64)
            norm = np.sqrt((x * x).sum(axis=1))
            good = np.isfinite(norm) & (norm > 0)
            part, x = part[good], x[good] / norm[good][:, None]
            if not len(part):
                continue
            ids = part["id"].to_numpy()
            order = np.argsort(ids)
            ids, scores = ids[order], np.round(matrix @ x[order].T, 9)
            keep = min(k, len(ids))
            top = np.argsort(-scores, axis=1, kind="stable")[:, :keep]  # ids ascend, so ties go to the smaller
            rows = np.repeat(np.arange(len(names)), keep)
            yield pd.DataFrame({"query_id": names[rows], "id": ids[top.ravel()], "cosine": scores[rows, top.ravel()]})

    return run


def vector_topk(corpus: DataFrame, queries: DataFrame, k: int, threshold: float | None = None, block: int = 4096, dim: int | None = None) -> DataFrame:
    """query_id, id, rank, similarity: for each query the ``k`` nearest rows by cosine, then those of at least ``threshold``.

    ``corpus``: id, embedding; ``queries``: query_id, embedding.  Similarity is the cosine, not under
    0, rounded to 4 places; ties go to the smaller id.  Null, zero, non-finite vectors and those of
    another length than ``dim`` (by default the most frequent one of the queries) take no part.  Queries are worked in blocks of ``block``, which bounds what is
    broadcast; each block scans the corpus once and shuffles k rows for each query and batch.
    """
    spark = corpus.sparkSession
    q = queries.where("embedding is not null").select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
    id_type, query_type = corpus.schema["id"].dataType, queries.schema["query_id"].dataType
    schema = T.StructType([T.StructField("query_id", query_type), T.StructField("id", id_type), T.StructField("cosine", T.DoubleType())])
    lengths = {r["n"]: r["count"] for r in q.groupBy(F.size("embedding").alias("n")).count().collect()}
    dim = dim or max(lengths, key=lambda n: (lengths[n], n), default=0)
    blocks = max(1, -(-sum(lengths.values()) // block))
    scored: DataFrame | None = None
    for b in range(blocks):
        rows = q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).orderBy("query_id").collect()
        rows = [r for r in rows if len(r["embedding"]) == dim and np.isfinite(r["embedding"]).all() and any(r["embedding"])] if dim else []
        m = np.array([r["embedding"] for r in rows], dtype=np.float64).reshape(len(rows), dim)
        m = m / np.sqrt((m * m).sum(axis=1, keepdims=True)) if len(rows) else m
        shared = spark.sparkContext.broadcast((np.array([r["query_id"] for r in rows], dtype=object), m))
        part = corpus.select("id", F.col("embedding").cast("array<double>").alias("embedding")).mapInPandas(_scorer(shared, dim, k), schema) if len(rows) else spark.createDataFrame([], schema)
        scored = part if scored is None else scored.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "id"))
    out = scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "id", "rank", F.round(F.greatest(F.lit(0.0), F.col("cosine")), 4).alias("similarity"))
    return out if threshold is None else out.where(F.col("similarity") >= threshold)


def hashing_embedder(dim: int = 384) -> Callable[[pd.Series], list]:
    """Deterministic feature hashing of words; stands in for a model behind the same signature."""

    def embed(texts: pd.Series) -> list:
        out = []
        for t in texts:
            v = np.zeros(dim)
            for w in (t or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % dim] += 1.0 if h >> 63 else -1.0
            n = np.linalg.norm(v)
            out.append((v / n if n else v).astype(np.float32))
        return out

    return embed


def embed(rows: DataFrame, text: str, embedder: Callable[[pd.Series], list] | None = None) -> DataFrame:
    """``rows`` with a column ``embedding`` (unit length; all zero for blank texts)."""
    run = embedder or hashing_embedder()

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def apply(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(run(part))

    return rows.withColumn("embedding", apply(F.col(text)))


def cache_key(model: str, text: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{model}::"), text), 256)


def uncached(rows: DataFrame, cache: DataFrame, model: str, text: str) -> DataFrame:
    """Rows whose text has no vector of this model in ``cache`` (column key); each distinct text once would suffice to embed."""
    return rows.withColumn("key", cache_key(model, F.col(text))).join(cache.select("key").distinct(), "key", "left_anti")
