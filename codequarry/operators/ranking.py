"""Fusion, keyword scores, hybrid ranking and context assembly, batched over query_id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codequarry.config import RetrievalConfig
from codequarry.functions import text as tx

PAYLOAD = "file_path language chunk_type function_name class_name text start_line end_line".split()


def fuse(hits: DataFrame, top: int, rrf_k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of (query_id, variant_no, rank, id, similarity).

    query_id, id, rrf_score, appearances, best_similarity, similarity (that of the last list), position.
    A query with one non-empty list keeps its similarities as scores.  Scores are rounded for output only:
    the order is that of the sums (to 12 places, below which a sum depends on the order of its terms).
    """
    lists = F.size(F.collect_set("variant_no").over(Window.partitionBy("query_id")))
    g = hits.withColumn("_lists", lists).groupBy("query_id", "id").agg(
        F.sum(F.lit(1.0) / (F.col("rank") + F.lit(float(rrf_k)))).alias("_rrf"), F.count("*").alias("appearances"), F.max("similarity").alias("best_similarity"),
        F.max_by("similarity", "variant_no").alias("similarity"), F.max("_lists").alias("_lists"), F.min(F.struct("variant_no", "rank")).alias("_first"),
    )
    g = g.withColumn("rrf_score", F.when(F.col("_lists") == 1, F.col("similarity")).otherwise(F.round("_rrf", 6)))
    position = F.row_number().over(Window.partitionBy("query_id").orderBy(F.when(F.col("_lists") == 1, F.col("similarity")).otherwise(F.round("_rrf", 12)).desc(), "_first", "id"))
    return g.withColumn("position", position).where(F.col("position") <= top).select("query_id", "id", "rrf_score", "appearances", "best_similarity", "similarity", "position")


def bm25_plus(candidates: DataFrame, queries: DataFrame, config: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """query_id, id, bm25: BM25+ of each candidate among the candidates of its query.

    ``candidates``: query_id, id, text; ``queries``: query_id, tokens.  Every query token counts, as
    often as it stands there; a document without the token still gets idf * delta; a token that no
    candidate holds gives nothing.
    """
    docs = candidates.select("query_id", "id", tx.tokenize_code(F.col("text")).alias("_t"))
    docs = docs.withColumn("dl", F.size("_t").cast("double"))
    per = Window.partitionBy("query_id")
    docs = docs.withColumn("n", F.count("*").over(per).cast("double")).withColumn("avgdl", F.avg("dl").over(per))
    asked = queries.select("query_id", F.explode("tokens").alias("token")).groupBy("query_id", "token").agg(F.count("*").cast("double").alias("times"))
    pairs = docs.join(asked, "query_id")
    tf = F.size(F.filter("_t", lambda w: w == F.col("token"))).cast("double")
    pairs = pairs.withColumn("tf", tf)
    df = F.sum((F.col("tf") > 0).cast("double")).over(Window.partitionBy("query_id", "token"))
    pairs = pairs.withColumn("df", df)
    k1, b, delta = (F.lit(float(x)) for x in (config.k1, config.b, config.delta))
    one = F.lit(1.0)
    norm = k1 * (one - b + b * F.col("dl") / F.when(F.col("avgdl") > 0, F.col("avgdl")).otherwise(one)) + F.col("tf")
    part = F.when(F.col("df") > 0, F.col("times") * F.log((F.col("n") + one) / F.col("df")) * (delta + F.col("tf") * (k1 + one) / norm)).otherwise(0.0)
    scores = pairs.groupBy("query_id", "id").agg(F.sum(part).alias("bm25"))
    return docs.select("query_id", "id").join(scores, ["query_id", "id"], "left").select("query_id", "id", F.coalesce("bm25", F.lit(0.0)).alias("bm25"))


def hybrid(fused: DataFrame, chunks: DataFrame, queries: DataFrame, top: int, config: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """Five-signal scores of fused hits: semantic, bm25 (of the best), path, identifier and type; ``hybrid`` and its order ``position``.

    ``chunks``: id and PAYLOAD; ``queries``: query_id, tokens.  A query with one candidate has bm25 1 and identifier 0.
    """
    c = fused.join(chunks.select("id", *PAYLOAD), "id")
    scored = c.join(bm25_plus(c, queries, config), ["query_id", "id"]).join(queries.select("query_id", "tokens"), "query_id")
    per = Window.partitionBy("query_id")
    most, n = F.max("bm25").over(per), F.count("*").over(per)
    scored = scored.withColumn("_n", n).withColumn("keyword", F.when(F.col("_n") == 1, 1.0).otherwise(F.col("bm25") / F.when(most > 0, most).otherwise(1.0)))
    scored = (
        scored.withColumn("path_score", tx.path_score(F.col("file_path"))).withColumn("type_score", tx.chunk_type_score(F.col("chunk_type")))
        .withColumn("identifier", F.when(F.col("_n") == 1, 0.0).otherwise(tx.exact_identifier_score(F.col("tokens"), F.col("function_name"), F.col("class_name"), F.col("text"))))
    )
    total = config.semantic * F.col("similarity") + config.keyword * F.col("keyword") + config.path * F.col("path_score") + config.identifier * F.col("identifier") + config.chunk_type * F.col("type_score")
    scored = scored.withColumn("hybrid", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)), 4)).withColumnRenamed("position", "_before")
    order = Window.partitionBy("query_id").orderBy(F.desc("hybrid"), "_before")
    return scored.withColumn("position", F.row_number().over(order)).where(F.col("position") <= top).drop("_n", "_before")


def rerank(scored: DataFrame, top_k: int, config: RetrievalConfig = RetrievalConfig(), similarity: str = "hybrid") -> DataFrame:
    """Second ranking by similarity, type, name, appearances and path; ``final_score`` and ``final_rank``."""
    most = F.greatest(F.max("appearances").over(Window.partitionBy("query_id")), F.lit(1))
    s = scored.withColumn("name_score", tx.name_score(F.col("tokens"), F.col("function_name"), F.col("class_name"))).withColumn("appear_score", F.col("appearances") / most)
    total = config.rank_similarity * F.col(similarity) + config.rank_type * F.col("type_score") + config.rank_name * F.col("name_score") + config.rank_appearances * F.col("appear_score") + config.rank_path * F.col("path_score")
    s = s.withColumn("final_score", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)), 4))
    order = Window.partitionBy("query_id").orderBy(F.desc("final_score"), "position")
    return s.withColumn("final_rank", F.row_number().over(order)).where(F.col("final_rank") <= top_k)


def pack_context(ranked: DataFrame, budget: int = 1200) -> DataFrame:
    """Hits that fit the token budget, implementation before documentation, each by score; it stops at the first that doesn't fit.

    ``ranked``: query_id, id, final_score, final_rank, path_score, file_path, text; ``tokens`` are characters / 4.
    """
    budget = budget or 1200
    tier = F.when(F.col("path_score") >= 0.5, 0).otherwise(1)
    p = ranked.withColumn("tier", tier).withColumn("tokens", F.floor(F.length("text") / 4).cast("long"))
    order = Window.partitionBy("query_id").orderBy("tier", F.desc("final_score"), "final_rank")
    p = p.withColumn("place", F.row_number().over(order)).withColumn("used", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return p.withColumn("truncated", F.max("used").over(Window.partitionBy("query_id")) > budget).where(F.col("used") <= budget)


SEPARATOR = "\n" + "─" * 60 + "\n"


def context_text(packed: DataFrame) -> DataFrame:
    """One row for each query: text, chunks, implementation and documentation chunks, tokens, files in order of first use."""
    name = F.coalesce(F.nullif("function_name", F.lit("")), F.nullif("class_name", F.lit("")), F.lit(""))
    head = F.concat(
        F.lit("File: "), "file_path", F.lit(" | Language: "), F.coalesce("language", F.lit("")), F.lit(" | Lines: "), F.coalesce(F.col("start_line").cast("string"), F.lit("0")), F.lit("-"), F.coalesce(F.col("end_line").cast("string"), F.lit("0")),
        F.lit("\nType: "), F.coalesce("chunk_type", F.lit("block")), F.lit(" "), name, F.lit(" | Relevance: "), F.format_string("%.1f%%", F.round(F.round(F.col("final_score") * 100, 2), 1)), F.lit("\n"),
    )
    rows = packed.withColumn("_b", F.concat(head, F.col("text")))
    g = rows.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("place", "_b", "file_path", "tier", "tokens"))).alias("_p"))
    return g.select(
        "query_id", F.array_join(F.col("_p._b"), SEPARATOR).alias("context"), F.size("_p").alias("chunks"), F.size(F.filter("_p", lambda x: x["tier"] == 0)).alias("implementation_chunks"),
        F.size(F.filter("_p", lambda x: x["tier"] == 1)).alias("documentation_chunks"), F.aggregate("_p", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("tokens"), F.array_distinct(F.col("_p.file_path")).alias("files"),
    )


def group_sources(cards: DataFrame) -> DataFrame:
    """Answer cards by file: the best card's code and lines, its relevance, and all line ranges in order."""
    g = cards.groupBy("answer_id", "file_path").agg(F.max(F.struct(F.coalesce("relevance_score", F.lit(0.0)).alias("relevance_score"), (-F.col("card_rank")).alias("_r"), "code", "start_line", "end_line")).alias("_b"), F.count("*").alias("cards"), F.sort_array(F.collect_set(F.struct("start_line", "end_line"))).alias("_l"))
    ranges = F.array_join(F.transform("_l", lambda x: F.concat(F.coalesce(x["start_line"].cast("string"), F.lit("?")), F.lit("-"), F.coalesce(x["end_line"].cast("string"), F.lit("?")))), ",")
    return g.select("answer_id", "file_path", F.col("_b.relevance_score").alias("relevance_score"), F.col("_b.code").alias("code"), F.col("_b.start_line").alias("start_line"), F.col("_b.end_line").alias("end_line"), "cards", ranges.alias("ranges"))


def expand_queries(queries: DataFrame, most: int = 3) -> DataFrame:
    """query_id, variant_no, variant: the question (variant 0) and up to ``most`` rephrasings.

    Domain synonyms (at most 2), two templates on the question without its question word, one code
    phrase; repeats in any case are dropped, order is kept.
    """
    from codequarry.functions import tables as t

    q = F.trim("question")
    low = F.lower(q)
    domain = []
    for term, synonyms in t.DOMAIN_TERMS.items():
        for s in synonyms:
            new = F.regexp_replace(low, rf"\b{term}\b", s)
            domain.append(F.when(F.contains(low, F.lit(term)) & (new != low), new))
    domain_two = F.slice(F.array_compact(F.array(*domain)), 1, 2)
    core = F.trim(F.regexp_replace(low, t.QUESTION_WORD, ""))
    templates = F.array_compact(F.array(*[F.when(core != "", F.concat(core, F.lit(x))) for x in (" function implementation", " code location file")]))
    call = F.regexp_extract(low, r"\b([a-z_][a-z0-9_]*)\s*\(", 1)
    code = F.array_compact(F.array(
        F.when(F.startswith(low, F.lit("where")) | F.startswith(low, F.lit("which file")) | F.startswith(low, F.lit("what file")), F.concat(F.lit("implement "), F.regexp_replace(low, r"^where\s+(is|are|does)\s+", ""))),
        F.when(F.startswith(low, F.lit("how")) | F.startswith(low, F.lit("explain")), F.concat(F.lit("function "), F.regexp_replace(low, r"^(how|explain)\s+(does|is|the)?\s*", ""), F.lit(" implementation"))),
        F.when(call != "", F.concat(F.lit("def "), call)),
    ))
    every = F.transform(F.concat(domain_two, templates, F.slice(code, 1, 1)), lambda v: F.trim(v))
    fresh = F.array_distinct(F.filter(every, lambda v: (v != "") & (F.lower(v) != low)))
    variants = F.concat(F.array(q), F.slice(fresh, 1, most))
    return queries.where("question is not null and trim(question) <> ''").select("query_id", F.posexplode(variants).alias("variant_no", "variant"))


def enrich(queries: DataFrame, messages: DataFrame) -> DataFrame:
    """query_id, question: vague questions get the last two messages of their session as context.

    ``queries``: query_id, session_id, question; ``messages``: session_id, seq, role, content."""
    last = Window.partitionBy("session_id").orderBy(F.desc("seq"))
    m = messages.where(F.col("role").isin("user", "assistant")).withColumn("_r", F.row_number().over(last)).where("_r <= 2")
    said = F.when(F.col("role") == "user", F.substring("content", 1, 80)).otherwise(F.substring(F.split("content", r"\.", 2)[0], 1, 120))
    context = m.groupBy("session_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", said.alias("s")))), lambda x: x["s"]), " ").alias("_context"))
    q = queries.join(context, "session_id", "left")
    plain = F.trim("question")
    return q.select("query_id", F.when(tx.is_vague(F.col("question")) & F.col("_context").isNotNull(), F.concat(plain, F.lit(" context: "), F.col("_context"))).otherwise(plain).alias("question"))


def retrieve(chunks: DataFrame, variants: DataFrame, queries: DataFrame, config: RetrievalConfig = RetrievalConfig(), threshold: float | None = None) -> DataFrame:
    """The whole chain: search each variant, fuse, hybrid score, rerank; top_k rows for each query.

    ``chunks``: id, embedding and PAYLOAD; ``variants``: query_id, variant_no, embedding; ``queries``: query_id, tokens."""
    from codequarry.operators.search import vector_topk

    k = min(2 * config.top_k, config.most_per_variant)
    asked = variants.select(F.struct("query_id", "variant_no").alias("key"), "embedding").select(F.to_json("key").alias("query_id"), "embedding")
    kind = dict(variants.dtypes)
    found = vector_topk(chunks.select("id", "embedding"), asked, k, config.similarity_threshold if threshold is None else threshold)
    hits = found.select(F.from_json("query_id", f"query_id {kind['query_id']}, variant_no int").alias("_k"), "id", "rank", "similarity").select("_k.*", "id", "rank", "similarity")
    fused = fuse(hits, 2 * config.top_k, config.rrf_k)
    return rerank(hybrid(fused, chunks, queries, 2 * config.top_k, config), config.top_k, config)


def with_fallback(hits: DataFrame, fallback: DataFrame) -> DataFrame:
    """``hits``, and for queries without any those of ``fallback`` (found by keywords, without filters) as one list."""
    missing = fallback.join(hits.select("query_id").distinct(), "query_id", "left_anti")
    return hits.unionByName(missing.select(*[F.lit(0).alias(c) if c == "variant_no" else F.col(c) for c in hits.columns]))
