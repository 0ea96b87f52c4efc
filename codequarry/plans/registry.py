"""Queries of the core operators over the project's tables, and the SQL that states the same."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codequarry.functions import text as tx
from codequarry.operators import chunking, graph, memory, ranking, registry, search, structure
from codequarry.plans.oracles import ORACLES
from codequarry.session import shared_folder
from codequarry.sources import files as sources
from codequarry.streaming import progress

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def chunks(spark, d):
    """The newest version of every chunk; absent names are empty."""
    c = search.newest_by(table(spark, d, "chunks"), ["chunk_id"], "ingested_at")
    return c.na.fill("", ["function_name", "class_name"])


def files(spark, d):
    return search.newest_by(table(spark, d, "source_files"), ["project_id", "file_path"], "ingested_at")


def modules(spark, d):
    return table(spark, d, "modules").distinct()


def documents(spark, d):
    return table(spark, d, "documents").select("doc_id", "text", "doc_kind", "project_id", "created_at").distinct()


def edges(spark, d):
    return graph.resolve_imports(modules(spark, d))


def joined(c):
    return F.array_join(F.sort_array(c), " ")


# --- scalar functions -----------------------------------------------------------------------------


@query
def tokenize_code(spark, d):
    t = chunks(spark, d).select("chunk_id", F.explode(tx.tokenize_code(F.col("text"))).alias("token"))
    return t.groupBy("chunk_id", "token").agg(F.count("*").alias("n"))


@query
def identifiers(spark, d):
    return chunks(spark, d).select("chunk_id", joined(tx.identifiers(F.col("text"))).alias("identifiers"))


@query
def path_score(spark, d):
    return chunks(spark, d).select("file_path", tx.path_score(F.col("file_path")).alias("path_score")).distinct()


@query
def chunk_type_score(spark, d):
    return chunks(spark, d).select("chunk_id", tx.chunk_type_score(F.col("chunk_type")).alias("type_score"))


@query
def exact_id_score(spark, d):
    tokens = tx.tokenize_code(F.col("file_path"))
    return chunks(spark, d).select("chunk_id", F.round(tx.exact_identifier_score(tokens, F.col("function_name"), F.col("class_name"), F.col("text")), 6).alias("identifier_score"))


@query
def name_score(spark, d):
    tokens = tx.tokenize_code(F.col("file_path"))
    return chunks(spark, d).select("chunk_id", F.round(tx.name_score(tokens, F.col("function_name"), F.col("class_name")), 6).alias("name_score"))


@query
def keyword_extract(spark, d):
    return documents(spark, d).select("doc_id", joined(tx.keywords(F.col("text"))).alias("keywords"), F.array_join(tx.fallback_keywords(F.col("text")), " ").alias("fallback"))


@query
def query_type(spark, d):
    q = F.col("text")
    return documents(spark, d).select("doc_id", tx.question_type(q).alias("question_type"), tx.is_architecture_question(q).alias("is_architecture"), tx.architecture_route(q).alias("route"))


@query
def vague_query(spark, d):
    return documents(spark, d).select("doc_id", tx.is_vague(F.col("text")).alias("is_vague"))


@query
def query_expand(spark, d):
    c = chunks(spark, d).where("function_name <> ''")
    q = c.select(F.col("chunk_id").alias("query_id"), F.concat(F.lit("Where is the "), F.coalesce("chunk_type", F.lit("code")), F.lit(" error service for "), F.col("function_name"), F.lit("() in "), F.col("language")).alias("question"))
    return ranking.expand_queries(q.where("question is not null"))


@query
def url_parse(spark, d):
    """The tables' host is invented; it is read as the code host that the parser knows."""
    p = table(spark, d, "projects").select("project_id", F.regexp_replace("source_url", "^https://code\\.example/", "https://github.com/").alias("source_url"))
    return p.select("project_id", "source_url", tx.repo_parts(F.col("source_url")).alias("r")).select("project_id", "source_url", "r.*").distinct()


@query
def language_detect(spark, d):
    return files(spark, d).select("project_id", "file_path", tx.language_of(F.col("file_path")).alias("language"))


@query
def line_counts(spark, d):
    return files(spark, d).select("project_id", "file_path", tx.line_count(F.col("content")).alias("lines"))


@query
def classify_error(spark, d):
    p = table(spark, d, "projects").select("project_id", "error_msg").distinct()
    return p.select("project_id", "error_msg", tx.error_class(F.col("error_msg")).alias("error_class"))


@query
def architecture_hints(spark, d):
    return files(spark, d).groupBy("project_id").agg(F.array_join(tx.architecture_hints(F.col("file_path")), ", ").alias("hints"))


@query
def tag_normalise(spark, d):
    p = table(spark, d, "projects").select("project_id", "languages").distinct()
    return p.select("project_id", "languages", F.array_join(tx.tags(F.split("languages", ",")), "|").alias("tags"))


@query
def collection_names(spark, d):
    p = table(spark, d, "projects").select("project_id").distinct()
    return p.select("project_id", tx.collection_name(F.col("project_id")).alias("code"), tx.collection_name(F.col("project_id"), "memory", 40).alias("memory"))


@query
def embedding_text(spark, d):
    t = tx.embedding_text(F.col("language"), F.col("file_path"), F.col("function_name"), F.col("class_name"), F.col("text"))
    return chunks(spark, d).select("chunk_id", F.sha2(t, 256).alias("digest"))


# --- files, chunkers, registry ----------------------------------------------------------------------


@query
def file_filters(spark, d):
    return registry.keep_files(files(spark, d)).select("project_id", "file_path")


@query
def size_bucket(spark, d):
    return registry.sizes(files(spark, d))


@query
def large_repo_cap(spark, d):
    return registry.cap_large(files(spark, d)).select("project_id", "file_path", "priority", "rank")


@query
def chunk_sliding(spark, d):
    c = chunking.sliding(files(spark, d))
    return c.select("chunk_id", "project_id", "file_path", "chunk_index", F.sha2("text", 256).alias("digest"), "start_line", "end_line", "char_count", "token_count")


@query
def chunk_markdown(spark, d):
    c = chunking.markdown(files(spark, d).where("language = 'markdown'"))
    return c.select("chunk_id", "file_path", "chunk_index", "title", "start_line", F.sha2("text", 256).alias("digest"))


@query
def chunk_definitions(spark, d):
    return chunking.definitions(files(spark, d)).select("chunk_id", "project_id", "file_path", "language", "chunk_type", "function_name", "class_name", "start_line", "end_line", "char_count")


@query
def chunk_routed(spark, d):
    return chunking.chunk_files(files(spark, d)).groupBy("language", "chunk_type").agg(F.count("*").alias("chunks"), F.countDistinct("project_id", "file_path").alias("files"))


@query
def chunks_by_language(spark, d):
    c = chunks(spark, d).groupBy("project_id", F.coalesce("language", F.lit("")).alias("language")).agg(F.count("*").alias("chunks"), F.countDistinct("file_path").alias("files"))
    return c.withColumn("strategy", chunking.strategy(F.col("language")))


@query
def chunk_inspect(spark, d):
    """The first 20 chunks of each project with a preview."""
    c = chunks(spark, d).select("project_id", "chunk_id", "file_path", "chunk_index", F.substring("text", 1, 200).alias("preview")).withColumn("rank", F.row_number().over(Window.partitionBy("project_id").orderBy("file_path", "chunk_index", "chunk_id"))).where("rank <= 20")
    return c.select("project_id", "chunk_id", "rank", "preview")


@query
def registry_list(spark, d):
    return registry.listed(table(spark, d, "projects")).select("project_id", "project_name", "status", "position")


@query
def find_existing(spark, d):
    p = table(spark, d, "projects")
    wanted = search.newest_by(p, ["project_id"], "updated_at").select(F.col("project_id").alias("request_id"), "source_url", "project_name", "source_type")
    return registry.find_existing(p, wanted)


@query
def project_search(spark, d):
    return registry.search_names(table(spark, d, "projects"), "a").select("project_id", "project_name")


@query
def files_by_language(spark, d):
    return registry.files_by_language(files(spark, d))


@query
def upsert_latest(spark, d):
    e = search.newest_by(table(spark, d, "embedded_chunks"), ["chunk_id"], "embedded_at")
    return e.select("chunk_id", "project_id", "model", F.coalesce(F.size("embedding"), F.lit(-1)).alias("size"))


@query
def embedding_cache_anti(spark, d):
    c = chunks(spark, d).select("chunk_id", "text")
    cached = table(spark, d, "source_chunks").where("code is not null").select(search.cache_key("mini-a2", F.col("code")).alias("key"))
    return search.uncached(c.where("text is not null"), cached, "mini-a2", "text").select("chunk_id", "key")


@query
def embed_hash(spark, d):
    return search.embed(chunks(spark, d).select("chunk_id", "text"), "text").select("chunk_id", F.size("embedding").alias("size"))


# --- search and ranking --------------------------------------------------------------------------------


def _vectors(spark, d, where="true"):
    e = table(spark, d, "embeddings").where(where)
    return e.select(F.col("vec_id").alias("id"), "embedding"), table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query
def vector_topk(spark, d):
    corpus, q = _vectors(spark, d)
    return search.vector_topk(corpus, q, 10)


@query
def vector_topk_filtered(spark, d):
    corpus, q = _vectors(spark, d, "label in (1, 3, 5)")
    return search.vector_topk(corpus, q, 10)


@query
def vector_threshold(spark, d):
    corpus, q = _vectors(spark, d)
    return search.vector_topk(corpus, q, 10, 0.2)


@query
def memory_search(spark, d):
    e = table(spark, d, "embeddings")
    kinds = F.array(F.lit("decision"), F.lit("note"), F.lit("convention"))
    m = e.select(F.col("vec_id").alias("id"), "embedding", F.element_at(kinds, (F.col("label") % 3 + 1).cast("int")).alias("memory_type"))
    return memory.search_memories(m, _vectors(spark, d)[1], 3, 0.1, "note")


def _cards(spark, d):
    """The cards of an answer as one ranked list for each kind of chunk."""
    c = table(spark, d, "source_chunks").distinct().withColumn("relevance_score", F.coalesce("relevance_score", F.lit(0.0)))
    c = c.where("answer_id is not null and file_path is not null").groupBy("answer_id", "file_path", F.coalesce("chunk_type", F.lit("block")).alias("kind")).agg(F.max("relevance_score").alias("similarity"))
    variant = F.when(F.col("kind") == "function", 0).when(F.col("kind") == "method", 1).when(F.col("kind") == "class", 2).when(F.col("kind") == "heading", 3).when(F.col("kind") == "module", 4).otherwise(5)
    c = c.groupBy("answer_id", "file_path", variant.alias("variant_no")).agg(F.max("similarity").alias("similarity"))
    rank = F.row_number().over(Window.partitionBy("answer_id", "variant_no").orderBy(F.desc("similarity"), "file_path"))
    return c.select(F.col("answer_id").alias("query_id"), "variant_no", rank.alias("rank"), F.col("file_path").alias("id"), "similarity")


@query
def rrf_fuse(spark, d):
    return ranking.fuse(_cards(spark, d), 10).select("query_id", "id", "rrf_score", "appearances", "best_similarity", "similarity", "position")


def _candidates(spark, d):
    """For each file, its chunks as candidates of the question that its path asks."""
    c = chunks(spark, d).where("text is not null and project_id is not null")
    key = F.concat_ws("/", "project_id", "file_path")
    return c.select(key.alias("query_id"), F.col("chunk_id").alias("id"), F.col("start_line"), *[x for x in ranking.PAYLOAD if x not in ("start_line",)], "similarity", "chunk_index"), c.select(key.alias("query_id"), tx.tokenize_code(F.col("file_path")).alias("tokens")).distinct()


@query
def bm25_plus(spark, d):
    c, q = _candidates(spark, d)
    return ranking.bm25_plus(c.select("query_id", "id", "text"), q).select("query_id", "id", F.round("bm25", 4).alias("bm25"))


def _scored(spark, d):
    c, q = _candidates(spark, d)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.coalesce("similarity", F.lit(0.0))), "id"))
    fused = c.select("query_id", "id", F.coalesce("similarity", F.lit(0.0)).alias("similarity"), rank.alias("position")).withColumn("appearances", F.lit(1) + F.col("position") % 3)
    return ranking.hybrid(fused, c.select("id", *ranking.PAYLOAD), q, 10)


@query
def hybrid_score(spark, d):
    return _scored(spark, d).select("query_id", "id", "hybrid", "position")


@query
def rerank(spark, d):
    return ranking.rerank(_scored(spark, d), 5).select("query_id", "id", "final_score", "final_rank")


@query
def context_budget(spark, d):
    return ranking.pack_context(ranking.rerank(_scored(spark, d), 10)).select("query_id", "id", "tier", "place", "used", "truncated")


@query
def context_text(spark, d):
    t = ranking.context_text(ranking.pack_context(ranking.rerank(_scored(spark, d), 10)))
    return t.select("query_id", F.sha2("context", 256).alias("digest"), "chunks", "implementation_chunks", "documentation_chunks", "tokens", F.array_join("files", "|").alias("files"))


@query
def retrieve_e2e(spark, d):
    """Two vectors for each question, searched, fused, scored and ranked."""
    e = search.newest_by(table(spark, d, "embedded_chunks"), ["chunk_id"], "embedded_at").where(F.size("embedding") == 384)
    c = chunks(spark, d).select(F.col("chunk_id").alias("id"), *ranking.PAYLOAD)
    corpus = c.join(e.select(F.col("chunk_id").alias("id"), "embedding"), "id")
    asked = corpus.where(F.conv(F.substring("id", 1, 8), 16, 10).cast("long") % 50 == 0)
    own = asked.select(F.col("id").alias("query_id"), F.lit(0).alias("variant_no"), "embedding")
    other = asked.select(F.col("id").alias("query_id"), F.lit(1).alias("variant_no"), F.transform("embedding", lambda x, i: F.when(i % 8 == 0, F.lit(0.0)).otherwise(x.cast("double"))).alias("embedding"))
    variants = own.withColumn("embedding", F.col("embedding").cast("array<double>")).unionByName(other)
    q = asked.select(F.col("id").alias("query_id"), tx.tokenize_code(F.concat_ws(" ", "function_name", "class_name", "file_path")).alias("tokens"))
    return ranking.retrieve(corpus, variants, q).select("query_id", "id", "final_score", "final_rank")


@query
def source_grouping(spark, d):
    g = ranking.group_sources(table(spark, d, "source_chunks").distinct())
    return g.select("answer_id", "file_path", "relevance_score", "cards", "ranges", F.sha2(F.coalesce("code", F.lit("")), 256).alias("digest"))


# --- sessions and memories ----------------------------------------------------------------------------------


def _messages(spark, d):
    """Documents of a project as its conversation: kinds answer and guide speak for the assistant."""
    m = documents(spark, d).where("project_id is not null and text is not null")
    role = F.when(F.col("doc_kind").isin("answer", "guide"), "assistant").when(F.col("doc_kind") == "adr", "system").otherwise("user")
    return m.select(F.col("project_id").alias("session_id"), F.col("doc_id").alias("seq"), role.alias("role"), F.col("text").alias("content"), F.col("created_at").alias("ts"))


@query
def history_last_n(spark, d):
    m = _messages(spark, d).where("role <> 'system'")
    return memory.last_messages(m).select("session_id", "seq", "role", "place")


@query
def history_text(spark, d):
    return memory.history(_messages(spark, d).where("role <> 'system'")).select("session_id", F.sha2("history", 256).alias("digest"))


@query
def session_expiry(spark, d):
    m = _messages(spark, d)
    return memory.expired(m, F.lit("2025-06-30 00:00:00").cast("timestamp_ntz")).select("session_id", "last_active", "messages", "is_expired")


@query
def enrich_query(spark, d):
    m = _messages(spark, d)
    q = m.select("session_id").distinct().select(F.col("session_id").alias("query_id"), "session_id", F.lit("Explain that in detail").alias("question"))
    return ranking.enrich(q, m).select("query_id", F.sha2("question", 256).alias("digest"))


@query
def memory_list(spark, d):
    m = documents(spark, d).select(F.col("doc_id").alias("id"), "project_id", F.col("doc_kind").alias("memory_type"), "created_at")
    return memory.list_memories(m, "note").select("id", "project_id", "position")


@query
def chat_export(spark, d):
    return memory.export_markdown(_messages(spark, d)).select("session_id", F.sha2("markdown", 256).alias("digest"))


# --- module graph --------------------------------------------------------------------------------------------


@query
def import_exact_resolve(spark, d):
    """Modules under the last part of their dotted name, which is what the tables' imports name."""
    m = modules(spark, d).withColumn("module_name", F.element_at(F.split("module_name", r"\."), -1))
    return graph.resolve_exact(m).select("project_id", "source", "target", "label")


@query
def import_prefix_resolve(spark, d):
    return graph.resolve_prefix(modules(spark, d)).select("project_id", "source", "target", "label")


@query
def import_dotted_resolve(spark, d):
    return graph.resolve_prefix(modules(spark, d), dotted=True).select("project_id", "source", "target", "label")


@query
def in_degree_topk(spark, d):
    return graph.top_in_degree(edges(spark, d)).select("project_id", "target", "imports", "rank")


@query
def most_complex(spark, d):
    return graph.most_complex(modules(spark, d)).select("project_id", "file_path", "complexity", "rank")


@query
def component_groups(spark, d):
    return graph.component_groups(modules(spark, d))


@query
def two_hop_flow(spark, d):
    m = modules(spark, d)
    return graph.flow(edges(spark, d), m.where("is_entry_point or size(entry_points) > 0"))


@query
def inheritance_pairs(spark, d):
    return graph.inheritance_pairs(modules(spark, d)).distinct()


@query
def inheritance_resolve(spark, d):
    return graph.resolve_inheritance(modules(spark, d)).distinct()


@query
def graph_statistics(spark, d):
    return graph.statistics(modules(spark, d), edges(spark, d))


@query
def graph_json(spark, d):
    j = graph.to_json(modules(spark, d))
    back = j.select("project_id", "file_path", F.from_json("node", "module_name string, imports array<string>, size_lines int").alias("n"))
    return back.select("project_id", "file_path", F.coalesce(F.size("n.imports"), F.lit(0)).alias("imports"), F.col("n.module_name").alias("module_name"))


@query
def graph_mermaid(spark, d):
    return graph.mermaid(modules(spark, d), edges(spark, d))


@query
def python_extract(spark, d):
    n = graph.extract_python(files(spark, d))
    return n.select("project_id", "file_path", "module_name", F.size("imports").alias("imports"), F.size("classes").alias("classes"), F.size("functions").alias("functions"), F.size("calls").alias("calls"), "is_entry_point", "size_lines")


@query
def script_extract(spark, d):
    n = graph.extract_script(files(spark, d))
    return n.select("project_id", "file_path", "module_name", F.array_join("imports", "|").alias("imports"), F.array_join("exports", "|").alias("exports"), F.array_join("classes", "|").alias("classes"), F.array_join("inherits_from", "|").alias("inherits_from"))


@query
def script_entries(spark, d):
    n = graph.extract_script(files(spark, d))
    return n.select("project_id", "file_path", F.array_join("functions", "|").alias("functions"), F.array_join("entry_points", "|").alias("entry_points"), "is_entry_point")


@query
def generic_extract(spark, d):
    n = graph.extract_generic(files(spark, d))
    return n.select("project_id", "file_path", "module_name", F.array_join("imports", "|").alias("imports"), F.array_join("classes", "|").alias("classes"), F.array_join("functions", "|").alias("functions"))


# --- structural questions ----------------------------------------------------------------------------------------


@query
def inheritance_edges(spark, d):
    """Bases named as the tables name them, by the class that they extend."""
    m = modules(spark, d).withColumn("inherits_from", F.transform("inherits_from", lambda b: F.regexp_replace(b, "Base$", "")))
    return graph.resolve_inheritance(m).distinct()


@query
def import_last_part(spark, d):
    """Modules under the name of their folder, which is what the tables' imports name."""
    m = modules(spark, d).withColumn("module_name", F.element_at(F.split("file_path", "/"), -2))
    return graph.resolve_exact(m).select("project_id", "source", "target", "label")


@query
def entry_answers(spark, d):
    a = structure.entry_answers(modules(spark, d), edges(spark, d))
    return a.select("project_id", "position", "file_path", *[F.array_join(c, "|").alias(c) for c in ("details", "classes", "imports")])


@query
def dependency_answers(spark, d):
    """Asked for the stems of all files that another file imports."""
    e = edges(spark, d)
    names = e.select("project_id", F.regexp_extract("target", r"([^/]+?)(?:\.[^./]+)?$", 1).alias("name"))
    a = structure.dependency_answers(modules(spark, d), e, names)
    return a.select("project_id", "name", "file_path", *[F.array_join(c, "|").alias(c) for c in ("imports_from", "imported_by", "inherits_from")])


@query
def architecture_overview(spark, d):
    a = structure.overview(modules(spark, d), edges(spark, d))
    return a.select("project_id", "modules", "classes", "functions", "dependencies", *[F.array_join(c, "|").alias(c) for c in ("languages", "entry_points", "core_modules")])


@query
def architecture_gate(spark, d):
    q = documents(spark, d).where("text is not null").select("project_id", F.col("text").alias("question"), "doc_id")
    return structure.gate(q, modules(spark, d)).select("doc_id", "project_id", "route")


@query
def architecture_summary(spark, d):
    return structure.summary_text(modules(spark, d), edges(spark, d))


# --- sources -------------------------------------------------------------------------------------------------------


def _raw(spark, d):
    """The files as bytes, the way a directory scan gives them."""
    f = files(spark, d).where("content is not null")
    return f.select("project_id", "file_path", F.encode("content", "utf-8").alias("bytes")).withColumn("length", F.octet_length("bytes"))


@query
def source_table(spark, d):
    t = sources.as_table(_raw(spark, d))
    return t.select("project_id", "file_path", "language", "file_size_bytes", "line_count", "encoding", F.sha2("content", 256).alias("digest"))


IGNORE = ["*.md", "tests/", "/app/**", "!keep.md", "internal/*/fixture", "# a remark", ""]


@query
def ignore_rules(spark, d):
    return files(spark, d).where(~sources.ignored(F.col("file_path"), IGNORE)).select("project_id", "file_path")


@query
def archive_members(spark, d):
    """Every file in an archive of its own, under a folder, and out of it again."""
    a = sources.archived(_raw(spark, d), root="root")
    m = sources.unpacked(a.select("project_id", F.col("archive").alias("content")))
    return m.select("project_id", "file_path", F.col("length").cast("long").alias("length"), F.sha2("bytes", 256).alias("digest"))


# --- streams -------------------------------------------------------------------------------------------------


@query
def progress_changes(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), F.struct("ts", "event_id").alias("seq"), F.col("event_type").alias("step"), F.floor("value").cast("long").alias("percent"), "event_id")
    return progress.progress_changes(e).select("key", "event_id", "step", "percent")


def _stream(spark, d, build, name):
    """Runs a stream over the events to its end, into files in the folder for checkpoints, and returns what it emitted."""
    source = table(spark, d, "events").schema
    e = spark.readStream.schema(source).option("pathGlobFilter", "events.parquet").parquet(d)
    e = e.select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("step"), F.floor("value").cast("long").alias("percent"))
    out = build(e)
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    q = out.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/rows")


@query
def stream_sessions(spark, d):
    s = _stream(spark, d, progress.stream_sessions, "stream_sessions")
    return s.select("key", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "events")


@query
def stream_progress(spark, d):
    return _stream(spark, d, progress.stream_progress, "stream_progress").groupBy("step").agg(F.count("*").alias("states"))


def queries():
    return dict(QUERIES)


def oracle_sql():
    return {k: v for k, v in ORACLES.items() if k in QUERIES}
