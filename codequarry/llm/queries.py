"""Queries pN_... of the training-data operators, and their SQL where SQL can state them."""

from __future__ import annotations

from pyspark.sql import functions as F

from codequarry.llm import docpairs, mixing, neardup, neighbours, packing, provenance, secrets, splitting, subjects, syntax
from codequarry.llm.common import columns_or_null, table


def p1_checked(spark, d):
    return syntax.check_syntax(table(spark, d, "modules"), table(spark, d, "source_files"))


def p1_found(spark, d):
    return p1_checked(spark, d).where(F.col("status").isin("wrong_language", "corrupt")).select("project_id", "file_path").distinct()


def p1_rates(spark, d):
    return syntax.broken_rates(p1_checked(spark, d))


def _definitions(spark, d):
    """The function, method and class records of chunks, as (id, at, wanted, text); the newest row of an id counts."""
    c = columns_or_null(table(spark, d, "chunks"), chunk_id="string", chunk_type="string", ingested_at="timestamp_ntz", text="string")
    return c.select(F.col("chunk_id").alias("id"), F.col("ingested_at").alias("at"), F.col("chunk_type").isin("function", "method", "class").alias("wanted"), "text")


def _near(spark, d):
    return neardup.NearDuplicates(_definitions(spark, d), similarity=0.7, k=3, least_words=30)


def p2_found(spark, d):
    return _near(spark, d).pairs().select(F.col("id_a").alias("chunk_id_a"), F.col("id_b").alias("chunk_id_b")).distinct()


def p2_groups(spark, d):
    return _near(spark, d).groups().withColumnRenamed("id", "chunk_id")


def p3_labels(spark, d):
    return provenance.classify_files(table(spark, d, "chunks"), table(spark, d, "upstream_files"))


def p3_found(spark, d):
    return p3_labels(spark, d).where("label <> 'handwritten'").select("project_id", "file_path").distinct()


def p4_pieces(spark, d):
    return splitting.split_oversized(table(spark, d, "chunks"), table(spark, d, "chunk_settings"))


def p4_found(spark, d):
    return p4_pieces(spark, d).select("chunk_id").distinct()


def p5_pairs(spark, d):
    return docpairs.doc_pairs(table(spark, d, "chunks"))


def p5_found(spark, d):
    return docpairs.doc_pairs(table(spark, d, "chunks"), with_code=False).select("chunk_id").distinct()


def _secrets(spark, d, with_text):
    chunks = secrets.find_secrets(table(spark, d, "chunks"), ["chunk_id"], "text", "ingested_at", with_text)
    cards = secrets.find_secrets(table(spark, d, "source_chunks"), ["card_id"], "code", "asked_at", with_text)
    return chunks.select(F.lit("chunks").alias("table_name"), F.col("chunk_id").alias("record_id"), "lines", "redacted").unionByName(
        cards.select(F.lit("source_chunks").alias("table_name"), F.col("card_id").cast("string").alias("record_id"), "lines", "redacted")
    )


def p6_found(spark, d):
    return _secrets(spark, d, False).select("table_name", "record_id", F.explode("lines").alias("line_no")).distinct()


def p6_redacted(spark, d):
    return _secrets(spark, d, True)


def p7_neighbours(spark, d):
    v = table(spark, d, "embedded_chunks").select(F.col("chunk_id").alias("id"), F.col("embedded_at").alias("at"), "embedding")
    return neighbours.most_similar(v).select(F.col("id").alias("chunk_id"), F.col("near_id").alias("near_chunk_id"), F.round("similarity", 5).alias("similarity"), "rank")


def p7_found(spark, d):
    n = p7_neighbours(spark, d)
    return n.select(F.least("chunk_id", "near_chunk_id").alias("chunk_id_a"), F.greatest("chunk_id", "near_chunk_id").alias("chunk_id_b")).distinct()


def p8_containers(spark, d):
    return packing.pack_documents(table(spark, d, "documents"))


def p8_report(spark, d):
    return packing.packing_report(p8_containers(spark, d))


def p8_found(spark, d):
    return p8_containers(spark, d).where("pieces > 1").select("doc_id").distinct()


def p9_shares(spark, d):
    return mixing.Mixture(table(spark, d, "documents"), table(spark, d, "mix_plan")).report()


def p9_selection(spark, d):
    return mixing.Mixture(table(spark, d, "documents"), table(spark, d, "mix_plan")).selection()


def p10_subjects(spark, d):
    documents = table(spark, d, "documents")
    return subjects.SubjectModel(documents, table(spark, d, "subject_labels")).assign()


def p10_found(spark, d):
    return p10_subjects(spark, d).select("doc_id", "subject").distinct()


def queries():
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1:2].isdigit()}


_NEWEST = "chunks_n AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at DESC NULLS LAST) AS rn FROM chunks) WHERE rn = 1)"

#: Statements that say the same without the operators; where SQL can't (parsing, secrets, documentation,
#: labels, packing, topic models), tests hold the operators against brute force and fixtures instead.
ORACLES = {
    "p2_found": f"""WITH {_NEWEST}, w AS (SELECT chunk_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS ws FROM chunks_n WHERE chunk_type IN ('function', 'method', 'class') AND text IS NOT NULL),
s AS (SELECT DISTINCT chunk_id, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS sh FROM (SELECT chunk_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 30)),
n AS (SELECT chunk_id, count(*) AS n FROM s GROUP BY 1), p AS (SELECT a.chunk_id AS chunk_id_a, b.chunk_id AS chunk_id_b, count(*) AS shared FROM s a JOIN s b ON a.sh = b.sh AND a.chunk_id < b.chunk_id GROUP BY 1, 2)
SELECT chunk_id_a, chunk_id_b FROM p JOIN n x ON x.chunk_id = chunk_id_a JOIN n y ON y.chunk_id = chunk_id_b WHERE 10 * shared >= 7 * (x.n + y.n - shared)""",
    "p4_found": f"""WITH {_NEWEST}, s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY updated_at DESC NULLS LAST) AS rn FROM chunk_settings) WHERE rn = 1)
SELECT c.chunk_id FROM chunks_n c LEFT JOIN s ON s.project_id = c.project_id AND s.project_id <> '*' WHERE length(c.text) > coalesce(s.chunk_size, (SELECT chunk_size FROM s WHERE project_id = '*'))""",
    "p7_found": """WITH v AS (SELECT chunk_id AS id, CAST(embedding AS DOUBLE[]) AS x FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY embedded_at DESC NULLS LAST) AS rn FROM embedded_chunks) WHERE rn = 1 AND len(embedding) = 384),
g AS (SELECT id, x, sqrt(list_dot_product(x, x)) AS n FROM v WHERE NOT list_contains(list_transform(x, lambda a: coalesce(isfinite(a), false)), false) AND list_dot_product(x, x) > 0),
r AS (SELECT a.id AS a, b.id AS b, row_number() OVER (PARTITION BY a.id ORDER BY round(list_dot_product(a.x, b.x) / (a.n * b.n), 9) DESC, b.id) AS rk FROM g a JOIN g b ON a.id <> b.id)
SELECT DISTINCT least(a, b) AS chunk_id_a, greatest(a, b) AS chunk_id_b FROM r WHERE rk <= 5""",
}


def oracle_sql():
    return dict(ORACLES)
