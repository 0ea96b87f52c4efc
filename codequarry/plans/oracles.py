"""SQL over the same tables for the queries of the registry; every statement stands by itself."""

from __future__ import annotations

from codequarry.functions import tables as t


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _in(words) -> str:
    return "(" + ", ".join(_q(w) for w in words) + ")"


def _any(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, {_q(w)})" for w in words) + ")"


def _case(key: str, mapping: dict) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {_q(k)} THEN {_q(v) if isinstance(v, str) else f'CAST({v} AS DOUBLE)'}" for k, v in mapping.items()) + " END"


CHUNKS = "chunks_n AS (SELECT * EXCLUDE (rn) REPLACE (coalesce(function_name, '') AS function_name, coalesce(class_name, '') AS class_name) FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at DESC NULLS LAST) AS rn FROM chunks) WHERE rn = 1)"
FILES = "files_n AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY project_id, file_path ORDER BY ingested_at DESC NULLS LAST) AS rn FROM source_files) WHERE rn = 1)"
MODULES = "modules_n AS (SELECT DISTINCT * FROM modules)"
PROJECTS = "projects_n AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY updated_at DESC NULLS LAST) AS rn FROM projects) WHERE rn = 1)"
DOCS = "docs_n AS (SELECT DISTINCT doc_id, text, doc_kind, project_id, created_at FROM documents)"
MESSAGES = DOCS + ", messages AS (SELECT project_id AS session_id, doc_id AS seq, CASE WHEN doc_kind IN ('answer', 'guide') THEN 'assistant' WHEN doc_kind = 'adr' THEN 'system' ELSE 'user' END AS role, text AS content, created_at AS ts FROM docs_n WHERE project_id IS NOT NULL AND text IS NOT NULL)"


def tokens(x: str) -> str:
    s = rf"regexp_replace(regexp_replace(coalesce({x}, ''), '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')"
    return f"list_filter(string_split_regex(lower(regexp_replace({s}, '[^a-zA-Z0-9]', ' ', 'g')), ' +'), lambda w: length(w) >= 2 AND NOT regexp_full_match(w, '[0-9]+'))"


def idents(x: str) -> str:
    raw = rf"list_filter(regexp_extract_all(coalesce({x}, ''), '[\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-zA-Z_][a-zA-Z0-9_]*'))"
    return rf"list_distinct(list_concat(list_transform({raw}, lambda i: lower(i)), flatten(list_transform({raw}, lambda i: regexp_extract_all(lower(regexp_replace(i, '([a-z])([A-Z])', '\1 \2', 'g')), '[a-z]+')))))"


def path_score(x: str) -> str:
    low = f"lower(replace(coalesce({x}, ''), chr(92), '/'))"
    tiers = " ".join(f"WHEN {_any(low, dirs)} THEN CAST({s} AS DOUBLE)" for dirs, s in t.PATH_TIERS)
    return f"coalesce({_case(f'string_split({low}, chr(47))[-1]', t.FILENAME_SCORES)}, CASE {tiers} ELSE CAST(0.5 AS DOUBLE) END)"


def type_score(x: str) -> str:
    return f"coalesce({_case(x, t.CHUNK_TYPE_SCORES)}, CAST(0.4 AS DOUBLE))"


def exact_id(tok: str) -> str:
    names = "lower(function_name || ' ' || class_name)"
    words = f"regexp_extract_all({names}, '[a-z]+')"
    in_name = f"len(list_filter({tok}, lambda w: list_contains({words}, w) OR contains({names}, w)))"
    in_code = f"len(list_filter({tok}, lambda w: list_contains({idents('substr(text, 1, 500)')}, w)))"
    n = f"CAST(len({tok}) AS DOUBLE)"
    return f"CASE WHEN len({tok}) = 0 THEN CAST(0 AS DOUBLE) WHEN {in_name} > 0 THEN least(CAST(1 AS DOUBLE), {in_name} / {n}) WHEN {in_code} > 0 THEN least(CAST(0.7 AS DOUBLE), CAST(0.7 AS DOUBLE) * {in_code} / {n}) ELSE CAST(0 AS DOUBLE) END"


def name_score(tok: str) -> str:
    first = "trim(CASE WHEN function_name <> '' THEN function_name ELSE class_name END)"
    useful = f"list_filter({tok}, lambda w: w NOT IN {_in(t.NAME_STOP_WORDS)} AND length(w) > 2)"
    exact = f"len(list_filter({useful}, lambda w: list_contains(regexp_extract_all(lower({first}), '[a-z]+'), w)))"
    part = f"len(list_filter({useful}, lambda w: contains(lower({first}), w)))"
    n = f"CAST(len({useful}) AS DOUBLE)"
    return f"CASE WHEN len({useful}) = 0 OR {first} = '' THEN CAST(0 AS DOUBLE) WHEN {exact} > 0 THEN least(CAST(1 AS DOUBLE), {exact} / {n}) WHEN {part} > 0 THEN least(CAST(0.5 AS DOUBLE), CAST(0.5 AS DOUBLE) * {part} / {n}) ELSE CAST(0 AS DOUBLE) END"


def language(path: str) -> str:
    name = f"lower(string_split({path}, '/')[-1])"
    ext = f"regexp_extract({name}, '[^.]([.][^.]+)$', 1)"
    stem = f"CASE WHEN {ext} <> '' THEN substr({name}, 1, length({name}) - length({ext})) ELSE {name} END"
    return f"CASE WHEN {name} IN {_in(t.SKIP_FILENAMES)} OR {ext} IN {_in(t.SKIP_EXTENSIONS)} THEN NULL ELSE coalesce({_case(ext, t.EXTENSIONS)}, {_case(name, t.FILENAMES)}, {_case(f'({stem})', t.FILENAMES)}) END"


def _dirs(path: str) -> str:
    return f"list_slice(string_split({path}, '/'), 1, len(string_split({path}, '/')) - 1)"


def _lines(x: str) -> str:
    return rf"CASE WHEN {x} = '' THEN 0 ELSE len(string_split(regexp_replace(regexp_replace({x}, '\r\n?', chr(10), 'g'), '\n$', ''), chr(10))) END"


def _topk(corpus: str, k: int, threshold: str = "") -> str:
    return f"""WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 50 = 0), v AS ({corpus}),
s AS (SELECT query_id, id, round(list_dot_product(e, x) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(x, x))), 9) AS c FROM q, v),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, id) AS rk FROM s)
SELECT query_id, id, CAST(rk AS INTEGER) AS rank, round(greatest(CAST(0 AS DOUBLE), c), 4) AS similarity FROM r WHERE rk <= {k} {threshold}"""


_ALL = "SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings"

CAND = CHUNKS + f""", cand0 AS (SELECT *, project_id || '/' || file_path AS query_id, chunk_id AS id, {tokens('file_path')} AS qt, {tokens('text')} AS dt, coalesce(similarity, CAST(0 AS DOUBLE)) AS sim FROM chunks_n WHERE text IS NOT NULL AND project_id IS NOT NULL AND file_path IS NOT NULL),
cand1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS pos0 FROM cand0), cand AS (SELECT *, 1 + pos0 % 3 AS appearances FROM cand1)"""
RETRIEVED = CHUNKS + f""", vec AS (SELECT chunk_id AS id, CAST(embedding AS DOUBLE[]) AS x FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY embedded_at DESC NULLS LAST) AS rn FROM embedded_chunks) WHERE rn = 1 AND len(embedding) = 384),
good AS (SELECT v.id, v.x FROM vec v JOIN chunks_n c ON c.chunk_id = v.id WHERE NOT list_contains(list_transform(v.x, lambda a: coalesce(isfinite(a), false)), false) AND list_dot_product(v.x, v.x) > 0),
asked0 AS (SELECT id AS query_id, x FROM good WHERE CAST('0x' || substr(id, 1, 8) AS BIGINT) % 50 = 0),
variants AS (SELECT query_id, 0 AS v, x AS e FROM asked0 UNION ALL SELECT query_id, 1, list_transform(x, lambda a, i: CASE WHEN (i - 1) % 8 = 0 THEN CAST(0 AS DOUBLE) ELSE a END) FROM asked0),
scored AS (SELECT query_id, v, id, round(list_dot_product(e, x) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(x, x))), 9) AS c FROM variants, good),
hits AS (SELECT * FROM (SELECT *, round(greatest(CAST(0 AS DOUBLE), c), 4) AS s, row_number() OVER (PARTITION BY query_id, v ORDER BY c DESC, id) AS rk FROM scored) WHERE rk <= 8 AND s >= 0.35),
lists AS (SELECT query_id, count(DISTINCT v) AS n FROM hits GROUP BY 1),
fused AS (SELECT query_id, id, sum(CAST(1 AS DOUBLE) / (rk + CAST(60 AS DOUBLE))) AS rrf, count(*) AS appearances, max_by(s, v) AS sim, min(v * 1000 + rk) AS f FROM hits GROUP BY 1, 2),
placed AS (SELECT fused.*, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN n = 1 THEN sim ELSE round(rrf, 12) END DESC, f, id) AS pos0 FROM fused JOIN lists USING (query_id)),
cand AS (SELECT p.query_id, p.id, p.sim, p.appearances, p.pos0, c.* EXCLUDE (similarity), {tokens("concat_ws(' ', qc.function_name, qc.class_name, qc.file_path)")} AS qt, {tokens('c.text')} AS dt FROM placed p JOIN chunks_n c ON c.chunk_id = p.id JOIN chunks_n qc ON qc.chunk_id = p.query_id WHERE p.pos0 <= 10)"""

KEYWORDS = f""",
asked AS (SELECT query_id, token, CAST(count(*) AS DOUBLE) AS times FROM (SELECT query_id, unnest(qt) AS token FROM (SELECT query_id, any_value(qt) AS qt FROM cand GROUP BY 1)) GROUP BY 1, 2),
docs AS (SELECT query_id, id, dt, CAST(len(dt) AS DOUBLE) AS dl, CAST(count(*) OVER (PARTITION BY query_id) AS DOUBLE) AS n, avg(CAST(len(dt) AS DOUBLE)) OVER (PARTITION BY query_id) AS avgdl FROM cand),
tfs AS (SELECT d.*, a.token, a.times, CAST(len(list_filter(d.dt, lambda w: w = a.token)) AS DOUBLE) AS tf FROM docs d JOIN asked a USING (query_id)),
dfs AS (SELECT *, sum(CASE WHEN tf > 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) OVER (PARTITION BY query_id, token) AS df FROM tfs),
parts AS (SELECT query_id, id, CASE WHEN df > 0 THEN times * ln((n + CAST(1 AS DOUBLE)) / df) * (CAST(1 AS DOUBLE) + tf * CAST(2.5 AS DOUBLE) / (CAST(1.5 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * dl / CASE WHEN avgdl > 0 THEN avgdl ELSE CAST(1 AS DOUBLE) END) + tf)) ELSE CAST(0 AS DOUBLE) END AS part FROM dfs),
bm AS (SELECT c.query_id, c.id, coalesce(s.bm25, CAST(0 AS DOUBLE)) AS bm25 FROM cand c LEFT JOIN (SELECT query_id, id, sum(part) AS bm25 FROM parts GROUP BY 1, 2) s USING (query_id, id))"""

SCORES = KEYWORDS + f""", sig AS (SELECT c.*, bm.bm25, max(bm.bm25) OVER (PARTITION BY c.query_id) AS mx, count(*) OVER (PARTITION BY c.query_id) AS cn, {path_score('c.file_path')} AS path_score, {type_score('c.chunk_type')} AS type_score, {exact_id('qt')} AS eid FROM cand c JOIN bm USING (query_id, id)),
hyb AS (SELECT *, round(least(CAST(1 AS DOUBLE), greatest(CAST(0 AS DOUBLE), CAST(0.55 AS DOUBLE) * sim + CAST(0.25 AS DOUBLE) * (CASE WHEN cn = 1 THEN CAST(1 AS DOUBLE) ELSE bm25 / CASE WHEN mx > 0 THEN mx ELSE CAST(1 AS DOUBLE) END END) + CAST(0.1 AS DOUBLE) * path_score + CAST(0.07 AS DOUBLE) * (CASE WHEN cn = 1 THEN CAST(0 AS DOUBLE) ELSE eid END) + CAST(0.03 AS DOUBLE) * type_score)), 4) AS hybrid FROM sig),
ranked AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY hybrid DESC, pos0) AS INTEGER) AS position FROM hyb) WHERE position <= 10),
fin AS (SELECT *, round(least(CAST(1 AS DOUBLE), greatest(CAST(0 AS DOUBLE), CAST(0.55 AS DOUBLE) * hybrid + CAST(0.15 AS DOUBLE) * type_score + CAST(0.15 AS DOUBLE) * ({name_score('qt')}) + CAST(0.08 AS DOUBLE) * (CAST(appearances AS DOUBLE) / greatest(max(appearances) OVER (PARTITION BY query_id), 1)) + CAST(0.07 AS DOUBLE) * path_score)), 4) AS final_score FROM ranked),
fr AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, position) AS INTEGER) AS final_rank FROM fin),
tk AS (SELECT *, CASE WHEN path_score >= 0.5 THEN 0 ELSE 1 END AS tier, CAST(length(text) // 4 AS BIGINT) AS tokens FROM fr),
pl AS (SELECT *, CAST(row_number() OVER o AS INTEGER) AS place, CAST(sum(tokens) OVER (PARTITION BY query_id ORDER BY tier, final_score DESC, final_rank ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM tk WINDOW o AS (PARTITION BY query_id ORDER BY tier, final_score DESC, final_rank)),
packed AS (SELECT * FROM (SELECT *, max(used) OVER (PARTITION BY query_id) > 1200 AS truncated FROM pl) WHERE used <= 1200)"""

CANDIDATES, HYBRID, RETRIEVE = CAND + KEYWORDS, CAND + SCORES, RETRIEVED + SCORES

_NL = "(length({0}) - length(replace({0}, chr(10), '')))"
_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"

IMPORTS = MODULES + ", im AS (SELECT project_id, file_path AS source, unnest(imports) AS label FROM modules_n), nm AS (SELECT DISTINCT project_id, file_path AS target, module_name FROM modules_n WHERE module_name <> '')"
PREFIX = IMPORTS + ", best AS (SELECT i.project_id, i.label, min(n.target) AS target FROM (SELECT DISTINCT project_id, label FROM im WHERE label <> '') i JOIN nm n ON i.project_id = n.project_id AND (starts_with(n.module_name, i.label) OR starts_with(i.label, n.module_name)) GROUP BY 1, 2), pe AS (SELECT i.project_id, i.source, b.target, i.label FROM im i JOIN best b USING (project_id, label) WHERE i.source <> b.target)"
EDGES = (
    PREFIX
    + """, xe AS (SELECT i.project_id, i.source, n.target, i.label FROM im i JOIN (SELECT project_id, module_name AS label, min(target) AS target FROM nm GROUP BY 1, 2) n USING (project_id, label) WHERE i.source <> n.target),
e12 AS (SELECT * FROM xe UNION ALL SELECT pe.* FROM pe ANTI JOIN xe USING (project_id, source, label)),
rel AS (SELECT project_id, source, label, unnest(['.js', '.ts', '/index.js', '/index.ts']) AS e FROM im WHERE starts_with(label, '.')),
re3 AS (SELECT r.project_id, r.source, regexp_replace(concat_ws('/', nullif(regexp_replace(r.source, '/?[^/]*$', ''), ''), regexp_replace(regexp_replace(r.label, '^[.]/', ''), '[.](js|ts)$', '')), '[^/]+/[.][.]/', '', 'g') || e AS target, r.label FROM rel r),
edges AS (SELECT * FROM e12 UNION ALL SELECT re3.* FROM re3 SEMI JOIN (SELECT DISTINCT project_id, file_path AS target FROM modules_n) k USING (project_id, target) ANTI JOIN e12 USING (project_id, source, label) WHERE re3.source <> re3.target)"""
)


def _stem(path: str) -> str:
    return rf"regexp_extract({path}, '([^/]+?)(?:\.[^./]+)?$', 1)"


def _domain() -> str:
    low = "lower(trim(question))"
    return "[" + ", ".join(rf"CASE WHEN contains({low}, {_q(k)}) AND regexp_replace({low}, '\b{k}\b', {_q(s)}, 'g') <> {low} THEN regexp_replace({low}, '\b{k}\b', {_q(s)}, 'g') END" for k, ss in t.DOMAIN_TERMS.items() for s in ss) + "]"


ORACLES = {
    "tokenize_code": f"WITH {CHUNKS} SELECT chunk_id, token, count(*) AS n FROM (SELECT chunk_id, unnest({tokens('text')}) AS token FROM chunks_n) GROUP BY 1, 2",
    "identifiers": f"WITH {CHUNKS} SELECT chunk_id, array_to_string(list_sort({idents('text')}), ' ') AS identifiers FROM chunks_n",
    "path_score": f"WITH {CHUNKS} SELECT DISTINCT file_path, {path_score('file_path')} AS path_score FROM chunks_n",
    "chunk_type_score": f"WITH {CHUNKS} SELECT chunk_id, {type_score('chunk_type')} AS type_score FROM chunks_n",
    "exact_id_score": f"WITH {CHUNKS}, x AS (SELECT *, {tokens('file_path')} AS qt FROM chunks_n) SELECT chunk_id, round({exact_id('qt')}, 6) AS identifier_score FROM x",
    "name_score": f"WITH {CHUNKS}, x AS (SELECT *, {tokens('file_path')} AS qt FROM chunks_n) SELECT chunk_id, round({name_score('qt')}, 6) AS name_score FROM x",
    "keyword_extract": f"WITH {DOCS}, x AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z_][a-z0-9_]*') AS w FROM docs_n) SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(w, lambda v: v NOT IN {_in(t.KEYWORD_STOP_WORDS)} AND length(v) > 2))), ' ') AS keywords, array_to_string(list_slice(list_filter(w, lambda v: v NOT IN {_in(t.FALLBACK_STOP_WORDS)} AND length(v) > 2), 1, 5), ' ') AS fallback FROM x",
    "query_type": f"WITH {DOCS}, x AS (SELECT doc_id, lower(coalesce(text, '')) AS q FROM docs_n) SELECT doc_id, CASE WHEN {_any('q', t.EXPLAIN_KEYWORDS)} THEN 'explain' WHEN {_any('q', t.DESIGN_KEYWORDS)} THEN 'architecture' ELSE 'general' END AS question_type, {_any('q', t.ARCHITECTURE_KEYWORDS)} AS is_architecture, CASE {' '.join(f'WHEN {_any("q", w)} THEN {_q(n)}' for n, w in t.ROUTES)} ELSE 'general' END AS route FROM x",
    "vague_query": f"WITH {DOCS}, x AS (SELECT doc_id, lower(trim(coalesce(text, ''))) AS q FROM docs_n) SELECT doc_id, ({' OR '.join(f'regexp_matches(q, {_q(p)})' for p in t.VAGUE_STARTS)} OR (len(list_filter(string_split_regex(q, '\\s+'), lambda w: w <> '')) <= 4 AND {_any('q', t.VAGUE_WORDS)})) AS is_vague FROM x",
    "query_expand": rf"""WITH {CHUNKS}, qs AS (SELECT chunk_id AS query_id, 'Where is the ' || coalesce(chunk_type, 'code') || ' error service for ' || function_name || '() in ' || language AS question FROM chunks_n WHERE function_name <> ''),
x AS (SELECT query_id, trim(question) AS q, lower(trim(question)) AS low, list_slice(list_filter({_domain()}, lambda v: v IS NOT NULL), 1, 2) AS dom, trim(regexp_replace(lower(trim(question)), '^(where|what|how|which|who|when|why|is|are|does|do)\s+', '')) AS core FROM qs WHERE question IS NOT NULL),
y AS (SELECT query_id, q, low, list_concat(dom, [core || ' function implementation', core || ' code location file'], ['implement ' || regexp_replace(low, '^where\s+(is|are|does)\s+', '')]) AS v FROM x),
z AS (SELECT query_id, list_concat([q], list_slice(list_filter(v, lambda a, i: a <> '' AND a <> low AND list_position(v, a) = i), 1, 3)) AS vs FROM y)
SELECT query_id, CAST(i - 1 AS INTEGER) AS variant_no, vs[i] AS variant FROM (SELECT query_id, vs, unnest(range(1, len(vs) + 1)) AS i FROM z)""",
    "url_parse": r"""WITH x AS (SELECT DISTINCT project_id, regexp_replace(source_url, '^https://code\.example/', 'https://github.com/') AS source_url FROM projects),
y AS (SELECT *, regexp_replace(trim(source_url), '/+$', '') AS u FROM x), z AS (SELECT *, regexp_extract(u, '^(?i:(?:https?://)?(?:www\.)?github\.com/)([^/\s]+)/([^/\s]+)(?:/tree/([^/\s]+).*)?$', 1) AS o, regexp_replace(regexp_extract(u, '^(?i:(?:https?://)?(?:www\.)?github\.com/)([^/\s]+)/([^/\s]+)(?:/tree/([^/\s]+).*)?$', 2), '\.git$', '') AS r, regexp_extract(u, '^(?i:(?:https?://)?(?:www\.)?github\.com/)([^/\s]+)/([^/\s]+)(?:/tree/([^/\s]+).*)?$', 3) AS b FROM y),
w AS (SELECT *, regexp_full_match(o, '[A-Za-z0-9-]{1,39}') AND regexp_full_match(r, '[A-Za-z0-9._-]{1,100}') AS ok FROM z)
SELECT project_id, source_url, CASE WHEN ok THEN lower(o) END AS owner, CASE WHEN ok THEN r END AS repo, CASE WHEN ok THEN nullif(b, '') END AS branch FROM w""",
    "language_detect": f"WITH {FILES} SELECT project_id, file_path, {language('file_path')} AS language FROM files_n",
    "line_counts": f"WITH {FILES} SELECT project_id, file_path, CAST({_lines('content')} AS INTEGER) AS lines FROM files_n",
    "classify_error": f"SELECT DISTINCT project_id, error_msg, CASE WHEN error_msg IS NULL OR error_msg = '' THEN NULL {' '.join(f'WHEN {_any("lower(error_msg)", w)} THEN {_q(n)}' for n, w in t.ERRORS)} ELSE 'other' END AS error_class FROM projects",
    "architecture_hints": f"WITH {FILES}, x AS (SELECT project_id, list(lower(file_path)) AS p FROM files_n GROUP BY 1) SELECT project_id, array_to_string(list_filter([{', '.join(f'CASE WHEN len(list_filter(p, lambda f: {_any("f", w)})) > 0 THEN {_q(label)} END' for w, label in t.HINTS)}], lambda h: h IS NOT NULL), ', ') AS hints FROM x",
    "tag_normalise": "SELECT DISTINCT project_id, languages, array_to_string(list_filter(list_transform(string_split(languages, ','), lambda x: lower(trim(x))), lambda x: x <> ''), '|') AS tags FROM projects",
    "collection_names": "SELECT DISTINCT project_id, 'cm_' || substr(regexp_replace(project_id, '[^a-zA-Z0-9_-]', '_', 'g'), 1, 50) || '_code' AS code, 'cm_' || substr(regexp_replace(project_id, '[^a-zA-Z0-9_-]', '_', 'g'), 1, 40) || '_memory' AS memory FROM projects",
    "embedding_text": f"WITH {CHUNKS} SELECT chunk_id, sha256(concat_ws(' ', language, file_path, '[' || coalesce(nullif(function_name, ''), nullif(class_name, '')) || ']') || chr(10) || text) AS digest FROM chunks_n",
    "file_filters": f"WITH {FILES} SELECT project_id, file_path FROM files_n WHERE strlen(coalesce(content, '')) BETWEEN 1 AND 512000 AND length({_STRIP.format("coalesce(content, '')")}) >= 10 AND ({language('file_path')}) IS NOT NULL AND len(list_filter({_dirs('file_path')}, lambda d: lower(d) IN {_in(t.SKIP_DIRECTORIES)} OR starts_with(d, '.'))) = 0",
    "size_bucket": f"WITH {FILES}, x AS (SELECT project_id, CAST(sum(file_size_bytes) AS BIGINT) AS bytes, CAST(sum(file_size_bytes) AS DOUBLE) / 1024 AS k FROM files_n GROUP BY 1) SELECT project_id, bytes, CASE WHEN k < 10000 THEN 'small' WHEN k < 50000 THEN 'medium' WHEN k < 150000 THEN 'large' ELSE 'very_large' END AS size, CASE WHEN k < 10000 THEN 1 WHEN k < 50000 THEN 2 WHEN k < 150000 THEN 5 ELSE 10 END AS minutes, k > 50000 AS is_large, round(k / 1024, 1) AS megabytes FROM x",
    "large_repo_cap": f"WITH {FILES}, x AS (SELECT *, lower(file_path) AS low, lower(string_split(file_path, '/')[-1]) AS nm FROM files_n), y AS (SELECT *, CASE WHEN len(list_filter({_dirs('low')}, lambda d: d IN {_in(t.LARGE_REPO_SKIP)})) > 0 THEN 99 WHEN nm IN {_in(t.LARGE_REPO_ENTRY)} THEN 1 WHEN string_split(low, '/')[1] IN {_in(t.LARGE_REPO_CORE)} AND contains(low, '/') THEN 2 WHEN nm IN {_in(t.LARGE_REPO_BUILD)} THEN 3 WHEN coalesce(language, '') NOT IN ('markdown', 'rst', 'text') THEN 4 WHEN language IN ('markdown', 'rst') THEN 7 ELSE 5 END AS priority FROM x) SELECT project_id, file_path, priority, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY project_id ORDER BY priority, file_path) AS INTEGER) AS rank FROM y) WHERE rank <= 300",
    "chunk_sliding": rf"""WITH {FILES}, w AS (SELECT project_id, file_path, content, unnest(range(0, CAST((length(content) - 1) // 450 + 1 AS BIGINT))) AS i FROM files_n WHERE content <> ''),
x AS (SELECT *, substr(content, CAST(i * 450 + 1 AS BIGINT), 500) AS t FROM w), y AS (SELECT *, min(CASE WHEN regexp_full_match(t, '\s*') THEN i END) OVER (PARTITION BY project_id, file_path) AS stop FROM x), z AS (SELECT *, {_NL.format("substr(content, 1, CAST(i * 450 AS BIGINT))")} + 1 AS a FROM y WHERE stop IS NULL OR i < stop)
SELECT substr(sha256(project_id || ':' || file_path || ':' || CAST(i AS VARCHAR)), 1, 12) AS chunk_id, project_id, file_path, CAST(i AS INTEGER) AS chunk_index, sha256({_STRIP.format('t')}) AS digest, CAST(a AS INTEGER) AS start_line, CAST(a + {_NL.format('t')} AS INTEGER) AS end_line, CAST(length(t) AS INTEGER) AS char_count, CAST(greatest(1, length(t) // 4) AS INTEGER) AS token_count FROM z""",
    "chunk_markdown": rf"""WITH {FILES}, m AS (SELECT project_id, file_path, regexp_replace(content, '(?m)^(#{{1,6}}[ \t]+\S)', chr(1) || '\1', 'g') AS c FROM files_n WHERE language = 'markdown' AND content IS NOT NULL AND NOT regexp_full_match(content, '\s*')),
p AS (SELECT project_id, file_path, string_split(c, chr(1)) AS ps FROM m), q AS (SELECT project_id, file_path, CASE WHEN regexp_full_match(ps[1], '\s*') AND len(ps) > 1 THEN ps[2:] ELSE ps END AS ps, CASE WHEN regexp_full_match(ps[1], '\s*') AND len(ps) > 1 THEN {_NL.format('ps[1]')} ELSE 0 END AS skipped FROM p),
u AS (SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM q), v AS (SELECT *, ps[i] AS t FROM u)
SELECT substr(sha256(project_id || ':' || file_path || ':' || CAST(i - 1 AS VARCHAR)), 1, 12) AS chunk_id, file_path, CAST(i - 1 AS INTEGER) AS chunk_index, trim(regexp_extract(t, '^#{{1,6}}[ \t]+([^\n]*)', 1)) AS title, CAST({_NL.format("array_to_string(ps[1:i - 1], '')")} + skipped + 1 AS INTEGER) AS start_line, sha256({_STRIP.format('t')}) AS digest FROM v WHERE NOT regexp_full_match(t, '\s*')""",
    "chunks_by_language": f"WITH {CHUNKS} SELECT project_id, coalesce(language, '') AS language, count(*) AS chunks, count(DISTINCT file_path) AS files, CASE WHEN coalesce(language, '') = 'python' THEN 'AST (Python)' WHEN language IN ('javascript', 'typescript', 'java', 'go') THEN 'AST (braces)' WHEN language IN ('markdown', 'rst') THEN 'Markdown headings' WHEN language IN {_in(t.DEFINITION_STARTS)} THEN 'Function-aware' ELSE 'Sliding window' END AS strategy FROM chunks_n GROUP BY project_id, coalesce(language, ''), language",
    "chunk_inspect": f"WITH {CHUNKS} SELECT project_id, chunk_id, rank, substr(text, 1, 200) AS preview FROM (SELECT *, CAST(row_number() OVER (PARTITION BY project_id ORDER BY file_path, chunk_index, chunk_id) AS INTEGER) AS rank FROM chunks_n) WHERE rank <= 20",
    "registry_list": f"WITH {PROJECTS} SELECT project_id, project_name, status, CAST(row_number() OVER (PARTITION BY status ORDER BY updated_at DESC NULLS LAST, project_id) AS INTEGER) AS position FROM projects_n",
    "find_existing": f"WITH {PROJECTS}, p AS (SELECT *, regexp_replace(source_url, '/+$', '') AS u FROM projects_n WHERE coalesce(status, '') <> 'failed'), r AS (SELECT project_id AS request_id, regexp_replace(source_url, '/+$', '') AS u, project_name, source_type FROM projects_n), bu AS (SELECT u, project_id, row_number() OVER (PARTITION BY u ORDER BY created_at DESC NULLS LAST, project_id DESC) AS n FROM p WHERE u IS NOT NULL), bn AS (SELECT project_name, source_type, project_id, row_number() OVER (PARTITION BY project_name, source_type ORDER BY created_at DESC NULLS LAST, project_id DESC) AS n FROM p) SELECT r.request_id, coalesce(bu.project_id, bn.project_id) AS project_id FROM r LEFT JOIN bu ON bu.u = r.u AND bu.n = 1 LEFT JOIN bn ON bn.project_name = r.project_name AND bn.source_type = r.source_type AND bn.n = 1",
    "project_search": f"WITH {PROJECTS} SELECT project_id, project_name FROM projects_n WHERE contains(lower(project_name), 'a')",
    "files_by_language": f"WITH {FILES}, x AS (SELECT project_id, coalesce(language, '') AS language, file_path, row_number() OVER (PARTITION BY project_id, coalesce(language, '') ORDER BY file_path) AS r FROM files_n) SELECT project_id, language, count(*) AS files, string_agg(file_path, ', ' ORDER BY file_path) FILTER (r <= 10) AS first_files FROM x GROUP BY 1, 2",
    "upsert_latest": "SELECT chunk_id, project_id, model, CAST(coalesce(len(embedding), -1) AS INTEGER) AS size FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY embedded_at DESC NULLS LAST) AS rn FROM embedded_chunks) WHERE rn = 1",
    "embedding_cache_anti": f"WITH {CHUNKS} SELECT chunk_id, sha256('mini-a2::' || text) AS key FROM chunks_n WHERE text IS NOT NULL AND text NOT IN (SELECT code FROM source_chunks WHERE code IS NOT NULL)",
    "vector_topk": _topk(_ALL, 10),
    "vector_topk_filtered": _topk(_ALL + " WHERE label IN (1, 3, 5)", 10),
    "vector_threshold": _topk(_ALL, 10, "AND round(greatest(CAST(0 AS DOUBLE), c), 4) >= 0.2"),
    "memory_search": _topk(_ALL + " WHERE label % 3 = 1", 3, "AND round(greatest(CAST(0 AS DOUBLE), c), 4) >= 0.1"),
    "rrf_fuse": """WITH c AS (SELECT answer_id AS query_id, file_path AS id, CASE coalesce(chunk_type, 'block') WHEN 'function' THEN 0 WHEN 'method' THEN 1 WHEN 'class' THEN 2 WHEN 'heading' THEN 3 WHEN 'module' THEN 4 ELSE 5 END AS v, max(coalesce(relevance_score, 0)) AS s FROM source_chunks WHERE answer_id IS NOT NULL AND file_path IS NOT NULL GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, v ORDER BY s DESC, id) AS rk FROM c), l AS (SELECT query_id, count(DISTINCT v) AS lists FROM c GROUP BY 1),
g AS (SELECT query_id, id, sum(CAST(1 AS DOUBLE) / (rk + CAST(60 AS DOUBLE))) AS rrf, count(*) AS appearances, max(s) AS best_similarity, max_by(s, v) AS similarity, min(v * 1000000 + rk) AS f FROM r GROUP BY 1, 2),
h AS (SELECT g.*, CASE WHEN lists = 1 THEN similarity ELSE round(rrf, 6) END AS rrf_score, CASE WHEN lists = 1 THEN similarity ELSE round(rrf, 12) END AS o FROM g JOIN l USING (query_id))
SELECT query_id, id, rrf_score, appearances, best_similarity, similarity, position FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY o DESC, f, id) AS INTEGER) AS position FROM h) WHERE position <= 10""",
    "bm25_plus": f"WITH {CANDIDATES} SELECT query_id, id, round(bm25, 4) AS bm25 FROM bm",
    "hybrid_score": f"WITH {HYBRID} SELECT query_id, id, hybrid, position FROM ranked",
    "rerank": f"WITH {HYBRID} SELECT query_id, id, final_score, final_rank FROM fr WHERE final_rank <= 5",
    "context_budget": f"WITH {HYBRID} SELECT query_id, id, tier, place, used, truncated FROM packed",
    "context_text": f"""WITH {HYBRID}, b AS (SELECT *, 'File: ' || file_path || ' | Language: ' || coalesce(language, '') || ' | Lines: ' || coalesce(CAST(start_line AS VARCHAR), '0') || '-' || coalesce(CAST(end_line AS VARCHAR), '0') || chr(10) || 'Type: ' || coalesce(chunk_type, 'block') || ' ' || coalesce(nullif(function_name, ''), nullif(class_name, ''), '') || ' | Relevance: ' || printf('%.1f', round(round(final_score * 100, 2), 1)) || '%' || chr(10) || text AS block FROM packed),
f AS (SELECT query_id, file_path, min(place) AS p FROM packed GROUP BY 1, 2), ff AS (SELECT query_id, string_agg(file_path, '|' ORDER BY p) AS files FROM f GROUP BY 1)
SELECT query_id, sha256(string_agg(block, chr(10) || repeat('─', 60) || chr(10) ORDER BY place)) AS digest, CAST(count(*) AS INTEGER) AS chunks, CAST(sum(1 - tier) AS INTEGER) AS implementation_chunks, CAST(sum(tier) AS INTEGER) AS documentation_chunks, CAST(sum(tokens) AS BIGINT) AS tokens, any_value(ff.files) AS files FROM b JOIN ff USING (query_id) GROUP BY 1""",
    "retrieve_e2e": f"WITH {RETRIEVE} SELECT query_id, id, final_score, final_rank FROM fr WHERE final_rank <= 5",
    "source_grouping": """WITH c AS (SELECT DISTINCT * FROM source_chunks), r AS (SELECT *, coalesce(relevance_score, 0) AS rs, row_number() OVER (PARTITION BY answer_id, file_path ORDER BY coalesce(relevance_score, 0) DESC, card_rank, code DESC NULLS LAST) AS n FROM c),
l AS (SELECT DISTINCT answer_id, file_path, start_line, end_line FROM c), ll AS (SELECT answer_id, file_path, string_agg(coalesce(CAST(start_line AS VARCHAR), '?') || '-' || coalesce(CAST(end_line AS VARCHAR), '?'), ',' ORDER BY start_line NULLS FIRST, end_line NULLS FIRST) AS ranges FROM l GROUP BY 1, 2),
g AS (SELECT answer_id, file_path, count(*) AS cards FROM c GROUP BY 1, 2)
SELECT r.answer_id, r.file_path, rs AS relevance_score, g.cards, ll.ranges, sha256(coalesce(r.code, '')) AS digest FROM r JOIN g ON r.answer_id IS NOT DISTINCT FROM g.answer_id AND r.file_path IS NOT DISTINCT FROM g.file_path JOIN ll ON r.answer_id IS NOT DISTINCT FROM ll.answer_id AND r.file_path IS NOT DISTINCT FROM ll.file_path WHERE n = 1""",
    "history_last_n": f"WITH {MESSAGES}, x AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS r FROM messages WHERE role <> 'system') SELECT session_id, seq, role, CAST(row_number() OVER (PARTITION BY session_id ORDER BY seq) AS INTEGER) AS place FROM x WHERE r <= 10",
    "history_text": f"WITH {MESSAGES}, x AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS r FROM messages WHERE role <> 'system') SELECT session_id, sha256(string_agg(CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || CASE WHEN length(content) > 300 THEN substr(content, 1, 300) || '...' ELSE content END, chr(10) ORDER BY seq)) AS digest FROM x WHERE r <= 10 GROUP BY 1",
    "session_expiry": f"WITH {MESSAGES} SELECT session_id, max(ts) AS last_active, count(*) AS messages, date_sub('second', max(ts), TIMESTAMP '2025-06-30 00:00:00') > 3600 AS is_expired FROM messages GROUP BY 1",
    "enrich_query": f"WITH {MESSAGES}, x AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS r FROM messages WHERE role IN ('user', 'assistant')) SELECT session_id AS query_id, sha256('Explain that in detail context: ' || string_agg(CASE WHEN role = 'user' THEN substr(content, 1, 80) ELSE substr(string_split(content, '.')[1], 1, 120) END, ' ' ORDER BY seq)) AS digest FROM x WHERE r <= 2 GROUP BY 1",
    "memory_list": f"WITH {DOCS} SELECT doc_id AS id, project_id, CAST(row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC NULLS LAST, doc_id) AS INTEGER) AS position FROM docs_n WHERE doc_kind = 'note'",
    "chat_export": f"WITH {MESSAGES} SELECT session_id, sha256('# Conversation' || chr(10) || chr(10) || string_agg('## ' || CASE role WHEN 'user' THEN 'User' ELSE 'Assistant' END || chr(10) || chr(10) || content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY seq)) AS digest FROM messages WHERE role IN ('user', 'assistant') GROUP BY 1",
    "import_exact_resolve": f"WITH {IMPORTS} SELECT i.project_id, i.source, n.target, i.label FROM im i JOIN (SELECT project_id, string_split(module_name, '.')[-1] AS label, min(target) AS target FROM nm GROUP BY 1, 2) n USING (project_id, label) WHERE i.source <> n.target",
    "import_prefix_resolve": f"WITH {PREFIX} SELECT project_id, source, target, label FROM pe",
    "import_dotted_resolve": f"WITH {IMPORTS}, best AS (SELECT i.project_id, i.label, min(n.target) AS target FROM (SELECT DISTINCT project_id, label FROM im WHERE label <> '') i JOIN nm n ON i.project_id = n.project_id AND (starts_with(n.module_name || '.', i.label || '.') OR starts_with(i.label || '.', n.module_name || '.')) GROUP BY 1, 2) SELECT i.project_id, i.source, b.target, i.label FROM im i JOIN best b USING (project_id, label) WHERE i.source <> b.target",
    "in_degree_topk": f"WITH {EDGES} SELECT project_id, target, imports, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY project_id ORDER BY imports DESC, target) AS INTEGER) AS rank FROM (SELECT project_id, target, count(*) AS imports FROM edges GROUP BY 1, 2)) WHERE rank <= 5",
    "most_complex": f"WITH {MODULES} SELECT project_id, file_path, complexity, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY project_id ORDER BY complexity DESC, file_path) AS INTEGER) AS rank FROM (SELECT project_id, file_path, CAST(len(classes) + len(functions) AS INTEGER) AS complexity FROM modules_n)) WHERE rank <= 5",
    "component_groups": f"WITH {MODULES} SELECT project_id, string_split(file_path, '/')[-2] AS component, count(*) AS files, CAST(sum(size_lines) AS BIGINT) AS lines FROM modules_n WHERE contains(file_path, '/') GROUP BY 1, 2 HAVING count(*) >= 2",
    "two_hop_flow": f"WITH {EDGES}, e AS (SELECT DISTINCT project_id, source, target FROM edges), st AS (SELECT DISTINCT project_id, file_path AS source FROM modules_n WHERE is_entry_point OR len(entry_points) > 0), n AS (SELECT *, row_number() OVER (PARTITION BY project_id, source ORDER BY target) AS r FROM e) SELECT a.project_id, a.source AS start, a.target AS first, b.target AS second FROM n a SEMI JOIN st USING (project_id, source) LEFT JOIN n b ON a.project_id = b.project_id AND a.target = b.source AND b.r <= 3 WHERE a.r <= 4",
    "inheritance_pairs": f"WITH {MODULES} SELECT DISTINCT project_id, file_path, class_name, unnest(inherits_from[1:3]) AS base_name FROM (SELECT project_id, file_path, inherits_from, unnest(classes[1:3]) AS class_name FROM modules_n WHERE len(inherits_from) > 0 AND len(classes) > 0)",
    "inheritance_resolve": f"WITH {MODULES}, o AS (SELECT project_id, label, min(file_path) AS target FROM (SELECT project_id, file_path, unnest(classes) AS label FROM modules_n) GROUP BY 1, 2) SELECT DISTINCT b.project_id, b.source, o.target, 'inheritance' AS edge_type, b.label FROM (SELECT project_id, file_path AS source, unnest(inherits_from) AS label FROM modules_n) b JOIN o USING (project_id, label)",
    "graph_statistics": f"WITH {EDGES} SELECT project_id, 'modules' AS metric, '' AS key, count(*) AS value FROM modules_n GROUP BY 1 UNION ALL SELECT project_id, 'classes', '', CAST(sum(len(classes)) AS BIGINT) FROM modules_n GROUP BY 1 UNION ALL SELECT project_id, 'functions', '', CAST(sum(len(functions)) AS BIGINT) FROM modules_n GROUP BY 1 UNION ALL SELECT project_id, 'entry_points', '', count(*) FILTER (coalesce(is_entry_point, false) OR len(entry_points) > 0) FROM modules_n GROUP BY 1 UNION ALL SELECT project_id, 'language', coalesce(language, ''), count(*) FROM modules_n GROUP BY 1, 3 UNION ALL SELECT project_id, 'edges', '', count(*) FROM edges GROUP BY 1",
    "graph_json": f"WITH {MODULES} SELECT project_id, file_path, CAST(coalesce(len(imports), 0) AS INTEGER) AS imports, module_name FROM modules_n",
    "script_extract": rf"""WITH {FILES}, x AS (SELECT *, replace(file_path, chr(92), '/') AS p0 FROM files_n WHERE language IN ('javascript', 'typescript') AND content IS NOT NULL), p1 AS (SELECT *, CASE WHEN starts_with(p0, 'src/') THEN substr(p0, 5) ELSE p0 END AS a FROM x), p2 AS (SELECT *, CASE WHEN starts_with(a, 'app/') THEN substr(a, 5) ELSE a END AS b FROM p1), p3 AS (SELECT *, CASE WHEN starts_with(b, 'lib/') THEN substr(b, 5) ELSE b END AS c FROM p2)
SELECT project_id, file_path, regexp_replace(regexp_replace(c, '\.js$', ''), '\.ts$', '') AS module_name, array_to_string(list_concat(regexp_extract_all(content, 'import\s+(?:[^''"\n;]*?\s+from\s+)?[''"]([^''"]+)[''"]', 1), regexp_extract_all(content, 'require\s*\(\s*[''"]([^''"]+)[''"]\s*\)', 1)), '|') AS imports,
array_to_string(list_concat(regexp_extract_all(content, 'export\s+(?:default\s+)?(?:async\s+)?function\s+(\w+)', 1), regexp_extract_all(content, 'export\s+(?:default\s+)?class\s+(\w+)', 1), regexp_extract_all(content, 'export\s+(?:const|let|var)\s+(\w+)', 1)), '|') AS exports,
array_to_string(regexp_extract_all(content, '\bclass\s+(\w+)', 1), '|') AS classes, array_to_string(regexp_extract_all(content, '\bclass\s+\w+\s+extends\s+([\w.]+)', 1), '|') AS inherits_from FROM p3""",
    "script_entries": rf"""WITH {FILES}, x AS (SELECT * FROM files_n WHERE language IN ('javascript', 'typescript') AND content IS NOT NULL)
SELECT project_id, file_path, array_to_string(list_transform(list_zip(regexp_extract_all(content, '\b(?:function\s+(\w+)|const\s+(\w+)\s*=\s*(?:async\s*)?\()', 1), regexp_extract_all(content, '\b(?:function\s+(\w+)|const\s+(\w+)\s*=\s*(?:async\s*)?\()', 2)), lambda z: coalesce(z[1], '') || coalesce(z[2], '')), '|') AS functions,
array_to_string(list_transform(list_zip(regexp_extract_all(content, '(?:app|router)\.(get|post|put|delete|patch|use)\s*\(\s*[''"]([^''"]+)[''"]', 1), regexp_extract_all(content, '(?:app|router)\.(get|post|put|delete|patch|use)\s*\(\s*[''"]([^''"]+)[''"]', 2)), lambda z: upper(z[1]) || ' ' || z[2]), '|') AS entry_points,
regexp_matches(content, '\.listen\s*\(|express\s*\(|createServer\s*\(|Fastify\s*\(|Koa\s*\(') OR regexp_extract(file_path, '[^/\\]*$') IN ('index.js', 'index.ts', 'main.js', 'main.ts', 'server.js', 'server.ts', 'app.js', 'app.ts') AS is_entry_point FROM x""",
    "generic_extract": rf"""WITH {FILES}, x AS (SELECT *, coalesce(language, '') AS l FROM files_n WHERE content IS NOT NULL AND coalesce(language, '') NOT IN ('python', 'javascript', 'typescript'))
SELECT project_id, file_path, regexp_extract(file_path, '([^/]+?)(?:\.[^./]+)?$', 1) AS module_name,
array_to_string(CASE l WHEN 'java' THEN regexp_extract_all(content, '(?m)^import\s+(?:static\s+)?([\w.]+)', 1) WHEN 'go' THEN regexp_extract_all(content, '"([\w./-]+)"', 1) WHEN 'rust' THEN regexp_extract_all(content, '(?m)^use\s+([\w:]+)', 1) ELSE CAST([] AS VARCHAR[]) END, '|') AS imports,
array_to_string(CASE l WHEN 'java' THEN regexp_extract_all(content, '\b(?:class|interface|enum)\s+(\w+)', 1) WHEN 'go' THEN regexp_extract_all(content, '(?m)^type\s+(\w+)\s+(?:struct|interface)', 1) WHEN 'rust' THEN regexp_extract_all(content, '\b(?:struct|enum|trait)\s+(\w+)', 1) ELSE CAST([] AS VARCHAR[]) END, '|') AS classes,
array_to_string(CASE l WHEN 'java' THEN regexp_extract_all(content, '\b(?:public|private|protected)\s+(?:static\s+)?[\w<>\[\]]+\s+(\w+)\s*\(', 1) WHEN 'go' THEN regexp_extract_all(content, '(?m)^func\s+(?:\([^)]*\)\s*)?(\w+)', 1) WHEN 'rust' THEN regexp_extract_all(content, '\bfn\s+(\w+)', 1) ELSE CAST([] AS VARCHAR[]) END, '|') AS functions FROM x""",
    "progress_changes": "WITH e AS (SELECT user_id AS key, event_id, event_type AS step, CAST(floor(value) AS BIGINT) AS percent, ts FROM events), x AS (SELECT *, lag(step) OVER w AS s, lag(percent) OVER w AS p, row_number() OVER w AS n FROM e WINDOW w AS (PARTITION BY key ORDER BY ts, event_id)) SELECT key, event_id, step, percent FROM x WHERE n = 1 OR s IS DISTINCT FROM step OR p IS DISTINCT FROM percent",
    "embed_hash": f"WITH {CHUNKS} SELECT chunk_id, CAST(384 AS INTEGER) AS size FROM chunks_n",
    "import_last_part": f"WITH {IMPORTS} SELECT i.project_id, i.source, n.target, i.label FROM im i JOIN (SELECT project_id, string_split(file_path, '/')[-2] AS label, min(file_path) AS target FROM modules_n GROUP BY 1, 2) n USING (project_id, label) WHERE i.source <> n.target",
    "inheritance_edges": f"WITH {MODULES}, o AS (SELECT project_id, label, min(file_path) AS target FROM (SELECT project_id, file_path, unnest(classes) AS label FROM modules_n) GROUP BY 1, 2) SELECT DISTINCT b.project_id, b.source, o.target, 'inheritance' AS edge_type, b.label FROM (SELECT project_id, file_path AS source, regexp_replace(unnest(inherits_from), 'Base$', '') AS label FROM modules_n) b JOIN o USING (project_id, label)",
    "entry_answers": f"""WITH {EDGES}, st AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY file_path) AS p FROM modules_n WHERE coalesce(is_entry_point, false) OR len(entry_points) > 0),
i AS (SELECT project_id, source AS file_path, string_agg(stem, '|' ORDER BY target) AS imports FROM (SELECT *, {_stem('target')} AS stem, row_number() OVER (PARTITION BY project_id, source ORDER BY target) AS r FROM (SELECT DISTINCT project_id, source, target FROM edges)) WHERE r <= 4 GROUP BY 1, 2)
SELECT project_id, CAST(p AS INTEGER) AS position, file_path, array_to_string(entry_points[1:4], '|') AS details, array_to_string(classes[1:4], '|') AS classes, coalesce(i.imports, '') AS imports FROM st LEFT JOIN i USING (project_id, file_path) WHERE p <= 8""",
    "dependency_answers": f"""WITH {EDGES}, e AS (SELECT DISTINCT project_id, source, target FROM edges), names AS (SELECT DISTINCT project_id, {_stem('target')} AS name FROM e),
f AS (SELECT n.project_id, n.name, min(m.file_path) AS file_path FROM names n JOIN modules_n m ON m.project_id = n.project_id AND lower({_stem('m.file_path')}) = lower(n.name) GROUP BY 1, 2),
o AS (SELECT project_id, source AS file_path, string_agg(target, '|' ORDER BY target) AS a FROM (SELECT *, row_number() OVER (PARTITION BY project_id, source ORDER BY target) AS r FROM e) WHERE r <= 8 GROUP BY 1, 2),
t AS (SELECT project_id, target AS file_path, string_agg(source, '|' ORDER BY source) AS b FROM (SELECT *, row_number() OVER (PARTITION BY project_id, target ORDER BY source) AS r FROM e) WHERE r <= 8 GROUP BY 1, 2)
SELECT f.project_id, f.name, f.file_path, coalesce(o.a, '') AS imports_from, coalesce(t.b, '') AS imported_by, array_to_string(m.inherits_from, '|') AS inherits_from FROM f LEFT JOIN o USING (project_id, file_path) LEFT JOIN t USING (project_id, file_path) JOIN modules_n m USING (project_id, file_path)""",
    "architecture_overview": f"""WITH {EDGES}, m AS (SELECT project_id, count(*) AS modules, CAST(sum(len(classes)) AS BIGINT) AS classes, CAST(sum(len(functions)) AS BIGINT) AS functions FROM modules_n GROUP BY 1),
l AS (SELECT project_id, string_agg(CAST(n AS VARCHAR) || ' ' || lang, '|' ORDER BY n DESC, lang) AS languages FROM (SELECT project_id, coalesce(language, '') AS lang, count(*) AS n FROM modules_n GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT project_id, string_agg(file_path, '|' ORDER BY file_path) AS entry_points FROM (SELECT project_id, file_path, row_number() OVER (PARTITION BY project_id ORDER BY file_path) AS r FROM modules_n WHERE coalesce(is_entry_point, false) OR len(entry_points) > 0) WHERE r <= 4 GROUP BY 1),
c AS (SELECT project_id, string_agg(target || ' ' || CAST(n AS VARCHAR), '|' ORDER BY r) AS core_modules FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY n DESC, target) AS r FROM (SELECT project_id, target, count(*) AS n FROM edges GROUP BY 1, 2)) WHERE r <= 4 GROUP BY 1), d AS (SELECT project_id, count(*) AS dependencies FROM edges GROUP BY 1)
SELECT project_id, modules, classes, functions, coalesce(dependencies, 0) AS dependencies, languages, coalesce(entry_points, '') AS entry_points, coalesce(core_modules, '') AS core_modules FROM m LEFT JOIN l USING (project_id) LEFT JOIN s USING (project_id) LEFT JOIN c USING (project_id) LEFT JOIN d USING (project_id)""",
    "architecture_gate": f"WITH {DOCS}, {MODULES} SELECT doc_id, project_id, CASE {' '.join(f'WHEN {_any("lower(text)", w)} THEN {_q(n)}' for n, w in t.ROUTES)} ELSE 'general' END AS route FROM docs_n WHERE text IS NOT NULL AND {_any('lower(text)', t.ARCHITECTURE_KEYWORDS)} AND project_id IN (SELECT project_id FROM modules_n)",
    "source_table": f"WITH {FILES} SELECT project_id, file_path, {language('file_path')} AS language, strlen(content) AS file_size_bytes, CAST({_lines('content')} AS INTEGER) AS line_count, 'utf-8' AS encoding, sha256(content) AS digest FROM files_n WHERE content IS NOT NULL AND strlen(content) BETWEEN 1 AND 512000 AND length({_STRIP.format('content')}) >= 10 AND ({language('file_path')}) IS NOT NULL AND len(list_filter({_dirs('file_path')}, lambda d: lower(d) IN {_in(t.SKIP_DIRECTORIES)} OR starts_with(d, '.'))) = 0",
    "ignore_rules": rf"WITH {FILES} SELECT project_id, file_path FROM files_n WHERE regexp_extract(file_path, '[^/]*$') = 'keep.md' OR NOT (ends_with(file_path, '.md') OR regexp_matches(file_path, '\.md/') OR list_contains(list_slice(string_split(file_path, '/'), 1, len(string_split(file_path, '/')) - 1), 'tests') OR starts_with(file_path, 'app/') OR regexp_matches(file_path, '^internal/[^/]+/fixture(/|$)'))",
    "archive_members": f"WITH {FILES} SELECT project_id, file_path, strlen(content) AS length, sha256(content) AS digest FROM files_n WHERE content IS NOT NULL",
    "stream_progress": "SELECT step, count(*) AS states FROM (SELECT DISTINCT user_id, event_type AS step, floor(value) AS p FROM events) GROUP BY 1",
    "stream_sessions": """WITH e AS (SELECT user_id AS key, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM e)
SELECT key, min(ts) AS start, max(ts) + INTERVAL 1 HOUR AS end, count(*) AS events FROM s GROUP BY key, n HAVING max(ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""",
}
