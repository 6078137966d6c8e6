"""The registered queries as SQL over the given tables."""

import sys

from archgraph.functions.stopwords import ENGLISH
from archgraph.plans.ask import NO_RELATIONSHIPS, RULES
from checks.derived import DERIVED, with_derived


# Fixed values, stated here a second time so that a wrong one in the engine shows as a difference.
API_DECORATOR = r"(?i)\.(route|get|post|put|delete|patch|websocket)\s*\(|@api_view|@action\b"
DATABASE_PACKAGES = (
    "sqlalchemy", "django", "psycopg2", "pymongo", "redis", "sqlite3", "peewee", "tortoise", "asyncpg", "pymysql",
    "sqlmodel", "mongoengine", "sqlalchemy_utils",
)
SERVICE_SUFFIXES = ("Service", "Repository", "Controller", "Manager", "Client", "Gateway", "Handler")
SMELL_TYPES = ("circular_dependency", "god_class", "large_function", "dead_code_candidate")
STAGES = ("cloning", "cloned", "parsing", "building_graph", "embedding", "ready")
REPOSITORY_URL = r"^https://github\.com/([A-Za-z0-9](?:[A-Za-z0-9-]{0,38}))/([A-Za-z0-9_.-]{1,100}?)(?:\.git)?/?$"
IGNORED_DIRS = (
    ".git", "node_modules", "venv", ".venv", "__pycache__", "dist", "build",
    ".next", ".nuxt", "target", ".idea", ".vscode", "vendor", "site-packages",
    ".mypy_cache", ".pytest_cache", ".ruff_cache", "coverage", ".tox", "egg-info",
)
SUFFIX_LANGUAGE = {
    ".py": "python",
    ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript",
    ".ts": "typescript", ".tsx": "typescript",
    ".java": "java",
    ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".h": "cpp",
}


def _list(values):
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _ranked(source, partition, order, k, columns="*", rank="rank"):
    """Rows of rank 1..k per partition."""
    return (f"SELECT {columns} FROM (SELECT *, CAST(row_number() OVER (PARTITION BY {partition} ORDER BY {order}) "
            f"AS INTEGER) AS {rank} FROM {source}) ranked WHERE {rank} <= {k}")


_LANGUAGE = "CASE lower(regexp_extract(reverse(split_part(reverse(path), '/', 1)), '^.+(\\.[^.]+)$', 1)) " + " ".join(
    f"WHEN '{s}' THEN '{lang}'" for s, lang in SUFFIX_LANGUAGE.items()) + " END"
_NOT_TEST = "NOT contains(lower({}), 'test')"
_TOKENS = "unnest(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]{{2,}}'))"
_SEVERITY = "CASE WHEN {0} >= {3} THEN 'HIGH' WHEN {0} >= {2} THEN 'MEDIUM' WHEN {0} >= {1} THEN 'LOW' END"
_FINDING = "repo_id, smell_type, severity, subject, metric, title, evidence"
_REPORT_ORDER = ("CASE severity WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END, CASE smell_type "
                 + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(SMELL_TYPES))
                 + " END, metric DESC, qualified_name, subject")


def _tfidf(prefix, docs, questions):
    """Index and scores over docs (repo_id, doc_id, text), questions (query_id, repo_id, question)."""
    return {
        f"{prefix}_counts": f"""
SELECT repo_id, doc_id, term, count(*) AS tf FROM (SELECT repo_id, doc_id, {_TOKENS.format('text')} AS term FROM {docs}) t
WHERE term NOT IN ({_list(ENGLISH)}) GROUP BY ALL""",
        f"{prefix}_vocabulary": f"""
SELECT v.repo_id, term, df, total, ln((1 + n) / (1 + df)) + 1 AS idf
FROM (SELECT repo_id, term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total FROM {prefix}_counts GROUP BY ALL) v
JOIN (SELECT repo_id, count(*) AS n FROM {docs} GROUP BY ALL) s ON s.repo_id = v.repo_id""",
        f"{prefix}_weights": f"""
SELECT repo_id, doc_id, term, raw / sqrt(CAST(sum(CAST(raw * raw AS DECIMAL(28, 9))) OVER (PARTITION BY repo_id, doc_id) AS DOUBLE)) AS weight
FROM (SELECT c.repo_id, c.doc_id, c.term, tf * idf AS raw FROM {prefix}_counts c
      JOIN {prefix}_vocabulary v ON v.repo_id = c.repo_id AND v.term = c.term) r""",
        f"{prefix}_asked": f"""
SELECT query_id, repo_id, term, raw / sqrt(CAST(sum(CAST(raw * raw AS DECIMAL(28, 9))) OVER (PARTITION BY query_id, repo_id) AS DOUBLE)) AS weight
FROM (SELECT c.query_id, c.repo_id, c.term, tf * idf AS raw
      FROM (SELECT query_id, repo_id, term, count(*) AS tf
            FROM (SELECT query_id, repo_id, {_TOKENS.format('question')} AS term FROM {questions}) t GROUP BY ALL) c
      JOIN {prefix}_vocabulary v ON v.repo_id = c.repo_id AND v.term = c.term) r""",
        f"{prefix}_scored": f"""
SELECT query_id, w.repo_id, doc_id, CAST(sum(CAST(floor(w.weight * a.weight * 1e15::DOUBLE) AS BIGINT)) AS DOUBLE) / 1e15::DOUBLE AS score
FROM {prefix}_weights w JOIN {prefix}_asked a ON a.repo_id = w.repo_id AND a.term = w.term GROUP BY ALL""",
    }


_SENTENCES = """concat_ws(' ',
  CASE WHEN total = 0 THEN format('No symbol of the repository depends on {}.', target_qualified_name)
       WHEN total > 25 THEN format('{} carries much of the repository: {} dependents, {} direct and {} indirect.',
                                   target_qualified_name, total, direct_count, indirect_count)
       WHEN total > 10 THEN format('{} has {} dependents, {} direct and {} indirect, in more than one place.',
                                   target_qualified_name, total, direct_count, indirect_count)
       ELSE format('{} has few dependents: {}, of which {} direct and {} indirect.',
                   target_qualified_name, total, direct_count, indirect_count) END,
  CASE WHEN affected_apis > 0 THEN format('API endpoints among them: {}; callers outside would notice a fault.', affected_apis)
       WHEN affected_services > 0 THEN format('Service components among them: {}; no endpoint is reached directly.', affected_services)
       WHEN total > 0 THEN 'Neither endpoints nor service components are among them.' END,
  CASE WHEN total > 0 AND affected_tests = 0 THEN 'No test is among them, so a fault may pass unseen.'
       WHEN total > 0 AND affected_tests >= total THEN format('Tests among them: {}, which covers all.', affected_tests)
       WHEN affected_tests > 0 THEN format('Tests among them: {} of {}, which covers a part.', affected_tests, total) END,
  CASE WHEN external_names <> '' THEN format('The file itself uses outside packages ({}).', replace(external_names, ',', ', ')) END,
  CASE WHEN degree >= 15 AND total <= 10 THEN format('Its {} edges make it central beyond that count.', degree) END,
  format('Overall risk: {}.', risk_level))"""

CTES = DERIVED | {
    "og_profile": f"""
SELECT repo_id, CAST(sum(n) AS BIGINT) AS file_count, CAST(sum(bytes) AS BIGINT) AS total_size_bytes,
       coalesce(string_agg(concat(language, '=', n), ',' ORDER BY language) FILTER (WHERE language IS NOT NULL), '') AS languages
FROM (SELECT repo_id, {_LANGUAGE} AS language, count(*) AS n, sum(size_bytes) AS bytes FROM fx_repo_files
      WHERE NOT list_has_any(string_split(path, '/'), [{_list(IGNORED_DIRS)}]) GROUP BY ALL) p
GROUP BY repo_id""",
    "og_limits": """
SELECT repo_id, file_count, total_size_bytes,
       CASE WHEN file_count > 500 THEN 'more than 500 files'
            WHEN total_size_bytes > 75 * 1024 * 1024 THEN 'more than 75 MB' END AS reject_reason
FROM og_profile""",
    "og_urls": f"""
SELECT id, CASE WHEN url_error IS NULL THEN owner END AS owner, CASE WHEN url_error IS NULL THEN repo END AS repo,
       CASE WHEN url_error IS NULL THEN concat('https://github.com/', owner, '/', repo, '.git') END AS clone_url, url_error
FROM (SELECT *, CASE WHEN owner = '' THEN 'not a https://github.com/<owner>/<repo> address'
                     WHEN repo IN ('.', '..') THEN 'not a repository name' END AS url_error
      FROM (SELECT id, regexp_extract(trim(url), '{REPOSITORY_URL}', 1) AS owner,
                   regexp_extract(trim(url), '{REPOSITORY_URL}', 2) AS repo FROM fx_repo_urls) a) b""",
    "og_latest": """
SELECT repo_id, status, error, created_at, updated_at
FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY ts DESC, seq DESC) AS place,
             min(ts) OVER (PARTITION BY repo_id) AS created_at, max(ts) OVER (PARTITION BY repo_id) AS updated_at
      FROM fx_status_log) s
WHERE place = 1""",
    # Files that are extracted: kind 0 does not parse, 1 is whole, 2 has two broken statements.
    "og_sources": """
SELECT repo_id, k, docstring, CASE sz WHEN 13 THEN 0 WHEN 23 THEN 2 ELSE 1 END AS kind,
       concat(split_part(path, '/', 1), '/', split_part(path, '/', 2), '/m', k, '.py') AS path,
       concat(split_part(path, '/', 1), '.', split_part(path, '/', 2), '.m', k) AS module
FROM fx_members WHERE sz <> 33""",
    "og_symbols": "SELECT *, concat(repo_id, ':', id) AS uid FROM fx_symbols",
    "og_exact": _ranked("fx_symbols", "repo_id, qualified_name", "file_path DESC, seq DESC", 1),
    "og_names": """
SELECT repo_id, name, count(*) AS n, min(id) AS id FROM fx_symbols
WHERE symbol_type IN ('class', 'function', 'method') GROUP BY ALL""",
    "og_resolved": """
SELECT r.repo_id, r.source_id,
       CASE WHEN r.target_id IS NOT NULL THEN r.target_id WHEN e.id IS NOT NULL THEN e.id WHEN n.n = 1 THEN n.id END AS target_id,
       r.target_name, r.relationship_type, r.source_file, r.source_line,
       CASE WHEN r.target_id IS NOT NULL THEN r.confidence WHEN e.id IS NOT NULL THEN 0.95 WHEN n.n = 1 THEN 0.75
            WHEN n.n > 1 THEN 0.3 ELSE least(r.confidence, 0.35) END::DOUBLE AS confidence, r.seq
FROM fx_relationships r
LEFT JOIN og_exact e ON e.repo_id = r.repo_id AND e.qualified_name = r.target_name
LEFT JOIN og_names n ON n.repo_id = r.repo_id
     AND n.name = CASE WHEN contains(r.target_name, '.') THEN reverse(split_part(reverse(r.target_name), '.', 1)) ELSE r.target_name END""",
    "og_nodes": _ranked("og_symbols", "uid", "file_path DESC, seq DESC", 1),
    "og_keyed": f"""
SELECT repo_id, concat(repo_id, ':', source_id) AS src, concat(repo_id, ':', target_id) AS dst,
       upper(relationship_type) AS relationship_type, source_file, source_line, confidence
FROM ({_ranked("og_resolved", "repo_id, source_id, target_id, relationship_type, source_line",
               "source_file DESC, seq DESC, confidence DESC", 1)}) x
WHERE target_id IS NOT NULL""",
    "og_edges": """
SELECT k.repo_id, k.src, k.dst, k.relationship_type, k.source_file, k.source_line, k.confidence,
       a.symbol_type AS src_type, a.qualified_name AS src_name, a.file_path AS src_path, a.start_line AS src_start,
       b.symbol_type AS dst_type, b.qualified_name AS dst_name, b.file_path AS dst_path, b.start_line AS dst_start
FROM og_keyed k JOIN og_nodes a ON a.uid = k.src JOIN og_nodes b ON b.uid = k.dst
UNION ALL
SELECT repo_id, repo_id, uid, 'CONTAINS', NULL, NULL, NULL, 'repository', repo_id, NULL, NULL,
       symbol_type, qualified_name, file_path, start_line
FROM og_nodes WHERE symbol_type = 'file'""",
    "og_ends": """
SELECT src AS uid, relationship_type FROM og_edges WHERE src_type <> 'repository'
UNION ALL
SELECT dst, relationship_type FROM og_edges WHERE src <> dst""",
    "og_degree": "SELECT uid, count(*) AS degree FROM og_ends GROUP BY uid",
    "og_call_degree": """
SELECT uid, count(*) AS degree FROM og_ends WHERE relationship_type IN ('CALLS', 'INHERITS') GROUP BY uid""",
    "og_suggested": _ranked(
        f"""(SELECT n.*, degree FROM og_nodes n JOIN og_call_degree d ON d.uid = n.uid
             WHERE symbol_type IN ('class', 'function', 'method') AND {_NOT_TEST.format('file_path')}) s""",
        "repo_id", "degree DESC, uid", 6, rank="place"),
    # File view
    "og_pairs": f"""
SELECT e.repo_id, src_path, dst_path, count(*) AS weight FROM og_edges e
WHERE relationship_type = 'CALLS' AND src_type IN ('function', 'method') AND dst_type IN ('function', 'method')
  AND src_path <> dst_path AND {_NOT_TEST.format('src_path')} AND {_NOT_TEST.format('dst_path')}
  AND EXISTS (SELECT 1 FROM og_nodes f WHERE f.symbol_type = 'file' AND f.repo_id = e.repo_id AND f.file_path = e.src_path)
  AND EXISTS (SELECT 1 FROM og_nodes f WHERE f.symbol_type = 'file' AND f.repo_id = e.repo_id AND f.file_path = e.dst_path)
GROUP BY ALL""",
    "og_touched": """
SELECT repo_id, file_path, count(*) AS degree
FROM (SELECT repo_id, src_path AS file_path FROM og_pairs UNION ALL SELECT repo_id, dst_path FROM og_pairs) t GROUP BY ALL""",
    "og_files": f"""
SELECT n.repo_id, n.uid, degree, symbol_type, name, qualified_name, n.file_path, start_line, end_line
FROM ({_ranked("og_touched", "repo_id", "degree DESC, file_path", 60)}) t
JOIN og_nodes n ON n.repo_id = t.repo_id AND n.file_path = t.file_path AND n.symbol_type = 'file'""",
    # Class view
    "og_classes": _ranked(
        f"""(SELECT n.repo_id, n.uid, degree, symbol_type, name, qualified_name, file_path, start_line, end_line
             FROM og_nodes n JOIN og_degree d ON d.uid = n.uid
             WHERE symbol_type IN ('file', 'class') AND {_NOT_TEST.format('file_path')}) s""",
        "repo_id", "degree DESC, uid", 100, "* EXCLUDE (rank)"),
    "og_class_edges": """
SELECT repo_id, src, dst, relationship_type, 1.0::DOUBLE AS weight FROM og_edges
WHERE (relationship_type = 'CONTAINS' AND src_type = 'file' AND dst_type = 'class')
   OR (relationship_type = 'INHERITS' AND src_type = 'class' AND dst_type = 'class')
UNION ALL
SELECT a.repo_id, a.src, b.src, 'USES', count(*)::DOUBLE
FROM og_edges a
JOIN og_edges c ON c.src = a.dst AND c.relationship_type = 'CALLS' AND c.src_type = 'method' AND c.dst_type = 'method'
JOIN og_edges b ON b.dst = c.dst AND b.relationship_type = 'CONTAINS' AND b.src_type = 'class'
WHERE a.relationship_type = 'CONTAINS' AND a.src_type = 'class' AND a.src <> b.src
GROUP BY a.repo_id, a.src, b.src""",
    "og_related": _ranked(
        """(SELECT src AS uid, 'outgoing' AS direction, relationship_type, dst_name AS qualified_name, dst_path AS file_path,
                   dst_start AS start_line, coalesce(nullif(confidence, 0), 1.0) AS confidence, source_line, dst AS other
            FROM og_edges WHERE src_type <> 'repository') o""",
        "uid", "confidence DESC, qualified_name, source_line, other, relationship_type", 8,
        "* EXCLUDE (source_line, other)", "position") + " UNION ALL " + _ranked(
        """(SELECT dst AS uid, 'incoming' AS direction, relationship_type, src_name AS qualified_name, src_path AS file_path,
                   src_start AS start_line, coalesce(nullif(confidence, 0), 1.0) AS confidence, source_line, src AS other
            FROM og_edges WHERE relationship_type = 'CALLS') i""",
        "uid", "confidence DESC, qualified_name, source_line, other, relationship_type", 5,
        "* EXCLUDE (source_line, other)", "position"),
    # Impact
    "og_arcs": "SELECT DISTINCT src, dst FROM og_edges WHERE relationship_type IN ('CALLS', 'INHERITS')",
    # Recursion needs an end on cycles; no shortest path here is nearly as long as this.
    "og_reach": """
SELECT s.uid AS target_uid, a.src AS uid, 1 AS depth FROM og_suggested s JOIN og_arcs a ON a.dst = s.uid
UNION
SELECT r.target_uid, a.src, r.depth + 1 FROM og_reach r JOIN og_arcs a ON a.dst = r.uid WHERE r.depth < 100""",
    "og_dependents": "SELECT target_uid, uid, min(depth) AS depth FROM og_reach GROUP BY ALL",
    "og_described": f"""
SELECT target_uid, d.uid, depth, symbol_type, qualified_name, file_path, start_line,
       regexp_matches(decorator, '{API_DECORATOR}') AS is_api,
       coalesce(regexp_matches(CASE symbol_type WHEN 'class' THEN string_split(qualified_name, '.')[-1]
                WHEN 'method' THEN string_split(qualified_name, '.')[-2] END, '({'|'.join(SERVICE_SUFFIXES)})$'), false) AS is_service,
       contains(lower(file_path), 'test') OR starts_with(name, 'test_') AS is_test
FROM og_dependents d JOIN og_nodes n ON n.uid = d.uid""",
    "og_category": f"""
SELECT DISTINCT dotted, split_part(dotted, '.', 1) AS package,
       CASE WHEN split_part(dotted, '.', 1) IN ({_list(DATABASE_PACKAGES)}) THEN 'database'
            WHEN split_part(dotted, '.', 1) IN ({_list(sorted(sys.stdlib_module_names))}) THEN NULL
            WHEN dotted LIKE '\\_%' ESCAPE '\\' OR dotted LIKE '.%' OR dotted = '' THEN NULL ELSE 'external_service' END AS category
FROM fx_imports""",
    "og_external": """
SELECT DISTINCT t.repo_id, t.uid AS target_uid, package, category
FROM og_suggested t JOIN og_nodes i ON i.repo_id = t.repo_id AND i.file_path = t.file_path AND i.symbol_type = 'import'
JOIN og_category c ON c.dotted = i.name WHERE category IS NOT NULL""",
    "og_impact_counts": """
SELECT t.repo_id, t.target_uid, n.uid IS NOT NULL AS found, n.qualified_name AS target_qualified_name,
       n.symbol_type AS target_symbol_type, n.file_path AS target_file_path,
       CASE WHEN n.uid IS NOT NULL THEN coalesce(g.degree, 0) END AS degree,
       count(d.uid) FILTER (WHERE depth = 1) AS direct_count, count(d.uid) FILTER (WHERE depth > 1) AS indirect_count,
       count(d.uid) FILTER (WHERE is_api) AS affected_apis, count(d.uid) FILTER (WHERE is_service) AS affected_services,
       count(d.uid) FILTER (WHERE is_test) AS affected_tests,
       (SELECT count(*) FROM og_external x WHERE x.target_uid = t.target_uid) AS external_count,
       (SELECT coalesce(string_agg(package, ',' ORDER BY package), '') FROM og_external x
        WHERE x.target_uid = t.target_uid
          AND (SELECT count(*) FROM og_external y WHERE y.target_uid = x.target_uid AND y.package < x.package) < 5) AS external_names
FROM (SELECT repo_id, uid AS target_uid FROM og_suggested
      UNION ALL SELECT DISTINCT repo_id, concat(repo_id, ':no.such.symbol') FROM og_nodes) t
LEFT JOIN og_nodes n ON n.uid = t.target_uid LEFT JOIN og_degree g ON g.uid = t.target_uid
LEFT JOIN og_described d ON d.target_uid = t.target_uid
GROUP BY ALL""",
    "og_signals": """
SELECT target_uid, s.name AS name, s.value AS value, s.points AS points
FROM (SELECT target_uid, unnest([
    {'name': 'Total dependents', 'value': concat(total, CASE WHEN total = 0 THEN ' (0)' WHEN total <= 3 THEN ' (1-3)'
        WHEN total <= 10 THEN ' (4-10)' WHEN total <= 25 THEN ' (11-25)' ELSE ' (>25)' END),
     'points': CASE WHEN total = 0 THEN 0 WHEN total <= 3 THEN 1 WHEN total <= 10 THEN 2 WHEN total <= 25 THEN 3 ELSE 4 END},
    {'name': 'Affects API endpoints', 'value': CAST(affected_apis AS VARCHAR), 'points': CASE WHEN affected_apis > 0 THEN 2 END},
    {'name': 'Affects service-layer components', 'value': CAST(affected_services AS VARCHAR),
     'points': CASE WHEN affected_services > 0 THEN 1 END},
    {'name': 'Test coverage of dependents', 'value': CASE WHEN affected_tests = 0 THEN 'none found'
        ELSE concat(affected_tests, ' test(s) found') END,
     'points': CASE WHEN total > 0 AND affected_tests = 0 THEN 2 WHEN total > 0 THEN 0 END},
    {'name': 'Touches external dependencies', 'value': CAST(external_count AS VARCHAR),
     'points': CASE WHEN external_count > 0 THEN 1 END},
    {'name': 'Graph centrality of target', 'value': concat('degree ', degree, ' (>=15)'),
     'points': CASE WHEN degree >= 15 THEN 1 END}]) AS s
  FROM (SELECT *, direct_count + indirect_count AS total FROM og_impact_counts WHERE found) c) u
WHERE s.points IS NOT NULL""",
    "og_impact": f"""
SELECT *, CASE WHEN found THEN {_SENTENCES} END AS explanation
FROM (SELECT *, CASE WHEN NOT found THEN NULL WHEN risk_score >= 8 THEN 'CRITICAL' WHEN risk_score >= 5 THEN 'HIGH'
                     WHEN risk_score >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level
      FROM (SELECT c.*, direct_count + indirect_count AS total,
                   (SELECT CAST(sum(points) AS INTEGER) FROM og_signals s WHERE s.target_uid = c.target_uid) AS risk_score
            FROM og_impact_counts c) a) b""",
    # Smells
    "og_calls": "SELECT DISTINCT src, dst FROM og_edges WHERE relationship_type = 'CALLS'",
    "og_closure": """
SELECT src, dst FROM og_calls
UNION
SELECT p.src, c.dst FROM og_closure p JOIN og_calls c ON c.src = p.dst""",
    "og_components": """
SELECT v.uid, least(v.uid, coalesce(min(b.dst), v.uid)) AS component
FROM (SELECT src AS uid FROM og_calls UNION SELECT dst FROM og_calls) v
LEFT JOIN (SELECT f.src, f.dst FROM og_closure f JOIN og_closure r ON r.src = f.dst AND r.dst = f.src) b ON b.src = v.uid
GROUP BY v.uid""",
    "og_cycles": """
SELECT repo_id, 'circular_dependency' AS smell_type,
       CASE WHEN n >= 5 THEN 'HIGH' WHEN n >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS severity, component AS subject,
       qualified_name, n AS metric, concat('Call cycle of ', n, ' symbols') AS title,
       concat('One strongly connected component of ', n, ' symbols over CALLS edges.') AS evidence
FROM (SELECT component, count(*) AS n FROM og_components GROUP BY component) c JOIN og_nodes g ON g.uid = c.component
WHERE n >= 2""",
    "og_god": f"""
SELECT repo_id, 'god_class' AS smell_type, {_SEVERITY.format('n', 15, 25, 40)} AS severity, uid AS subject, qualified_name,
       n AS metric, concat(qualified_name, ' has ', n, ' methods') AS title,
       concat(n, ' methods (LOW>=15, MEDIUM>=25, HIGH>=40).') AS evidence
FROM (SELECT src, count(*) AS n FROM og_edges
      WHERE relationship_type = 'CONTAINS' AND src_type = 'class' AND dst_type = 'method' GROUP BY src) c
JOIN og_nodes g ON g.uid = c.src WHERE n >= 15""",
    "og_large": f"""
SELECT repo_id, 'large_function' AS smell_type, {_SEVERITY.format('(end_line - start_line)', 60, 100, 150)} AS severity,
       uid AS subject, qualified_name, CAST(end_line - start_line AS BIGINT) AS metric,
       concat(qualified_name, ' spans ', end_line - start_line, ' lines') AS title,
       concat(end_line - start_line, ' lines (LOW>=60, MEDIUM>=100, HIGH>=150).') AS evidence
FROM og_nodes WHERE symbol_type IN ('function', 'method') AND end_line - start_line >= 60""",
    "og_dead": """SELECT repo_id, 'dead_code_candidate' AS smell_type, 'LOW' AS severity, uid AS subject, qualified_name,
                   CAST(0 AS BIGINT) AS metric, concat(qualified_name, ' has no known caller') AS title,
                   'No incoming CALLS edge, no decorator, no framework name.' AS evidence
            FROM og_nodes n
            WHERE symbol_type IN ('function', 'method') AND NOT starts_with(name, '__') AND NOT starts_with(name, 'test_')
              AND decorator = '' AND NOT EXISTS (SELECT 1 FROM og_calls c WHERE c.dst = n.uid)""",
    "og_findings": " UNION ALL ".join(f"SELECT * FROM {t}" for t in ("og_cycles", "og_god", "og_large", "og_dead")),
    "og_affected": """
SELECT g.repo_id, 'circular_dependency' AS smell_type, m.component AS subject, g.qualified_name, g.file_path, g.start_line, g.end_line
FROM og_components m JOIN og_cycles c ON c.subject = m.component JOIN og_nodes g ON g.uid = m.uid
UNION ALL
SELECT f.repo_id, smell_type, subject, g.qualified_name, file_path, start_line, end_line
FROM og_findings f JOIN og_nodes g ON g.uid = f.subject WHERE smell_type <> 'circular_dependency'""",
    # Retrieval
    "og_docs": """
SELECT repo_id, format('{}#{:08d}', file_path, seq) AS doc_id, uid AS symbol_uid,
       regexp_replace(concat(qualified_name, chr(10), decorator, chr(10), docstring), '^\\s+|\\s+$', '', 'g') AS text,
       symbol_type, qualified_name, file_path, start_line, end_line
FROM og_symbols WHERE symbol_type IN ('file', 'class', 'function', 'method')""",
} | _tfidf("od", "fx_docs", "fx_questions") | _tfidf("os", "og_docs", "fx_symbol_questions") | {
    "os_hits": _ranked(
        f"""(SELECT query_id, repo_id, doc_id, max(score) AS score
             FROM (SELECT * FROM os_scored UNION ALL
                   SELECT q.query_id, q.repo_id, f.doc_id, 0 FROM fx_symbol_questions q
                   JOIN ({_ranked('og_docs', 'repo_id', 'doc_id', 8)}) f ON f.repo_id = q.repo_id) b GROUP BY ALL) s""",
        "query_id, repo_id", "score DESC, doc_id", 8),
    "os_evidence": """
SELECT query_id, h.repo_id, rank, h.doc_id, score AS relevance, symbol_uid, symbol_type, qualified_name, file_path,
       start_line, end_line
FROM os_hits h JOIN og_docs d ON d.repo_id = h.repo_id AND d.doc_id = h.doc_id WHERE rank <= 6""",
    "os_support": """
SELECT uid AS symbol_uid, count(*) AS n, max(confidence) AS best,
       string_agg(format('   {} {} {} at {}:{}, {:.2f}', direction, relationship_type, qualified_name,
                         file_path, start_line, confidence), chr(10) ORDER BY direction DESC, position) AS lines
FROM og_related GROUP BY uid""",
    "os_blocks": f"""
SELECT query_id, string_agg(concat(rank, '. ', symbol_type, ' ', qualified_name, ', ', file_path, ' lines ',
           start_line, ' to ', end_line, chr(10), coalesce(lines, '{NO_RELATIONSHIPS}')),
           chr(10) || chr(10) ORDER BY rank) AS evidence_block
FROM os_evidence e LEFT JOIN os_support s ON s.symbol_uid = e.symbol_uid GROUP BY query_id""",
}

_SYMBOL_ROWS = """
SELECT repo_id, concat(repo_id, ':', id) AS uid, seq, name, qualified_name, symbol_type, path AS file_path,
       start_line, end_line, decorators, docstring
FROM (
  SELECT repo_id, path, module AS id, 0 AS seq, concat('m', k, '.py') AS name, module AS qualified_name, 'file' AS symbol_type,
         1 AS start_line, CASE kind WHEN 0 THEN 2 ELSE 15 END AS end_line, '' AS decorators,
         CASE WHEN kind = 1 THEN concat('\"\"\"', docstring, '.\"\"\"') END AS docstring FROM og_sources
  UNION ALL SELECT repo_id, path, concat(path, '::import::os::1'), 1, 'os', 'os', 'import', 2, 2, '', NULL
  FROM og_sources WHERE kind = 1
  UNION ALL SELECT repo_id, path, concat(path, '::import::sqlalchemy.orm.Session::2'), 3, 'sqlalchemy.orm.Session',
         'sqlalchemy.orm.Session', 'import', 3, 3, '', NULL FROM og_sources WHERE kind = 1
  UNION ALL SELECT repo_id, path, concat(module, '.Base', k), 5, concat('Base', k), concat(module, '.Base', k), 'class', 5, 6, '', NULL
  FROM og_sources WHERE kind = 1
  UNION ALL SELECT repo_id, path, concat(module, '.C', k), 7, concat('C', k), concat(module, '.C', k), 'class', 8, 11, '', NULL
  FROM og_sources WHERE kind = 1
  UNION ALL SELECT repo_id, path, concat(module, '.C', k, '.run'), 10, 'run', concat(module, '.C', k, '.run'), 'method', 10, 11,
         concat('@app.get("/', k, '")'), NULL FROM og_sources WHERE kind = 1
  UNION ALL SELECT repo_id, path, concat(module, '.helper', k), 13, concat('helper', k), concat(module, '.helper', k), 'function',
         13, 14, '', NULL FROM og_sources WHERE kind = 1
  UNION ALL SELECT repo_id, path, concat(path, '::import::os::0'), 2, 'os', 'os', 'import', 1, 1, '', NULL
  FROM og_sources WHERE kind = 2
  UNION ALL SELECT repo_id, path, concat(module, '.A', k), 4, concat('A', k), concat(module, '.A', k), 'class', 3, 9, '', NULL
  FROM og_sources WHERE kind = 2
  UNION ALL SELECT repo_id, path, concat(module, '.A', k, '.sound', k), 6, concat('sound', k), concat(module, '.A', k, '.sound', k),
         'method', 4, 5, '', NULL FROM og_sources WHERE kind = 2
  UNION ALL SELECT repo_id, path, concat(module, '.A', k, '.broken', k), 9, concat('broken', k), concat(module, '.A', k, '.broken', k),
         'method', 7, 9, '', NULL FROM og_sources WHERE kind = 2
  UNION ALL SELECT repo_id, path, concat(module, '.tail', k), 12, concat('tail', k), concat(module, '.tail', k), 'function',
         13, 14, '', NULL FROM og_sources WHERE kind = 2) s"""

_RELATIONSHIP_ROWS = """
SELECT repo_id, seq, source_id, target_id, target_name, relationship_type, path AS source_file, source_line,
       CAST(confidence AS DOUBLE) AS confidence
FROM (
  SELECT repo_id, path, 2 AS seq, module AS source_id, NULL AS target_id, 'os' AS target_name, 'imports' AS relationship_type,
         2 AS source_line, 1.0 AS confidence, 1 AS of_kind, kind FROM og_sources
  UNION ALL SELECT repo_id, path, 4, module, NULL, 'sqlalchemy.orm.Session', 'imports', 3, 1.0, 1, kind FROM og_sources
  UNION ALL SELECT repo_id, path, 6, module, concat(module, '.Base', k), concat('Base', k), 'contains', 5, 1.0, 1, kind FROM og_sources
  UNION ALL SELECT repo_id, path, 8, module, concat(module, '.C', k), concat('C', k), 'contains', 8, 1.0, 1, kind FROM og_sources
  UNION ALL SELECT repo_id, path, 9, concat(module, '.C', k), NULL, concat('Base', k), 'inherits', 8, 0.6, 1, kind FROM og_sources
  UNION ALL SELECT repo_id, path, 11, concat(module, '.C', k), concat(module, '.C', k, '.run'), 'run', 'contains', 10, 1.0, 1, kind FROM og_sources
  UNION ALL SELECT repo_id, path, 12, concat(module, '.C', k, '.run'), NULL, concat('helper', k), 'calls', 11, 0.5, 1, kind FROM og_sources
  UNION ALL SELECT repo_id, path, 14, module, concat(module, '.helper', k), concat('helper', k), 'contains', 13, 1.0, 1, kind FROM og_sources
  UNION ALL SELECT repo_id, path, 15, concat(module, '.helper', k), NULL, 'x.run', 'calls', 14, 0.5, 1, kind FROM og_sources
  UNION ALL SELECT repo_id, path, 3, module, NULL, 'os', 'imports', 1, 1.0, 2, kind FROM og_sources
  UNION ALL SELECT repo_id, path, 5, module, concat(module, '.A', k), concat('A', k), 'contains', 3, 1.0, 2, kind FROM og_sources
  UNION ALL SELECT repo_id, path, 7, concat(module, '.A', k), concat(module, '.A', k, '.sound', k), concat('sound', k), 'contains', 4, 1.0, 2, kind
  FROM og_sources
  UNION ALL SELECT repo_id, path, 8, concat(module, '.A', k, '.sound', k), NULL, concat('first', k), 'calls', 5, 0.5, 2, kind FROM og_sources
  UNION ALL SELECT repo_id, path, 10, concat(module, '.A', k), concat(module, '.A', k, '.broken', k), concat('broken', k), 'contains', 7, 1.0, 2, kind
  FROM og_sources
  UNION ALL SELECT repo_id, path, 11, concat(module, '.A', k, '.broken', k), NULL, concat('second', k), 'calls', 9, 0.5, 2, kind FROM og_sources
  UNION ALL SELECT repo_id, path, 13, module, concat(module, '.tail', k), concat('tail', k), 'contains', 13, 1.0, 2, kind FROM og_sources
  UNION ALL SELECT repo_id, path, 14, concat(module, '.tail', k), NULL, 'y.go', 'calls', 14, 0.5, 2, kind FROM og_sources) r
WHERE of_kind = kind"""

# Files, whole ones and partly broken ones of every repository.
_STREAMED = """(SELECT repo_id, count(*) AS f, count(*) FILTER (WHERE kind = 1) AS g, count(*) FILTER (WHERE kind = 2) AS h
  FROM og_sources GROUP BY repo_id) s"""
_STREAMED_SYMBOLS = "f + 6 * g + 5 * h"
_STREAMED_RELATIONSHIPS = "4 * g + 2 * g + g + CASE WHEN g = 1 THEN 2 ELSE g END + 4 * h + h"

_STREAMED_KINDS = f"""
SELECT repo_id, kind, n FROM (
  SELECT repo_id, unnest(['file', 'import', 'class', 'method', 'function', 'CONTAINS', 'IMPORTS', 'INHERITS', 'CALLS']) AS kind,
         unnest([f, 2 * g + h, 2 * g + h, g + 2 * h, g + h, 4 * g + 4 * h + f, 2 * g + h, g, CASE WHEN g = 1 THEN 2 ELSE g END]) AS n FROM {_STREAMED}) x
WHERE n > 0"""

# The documents that the stream indexes.
CTES["oi_docs"] = f"""
SELECT repo_id, format('{{}}#{{:08d}}', file_path, seq) AS doc_id,
       concat_ws(chr(10), qualified_name, decorators, coalesce(docstring, '')) AS text
FROM ({_SYMBOL_ROWS}) d WHERE symbol_type IN ('file', 'class', 'function', 'method')"""
CTES |= _tfidf("oi", "oi_docs", "fx_symbol_questions")

STATEMENTS = {
    "language_of_file": f"SELECT repo_id, path, {_LANGUAGE} AS language FROM fx_repo_files",
    "repo_profile": "SELECT repo_id, file_count, total_size_bytes, languages FROM og_profile",
    "repo_limits": "SELECT repo_id, file_count, total_size_bytes, reject_reason FROM og_limits",
    "scan_status": """
SELECT repo_id, CASE WHEN reject_reason IS NULL THEN 'cloned' ELSE 'failed' END AS status, reject_reason AS error, file_count
FROM og_limits""",
    "accepted_files": """
SELECT repo_id, path, size_bytes FROM fx_repo_files
WHERE repo_id IN (SELECT repo_id FROM og_limits WHERE reject_reason IS NULL)""",
    "scan_source_tree": f"""
SELECT repo_id, path, size_bytes, md5(content) AS content_md5 FROM fx_source_files
WHERE NOT list_has_any(string_split(path, '/'), [{_list(IGNORED_DIRS)}])""",
    "extract_broken_blocks": """
SELECT repo_id, unnest([module, 'os', concat(module, '.first', k), concat(module, '.Second', k), concat(module, '.tail', k)]) AS qualified_name,
       unnest(['file', 'import', 'function', 'class', 'function']) AS symbol_type,
       unnest([1, 1, 3 + shift, 6 + shift, 8 + shift + more]) AS start_line
FROM (SELECT repo_id, k, concat('src.b', k) AS module, CASE sz % 6 WHEN 5 THEN 1 ELSE 0 END AS shift,
             CASE sz % 6 WHEN 1 THEN 2 ELSE 0 END AS more FROM fx_members) m""",
    "validate_repo_urls": "SELECT id, owner, repo, clone_url, url_error FROM og_urls",
    "register_repositories": """
SELECT id, clone_url AS url, owner, repo AS name, 'pending' AS status FROM og_urls WHERE url_error IS NULL""",
    "latest_status": "SELECT repo_id, status, error, epoch_us(created_at) AS created_us, epoch_us(updated_at) AS updated_us FROM og_latest",
    "list_repositories": "SELECT repo_id, status FROM og_latest ORDER BY created_at DESC, repo_id",
    "ready_only": """
SELECT repo_id, seq, status FROM fx_status_log WHERE repo_id IN (SELECT repo_id FROM og_latest WHERE status = 'ready')""",
    "readiness": """
SELECT CAST(c_custkey AS VARCHAR) AS repo_id,
       CASE WHEN status IS NULL THEN 'missing' WHEN status = 'ready' THEN 'ready' ELSE 'not_ready' END AS readiness,
       CASE WHEN status IS NULL THEN 404 WHEN status = 'ready' THEN 200 ELSE 409 END AS response_code
FROM customer LEFT JOIN og_latest l ON l.repo_id = CAST(c_custkey AS VARCHAR)""",
    "stage_states": f"""
SELECT repo_id, status, stage, place - 1 AS position,
       CASE WHEN place < current_place THEN 'done' WHEN place = current_place THEN 'active' ELSE 'pending' END AS state
FROM (SELECT repo_id, status, unnest([{_list(STAGES)}]) AS stage, CAST(unnest(range(1, 7)) AS INTEGER) AS place,
             coalesce(list_position([{_list(STAGES)}], status), 0) AS current_place FROM og_latest) s""",
    "extract_symbols": _SYMBOL_ROWS,
    "extract_relationships": _RELATIONSHIP_ROWS,
    "parse_summary": """
SELECT repo_id, count(*) AS parsed_files, count(*) FILTER (WHERE kind <> 1) AS parse_errors FROM og_sources GROUP BY repo_id""",
    "resolve_relationships": """
SELECT repo_id, source_id, target_id, target_name, relationship_type, source_file, source_line, confidence FROM og_resolved""",
    "build_nodes": """
SELECT repo_id, uid, id, seq, name, qualified_name, symbol_type, file_path, start_line, end_line, docstring FROM og_nodes""",
    "build_edges": "SELECT * FROM og_edges",
    "graph_counts": """
SELECT s.repo_id, s.n AS symbol_count, r.n AS relationship_count
FROM (SELECT repo_id, count(*) AS n FROM fx_symbols GROUP BY repo_id) s
JOIN (SELECT repo_id, count(target_id) AS n FROM og_resolved GROUP BY repo_id) r ON r.repo_id = s.repo_id""",
    "unique_violations": "SELECT uid, count(*) AS occurrences FROM og_symbols GROUP BY uid HAVING count(*) > 1",
    "degree_all_types": "SELECT n.repo_id, d.uid, degree FROM og_degree d JOIN og_nodes n ON n.uid = d.uid",
    "degree_calls_inherits": "SELECT n.repo_id, d.uid, degree FROM og_call_degree d JOIN og_nodes n ON n.uid = d.uid",
    "suggest_symbols": """
SELECT repo_id, uid, degree, place AS rank, symbol_type, name, qualified_name, file_path, start_line FROM og_suggested""",
    "search_symbols": _ranked(
        """(SELECT query_id, uid, symbol_type, qualified_name
            FROM og_nodes n JOIN fx_symbol_queries q ON q.repo_id = n.repo_id
             AND contains(lower(qualified_name), lower(trim(query)))
            WHERE trim(query) <> '' AND symbol_type IN ('file', 'class', 'function', 'method')) m""",
        "query_id", "length(qualified_name), uid", 20),
    "search_short_queries": _ranked(
        """(SELECT concat(q.repo_id, '/', query) AS query_id, uid, symbol_type, qualified_name
            FROM og_nodes n JOIN (
              SELECT DISTINCT repo_id, unnest([substr(trim(query), 1, 1), substr(trim(query), 2, 2)]) AS query
              FROM fx_symbol_queries WHERE trim(query) <> '') q
              ON q.repo_id = n.repo_id AND contains(lower(qualified_name), lower(query))
            WHERE symbol_type IN ('file', 'class', 'function', 'method')) m""",
        "query_id", "length(qualified_name), uid", 20),
    "file_view_nodes": "SELECT * FROM og_files",
    "file_view_edges": """
SELECT p.repo_id, a.uid AS source_uid, b.uid AS target_uid, 'USES' AS relationship_type, weight::DOUBLE AS weight
FROM og_pairs p JOIN og_files a ON a.repo_id = p.repo_id AND a.file_path = p.src_path
JOIN og_files b ON b.repo_id = p.repo_id AND b.file_path = p.dst_path""",
    "file_view_truncated": """
SELECT n.repo_id, coalesce(any_value(t.n) > 20, false) AS truncated FROM og_nodes n
LEFT JOIN (SELECT repo_id, count(*) AS n FROM og_touched GROUP BY repo_id) t ON t.repo_id = n.repo_id GROUP BY n.repo_id""",
    "class_view_nodes": "SELECT * FROM og_classes",
    "class_view_edges": """
SELECT repo_id, src AS source_uid, dst AS target_uid, relationship_type, weight FROM og_class_edges
WHERE src IN (SELECT uid FROM og_classes) AND dst IN (SELECT uid FROM og_classes)""",
    "class_view_truncated": """
SELECT n.repo_id, coalesce(any_value(c.n) >= 85, false) AS truncated FROM og_nodes n
LEFT JOIN (SELECT repo_id, count(*) AS n FROM og_classes GROUP BY repo_id) c ON c.repo_id = n.repo_id GROUP BY n.repo_id""",
    "neighbourhood": "SELECT * FROM og_related",
    "dependents": "SELECT target_uid, uid, depth FROM og_dependents",
    "impact_summary": """
SELECT repo_id, target_uid, found, target_qualified_name, target_symbol_type, target_file_path, degree, direct_count,
       indirect_count, affected_apis, affected_services, affected_tests, external_count, external_names, risk_score,
       risk_level, explanation FROM og_impact""",
    "risk_signals": "SELECT target_uid, name, value, points FROM og_signals",
    "impact_dependents": "SELECT * FROM og_described",
    "external_dependencies": "SELECT repo_id, target_uid, package, category FROM og_external",
    "dependents_preview": """
SELECT target_uid, count(*) AS total, greatest(count(*) - 8, 0) AS more,
       string_agg(qualified_name, ',' ORDER BY place) FILTER (WHERE place <= 8) AS dependents
FROM (SELECT *, row_number() OVER (PARTITION BY target_uid ORDER BY depth, qualified_name, uid) AS place FROM og_described) d
GROUP BY target_uid""",
    "classify_imports": "SELECT dotted, category FROM og_category",
    "god_classes": f"SELECT {_FINDING} FROM og_god",
    "large_functions": f"SELECT {_FINDING} FROM og_large",
    "dead_code": f"SELECT {_FINDING} FROM og_dead",
    "strongly_connected_components": "SELECT uid, component FROM og_components",
    "strongly_connected_components_by_rounds": "SELECT uid, component FROM og_components",
    "circular_dependencies": f"SELECT {_FINDING} FROM og_cycles",
    "smell_report": f"SELECT {_FINDING} FROM og_findings ORDER BY repo_id, {_REPORT_ORDER}",
    "smell_affected": "SELECT * FROM og_affected",
    "top_findings": f"""
SELECT {_FINDING} FROM og_findings WHERE severity = 'HIGH'
UNION ALL {_ranked("(SELECT * FROM og_findings WHERE severity = 'MEDIUM') m", 'repo_id', _REPORT_ORDER, 5, _FINDING)}""",
    "hidden_findings": """
SELECT n.repo_id, coalesce(any_value(total), 0) AS total, coalesce(any_value(hidden), 0) AS hidden FROM og_nodes n
LEFT JOIN (SELECT repo_id, count(*) AS total, count(*) FILTER (WHERE severity = 'LOW')
                  + greatest(count(*) FILTER (WHERE severity = 'MEDIUM') - 5, 0) AS hidden FROM og_findings GROUP BY repo_id) f
     ON f.repo_id = n.repo_id GROUP BY n.repo_id""",
    "affected_preview": """
SELECT smell_type, subject, count(*) AS total, greatest(count(*) - 6, 0) AS more,
       string_agg(qualified_name, ',' ORDER BY place) FILTER (WHERE place <= 6) AS symbols
FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, smell_type, subject
                                   ORDER BY qualified_name, file_path, start_line, end_line) AS place FROM og_affected) a
GROUP BY repo_id, smell_type, subject""",
    "search_documents": "SELECT repo_id, doc_id, symbol_uid, text FROM og_docs",
    "tfidf_top_terms": "SELECT repo_id, term, df, total, round(idf, 6) AS idf FROM od_vocabulary",
    "search_topk": _ranked("od_scored", "query_id, repo_id", "score DESC, doc_id", 8, "query_id, repo_id, doc_id, round(score, 6) AS score, rank"),
    "search_topk_padded": "SELECT query_id, repo_id, doc_id, round(score, 6) AS score, rank FROM os_hits",
    "search_dense_topk": _ranked(
        """(SELECT q.query_id, 'all' AS repo_id, e.vec_id, list_cosine_similarity(q.v, e.v) AS score
            FROM (SELECT label AS query_id, list(mean ORDER BY pos) AS v
                  FROM (SELECT label, pos, avg(CAST(embedding[pos] AS DOUBLE)) AS mean
                        FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings) p
                        GROUP BY label, pos) m GROUP BY label) q,
                 (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) e) s""",
        "query_id", "score DESC, vec_id", 8, "query_id, repo_id, vec_id, round(score, 6) AS score, rank"),
    "evidence": """
SELECT query_id, rank, e.symbol_uid, round(relevance, 6) AS relevance, coalesce(n, 0) AS related
FROM os_evidence e LEFT JOIN os_support s ON s.symbol_uid = e.symbol_uid""",
    "evidence_confidence": """
SELECT query_id, repo_id, round(score, 9) AS confidence_score,
       CASE WHEN score >= 0.55 THEN 'Confirmed' WHEN score >= 0.30 THEN 'Inferred' ELSE 'Uncertain' END AS confidence_label
FROM (SELECT h.query_id, h.repo_id, least(1.0, avg(h.score) FILTER (WHERE h.rank <= 3)
             + max(CASE WHEN h.rank > 6 THEN 0 WHEN best >= 0.7 THEN 0.2 WHEN n > 0 THEN 0.05 ELSE 0 END)::DOUBLE) AS score
      FROM os_hits h JOIN og_docs d ON d.repo_id = h.repo_id AND d.doc_id = h.doc_id
      LEFT JOIN os_support s ON s.symbol_uid = d.symbol_uid GROUP BY h.query_id, h.repo_id) c""",
    "evidence_text": "SELECT query_id, evidence_block FROM os_blocks",
    "prompts": f"""
SELECT query_id, 'system' AS role, '{RULES}' AS content FROM fx_symbol_questions
UNION ALL
SELECT q.query_id, 'user', concat('<question>', question, '</question>', chr(10), '<evidence>', chr(10), evidence_block, chr(10),
       '</evidence>', chr(10), 'Answer from the evidence only.')
FROM fx_symbol_questions q JOIN os_blocks b ON b.query_id = q.query_id""",
    "stream_ingest_graph": _STREAMED_KINDS,
    "stream_degrees": f"""
SELECT k.repo_id, kind AS relationship_type, CASE WHEN kind = 'CONTAINS' THEN 2 * n - f ELSE 2 * n END AS ends
FROM ({_STREAMED_KINDS}) k JOIN {_STREAMED} ON s.repo_id = k.repo_id WHERE kind = upper(kind)""",
    "stream_removed_files": _STREAMED_KINDS.replace(_STREAMED, f"(SELECT repo_id, f - h AS f, g, 0 AS h FROM {_STREAMED}) t"),
    "stream_ingest_index": "SELECT repo_id, term, df, total, round(idf, 6) AS idf FROM oi_vocabulary",
    "stored_repositories": f"""
SELECT p.repo_id AS id, concat('https://github.com/org/', p.repo_id, '.git') AS url, 'org' AS owner, p.repo_id AS name, 'ready' AS status,
       'main' AS default_branch, md5(p.repo_id) AS commit_sha, file_count, {_STREAMED_SYMBOLS} AS symbol_count
FROM og_profile p JOIN {_STREAMED} ON s.repo_id = p.repo_id""",
    "get_repository": "SELECT repo_id, status, error FROM og_latest WHERE repo_id = '7'",
    "extract_with_registered_extractor": f"""
SELECT repo_id, concat(repo_id, ':', path, suffix) AS uid, CAST(seq AS INTEGER) AS seq, name, qualified_name, symbol_type, 'javascript' AS language
FROM (SELECT repo_id, path, '' AS suffix, 0 AS seq, reverse(split_part(reverse(path), '/', 1)) AS name, path AS qualified_name,
             'file' AS symbol_type, {_LANGUAGE} AS language FROM fx_repo_files
      WHERE NOT list_has_any(string_split(path, '/'), [{_list(IGNORED_DIRS)}])
      UNION ALL
      SELECT repo_id, path, '.first', 1, 'first', concat('in ', path), 'function', {_LANGUAGE} FROM fx_repo_files
      WHERE NOT list_has_any(string_split(path, '/'), [{_list(IGNORED_DIRS)}])) s
WHERE language = 'javascript'""",
    "stream_ingest_status": f"""
SELECT repo_id, 'ready' AS status, f AS file_count, {_STREAMED_SYMBOLS} AS symbol_count,
       {_STREAMED_RELATIONSHIPS} AS relationship_count FROM {_STREAMED}""",
    "repository_records": f"""
SELECT p.repo_id AS id, concat('https://github.com/org/', p.repo_id, '.git') AS url, 'org' AS owner, p.repo_id AS name,
       'ready' AS status, file_count, {_STREAMED_SYMBOLS} AS symbol_count,
       {_STREAMED_RELATIONSHIPS} AS relationship_count, CAST(NULL AS VARCHAR) AS error, languages
FROM og_profile p JOIN {_STREAMED} ON s.repo_id = p.repo_id""",
}

STATEMENTS["search_dense_index_topk"] = STATEMENTS["search_dense_topk"]

_RECURSIVE = ("og_reach", "og_closure")


def oracle(name: str) -> str:
    text = with_derived(STATEMENTS[name], CTES)
    return text.replace("WITH ", "WITH RECURSIVE ", 1) if any(f"{r} AS (" in text for r in _RECURSIVE) else text
