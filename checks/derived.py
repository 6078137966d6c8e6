"""Graph-shaped input tables derived from the given tables.

The given tables hold no program text, so parts become functions and methods
and the line items of an order become calls. Every statement reads its whole
tables, and is plain SQL that Spark and the oracle engine both run.
"""

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()

DERIVED = {
    # One function or method per part. Brands from 17 on share one repository,
    # which so holds a third of all rows; 'run' repeats within classes.
    "fx_members": """
SELECT k, repo_id, path, module, class_name, economy_class,
       concat(CASE WHEN sz % 7 = 0 THEN module ELSE concat(module, '.', class_name) END, '.', name) AS qualified_name,
       name, sz,
       CASE WHEN sz % 7 = 0 THEN 'function' ELSE 'method' END AS symbol_type,
       CAST(k % 97 * 10 + 1 AS INTEGER) AS start_line,
       CAST(k % 97 * 10 + 1 + sz * 4 AS INTEGER) AS end_line,
       CASE sz % 10 WHEN 0 THEN '@app.get("/p")' WHEN 5 THEN '@staticmethod' ELSE '' END AS decorator,
       docstring
FROM (
  SELECT k, sz, docstring, repo_id,
         concat(folder, '/', kind, '/', noun, '.py') AS path,
         concat(folder, '.', kind, '.', noun) AS module,
         concat(kind, '_', noun, suffix) AS class_name,
         concat('src.economy.', noun, '.economy_', noun, suffix) AS economy_class,
         CASE sz WHEN 1 THEN concat('__m', k, '__') WHEN 2 THEN concat('test_m', k)
                 WHEN 3 THEN 'run' ELSE concat('m', k) END AS name
  FROM (
    SELECT p_partkey AS k, p_size AS sz, p_name AS docstring, lower(p_type) AS kind,
           split_part(p_name, ' ', 2) AS noun,
           CASE WHEN p_type = 'PROMO' THEN 'tests' ELSE 'src' END AS folder,
           CASE WHEN split_part(p_name, ' ', 2) IN ('widget', 'gear') THEN 'Service' ELSE '' END AS suffix,
           CASE WHEN CAST(substr(p_brand, 7) AS INTEGER) >= 17 THEN 'mono'
                ELSE concat('r', substr(p_brand, 7)) END AS repo_id
    FROM part) p) q""",
    # Imports of a file, by the sizes of its parts; one band names a class of the repository.
    "fx_imports": """
SELECT DISTINCT repo_id, path, module, band AS source_line,
       CASE band WHEN 1 THEN 'os.path' WHEN 2 THEN 'sqlalchemy.orm' WHEN 3 THEN 'requests.sessions'
                 WHEN 4 THEN '_private.x' ELSE economy_class END AS dotted
FROM (SELECT *, CASE WHEN sz <= 10 THEN 1 WHEN sz <= 20 THEN 2 WHEN sz <= 30 THEN 3
                     WHEN sz <= 40 THEN 4 ELSE 5 END AS band FROM fx_members) m""",
    "fx_symbols": """
SELECT DISTINCT repo_id, module AS id, 0 AS seq, reverse(split_part(reverse(path), '/', 1)) AS name,
       module AS qualified_name, 'file' AS symbol_type, path AS file_path, 1 AS start_line, 1000 AS end_line,
       '' AS decorator, '' AS docstring
FROM fx_members
UNION ALL
SELECT repo_id, concat(path, '::import::', dotted, '::', source_line - 1), source_line, dotted, dotted,
       'import', path, source_line, source_line, '', ''
FROM fx_imports
UNION ALL
SELECT DISTINCT repo_id, concat(module, '.', class_name), 9, class_name, concat(module, '.', class_name),
       'class', path, 9, 999, '', ''
FROM fx_members
UNION ALL
SELECT repo_id, qualified_name, CAST(k + 10 AS INTEGER), name, qualified_name, symbol_type, path, start_line,
       end_line, decorator, docstring
FROM fx_members""",
    # Rows as an extractor emits them. Calls link consecutive line items of an
    # order within a repository; the target is written fully qualified, as an
    # attribute of self, or as an outside name.
    "fx_calls": """
SELECT s.repo_id, s.qualified_name AS source_id, s.path AS source_file,
       CASE WHEN l.l_suppkey % 11 = 0 THEN 'os.getcwd'
            WHEN l.l_linenumber % 3 = 0 THEN t.qualified_name ELSE concat('self.', t.name) END AS target_name,
       CAST(s.start_line + l.l_linenumber AS INTEGER) AS source_line
FROM (SELECT l_suppkey, l_linenumber, l_partkey,
             lead(l_partkey) OVER (PARTITION BY l_orderkey, m.repo_id
                                   ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS nxt
      FROM lineitem JOIN fx_members m ON m.k = l_partkey) l
JOIN fx_members s ON s.k = l.l_partkey
JOIN fx_members t ON t.k = l.nxt""",
    "fx_relationships": """
SELECT repo_id, 1 AS seq, module AS source_id, concat(module, '.', class_name) AS target_id,
       class_name AS target_name, 'contains' AS relationship_type, path AS source_file, 9 AS source_line,
       CAST(1.0 AS DOUBLE) AS confidence
FROM (SELECT DISTINCT repo_id, module, class_name, path FROM fx_members) c
UNION ALL
SELECT repo_id, 2, CASE WHEN symbol_type = 'function' THEN module ELSE concat(module, '.', class_name) END,
       qualified_name, name, 'contains', path, start_line, CAST(1.0 AS DOUBLE)
FROM fx_members
UNION ALL
SELECT repo_id, 3, module, NULL, dotted, 'imports', path, source_line, CAST(1.0 AS DOUBLE) FROM fx_imports
UNION ALL
SELECT repo_id, 4, concat(module, '.', class_name), NULL,
       concat('economy_', substr(class_name, instr(class_name, '_') + 1)), 'inherits', path, 9, CAST(0.6 AS DOUBLE)
FROM (SELECT DISTINCT repo_id, module, class_name, path FROM fx_members) c
WHERE class_name NOT LIKE 'economy%'
UNION ALL
SELECT repo_id, 5, source_id, NULL, target_name, 'calls', source_file, source_line, CAST(0.5 AS DOUBLE)
FROM fx_calls""",
    # Files of many kinds, some in ignored folders.
    "fx_repo_files": """
SELECT repo_id, path, CAST(retail * 1000 AS BIGINT) AS size_bytes
FROM (
  SELECT m.repo_id, p.p_retailprice AS retail,
         concat(CASE m.sz WHEN 7 THEN 'node_modules/' WHEN 17 THEN 'pkg/build/' WHEN 27 THEN '.git/' ELSE 'pkg/' END,
                'f', m.k,
                CASE m.sz % 12 WHEN 0 THEN '.js' WHEN 1 THEN '.TSX' WHEN 2 THEN '.java' WHEN 3 THEN '.h'
                               WHEN 4 THEN '.md' WHEN 5 THEN '' WHEN 6 THEN '.tar.cc' WHEN 7 THEN '.Py' ELSE '.py' END) AS path
  FROM fx_members m JOIN part p ON p.p_partkey = m.k) f""",
    "fx_repo_urls": """
SELECT s_suppkey AS id,
       CASE s_suppkey % 9
         WHEN 0 THEN concat('https://github.com/', owner, '/', repo)
         WHEN 1 THEN concat('https://github.com/', owner, '/', repo, '.git')
         WHEN 2 THEN concat('https://github.com/', owner, '/', repo, '/')
         WHEN 3 THEN concat('http://github.com/', owner, '/', repo)
         WHEN 4 THEN concat('https://example.com/', owner, '/', repo)
         WHEN 5 THEN concat('https://github.com/', owner)
         WHEN 6 THEN concat('https://github.com/', owner, '/..')
         WHEN 7 THEN concat('  https://github.com/', owner, '/', repo, '.git/ ')
         ELSE '' END AS url
FROM (SELECT s_suppkey, lower(split_part(s_name, '#', 1)) AS owner, replace(s_name, '#', '_') AS repo
      FROM supplier) s""",
    # One repository per user; the event kinds stand for pipeline stages.
    "fx_status_log": """
SELECT CAST(user_id AS VARCHAR) AS repo_id, ts, event_id AS seq,
       CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'parsing' WHEN 'click' THEN 'building_graph'
                       WHEN 'purchase' THEN 'ready' ELSE 'failed' END AS status,
       CASE WHEN event_type = 'error' THEN props END AS error
FROM events""",
    # Search terms of a repository: its nouns, its folders in upper case, and blanks.
    "fx_symbol_queries": """
SELECT concat(repo_id, '/', query) AS query_id, repo_id, query
FROM (SELECT DISTINCT repo_id, split_part(docstring, ' ', 2) AS query FROM fx_members
      UNION ALL
      SELECT DISTINCT repo_id, concat(' ', upper(split_part(path, '/', 2)), ' ') FROM fx_members
      UNION ALL
      SELECT DISTINCT repo_id, '  ' FROM fx_members) q""",
    # Questions of a repository: each part name it uses, and one of unknown words.
    "fx_symbol_questions": """
SELECT concat(repo_id, '/', question) AS query_id, repo_id, question
FROM (SELECT DISTINCT repo_id, concat('where is the ', docstring, ' handled?') AS question FROM fx_members
      UNION ALL
      SELECT DISTINCT repo_id, 'zzzz qqqq' FROM fx_members) q""",
    "fx_docs": "SELECT 'documents' AS repo_id, doc_id, text FROM documents",
    "fx_questions": "SELECT item_id AS query_id, 'documents' AS repo_id, text AS question FROM benchmark",
    # One small file per part; size 13 gives one that does not parse at all, size 23 one with two broken
    # statements among sound ones; size 33 stands in an ignored folder.
    "fx_source_files": """
SELECT repo_id, path, CAST(length(content) AS BIGINT) AS size_bytes, content
FROM (
  SELECT repo_id, concat(CASE WHEN sz = 33 THEN 'node_modules/' ELSE '' END,
                         split_part(path, '/', 1), '/', split_part(path, '/', 2), '/m', k, '.py') AS path,
         CASE WHEN sz = 13 THEN concat('def f(:', chr(10), '  pass')
              WHEN sz = 23 THEN concat('import os', chr(10), chr(10),
                     'class A', k, ':', chr(10),
                     '    def sound', k, '(self):', chr(10),
                     '        return first', k, '(1)', chr(10), chr(10),
                     '    def broken', k, '(self):', chr(10),
                     '        print "x"', chr(10),
                     '        return second', k, '()', chr(10), chr(10),
                     'x = = 1', chr(10), chr(10),
                     'def tail', k, '(y):', chr(10),
                     '    return y.go()', chr(10))
         ELSE concat('\"\"\"', docstring, '.\"\"\"', chr(10),
                     'import os', chr(10),
                     'from sqlalchemy.orm import Session as S', chr(10),
                     chr(10),
                     'class Base', k, ':', chr(10),
                     '    pass', chr(10),
                     chr(10),
                     'class C', k, '(Base', k, '):', chr(10),
                     '    @app.get("/', k, '")', chr(10),
                     '    def run(self):', chr(10),
                     '        return helper', k, '(self.x)', chr(10),
                     chr(10),
                     'def helper', k, '(x):', chr(10),
                     '    return x.run()', chr(10)) END AS content
  FROM fx_members) f""",
    # One file per part with a broken statement inside of a block; the size chooses the block.
    "fx_broken_files": """
SELECT repo_id, path, CAST(length(content) AS BIGINT) AS size_bytes, content
FROM (
  SELECT repo_id, concat('src/b', k, '.py') AS path,
         concat('import os', chr(10),
                CASE sz % 6 WHEN 0 THEN 'if os.name:' WHEN 1 THEN 'try:' WHEN 2 THEN 'with open(os) as f:'
                            WHEN 3 THEN 'for x in os.listdir():' WHEN 4 THEN 'while os.name:'
                            ELSE concat('match os.name:', chr(10), '    case 1:') END, chr(10),
                margin, 'def first', k, '():', chr(10),
                margin, '    return os.getcwd()', chr(10),
                margin, 'x = = 1', chr(10),
                margin, 'class Second', k, ':', chr(10),
                margin, '    pass', chr(10),
                CASE sz % 6 WHEN 1 THEN concat('finally:', chr(10), '    pass', chr(10)) ELSE '' END,
                'def tail', k, '():', chr(10),
                '    pass', chr(10)) AS content
  FROM (SELECT *, CASE WHEN sz % 6 = 5 THEN '        ' ELSE '    ' END AS margin FROM fx_members) m) f""",
}


def with_derived(statement: str, ctes=DERIVED) -> str:
    """The statement preceded by the derived tables it needs, in order."""
    needed, pending = set(), [statement]
    while pending:
        text = pending.pop()
        for name in ctes:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                pending.append(ctes[name])
    parts = [f"{name} AS ({ctes[name]})" for name in ctes if name in needed]
    return f"WITH {', '.join(parts)}\n{statement}" if parts else statement


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table on Spark, lazily, from the files of ``sf_dir``."""
    given = {t: f"SELECT * FROM parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}
    return spark.sql(with_derived(f"SELECT * FROM {name}", given | DERIVED).replace(" AS VARCHAR)", " AS STRING)"))


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
