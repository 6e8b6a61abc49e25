"""DuckDB SQL for the registered queries.

Written apart from the Spark side: tokens cover the whole text and are placed
by window sums, vectors are compared by sparse joins, and so on.
"""

from __future__ import annotations

from lexhaven.plans.inputs import MESSAGES

_NL = "chr(10)"


def _newlines(x: str) -> str:
    return f"(length({x}) - length(replace({x}, {_NL}, '')))"


def _id(relative, package, cls, method, kind, start, end, digest, index) -> str:
    return (
        f"md5(concat_ws(':', 'corpus', {relative}, nullif({package}, ''), nullif({cls}, ''), "
        f"nullif({method}, ''), {kind}, nullif({start}, 0), nullif({end}, 0), "
        f"substr({digest}, 1, 16), {index}))"
    )


# --- vectors ----------------------------------------------------------------

_PAIRS = """
pairs AS (
  SELECT q.vec_id AS query_id, s.vec_id AS id, s.label,
    round(pow(list_distance(q.embedding::DOUBLE[], s.embedding::DOUBLE[]), 2), 9) AS d
  FROM embeddings q JOIN embeddings s ON {on}
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rank FROM pairs
)"""


def _knn(k: int, on: str = "true", where: str = "true", label: bool = True) -> str:
    extra = "label::VARCHAR AS chunk_type," if label else ""
    return f"""WITH {_PAIRS.format(on=on)}
SELECT query_id, rank::INTEGER AS rank, id, {extra} round(d, 6) AS distance, round(1 / (1 + d), 6) AS score
FROM ranked WHERE rank <= {k} AND {where}"""


_SINGLE = """WITH cells AS (
  SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS n FROM embeddings
), mean AS (SELECT n, avg(x) AS m FROM cells GROUP BY n),
d AS (
  SELECT vec_id AS id, label, round(sum((x - m) * (x - m)), 9) AS d
  FROM cells JOIN mean USING (n) GROUP BY ALL
)
SELECT '0' AS query_id, (row_number() OVER (ORDER BY d, id))::INTEGER AS rank, id,
  label::VARCHAR AS chunk_type, round(d, 6) AS distance, round(1 / (1 + d), 6) AS score
FROM d QUALIFY rank <= 25"""

_BANDS = f"""WITH {_PAIRS.format(on="true")}
SELECT query_id, CASE WHEN round(1 / (1 + d), 6) > 0.40 THEN 'high'
  WHEN round(1 / (1 + d), 6) >= 0.20 THEN 'moderate' ELSE 'weak' END AS band, count(*) AS hits
FROM ranked WHERE rank <= 10 GROUP BY ALL"""

# --- documents as chunks and pieces -----------------------------------------

_DOCS = f"""docs AS (
  SELECT *, {_id("relative_path", "package", "NULL", "NULL", "'file'", "1", "line_end", "content_hash", "0")} AS id
  FROM (
    SELECT doc_id, text, length(text) AS size, source || '/' || doc_id AS relative_path, source AS package,
      lang, ({_newlines("text")} + 1)::INTEGER AS line_end, sha256(text) AS content_hash
    FROM documents
  )
)"""


def _pieces(size: int, overlap: int, rows: str = "docs", text: str = "text", start: str = "1") -> str:
    step = size - overlap
    return f"""cut AS (
  SELECT *, unnest(range(CASE WHEN length({text}) <= {size} THEN 1
    ELSE CAST(ceil((length({text}) - {overlap}) / {step}.0) AS BIGINT) END)) AS n FROM {rows}
),
pieces AS (
  SELECT * EXCLUDE (id), length({text}) > {size} AS split,
    CASE WHEN length({text}) > {size} THEN id || '_sub' || n ELSE id END AS id,
    CASE WHEN length({text}) > {size} THEN n::INTEGER END AS sub_index,
    substr({text}, n * {step} + 1, {size}) AS content,
    ({start} + CASE WHEN length({text}) > {size} THEN n * {step} // 100 ELSE 0 END)::INTEGER AS line_from
  FROM cut
)"""


_SPLIT = f"""WITH {_DOCS}, {_pieces(1000, 200)}
SELECT id, sub_index, line_from AS line_start, line_end, content_hash, sha256(content) AS piece_hash, content
FROM pieces"""

_SPLIT_EXACT = f"""WITH {_DOCS}, {_pieces(300, 120)}, placed AS (
  SELECT *, (1 + {_newlines("substr(text, 1, n * 180)")})::INTEGER AS line_at FROM pieces
)
SELECT id, CASE WHEN split THEN line_at ELSE 1 END AS line_start,
  CASE WHEN split THEN (line_at + {_newlines("content")})::INTEGER ELSE line_end END AS line_end,
  sha256(content) AS piece_hash
FROM placed"""

_COUNTERS = """WITH n AS (
  SELECT length(text) > 1000 AS big,
    CASE WHEN length(text) <= 1000 THEN 1 ELSE ceil((length(text) - 200) / 800.0) END::BIGINT AS pieces
  FROM documents
)
SELECT count(*) AS chunks, count(*) FILTER (big) AS oversized, sum(pieces)::BIGINT AS pieces,
  sum(pieces - 1)::BIGINT AS extra_pieces FROM n"""

# --- hashed words -----------------------------------------------------------

_WORD = r"[^\x00-\x20!-/:-@\[-\^`{-\x7f]+"


def _vectors(name: str, source: str, key: str, text: str) -> str:
    return f"""{name}_counts AS (
  SELECT key, ('0x' || substr(md5(word), 1, 8))::UBIGINT % 64 AS place, count(*) AS c
  FROM (SELECT {key} AS key, unnest(regexp_extract_all(lower({text}), '{_WORD}')) AS word FROM {source})
  GROUP BY ALL
),
{name} AS (
  SELECT key, place::INTEGER AS place, (c / sqrt(sum(c * c) OVER (PARTITION BY key)))::FLOAT::DOUBLE AS w
  FROM {name}_counts
),
{name}_norms AS (
  SELECT {key} AS key, coalesce(sum(w * w), 0) AS norm FROM {source} LEFT JOIN {name} ON {key} = {name}.key GROUP BY ALL
)"""


_HASH_EMBED = f"""WITH {_vectors("v", "documents", "doc_id", "text")}
SELECT key AS doc_id, place, round(w, 5) AS weight FROM v"""


def _text_hits(k: int, score: float) -> str:
    return f"""{_DOCS}, {_pieces(1000, 200)},
{_vectors("q", "benchmark", "item_id", "text")},
{_vectors("s", "pieces", "id", "content")},
dots AS (
  SELECT q.key AS query_id, s.key AS id, sum(q.w * s.w) AS dot FROM q JOIN s USING (place) GROUP BY ALL
),
found AS (
  SELECT qn.key AS query_id, sn.key AS id, round(qn.norm + sn.norm - 2 * coalesce(dot, 0), 9) AS d
  FROM q_norms qn CROSS JOIN s_norms sn
  LEFT JOIN dots ON dots.query_id = qn.key AND dots.id = sn.key
),
best AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rank, 1 / (1 + d) AS score FROM found
),
hits AS (
  SELECT best.*, p.relative_path, p.package, p.lang, p.line_from, p.line_end, p.sub_index, p.content
  FROM best JOIN pieces p USING (id) WHERE rank <= {k} AND score >= {score}
)"""


_SEARCH_TEXT = f"""WITH {_text_hits(5, 0)}
SELECT query_id, rank::INTEGER AS rank, id, relative_path, lang AS language, line_from AS line_start, sub_index,
  round(d, 6) AS distance, round(score, 6) AS score FROM hits"""

_HUMAN = f"""WITH {_text_hits(3, 0.5)}, lines AS (
  SELECT query_id, count(*) AS n, string_agg(
    {_NL} || rn || '. Score: ' || printf('%.1f%%', score * 100) || {_NL}
    || '   📁 ' || relative_path || {_NL} || '   📦 Package: ' || package || {_NL}
    || '   📝 Type: file' || {_NL} || '   📍 Lines: ' || line_from || '-' || line_end || {_NL}
    || '   💬 "' || replace(substr(content, 1, 200), {_NL}, ' ')
    || CASE WHEN length(content) > 200 THEN '...' ELSE '' END || '"' || {_NL}, '' ORDER BY rn) AS body
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rn FROM hits) GROUP BY query_id
)
SELECT item_id AS query_id, CASE WHEN n IS NULL THEN 'No results found.'
  ELSE {_NL} || '📊 Found ' || n || ' results:' || {_NL} || {_NL} || body END AS rendered
FROM benchmark LEFT JOIN lines ON item_id = query_id"""

_AGENT = f"""WITH {_text_hits(3, 0.5)}, lines AS (
  SELECT query_id, count(*) AS n, string_agg(
    '## Result ' || rn || {_NL} || {_NL} || '**Location:**' || {_NL} || '- File: `' || relative_path || '`' || {_NL}
    || '- Lines: ' || line_from || '-' || line_end || {_NL} || '- Package: `' || package || '`' || {_NL}
    || '- Type: file' || {_NL} || '- Language: ' || lang || {_NL} || {_NL} || '**Code:**' || {_NL}
    || '```gosu' || {_NL} || content || {_NL} || '```' || {_NL} || {_NL} || '---' || {_NL} || {_NL},
    '' ORDER BY rn) AS body
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rn FROM hits) GROUP BY query_id
)
SELECT item_id AS query_id, CASE WHEN n IS NULL THEN 'No relevant code found in the knowledge base.'
  ELSE '# Retrieved Code Context' || {_NL} || {_NL} || 'Found ' || n || ' relevant code chunks:' || {_NL} || {_NL}
    || '---' || {_NL} || {_NL} || body || {_NL}
    || '**Note:** Use this retrieved context to inform your code generation. '
    || 'Ensure your code aligns with the patterns, naming conventions, and structures shown above.' || {_NL}
  END AS rendered
FROM benchmark LEFT JOIN lines ON item_id = query_id"""

# --- source and template files ----------------------------------------------

_SOURCES = """sources AS (
  SELECT '/corpus/' || source || '/Doc' || doc_id || '.gs' AS path,
    'package corpus.' || lang || chr(10) || chr(10) || 'uses corpus.base.*' || chr(10) || chr(10)
    || 'class Doc' || doc_id || ' {' || chr(10)
    || array_to_string(list_transform(
      string_split(translate(text, '"''\\*', '    '), chr(10)),
      lambda x, i: CASE (i - 1) % 4
        WHEN 0 THEN '  // ' || x || ' {' || chr(10)
        WHEN 1 THEN '  function part' || (i - 1) || '() : String {' || chr(10) || '    return "' || x || '"'
          || chr(10) || '  }' || chr(10)
        WHEN 2 THEN '  property get Part' || (i - 1) || '() : String { /* ' || x || ' } */ return null }' || chr(10)
        ELSE '  class Inner' || (i - 1) || ' {' || chr(10) || '    function run' || (i - 1) || '() { print('''
          || x || ''') }' || chr(10) || '  }' || chr(10) END), '')
    || CASE n_chars % 10 WHEN 0 THEN '' WHEN 1 THEN '}' || chr(10) || '}' || chr(10) ELSE '}' || chr(10) END AS text,
    lang
  FROM documents
)"""

_TOKEN = (
    r'"[^"\\\n]*(?:\\.[^"\\\n]*)*"|'
    r"''[^''\\\n]*(?:\\.[^''\\\n]*)*''|//[^\n]*|(?s:/\*.*?\*/)|[{}]|"
    r"(?:class|interface|enum|enhancement|function)\s+\w+|property\s+(?:get|set)\s+\w+|"
    r"uses\s+[\w.]+\*?|package\s+[\w.]+|construct\s*\(|"
    r"\w+|[^\"''/{}\w]+|[\"''/]"
)

_BLOCKS = f"""{_SOURCES},
tokens AS (
  SELECT path, unnest(t) AS tok, unnest(range(len(t))) AS i
  FROM (SELECT path, regexp_extract_all(text, '{_TOKEN}') AS t FROM sources)
),
places AS (
  SELECT *, sum(length(tok)) OVER w AS stop, sum({_newlines("tok")}) OVER w AS nl,
    sum(CASE tok WHEN '{{' THEN 1 WHEN '}}' THEN -1 ELSE 0 END) OVER w AS depth
  FROM tokens WINDOW w AS (PARTITION BY path ORDER BY i)
),
kinds AS (
  SELECT *, stop - length(tok) AS start, 1 + nl - {_newlines("tok")} AS line,
    CASE WHEN regexp_matches(tok, '^(class|interface|enum|enhancement)\\s') THEN 'class'
      WHEN regexp_matches(tok, '^function\\s') THEN 'function'
      WHEN regexp_matches(tok, '^property\\s') THEN 'property' END AS kind
  FROM places
),
closes AS (
  SELECT *, min(CASE WHEN tok = '}}' THEN i END) OVER (
    PARTITION BY path, depth ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS close_i
  FROM kinds
),
units AS (
  SELECT u.path, u.i, u.kind, regexp_extract(u.tok, '(\\w+)$', 1) AS name, u.start, u.line,
    c.stop AS stop, 1 + c.nl AS last_line
  FROM closes u LEFT JOIN places c ON c.path = u.path AND c.i = u.close_i WHERE u.kind IS NOT NULL
),
scopes AS (
  SELECT u.path, u.i, arg_max(c.name, c.start) AS scope
  FROM units u JOIN units c ON c.path = u.path AND c.kind = 'class' AND c.start < u.start
    AND coalesce(c.stop, 1e15) >= u.stop
  GROUP BY ALL
),
blocks AS (
  SELECT u.path, substr(u.path, 9) AS relative_path, 'corpus.' || s.lang AS package, kind AS chunk_type, name,
    CASE kind WHEN 'class' THEN name END AS class_name, CASE kind WHEN 'class' THEN NULL ELSE name END AS method_name,
    scope AS enclosing_class, u.line::INTEGER AS line_start, u.last_line::INTEGER AS line_end,
    (row_number() OVER (PARTITION BY u.path ORDER BY u.start) - 1)::INTEGER AS chunk_index,
    substr(s.text, (u.start + 1)::BIGINT, (u.stop - u.start)::BIGINT) AS text
  FROM units u JOIN sources s USING (path) LEFT JOIN scopes sc ON sc.path = u.path AND sc.i = u.i
  WHERE u.stop IS NOT NULL
)"""

_BLOCK_ID = _id(
    "relative_path", "package", "class_name", "method_name", "chunk_type", "line_start", "line_end",
    "sha256(text)", "chunk_index",
)

_BLOCKS_CODE = f"""WITH {_BLOCKS}
SELECT {_BLOCK_ID} AS id, path AS absolute_path, package, class_name, method_name, enclosing_class, chunk_type,
  line_start, line_end, chunk_index, sha256(text) AS content_hash FROM blocks"""

_STATEMENTS = f"""WITH {_BLOCKS}, chosen AS (
  SELECT path, 'class_declaration' AS unit_type, 'class' AS chunk_type, name, line::INTEGER AS line_start,
    last_line::INTEGER AS line_end, start FROM units WHERE kind = 'class' AND stop IS NOT NULL
  UNION ALL
  SELECT path, 'uses_statement', 'file', regexp_extract(tok, '^uses\\s+(.*)$', 1), line::INTEGER, line::INTEGER, start
  FROM kinds WHERE regexp_matches(tok, '^uses\\s')
)
SELECT * EXCLUDE (start), (row_number() OVER (PARTITION BY path ORDER BY start) - 1)::INTEGER AS chunk_index
FROM chosen"""

_ISSUES = """issues AS (
  SELECT path, start, line, 'MISSING' AS type, NULL AS text FROM units WHERE stop IS NULL
  UNION ALL
  SELECT path, start, line, 'ERROR', '}' FROM kinds WHERE tok = '}' AND depth < 0
)"""

_BLOCK_ERRORS = f"""WITH {_BLOCKS}, {_ISSUES},
firsts AS (
  SELECT *, count(*) OVER (PARTITION BY path) AS n, row_number() OVER (PARTITION BY path ORDER BY start) AS rn
  FROM issues
)
SELECT path, n::INTEGER AS n_issues, type AS first_type, line::INTEGER AS line,
  (length(string_split(substr(s.text, 1, start::BIGINT), {_NL})[-1]) + 1)::INTEGER AS col,
  coalesce(f.text, substr(s.text, (start + 1)::BIGINT, 200)) AS text
FROM firsts f JOIN sources s USING (path) WHERE rn = 1"""

_TEMPLATES = """templates AS (
  SELECT '/corpus/pages/' || page_id || '.gst' AS path,
    replace(replace(replace(replace(replace(replace(replace(replace(replace(html,
      '<!DOCTYPE html>', '<%@ page %>' || chr(10)), '<script>', '<% '), '</script>', chr(10) || '%>'),
      '<title>', '<%= '), '</title>', ' %>'), '<style>', '<%! '), '</style>', ' %>'),
      '<!-- ', '<%-- '), ' -->', ' --%>') AS text
  FROM pages
)"""


def _region_tokens(source: str, key: str, text: str, pattern: str) -> str:
    return f"""region_tokens AS (
  SELECT {key} AS key, unnest(t) AS tok, unnest(range(len(t))) AS i
  FROM (SELECT {key}, regexp_extract_all({text}, '{pattern}') AS t FROM {source})
),
region_places AS (
  SELECT *, 1 + sum({_newlines("tok")}) OVER (PARTITION BY key ORDER BY i) AS last_line FROM region_tokens
)"""


_REGIONS = f"""{_TEMPLATES}, {_region_tokens(
    "templates", "path", "text",
    r"(?s:<%--.*?--%>)|(?s:<%.*?%>)|\$\{[^}]*\}|[^<$]+|[<$]",
)},
regions AS (
  SELECT key AS path, substr(key, 9) AS relative_path, tok AS text,
    CASE WHEN tok LIKE '<\\%@%' ESCAPE '\\' THEN 'template_directive' ELSE 'template_block' END AS chunk_type,
    (last_line - {_newlines("tok")})::INTEGER AS line_start, last_line::INTEGER AS line_end,
    (row_number() OVER (PARTITION BY key ORDER BY i) - 1)::INTEGER AS chunk_index
  FROM region_places
  WHERE regexp_matches(tok, '(?s)^(<%.*%>|\\$\\{{.*\\}})$') AND NOT starts_with(tok, '<%--')
)"""

_REGION_ID = _id(
    "relative_path", "NULL", "NULL", "NULL", "chunk_type", "line_start", "line_end", "sha256(text)", "chunk_index"
)

_REGIONS_TEMPLATE = f"""WITH {_REGIONS}
SELECT {_REGION_ID} AS id, path AS absolute_path, chunk_type, line_start, line_end, chunk_index, text AS content
FROM regions"""

_REGIONS_HTML = f"""WITH {_region_tokens(
    "pages", "page_id", "html",
    r"<![A-Z]+[^>]*>|(?s:<script>.*?</script>)|(?s:<!--.*?-->)|(?s:<h1>.*?</h1>)|[^<]+|<",
)}, named AS (
  SELECT *, CASE WHEN starts_with(tok, '<!--') THEN 'comment' WHEN starts_with(tok, '<!') THEN 'doctype'
    WHEN starts_with(tok, '<script>') THEN 'script' WHEN starts_with(tok, '<h1>') THEN 'heading' END AS unit_type
  FROM region_places
)
SELECT key AS page_id, (row_number() OVER (PARTITION BY key ORDER BY i) - 1)::INTEGER AS chunk_index, unit_type,
  CASE unit_type WHEN 'doctype' THEN 'template_directive' WHEN 'comment' THEN 'file' ELSE 'template_block' END
    AS chunk_type,
  (last_line - {_newlines("tok")})::INTEGER AS line_start, last_line::INTEGER AS line_end, tok AS content
FROM named WHERE unit_type IS NOT NULL"""

_PACKAGES = f"""WITH {_SOURCES}, {_TEMPLATES}
SELECT '.gs' AS ext, 'gosu' AS language, 'corpus.' || lang AS package, count(*) AS files,
  sum(strlen(text))::BIGINT AS bytes FROM sources GROUP BY ALL
UNION ALL
SELECT '.gst', 'gosu_template', NULL, count(*), sum(strlen(text))::BIGINT FROM templates"""

_ALL_CHUNKS = f"""{_BLOCKS}, {_REGIONS}, all_chunks AS (
  SELECT {_BLOCK_ID} AS id, path, relative_path, package, class_name, method_name, chunk_type,
    'gosu' AS language, line_start, line_end, text FROM blocks
  UNION ALL
  SELECT {_REGION_ID}, path, relative_path, NULL, NULL, NULL, chunk_type, 'gosu_template', line_start, line_end, text
  FROM regions
), {_pieces(1000, 200, "all_chunks", "text", "line_start")}"""

_INGEST_STORE = f"""WITH {_ALL_CHUNKS}
SELECT id, relative_path, package, class_name, method_name, chunk_type, language, line_from AS line_start, line_end,
  sub_index, sha256(content) AS piece_hash FROM pieces"""

_FILE_COUNTS = f"""{_ALL_CHUNKS}, {_ISSUES},
all_files AS (SELECT path, text FROM sources UNION ALL SELECT path, text FROM templates),
file_counts AS (
  SELECT f.path, any_value(sha256(f.text)) AS file_hash, count(p.id) AS n,
    bool_or(f.path IN (SELECT path FROM issues)) AS broken
  FROM all_files f LEFT JOIN pieces p ON p.path = f.path GROUP BY f.path
)"""

_INGEST_LOG = f"""WITH {_FILE_COUNTS}, rows AS (
  SELECT 'first' AS session_id, CASE WHEN n = 0 AND broken THEN 'parse_error' ELSE 'success' END AS status, n
  FROM file_counts
  UNION ALL
  SELECT 'second', CASE WHEN n > 0 THEN 'skipped' WHEN broken THEN 'parse_error' ELSE 'success' END, n
  FROM file_counts
)
SELECT session_id, status, count(*) AS files,
  (CASE WHEN status = 'success' THEN sum(n) END)::BIGINT AS chunks FROM rows GROUP BY session_id, status"""

_INGEST_RATES = f"""WITH {_FILE_COUNTS}
SELECT 'first' AS session_id, count_if(NOT (n = 0 AND broken)) AS files_processed,
  sum(CASE WHEN NOT (n = 0 AND broken) THEN n ELSE 0 END)::BIGINT AS chunks_created,
  count_if(n = 0 AND broken) AS errors, true AS timed, true AS rated FROM file_counts"""

_STORED = """package, class_name, method_name, chunk_type, language, line_start, line_end, sub_index, piece_hash"""

_INGEST_DISK = f"SELECT relative_path, {_STORED} FROM ({_INGEST_STORE}) s"

_INGEST_HIDDEN = f"""SELECT regexp_replace(relative_path, '/([^/]*)$', '/_\\1') AS relative_path, {_STORED}
FROM ({_INGEST_STORE}) s"""

_INGEST_MANIFEST = f"""WITH {_FILE_COUNTS}
SELECT path, file_hash, n AS chunk_count FROM file_counts WHERE n > 0"""

# --- changes ----------------------------------------------------------------

_KNOWN = """files AS (
  SELECT 'doc/' || doc_id AS path, doc_id, sha256(text) AS file_hash, 1700000000 + n_chars AS t, length(text) AS size
  FROM documents
),
manifest AS (
  SELECT path, CASE quality WHEN 0 THEN 'old' ELSE file_hash END AS file_hash,
    CASE toxic WHEN 1 THEN 1600000000 ELSE t END AS t, 1 AS chunk_count
  FROM files JOIN labels USING (doc_id)
  UNION ALL SELECT url, 'page', 1600000000, 2 FROM pages
)"""


def _changes(differs: str) -> str:
    return f"""WITH {_KNOWN}
SELECT coalesce(f.path, m.path) AS path, CASE WHEN m.path IS NULL THEN 'new' WHEN f.path IS NULL THEN 'deleted'
  WHEN {differs} THEN 'changed' ELSE 'unchanged' END AS status
FROM files f FULL JOIN manifest m ON f.path = m.path"""


_UPDATE = f"""WITH {_KNOWN}
SELECT f.path, f.file_hash, CASE WHEN m.file_hash = f.file_hash THEN m.chunk_count
  WHEN size <= 1000 THEN 1 ELSE ceil((size - 200) / 800.0) END::BIGINT AS chunk_count
FROM files f LEFT JOIN manifest m ON f.path = m.path"""

_UPSERT = """SELECT doc_id AS id, sha256(CASE WHEN toxic = 1 THEN 'third ' || text WHEN toxic = 0 THEN 'second ' || text
  ELSE text END) AS content_hash, CASE WHEN toxic = 1 THEN 3 WHEN toxic = 0 THEN 2 ELSE 1 END AS version
FROM documents LEFT JOIN labels USING (doc_id)"""

_STORE_MERGE = f"""WITH {_DOCS}
SELECT id, CASE WHEN l.doc_id IS NULL THEN 1.0 ELSE 2.0 END::DOUBLE AS before,
  CASE WHEN l.doc_id IS NULL THEN 1.0 ELSE 2.0 END::DOUBLE AS after
FROM docs LEFT JOIN labels l USING (doc_id)"""

_REPLACE = """WITH d AS (
  SELECT doc_id AS id, source || '/' || lang AS absolute_path,
    doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS hit
  FROM documents
), r AS (SELECT *, bool_or(hit) OVER (PARTITION BY absolute_path) AS replaced FROM d)
SELECT absolute_path, id, CASE WHEN hit THEN 2 ELSE 1 END AS version FROM r WHERE hit OR NOT replaced"""

# --- run log ----------------------------------------------------------------

_MESSAGE_LIST = "[" + ", ".join("'" + m.replace("'", "''") + "'" for m in MESSAGES) + "]"

_MESSAGES = f"""messages AS (
  SELECT *, ({_MESSAGE_LIST})[(regexp_extract(props, '"k": *([0-9]+)', 1)::INTEGER) % {len(MESSAGES)} + 1]
    AS error_message FROM events
)"""

_LOG = f"""{_MESSAGES},
log AS (
  SELECT ts, strftime(ts, '%Y-%m-%d') AS session_id, '/corpus/user' || user_id || '/' || event_id AS file_path,
    'user' || user_id || '/' || event_id AS relative_path,
    CASE event_type WHEN 'view' THEN 'success' WHEN 'click' THEN 'skipped' WHEN 'signup' THEN 'parse_error'
      WHEN 'purchase' THEN 'embedding_error' ELSE 'unknown_error' END AS status,
    CASE event_type WHEN 'view' THEN floor(value)::BIGINT END AS chunk_count,
    CASE WHEN event_type NOT IN ('view', 'click') THEN error_message END AS error_message
  FROM messages
),
latest AS (SELECT * FROM log WHERE session_id = (SELECT session_id FROM log ORDER BY ts DESC LIMIT 1))"""

_RUN_RESULT = f"""WITH {_LOG}, s AS (
  SELECT session_id, count(*) FILTER (status = 'success') AS files_processed,
    count(*) FILTER (status = 'skipped') AS files_skipped,
    coalesce(sum(chunk_count), 0)::BIGINT AS chunks_created,
    count(*) FILTER (status NOT IN ('success', 'skipped')) AS errors,
    (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS s
  FROM log GROUP BY session_id
)
SELECT * EXCLUDE (s), round(s, 6) AS seconds, round(chunks_created / files_processed, 6) AS chunks_per_file,
  round(chunks_created / s, 6) AS chunks_per_second FROM s"""

_TRIAGE = f"""WITH {_MESSAGES}, m AS (SELECT event_id, error_message, lower(error_message) AS t FROM messages)
SELECT event_id, error_message, CASE
  WHEN contains(t, 'maximum context length') OR contains(t, 'token') THEN 'token_limit'
  WHEN contains(t, 'rate limit') OR contains(t, '429') THEN 'rate_limit'
  WHEN contains(t, 'parse') OR contains(t, 'syntax') THEN 'parse_error'
  WHEN contains(t, 'chunk') THEN 'chunk_error' WHEN contains(t, 'embed') THEN 'embedding_error'
  WHEN contains(t, 'chroma') OR contains(t, 'upsert') THEN 'storage_error' ELSE 'unknown_error' END AS status
FROM m"""

_REPORT = f"""WITH {_LOG}, sums AS (SELECT session_id, status, count(*) AS n FROM log GROUP BY ALL)
SELECT session_id, 'log' AS section, file_path AS name, status, chunk_count AS n FROM log
UNION ALL
SELECT session_id, 'head', session_id, min(status), arg_min(n, status)::BIGINT FROM sums GROUP BY session_id"""

_ORACLE = {
    "search_topk": _knn(10),
    "search_block": _knn(10),
    "search_pruned": f"""WITH gathered AS (
  SELECT vec_id, label, list_transform(embedding, lambda x, i: (x::DOUBLE / 4
    + CASE WHEN i - 1 = (label * 7) % len(embedding) THEN 3.0::DOUBLE ELSE 0.0 END)::FLOAT) AS embedding FROM embeddings
), {_PAIRS.format(on="true").replace("embeddings", "gathered")}
SELECT query_id, rank::INTEGER AS rank, id, label::VARCHAR AS chunk_type, round(d, 6) AS distance, round(1 / (1 + d), 6) AS score,
  true AS spared
FROM ranked WHERE rank <= 10""",
    "search_filtered": _knn(10, on="q.label = s.label"),
    "search_min_score": _knn(20, where="1 / (1 + d) >= 0.42", label=False),
    "search_single": _SINGLE,
    "search_text": _SEARCH_TEXT,
    "relevance_bands": _BANDS,
    "filter_metadata": f"""WITH {_DOCS} SELECT id, relative_path, lang AS language, package FROM docs
WHERE lang = 'en' AND package = 'src1' AND contains(relative_path, 'c1/1')""",
    "render_human": _HUMAN,
    "render_agent": _AGENT,
    "split_documents": _SPLIT,
    "split_exact_lines": _SPLIT_EXACT,
    "split_counters": _COUNTERS,
    "chunk_ids": f"WITH {_DOCS} SELECT id, relative_path, content_hash, line_end FROM docs",
    "blocks_code": _BLOCKS_CODE,
    "blocks_statements": _STATEMENTS,
    "block_errors": _BLOCK_ERRORS,
    "regions_template": _REGIONS_TEMPLATE,
    "regions_html": _REGIONS_HTML,
    "file_packages": _PACKAGES,
    "file_stats": """SELECT '.gs' AS ext, count(*) AS files FROM documents
UNION ALL SELECT '.gst', count(*) FROM pages""",
    "hash_embed": _HASH_EMBED,
    "embed_udf": f"""SELECT doc_id, length(text)::DOUBLE AS chars, {_newlines("text")}::DOUBLE AS lines,
  (length(text) - length(replace(text, ' ', '')))::DOUBLE AS blanks FROM documents""",
    "attach_vectors": f"WITH {_DOCS} SELECT id, size::DOUBLE AS chars, line_end::DOUBLE AS lines FROM docs",
    "detect_changes": _changes("f.file_hash <> m.file_hash"),
    "detect_changes_mtime": _changes("f.t > m.t"),
    "update_manifest": _UPDATE,
    "chunks_per_file": f"""WITH {_DOCS}, {_pieces(1000, 200)}
SELECT '/corpus/' || relative_path AS path, count(*) AS chunk_count FROM pieces GROUP BY ALL""",
    "upsert_latest": _UPSERT,
    "store_merge": _STORE_MERGE,
    "replace_files": _REPLACE,
    "log_summary": f"""WITH {_LOG} SELECT session_id, CASE WHEN grouping(status) = 1 THEN 'TOTAL' ELSE status END AS status,
  count(*) AS files, coalesce(sum(chunk_count), 0)::BIGINT AS chunks
FROM log GROUP BY GROUPING SETS ((session_id, status), (session_id))""",
    "log_session_summary": f"""WITH {_LOG} SELECT session_id, status, count(*) AS files,
  sum(chunk_count)::BIGINT AS chunks FROM log GROUP BY ALL""",
    "log_latest": f"WITH {_LOG} SELECT DISTINCT session_id FROM latest",
    "log_errors": f"""WITH {_LOG} SELECT ts, session_id, file_path, status, error_message FROM latest
WHERE status NOT IN ('success', 'skipped') ORDER BY ts DESC, file_path LIMIT 100""",
    "log_parse_errors": f"""WITH {_LOG} SELECT ts, file_path, error_message FROM latest
WHERE status = 'parse_error'""",
    "log_sessions": f"""WITH {_LOG} SELECT session_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS rows
FROM log GROUP BY session_id""",
    "log_session_rows": f"WITH {_LOG} SELECT * FROM latest",
    "run_result": _RUN_RESULT,
    "error_triage": _TRIAGE,
    "error_files": """SELECT doc_id, source, sha256(text) AS hash FROM documents
WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)""",
    "error_tree": """SELECT source || '/' || lang || '/' || doc_id || '.gs' AS relative_path, octet_length(encode(text))::BIGINT AS length,
  sha256(text) AS hash FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)""",
    "report_json": _REPORT,
    "ingest_store": _INGEST_STORE,
    "ingest_log": _INGEST_LOG,
    "ingest_manifest": _INGEST_MANIFEST,
    "ingest_rates": _INGEST_RATES,
    "store_counts": f"""WITH {_DOCS}, {_pieces(1000, 200)}
SELECT 'pieces' AS name, count(*) AS rows, least(count(*), 3) AS samples FROM pieces UNION ALL SELECT 'none', 0, 0""",
    "collections_list": """SELECT lang AS collection, count(*) AS rows, lang AS language, count(DISTINCT source) AS sources,
  true AS several_files FROM documents GROUP BY lang""",
    "own_chunker": """SELECT relative_path, sha256(lines[i]) AS hash, i AS line FROM (
  SELECT source || '/' || doc_id AS relative_path, lines, unnest(range(1, len(lines) + 1)) AS i
  FROM (SELECT source, doc_id, string_split(text, chr(10)) AS lines FROM documents))""",
    "own_chunker_sql": """SELECT relative_path, sha256(lines[i]) AS hash, i AS line FROM (
  SELECT source || '/' || doc_id AS relative_path, lines, unnest(range(1, len(lines) + 1)) AS i
  FROM (SELECT source, doc_id, string_split(text, chr(10)) AS lines FROM documents))""",
    "replace_on_disk": """WITH d AS (
  SELECT source || '/' || lang AS absolute_path, source || '/' || doc_id AS relative_path,
    doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS hit
  FROM documents
), r AS (SELECT *, bool_or(hit) OVER (PARTITION BY absolute_path) AS replaced FROM d)
SELECT absolute_path, relative_path, CASE WHEN hit THEN 2 ELSE 1 END AS before, CASE WHEN hit THEN 2 ELSE 1 END AS after
FROM r WHERE hit OR NOT replaced""",
    "ingest_stream_edits": f"""WITH marked AS (
  SELECT doc_id || '.gs' AS name, '' AS id, CASE WHEN toxic = 1 THEN 'edited ' || text ELSE text END AS text,
    quality IS NOT NULL AS early, quality IS NULL OR toxic = 1 OR quality = 1 AS late, toxic = 1 AS edited
  FROM documents LEFT JOIN labels USING (doc_id)
), present AS (SELECT * FROM marked WHERE late), {_pieces(1000, 200, rows="present")}, stored AS (
  SELECT name, count(*) AS n, sha256(string_agg(h, '' ORDER BY h)) AS hash FROM (SELECT name, sha256(content) AS h FROM pieces) GROUP BY 1
)
SELECT name, n AS pieces, hash, n AS recorded,
  CASE WHEN early AND edited THEN 'success success' WHEN early AND late THEN 'success skipped' ELSE 'success' END AS outcomes
FROM marked LEFT JOIN stored USING (name)""",
    "ingest_disk": _INGEST_DISK,
    "ingest_hidden": _INGEST_HIDDEN,
    "ingest_tree": f"""SELECT source, sum({_newlines("text")} + 1)::BIGINT AS lines,
  sum(length(text) - {_newlines("text")})::BIGINT AS chars FROM documents GROUP BY source""",
    "ingest_stream": f"""WITH {_DOCS}, {_pieces(1000, 200)}
SELECT id, relative_path, sub_index, line_from AS line_start, sha256(content) AS piece_hash FROM pieces""",
}


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)
