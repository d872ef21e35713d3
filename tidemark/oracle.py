"""DuckDB SQL of the registered queries, on the same tables and column names."""

from __future__ import annotations

EV = """ev AS (SELECT event_id AS id, user_id AS file_id,
  CASE event_type WHEN 'signup' THEN 'created' WHEN 'error' THEN 'deleted' WHEN 'purchase' THEN 'renamed' ELSE 'modified' END AS kind,
  epoch_us(ts) // 1000 AS at_unix_ms, regexp_extract(props, '"k": *([0-9]+)', 1)::BIGINT AS size_bytes FROM events)"""
WORDS = r"len(regexp_extract_all(coalesce({0}, ''), '[^\s\x0B\x{{85}}\p{{Z}}]+'))::BIGINT"
FM = f"""fm AS (SELECT doc_id AS file_id, CASE WHEN n_chars < 300 THEN 'text' WHEN n_chars < 2000 THEN 'docx' ELSE 'pdf' END AS doc_type,
  source AS author, lang AS language, {WORDS.format('text')} AS word_count, text[:8000] AS body_text,
  CASE WHEN doc_id % 4 < 2 THEN 1 ELSE 2 END AS extractor_version FROM documents)"""
FE = """fe AS (SELECT doc_id AS file_id, CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'good' ELSE 'junk' END AS classification,
  (doc_id % 3)::INTEGER AS enrichment_version FROM labels)"""
PP = r"""pp AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', '/'), '[?#].*$', '') AS path FROM pages)"""
#: Nodes of the page tree: every prefix of every path, with its parent's path.
TREE = PP + r""",
parts AS (SELECT page_id, list_filter(string_split(path, '/'), lambda p: p <> '' AND p <> '.') AS p FROM pp),
nodes AS (SELECT DISTINCT '/' || array_to_string(p[:n], '/') AS path, p[n] AS name, CASE WHEN n > 1 THEN '/' || array_to_string(p[:n - 1], '/') END AS parent
  FROM (SELECT p, unnest(range(1, len(p) + 1)) AS n FROM parts))"""
TREE2 = """tree2 AS (SELECT r_regionkey::BIGINT AS id, NULL::BIGINT AS parent_id, r_name AS name FROM region
  UNION ALL SELECT n_nationkey + 1000, n_regionkey, n_name FROM nation UNION ALL SELECT c_custkey + 1000000, c_nationkey + 1000, c_name FROM customer),
resolved AS (WITH RECURSIVE walk AS (SELECT id, '/' || name AS path FROM tree2 WHERE parent_id IS NULL
  UNION ALL SELECT t.id, w.path || '/' || t.name FROM tree2 t JOIN walk w ON t.parent_id = w.id) SELECT id, path FROM walk)"""
SNAP = """snap_old AS (SELECT '/' || source || '/' || lang || '/' || doc_id AS path, n_chars AS size_bytes, doc_id * 60 AS mtime_unix, doc_id FROM documents WHERE doc_id % 10 <> 0),
snap_new AS (SELECT '/' || source || '/' || lang || '/' || doc_id AS path, n_chars + (CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END) AS size_bytes, doc_id * 60 AS mtime_unix, doc_id FROM documents WHERE doc_id % 7 <> 0)"""
QUEUE = "queue AS (SELECT doc_id AS file_id, doc_id * 7919 % 10007 AS queued_at_unix, (doc_id % 7)::INTEGER AS attempt_count FROM documents)"
EMB = """q AS (SELECT embedding AS e FROM embeddings ORDER BY vec_id LIMIT 1),
scored AS (SELECT vec_id AS file_id,
  list_sum(list_transform(range(1, 65), lambda i: ((embedding[i] >= 0) <> (e[i] >= 0))::INTEGER))::INTEGER AS h,
  sqrt(list_sum(list_transform(range(1, 65), lambda i: (embedding[i]::DOUBLE - e[i]::DOUBLE) ** 2))) AS d FROM embeddings, q)"""
HALVES = """halves AS (SELECT id, file_id AS tracker, id % 2 = 0 AS is_source, at_unix_ms AS t FROM ev WHERE kind = 'renamed'),
linked AS (SELECT *, coalesce(lag(is_source) OVER o <> is_source AND t - lag(t) OVER o <= 21600000, false) AS l FROM halves WINDOW o AS (PARTITION BY tracker ORDER BY t, id)),
runs AS (SELECT *, sum(CASE WHEN l THEN 0 ELSE 1 END) OVER (PARTITION BY tracker ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS run FROM linked),
placed AS (SELECT *, row_number() OVER (PARTITION BY tracker, run ORDER BY t, id) AS k FROM runs),
mated AS (SELECT a.*, b.id AS next_id, b.t AS next_t FROM placed a LEFT JOIN placed b ON a.tracker = b.tracker AND a.run = b.run AND a.k % 2 = 1 AND b.k = a.k + 1)"""
PAIRS = "SELECT tracker, CASE WHEN is_source THEN id ELSE next_id END AS from_id, CASE WHEN is_source THEN next_id ELSE id END AS to_id, next_t AS t FROM mated WHERE next_id IS NOT NULL"
#: One file per source and language, with its documents' texts as lines.
LAID_OUT = """laid AS (SELECT 'source=' || coalesce(source, '__HIVE_DEFAULT_PARTITION__') || '/lang=' || coalesce(lang, '__HIVE_DEFAULT_PARTITION__') AS folder,
  string_agg(coalesce(text, ''), chr(10) ORDER BY doc_id) || chr(10) AS t FROM documents GROUP BY source, lang)"""
#: Letter triples of all words, and each language's commonest 300.
LANGUAGE = r"""WITH words AS (SELECT doc_id, lang, length(regexp_replace(regexp_replace(text, '^[\s\x0B\x{85}\p{Z}]+', ''), '[\s\x0B\x{85}\p{Z}]+$', '')) >= 40 AS long, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS w FROM documents),
grams AS (SELECT doc_id, lang, long, (' ' || w || ' ')[k:k + 2] AS gram FROM (SELECT *, unnest(range(1, length(w) + 1)) AS k FROM words)),
profiles AS (SELECT * FROM (SELECT lang, gram, (row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, gram))::INTEGER AS rank FROM grams WHERE lang IS NOT NULL GROUP BY lang, gram) WHERE rank <= 300)
"""
#: Raw watch events, and what they come to once halves are paired and paths are quiet.
WATCH = """w AS (SELECT *, CASE WHEN mode = 'both' THEN '/f' || (user_id + 1 + id % 3) END AS to_path, '/f' || (CASE WHEN mode = 'to' THEN user_id + 1 ELSE user_id END) AS path,
    CASE WHEN mode IN ('from', 'to') AND id % 11 <> 0 THEN user_id END AS tracker
  FROM (SELECT event_id AS id, user_id, epoch_us(ts) // 1000 AS ms, CASE WHEN event_type = 'purchase' THEN CASE WHEN event_id % 5 = 0 THEN 'both' WHEN event_id % 2 = 0 THEN 'from' ELSE 'to' END
    WHEN event_type = 'error' THEN 'removed' WHEN event_type = 'view' THEN 'access' ELSE 'touched' END AS mode FROM events)),
linked AS (SELECT *, coalesce(lag(mode) OVER o <> mode AND ms - lag(ms) OVER o <= 21600000, false) AS l FROM w WHERE tracker IS NOT NULL WINDOW o AS (PARTITION BY tracker ORDER BY ms, id)),
runs AS (SELECT *, sum(CASE WHEN l THEN 0 ELSE 1 END) OVER (PARTITION BY tracker ORDER BY ms, id ROWS UNBOUNDED PRECEDING) AS run FROM linked),
placed AS (SELECT *, row_number() OVER (PARTITION BY tracker, run ORDER BY ms, id) AS k FROM runs),
mates AS (SELECT a.mode, a.path AS p1, b.path AS p2, b.ms, b.id, a.id AS first_id FROM placed a JOIN placed b ON a.tracker = b.tracker AND a.run = b.run AND a.k % 2 = 1 AND b.k = a.k + 1),
every AS (
  SELECT coalesce(to_path, path) AS path, ms, id, CASE WHEN mode = 'both' THEN 'renamed' WHEN mode IN ('removed', 'from') THEN 'removed' ELSE 'touched' END AS change, CASE WHEN mode = 'both' THEN path END AS from_path
    FROM w WHERE mode <> 'access' AND tracker IS NULL
  UNION ALL SELECT path, ms, id, NULL, NULL FROM w WHERE mode = 'both'
  UNION ALL SELECT CASE WHEN mode = 'from' THEN p2 ELSE p1 END, ms, id, 'renamed', CASE WHEN mode = 'from' THEN p1 ELSE p2 END FROM mates
  UNION ALL SELECT CASE WHEN mode = 'from' THEN p1 ELSE p2 END, ms, id, NULL, NULL FROM mates
  UNION ALL SELECT path, ms + 21600000, id, CASE WHEN mode = 'from' THEN 'removed' ELSE 'touched' END, NULL FROM placed WHERE id NOT IN (SELECT id FROM mates UNION ALL SELECT first_id FROM mates)),
settled AS (SELECT path, ms + 3600000 AS at_ms, id, change, from_path
  FROM (SELECT *, lead(ms) OVER (PARTITION BY path ORDER BY ms, id) AS next_at FROM every) WHERE coalesce(next_at - ms >= 3600000, true) AND change IS NOT NULL)"""
#: Renames in their order: who is at a path follows from the rename that touched it last.
CHAINS = """state AS (SELECT DISTINCT user_id AS id, '/f' || user_id AS path, CASE WHEN user_id % 5 = 0 THEN 1 END AS deleted_at FROM events),
moves AS (SELECT * FROM (SELECT event_id AS seq, '/f' || user_id AS from_path, CASE WHEN event_id % 13 > 0 THEN '/f' || (user_id + event_id % 4 - 1) END AS to_path, epoch_us(ts) // 1000 AS at_ms
  FROM events WHERE event_type IN ('purchase', 'click')) WHERE to_path IS DISTINCT FROM from_path),
touches AS (SELECT seq, from_path AS path, false AS reaches FROM moves UNION ALL SELECT seq, to_path, true FROM moves WHERE to_path IS NOT NULL),
lasts AS (SELECT *, lag(seq) OVER o AS pseq, lag(reaches) OVER o AS preaches FROM touches WINDOW o AS (PARTITION BY path ORDER BY seq)),
met AS (SELECT l.*, CASE WHEN pseq IS NULL THEN s.id END AS known FROM lasts l LEFT JOIN state s ON s.path = l.path AND s.deleted_at IS NULL),
both_sides AS (SELECT m.*, CASE WHEN f.preaches THEN f.pseq END AS fseq, f.known AS fknown, CASE WHEN t.preaches THEN t.pseq END AS tseq, t.known AS tknown
  FROM moves m JOIN met f ON f.seq = m.seq AND NOT f.reaches LEFT JOIN met t ON t.seq = m.seq AND t.reaches),
nodes AS (SELECT seq, CASE WHEN fseq IS NOT NULL THEN fseq WHEN fknown IS NOT NULL THEN NULL ELSE tseq END AS up, coalesce(fknown, tknown) AS id FROM both_sides WHERE to_path IS NOT NULL),
occupants AS (WITH RECURSIVE o AS (SELECT seq, id, CASE WHEN id IS NULL THEN seq END AS born FROM nodes WHERE up IS NULL UNION ALL SELECT n.seq, o.id, o.born FROM nodes n JOIN o ON n.up = o.seq) SELECT * FROM o),
traced AS (SELECT b.*, coalesce(f.id, fknown) AS mid, f.born AS mborn, coalesce(t.id, tknown) AS vid, t.born AS vborn, f.seq IS NOT NULL OR fknown IS NOT NULL AS moved, t.seq IS NOT NULL OR tknown IS NOT NULL AS taken
  FROM both_sides b LEFT JOIN occupants f ON f.seq = b.fseq LEFT JOIN occupants t ON t.seq = b.tseq),
told AS (
  SELECT seq, mid AS id, mborn AS born, from_path AS path, 'deleted' AS kind, NULL AS previous_path, at_ms FROM traced WHERE moved AND to_path IS NULL
  UNION ALL SELECT seq, vid, vborn, to_path, 'deleted', NULL, at_ms FROM traced WHERE moved AND to_path IS NOT NULL AND taken
  UNION ALL SELECT seq, mid, mborn, to_path, 'renamed', from_path, at_ms FROM traced WHERE moved AND to_path IS NOT NULL
  UNION ALL SELECT seq, NULL, seq, to_path, 'created', NULL, at_ms FROM traced WHERE NOT moved AND to_path IS NOT NULL AND NOT taken),
ends AS (SELECT id, born, arg_max(path, seq) AS path, CASE WHEN arg_max(kind, seq) = 'deleted' THEN max(at_ms) END AS gone FROM told GROUP BY id, born)"""
BURSTS = """ordered AS (SELECT *, CASE WHEN at_unix_us - lag(at_unix_us) OVER o <= 21600000000 THEN 0 ELSE 1 END AS fresh FROM raw WINDOW o AS (PARTITION BY file_id ORDER BY at_unix_us, id)),
marked AS (SELECT *, sum(fresh) OVER (PARTITION BY file_id ORDER BY at_unix_us, id ROWS UNBOUNDED PRECEDING) AS burst FROM ordered),
bursts AS (SELECT file_id, arg_max(kind, (at_unix_us, id)) AS kind, count(*) AS n, max(at_unix_us) // 1000 AS last_ms, min(at_unix_us) // 1000 AS first_ms, max(at_unix_us) AS last_us FROM marked GROUP BY file_id, burst)"""


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


def _timeline(where: str = "true", limit: int = 50) -> str:
    return _with(EV, FM, FE) + (
        "SELECT e.*, m.doc_type, m.author, m.language, m.word_count, f.classification FROM ev e LEFT JOIN fm m ON e.file_id = m.file_id LEFT JOIN fe f ON e.file_id = f.file_id"
        f" WHERE {where} ORDER BY e.at_unix_ms DESC, e.id DESC LIMIT {limit}"
    )


def _facet(field: str, view: str) -> str:
    return _with(FM, FE) + f"SELECT {field} AS value, count(*) AS count FROM {view} WHERE {field} IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50"


#: The first 8 KiB of each content, as hex digits.
HEADS = """heads AS (SELECT doc_id, substr(hex(from_hex((['25504446', 'FFD8FF', '49492A00', '504B0304', '00'])[doc_id % 5 + 1]) || encode(coalesce(text, ''))), 1, 16384) AS head FROM documents)"""

NAMES = """names AS (SELECT doc_id, text, CASE WHEN doc_id % 13 = 0 THEN '.' || source ELSE doc_id || CASE WHEN doc_id % 9 = 8 THEN '' ELSE '.' || (['txt', 'PDF', 'docx', 'XLSX', 'pptx', 'jpg', 'html', 'gz'])[doc_id % 8 + 1] END END AS name FROM documents),
exts AS (SELECT *, nullif(lower(regexp_extract(name, '[^/]\\.([^./]*)$', 1)), '') AS extension FROM names),
typed AS (SELECT *, CASE WHEN extension IN ('txt', 'html') THEN 'text' WHEN extension IN ('pdf', 'docx', 'xlsx', 'pptx') THEN extension ELSE 'unknown' END AS doc_type FROM exts)"""
LIVE_FILES = TREE + """,
files AS (SELECT n.*, EXISTS (SELECT 1 FROM nodes c WHERE c.parent = n.path) AS is_dir FROM nodes n)"""
STATE = SNAP + ", state AS (SELECT path, size_bytes, mtime_unix, CASE WHEN doc_id % 4 = 0 THEN doc_id * 100 END AS deleted_at FROM snap_old)"
DIFF = """SELECT n.path, CASE WHEN o.path IS NULL THEN 'created' ELSE 'modified' END AS kind, n.size_bytes FROM snap_new n LEFT JOIN snap_old o ON n.path = o.path
  WHERE o.path IS NULL OR n.size_bytes IS DISTINCT FROM o.size_bytes OR n.mtime_unix IS DISTINCT FROM o.mtime_unix"""
HALF_QUEUE = "hq AS (SELECT doc_id AS file_id, 1::BIGINT AS queued_at_unix, 3 AS attempt_count FROM documents WHERE doc_id % 15 = 0)"
REQUEUE = """fm5 AS (SELECT * FROM fm WHERE file_id % 5 <> 0),
rq AS (SELECT file_id, 'stale' AS reason FROM fm5 WHERE extractor_version < 2
  UNION ALL SELECT doc_id, 'never' FROM documents d WHERE NOT EXISTS (SELECT 1 FROM fm5 WHERE fm5.file_id = d.doc_id) AND NOT EXISTS (SELECT 1 FROM hq WHERE hq.file_id = d.doc_id))"""
PENDING = "pend AS (SELECT * FROM queue WHERE attempt_count < 5 ORDER BY queued_at_unix, file_id LIMIT 16)"
RENAMES = """st AS (SELECT doc_id AS id, '/f/' || doc_id AS path, CASE WHEN doc_id % 11 = 0 THEN 1::BIGINT END AS deleted_at FROM documents WHERE doc_id % 7 <> 0),
ren AS (SELECT '/f/' || doc_id AS from_path, CASE WHEN doc_id % 4 = 0 THEN '/f/' || (doc_id + 1) WHEN doc_id % 4 = 2 THEN '/g/' || doc_id END AS to_path FROM documents WHERE doc_id % 4 IN (0, 2) OR doc_id % 12 = 3),
told0 AS (SELECT s.*, r.to_path, s.deleted_at IS NULL AND r.from_path IS NOT NULL AS moves, s.deleted_at IS NULL AND r.from_path IS NULL AND EXISTS (SELECT 1 FROM ren x WHERE x.to_path = s.path) AS displaced
  FROM st s LEFT JOIN ren r ON r.from_path = s.path AND s.deleted_at IS NULL),
told AS (SELECT *, displaced OR (moves AND to_path IS NULL) AS gone FROM told0)"""
CIVIL = """SELECT id, CASE WHEN s IS NULL THEN NULL ELSE s END AS seconds FROM (SELECT id,
  date_diff('day', DATE '1970-01-01', make_date((1950 + id % 150)::BIGINT, (1 + id % 12)::BIGINT, 1::BIGINT)) * 86400 + (id % 31) * 86400 + (id % 24) * 3600 + (id % 60) * 60 + id % 61 AS s FROM ev)"""


def _label(value: str, fixed: bool) -> str:
    cases = f"WHEN {value} < 1024 THEN {value} || ' B' "
    for power, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        x = f"({value} / {float(1024**power)!r}::DOUBLE)"
        text = f"printf('%.1f', {x})" if fixed else f"CASE WHEN {x} < 10 THEN printf('%.1f', floor({x} * 10 + 0.5) / 10) ELSE (floor({x} + 0.5))::BIGINT::VARCHAR END"
        when = f"WHEN {value} < {1024 ** (power + 1)} THEN" if unit != "TiB" else "ELSE"
        cases += f"{when} ({text}) || ' {unit}' "
    return f"CASE {cases} END"


SIZE = "(n_chars * n_chars * n_chars * (doc_id % 5))::BIGINT"
SECOND = "(((at_unix_ms - CASE WHEN id % 2 = 0 THEN 4000000000123 ELSE 0 END) / 1000.0::DOUBLE))"
SECOND = f"((floor({SECOND})::BIGINT % 86400 + 86400) % 86400)"
NORMAL = r"""lower_bound AS (SELECT page_id, string_split(path || '/./a//../' || CASE WHEN page_id % 3 = 0 THEN '../../../../x' ELSE 'b' END, '/') AS p FROM pp),
steps AS (SELECT page_id, p, 1 AS i, []::VARCHAR[] AS acc FROM lower_bound
  UNION ALL SELECT page_id, p, i + 1, CASE WHEN p[i] IN ('', '.') THEN acc WHEN p[i] = '..' THEN acc[:greatest(len(acc) - 1, 0)] ELSE list_append(acc, p[i]) END FROM steps WHERE i <= len(p))"""

ORACLE_SQL: dict[str, str] = {
    "tl_default": _timeline(),
    "tl_all_filters": _timeline("e.id < 9000 AND kind = 'modified' AND doc_type = 'pdf' AND author = 'src1' AND language = 'en' AND classification = 'good'", 500),
    "tl_kind": _timeline("kind = 'created'"),
    "tl_doc_type": _timeline("doc_type = 'docx'"),
    "tl_author": _timeline("author = 'src3'"),
    "tl_language": _timeline("language = 'de'"),
    "tl_classification": _timeline("classification = 'good'"),
    "tl_before_id": _timeline("e.id < 500"),
    "tl_null_metadata_excluded": _timeline("doc_type = 'text'", 500),
    "tl_limit_clamp_zero": _timeline(limit=1),
    "tl_limit_clamp_huge": _timeline(limit=500),
    "tl_git_branch": _with(EV, FM, FE)
    + "SELECT e.*, m.doc_type, m.author, m.language, m.word_count, 'main' AS git_branch, f.classification FROM ev e JOIN fm m ON e.file_id = m.file_id LEFT JOIN fe f ON e.file_id = f.file_id WHERE m.file_id % 2 = 0 ORDER BY e.at_unix_ms DESC, e.id DESC LIMIT 50",
    "tl_paths": _with(EV, TREE2)
    + "SELECT e.id, e.file_id + 1000001 AS file_id, e.kind, e.at_unix_ms, coalesce(r.path, '') AS path FROM (SELECT * FROM ev ORDER BY at_unix_ms DESC, id DESC LIMIT 50) e LEFT JOIN resolved r ON r.id = e.file_id + 1000001",
    "tl_page2": _with(EV, "p1 AS (SELECT id, at_unix_ms FROM ev ORDER BY at_unix_ms DESC, id DESC LIMIT 50)")
    + "SELECT * FROM ev WHERE id < (SELECT id FROM p1 ORDER BY at_unix_ms, id LIMIT 1) ORDER BY at_unix_ms DESC, id DESC LIMIT 50",
    "tl_cursor": _with(EV, "p1 AS (SELECT id, at_unix_ms FROM ev ORDER BY at_unix_ms DESC, id DESC LIMIT 50)") + "SELECT id AS next_before_id FROM p1 ORDER BY at_unix_ms, id LIMIT 1",
    "rename_previous_path": _with(EV, TREE2)
    + """SELECT e.id, e.file_id + 1000001 AS file_id, e.kind, r.path, CASE WHEN e.kind = 'renamed' AND n.name IS NOT NULL THEN coalesce(p.path, '') || '/' || n.name END AS previous_path
  FROM ev e LEFT JOIN resolved r ON r.id = e.file_id + 1000001 LEFT JOIN resolved p ON p.id = e.id % 25 + 1000 LEFT JOIN tree2 n ON n.id = e.id % 5""",
    "facet_doc_type": _facet("doc_type", "fm"),
    "facet_author": _facet("author", "fm"),
    "facet_language": _facet("language", "fm"),
    "facet_classification": _facet("classification", "fe"),
    "agg_stats": _with(EV, LIVE_FILES, QUEUE)
    + "SELECT (SELECT count(*) FROM ev) AS events, (SELECT count(*) FROM files WHERE NOT is_dir AND length(path) % 10 <> 0) AS files, (SELECT count(*) FROM queue) AS pending_extractions",
    "agg_schema_version": _with(EV) + "SELECT coalesce(max(id % 5 + 1), 0)::INTEGER AS version FROM ev",
    "agg_scan_summary": _with(SNAP, f"d AS ({DIFF})")
    + """SELECT (SELECT count(*) FROM snap_new) AS files_seen,
  (SELECT count(*) FROM (SELECT DISTINCT regexp_extract(path, '^(/[^/]*)', 1) FROM snap_new UNION SELECT DISTINCT regexp_extract(path, '^(/[^/]*/[^/]*)', 1) FROM snap_new)) AS dirs_seen,
  (SELECT count(*) FROM d) AS events_recorded, (SELECT count(*) FROM snap_new WHERE doc_id % 11 = 0) AS skipped""",
    "agg_by_day": _with(EV, "days AS (SELECT (TIMESTAMP '1970-01-01' + to_milliseconds(at_unix_ms))::DATE AS day, at_unix_ms FROM ev)")
    + "SELECT day::VARCHAR AS day, count(*) AS n, CASE (SELECT max(day) FROM days) - day WHEN 0 THEN 'Today' WHEN 1 THEN 'Yesterday' ELSE 'earlier' END AS label FROM days GROUP BY day",
    "latest_per_file": _with(EV) + "SELECT * FROM ev WHERE id IN (SELECT max(id) FROM ev GROUP BY file_id)",
    "latest_for_ids_ordered": _with(EV) + "SELECT ev.*, 10000000 - c_custkey AS rank FROM ev JOIN customer ON c_custkey = file_id WHERE c_custkey % 7 = 0 AND id IN (SELECT max(id) FROM ev GROUP BY file_id)",
    "orphan_events": _with(EV) + "SELECT id, file_id FROM ev WHERE NOT EXISTS (SELECT 1 FROM documents WHERE doc_id = file_id AND doc_id % 2 = 0)",
    "page_merge_new": _with(EV) + "SELECT * FROM ev WHERE id % 3 = 0 OR id % 2 = 0",
    "path_resolve": _with(TREE2) + "SELECT id, path FROM resolved",
    "path_resolve_pages": _with(TREE) + "SELECT path FROM nodes",
    "path_intern": _with(TREE) + "SELECT dense_rank() OVER (ORDER BY name) AS id, name FROM (SELECT DISTINCT name FROM nodes)",
    "path_component_names": _with(TREE, "ids AS (SELECT dense_rank() OVER (ORDER BY name) AS id, name FROM (SELECT DISTINCT name FROM nodes))")
    + "SELECT page_id, ids.id AS component_id, name FROM (SELECT page_id, string_split(path, '/')[2] AS name FROM pp) JOIN ids USING (name)",
    "path_normalise": _with(PP, NORMAL) + "SELECT page_id, CASE WHEN len(acc) > 0 THEN '/' || array_to_string(acc, '/') END AS path FROM steps WHERE i = len(p) + 1",
    "path_split": _with(PP) + "SELECT page_id, regexp_extract(path, '^(.*/)[^/]*$', 1) AS dir, regexp_extract(path, '([^/]*)$', 1) AS name FROM pp",
    "path_join": _with(PP) + "SELECT page_id, '/' || array_to_string(list_filter(string_split(path, '/'), lambda p: p <> ''), '/') AS path FROM pp",
    "path_ensure_chain": _with(TREE, "half AS (SELECT DISTINCT '/' || array_to_string(p[:n], '/') AS path FROM (SELECT p, unnest(range(1, len(p) + 1)) AS n FROM parts WHERE page_id % 2 = 0))")
    + "SELECT path, name FROM nodes WHERE path NOT IN (SELECT path FROM half)",
    "path_owning_root": _with(TREE, "roots AS (SELECT DISTINCT '/' || array_to_string(p[:n], '/') AS root FROM (SELECT p, unnest(range(1, least(len(p), 2) + 1)) AS n FROM parts WHERE page_id % 5 = 0))")
    + "SELECT page_id, path, (SELECT root FROM roots WHERE path = root OR starts_with(path, root || '/') ORDER BY length(root) DESC LIMIT 1) AS root FROM pp",
    "path_excluded_watch": _with(PP) + "SELECT page_id, list_has_any(string_split(path, '/'), ['en', 'de']) AS excluded FROM pp",
    "path_excluded_scan": _with(TREE) + "SELECT page_id, list_has_any(p[2:len(p) - 1], ['en', 'de']) AS excluded FROM parts",
    "path_lookup_live_first": "SELECT id, parent_id, name, deleted_at FROM (SELECT *, row_number() OVER (PARTITION BY parent_id, name ORDER BY deleted_at IS NULL DESC, deleted_at DESC, id) AS k FROM (SELECT doc_id AS id, doc_id % 50 AS parent_id, source AS name, CASE WHEN doc_id % 3 > 0 THEN doc_id * 10 END AS deleted_at FROM documents)) WHERE k = 1",
    "knn_exact": _with(EMB) + "SELECT file_id, round(d, 6) AS distance FROM scored ORDER BY d, file_id LIMIT 10",
    "knn_two_stage": _with(EMB) + "SELECT file_id, round(d, 6) AS distance FROM (SELECT * FROM scored ORDER BY h, file_id LIMIT 40) ORDER BY d, file_id LIMIT 10",
    "knn_faceted": _with(EMB, EV, FM, "c AS (SELECT * FROM (SELECT * FROM scored ORDER BY h, file_id LIMIT 400) ORDER BY d, file_id LIMIT 100)")
    + "SELECT c.file_id, e.id, e.kind, m.doc_type, m.language, round(c.d, 6) AS distance FROM c JOIN ev e ON e.file_id = c.file_id AND e.id IN (SELECT max(id) FROM ev GROUP BY file_id) JOIN fm m ON m.file_id = c.file_id WHERE m.language = 'en' ORDER BY c.d, c.file_id LIMIT 20",
    "knn_faceted_exact": _with(EMB, EV, FM, "c AS (SELECT s.*, m.language FROM scored s JOIN fm m ON m.file_id = s.file_id WHERE m.language = 'en' ORDER BY d, s.file_id LIMIT 20)")
    + "SELECT c.file_id, e.id, c.language, round(c.d, 6) AS distance FROM c JOIN ev e ON e.file_id = c.file_id AND e.id IN (SELECT max(id) FROM ev GROUP BY file_id)",
    "knn_recall": """WITH met AS (SELECT a.vec_id AS query_id, b.vec_id AS file_id,
  list_sum(list_transform(range(1, 65), lambda i: ((b.embedding[i] >= 0) <> (a.embedding[i] >= 0))::INTEGER)) AS h,
  sqrt(list_sum(list_transform(range(1, 65), lambda i: (b.embedding[i]::DOUBLE - a.embedding[i]::DOUBLE) ** 2))) AS d FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, file_id) AS kd, row_number() OVER (PARTITION BY query_id ORDER BY h, file_id) AS kh FROM met),
second AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, file_id) AS k2 FROM ranked WHERE kh <= 40)
SELECT r.query_id, count(s.file_id) AS hits, count(*) AS wanted FROM ranked r LEFT JOIN second s ON s.query_id = r.query_id AND s.file_id = r.file_id AND s.k2 <= 10 WHERE r.kd <= 10 GROUP BY 1""",
    "vec_bits": """SELECT vec_id AS file_id, list_sum(list_transform(range(0, 32), lambda i: CASE WHEN embedding[i + 1] >= 0 THEN 1::BIGINT << i ELSE 0 END))::BIGINT AS low,
  list_sum(list_transform(range(0, 32), lambda i: CASE WHEN embedding[i + 33] >= 0 THEN 1::BIGINT << i ELSE 0 END))::BIGINT AS high FROM embeddings""",
    "vec_hamming": _with(EMB) + "SELECT file_id, h AS hamming FROM scored",
    "vec_l2": _with(EMB) + "SELECT file_id, round(d, 6) AS distance FROM scored",
    "cdc_snapshot_diff": _with(SNAP) + DIFF,
    "cdc_with_deletes": _with(SNAP) + DIFF + " UNION ALL SELECT path, 'deleted', NULL FROM snap_old WHERE path NOT IN (SELECT path FROM snap_new)",
    "cdc_upsert_state": _with(STATE)
    + """SELECT coalesce(n.path, s.path) AS path, CASE WHEN n.path IS NULL THEN s.size_bytes ELSE n.size_bytes END AS size_bytes, CASE WHEN n.path IS NULL THEN s.mtime_unix ELSE n.mtime_unix END AS mtime_unix,
  CASE WHEN n.path IS NULL THEN s.deleted_at END AS deleted_at FROM state s FULL JOIN snap_new n ON s.path = n.path""",
    "cdc_tombstones": _with(STATE) + "SELECT path, 'deleted' AS kind, 5000::BIGINT AS at_unix_ms FROM state WHERE deleted_at IS NULL AND path NOT IN (SELECT path FROM snap_new)",
    "cdc_state_fold": _with(EV)
    + "SELECT file_id, max(id) AS last_id, arg_max(size_bytes, id) AS size_bytes, CASE WHEN arg_max(kind, id) = 'deleted' THEN arg_max(at_unix_ms, id) END AS deleted_at, count(*) AS n_events FROM ev GROUP BY file_id",
    "change_decide": _with(STATE, "touched AS (SELECT '/' || source || '/' || lang || '/' || doc_id AS path FROM documents WHERE doc_id % 2 = 0)", "live AS (SELECT * FROM state WHERE deleted_at IS NULL)")
    + """SELECT * FROM (SELECT t.path, CASE WHEN s.path IS NOT NULL AND n.path IS NULL THEN 'deleted' WHEN n.path IS NOT NULL AND s.path IS NULL THEN 'created'
  WHEN n.path IS NOT NULL AND (s.size_bytes IS DISTINCT FROM n.size_bytes OR s.mtime_unix IS DISTINCT FROM n.mtime_unix) THEN 'modified' END AS kind
  FROM touched t LEFT JOIN live s ON t.path = s.path LEFT JOIN snap_new n ON t.path = n.path) WHERE kind IS NOT NULL""",
    "rename_apply": _with(RENAMES) + "SELECT id, CASE WHEN moves THEN coalesce(to_path, path) ELSE path END AS path, CASE WHEN gone THEN 99 ELSE deleted_at END AS deleted_at FROM told",
    "rename_apply_events": _with(RENAMES)
    + """SELECT id, CASE WHEN moves THEN coalesce(to_path, path) ELSE path END AS path, CASE WHEN gone THEN 'deleted' ELSE 'renamed' END AS kind, CASE WHEN moves AND to_path IS NOT NULL THEN path END AS previous_path FROM told WHERE gone OR moves
  UNION ALL SELECT NULL, to_path, 'created', NULL FROM ren WHERE to_path IS NOT NULL AND from_path NOT IN (SELECT path FROM st WHERE deleted_at IS NULL)""",
    "rename_supersedes": _with(RENAMES) + "SELECT id, path FROM st WHERE path NOT IN (SELECT from_path FROM ren) AND path NOT IN (SELECT to_path FROM ren WHERE to_path IS NOT NULL)",
    "queue_pending": _with(QUEUE, PENDING) + "SELECT * FROM pend",
    "queue_enqueue": _with(QUEUE, "kept AS (SELECT * FROM queue WHERE file_id % 5 <> 0)", "news AS (SELECT doc_id AS file_id FROM documents WHERE doc_id % 10 IN (0, 3))")
    + "SELECT coalesce(q.file_id, n.file_id) AS file_id, CASE WHEN n.file_id IS NULL THEN q.queued_at_unix ELSE 20000 END AS queued_at_unix, coalesce(q.attempt_count, 0) AS attempt_count FROM kept q FULL JOIN news n ON q.file_id = n.file_id",
    "queue_record_attempt": _with(QUEUE, PENDING) + "SELECT q.file_id, q.queued_at_unix, q.attempt_count + (q.file_id IN (SELECT file_id FROM pend))::INTEGER AS attempt_count FROM queue q",
    "queue_drain": _with(QUEUE, PENDING, FM)
    + "SELECT q.file_id, q.queued_at_unix, q.attempt_count + (p.file_id IS NOT NULL)::INTEGER AS attempt_count FROM queue q LEFT JOIN pend p ON p.file_id = q.file_id LEFT JOIN fm m ON m.file_id = q.file_id WHERE p.file_id IS NULL OR m.word_count % 3 = 0",
    "queue_complete": _with(QUEUE, FM) + "SELECT * FROM queue WHERE file_id NOT IN (SELECT file_id FROM fm WHERE extractor_version = 2)",
    "queue_requeue_stale": _with(FM, HALF_QUEUE, REQUEUE) + "SELECT * FROM rq",
    "queue_requeued": _with(FM, HALF_QUEUE, REQUEUE)
    + "SELECT coalesce(q.file_id, n.file_id) AS file_id, CASE WHEN n.file_id IS NULL THEN q.queued_at_unix ELSE 30000 END AS queued_at_unix, CASE WHEN n.file_id IS NULL THEN q.attempt_count ELSE 0 END AS attempt_count FROM hq q FULL JOIN rq n ON q.file_id = n.file_id",
    "queue_requeue_enrichment": _with(FE) + "SELECT file_id FROM fe WHERE enrichment_version < 2",
    "queue_gate": "SELECT doc_id FROM documents WHERE length(coalesce(text[:8000], '')) >= 300",
    "queue_depth": _with(QUEUE) + "SELECT count(*) AS depth FROM queue",
    "upsert_metadata": _with(FM)
    + "SELECT doc_id AS file_id, 'pdf' AS doc_type, 3 AS extractor_version FROM documents WHERE doc_id % 4 = 0 UNION ALL SELECT file_id, doc_type, extractor_version FROM fm WHERE file_id % 4 <> 0",
    "fn_word_count": f"SELECT doc_id, {WORDS.format('text')} AS words FROM documents",
    "fn_trimmed": "SELECT doc_id, CASE WHEN doc_id % 11 > 0 THEN nullif(regexp_replace(regexp_replace(text, '^[\\s\\x0B\\x85\\p{Z}]+', ''), '[\\s\\x0B\\x85\\p{Z}]+$', ''), '') END AS trimmed FROM documents",
    "fn_cap_body": "SELECT doc_id, md5(text[:8000]) AS md5 FROM documents",
    "fn_extension": _with(NAMES) + "SELECT doc_id, name, extension FROM exts",
    "fn_doc_type": _with(NAMES) + "SELECT doc_id, doc_type FROM typed",
    "fn_sniff": _with(NAMES, HEADS)
    + """SELECT doc_id, CASE WHEN starts_with(head, '25504446') THEN 'pdf' WHEN starts_with(head, 'FFD8FF') THEN 'jpeg' WHEN starts_with(head, '49492A00') OR starts_with(head, '4D4D002A') THEN 'tiff' ELSE doc_type END AS doc_type
FROM typed JOIN heads USING (doc_id)""",
    "fn_camera_model": """WITH given AS (SELECT p_partkey, nullif(trim(CASE WHEN p_partkey % 5 > 0 THEN string_split(p_name, ' ')[1] END), '') AS make,
  nullif(trim(CASE WHEN p_partkey % 7 > 0 THEN CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE ' X' || p_partkey || ' ' END END), '') AS model FROM part)
SELECT p_partkey, CASE WHEN make IS NULL THEN model WHEN model IS NULL THEN make WHEN starts_with(lower(model), lower(make)) THEN model ELSE make || ' ' || model END AS camera FROM given""",
    "fn_civil_to_unix": _with(EV) + CIVIL,
    "fn_format_bytes": f"SELECT doc_id, {_label(SIZE, False)} AS label, {_label(SIZE, True)} AS fixed FROM documents",
    "fn_relative_time": _with(EV, "aged AS (SELECT id, at_unix_ms, floor(((SELECT max(at_unix_ms) FROM ev) - at_unix_ms) / 1000.0::DOUBLE + 0.5)::BIGINT AS s FROM ev)")
    + """SELECT id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || ' min ago' WHEN s < 86400 THEN (s // 3600) || ' hour' || CASE WHEN s // 3600 = 1 THEN '' ELSE 's' END || ' ago'
  WHEN s < 604800 THEN (s // 86400) || ' day' || CASE WHEN s // 86400 = 1 THEN '' ELSE 's' END || ' ago' ELSE strftime(TIMESTAMP '1970-01-01' + to_milliseconds(at_unix_ms), '%Y-%m-%d') END AS ago FROM aged""",
    "fn_hms": _with(EV) + f"SELECT id, printf('%02d:%02d:%02d', {SECOND} // 3600, {SECOND} % 3600 // 60, {SECOND} % 60) AS hms FROM ev",
    "fn_duration": _with(EV) + "SELECT id, printf('%dh%02dm%02ds', id * 37 // 3600, id * 37 % 3600 // 60, id * 37 % 60) AS duration FROM ev",
    "fn_url_join": "SELECT page_id, rtrim(url || '//', '/') || '/chat/completions' AS url FROM pages",
    "json_chat_reply": """SELECT conv_id, turn, CASE WHEN ok THEN text END AS summary, CASE WHEN ok THEN CASE WHEN turn % 2 = 0 THEN 1 ELSE 0 END END::INTEGER AS n_keywords, CASE WHEN ok THEN role END AS classification
  FROM (SELECT *, conv_id % 9 <> 0 AND conv_id % 11 <> 0 AS ok FROM conversations)""",
    "json_embedding_reply": "SELECT vec_id, len(embedding)::INTEGER AS width, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings",
    "json_list_or_null": """SELECT doc_id, CASE WHEN len(l) > 0 THEN '["' || array_to_string(l, '","') || '"]' END AS items FROM (SELECT doc_id, list_filter([lang, CASE WHEN doc_id % 2 = 0 THEN source END], lambda x: x IS NOT NULL AND x <> 'en') AS l FROM documents)""",
    "metrics_render": _with(EV, "m AS (SELECT 'tidemark_' || kind || '_total' AS full_name, kind || '_total' AS name, count(*) AS n FROM ev GROUP BY kind)")
    + "SELECT name, unnest([0, 1, 2])::INTEGER AS line_no, unnest(['# HELP ' || full_name || ' Events of a kind.', '# TYPE ' || full_name || ' counter', full_name || ' ' || n]) AS line FROM m",
    "metrics_parse": _with(EV) + "SELECT 'tidemark_' || kind || '_total' AS name, count(*)::DOUBLE AS value FROM ev GROUP BY kind",
    "log_tail": "SELECT conv_id, turn, role FROM conversations ORDER BY conv_id DESC, turn DESC LIMIT 200",
    "debounce_batch": _with("raw AS (SELECT event_id AS id, user_id AS file_id, CASE event_type WHEN 'error' THEN 'removed' ELSE 'touched' END AS kind, epoch_us(ts) // 1000 * 1000 AS at_unix_us FROM events)", BURSTS)
    + "SELECT file_id, kind, n, last_ms, first_ms FROM bursts",
    "rename_pairs": _with(EV, HALVES) + PAIRS,
    "rename_unpaired": _with(EV, HALVES)
    + "SELECT id, tracker, CASE WHEN is_source THEN 'removed' ELSE 'touched' END AS change FROM mated m WHERE next_id IS NULL AND NOT EXISTS (SELECT 1 FROM mated o WHERE o.next_id = m.id)",
    "watch_changes": _with(WATCH) + "SELECT * FROM settled",
    # The watermark ends three days before the last event.
    "stream_watch_changes": _with(WATCH) + "SELECT * FROM settled WHERE at_ms <= (SELECT max(ms) FROM w) - 259200000",
    "stream_rename_join": _with(WATCH)
    + """SELECT coalesce(f.tracker, t.tracker) AS tracker, f.id AS from_id, t.id AS to_id, f.path AS from_path, t.path AS to_path, greatest(f.ms, t.ms) AS t
FROM (SELECT * FROM w WHERE mode = 'from') f FULL JOIN (SELECT * FROM w WHERE mode = 'to') t ON f.tracker = t.tracker AND abs(f.ms - t.ms) <= 21600000
WHERE f.id IS NOT NULL AND t.id IS NOT NULL OR coalesce(f.tracker, t.tracker) IS NULL
  OR greatest(f.ms, t.ms) + 21600000 < (SELECT least(max(ms) FILTER (mode = 'from'), max(ms) FILTER (mode = 'to')) FROM w) - 259200000""",
    "rename_chain_events": _with(CHAINS) + "SELECT * FROM told",
    "rename_chain_state": _with(CHAINS)
    + """SELECT s.id, NULL::BIGINT AS born, coalesce(e.path, s.path) AS path, coalesce(e.gone, s.deleted_at) AS deleted_at FROM state s LEFT JOIN ends e ON e.id = s.id
UNION ALL SELECT id, born, path, gone FROM ends WHERE id IS NULL""",
    "cdc_replay": _with(EV)
    + """, before AS (SELECT *, lag(kind) OVER o AS was, coalesce(count(*) FILTER (kind <> 'deleted') OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS touches FROM ev WINDOW o AS (PARTITION BY file_id ORDER BY id)),
done AS (SELECT *, CASE WHEN touches = 0 THEN 0 WHEN was = 'deleted' THEN 1 ELSE 2 END AS s, kind = 'deleted' AS gone FROM before)
SELECT file_id, CASE WHEN count(*) FILTER (NOT gone) = 0 THEN 'absent' WHEN arg_max(gone, id) THEN 'dead' ELSE 'live' END AS state, count(*) FILTER (NOT gone AND s = 0) AS created, count(*) FILTER (NOT gone AND s = 1) AS revived,
  count(*) FILTER (NOT gone AND s = 2) AS modified, count(*) FILTER (gone AND s = 2) AS deleted, arg_max(size_bytes, id) FILTER (NOT gone) AS size_bytes,
  CASE WHEN arg_max(gone, id) THEN max(at_unix_ms) FILTER (gone AND s = 2) END AS deleted_at, count(*) AS n_events FROM done GROUP BY file_id""",
    "agg_consecutive_days": _with(EV)
    + """, listed AS (SELECT id, at_unix_ms, (TIMESTAMP '1970-01-01' + to_milliseconds(at_unix_ms))::DATE AS day, row_number() OVER (ORDER BY size_bytes DESC, id DESC) AS k FROM ev),
opened AS (SELECT *, CASE WHEN day = lag(day) OVER (ORDER BY k) THEN 0 ELSE 1 END AS o FROM listed),
grouped AS (SELECT *, sum(o) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING) AS g FROM opened)
SELECT g::BIGINT AS n_group, min(day) AS day, CASE min(day) WHEN DATE '2024-02-01' THEN 'Today' WHEN DATE '2024-01-31' THEN 'Yesterday' ELSE strftime(min(day), '%A, %b %-d') END AS label, count(*) AS n, arg_min(id, k) AS first_id, arg_max(id, k) AS last_id FROM grouped GROUP BY g""",
    "path_intern_into": _with(TREE)
    + """, names AS (SELECT DISTINCT name, CASE WHEN name < 'm' THEN 0 WHEN name >= 'a' THEN 1 ELSE 2 END AS b FROM nodes) SELECT row_number() OVER (ORDER BY b, name) AS id, name FROM names""",
    "stream_state_merge": """SELECT '/u' || user_id AS path, arg_max(regexp_extract(props, '"k": *([0-9]+)', 1)::BIGINT, event_id) AS size_bytes, max(event_id) // 100 AS mtime_unix
FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'error'""",
    "rename_exclusion_matrix": _with(PP)
    + r"""SELECT page_id, CASE WHEN a AND b THEN 'ignore' WHEN a THEN 'arrival' WHEN b THEN 'departure' ELSE 'rename' END AS action
  FROM (SELECT page_id, list_has_any(string_split(path, '/'), ['de', 'es']) AS a, list_has_any(string_split(regexp_replace(path, '/(en|fr)/', '/de/', 'g'), '/'), ['de', 'es']) AS b FROM pp)""",
    "stream_append": "SELECT event_id AS id, user_id AS file_id, event_type AS kind FROM events",
    "stream_dedupe": "SELECT DISTINCT user_id AS file_id, event_type AS kind FROM events",
    "stream_debounce": _with("raw AS (SELECT event_id AS id, user_id AS file_id, event_type AS kind, epoch_us(ts) AS at_unix_us FROM events)", BURSTS)
    + "SELECT file_id, kind, n, last_ms, first_ms FROM bursts WHERE last_us + 21600000000 <= (SELECT max(epoch_us(ts)) // 1000 * 1000 FROM events)",
    "stream_debounce_late": _with("raw AS (SELECT event_id AS id, user_id AS file_id, event_type AS kind, epoch_us(ts) AS at_unix_us FROM events)", BURSTS)
    + "SELECT file_id, kind, n, last_ms, first_ms FROM bursts WHERE last_us + 21600000000 <= (SELECT max(epoch_us(ts)) // 1000 * 1000 - 259200000000 FROM events)",
    "stream_rename": _with(EV, HALVES) + PAIRS,
    "stream_rename_unpaired": _with(EV, HALVES)
    + """SELECT id, tracker, CASE WHEN is_source THEN 'removed' ELSE 'touched' END AS change FROM mated m WHERE next_id IS NULL AND NOT EXISTS (SELECT 1 FROM mated o WHERE o.next_id = m.id)
  AND (EXISTS (SELECT 1 FROM mated o WHERE o.tracker = m.tracker AND (o.t, o.id) > (m.t, m.id)) OR t + 21600001 < (SELECT max(t) FROM halves))""",
    "extract_html_title": r"SELECT page_id, nullif(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '^[\s\x0B\x{85}\p{Z}]+|[\s\x0B\x{85}\p{Z}]+$', '', 'g'), '') AS title FROM pages",
    "extract_exif": "SELECT doc_id AS id, 'Acme ' || length(coalesce(text, '')) AS camera, 1706933106::BIGINT AS taken_at, NULL::VARCHAR AS error FROM documents",
    "tl_json_rows": _with(EV, FM)
    + """SELECT e.id, '{"file_id":' || e.file_id || ',"id":' || e.id || ',"kind":"' || e.kind || '","at_unix_ms":' || e.at_unix_ms || coalesce(',"size_bytes":' || e.size_bytes, '')
  || coalesce(',"doc_type":"' || m.doc_type || '"', '') || coalesce(',"language":"' || m.language || '"', '') || '}' AS json FROM ev e LEFT JOIN fm m ON e.file_id = m.file_id""",
    "facet_git_branch": _with(FM) + "SELECT CASE WHEN file_id % 2 = 0 THEN 'main' ELSE 'dev' END AS value, count(*) AS count FROM fm GROUP BY 1",
    "path_lookup": _with(TREE2) + "SELECT path, id FROM resolved UNION ALL SELECT path || '/none', NULL FROM resolved",
    "path_children": _with(TREE2) + "SELECT id, parent_id, name FROM tree2 WHERE parent_id IS NULL AND name = (SELECT min(r_name) FROM region)",
    "orphan_metadata": _with(EV, FM) + "SELECT file_id FROM fm WHERE NOT EXISTS (SELECT 1 FROM ev WHERE ev.file_id = fm.file_id)",
    "orphan_enrichment": _with(EV, FE) + "SELECT file_id FROM fe WHERE NOT EXISTS (SELECT 1 FROM ev WHERE ev.file_id = fe.file_id)",
    "cdc_tombstone_state": _with(STATE) + "SELECT path, size_bytes, mtime_unix, CASE WHEN deleted_at IS NULL AND path NOT IN (SELECT path FROM snap_new) THEN 5000 ELSE deleted_at END AS deleted_at FROM state",
    "upsert_enrichment": _with(FE)
    + "SELECT doc_id AS file_id, 'reviewed' AS classification, 9 AS enrichment_version FROM documents WHERE doc_id % 4 = 0 UNION ALL SELECT file_id, classification, enrichment_version FROM fe WHERE file_id % 4 <> 0",
    "scan_walk": """WITH d AS (SELECT DISTINCT 'source=' || coalesce(source, '__HIVE_DEFAULT_PARTITION__') AS s, 'lang=' || coalesce(lang, '__HIVE_DEFAULT_PARTITION__') AS l FROM documents)
SELECT '' AS path, 0 AS depth, count(DISTINCT s) AS n_dirs, true AS has_files FROM d UNION ALL SELECT s, 1, count(*), false FROM d GROUP BY s UNION ALL SELECT s || '/' || l, 2, 0, true FROM d""",
    "scan_files": _with(LAID_OUT) + "SELECT folder, strlen(t) AS size_bytes FROM laid",
    "read_contents": _with(LAID_OUT) + "SELECT folder, md5(t) AS md5, NULL::VARCHAR AS error FROM laid",
    "read_heads": _with(LAID_OUT) + "SELECT folder, md5(encode(t)[1:8192]) AS md5 FROM laid",
    "append_rows": "SELECT doc_id, n_chars FROM documents",
    "scan_hidden": """SELECT '_k=_' || lower(r_name) AS name, true AS is_dir, 1 AS depth, true AS no_size, false AS skipped FROM region WHERE r_name <> 'ASIA' UNION ALL SELECT '_SUCCESS', false, 1, false, false""",
    "stream_roots": """WITH r AS (SELECT event_id AS id, user_id, event_id % 3 AS root, CASE WHEN event_id <= (SELECT max(event_id) // 2 FROM events) THEN 0 ELSE 1 END AS go FROM events),
held AS (SELECT root, user_id, min(id) AS id FROM r GROUP BY root, user_id)
SELECT 'root' || root AS root, stage, command, count(*) AS n, sum(id)::BIGINT AS ids FROM (
  SELECT root, 'scan' AS stage, NULL AS command, id FROM held
  UNION ALL SELECT root, 'change', NULL, id FROM r WHERE root = 1 OR root = 0 AND go = 0 OR root = 2 AND go = 1
  UNION ALL SELECT unnest([0, 1, 2]), 'command', 'added', NULL UNION ALL SELECT 0, 'command', 'removed', NULL) GROUP BY ALL""",
    "vec_bit_width": """WITH cut AS (SELECT vec_id, embedding[:len(embedding) - vec_id % 13] AS v FROM embeddings)
SELECT vec_id, len(v)::INTEGER AS dimensions, ((len(v) + 7) // 8 * 8)::INTEGER AS bit_dimensions,
  array_to_string(list_transform(range(0, (len(v) + 7) // 8), lambda j: printf('%02X', list_sum(list_transform(range(0, 8), lambda k: CASE WHEN coalesce(v[j * 8 + k + 1] >= 0, false) THEN (1 << k)::INTEGER ELSE 0 END))::INTEGER)), '') AS packed FROM cut""",
    "language_profiles": LANGUAGE + "SELECT lang, gram, rank FROM profiles",
    "detect_language": LANGUAGE
    + """, counted AS (SELECT doc_id, gram, count(*) AS n FROM grams WHERE long GROUP BY doc_id, gram),
ranked AS (SELECT * FROM (SELECT doc_id, gram, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, gram) AS rank FROM counted) WHERE rank <= 300),
near AS (SELECT r.doc_id, p.lang, sum(abs(r.rank - p.rank) - 300) AS less FROM ranked r JOIN profiles p USING (gram) GROUP BY r.doc_id, p.lang),
best AS (SELECT doc_id, min((less, CASE lang WHEN 'en' THEN 'eng' WHEN 'fr' THEN 'fra' WHEN 'de' THEN 'deu' WHEN 'es' THEN 'spa' ELSE lang END)) AS b FROM near GROUP BY doc_id)
SELECT d.doc_id, b[2] AS language FROM documents d LEFT JOIN best USING (doc_id)""",
    "vec_checked": "SELECT vec_id AS file_id, len(embedding)::INTEGER AS width FROM embeddings",
    "knn_config": "SELECT 1 AS id, 'given' AS model, max(len(embedding))::INTEGER AS dimensions FROM embeddings",
    "json_chat_request": """SELECT doc_id, md5('{"model":"m","messages":[{"role":"system","content":"Describe."},{"role":"user","content":' || to_json(text[:8000])::VARCHAR || '}],"temperature":0.2}') AS md5 FROM documents""",
    "fn_valid_text": "SELECT doc_id, lang || chr(65533) || source AS text FROM documents",
}
