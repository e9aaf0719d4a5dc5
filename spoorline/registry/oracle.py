"""The reference results as SQL, built from common table expressions.

They state the semantics directly (replay of the log, one window per session)
and serve to check the distributed jobs on small data.
"""

from __future__ import annotations

from spoorline.sources.tables import oracle_ctes

_NAME = r'("[^"]+"|\w+)'
_QUAL = rf"(?:\w+\.)*{_NAME}"


def _rx(text: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract({text}, '(?is){pattern.replace(chr(39), chr(39) * 2)}', {group})"


def _is(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, '(?is){pattern.replace(chr(39), chr(39) * 2)}')"


def _ident(expr: str) -> str:
    return f"CASE WHEN {expr} = '' THEN NULL WHEN {expr} LIKE '\"%' THEN trim({expr}, '\"') ELSE lower({expr}) END"


def _fold(expr: str, depth: int = 4) -> str:
    for _ in range(depth):
        expr = f"regexp_replace({expr}, '\\([^()]*\\)', ' § ', 'g')"
    return expr


_BARE = "split_part(regexp_replace(query, '''[^'']*''', '''''', 'g'), ';', 1)"
_KIND = f"""CASE WHEN {_is('bare', r'^\s*COPY\b')} THEN 'copy'
 WHEN {_is('bare', r'^\s*TRUNCATE\b')} THEN 'truncate'
 WHEN {_is('bare', r'^\s*CREATE\s+ROLE\s')} THEN 'create_role'
 WHEN {_is('bare', r'^\s*ALTER\s+SYSTEM\b')} THEN 'alter_system'
 WHEN {_is('bare', r'^\s*ALTER\s+ROLE\s')} THEN 'alter_role'
 WHEN {_is('bare', r'^\s*SET\s+ROLE\b')} THEN 'set_role'
 WHEN {_is('bare', r'^\s*DROP\s+TABLE\b')} THEN 'drop'
 WHEN {_is('bare', r'^\s*(?:INSERT\s+INTO|UPDATE|DELETE\s+FROM)\b')} THEN 'dml'
 WHEN {_is('bare', r'^\s*SELECT\b')} THEN 'select' END"""
_FROM = r"\bFROM\s+"
_TABLE = f"""CASE kind WHEN 'copy' THEN {_ident(_rx('bare', r'^\s*COPY\s+' + _QUAL))}
 WHEN 'truncate' THEN {_ident(_rx('bare', r'^\s*TRUNCATE\s+(?:TABLE\s+)?' + _QUAL))}
 WHEN 'drop' THEN {_ident(_rx('bare', r'^\s*DROP\s+TABLE\s+(?:IF\s+EXISTS\s+)?' + _QUAL))}
 WHEN 'dml' THEN {_ident(_rx('bare', r'^\s*(?:INSERT\s+INTO|UPDATE|DELETE\s+FROM)\s+' + _QUAL))}
 WHEN 'select' THEN CASE WHEN {_is('flat', r'\b(?:UNION|INTERSECT|EXCEPT)\b')}
   OR {_is('flat', _FROM + r'(?:[\w."]+\s*)?§')}
   OR {_is('flat', _FROM + r'[^,]*\bJOIN\b')} THEN NULL
   ELSE {_ident(_rx('flat', _FROM + _QUAL))} END END"""
_SHELL = _rx("query", r"^\s*COPY\b.*\b(?:TO|FROM)\s+PROGRAM\s+'((?:[^']|'')*)'")

CTES = {
    "offsets": """SELECT k.run_id, COALESCE(c."timestamp" - k.first_ns / 1e9, t.server_boot_unix_time) AS clock_offset
 FROM (SELECT run_id, arg_min("timestamp", pos) AS first_ns FROM kernel GROUP BY 1) k
 LEFT JOIN control c ON c.run_id = k.run_id LEFT JOIN time_sync t ON t.run_id = k.run_id""",
    "merged": """SELECT k.run_id, pos, 0 AS source_rank, 'kernel' AS source, "timestamp" / 1e9 + clock_offset AS timestamp_unix,
  pid, ppid, uid, comm, syscall, arg, dest_ip, dest_port, NULL::BIGINT AS session_id, NULL::VARCHAR AS event_type,
  NULL::VARCHAR AS query, NULL::VARCHAR AS username FROM kernel k JOIN offsets o ON o.run_id = k.run_id
 UNION ALL SELECT run_id, pos, 1, 'postgres', "timestamp", backend_pid, NULL::BIGINT, NULL::BIGINT, NULL::VARCHAR,
  NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR, NULL::BIGINT, session_id, event_type, query, username FROM audit""",
    "log": """SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY timestamp_unix, source_rank, pos) - 1 AS event_id
 FROM merged""",
    "starts": """SELECT run_id, session_id AS session_key, min(event_id) AS since FROM log
 WHERE source = 'postgres' GROUP BY 1, 2""",
    "stated": """SELECT run_id, pid, ppid, event_id AS since,
  COALESCE(lead(event_id) OVER (PARTITION BY run_id, pid ORDER BY event_id), 9223372036854775807) AS until
 FROM log WHERE source = 'kernel' AND ppid <> 0""",
    "attempts": """SELECT run_id, event_id, event_id AS moment, pid FROM log WHERE source = 'kernel'
 UNION ALL SELECT k.run_id, k.event_id, a.event_id, k.pid FROM log k JOIN log a
  ON a.run_id = k.run_id AND a.source = 'postgres' AND a.event_id > k.event_id
  AND a.timestamp_unix - k.timestamp_unix <= 20.0 WHERE k.source = 'kernel'""",
    "walk": """SELECT run_id, event_id, moment, pid AS cur, 0 AS depth FROM attempts
 UNION ALL SELECT w.run_id, w.event_id, w.moment, l.ppid, w.depth + 1 FROM walk w
  JOIN stated l ON l.run_id = w.run_id AND l.pid = w.cur AND l.since <= w.moment AND w.moment < l.until
  LEFT JOIN starts s ON s.run_id = w.run_id AND s.session_key = w.cur AND s.since <= w.moment
  WHERE s.session_key IS NULL AND w.depth < 7""",
    "pairs": """SELECT run_id, event_id, session_id AS session_key, event_id AS resolved_at FROM log WHERE source = 'postgres'
 UNION ALL SELECT w.run_id, w.event_id, arg_min(s.session_key, w.moment), min(w.moment) FROM walk w
  JOIN starts s ON s.run_id = w.run_id AND s.session_key = w.cur AND s.since <= w.moment GROUP BY 1, 2""",
    "slog": """SELECT l.*, p.session_key, p.resolved_at, row_number() OVER (PARTITION BY l.run_id, p.session_key
  ORDER BY l.timestamp_unix, p.resolved_at, p.resolved_at <> l.event_id, l.event_id) - 1 AS seq
 FROM log l JOIN pairs p ON p.run_id = l.run_id AND p.event_id = l.event_id""",
    "paired": """SELECT *, CASE WHEN event_type = 'ExecutorEnd' THEN COALESCE(last_value(
   CASE WHEN event_type = 'ExecutorStart' THEN event_id END IGNORE NULLS) OVER (PARTITION BY run_id, session_key, query
   ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), event_id) ELSE event_id END AS query_id
 FROM slog WHERE source = 'postgres'""",
    "parsed": f"""SELECT *, {_KIND} AS kind, {_fold('bare')} AS flat FROM (SELECT *, {_BARE} AS bare FROM paired)""",
    "facts": f"""SELECT *, {_TABLE} AS table_name,
  CASE WHEN kind = 'copy' THEN {_is('bare', r"PROGRAM\s+'")} END AS is_program,
  CASE WHEN kind = 'copy' AND {_is('bare', r"PROGRAM\s+'")} THEN replace({_SHELL}, '''''', '''') END AS shell_cmd,
  CASE WHEN kind = 'drop' THEN true END AS is_drop,
  CASE WHEN kind IN ('create_role', 'alter_role') THEN {_ident(_rx('bare', r'^\s*(?:CREATE|ALTER)\s+ROLE\s+' + _NAME))}
   WHEN kind = 'set_role' THEN {_ident(_rx('bare', r'^\s*SET\s+ROLE\s+' + _NAME))} END AS role_name,
  CASE WHEN kind IN ('create_role', 'alter_role', 'set_role') THEN true END AS is_role_change,
  CASE WHEN kind = 'create_role' THEN {_is('bare', r'\b(?:NO)?SUPERUSER\b')}
   WHEN kind = 'alter_role' THEN {_is('bare', r'\bSUPERUSER\b')} END AS is_superuser,
  CASE WHEN kind = 'alter_role' THEN {_is('bare', r'\bSUPERUSER\b')} END AS is_privilege_escalation,
  CASE WHEN kind = 'truncate' THEN true END AS is_destructive,
  CASE WHEN kind = 'truncate' THEN true END AS is_truncate,
  CASE WHEN kind = 'alter_system' THEN {_rx('bare', r'^\s*ALTER\s+SYSTEM\s+SET\s+([\w.]+)')} END AS setting_name,
  CASE WHEN kind = 'alter_system' THEN {_rx('query', r"SET\s+[\w.]+\s*=\s*'([^']*)'")} END AS setting_value,
  CASE WHEN kind = 'alter_system' THEN true END AS is_system_config FROM parsed""",
    "everything": """SELECT run_id, session_key, seq, event_id, source, timestamp_unix, pid, ppid, comm, syscall, arg, dest_ip, dest_port,
  query, query_id, table_name, role_name, is_program FROM facts
 UNION ALL SELECT run_id, session_key, seq, event_id, source, timestamp_unix, pid, ppid, comm, syscall, arg, dest_ip, dest_port,
  NULL::VARCHAR, NULL::BIGINT, NULL::VARCHAR, NULL::VARCHAR, NULL::BOOLEAN FROM slog WHERE source = 'kernel'""",
    "processes": "SELECT run_id, session_key, pid, min(seq) AS first_seq FROM everything WHERE source = 'kernel' GROUP BY 1, 2, 3",
    "programs": """SELECT *, last_value(CASE WHEN is_program THEN query_id END IGNORE NULLS) OVER w AS prog_id,
  last_value(CASE WHEN is_program THEN timestamp_unix END IGNORE NULLS) OVER w AS prog_ts FROM everything
  WINDOW w AS (PARTITION BY run_id, session_key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "prep": """SELECT b.*, p.pid AS parent_pid,
  CASE WHEN b.source = 'kernel' AND p.pid IS NULL AND b.timestamp_unix - b.prog_ts < 5.0 THEN b.prog_id END AS spawn_query
 FROM programs b LEFT JOIN processes p ON b.source = 'kernel' AND b.ppid <> 0 AND p.run_id = b.run_id
  AND p.session_key = b.session_key AND p.pid = b.ppid
  AND (p.first_seq < b.seq OR (p.first_seq = b.seq AND b.pid = b.ppid))""",
    "mentions": """SELECT *, 'Query' AS node_type, query_id::VARCHAR AS node_key FROM prep WHERE source = 'postgres'
 UNION ALL SELECT *, 'Session', session_key::VARCHAR FROM prep WHERE source = 'postgres'
 UNION ALL SELECT *, 'Table', table_name FROM prep WHERE table_name <> ''
 UNION ALL SELECT *, 'Role', role_name FROM prep WHERE role_name <> ''
 UNION ALL SELECT *, 'Process', pid::VARCHAR FROM prep WHERE source = 'kernel'
 UNION ALL SELECT *, 'File', arg FROM prep WHERE syscall IN ('openat', 'unlink', 'rename')
 UNION ALL SELECT *, 'Endpoint', dest_ip || ':' || dest_port FROM prep WHERE syscall = 'connect' AND dest_ip <> ''""",
    "nodes": """SELECT run_id, session_key, node_type, node_key, arg_min_null(timestamp_unix, seq) AS timestamp_unix,
  arg_min_null(event_id, seq) AS event_id, arg_min_null(query, seq) AS query, arg_min_null(comm, seq) AS comm, arg_min_null(arg, seq) AS arg,
  arg_min_null(dest_ip, seq) AS dest_ip, CASE WHEN count(*) > 1 AND node_type <> 'Session' THEN max(timestamp_unix) END AS last_seen,
  count(*) AS mentions FROM mentions GROUP BY 1, 2, 3, 4""",
    "links": """SELECT run_id, session_key, 'Session' AS src_type, session_key::VARCHAR AS src_key, 'executes' AS rel, 'Query' AS dst_type,
  query_id::VARCHAR AS dst_key, seq, timestamp_unix, query_id AS event_id FROM prep WHERE source = 'postgres'
 UNION ALL SELECT run_id, session_key, 'Query', query_id::VARCHAR, 'accesses', 'Table', table_name, seq, timestamp_unix, query_id
  FROM prep WHERE table_name <> ''
 UNION ALL SELECT run_id, session_key, 'Query', query_id::VARCHAR, 'accesses', 'Role', role_name, seq, timestamp_unix, query_id
  FROM prep WHERE role_name <> ''
 UNION ALL SELECT run_id, session_key, 'Process', parent_pid::VARCHAR, 'spawns', 'Process', pid::VARCHAR, seq, timestamp_unix, event_id
  FROM prep WHERE parent_pid IS NOT NULL
 UNION ALL SELECT run_id, session_key, 'Query', spawn_query::VARCHAR, 'spawns', 'Process', pid::VARCHAR, seq, timestamp_unix, event_id
  FROM prep WHERE spawn_query IS NOT NULL
 UNION ALL SELECT run_id, session_key, 'Process', pid::VARCHAR, 'opens', 'File', arg, seq, timestamp_unix, event_id
  FROM prep WHERE syscall IN ('openat', 'unlink', 'rename')
 UNION ALL SELECT run_id, session_key, 'Process', pid::VARCHAR, 'connects_to', 'Endpoint', dest_ip || ':' || dest_port, seq,
  timestamp_unix, event_id FROM prep WHERE syscall = 'connect' AND dest_ip <> ''""",
    "edges": """SELECT run_id, session_key, src_type, src_key, rel, dst_type, dst_key, count(*) AS "count",
  min(timestamp_unix) AS first_seen, max(timestamp_unix) AS last_seen,
  list(event_id ORDER BY seq) AS event_ids FROM links GROUP BY 1, 2, 3, 4, 5, 6, 7""",
    "texts": """SELECT *, CASE node_type WHEN 'Query' THEN COALESCE(query, '') WHEN 'Process' THEN comm || ' ' || arg
  WHEN 'Endpoint' THEN dest_ip ELSE node_key END AS text FROM nodes""",
    "ends": """SELECT e.*, s.text AS src_text, s.timestamp_unix AS src_ts, d.text AS dst_text, d.timestamp_unix AS dst_ts,
  list_distinct(list_filter(string_split_regex(lower(s.text || ' ' || d.text), '[^a-z0-9_]+'), lambda w: w <> '')) AS ws
 FROM edges e JOIN texts s ON s.run_id = e.run_id AND s.session_key = e.session_key AND s.node_type = e.src_type AND s.node_key = e.src_key
  JOIN texts d ON d.run_id = e.run_id AND d.session_key = e.session_key AND d.node_type = e.dst_type AND d.node_key = e.dst_key""",
}


def _behavior_parts() -> str:
    from spoorline.operators.behaviors import RULES

    parts = []
    for i, r in enumerate(RULES):
        words = ", ".join(f"'{k}'" for k in r.keywords)
        sem = (
            f"CASE WHEN len(ws) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(ws, [{words}])) "
            f"/ sqrt((len(ws) * {len(r.keywords)})::DOUBLE) END"
        )
        cond = f"src_type = '{r.src_type}' AND rel = '{r.rel}' AND dst_type = '{r.dst_type}'"
        if r.src:
            cond += f" AND regexp_matches(src_text, '{r.src}')"
        if r.dst:
            cond += f" AND regexp_matches(dst_text, '{r.dst}')"
        if r.needs_keyword:
            cond += f" AND len(list_intersect(ws, [{words}])) > 0"
        parts.append(
            f"SELECT *, {i} AS rule_order, '{r.label}' AS behavior, '{r.mitre}' AS mitre_id, {sem} AS sem "
            f"FROM ends WHERE {cond}"
        )
    return " UNION ALL ".join(parts)


def _chain_parts() -> str:
    """Ordered occurrence of each chain, by nested earliest positions."""
    from spoorline.operators.risk import CHAINS

    parts = []
    for i, c in enumerate(CHAINS):
        names = ", ".join(f"'{x}'" for x in c.labels)
        joins, prev = [], "b0"
        for j in range(1, len(c.labels)):
            joins.append(
                f"JOIN found b{j} ON b{j}.run_id = b0.run_id AND b{j}.session_key = b0.session_key "
                f"AND b{j}.behavior = '{c.labels[j]}' AND b{j}.chain_no > {prev}.chain_no"
            )
            prev = f"b{j}"
        parts.append(
            f"SELECT {i} AS chain_order, '{c.scenario}' AS scenario, f.run_id, f.session_key, "
            f"{float(c.weight)}::DOUBLE * avg(f.confidence) AS rule_score FROM found f "
            f"WHERE f.behavior IN ({names}) AND EXISTS (SELECT 1 FROM found b0 {' '.join(joins)} "
            f"WHERE b0.behavior = '{c.labels[0]}' AND b0.run_id = f.run_id AND b0.session_key = f.session_key) "
            "GROUP BY f.run_id, f.session_key"
        )
    return " UNION ALL ".join(parts)


def _all() -> dict[str, str]:
    out = dict(CTES)
    out["hits"] = _behavior_parts()
    out["found"] = """SELECT *, '[' || mitre_id || '] ' || behavior AS label, round(0.4::DOUBLE + 0.6::DOUBLE * sem, 3) AS confidence,
  round(sem, 3) AS s_sem, round(exp(-abs(src_ts - dst_ts) / 60.0::DOUBLE), 3) AS s_temp, greatest(src_ts, dst_ts) AS timestamp_unix,
  row_number() OVER (PARTITION BY run_id, session_key ORDER BY greatest(src_ts, dst_ts), rule_order, src_type, src_key, dst_key) - 1
  AS chain_no FROM hits"""
    out["chains"] = _chain_parts()
    out["best"] = """SELECT run_id, session_key, scenario, rule_score FROM chains QUALIFY row_number() OVER
  (PARTITION BY run_id, session_key ORDER BY rule_score DESC, chain_order) = 1"""
    return out


def with_ctes(select: str, extra: str = "") -> str:
    """``select`` over the derived tables."""
    return chain_ctes(select, {}, extra)


def chain_ctes(select: str, changed: dict[str, str], extra: str = "") -> str:
    """``select`` over the derived tables, some of them ``changed``.

    A changed table takes the place of its namesake; new ones stand before the next changed one.
    """
    chain, waiting = {}, dict(changed)
    for name, q in _all().items():
        if name in waiting:
            while (first := next(iter(waiting))) != name:
                chain[first] = waiting.pop(first)
            q = waiting.pop(name)
        chain[name] = q
    text = ",\n".join(f"{n} AS ({q})" for n, q in chain.items())
    tail = f",\n{extra}" if extra else ""
    return f"WITH RECURSIVE {oracle_ctes()},\n{text}{tail}\n{select}"
