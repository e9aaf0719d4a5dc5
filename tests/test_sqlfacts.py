import pytest

from spoorline.functions.sqlfacts import FACTS, with_statement_facts

CASES = {
    "/* a /* b /* c */ ' */ \" */ SELECT * FROM t1": {"table_name": "t1"},
    "SELECT '/* /* ', \"/*\" FROM t2 /* x /* y /* z */ */ */ -- /* '": {"table_name": "t2"},
    "SELECT E'\\' /* ', $q$ /* ' $q$ FROM t3 /*/**//*/**/*/*/": {"table_name": "t3"},
    "SELECT 'a''/*' FROM t4 -- it's /* not open\n /* /* /* */ */ */": {"table_name": "t4"},
    "SELECT 1 /* /* */": {"parse_error": 'syntax error at or near "select"'},
    "SELECT a IS DISTINCT FROM b FROM t": {"table_name": "t"},
    "SELECT a IS NOT DISTINCT FROM b FROM t WHERE c IS DISTINCT FROM d": {"table_name": "t"},
    "SELECT a IS DISTINCT FROM b": {},
    "SELECT * FROM ONLY (public.t)": {"table_name": "t"},
    "DROP TRIGGER IF EXISTS trg ON public.t CASCADE": {"table_name": "trg", "is_drop": True},
    'DROP RULE "R1" ON t': {"table_name": "R1", "is_drop": True},
    "DROP POLICY p ON t": {"table_name": "p", "is_drop": True},
    "COPY (SELECT 'it''s', id FROM c) TO PROGRAM 'curl -H ''a: b'' -d @-'":
        {"is_program": True, "shell_cmd": "curl -H 'a: b' -d @-"},
    "COPY (SELECT 'TO PROGRAM ''x''' FROM c) TO STDOUT": {"is_program": False},
    "COPY public.accounts FROM PROGRAM 'cat'":
        {"table_name": "accounts", "is_program": True, "shell_cmd": "cat"},
    "SELECT a FROM x, y": {"table_name": "x"},
    "SELECT a FROM x JOIN y ON 1=1": {},
    "SELECT a FROM x, y JOIN z ON 1=1": {"table_name": "x"},
    "SELECT a FROM x UNION SELECT 1": {},
    "SELECT * FROM f(1)": {},
    "SELECT * FROM (SELECT 1 FROM t) q": {},
    "SELECT (SELECT max(b) FROM u) FROM information_schema.tables": {"table_name": "tables"},
    "WITH c AS (SELECT 1) SELECT * FROM c": {"table_name": "c"},
    "CREATE ROLE r LOGIN PASSWORD 'SUPERUSER'":
        {"role_name": "r", "is_role_change": True, "is_superuser": False},
    "CREATE ROLE r NOSUPERUSER": {"role_name": "r", "is_role_change": True, "is_superuser": True},
    "ALTER ROLE b WITH NOSUPERUSER":
        {"role_name": "b", "is_role_change": True, "is_superuser": False, "is_privilege_escalation": False},
    "ALTER ROLE b WITH SUPERUSER":
        {"role_name": "b", "is_role_change": True, "is_superuser": True, "is_privilege_escalation": True},
    "ALTER SYSTEM SET log_statement = 'none'":
        {"setting_name": "log_statement", "setting_value": "none", "is_system_config": True},
    "ALTER SYSTEM SET work_mem = 4": {"setting_name": "work_mem", "is_system_config": True},
    "SET ROLE 'Bob'": {"role_name": "Bob", "is_role_change": True},
    "DROP TABLE IF EXISTS public.t1, t2": {"table_name": "t1", "is_drop": True},
    "DROP ROLE x": {},
    "TRUNCATE TABLE a.b, c": {"table_name": "b", "is_destructive": True, "is_truncate": True},
    'INSERT INTO "Big"."T x" VALUES (1)': {"table_name": "T x"},
    "UPDATE ONLY Acc SET a=1": {"table_name": "acc"},
    "DELETE FROM x": {"table_name": "x"},
    "GRANT SELECT ON t TO r": {},
    "SELECT ';' FROM t; DROP TABLE z": {"table_name": "t"},
    "/* app */ SELECT * FROM customers": {"table_name": "customers"},
    "-- note; it's\nSELECT * FROM customers": {"table_name": "customers"},
    "SELECT /* a /* nested ' */ b */ * FROM customers -- '": {"table_name": "customers"},
    "-- only a comment": {},
    "SELECT $$it's; (here$$ FROM customers": {"table_name": "customers"},
    "SELECT $a$ $$ ' $a$, $1 FROM customers": {"table_name": "customers"},
    r"SELECT E'a\'b; (' FROM customers": {"table_name": "customers"},
    r"COPY c TO PROGRAM E'echo \'x\' \\ y'": {"table_name": "c", "is_program": True, "shell_cmd": r"echo 'x' \ y"},
    "COPY c TO PROGRAM $$cat 'f'$$": {"table_name": "c", "is_program": True, "shell_cmd": "cat 'f'"},
    "ALTER SYSTEM SET logging_collector TO off":
        {"setting_name": "logging_collector", "setting_value": "off", "is_system_config": True},
    "ALTER SYSTEM SET log_statement = NONE":
        {"setting_name": "log_statement", "setting_value": "none", "is_system_config": True},
    "ALTER SYSTEM SET log_statement TO DEFAULT": {"setting_name": "log_statement", "is_system_config": True},
    "ALTER SYSTEM RESET work_mem": {"setting_name": "work_mem", "is_system_config": True},
    "ALTER ROLE bob SET search_path TO x": {},
    "ALTER ROLE bob IN DATABASE d RESET ALL": {},
    "ALTER USER bob RENAME TO eve": {},
    "ALTER GROUP staff ADD USER bob":
        {"role_name": "staff", "is_role_change": True, "is_superuser": False, "is_privilege_escalation": False},
    "SET role TO auditor": {"role_name": "auditor", "is_role_change": True},
    "SET LOCAL role = 'auditor'": {"role_name": "auditor", "is_role_change": True},
    "SET role TO DEFAULT": {"is_role_change": True},
    "RESET ROLE": {"is_role_change": True},
    "(SELECT * FROM customers)": {"table_name": "customers"},
    "((SELECT * FROM customers) UNION (SELECT 1))": {},
    "TABLE customers": {"table_name": "customers"},
    "TABLE a UNION TABLE b": {},
    "DROP FOREIGN TABLE ft": {"table_name": "ft", "is_drop": True},
    'SELECT * FROM "a;b"': {"table_name": "a;b"},
    """SELECT * FROM s."it's (x" WHERE a = 'q'""": {"table_name": "it's (x"},
    "": {},
    "foo bar": {"parse_error": 'syntax error at or near "foo"'},
    "SELECT (1": {"parse_error": 'syntax error at or near "select"'},
}


@pytest.fixture(scope="module")
def facts(spark):
    df = spark.createDataFrame([(q,) for q in CASES], "query string")
    return {r.query: r.asDict() for r in with_statement_facts(df).collect()}


@pytest.mark.parametrize("text", list(CASES))
def test_facts(facts, text):
    assert {f: facts[text][f] for f in FACTS if facts[text][f] is not None} == CASES[text]


def test_long_texts_do_not_overflow(spark):
    text = "COPY (SELECT 1) TO PROGRAM 'echo " + "a''b(" * 50000 + "'"
    row = with_statement_facts(spark.createDataFrame([(text,)], "query string")).first()
    assert row.shell_cmd == "echo " + "a'b(" * 50000
