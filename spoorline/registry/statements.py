"""Statement facts on texts as they come from clients, with facts written by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from spoorline.functions.sqlfacts import FACTS, with_statement_facts
from spoorline.sources import tables

QUERIES, ORACLE = {}, {}

ROLE = {"is_role_change": True}
ALTERED = {**ROLE, "is_superuser": False, "is_privilege_escalation": False}
CONFIG = {"is_system_config": True}

#: Text and stated facts; ``{n}`` in a text is the number of the event.
TEXTS: list[tuple[str, dict]] = [
    ("/* app={n} */ SELECT * FROM customers", {"table_name": "customers"}),
    ("-- it's {n}; (\nSELECT a FROM public.accounts, b", {"table_name": "accounts"}),
    ("SELECT /* a /* ' */ {n} */ 1 FROM \"It's; (x\" -- '", {"table_name": "It's; (x"}),
    ("SELECT $$it's; ({n}$$ FROM customers", {"table_name": "customers"}),
    (r"SELECT E'a\'b; ( {n}' FROM customers", {"table_name": "customers"}),
    ("COPY c{n} TO PROGRAM $x$cat 'f'$x$", {"table_name": "c{n}", "is_program": True, "shell_cmd": "cat 'f'"}),
    (r"COPY c TO PROGRAM E'echo \'{n}\''", {"table_name": "c", "is_program": True, "shell_cmd": "echo '{n}'"}),
    ("ALTER SYSTEM SET logging_collector TO off -- {n}", {**CONFIG, "setting_name": "logging_collector", "setting_value": "off"}),
    ("ALTER SYSTEM SET log_statement = NONE", {**CONFIG, "setting_name": "log_statement", "setting_value": "none"}),
    ("ALTER SYSTEM SET work_mem = {n}", {**CONFIG, "setting_name": "work_mem"}),
    ("ALTER SYSTEM SET work_mem TO DEFAULT", {**CONFIG, "setting_name": "work_mem"}),
    ("ALTER ROLE r{n} SET search_path TO x", {}),
    ("ALTER ROLE r{n} IN DATABASE d RESET ALL", {}),
    ("ALTER USER bob RENAME TO eve{n}", {}),
    ("ALTER GROUP g{n} ADD USER bob", {**ALTERED, "role_name": "g{n}"}),
    ("ALTER ROLE \"Big {n}\" WITH SUPERUSER", {"role_name": "Big {n}", "is_role_change": True, "is_superuser": True, "is_privilege_escalation": True}),
    ("SET role TO auditor{n}", {**ROLE, "role_name": "auditor{n}"}),
    ("SET LOCAL role = 'Auditor {n}'", {**ROLE, "role_name": "Auditor {n}"}),
    ("RESET ROLE -- {n}", ROLE),
    ("(SELECT * FROM customers{n})", {"table_name": "customers{n}"}),
    ("((SELECT 1 FROM a) UNION (SELECT {n}))", {}),
    ("TABLE customers{n}", {"table_name": "customers{n}"}),
    ("DROP FOREIGN TABLE IF EXISTS s.ft{n}", {"table_name": "ft{n}", "is_drop": True}),
    ("-- only {n}", {}),
    ("selec {n}", {"parse_error": 'syntax error at or near "selec"'}),
    ("SELECT '{n}", {"parse_error": 'syntax error at or near "select"'}),
]


def _literal(text: str) -> str:
    """A literal in which the number of the event takes its place, for DuckDB."""
    whole = "'" + text.replace("'", "''") + "'"
    return f"replace({whole}, '{{n}}', event_id::VARCHAR)"


def _value(value) -> str:
    if value is None:
        return "NULL"
    return _literal(value) if isinstance(value, str) else f"'{str(value).lower()}'"


def _expected() -> str:
    def fact(name):
        cases = " ".join(f"WHEN {i} THEN {_value(f.get(name))}" for i, (_, f) in enumerate(TEXTS))
        return f"CASE event_id % {len(TEXTS)} {cases} END AS {name}"

    return f"SELECT event_id, {', '.join(map(fact, FACTS))} FROM events"


def real_statements(spark, d):
    """Every event carries one of the texts; facts as text, null if not stated."""
    events = tables.table(spark, d, "events")
    which = F.col("event_id") % len(TEXTS)
    text = F.lit(None).cast("string")
    for i, (template, _) in enumerate(TEXTS):
        own = F.replace(F.lit(template), F.lit("{n}"), F.col("event_id").cast("string"))
        text = F.when(which == i, own).otherwise(text)
    facts = with_statement_facts(events.select("event_id", text.alias("query")))
    return facts.select("event_id", *[F.col(f).cast("string").alias(f) for f in FACTS])


QUERIES["p03_real_statements"] = real_statements
ORACLE["p03_real_statements"] = _expected()
