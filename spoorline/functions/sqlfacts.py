"""Facts of SQL statements, as column expressions.

Only the first statement of a text counts. Comments go and all kinds of literals
become plain ones before anything else; then literals are emptied before any
keyword is looked for, and their contents are fetched by position afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDED = "§"

FACTS = [
    "table_name", "is_program", "shell_cmd", "is_drop", "role_name", "is_role_change",
    "is_superuser", "is_privilege_escalation", "is_destructive", "is_truncate", "setting_name",
    "setting_value", "is_system_config", "parse_error",
]

# First words of PostgreSQL statements.
STATEMENT_WORDS = (
    "abort alter analyze begin call checkpoint close cluster comment commit copy create deallocate "
    "declare delete discard do drop end execute explain fetch grant import insert listen load lock "
    "merge move notify prepare reassign refresh reindex release reset revoke rollback savepoint "
    "security select set show start table truncate unlisten update vacuum values with"
).split()

NAME = r'("[^"]+"|\w+)'

# Lexical pieces of a statement: E-strings, strings, quoted names, comments (one level nested;
# `without_nested` has taken out deeper ones),
# dollar strings, words, and any other character.
_COMMENT = r"(?:[^*/]|\*(?!/)|/(?!\*)"
TOKENS = (
    r"(?s)[eE]'(?:[^'\\]|\\.|'')*+'|'(?:[^']|'')*+'|\"(?:[^\"]|\"\")*+\"|--[^\n]*"
    rf"|/\*{_COMMENT}|/\*{_COMMENT})*+\*/)*+\*/"
    r"|\$((?:[A-Za-z_]\w*)?)\$.*?\$\1\$|\w[\w$]*|."
)
#: What opens, closes or escapes something; everything between is one token.
MARKS = r"""(?s)/\*|\*/|--|\$(?:[A-Za-z_]\w*)?\$|''|\b[eE]'|['"\\\n]|\w[\w$]*|[^\w'"\\\n$/*-]+|."""
#: Only texts with a comment inside a comment are folded for them.
NESTED = r"(?s)/\*.*/\*"
#: Only texts with one of these have anything to make plain.
UNCOMMON = r"""--|/\*|\$|"|[eE]'"""
# characters of quoted names that would be taken for quotes, ends or parentheses, and their stand-ins
_INSIDE, _STAND_INS = "';()", "\uE001\uE002\uE003\uE004"
_BACKSLASH = "\uE005"
#: Objects whose names a DROP lists as plain names.
DROPPED = (
    r"(?:TABLE|VIEW|INDEX|SEQUENCE|MATERIALIZED\s+VIEW|FOREIGN\s+TABLE|COLLATION|CONVERSION|STATISTICS"
    r"|TEXT\s+SEARCH\s+(?:PARSER|DICTIONARY|TEMPLATE|CONFIGURATION)|TRIGGER|RULE|POLICY)"
)
QUALIFIED = rf'(?:(?:"[^"]+"|\w+)\.)*{NAME}'


def _plain_token(token: Column) -> Column:
    body = F.regexp_extract(token, r"(?s)^\$(\w*)\$(.*)\$\1\$$", 2)
    escaped = F.regexp_extract(token, r"(?s)^[eE]'(.*)'$", 1)
    for pattern, to in (
        (r"\\\\", _BACKSLASH), (r"\\'", "''"), (r"\\n", "\n"), (r"\\t", "\t"), (r"\\r", "\r"),
        (r"\\(.)", "$1"), (_BACKSLASH, r"\\"),
    ):
        escaped = F.regexp_replace(escaped, pattern, to)
    quote = F.lit("'")
    return (
        F.when(token.startswith("--") | token.startswith("/*"), F.lit(" "))
        .when(
            token.rlike(r"(?s)^\$.*\$$") & (F.length(token) > 1),
            F.concat(quote, F.replace(body, quote, F.lit("''")), quote),
        )
        .when(token.rlike("^[eE]'"), F.concat(quote, escaped, quote))
        .when(token.startswith('"'), F.translate(token, _INSIDE, _STAND_INS))
        .otherwise(token)
    )


def without_nested(text: Column) -> Column:
    """The text with a space for each block comment, however deep others are nested in it.

    A fold over the marks: ``mode`` is what the text is inside of (the mark that opened it), ``depth``
    counts open comments, ``held`` is set behind a backslash in an E-string.
    """

    def step(at: Column, token: Column) -> Column:
        mode, held, string = at["mode"], at["held"], token == "'"
        opens = token.isin("'", '"', "--", "/*") | token.rlike(r"^(?:[eE]'|\$\w*\$)$")
        depth = at["depth"] + F.when(token == "/*", 1).when(token == "*/", -1).otherwise(0)
        in_comment = mode == "/*"
        escaped = F.lower(mode) == "e'"
        closes = (
            F.when(mode == "'", string)
            .when(escaped & held, token == "''")
            .when(escaped, string)
            .when(mode == "--", token == "\n")
            .otherwise(token == mode)
        )
        ended = F.when(in_comment, depth == 0).otherwise(closes)
        after = F.when(mode == "", F.when(opens, token).otherwise("")).otherwise(F.when(ended, "").otherwise(mode))
        shown = F.when(in_comment, F.when(depth == 0, " ").otherwise("")).when((mode == "") & (token == "/*"), "").otherwise(token)
        return F.struct(
            after.alias("mode"),
            F.when(in_comment, depth).when((mode == "") & (token == "/*"), 1).otherwise(0).alias("depth"),
            (escaped & ~held & (token == "\\")).alias("held"),
            F.concat(at["text"], shown).alias("text"),
        )

    none = F.struct(F.lit("").alias("mode"), F.lit(0).alias("depth"), F.lit(False).alias("held"), F.lit("").alias("text"))
    # an open comment at the end is an error, which its opening tells
    last = lambda at: F.when(at["mode"] == "/*", F.concat(at["text"], F.lit("'"))).otherwise(at["text"])
    return F.aggregate(F.regexp_extract_all(text, F.lit(MARKS), F.lit(0)), none, step, last)


def plain_text(text: Column) -> Column:
    """The text without comments; dollar strings and E-strings become plain literals."""
    text = F.when(text.rlike(NESTED), without_nested(text)).otherwise(text)
    tokens = F.regexp_extract_all(text, F.lit(TOKENS), F.lit(0))
    plain = F.array_join(F.transform(tokens, _plain_token), "")
    return F.when(text.rlike(UNCOMMON), plain).otherwise(text)


def pieces(text: Column) -> Column:
    """The text cut at its quotes; odd pieces are inside literals."""
    return F.split(text, "'", -1)


def emptied(cut: Column) -> Column:
    """The text with every literal emptied."""
    return F.array_join(
        F.transform(cut, lambda x, i: F.when(i % 2 == 0, x).otherwise(F.lit(""))), "'"
    )


def literal_after(cut: Column, head: Column) -> Column:
    """The literal that opens right after ``head``, a prefix of the emptied text."""
    start = F.length(head) - F.length(F.regexp_replace(head, "'", "")) + 1
    last = F.size(cut) - 1
    ends = F.filter(
        F.sequence(start, F.greatest(last - 1, start), F.lit(2)),
        lambda j: (j + 1 >= last) | (F.get(cut, j + 1) != ""),
    )
    inside = F.transform(
        F.sequence(start, F.coalesce(F.get(ends, F.lit(0)), start), F.lit(2)),
        lambda i: F.get(cut, i),
    )
    return F.when((F.length(head) > 0) & (start < last), F.array_join(inside, "'"))


def identifier(raw: Column) -> Column:
    """Quoted names keep their case, bare ones are folded to lower case."""
    quoted = F.translate(F.regexp_replace(raw, '"', ""), _STAND_INS, _INSIDE)
    name = F.when(raw.startswith('"'), quoted).otherwise(F.lower(raw))
    return F.when(raw != "", name)


def _extract(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(text, "(?is)" + pattern, group)


def _folded(bare: Column) -> Column:
    """Parentheses and their contents replaced by a mark, innermost first, until none is left."""
    opened = F.length(bare) - F.length(F.replace(bare, F.lit("("), F.lit("")))

    def fold(text, _):
        inner = F.regexp_replace(text, r"\([^()]*\)", f" {FOLDED} ")
        return F.when(F.instr(text, "(") == 0, text).otherwise(inner)

    return F.when(opened == 0, bare).otherwise(
        F.aggregate(F.sequence(F.lit(1), F.greatest(opened, F.lit(1))), bare, fold)
    )


def _kind(bare: Column) -> Column:
    patterns = [
        ("copy", r"^\s*COPY\b"),
        ("truncate", r"^\s*TRUNCATE\b"),
        ("create_role", r"^\s*CREATE\s+(?:ROLE|USER|GROUP)\s+(?!MAPPING\b)"),
        ("alter_system", r"^\s*ALTER\s+SYSTEM\b"),
        # settings and renames of a role are other statements
        (
            "other",
            rf"^\s*ALTER\s+(?:ROLE|USER|GROUP)\s+(?:MAPPING\b|{NAME}\s+(?:IN\s+DATABASE\s+{NAME}\s+)?(?:SET|RESET|RENAME)\b)",
        ),
        ("alter_role", r"^\s*ALTER\s+(?:ROLE|USER|GROUP)\s"),
        ("set_role", r"^\s*(?:SET\s+(?:SESSION\s+|LOCAL\s+)?|RESET\s+)ROLE\b"),
        ("drop", rf"^\s*DROP\s+{DROPPED}\s"),
        ("dml", r"^\s*(?:INSERT\s+INTO|UPDATE|DELETE\s+FROM)\b"),
        ("select", r"^[\s(]*(?:SELECT|WITH)\b"),
        ("table", r"^[\s(]*TABLE\s"),
    ]
    out = F.lit(None).cast("string")
    for name, pattern in reversed(patterns):
        out = F.when(bare.rlike("(?is)" + pattern), F.lit(name)).otherwise(out)
    return out


def _parse_error(cut: Column, bare: Column) -> Column:
    """Set if a text starts with no statement word, or quotes or parentheses do not match."""
    word = F.lower(_extract(bare, r"^\s*\(*\s*(\w*)"))
    opened, closed = (F.length(F.replace(bare, F.lit(c), F.lit(""))) for c in "()")
    wrong = ~word.isin(STATEMENT_WORDS) | (F.size(cut) % 2 == 0) | (opened != closed)
    return F.when(
        bare.isNotNull() & (F.trim(bare) != "") & wrong,
        F.concat(F.lit('syntax error at or near "'), word, F.lit('"')),
    )


def _select_table(flat: Column) -> Column:
    # in a comparison FROM is no clause
    flat = F.regexp_replace(flat, r"(?is)\bIS\s+(?:NOT\s+)?DISTINCT\s+FROM\b", " = ")
    common = _extract(flat, rf"{FOLDED}\s*(?:INSERT\s+INTO|UPDATE(?:\s+ONLY)?|DELETE\s+FROM(?:\s+ONLY)?)\s+{QUALIFIED}")
    name = _extract(flat, rf"\bFROM\s+(?:ONLY\s+)?{QUALIFIED}")
    items = _extract(flat, r"\bFROM\s+(.*)$")
    first_item = F.element_at(F.split(items, ","), 1)
    plain = (
        (name != "")
        & (~flat.rlike(r"(?is)\b(?:UNION|INTERSECT|EXCEPT)\b"))
        & (~items.rlike(rf"(?is)^(?:ONLY\s+)?[\w.\"]+\s*{FOLDED}"))
        & (~items.rlike(rf"(?is)^\s*(?:LATERAL\s|{FOLDED})"))
        & (~first_item.rlike(r"(?is)\bJOIN\b"))
    )
    return F.when(common != "", identifier(common)).when(plain, identifier(name))


def with_statement_facts(df: DataFrame, text: str = "query") -> DataFrame:
    """Add the fact columns of the statement in column ``text``; null means "not stated"."""
    df = df.withColumn("_plain", plain_text(F.col(text)))
    df = df.withColumn("_cut", F.when(F.trim("_plain") != "", pieces(F.col("_plain"))))
    df = df.withColumn("_text", emptied(F.col("_cut")))
    df = df.withColumn("_bare", F.element_at(F.split(F.col("_text"), ";"), 1))
    df = df.withColumn("parse_error", _parse_error(F.col("_cut"), F.col("_bare")))
    known = F.col("parse_error").isNull()
    df = df.withColumn("_kind", F.when(known, _kind(F.col("_bare"))))
    unwrapped = F.regexp_replace(F.col("_bare"), r"^[\s(]+", "")
    unwrapped = F.regexp_replace(unwrapped, r'(?i)\bONLY\s*\(\s*((?:(?:"[^"]+"|\w+)\.)*(?:"[^"]+"|\w+))\s*\)', "ONLY $1")
    df = df.withColumn("_flat", F.when(F.col("_kind").isin("select", "table"), _folded(unwrapped)))
    cut, bare, kind = F.col("_cut"), F.col("_bare"), F.col("_kind")

    def on(*kinds):
        return kind.isin(*kinds)

    yes = F.lit(True)
    program = _extract(bare, r"^(.*?\b(?:TO|FROM)\s+PROGRAM\s+(?:E)?)'")
    setting = _extract(bare, r"^(\s*ALTER\s+SYSTEM\s+SET\s+[\w.]+\s*(?:=|TO)\s*)'")
    role = rf"(?:ROLE|USER|GROUP)\s+{NAME}"
    role_rest = _extract(bare, rf"^\s*(?:CREATE|ALTER)\s+{role}(.*)$", 2)
    table = (
        F.when(on("copy"), identifier(_extract(bare, rf"^\s*COPY\s+(?:BINARY\s+)?{QUALIFIED}")))
        .when(on("truncate"), identifier(_extract(bare, rf"^\s*TRUNCATE\s+(?:TABLE\s+)?(?:ONLY\s+)?{QUALIFIED}")))
        .when(
            on("drop"),
            identifier(
                _extract(
                    bare,
                    rf"^\s*DROP\s+{DROPPED}\s+(?:CONCURRENTLY\s+)?"
                    rf"(?:IF\s+EXISTS\s+)?{QUALIFIED}",
                )
            ),
        )
        .when(
            on("dml"),
            identifier(
                _extract(
                    bare,
                    r"^\s*(?:INSERT\s+INTO|UPDATE(?:\s+ONLY)?|DELETE\s+FROM(?:\s+ONLY)?)\s+"
                    rf"{QUALIFIED}",
                )
            ),
        )
        .when(on("select"), _select_table(F.col("_flat")))
        .when(
            on("table") & ~F.col("_flat").rlike(r"(?is)\b(?:UNION|INTERSECT|EXCEPT)\b"),
            identifier(_extract(F.col("_flat"), rf"^TABLE\s+(?:ONLY\s+)?{QUALIFIED}")),
        )
    )
    to_role = r"^\s*SET\s+(?:SESSION\s+|LOCAL\s+)?ROLE\s*(?:=|\bTO\b)?\s*"
    role_set = _extract(bare, to_role + NAME)
    role_name = F.when(
        on("create_role", "alter_role"),
        identifier(_extract(bare, rf"^\s*(?:CREATE|ALTER)\s+{role}")),
    ).when(
        on("set_role"),
        F.coalesce(
            identifier(F.when(F.lower(role_set) != "default", role_set).otherwise("")),
            literal_after(cut, _extract(bare, f"({to_role})'")),
        ),
    )
    word = F.lower(_extract(bare, r"^\s*ALTER\s+SYSTEM\s+SET\s+[\w.]+\s*(?:=|\bTO\b)\s*([A-Za-z_]\w*)"))
    grants = role_rest.rlike(r"(?is)\bSUPERUSER\b")
    facts = {
        "table_name": table,
        "is_program": F.when(on("copy"), program != ""),
        "shell_cmd": F.when(on("copy"), literal_after(cut, program)),
        "is_drop": F.when(on("drop"), yes),
        "role_name": role_name,
        "is_role_change": F.when(on("create_role", "alter_role", "set_role"), yes),
        "is_superuser": F.when(on("create_role"), role_rest.rlike(r"(?is)\b(?:NO)?SUPERUSER\b")).when(
            on("alter_role"), grants
        ),
        "is_privilege_escalation": F.when(on("alter_role"), grants),
        "is_destructive": F.when(on("truncate"), yes),
        "is_truncate": F.when(on("truncate"), yes),
        "setting_name": F.when(
            on("alter_system"),
            F.lower(_extract(bare, r"^\s*ALTER\s+SYSTEM\s+(?:SET|RESET)\s+([\w.]+)")),
        ),
        "setting_value": F.when(
            on("alter_system"),
            F.coalesce(literal_after(cut, setting), F.when(~word.isin("", "default"), word)),
        ),
        "is_system_config": F.when(on("alter_system"), yes),
    }
    return df.withColumns(facts).drop("_plain", "_cut", "_text", "_bare", "_kind", "_flat")


def join_statement_facts(df: DataFrame, text: str = "query") -> DataFrame:
    """The same columns, read once per distinct text and joined to its rows; a null text states nothing.

    Logs repeat few texts. The side of the texts has one row a key, so a frequent one is split by the
    adaptive join.
    """
    once = with_statement_facts(df.select(text).where(F.col(text).isNotNull()).distinct(), text)
    joined = df.join(once.withColumnRenamed(text, "_text"), F.col(text) == F.col("_text"), "left")
    return joined.drop("_text")
