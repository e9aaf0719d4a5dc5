"""Data-quality queries on scenario specs, corpora and captures."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoorline.functions.text import mask_literals

# The closed vocabularies of the spec format.
DIMENSIONS = [
    "process_tree_shape", "syscall_sequence", "timing_pattern", "sql_content",
    "connects_to_destination", "role",
]
TEMPOS = ["bursty", "steady", "scheduled", "off_hours"]
ANCHORS = ["db", "synthetic", "none"]
RELATIONSHIPS = ["agrees", "benign_false_positive", "malicious_false_negative"]
CLASSES = ["benign", "malicious"]


def minutes_of_day(text: Column) -> Column:
    """Minutes of "HH:MM"."""
    return F.element_at(F.split(text, ":"), 1).cast("int") * 60 + F.element_at(
        F.split(text, ":"), 2
    ).cast("int")


def spec_sessions(specs: DataFrame, *more: str) -> DataFrame:
    """One row per session of a spec, with the scenario's fields and ``more`` fields of the session."""
    return specs.select(
        "run_id",
        "scenario_id",
        "family_id",
        "matched_pair_id",
        "matched_dimensions",
        "time_of_day",
        "default_class",
        F.coalesce("rule_engine_relationship", F.lit("agrees")).alias("rule_engine_relationship"),
        F.posexplode("sessions").alias("session_no", "s"),
    ).select(
        "*",
        "s.session_label",
        F.coalesce("s.class", "default_class").alias("class"),
        "s.role",
        F.coalesce("s.anchor", F.lit("db")).alias("anchor"),
        "s.concurrent_with",
        F.coalesce("s.delay_after_previous_seconds", F.lit(0.0)).alias("delay_s"),
        F.col("s.timing.tempo").alias("tempo"),
        F.col("s.timing.step_gaps_seconds").alias("gaps"),
        "s.events",
        *[f"s.{name}" for name in more],
    ).drop("s")


def gap_stats(gaps: Column) -> tuple[Column, Column, Column]:
    """Mean, smallest and largest gap."""
    mean = F.aggregate(gaps, F.lit(0.0), lambda a, g: a + g) / F.size(gaps)
    return mean, F.array_min(gaps), F.array_max(gaps)


def spec_violations(specs: DataFrame) -> DataFrame:
    """Broken rules, one row per session and rule."""
    s = spec_sessions(specs).withColumn(
        "_dims", F.concat(
            F.coalesce("matched_dimensions.fixed", F.array().cast("array<string>")),
            F.coalesce("matched_dimensions.varied", F.array().cast("array<string>")),
        )
    )
    mean, low, high = gap_stats(F.col("gaps"))
    some = F.size("gaps") > 0
    at = minutes_of_day(F.col("time_of_day"))
    rules = {
        "class": ~F.coalesce(F.col("class").isin(CLASSES), F.lit(False)),
        "anchor": ~F.col("anchor").isin(ANCHORS),
        "tempo": ~F.coalesce(F.col("tempo").isin(TEMPOS), F.lit(False)),
        "relationship": ~F.col("rule_engine_relationship").isin(RELATIONSHIPS),
        "dimension": ~F.forall("_dims", lambda d: d.isin(DIMENSIONS)),
        "pair_dimensions": F.col("matched_pair_id").isNotNull() & F.col("matched_dimensions").isNull(),
        "bursty_gap": (F.col("tempo") == "bursty") & some & (high >= 2),
        "steady_gap": (F.col("tempo") == "steady") & some
        & ((high > mean * 1.2) | (low < mean * 0.8)),
        "off_hours": (F.col("tempo") == "off_hours") & at.between(8 * 60, 18 * 60 - 1),
    }
    broken = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))
    return s.select(
        "run_id", "scenario_id", "session_label", F.explode(broken).alias("rule")
    )


def with_dimensions(sessions: DataFrame) -> DataFrame:
    """What a session shows in each matched dimension, one column per dimension.

    Processes are compared by command and parent command, events by their system call, and
    statements by their texts in order (``_masked`` has their literals taken out).
    """
    e = F.col("events")
    commands = F.filter(e, lambda x: x["process"].isNotNull())

    def parent(x):
        return F.get(F.filter(commands, lambda y: y["step_id"] == x["process"]["parent"]), F.lit(0))["process"]["comm"]

    shape = F.array_sort(
        F.transform(
            commands, lambda x: F.concat(x["process"]["comm"], F.lit("<"), F.coalesce(parent(x), F.lit("")))
        )
    )
    calls = F.array_compact(
        F.transform(
            e,
            lambda x: F.when(x["process"].isNotNull(), F.lit("execve"))
            .when(x["file"].isNotNull(), x["file"]["syscall"])
            .when(x["connect"].isNotNull(), F.lit("connect")),
        )
    )
    ends = F.array_compact(
        F.transform(
            e,
            lambda x: F.coalesce(
                F.concat(x["connect"]["ip"], F.lit(":"), x["connect"]["port"].cast("string")),
                F.concat(x["connects_to"]["ip"], F.lit(":"), x["connects_to"]["port"].cast("string")),
            ),
        )
    )
    statements = F.transform(e, lambda x: F.coalesce(x["sql"], F.lit("")))
    return sessions.withColumns(
        {
            "process_tree_shape": F.array_join(shape, " "),
            "syscall_sequence": F.array_join(calls, " "),
            "timing_pattern": F.col("tempo"),
            "sql_content": F.array_join(statements, "\n"),
            "connects_to_destination": F.array_join(ends, " "),
            "_masked": F.array_join(F.transform(statements, mask_literals), "\n"),
        }
    )


def pair_checks(specs: DataFrame) -> DataFrame:
    """Per session of a matched pair: one sibling of each class, and what its dimensions ask for.

    A fixed dimension must agree and a varied one differ; statements that differ in literals
    only do not count as different.
    """
    s = with_dimensions(spec_sessions(specs)).where(F.col("matched_pair_id").isNotNull())
    side = F.struct("scenario_id", *DIMENSIONS, "gaps", "_masked")
    keys = ["run_id", "matched_pair_id", "session_no"]
    per = s.groupBy(*keys).agg(
        F.count_if(F.col("class") == "benign").alias("benign"),
        F.count_if(F.col("class") == "malicious").alias("malicious"),
        F.min(F.when(F.col("class") == "benign", side)).alias("b"),
        F.min(F.when(F.col("class") == "malicious", side)).alias("m"),
        *[
            F.max(F.coalesce(F.array_contains(f"matched_dimensions.{kind}", dim), F.lit(False))).alias(f"{kind}_{dim}")
            for kind in ("fixed", "varied")
            for dim in DIMENSIONS
        ],
    )
    near = F.forall(
        F.arrays_zip(F.col("b.gaps").alias("x"), F.col("m.gaps").alias("y")),
        lambda g: F.abs(g["x"] - g["y"]) <= 0.2 * F.greatest(g["x"], g["y"]),
    )
    one_each = (F.col("benign") == 1) & (F.col("malicious") == 1)
    same = {dim: F.col(f"b.{dim}") == F.col(f"m.{dim}") for dim in DIMENSIONS}
    same["timing_pattern"] = same["timing_pattern"] & near
    differs = {dim: ~c for dim, c in same.items()} | {"sql_content": F.col("b._masked") != F.col("m._masked")}
    valid = one_each
    for dim in DIMENSIONS:
        valid = valid & (~F.col(f"fixed_{dim}") | same[dim]) & (~F.col(f"varied_{dim}") | differs[dim])
    return per.select(
        *keys,
        one_each.alias("one_of_each"),
        *[F.when(one_each, c).alias(f"same_{dim}") for dim, c in same.items()],
        F.coalesce(valid, F.lit(False)).alias("valid"),
    )


def dimension_tables(sessions: DataFrame) -> DataFrame:
    """Dimension × value × class over all dimensions; a value of one class only predicts the class."""
    shown = F.array(*[F.struct(F.lit(x).alias("dimension"), F.col(x).alias("value")) for x in DIMENSIONS])
    long = sessions.select("class", F.inline(shown))
    return (
        long.groupBy("dimension", "value")
        .agg(
            F.count_if(F.col("class") == "benign").alias("benign"),
            F.count_if(F.col("class") == "malicious").alias("malicious"),
        )
        .withColumn("predicts", (F.col("benign") == 0) | (F.col("malicious") == 0))
    )


def os_activity(sessions: DataFrame) -> DataFrame:
    """Per scenario: whether some session has activity of the operating system."""
    program = F.coalesce(
        F.exists(
            "events",
            lambda e: e["process"].isNotNull()
            | e["file"].isNotNull()
            | e["connect"].isNotNull()
            | F.coalesce(e["sql"].rlike(r"(?i)\bPROGRAM\s+'"), F.lit(False)),
        ),
        F.lit(False),
    )
    return sessions.groupBy("run_id", "scenario_id").agg(
        F.bool_or(program).alias("has_os_activity"), F.count(F.lit(1)).alias("sessions")
    )


def relationship_coverage(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("rule_engine_relationship", "class").agg(
        F.countDistinct("run_id", "scenario_id").alias("scenarios")
    )


def _let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of a value that is computed once, not at each use."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def _session_places(sessions: Column, day_s: Column) -> Column:
    """`start_s` and `error` of all sessions of one spec, in listed order (`session_starts`)."""

    def plan(x: Column, i: Column, labels: Column) -> Column:
        gaps = x["timing"]["step_gaps_seconds"]
        m, steps = F.size(gaps), F.greatest(F.size(x["events"]) - 1, F.lit(0))
        cycle = F.aggregate(gaps, F.lit(0.0), lambda a, g: a + g)
        part = F.aggregate(F.slice(gaps, F.lit(1), steps % m), F.lit(0.0), lambda a, g: a + g)
        length = F.when(m > 0, F.floor(steps / m) * cycle + part).otherwise(F.lit(0.0))
        delay = F.when(i == 0, F.lit(0.0)).otherwise(F.coalesce(x["delay_after_previous_seconds"], F.lit(0.0)))
        at = F.nullif(F.array_position(labels, x["concurrent_with"]), F.lit(0).cast("long")) - 1
        return F.struct(
            x["concurrent_with"].isNull().alias("serial"), delay.alias("delay"), length.alias("length"),
            at.cast("int").alias("host"),
        )

    def listed(plans: Column) -> Column:
        """Starts of sessions one after another."""

        def add(acc: Column, x: Column) -> Column:
            delays = acc["delays"] + F.when(x["serial"], x["delay"]).otherwise(F.lit(0.0))
            lengths = acc["lengths"] + F.when(x["serial"], F.coalesce(x["length"], F.lit(0.0))).otherwise(F.lit(0.0))
            starts = F.concat(acc["starts"], F.array(acc["day"] + delays + acc["lengths"]))
            return F.struct(
                acc["day"].alias("day"), delays.alias("delays"), lengths.alias("lengths"), starts.alias("starts")
            )

        none = F.array().cast("array<double>")
        zero = F.struct(
            day_s.cast("double").alias("day"), F.lit(0.0).alias("delays"), F.lit(0.0).alias("lengths"), none.alias("starts")
        )
        return F.aggregate(plans, zero, add, lambda acc: acc["starts"])

    def chains(plans: Column) -> Column:
        """Where the chain of a session's names leads; how far it looks doubles each time."""

        def look(far: Column, _: Column) -> Column:
            return F.transform(
                far,
                lambda x: _let(
                    F.get(far, x["host"]),
                    lambda up: F.when(
                        x.isNotNull(),
                        F.struct(
                            F.coalesce(up["host"], x["host"]).alias("host"),
                            (x["half"] + F.coalesce(up["half"], F.lit(0.0))).alias("half"),
                        ),
                    ),
                ),
            )

        near = F.transform(
            plans,
            lambda x: F.when(
                x["host"].isNotNull(),
                F.struct(x["host"].alias("host"), (F.get(plans, x["host"])["length"] / 2).alias("half")),
            ),
        )
        named = F.size(F.filter(plans, lambda x: x["host"].isNotNull()))
        return F.aggregate(F.sequence(F.lit(1), F.length(F.bin(named))), near, look)

    def places(plans: Column, starts: Column, far: Column) -> Column:
        def place(x: Column, i: Column) -> Column:
            # what has not come to a session without a name by then goes round
            ring = F.get(plans, x["host"])["host"].isNotNull()
            start = F.coalesce(F.get(starts, x["host"]) + x["half"], F.get(starts, i))
            return F.struct(
                F.when(~ring, start).alias("start_s"),
                F.when(ring, F.lit("concurrent_with leads back to itself")).alias("error"),
            )

        return F.transform(far, place)

    labels = F.transform(sessions, lambda x: x["session_label"])
    plans = _let(labels, lambda names: F.transform(sessions, lambda x, i: plan(x, i, names)))
    return _let(
        plans, lambda p: _let(listed(p), lambda starts: _let(chains(p), lambda far: places(p, starts, far)))
    )


def session_starts(specs: DataFrame) -> DataFrame:
    """Every session with the second at which it starts (`start_s`), or why it has none (`error`).

    A session starts its delay after the previous session's last event, in listed order; one that
    names another in `concurrent_with` starts in the middle of that one, and so on along a
    chain of such names. A name that no session of the scenario has counts as none; of several with
    one name the first is meant. A ring of names has no start.

    A spec is one document with its sessions in it, so all this is computed inside its row.
    """
    day_s = minutes_of_day(F.col("time_of_day")) * 60

    def with_places(sessions: Column) -> Column:
        return F.zip_with(
            sessions,
            _session_places(sessions, day_s),
            lambda s, p: s.withField("start_s", p["start_s"]).withField("error", p["error"]),
        )

    placed = specs.withColumn("sessions", _let(F.col("sessions"), with_places))
    cycle = F.aggregate("gaps", F.lit(0.0), lambda a, g: a + g)
    return spec_sessions(placed, "start_s", "error").withColumns({"_cycle": cycle, "_m": F.size("gaps")})


def event_schedule(specs: DataFrame) -> DataFrame:
    """Second of every event from the scenario's day start; gaps repeat if they are fewer than the events need.

    Sessions in a ring of `concurrent_with` have no events here (`session_starts` names them).
    """
    placed = session_starts(specs).where("error IS NULL")
    offset = F.floor(F.col("step_no") / F.col("_m")) * F.col("_cycle") + F.aggregate(
        F.slice("gaps", F.lit(1), F.col("step_no") % F.col("_m")), F.lit(0.0), lambda a, g: a + g
    )
    return placed.select("*", F.posexplode("events").alias("step_no", "event")).select(
        "run_id",
        "scenario_id",
        "session_no",
        "step_no",
        (F.col("start_s") + F.when(F.col("_m") > 0, offset).otherwise(F.lit(0.0))).alias("at_s"),
        "event",
    )


def field_types(lines: DataFrame, column: str = "value") -> DataFrame:
    """Field × type with the number of records, over JSON lines that are no markers.

    Types are those of the records themselves, not of a declared schema.
    """
    spark = lines.sparkSession
    parsed = lines.select(F.try_parse_json(F.col(column)).alias("v"))
    fields = spark.sql(
        "SELECT e.key AS field, schema_of_variant(e.value) AS t FROM {lines}, "
        "LATERAL variant_explode(v) AS e WHERE variant_get(v, '$.marker') IS NULL",
        lines=parsed,
    )
    kind = (
        F.when(F.col("t") == "BIGINT", "int")
        .when(F.col("t").startswith("DECIMAL") | F.col("t").isin("DOUBLE", "FLOAT"), "float")
        .when(F.col("t") == "STRING", "str")
        .when(F.col("t") == "BOOLEAN", "bool")
        .when(F.col("t").startswith("ARRAY"), "list")
        .when(F.col("t").startswith("OBJECT"), "dict")
        .otherwise("null")
    )
    return fields.groupBy("field", kind.alias("type")).agg(F.count(F.lit(1)).alias("records"))


def profile_diff(live: DataFrame, reference: DataFrame, optional: Sequence[str] = ("dest_ip", "dest_port")) -> DataFrame:
    """Fields missing in the live capture, extra in it, or of a type the reference lacks."""
    def typed(df, name):
        return df.groupBy("field").agg(F.array_sort(F.collect_set("type")).alias(name))  # few types

    both = typed(live, "live").join(typed(reference, "ref"), "field", "full_outer")
    number = F.array(F.lit("int"), F.lit("float"))
    allowed = F.array_union(F.col("ref"), F.array_intersect("ref", number))
    problem = (
        F.when(F.col("live").isNull(), F.lit("missing"))
        .when(F.col("ref").isNull() & ~F.col("field").isin(*optional), F.lit("extra"))
        .when(
            F.col("ref").isNotNull() & (F.size(F.array_except("live", allowed)) > 0), F.lit("types")
        )
    )
    return both.withColumn("problem", problem).where(F.col("problem").isNotNull())


def capture_counts(kernel: DataFrame, audit: DataFrame) -> DataFrame:
    """Counts of system calls and audit event types per run."""
    k = kernel.select("run_id", F.lit("syscall").alias("part"), F.col("syscall").alias("kind"))
    a = audit.select("run_id", F.lit("event_type").alias("part"), F.col("event_type").alias("kind"))
    return k.unionByName(a).groupBy("run_id", "part", "kind").agg(F.count(F.lit(1)).alias("n"))


def subsecond_share(audit: DataFrame) -> DataFrame:
    """Audit records with a fraction of a second, per run."""
    ts = F.col("timestamp")
    return audit.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("records"), F.count_if(ts != F.floor(ts)).alias("subsecond")
    )


def log_starts(kernel: DataFrame, control: DataFrame, known: Sequence[str]) -> DataFrame:
    """Per run: whether a start mark comes before every event, and events of unknown system calls."""
    events = kernel.groupBy("run_id").agg(
        F.min("pos").alias("_first"), F.count_if(~F.col("syscall").isin(*known)).alias("unknown")
    )
    marks = control.where("marker = 'LOGGING_START'").groupBy("run_id").agg(F.min("pos").alias("_mark"))
    starts = F.coalesce(F.col("_mark") < F.col("_first"), F.lit(False))
    return events.join(marks, "run_id", "left").select("run_id", starts.alias("starts_with_marker"), "unknown")
