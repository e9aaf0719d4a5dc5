"""Readers of run folders: logs, labels, manifests, graphs, specs, reports; and their sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spoorline import schemas
from spoorline.plans.live import binary_label, split_label
from spoorline.sources.tables import Capture

KERNEL_FILE = "kernel_events.json"
AUDIT_FILE = "postgres_events.json"
SYNC_FILE = "time_sync.json"


def folder_of_file() -> Column:
    """Name of the folder a row's file lies in, without a "name=" in front: the run."""
    return F.regexp_extract(F.col("_metadata.file_path"), r"([^/=]+)/[^/]+$", 1)


def file_position() -> Column:
    """Order of the rows of a run: by file name, then block, then row of the block."""
    return F.struct(
        F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def _lines(spark: SparkSession, path, schema: T.StructType) -> DataFrame:
    """Rows of JSON lines; their run is the one they name (`write_capture`), else their folder."""
    named = T.StructType([*schema.fields, T.StructField("run", T.StringType())])
    return (
        spark.read.schema(named)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .json(path)
        .select("*", F.coalesce("run", folder_of_file()).alias("run_id"), file_position().alias("pos"))
        .drop("run")
    )


def read_kernel_log(spark: SparkSession, path) -> DataFrame:
    """All rows of kernel logs, control rows and malformed lines included."""
    return _lines(spark, path, schemas.KERNEL_RAW)


def read_audit_log(spark: SparkSession, path) -> DataFrame:
    return _lines(spark, path, schemas.AUDIT_RAW)


def kernel_events(raw: DataFrame) -> DataFrame:
    """Event rows only; their time is integer nanoseconds."""
    return raw.where(F.col("marker").isNull() & F.col("_corrupt_record").isNull()).select(
        "run_id", "pos", F.col("timestamp").cast("long").alias("timestamp"), *schemas.KERNEL_FIELDS
    )


def audit_events(raw: DataFrame) -> DataFrame:
    return raw.where(F.col("marker").isNull() & F.col("_corrupt_record").isNull()).select(
        "run_id", "pos", "timestamp", *schemas.AUDIT_FIELDS
    )


def control_rows(raw: DataFrame) -> DataFrame:
    """Marker rows; their time is epoch seconds."""
    cols = ["run_id", "pos", "marker", F.col("timestamp").cast("double").alias("timestamp")]
    cols += [c for c in ("backend_pid", "attack") if c in raw.columns]
    return raw.where(F.col("marker").isNotNull()).select(*cols)


def malformed_lines(raw: DataFrame) -> DataFrame:
    return raw.where(F.col("_corrupt_record").isNotNull()).select("run_id", "_corrupt_record")


def read_time_sync(spark: SparkSession, path) -> DataFrame:
    schema = "server_boot_unix_time double"
    read = spark.read.schema(schema).option("multiLine", True).json(path)
    return read.select(folder_of_file().alias("run_id"), "server_boot_unix_time")


def read_capture(spark: SparkSession, root: str) -> Capture:
    """All runs under ``root`` (root/<run>/…)."""
    kernel = read_kernel_log(spark, f"{root}/*/{KERNEL_FILE}")
    audit = read_audit_log(spark, f"{root}/*/{AUDIT_FILE}")
    return Capture(
        kernel_events(kernel),
        audit_events(audit),
        control_rows(kernel),
        read_time_sync(spark, f"{root}/*/{SYNC_FILE}"),
    )


#: Columns of a label file that are read.
LABEL_COLUMNS = 32


def read_label_csv(spark: SparkSession, path) -> DataFrame:
    """Label files, each with a header of its own order; rows without a session id are dropped.

    A leading BOM is ignored. A column that a file lacks is null in its rows.
    """
    names = [f"_c{i}" for i in range(LABEL_COLUMNS)]
    raw = spark.read.schema(", ".join(f"{n} string" for n in names)).csv(path)
    raw = raw.select(F.array(*names).alias("_cells"), F.col("_metadata.file_path").alias("_file"), folder_of_file().alias("run_id"))
    trimmed = F.transform("_cells", lambda c: F.trim(F.regexp_replace(c, "^\uFEFF", "")))
    is_header = F.coalesce(F.array_contains(trimmed, "session_id"), F.lit(False))
    headers = raw.where(is_header).groupBy("_file").agg(F.first(trimmed).alias("_header"))
    columns = headers.select(F.explode("_header").alias("name")).where("name <> ''").distinct().collect()
    rows = raw.where(~is_header).join(headers, "_file")
    named = [F.get("_cells", F.array_position("_header", r.name) - 1).alias(r.name) for r in sorted(columns)]
    return clean_labels(rows.select("run_id", *named))


def clean_labels(rows: DataFrame) -> DataFrame:
    sid = F.trim(F.col("session_id").cast("string"))
    return (
        rows.withColumn("session_id", F.nullif(sid, F.lit("")).cast("long"))
        .where(F.col("session_id").isNotNull())
        .withColumns({"label": F.trim("label"), "y": binary_label(F.col("label"))})
    )


def read_label_lines(spark: SparkSession, path) -> DataFrame:
    """Label lines "Class:key" with class, key and 0/1."""
    raw = spark.read.schema(schemas.LABEL_LINE).json(path)
    return label_lines(raw.select("*", folder_of_file().alias("run_id")))


def label_lines(rows: DataFrame) -> DataFrame:
    cls, key = split_label(F.col("label"))
    return rows.withColumns({"class": cls, "key": key, "y": binary_label(cls)})


def read_manifests(spark: SparkSession, path) -> DataFrame:
    raw = spark.read.schema(schemas.MANIFEST).option("multiLine", True).json(path)
    return manifest_sessions(raw.select("scenarios", folder_of_file().alias("run_id")))


def manifest_sessions(manifests: DataFrame) -> DataFrame:
    """One row per planned session: scenario, family, template and backend pid."""
    return (
        manifests.select("run_id", F.explode("scenarios").alias("scenario_id", "_s"))
        .select(
            "run_id",
            "scenario_id",
            F.col("_s.family_id").alias("family"),
            F.explode("_s.sessions").alias("session_name", "_p"),
        )
        .select(
            "run_id",
            "scenario_id",
            "family",
            F.regexp_replace("scenario_id", r"_\d+$", "").alias("template"),
            "session_name",
            F.col("_p.backend_pid").alias("backend_pid"),
        )
    )


def manifest_problems(sessions: DataFrame) -> DataFrame:
    """Missing families, missing pids, and pids that are given two families."""
    gaps = F.when(F.coalesce("family", F.lit("")) == "", F.lit("missing family")).when(
        F.col("backend_pid").isNull(), F.lit("missing pid")
    )
    missing = sessions.select("run_id", "backend_pid", gaps.alias("problem")).where(
        F.col("problem").isNotNull()
    )
    conflicts = (
        sessions.where(F.col("backend_pid").isNotNull())
        .groupBy("run_id", "backend_pid")
        .agg(F.countDistinct("family").alias("_n"))
        .where("_n > 1")
        .select("run_id", "backend_pid", F.lit("conflicting family").alias("problem"))
    )
    return missing.unionByName(conflicts)


def read_live_manifest(spark: SparkSession, path) -> DataFrame:
    return spark.read.schema(schemas.LIVE_MANIFEST).json(path)


def read_scores(spark: SparkSession, path) -> DataFrame:
    return spark.read.schema(schemas.SCORE).json(path).select("*", file_position().alias("pos"))


def read_reports(spark: SparkSession, path) -> DataFrame:
    """Fold reports named <fold>_s<seed>.report.json, flattened to one row each."""
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)_s(\d+)\.report\.json$", 1)
    seed = F.regexp_extract(F.col("_metadata.file_path"), r"_s(\d+)\.report\.json$", 1)
    raw = spark.read.schema(schemas.REPORT).option("multiLine", True).json(path)
    return raw.select(
        name.alias("fold"),
        seed.cast("int").alias("seed"),
        "theta",
        "test_templates",
        "val_templates",
        "unseen.*",
        F.col("unseen_gat_only.roc_auc").alias("model_roc_auc"),
        F.col("seen_test.f1").alias("seen_test_f1"),
    )


def read_graphml(spark: SparkSession, path) -> DataFrame:
    """One row per graph file: `file`, and nodes and edges with attribute maps."""
    raw = (
        spark.read.format("xml")
        .option("rowTag", "graphml")
        .option("useLegacyXMLParser", True)  # documents may follow each other in one file
        .schema(schemas.GRAPHML)
        .load(path)
    )
    return graphml_rows(
        raw.select("*", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1).alias("file"))
    )


def graphml_rows(raw: DataFrame) -> DataFrame:
    names = F.map_from_entries(
        F.transform("key", lambda k: F.struct(k["_id"], k["_attr.name"]))
    )

    def attributes(item):
        return F.map_from_entries(
            F.transform(
                F.coalesce(item["data"], F.array()),
                lambda d: F.struct(F.element_at(F.col("_names"), d["_key"]), d["_VALUE"]),
            )
        )

    return raw.withColumn("_names", names).select(
        "file",
        F.transform(
            "graph.node", lambda n: F.struct(n["_id"].alias("id"), attributes(n).alias("attrs"))
        ).alias("nodes"),
        F.transform(
            F.coalesce("graph.edge", F.array()),
            lambda e: F.struct(
                e["_source"].alias("src"), e["_target"].alias("dst"), attributes(e).alias("attrs")
            ),
        ).alias("edges"),
    )


def graphml_nodes(graphs: DataFrame) -> DataFrame:
    return graphs.select("file", F.explode("nodes").alias("n")).select("file", "n.*")


def graphml_edges(graphs: DataFrame) -> DataFrame:
    return graphs.select("file", F.explode("edges").alias("e")).select("file", "e.*")


def read_specs(spark: SparkSession, path) -> DataFrame:
    texts = spark.read.option("wholetext", True).text(path)
    return parse_specs(
        texts.select(
            F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+/[^/]+$", 1).alias("run_id"),
            F.col("value").alias("text"),
        )
    )


def parse_specs(texts: DataFrame) -> DataFrame:
    """Scenario specs (run_id, text) as typed rows; `error` is set if a text is no valid spec."""
    def parse(batches):
        import json
        import re

        import pandas as pd
        import yaml

        base = getattr(yaml, "CSafeLoader", yaml.SafeLoader)

        class Loader(base):
            """Leaves 02:30 a text instead of a base-60 number."""

        numbers = "tag:yaml.org,2002:int", "tag:yaml.org,2002:float"
        Loader.yaml_implicit_resolvers = {
            first: [(tag, rx) for tag, rx in known if tag not in numbers]
            for first, known in base.yaml_implicit_resolvers.items()
        }
        Loader.add_implicit_resolver(
            numbers[0], re.compile(r"^[-+]?(?:0|[1-9][0-9_]*)$"), list("-+0123456789")
        )
        Loader.add_implicit_resolver(
            numbers[1],
            re.compile(r"^[-+]?(?:[0-9][0-9_]*)?\.[0-9_]*(?:[eE][-+]?[0-9]+)?$"),
            list("-+0123456789."),
        )

        def one(text):
            try:
                data = yaml.load(text, Loader=Loader)  # a SafeLoader
                return json.dumps(data, default=str), None
            except yaml.YAMLError as exc:
                return None, str(exc).splitlines()[0]

        for pdf in batches:
            pairs = [one(t) for t in pdf["text"]]
            yield pd.DataFrame(
                {
                    "run_id": pdf["run_id"],
                    "_json": [p[0] for p in pairs],
                    "error": [p[1] for p in pairs],
                }
            )

    parsed = texts.select("run_id", "text").mapInPandas(
        parse, "run_id string, _json string, error string"
    )
    return _typed_specs(parsed)


def json_specs(texts: DataFrame) -> DataFrame:
    """Specs (run_id, text) in JSON as typed rows; no Python runs."""
    none = F.lit(None).cast("string")
    return _typed_specs(texts.select("run_id", F.col("text").alias("_json"), none.alias("error")))


def _typed_specs(parsed: DataFrame) -> DataFrame:
    # as rows of a generator: fields of one plain column would parse their text again, each for itself
    spec = F.inline(F.array(F.from_json("_json", schemas.SPEC)))
    typed = parsed.select("run_id", F.col("error").alias("_error"), spec)
    no_spec = F.when(F.col("scenario_id").isNull(), F.lit("no scenario_id"))
    return typed.withColumn("error", F.coalesce("_error", no_spec)).drop("_error")


def write_tables(tables: dict[str, DataFrame], root: str, mode: str = "overwrite") -> None:
    """Tables clustered by run in files of many runs; big runs are spread over several tasks and files."""
    for name, df in tables.items():
        clustered = df.hint("rebalance", "run_id").sortWithinPartitions("run_id")
        clustered.write.mode(mode).parquet(f"{root}/{name}")


def append_manifest(manifest: DataFrame, root: str) -> None:
    manifest.write.mode("append").json(f"{root}/manifest")


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def write_label_csv(labels: DataFrame, path: str) -> None:
    """Session labels as session_id,label."""
    labels.select("session_id", "label").write.mode("overwrite").option("header", True).csv(path)


def write_capture(cap: Capture, root: str) -> None:
    """A capture as JSON lines that name their run, in order and in files of many runs.

    Files follow the number of rows, not that of runs: opening one costs as much as hundreds of lines.
    """
    kernel = cap.kernel.withColumn("timestamp", F.col("timestamp").cast("string"))
    control = cap.control.withColumn("timestamp", F.col("timestamp").cast("string"))
    rows = {
        "kernel": control.unionByName(kernel, allowMissingColumns=True),
        "audit": cap.audit,
        "sync": cap.time_sync,
    }
    for name, df in rows.items():
        order = [c for c in ("run_id", "pos") if c in df.columns]
        (
            df.repartitionByRange(*order)
            .sortWithinPartitions(*order)
            .withColumnRenamed("run_id", "run")
            .drop("pos")
            .write.json(f"{root}/{name}")
        )
