"""Label files: one per run, however many tasks write."""

import os

import pytest
from pyspark.sql import functions as F

from spoorline.registry import all_queries
from spoorline.sources import logs

FOLDER = os.environ.get("SPOORLINE_TABLES", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
def test_a_run_has_one_label_file(spark, monkeypatch):
    read = []
    whole = logs.read_label_csv
    monkeypatch.setattr(logs, "read_label_csv", lambda s, path: read.append(path) or whole(s, path))
    settings = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        all_queries()["s04_label_csv"](spark, FOLDER)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    files = spark.read.text(read[0]).select(F.input_file_name().alias("f"), logs.folder_of_file().alias("run")).distinct()
    assert files.groupBy("run").count().where("count > 1").count() == 0
