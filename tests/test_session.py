"""Scratch folders of the registered queries."""

import os

from conftest import SF_DIR

import __spark_entry__ as registry
from tidelog.session import shared_dir


def test_repeated_calls_leave_no_growing_folders(spark):
    folder = f"{shared_dir(spark)}/tidelog"
    seen = []
    for _ in range(2):
        for name in ("rollup_rebuild", "retention_expire_stored", "stored_batch_status"):
            registry.queries()[name](spark, SF_DIR).count()
        seen.append(sorted(os.listdir(folder)))
    assert seen[0] == seen[1]


def test_unused_checkpoints_are_removed(spark):
    assert spark.sparkContext.getConf().get("spark.cleaner.referenceTracking.cleanCheckpoints") == "true"
