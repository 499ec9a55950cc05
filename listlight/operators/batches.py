"""Rows for Python: in Arrow batches of bounded size, and dealt out evenly before work that costs far more than reading them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20
TASK_ROWS = 2500  # rows of a task, or so, when rows are dealt out
MOST_TASKS = 10_000  # beyond it, tasks get more rows


def in_batches(df: DataFrame, run, schema: str) -> DataFrame:
    """df.mapInArrow with Arrow batches of BATCH_ROWS rows and BATCH_BYTES or so: workers and executors hold few texts at once.

    The session's settings are lowered to these; smaller ones stay.
    """
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = re.fullmatch(r"(\d+)b?", conf.get(key))
        if not now or not 0 < int(now[1]) <= most:
            conf.set(key, str(most))
    return df.mapInArrow(run, schema)


def dealt(rows: DataFrame, key: str, *, task_rows: int = TASK_ROWS) -> DataFrame:
    """rows shuffled by a column of many values into tasks of about task_rows.

    Readers cut tables by bytes, so a table of narrow rows that compress well comes in one task or two, however many cores there are. Dealt out, its rows
    use as many tasks as their number calls for. The rows are counted first; deal them while they are narrow, before pages or texts are made of them.
    """
    return rows.repartition(max(1, min(MOST_TASKS, -(-rows.count() // task_rows))), key)
