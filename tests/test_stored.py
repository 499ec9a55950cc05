"""Intermediate tables: where they lie, and that they go."""

import os
import subprocess
import sys
import textwrap

from listlight.operators import regions, stored


def folder(spark) -> str:
    return stored.shared_dir(spark).removeprefix("file://")


def left(spark) -> list[str]:
    at = folder(spark)
    return [f for f in os.listdir(at) if f.startswith("listlight-")] if os.path.isdir(at) else []


def test_written_tables_go_by_drop_and_by_close(spark):
    stored.close(spark)
    before = set(left(spark))
    one, two = stored.written(spark.range(5), "one"), stored.written(spark.range(7), "two")
    assert len(set(left(spark)) - before) == 2 and one.count() == 5
    stored.drop(one)
    assert len(set(left(spark)) - before) == 1 and two.count() == 7
    stored.drop(two.where("id > 2"))  # found by its files
    assert set(left(spark)) == before
    stored.drop(one)  # gone already
    stored.written(spark.range(3), "three")
    stored.close(spark)
    assert set(left(spark)) == before


def test_failed_writes_leave_nothing(spark):
    from pyspark.sql import functions as F

    stored.close(spark)
    before = set(left(spark))
    try:
        stored.written(spark.range(5).select(F.raise_error(F.lit("stop")).alias("x")), "bad")
        raise AssertionError("no error")
    except Exception as e:
        assert "stop" in str(e)
    assert set(left(spark)) == before


def test_rounds_of_a_deep_closure_leave_one_table(spark):
    stored.close(spark)
    before = set(left(spark))
    chain = spark.range(40).selectExpr("id", "nullif(id - 1, -1) as parent_id")
    assert regions.closure(chain).count() == 40 * 41 // 2
    assert len(set(left(spark)) - before) == 1  # the pairs
    stored.close(spark)
    assert set(left(spark)) == before


def test_sessions_without_a_shared_folder(tmp_path):
    """spark.checkpoint.dir unset, two sessions one after the other, and a Python that just ends: nothing stays behind."""
    (tmp_path / "conf").mkdir()
    (tmp_path / "tmp").mkdir()
    code = textwrap.dedent("""
        import os, tempfile
        from pyspark.sql import SparkSession
        from listlight.operators import regions, stored

        def session():
            return SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()

        tree = lambda spark: spark.range(30).selectExpr("id", "nullif(id - 1, -1) as parent_id")
        spark = session()
        assert spark.conf.get("spark.checkpoint.dir", None) is None
        assert regions.closure(tree(spark)).count() == 465
        first = stored.shared_dir(spark)
        assert os.listdir(first)
        spark.stop()
        spark = session()
        assert regions.closure(tree(spark)).count() == 465
        assert stored.shared_dir(spark) != first and not os.path.exists(first)
        stored.written(spark.range(3), "left")
        spark.stop()
    """)
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path / "conf"), "TMPDIR": str(tmp_path / "tmp"), "PYTHONPATH": os.pathsep.join(sys.path)}
    done = subprocess.run([sys.executable, "-c", code], env=env, cwd=os.getcwd(), capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
    assert not [f for f in os.listdir(tmp_path / "tmp") if f.startswith("listlight-")]
