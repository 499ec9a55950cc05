"""Configuration as small dimensions: JSON from an environment variable or a file, and folders of prompt texts."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def load(name: str, *, environment: dict[str, str] | None = None, default: str | None = None) -> dict:
    """The JSON object in the environment variable `name`, else in the file that it or `default` names; {} if neither is there.

    What is no JSON object is an error that says where it stood.
    """
    value = (os.environ if environment is None else environment).get(name) or default
    if not value:
        return {}
    text = value if value.lstrip().startswith("{") else Path(value).read_text(encoding="utf-8") if Path(value).is_file() else "{}"
    try:
        found = json.loads(text)
    except json.JSONDecodeError as e:
        raise ValueError(f"{name} holds no JSON: {e}") from e
    if not isinstance(found, dict):
        raise ValueError(f"{name} holds no JSON object")
    return found


def prompts(folder: str) -> dict[str, str]:
    """The texts of a folder by file name without suffix, stripped, in the order of the names."""
    return {p.stem: p.read_text(encoding="utf-8").strip() for p in sorted(Path(folder).glob("*.txt"))}


def dimension(spark: SparkSession, entries: list[dict], schema: str) -> DataFrame:
    """Entries of a configuration as a table; fields that an entry lacks are null, others are left out."""
    names = spark.createDataFrame([], schema).columns
    return spark.createDataFrame([tuple(e.get(n) for n in names) for e in entries], schema)
