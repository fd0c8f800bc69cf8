"""Metric logs, manifests and output folders."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.sources.tokenbin import opened


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """(row, …) of a JSON-lines log: blank lines are skipped, a broken one is an error, row counts the lines kept from 1.

    A log is one file of one run; its lines are numbered by their places over ranges, not in one task.
    """
    from gristmill.plans.offsets import numbered

    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("_at"), "value").where(F.trim("value") != "")
    objects = lines.where(F.substring(F.ltrim("value"), 1, 1) == "{")
    fields = spark.read.option("mode", "FAILFAST").option("pathGlobFilter", "*").json(path).schema
    parsed = objects.select("_at", F.from_json("value", fields, {"mode": "FAILFAST"}).alias("r"))
    return numbered(parsed, "_at").select((F.col("seq") + 1).alias("row"), "r.*")


def append_rows(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def validation_rows(log: DataFrame) -> DataFrame:
    return log.where(F.col("validation_loss").isNotNull()) if "validation_loss" in log.columns else log.limit(0)


def throughput_rows(log: DataFrame) -> DataFrame:
    have = {"tokens_per_second", "step"} <= set(log.columns)
    return log.where(F.col("tokens_per_second").isNotNull() & F.col("step").isNotNull()) if have else log.limit(0)


def last_row(log: DataFrame, step: str = "step") -> DataFrame:
    return log.orderBy(F.col(step).desc()).limit(1)


def read_manifest(path: str | Path) -> dict[str, Any]:
    """{} for a manifest that isn't there or is broken."""
    try:
        fs, place = opened(str(path))
        with fs.open_input_stream(place) as f:
            return json.loads(f.read())
    except (OSError, ValueError):
        return {}


def write_manifest(path: str | Path, body: dict[str, Any]) -> None:
    fs, place = opened(str(path))
    fs.create_dir(place.rpartition("/")[0] or ".", recursive=True)
    with fs.open_output_stream(f"{place}.new") as f:
        f.write((json.dumps(body, indent=2, ensure_ascii=True) + "\n").encode())
    fs.move(f"{place}.new", place)


def reusable(manifest: dict[str, Any], expected: dict[str, Any]) -> bool:
    """Whether what a manifest tells of was made in the same way."""
    return bool(manifest) and all(manifest.get(k) == v for k, v in expected.items())


def token_state(manifest: dict[str, Any], expected: dict[str, Any], train: int, validation: int) -> str:
    """complete, resumable or rebuild: whether a token run's outputs may be used, carried on, or must be made anew."""
    if not reusable(manifest, expected):
        return "rebuild"
    have = (int(manifest.get("train_tokens", 0)), int(manifest.get("validation_tokens", 0)))
    if have[0] >= train and have[1] >= validation:
        return "complete"
    return "resumable" if any(have) else "rebuild"


def checkpoint_choice(found: list[str], explicit: str | None = None, resume: str | None = None) -> str | None:
    """The checkpoint to load: as asked, as configured, the latest, the final one."""
    steps = sorted(f for f in found if f.rpartition("/")[2].startswith("step_"))
    final = [f for f in found if f.rpartition("/")[2].startswith("final")]
    return explicit or resume or next((f for f in found if f.rpartition("/")[2].startswith("latest")), None) or (steps[-1] if steps else None) or (final[0] if final else None)
