"""Deterministic sampling by hashes of content."""

from __future__ import annotations

import hashlib
import json
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = 18446744073709551616.0  # 2^64


def sha1_bucket(text: Column, salt: str) -> Column:
    """The first 64 bits of sha1(salt + text) as a share of 2^64; inside the JVM."""
    head = F.substring(F.sha1(F.concat(F.lit(salt), text).cast("binary")), 1, 16)
    return F.conv(head, 16, 10).cast("decimal(20,0)").cast("double") / F.lit(SPAN)


def is_validation(text: Column, ratio: float, salt: str) -> Column:
    return sha1_bucket(text, salt) < F.lit(float(ratio))


def validation_ratio(train_tokens: int, validation_tokens: int, configured: float | None = None) -> float:
    ratio = float(configured) if configured is not None else validation_tokens / max(1, train_tokens + validation_tokens)
    if not 0 < ratio < 1:
        raise ValueError("the validation ratio must lie between 0 and 1")
    return ratio


def plain(value: Any) -> Any:
    """A cell as JSON would hold it."""
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    if hasattr(value, "asDict"):
        return plain(value.asDict())
    if hasattr(value, "tolist"):
        return plain(value.tolist())
    return [plain(v) for v in value] if isinstance(value, (list, tuple)) else value


def sample_key(row: dict[str, Any]) -> str:
    """What identifies a sample: its messages as JSON, else question, answer and text, else the whole row as JSON."""
    if "messages" in row:
        return json.dumps(plain(row["messages"]), sort_keys=True)
    given = [str(row[k]) for k in ("question", "answer", "text") if row.get(k) is not None]
    return "\n".join(given) if given else json.dumps(plain(row), sort_keys=True)


def key_bucket(key: str, salt: str) -> float:
    return int.from_bytes(hashlib.blake2b(f"{salt}\n{key}".encode(), digest_size=8).digest(), "big") / SPAN


def sample_bucket(columns: list[str], salt: str) -> Column:
    """The share of 2^64 that blake2b gives a sample; neither Spark nor DuckDB has it, so it runs on Arrow batches."""

    @F.pandas_udf("double")
    def bucket(rows: pd.DataFrame) -> pd.Series:
        return pd.Series([key_bucket(sample_key(r), salt) for r in rows.to_dict("records")], dtype="float64")

    return bucket(F.struct(*columns))


def in_range(columns: list[str], start: float, end: float, key: str) -> Column:
    """Whether a sample falls into a source's share of its range key; all of it needs no hash."""
    if not 0 <= start < end <= 1:
        raise ValueError("a range must satisfy 0 <= start < end <= 1")
    if start <= 0 and end >= 1:
        return F.lit(True)
    bucket = sample_bucket(columns, f"source-range:{key}")
    return (bucket >= start) & (bucket < end)


def in_partition(columns: list[str], partition: str, ratio: float) -> Column:
    """Whether a sample belongs to train or validation."""
    if ratio <= 0 or ratio >= 1:
        return F.lit((partition == "train") == (ratio <= 0))
    held = sample_bucket(columns, "validation") < ratio
    return held if partition == "validation" else ~held
