"""Tokenizers as plugs for Arrow batches, and counts that need no ids."""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions.text import words
from gristmill.plans.shipping import ship


class Tokenizer(Protocol):
    vocab_size: int

    def encode(self, text: str) -> list[int]: ...

    def decode(self, ids: list[int]) -> str: ...


class ByteTokenizer:
    """One id for each byte of UTF-8."""

    vocab_size = 256

    def encode(self, text: str) -> list[int]:
        return list(text.encode())

    def decode(self, ids: list[int]) -> str:
        return bytes(ids).decode("utf-8", "replace")


class CodePointTokenizer:
    """One id for each code point."""

    vocab_size = 0x110000

    def encode(self, text: str) -> list[int]:
        return list(map(ord, text))

    def decode(self, ids: list[int]) -> str:
        return "".join(map(chr, ids))


#: Rows of an Arrow batch that goes to Python, and what one that comes back holds, a longer text aside: ids, or characters.
ARROW_ROWS, BACK = 1000, 1 << 20


def arrow_rows(spark: SparkSession) -> None:
    """Lower the rows of an Arrow batch: of whole texts, and of their ids, the default number takes hundreds of MB in each worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def encode(df: DataFrame, column: str, make: Callable[[], Tokenizer], name: str = "ids", eos: int | None = None) -> DataFrame:
    """df with the ids of a text column; the tokenizer is made once for each task. Empty encodings get no end id.

    One text's ids at a time are Python numbers; the others are packed, and go back before they are many.
    """
    ship(df.sparkSession)
    arrow_rows(df.sparkSession)

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokenizer = make()
        for texts in batches:
            flat, ends = array("i"), [0]
            for text in texts:
                ids = tokenizer.encode(text.as_py() or "")
                flat.extend(ids)
                if eos is not None and len(ids):
                    flat.append(eos)
                ends.append(len(flat))
                if len(flat) >= BACK:
                    yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(flat, np.int32)))
                    flat, ends = array("i"), [0]
            if len(ends) > 1:
                yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(flat, np.int32)))

    return df.withColumn(name, run(column))


def decode(df: DataFrame, column: str, make: Callable[[], Tokenizer], name: str = "text") -> DataFrame:
    ship(df.sparkSession)
    arrow_rows(df.sparkSession)

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokenizer = make()
        for rows in batches:
            texts, size = [], 0
            for row in rows:
                texts.append(tokenizer.decode(row.values.to_numpy(zero_copy_only=False).tolist()) if row.is_valid else None)
                size += len(texts[-1] or "")
                if size >= BACK:
                    yield pa.array(texts, pa.string())
                    texts, size = [], 0
            if texts:
                yield pa.array(texts, pa.string())

    return df.withColumn(name, run(column))


def end_id(special: dict[str, int]) -> int:
    """The id that ends a document, by the names it goes under."""
    for name in ("eos_token", "eot_token"):
        if special.get(name) is not None:
            return special[name]
    raise ValueError("the tokenizer names no end id")


def verify(tokenizer: Tokenizer, vocab_size: int, special: dict[str, int] | None = None) -> None:
    """Refuses a tokenizer of another size, or with a special id outside of it."""
    if tokenizer.vocab_size != vocab_size:
        raise ValueError(f"the vocabulary has {tokenizer.vocab_size} ids, {vocab_size} were asked for")
    wrong = [k for k, v in (special or {}).items() if not 0 <= v < vocab_size]
    if wrong:
        raise ValueError(f"special ids outside of the vocabulary: {', '.join(wrong)}")


def word_count(text: Column | str) -> Column:
    """How many runs of non-space characters there are."""
    return F.size(words(text)).cast("long")


def byte_ids(text: Column | str) -> Column:
    """The bytes of a text as ids, inside the JVM."""
    hexes = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit("(..)"), F.lit(1))
    return F.transform(hexes, lambda h: F.conv(h, 16, 10).cast("int"))


def dtype_for_vocab(size: Column) -> Column:
    """uint16 up to 65,535 ids, else uint32."""
    return F.when(size <= 65535, "uint16").otherwise("uint32")


def corpus_count(df: DataFrame, group: str, n: Column) -> DataFrame:
    """(group, samples, tokens)."""
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("samples"), F.sum(n).cast("long").alias("tokens"))
