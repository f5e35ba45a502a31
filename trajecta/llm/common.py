"""Helpers shared by the operators: words, Arrow slices, stage tables, folds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajecta.session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: later steps start from a scan."""
    return cut_lineage(df, f"llm-{name}")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; NULL ids fall in fold -1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(-1))


def text_key(text: Column) -> Column:
    """A key of the text; with the doc_id it names a row (and its exact repeats)."""
    return F.coalesce(F.xxhash64(text), F.lit(0))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER))


def space_words(text: Column) -> Column:
    r"""Words ``[^\x20\x09-\x0D]+`` of a non-NULL text, as an array."""
    return F.array_remove(F.split(text, "[ \\t-\\r]+"), "")


def plain_words(text: Column) -> Column:
    r"""Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of a non-NULL lower-cased text."""
    return F.array_remove(F.split(text, "[\\x00-/:-`{-\\x7F]+"), "")


def slices(batch: pa.RecordBatch, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the ``text`` of a slice stays near ``size`` bytes.

    A single longer text is a slice of its own: texts are never cut.
    """
    lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if i > start and held + n > size:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if batch.num_rows > start:
        yield batch.slice(start)


DDL = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.float64(): "double",
       pa.bool_(): "boolean", pa.binary(): "binary", pa.list_(pa.string()): "array<string>",
       pa.list_(pa.binary()): "array<binary>", pa.list_(pa.int64()): "array<long>"}


def map_slices(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], types: dict,
               size: int = SLICE_BYTES) -> DataFrame:
    """Apply ``fn`` (slice -> columns by name) to every slice of every partition."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, size):
                out = fn(part)
                yield pa.RecordBatch.from_arrays(
                    [out[c].cast(t) if isinstance(out[c], pa.Array) else pa.array(out[c], t)
                     for c, t in types.items()], names=list(types))

    return df.mapInArrow(run, ", ".join(f"`{c}` {DDL[t]}" for c, t in types.items()))


def texts_of(batch: pa.RecordBatch) -> list[bytes]:
    """The texts as UTF-8 bytes, NULL as empty."""
    return pc.fill_null(batch.column("text").cast(pa.binary()), b"").to_pylist()
