"""Aggregates per key that stay even when a few keys hold most rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.runtime import Written, shuffle_partitions
from shelfmark.tables import valid_hash

_STATE = "field_name string, key_value string, n bigint, bytes bigint, newest bigint, edge boolean"


_NONE = np.iinfo(np.int64).min


def _starts(batch: pa.RecordBatch) -> np.ndarray:
    """Where runs of equal keys start in a sorted batch."""
    new = np.ones(batch.num_rows, bool)
    if batch.num_rows > 1:
        differs = [pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False) for c in (batch.column("field_name"), batch.column("key_value"))]
        new[1:] = differs[0] | differs[1]
    return np.flatnonzero(new)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition sorted by key: one state per key. Its first and last key may go on in the next partition and are marked."""

    def batch_of(states: list[tuple], edge: list[bool]) -> pa.RecordBatch:
        field, key, n, has, total, newest = (np.concatenate(c) if isinstance(c[0], np.ndarray) else pa.concat_arrays(c) for c in zip(*states))
        columns = [field, key, pa.array(n), pa.array(total, mask=has == 0), pa.array(newest, mask=newest == _NONE), pa.array(edge)]
        return pa.RecordBatch.from_arrays(columns, ["field_name", "key_value", "n", "bytes", "newest", "edge"])

    held, first = None, True
    for batch in batches:
        if not batch.num_rows:
            continue
        at = _starts(batch)
        size, newest = batch.column("bytes"), batch.column("newest")
        has = size.is_valid().to_numpy(zero_copy_only=False).astype(np.int64)
        keys = [batch.column(k).take(pa.array(at)) for k in ("field_name", "key_value")]
        n = np.diff(np.append(at, batch.num_rows))
        has, total, newest = np.add.reduceat(has, at), np.add.reduceat(size.fill_null(0).to_numpy(), at), np.maximum.reduceat(newest.fill_null(_NONE).to_numpy(), at)
        done = None
        if held is not None:
            if all(h[0].as_py() == k[0].as_py() for h, k in zip(held, keys)):
                n[0] += held[2][0]
                has[0] += held[3][0]
                total[0] += held[4][0]
                newest[0] = max(newest[0], held[5][0])
            else:
                done = held
        state = (*keys, n, has, total, newest)
        out = [x for x in (done, tuple(c[:-1] for c in state)) if x is not None and len(x[0])]
        held = tuple(c[-1:] for c in state)
        if out:
            rows = sum(len(x[0]) for x in out)
            yield batch_of(out, [first] + [False] * (rows - 1))
            first = False
    if held is not None:
        yield batch_of([held], [True])


def aggregate_by_range(rows: DataFrame, order: list[str], partitions: int | None = None) -> DataFrame:
    """n, bytes (sum) and newest (maximum) per (field_name, key_value) of rows, whatever the keys' weights.

    rows: field_name, key_value, bytes, newest and the columns named in order, which must tell rows
    of one key apart. Rows are range partitioned by key and order, the bounds taken from sampled
    quantiles: a key with a third of all rows fills a third of the partitions and none is longer
    than others. Each partition, sorted, gives one state per key; only the keys at a partition's
    edges, two for each, are shuffled again and put together.

    Null keys make no group. Null bytes add nothing, a key with none has null. Null order columns
    are ordinary values. No rows, no result.
    """
    spark = rows.sparkSession
    n = partitions or shuffle_partitions(spark)
    rows = rows.where(F.col("field_name").isNotNull() & F.col("key_value").isNotNull())
    ordered = rows.repartitionByRange(n, "field_name", "key_value", *order).sortWithinPartitions("field_name", "key_value")
    states = Written(ordered.select("field_name", "key_value", "bytes", "newest").mapInArrow(_runs, _STATE), "range-states").df
    stitched = states.where("edge").groupBy("field_name", "key_value").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.max("newest").alias("newest"))
    return states.where("not edge").drop("edge").unionByName(stitched)


def file_values(files: DataFrame) -> DataFrame:
    """Every row of files as delivered, once by its size and once by its valid content hash."""
    fields = F.array(
        F.struct(F.lit("size").alias("field_name"), F.col("size").cast("string").alias("key_value")),
        F.struct(F.lit("content_hash").alias("field_name"), valid_hash(F.col("content_hash")).alias("key_value")),
    )
    return files.select(F.col("size").alias("bytes"), F.col("mtime").alias("newest"), "id", F.explode(fields).alias("k")).select("k.field_name", "k.key_value", "bytes", "newest", "id")


def heavy_values(files: DataFrame, share: float = 0.01) -> DataFrame:
    """The values of size and content_hash that hold at least that share of all rows, with their aggregates."""
    total = files.count()
    return aggregate_by_range(file_values(files), ["id"]).where(F.col("n") >= F.lit(share) * F.lit(total))
