"""Versions of data sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dataset_version(rows: DataFrame, by: str, key: str) -> DataFrame:
    """(by, version, n): the first twelve digits of the sha1 of the sorted distinct keys, one a line.

    A hash of a sorted list needs the list in one place: keys of a group are
    streamed in order through one task (never into an array), so that memory
    stays flat; time is linear in the group.
    """
    import hashlib
    from collections.abc import Iterator

    import pyarrow as pa

    def run(k: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, n = hashlib.sha1(), 0
        for b in batches:
            for x in b.column("k").to_pylist():
                digest.update(x.encode() if n == 0 else b"\n" + x.encode())
                n += 1
        yield pa.RecordBatch.from_pydict({by: pa.array([k[0].as_py()], pa.string()), "version": pa.array([digest.hexdigest()[:12]]), "n": pa.array([n], pa.int64())})

    run.__annotations__ = {"k": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    keys = rows.where(F.col(key).isNotNull()).select(F.col(by), F.col(key).alias("k")).distinct()
    # the grouping column comes first in the exchange's sort, the key second
    return keys.repartition(by).sortWithinPartitions(by, "k").groupBy(by).applyInArrow(run, f"{by} string, version string, n long")
