"""Arrays of tasks added up, by slices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Numbers that are added up at a time.
SLICE = 1 << 16
SUMS = "group int, slice int, data binary"


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of slices; a task holds one of each that it meets."""
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for group, number, data in zip(*(batch.column(c).to_pylist() for c in ("group", "slice", "data"))):
            values = np.frombuffer(data)
            sums[group, number] = sums[group, number] + values if (group, number) in sums else values
    for (group, number), values in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([number], pa.int32()), pa.array([values.tobytes()])], names=["group", "slice", "data"])
