"""Arrow columns in small parts, so that what Python holds does not grow with a batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts of a part have so many bytes, and those of its last row.
PART_BYTES = 1 << 20


def parts(texts: pa.Array, *others: pa.Array) -> Iterator[tuple[list, ...]]:
    """``texts`` and ``others`` as Python lists, part by part: a new one begins where ``PART_BYTES`` of texts are full or 1,000 rows."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.maximum.accumulate((np.cumsum(size) - size) // PART_BYTES) * (len(size) + 1) + np.arange(len(size)) // 1000
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(size)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield tuple(c.slice(a, b - a).to_pylist() for c in (texts, *others))
