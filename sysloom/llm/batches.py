"""Cut Arrow batches into pieces of bounded size, whatever the length of their texts."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def filled(column: pa.Array) -> pa.Array:
    """Texts with null as the empty text, copied so that the first begins at byte 0.

    A cast keeps a slice's offsets as they are, and ``pc.ascii_lower`` of such an array reads past its bytes.
    """
    return pa.concat_arrays([pc.fill_null(column.cast(pa.large_string()), "")])


def pieces(column: pa.Array, limit: int) -> Iterator[tuple[int, int, pa.Array]]:
    """Row ranges ``[lo, hi)`` of at most ``limit`` text bytes each (a single longer text stands alone), with their ``filled`` texts.

    Only one range at a time is copied, so a batch of long texts does not stand twice in memory.
    """
    if not len(column):
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo, base = 0, 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield lo, hi, filled(column.slice(lo, hi - lo))
        base, lo = int(ends[hi - 1]), hi


def releasing(run: Callable) -> Callable:
    """``run`` (a function over a partition's batches), giving the memory it no longer needs back to the system when it ends.

    Spark uses a Python worker for many tasks of many stages, and what one of them has freed would else stay with it.
    """

    def inner(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return inner
