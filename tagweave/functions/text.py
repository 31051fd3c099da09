"""Token id lists of a fixed length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pad_tokens(ids, maxlen: int, side: str = "end") -> Column:
    """First `maxlen` ids, filled with 0 at the end or the front."""
    ids = F.col(ids) if isinstance(ids, str) else ids
    kept = F.slice(ids, 1, maxlen)
    fill = F.array_repeat(F.lit(0).cast("int"), F.greatest(F.lit(maxlen) - F.size(kept), F.lit(0)).cast("int"))
    if side == "end":
        return F.concat(kept, fill)
    if side == "front":
        return F.concat(fill, kept)
    raise ValueError(f"side must be 'end' or 'front', not {side!r}")
