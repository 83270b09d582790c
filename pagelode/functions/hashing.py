"""Stable hash used in fixture keys."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules as R

#: From here on, a batch's few longest texts are folded one by one.
FEW = 16


def fnv1a_texts(texts: pd.Series) -> pd.Series:
    """FNV-1a of a batch of texts: all are folded together, unit by unit, the longest first."""
    raw = [None if t is None else t.encode("utf-16-le", "surrogatepass") for t in texts]
    sizes = np.array([0 if r is None else len(r) // 2 for r in raw], np.int64)
    units = np.frombuffer(b"".join(r for r in raw if r is not None), "<u2").astype(np.uint32)
    order = np.argsort(-sizes, kind="stable")
    starts = (np.cumsum(sizes) - sizes)[order]
    left = sizes[order]
    folded = np.full(len(raw), R.FNV_OFFSET, np.uint32)
    # The units of place i are those of the first live[i] texts.
    longest = int(left[FEW]) if len(left) > FEW else 0
    live = np.searchsorted(-left, -np.arange(longest), "left")
    for i, n in enumerate(live.tolist()):
        folded[:n] = (folded[:n] ^ units[starts[:n] + i]) * np.uint32(R.FNV_PRIME)
    for row in range(min(FEW, len(left))):
        h = int(folded[row])
        for c in units[starts[row] + min(longest, left[row]):starts[row] + left[row]].tolist():
            h = (h ^ c) * R.FNV_PRIME & 0xFFFFFFFF
        folded[row] = h
    out = np.empty(len(raw), np.uint32)
    out[order] = folded
    return pd.Series([None if r is None else f"{h:08x}" for r, h in zip(raw, out.tolist())], dtype=object)


def fnv1a(text: Column) -> Column:
    """FNV-1a, 32 bits, over UTF-16 code units; 8 hex digits. NULL stays NULL."""
    return F.pandas_udf(fnv1a_texts, "string")(text)
