"""Rows that carry packed arrays: one row per sending slice and partition instead of one per item."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import kernels as K


def schema(fields: dict[str, str]) -> str:
    return ", ".join(["part int", *(f"{name} binary" for name in fields)])


def deal(part: np.ndarray, parts: int, fields: dict[str, str], values: dict[str, np.ndarray], more: dict[str, tuple] | None = None) -> pd.DataFrame:
    """values (arrays alike in length) by part; more: fields dealt evenly, whatever their part."""
    order = np.argsort(part, kind="stable")
    cut = np.searchsorted(part[order], np.arange(parts + 1))
    out = {name: (values[name][order].astype(fields[name]), cut) for name in values}
    for name, value in (more or {}).items():
        out[name] = (value.astype(fields[name]), np.arange(parts + 1) * len(value) // parts)
    full = [p for p in range(parts) if any(c[p] < c[p + 1] for _, c in out.values())]
    return pd.DataFrame({"part": np.array(full, np.int32)} | {
        name: [out[name][0][out[name][1][p]:out[name][1][p + 1]].tobytes() if name in out else b"" for p in full] for name in fields})


def gather(batches, fields: dict[str, str]) -> dict[str, np.ndarray]:
    """All arrays that reached this partition."""
    rows = [pdf for pdf in batches]
    out = {name: np.frombuffer(b"".join(x for pdf in rows for x in pdf.pop(name)), kind) for name, kind in fields.items()}
    K.release()
    return out


def by_part(rows: DataFrame, parts: int) -> DataFrame:
    """Rows to the partition that ``part`` names, each to one of its own."""
    return rows.repartitionById(parts, "part")
