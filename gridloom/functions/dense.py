"""Between the rows of one field and an array."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


#: Nodes of a field that one task may hold; what is larger has to be cut into tiles or routed on edges.
MOST_NODES = 1 << 24


def dense(pdf: pd.DataFrame, value: str = "z", most: int = MOST_NODES) -> np.ndarray:
    """The field of one group as an array; nodes that are not there are NaN. Larger fields are refused."""
    if (int(pdf["row"].max()) + 1) * (int(pdf["col"].max()) + 1) > most:
        raise ValueError(f"a field of more than {most} nodes is too large for one task")
    out = np.full((int(pdf["row"].max()) + 1, int(pdf["col"].max()) + 1), np.nan)
    out[pdf["row"].to_numpy(), pdf["col"].to_numpy()] = pdf[value].to_numpy()
    return out


def long(region: int, **fields: np.ndarray) -> pd.DataFrame:
    """A row for each node, with the arrays' values."""
    r, c = np.indices(next(iter(fields.values())).shape)
    return pd.DataFrame({"region": region, "row": r.ravel().astype(np.int32), "col": c.ravel().astype(np.int32)} | {k: v.ravel() for k, v in fields.items()})


def per_field(cells: DataFrame, f, schema: str) -> DataFrame:
    """f(region, array) for each field of cells (region, row, col, z)."""
    return cells.groupBy("region").applyInPandas(lambda pdf: f(int(pdf["region"].iloc[0]), dense(pdf)), schema)
