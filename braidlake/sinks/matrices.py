"""Matrices to files of arrays, or to tables.

Files of arrays are single files put together by the driver, so sparse ones are as large as its memory allows, and full ones are
checked before. Tables are written by the executors and have no such bound.
"""

from __future__ import annotations

from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame

from braidlake.operators.matrix import check_dense, compressed
from braidlake.schema import DTYPES

_NUMPY = {"bool": np.bool_, "int8": np.int8, "int32": np.int32, "float32": np.float32, "float64": np.float64}
SUFFIXES = (".npz", ".npy", ".csv")


def dtype_of(coo: DataFrame) -> str:
    kind = dict(coo.dtypes)["value"]
    return next(name for name, t in DTYPES.items() if t == kind)


def _arrays(coo: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = coo.select("row", "col", "value").toArrow()
    return tuple(rows.column(c).to_numpy() for c in ("row", "col", "value"))  # type: ignore[return-value]


def sparse_arrays(coo: DataFrame, n: int, fmt: str = "csr") -> dict[str, np.ndarray]:
    """Arrays of the form csr, csc, coo or dok under their usual names."""
    kind = fmt.lower()
    if kind not in ("csr", "csc", "coo", "dok"):
        raise ValueError(f"unknown matrix format: {fmt}")
    row, col, value = _arrays(coo)
    out = {"format": np.array(kind.encode()), "shape": np.array([n, n]), "data": value}
    if kind in ("coo", "dok"):
        return out | {"row": row, "col": col}
    major, minor = (row, col) if kind == "csr" else (col, row)
    order = np.lexsort((minor, major))
    return out | {"data": value[order], "indices": minor[order], "indptr": np.searchsorted(major[order], np.arange(n + 1))}


def dense(coo: DataFrame, n: int) -> np.ndarray:
    row, col, value = _arrays(coo)
    out = np.zeros((n, n), dtype=_NUMPY[dtype_of(coo)])
    if out.dtype == bool:
        out[row, col] = value
    else:
        np.add.at(out, (row, col), value)
    return out


def save_array(array: np.ndarray, path: str | Path) -> None:
    """A full matrix as .npy, .npz or .csv (six significant digits)."""
    suffix = Path(path).suffix
    if suffix == ".npy":
        np.save(path, array)
    elif suffix == ".npz":
        np.savez_compressed(path, array=array)
    elif suffix == ".csv":
        np.savetxt(path, array, delimiter=",", fmt="%.6g")
    else:
        raise ValueError(f"unknown matrix file type: {suffix}")


def save_matrix(coo: DataFrame, n: int, path: str | Path, fmt: str = "csr", max_dense_gb: float = 5.0) -> None:
    """The matrix in the file type of `path`: sparse arrays (.npz) or full (.npy, .csv). MemoryError if it would be too large."""
    suffix = Path(path).suffix
    if suffix not in SUFFIXES:
        raise ValueError(f"unknown matrix file type: {suffix}")
    if suffix == ".npz":
        np.savez_compressed(path, **sparse_arrays(coo, n, fmt))
        return
    check_dense(n, 0, dtype_of(coo), max_dense_gb)
    save_array(dense(coo, n), path)


def save_matrix_tables(coo: DataFrame, n: int, folder: str, by: str = "row") -> None:
    """Tables `entries` (pos, k, index, value) and `indptr` (k, start) of the CSR form, or of CSC with by="col", written by the executors, whatever the size."""
    indptr, entries = compressed(coo, n, by)
    entries.write.mode("overwrite").parquet(f"{folder}/entries")
    indptr.write.mode("overwrite").parquet(f"{folder}/indptr")


def save_names(names: list[str], path: str | Path) -> None:
    """`number TAB name` lines."""
    with open(path, "w") as f:
        f.writelines(f"{i}\t{name}\n" for i, name in enumerate(names))


def save_node_map(index: DataFrame, path: str | Path) -> None:
    """`idx TAB node` lines in the order of idx."""
    with open(path, "w") as f:
        for row in index.orderBy("idx").select("idx", "node").toLocalIterator(prefetchPartitions=True):
            f.write(f"{row[0]}\t{row[1]}\n")

