"""Vector columns for the search operators: which rows take part, list columns as matrices, and dealing a query side with
a corpus in groups of bounded size."""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: components of corpus vectors that a task holds at a time (64 numbers: 65,536 vectors, 32 MB), and queries beside them
GROUP_VALUES = 1 << 22
GROUP_QUERIES = 2048


def usable(vec: Column) -> Column:
    """Neither null nor with a null or non-finite component."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(vec.isNotNull() & ~bad, F.lit(False))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column as doubles, a row each; shorter vectors are filled up with zeros."""
    offsets = column.offsets.to_numpy()
    values = column.values.slice(offsets[0], offsets[-1] - offsets[0]).to_numpy(zero_copy_only=False).astype(np.float64)
    lens = np.diff(offsets)
    if (lens == dim).all():
        return values.reshape(len(column), dim)
    out = np.zeros((len(column), dim))
    out[np.repeat(np.arange(len(lens)), lens), np.arange(len(values)) - np.repeat(offsets[:-1] - offsets[0], lens)] = values
    return out


def packed(rows: np.ndarray, dtype) -> pa.Array:
    """A matrix as a binary column."""
    data = np.ascontiguousarray(rows, dtype)
    offsets = np.arange(len(data) + 1, dtype=np.int32) * (data.shape[1] * data.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def unpacked(table: pa.Table, name: str, dtype, width: int) -> np.ndarray:
    data = b"".join(table[name].to_pylist())
    return np.frombuffer(data, dtype).reshape(table.num_rows, width)


def sample(df: DataFrame, id_col: str, vec_col: str, dim: int, rows: int) -> np.ndarray:
    """At most ``rows`` vectors and GROUP_VALUES components: those with the smallest hash of id and vector."""
    n = max(1, min(rows, GROUP_VALUES // max(dim, 1)))
    picked = df.select(vec_col).orderBy(F.xxhash64(id_col, vec_col)).limit(n).collect()
    out = np.zeros((len(picked), dim))
    for i, r in enumerate(picked):
        out[i, :len(r[0])] = r[0]
    return out


def group_plan(counts: dict[int, int], dim: int, bundle: bool) -> tuple[list[tuple[int, int, int]], int]:
    """[(cell, first group, groups)] and the number of groups: a cell with more rows than a group may hold is split;
    with ``bundle`` small cells next to each other share a group."""
    limit = max(1, GROUP_VALUES // max(dim, 1) // (8 if bundle else 1))
    out, at, room = [], 0, 0
    for cell in sorted(counts):
        n = counts[cell]
        if bundle and n <= room:
            out.append((cell, at - 1, 1))
            room -= n
        else:
            pieces = max(1, math.ceil(n / limit))
            out.append((cell, at, pieces))
            at += pieces
            room = limit - n if pieces == 1 else 0
    return out, at


def deal(corpus: DataFrame, plan: list[tuple[int, int, int]], id_col: str, query_groups: int) -> DataFrame:
    """The corpus with its group ``cg`` (rows of a cell are spread by a hash of their id) for every group of queries ``qg``."""
    cells = corpus.sparkSession.createDataFrame(plan or [(0, 0, 1)], "cell int, first int, pieces int")  # a row per cell: bounded by the index
    placed = corpus.join(F.broadcast(cells), "cell").withColumn("cg", (F.col("first") + F.pmod(F.xxhash64(id_col), F.col("pieces"))).cast("int"))
    return placed.drop("first", "pieces").withColumn("qg", F.explode(F.sequence(F.lit(0), F.lit(query_groups - 1))))


def query_groups(n: int) -> int:
    return max(1, math.ceil(n / GROUP_QUERIES))


def query_group(id_col: str, groups: int) -> Column:
    return F.pmod(F.xxhash64(id_col), F.lit(groups)).cast("int")
