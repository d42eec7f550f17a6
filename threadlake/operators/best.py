"""The k best of each query, kept by every task for a block of queries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


class Best:
    """The k least (value to `places`, item) of each of n queries, of all that was added; `bound` is each query's k-th value so far."""

    def __init__(self, n: int, k: int, places: int, bound: np.ndarray | None = None):
        self.n, self.k, self.places, self.held, self.rows = n, k, places, 0, []
        self.bound = np.full(n, np.inf) if bound is None else bound.copy()

    def add(self, query: np.ndarray, item: np.ndarray, value: np.ndarray) -> None:
        self.rows.append((query.astype(np.int32), item, value))
        self.held += len(query)
        if self.held > max(2 * self.n * self.k, 1 << 18):
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.rows:
            return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0)
        query, item, value = (np.concatenate(c) for c in zip(*self.rows, strict=True))
        self.rows = []
        order = np.lexsort((item, np.round(value, self.places), query))
        query = query[order]
        at = np.arange(len(query)) - np.searchsorted(query, query)
        last, kept = order[at == self.k - 1], order[at < self.k]
        self.bound[query[at == self.k - 1]] = np.round(value[last], self.places)
        self.rows, self.held = [(query[at < self.k], item[kept], value[kept])], len(kept)
        return self.rows[0]


def answers(best: Best, ids: pa.Array, value: str) -> pa.RecordBatch:
    query, item, x = best.settle()
    return pa.RecordBatch.from_arrays([ids.take(pa.array(query)), pa.array(item, pa.int64()), pa.array(x, pa.float64())], names=["query_id", "item", value])
