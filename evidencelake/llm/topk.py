"""Exact top-k search by inner product over a bit-sliced index.

Each component x becomes floor(1024 x). A block of vectors is held as bit slices: one bitmap for each bit of each
attribute, over the rows. A query's scores are sums of slices by bitmap adders (three bitmaps in, sum and carry out);
the top rows are then selected from the most significant slice downward, and rows that tie at the boundary are
resolved exactly, by smaller vec_id.

Vectors that are null or hold a null or non-finite component take no part, nor do rows without a vec_id. Rows that
share a vec_id all take part, each as a candidate of the others too, and as a query with a result of its own. Vectors of other lengths count as padded with zeros; an empty one scores
0. With fewer than k candidates a query gets them all; without queries there is no row. Extra columns are not read.
Scores outside 64 bits are held at its limits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidencelake.llm.common import cut, map_rows

#: Rows of a block of the index, queries that travel together, and components up to which slices are used.
BLOCK, QUERIES, SLICED = 16_384, 1_024, 1 << 24
_LIMIT = (1 << 63) - 1


def quantise(vector: list[float]) -> np.ndarray:
    return np.floor(1024.0 * np.asarray(vector, np.float64))


def usable(column: str):
    x = F.col(column)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return x.isNotNull() & ~F.coalesce(bad, F.lit(False))


class Slices:
    """The bit slices of a block: ``planes[sign, attribute, bit]`` are bitmaps over its rows, ``sign`` 1 the complement."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, matrix: np.ndarray):
        self.ids, self.rows, self.matrix = ids, rows, matrix
        n, d = matrix.shape
        self.low = matrix.min(axis=0) if n else np.zeros(d, np.int64)
        shifted = (matrix - self.low).T.astype(np.uint64)
        self.bits = max(1, int(shifted.max(initial=0)).bit_length())
        self.words = -(-n // 64)
        self.valid = self._bitmap(np.ones((1, n), bool))[0]
        planes = np.stack([self._bitmap((shifted >> np.uint64(b)) & np.uint64(1) == 1) for b in range(self.bits)], axis=1)
        self.planes = np.stack([planes, ~planes])

    def _bitmap(self, rows: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(rows), self.words * 64), bool)
        wide[:, : rows.shape[1]] = rows
        return np.packbits(wide, axis=1, bitorder="little").view("<u8")

    def sums(self, query: np.ndarray) -> list[np.ndarray]:
        """Slices of the sum over attributes of |q| times the shifted value, or its complement where q is below 0."""
        size = np.abs(query).astype(np.int64)
        negative = (query < 0).astype(np.int64)
        q_bits = max(1, int(size.max(initial=0)).bit_length())
        chosen = [np.flatnonzero((size >> b) & 1) for b in range(q_bits)]
        columns: dict[int, list[np.ndarray]] = {}
        out, w = [], 0
        while w < q_bits + self.bits or w in columns:
            parts = columns.pop(w, [])
            for j in range(max(0, w - q_bits + 1), min(self.bits, w + 1)):
                d = chosen[w - j]
                if len(d):
                    parts.append(self.planes[negative[d], d, j])
            stack = np.concatenate(parts) if parts else np.zeros((0, self.words), "<u8")
            while len(stack) > 1:
                t = len(stack) // 3
                if t:
                    a, b, c, rest = stack[:t], stack[t : 2 * t], stack[2 * t : 3 * t], stack[3 * t :]
                    x = a ^ b
                    carry, stack = (a & b) | (x & c), np.concatenate((x ^ c, rest))
                else:
                    carry, stack = stack[:1] & stack[1:], stack[:1] ^ stack[1:]
                columns.setdefault(w + 1, []).append(carry)
            out.append(stack[0] if len(stack) else np.zeros(self.words, "<u8"))
            w += 1
        return out

    def top(self, query: np.ndarray, own: int, k: int) -> Iterator[tuple[int, int]]:
        """(vec_id, score) of the k best rows but the query's ``own``."""
        tied = self.valid.copy()
        for at in np.flatnonzero(self.rows == own).tolist():
            tied[at >> 6] &= ~np.uint64(1 << (at & 63))
        inside = np.zeros_like(tied)
        found = 0
        for plane in reversed(self.sums(query)):
            more = tied & plane
            n = int(np.bitwise_count(more).sum())
            if found + n > k:
                tied = more
            else:
                inside, found = inside | more, found + n
                tied = tied & ~plane
                if found == k:
                    break
        rows = lambda bitmap: np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))
        chosen = np.concatenate((rows(inside), rows(tied)[: k - found]))
        yield from zip(self.ids[chosen].tolist(), (self.matrix[chosen] @ query).tolist(), strict=True)


def exact_top(ids: np.ndarray, rows: np.ndarray, matrix: np.ndarray, query: np.ndarray, own: int, k: int) -> Iterator[tuple[int, int]]:
    """The same over integers of any size, for the rare blocks with components too large for slices."""
    wide = [int(x) for x in query]
    hold = lambda s: max(-_LIMIT - 1, min(_LIMIT, s))
    scores = [(-hold(sum(int(a) * b for a, b in zip(row, wide, strict=True))), i) for row, i, own_row in zip(matrix, ids.tolist(), rows.tolist(), strict=True) if own_row != own]
    for score, i in sorted(scores)[:k]:
        yield i, -score


def blocks(vectors: DataFrame, rows: int, dims: int) -> DataFrame:
    """(ids, rows, matrix): packed blocks of one task's vectors, in order of vec_id; no shuffle."""

    def pack(source: Iterator[dict]) -> Iterator[tuple]:
        held: list[tuple[int, int, np.ndarray]] = []

        def flush() -> tuple:
            held.sort(key=lambda x: x[:2])
            matrix = np.zeros((len(held), dims))
            for row, (_, _, v) in zip(matrix, held, strict=True):
                row[: len(v)] = v
            ids, numbers = (np.array([x[c] for x in held], "<i8").tobytes() for c in (0, 1))
            return (ids, numbers, matrix.astype("<f8").tobytes() if np.abs(matrix).max(initial=0) >= SLICED else matrix.astype("<i4").tobytes())

        for r in source:
            held.append((r["vec_id"], r["row"], quantise(r["embedding"])))
            if len(held) >= rows:
                yield flush()
                held = []
        if held:
            yield flush()

    return map_rows(vectors, "ids binary, rows binary, matrix binary", pack, out_rows=1)


def unpack(ids: bytes, rows: bytes, matrix: bytes, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    own = np.frombuffer(ids, "<i8")
    wide = bool(len(own)) and dims and len(matrix) == len(own) * dims * 8
    return own, np.frombuffer(rows, "<i8"), np.frombuffer(matrix, "<f8" if wide else "<i4").reshape(len(own), dims)


def top_k(embeddings: DataFrame, is_query, k: int = 10, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) for every vector of which ``is_query`` (a condition) holds, against all others.

    The stated queries, a hundredth of the rows, meet all rows in blocks: every block of the index gets every block of
    queries once, by a join on a slot number. Vectors are never copied, queries once for each slot.
    """
    own = cut(embeddings.where(F.col("vec_id").isNotNull() & usable("embedding")).select("vec_id", "embedding", F.monotonically_increasing_id().alias("row")))
    dims = own.agg(F.max(F.size("embedding"))).first()[0] or 0
    index = cut(blocks(own, block, dims)).withColumn("block", F.xxhash64("rows"))
    slots = max(1, min(index.count(), 4096))
    asked = blocks(own.where(is_query), QUERIES, dims).select(F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows"), F.col("matrix").alias("q_matrix"), F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))
    pairs = index.withColumn("slot", F.pmod("block", F.lit(slots)).cast("int")).join(asked.hint("shuffle_hash"), "slot").select("block", "ids", "rows", "matrix", "q_ids", "q_rows", "q_matrix")

    def search(source: Iterator[dict]) -> Iterator[tuple]:
        last, slices, ids, rows, matrix = None, None, None, None, None
        for r in source:
            if r["block"] != last:
                last = r["block"]
                ids, rows, matrix = unpack(r["ids"], r["rows"], r["matrix"], dims)
                slices = Slices(ids, rows, matrix.astype(np.int64)) if matrix.dtype == np.dtype("<i4") and dims else None
            q_ids, q_rows, queries = unpack(r["q_ids"], r["q_rows"], r["q_matrix"], dims)
            for own_id, own_row, query in zip(q_ids.tolist(), q_rows.tolist(), queries, strict=True):
                small = slices is not None and query.dtype == np.dtype("<i4")
                found = slices.top(query.astype(np.int64), own_row, k) if small else exact_top(ids, rows, matrix, query, own_row, k)
                for vec_id, score in found:
                    yield (own_id, own_row, vec_id, score)

    best = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")
    return map_rows(pairs, "query_id long, query_row long, vec_id long, score long", search).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
