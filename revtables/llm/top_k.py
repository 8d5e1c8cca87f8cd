"""Exact top-k by integer inner product, over a bit-sliced index.

1. The components of a vector become whole numbers. A block of rows holds, for every
   component and bit, one bitmap over its rows: a slice.
2. A query's component is a sum of signed powers of two. The slices of the components that
   have the same power are added by bitmap arithmetic, three bitmaps into two, and the sums
   of the powers one place apart; that gives the slices of all rows' scores. A component
   that is taken away is added as its complement, and a constant is kept beside.
3. The rows with the highest scores are picked from the most significant slice downward:
   rows with the bit are in, if they are not too many; otherwise only they stay open. Rows
   still open after the last slice have equal scores, and the smaller ids among them are taken.

Blocks of rows meet blocks of queries, a cell a pair of blocks; of every cell only the k best
rows of each query go on. A cell holds BLOCK rows and at most MOST_QUERIES queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revtables.session import cut_lineage

#: A component x counts as floor(SCALE * x).
SCALE = 1024
#: Vectors with a component of this size or more take no part.
TOO_LARGE = float(1 << 16)
#: Rows of a block, and fewest and most queries of one.
BLOCK = 16_384
LEAST_QUERIES, MOST_QUERIES = 64, 4096
#: Cells that are aimed at if there are few rows, so that all cores have some.
CELLS = 64
#: Most partitions that cells are dealt out to.
MOST_PARTITIONS = 100_000

_INDEX = "block int, ids array<long>, low array<long>, bits int, slices binary"
_QUERIES = "queries int, query_ids array<long>, dims int, values binary"
_FOUND = "queries int, number int, query_id long, vec_id long, score long"


def whole_numbers(vector: Column) -> Column:
    """floor(SCALE * x) of every component, or null if the vector takes no part."""
    usable = F.forall(vector, lambda x: F.abs(x.cast("double")) < TOO_LARGE)  # not so for NaN
    return F.when(usable, F.transform(vector, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double"))))


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors as rows; components that shorter ones lack are 0."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lengths), int(lengths.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return out


def slices_of(matrix: np.ndarray) -> tuple[np.ndarray, int, np.ndarray]:
    """The least of each component, bits, and the bitmaps (component, bit, words) of what is above it."""
    n, dims = matrix.shape
    low = matrix.min(axis=0)
    above = np.ascontiguousarray((matrix - low).T)
    bits = max(1, int(above.max(initial=0)).bit_length())
    rows = -(-n // 64) * 64
    out = np.zeros((dims, bits, rows // 8), np.uint8)
    for i in range(bits):
        out[:, i, : -(-n // 8)] = np.packbits((above >> i & 1).astype(np.uint8), axis=1, bitorder="little")
    return low, bits, out.view(np.uint64)


def _gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """The rows of a task in tables of ``size`` rows."""
    held, n = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, size - n)
            held.append(part)
            n += part.num_rows
            batch = batch.slice(part.num_rows)
            if n == size:
                yield pa.Table.from_batches(held).combine_chunks()
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _numbered(rows: DataFrame, n: int, size: int, schema: str, made) -> tuple[DataFrame, int]:
    """``rows``, ``n`` of them, dealt out evenly: a written row for ``size`` of them, and a bound of the rows' numbers."""
    parts = max(1, -(-n // size))

    def run(batches):
        part = TaskContext.get().partitionId()
        for k, table in enumerate(_gathered(batches, size)):
            yield pa.RecordBatch.from_pylist([made(part + k * parts, table)], _arrow(schema))

    out = cut_lineage(rows.repartition(parts).mapInArrow(run, schema))
    return out, (out.agg(F.max(schema.split()[0])).first()[0] or 0) + 1


def _arrow(schema: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in schema.split(", "))])


def build_index(vectors: DataFrame, n: int, block: int = BLOCK) -> tuple[DataFrame, int]:
    """One row a block: ids in order, and the slices of ``vectors`` (id, values), ``n`` rows; and a bound of the blocks' numbers."""

    def made(number, table):
        table = table.take(pc.sort_indices(table, sort_keys=[("id", "ascending")], null_placement="at_end"))
        low, bits, slices = slices_of(_matrix(table["values"].combine_chunks()))
        return {"block": number, "ids": table["id"].to_pylist(), "low": low.tolist(), "bits": bits, "slices": slices.tobytes()}

    return _numbered(vectors, n, block, _INDEX, made)


def _query_blocks(queries: DataFrame, n: int, size: int) -> tuple[DataFrame, int]:
    def made(number, table):
        values = _matrix(table["values"].combine_chunks())
        return {"queries": number, "query_ids": table["id"].to_pylist(), "dims": values.shape[1], "values": values.tobytes()}

    return _numbered(queries, n, size, _QUERIES, made)


def signed_digits(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits of two numbers whose difference is each value, no two bits of both next to each other."""
    size = np.abs(values)
    half = size >> 1
    more = size + half
    change = half ^ more
    plus, minus = more & change, half & change
    return np.where(values < 0, minus, plus), np.where(values < 0, plus, minus)


class Adder:
    """Sums of bit-sliced numbers, held as two rows of slices whose sum is meant."""

    def __init__(self, width: int, words: int):
        self.sums, self.carries, self.either = (np.zeros((width, words), np.uint64) for _ in range(3))

    def clear(self) -> None:
        self.sums[:] = 0
        self.carries[:] = 0

    def add(self, slices: np.ndarray, shift: int = 0) -> None:
        """Three numbers into two: the bits that stand alone, and the carries one place up."""
        sums, carries, either = self.sums, self.carries, self.either
        end = shift + len(slices)
        np.bitwise_xor(sums, carries, out=either)
        np.bitwise_and(sums, carries, out=sums)  # carries of the two numbers held
        np.bitwise_or(sums[shift:end], either[shift:end] & slices, out=sums[shift:end])
        np.bitwise_xor(either[shift:end], slices, out=either[shift:end])
        carries[1:] = sums[:-1]
        carries[0] = 0
        self.sums, self.either = either, sums

    def total(self) -> np.ndarray:
        """The slices of the sum, carries passed up from slice to slice."""
        carry = np.zeros(self.sums.shape[1], np.uint64)
        out = np.empty_like(self.sums)
        for i, (a, b) in enumerate(zip(self.sums, self.carries)):
            either = a ^ b
            out[i] = either ^ carry
            carry = (a & b) | (either & carry)
        return out


def score_slices(slices: np.ndarray, low: np.ndarray, query: np.ndarray, level: Adder, whole: Adder) -> tuple[np.ndarray, int]:
    """Slices of all rows' scores, and the constant that is to be added to them."""
    dims, bits, _ = slices.shape
    query = query[:dims]
    plus, minus = signed_digits(query)
    constant = int(sum(int(q) * int(x) for q, x in zip(query, low)))
    whole.clear()
    for j in range(int(max(plus.max(initial=0), minus.max(initial=0))).bit_length()):
        added, taken = np.flatnonzero(plus >> j & 1), np.flatnonzero(minus >> j & 1)
        level.clear()
        for d in added:
            level.add(slices[d])
        for d in taken:
            level.add(~slices[d])
        constant -= len(taken) * ((1 << bits) - 1) << j
        whole.add(level.sums, j)
        whole.add(level.carries, j)
    return whole.total(), constant


def highest(total: np.ndarray, open_rows: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the k rows with the highest sums; of equal ones the first."""
    taken, n_taken = np.zeros_like(open_rows), 0
    for slice_ in total[::-1]:
        ones = open_rows & slice_
        n = int(np.bitwise_count(ones).sum())
        if n_taken + n > k:
            open_rows = ones
        else:
            taken |= ones
            n_taken += n
            open_rows = open_rows & ~slice_
            if n_taken == k:
                return _set_bits(taken)
    rest = _set_bits(open_rows)[: k - n_taken]
    return np.concatenate([_set_bits(taken), rest])


def _set_bits(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def scores_of(total: np.ndarray, rows: np.ndarray, constant: int) -> list[int]:
    bits = (total[:, rows >> 6] >> (rows & 63).astype(np.uint64)) & np.uint64(1)
    if len(total) < 63:
        return (np.left_shift(bits.astype(np.int64), np.arange(len(total))[:, None]).sum(axis=0) + constant).tolist()
    return [sum(int(b) << i for i, b in enumerate(column)) + constant for column in bits.T]


def search_block(ids: list, low: np.ndarray, bits: int, slices: np.ndarray, query_ids: list, queries: np.ndarray, k: int) -> Iterator[tuple]:
    """(number of the query, row, score) of the k best rows of one block for each query."""
    dims, words = len(low), slices.shape[2]
    level_width = bits + max(1, dims).bit_length()
    most = int(np.abs(queries).max(initial=0)).bit_length() + 1
    level, whole = Adder(level_width, words), Adder(level_width + most + 1, words)
    known = np.array([i for i in ids if i is not None], np.int64)
    every = np.zeros(words * 64, np.uint8)
    every[: len(ids)] = 1
    for number, (own, query) in enumerate(zip(query_ids, queries)):
        total, constant = score_slices(slices, low, query, level, whole)
        open_rows = every.copy()
        open_rows[np.searchsorted(known, own) : np.searchsorted(known, own, "right")] = 0
        rows = highest(total, np.packbits(open_rows, bitorder="little").view(np.uint64), k)
        yield from zip([number] * len(rows), rows.tolist(), scores_of(total, rows, constant))


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for cell in range(batch.num_rows):
            at = {name: batch.column(name)[cell] for name in batch.schema.names}
            ids, query_ids, bits, low = at["ids"].as_py(), at["query_ids"].as_py(), at["bits"].as_py(), np.array(at["low"].as_py(), np.int64)
            slices = np.frombuffer(at["slices"].as_buffer(), np.uint64).reshape(len(low), bits, -(-len(ids) // 64))
            queries = np.frombuffer(at["values"].as_buffer(), np.int64).reshape(len(query_ids), at["dims"].as_py())
            found = list(search_block(ids, low, bits, slices, query_ids, queries, k))
            numbers = [f[0] for f in found]
            columns = [[at["queries"].as_py()] * len(found), numbers, [query_ids[n] for n in numbers], [ids[f[1]] for f in found], [f[2] for f in found]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _arrow(_FOUND).types)], schema=_arrow(_FOUND))


def top_k(vectors: DataFrame, is_query: Column, k: int, vec_id: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the k rows with the highest scores for each query.

    The score is the inner product of the whole numbers of two vectors (``whole_numbers``),
    exact at any size; components that one of them lacks count as 0. Rows for which
    ``is_query`` holds are queries, against all rows with another id; a null id is no query and
    comes last among equal scores, otherwise the smaller id is first. Vectors that are null,
    that hold null, NaN or infinite components, or one of 65,536 or more, take no part; an
    empty vector has score 0 with every other. A repeated row is a row of its own: as a query
    it is answered once more, and it is no answer to its like. Columns besides the id and the
    vector are not read, whatever their names. Without queries or rows the result is empty.
    """
    chosen = F.coalesce(is_query, F.lit(False)) & F.col(f"`{vec_id}`").isNotNull()
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), whole_numbers(F.col(f"`{vector}`")).alias("values"), chosen.alias("asked"))
    rows = rows.where(F.col("values").isNotNull())
    sizes = rows.agg(F.count("*").alias("n"), F.count_if("asked").alias("q")).first()
    index, blocks = build_index(rows.select("id", "values"), sizes["n"], block)
    per_block = min(MOST_QUERIES, max(LEAST_QUERIES, -(-sizes["q"] * blocks // CELLS)))
    queries, groups = _query_blocks(rows.where("asked").select("id", "values"), sizes["q"], per_block)
    # every block of rows with every block of queries, each cell a key of its own
    cells = min(MOST_PARTITIONS, blocks * groups)
    left = index.withColumn("queries", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).repartition(cells, "block", "queries")
    right = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartition(cells, "block", "queries")
    found = left.join(right.hint("merge"), ["block", "queries"]).drop("block").mapInArrow(lambda batches: _search(batches, k), _FOUND)
    best = Window.partitionBy("queries", "number").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
