"""Near duplicates by an inverted index over MinHash coordinates.

1. A text becomes the set of its distinct word shingles; texts with equal sets are one
   node from here on, so thousands of exact copies cost one row.
2. Each set has a signature of ``COORDINATES`` minima. Sets of the wanted similarity agree
   in ``agreeing(similarity)`` coordinates at least (four standard deviations below the
   mean; at the threshold itself about one pair in ten thousand is missed, above it fewer).
3. A set is posted under the coordinate-value pairs that its prefix keeps: two sets that
   agree in t of k coordinates share s of the first k - t + s under one common order.
   Frequent pairs come last in that order, so lists of boilerplate are skipped, and a set
   with fewer than s shared lists is out.
4. Within a list all are paired with its most central set only, and confirmed on the full
   sets. What that leaves in different components meets block by block, so no list is
   gathered and none is paired within itself when one link path already connects it.
5. Components over the confirmed links.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revtables.llm.components import components
from revtables.llm.texts import NOT_SPACE, mix, runs, slices, utf8, window_hashes, word_hashes
from revtables.session import cut_lineage

COORDINATES = 64
#: A pair of coordinate and value counts as frequent from this share of all postings on, so
#: that there are at most as many frequent pairs as its inverse says, whatever the input.
FREQUENT_SHARE = 1 / 50_000
#: Prefixes are so long that sets that agree enough share this many lists at least.
SHARED = 8
#: Sets of a list that meet in one task at a time.
BLOCK = 500
#: Of those, longer signatures of four bits a coordinate are compared, a short part first.
LONG, QUICK = 512, 128
#: Values of a coordinate there; different minima have the same one with a probability of one in so many.
VALUES = 16
_BITS = np.arange(0, 8, 4, dtype=np.uint8)

_random = np.random.default_rng(20)
_FACTORS = _random.integers(0, 1 << 32, COORDINATES, dtype=np.uint32) | np.uint32(1)
_SHIFTS = _random.integers(0, 1 << 32, COORDINATES, dtype=np.uint32)
_LONG_FACTORS = _random.integers(0, 1 << 32, LONG, dtype=np.uint32) | np.uint32(1)
_LONG_SHIFTS = _random.integers(0, 1 << 32, LONG, dtype=np.uint32)


def agreeing(similarity: float, coordinates: int = COORDINATES) -> int:
    """Coordinates in which sets of this similarity agree at least, four deviations down."""
    deviation = math.sqrt(coordinates * similarity * (1 - similarity))
    return max(1, math.floor(coordinates * similarity - 4 * deviation))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a shorter text is one shingle."""
    words, _, _, first = word_hashes(data, offsets, NOT_SPACE)
    windows = window_hashes(words, size)
    sets = []
    for a, z in zip(first[:-1].tolist(), first[1:].tolist()):
        if z - a >= size:
            sets.append(np.unique(windows[a : z - size + 1]))
        elif z > a:
            short = np.uint64(z - a)
            for h in words[a:z]:
                short = mix(np.array([short ^ h]))[0]
            sets.append(np.array([short], np.uint64))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def signature(shingles: np.ndarray) -> np.ndarray:
    best = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    high = (shingles >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(high), 4096):
        best = np.minimum(best, (high[i : i + 4096, None] * _FACTORS + _SHIFTS).min(axis=0))
    return best


def long_signature(shingles: np.ndarray) -> np.ndarray:
    """Four bits of each of ``LONG`` other minima, two minima a byte."""
    best = np.full(LONG, 0xFFFFFFFF, np.uint32)
    low = shingles.astype(np.uint32)
    for i in range(0, len(low), 2048):
        best = np.minimum(best, (low[i : i + 2048, None] * _LONG_FACTORS + _LONG_SHIFTS).min(axis=0))
    values = (best >> np.uint32(4)).astype(np.uint8) % VALUES
    return np.bitwise_or.reduce(values.reshape(-1, len(_BITS)) << _BITS, axis=1)


def long_values(signatures: list[bytes]) -> np.ndarray:
    """The values of the coordinates, a row for each long signature."""
    packed = np.frombuffer(b"".join(signatures), np.uint8).reshape(len(signatures), LONG // len(_BITS), 1)
    return (packed >> _BITS & np.uint8(VALUES - 1)).reshape(len(signatures), LONG)


def alike(similarity: float) -> float:
    """The share of equal values to expect in long signatures of sets of this similarity."""
    return similarity + (1 - similarity) / VALUES


def _sets_of(text: pa.Array, size: int) -> Iterator[np.ndarray]:
    data, offsets = utf8(text)
    for a, z in slices(offsets):
        yield from shingle_sets(data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a], size)


def _set_id(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, set_id (of equal sets) and both signatures of each (doc_id, text)."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_shingles long, set_id binary, signature binary, long binary"

    def run(batches):
        for batch in batches:
            sizes, ids, signs, long = [], [], [], []
            for shingles in _sets_of(batch.column("text"), size):
                sizes.append(len(shingles))
                ids.append(_set_id(shingles) if len(shingles) else None)
                signs.append(signature(shingles).tobytes() if len(shingles) else None)
                long.append(long_signature(shingles).tobytes() if len(shingles) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), *(pa.array(x, pa.binary()) for x in (ids, signs, long))],
                ["doc_id", "n_shingles", "set_id", "signature", "long"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def full_sets(docs: DataFrame, size: int) -> DataFrame:
    """set_id and the hashes of the whole set of each (doc_id, text)."""

    def run(batches):
        for batch in batches:
            for shingles in _sets_of(batch.column("text"), size):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_set_id(shingles)], pa.binary()), pa.array([shingles.tobytes()], pa.binary())],
                    ["set_id", "shingles"],
                )

    return docs.select("text").mapInArrow(run, "set_id binary, shingles binary")


def _keys(signatures: pa.Array) -> np.ndarray:
    """Coordinate-value pairs as one number each, a row for each signature."""
    values = np.frombuffer(b"".join(signatures.to_pylist()), np.uint32).reshape(-1, COORDINATES)
    return values.astype(np.int64) | (np.arange(COORDINATES, dtype=np.int64) << 32)


def _key_rows(sets: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_keys(batch.column("signature")).ravel())], ["key"])

    return sets.select("signature").mapInArrow(run, "key long")


def _postings(sets: DataFrame, frequent: dict[int, int], prefix: int) -> DataFrame:
    """The prefix of each set: its rarest pairs, by (times seen if frequent, pair)."""
    known = np.array(sorted(frequent), np.int64)
    times = np.array([frequent[k] for k in known.tolist()], np.int64)

    def run(batches):
        for batch in batches:
            keys = _keys(batch.column("signature"))
            seen = np.zeros(keys.shape, np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                seen = np.where(known[at] == keys, times[at], 0)
            order = np.lexsort((keys, seen), axis=1)[:, :prefix]
            ids = batch.column("set_id").take(pa.array(np.repeat(np.arange(len(keys)), prefix)))
            rank = pa.array(np.tile(np.arange(prefix, dtype=np.int8), len(keys)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.take_along_axis(keys, order, 1).ravel()), ids, rank], ["key", "set_id", "rank"]
            )

    return sets.select("set_id", "signature").mapInArrow(run, "key long, set_id binary, rank byte")


def _meet_in_blocks(rows: DataFrame, similarity: float) -> DataFrame:
    """Pairs of different components in one list whose long signatures agree enough.

    ``rows``: key, n (length of the list), keys (all lists of the set), set_id, component,
    n_shingles, long. A list longer than ``BLOCK`` is dealt out in blocks, and every two of
    its blocks meet in a task of their own; a pair comes out in the first list it shares.
    """
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK)).cast("int")
    own = F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int")
    dealt = (
        rows.withColumn("blocks", blocks)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("low", F.least("own", "other"))
        .withColumn("high", F.greatest("own", "other"))
        .drop("blocks", "n", "rank", "other")
    )
    quick, least = agreeing(alike(similarity), QUICK), agreeing(alike(similarity), LONG)

    def pairs(ids, own, part, sizes, lists, long, key, low, high):
        left, right = np.flatnonzero(own == low), np.flatnonzero(own == high)
        a, b = long[left], long[right]
        for i, row in enumerate(left.tolist()):
            s = sizes[right]
            fit = (part[right] != part[row]) & (np.minimum(sizes[row], s) >= similarity * np.maximum(sizes[row], s) - 1e-9)
            at = np.flatnonzero(fit)
            at = at[np.count_nonzero(b[at, :QUICK] == a[i, :QUICK], axis=1) >= quick]
            at = at[np.count_nonzero(b[at] == a[i], axis=1) >= least]
            for j in right[at].tolist():
                if (low < high or ids[row] < ids[j]) and min(lists[row] & lists[j]) == key:
                    yield min(ids[row], ids[j]), max(ids[row], ids[j])

    def run(batches):
        for rows in runs(batches, ["key", "low", "high"]):
            long = long_values(rows["long"].to_pylist())
            parts = rows["component"].to_pylist()
            number = {x: i for i, x in enumerate(set(parts))}
            found = list(
                pairs(
                    rows["set_id"].to_pylist(), rows["own"].to_numpy(), np.array([number[x] for x in parts]),
                    rows["n_shingles"].to_numpy(), [set(x) for x in rows["keys"].to_pylist()], long,
                    *(rows[c][0].as_py() for c in ("key", "low", "high")),
                )
            )
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[i] for x in found], pa.binary()) for i in (0, 1)], ["a", "b"]
            )

    by_task = dealt.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    return by_task.mapInArrow(run, "a binary, b binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= percent * union."""
    a = sets.select(F.col("set_id").alias("a"), F.col("shingles").alias("of_a"))
    b = sets.select(F.col("set_id").alias("b"), F.col("shingles").alias("of_b"))

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("of_a"), batch.column("of_b")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(b, "b").join(a, "a").select("a", "b", "of_a", "of_b").mapInArrow(run, "a binary, b binary")


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of ``docs`` (doc_id, text).

    Words are what white space parts, A-Z lower-cased; texts are linked when 100 times the
    shingles they share are ``percent`` times all their shingles or more. ``component_id`` is
    the smallest doc_id that links reach, ``kept`` marks the row it names. A null, empty or
    blank text has no shingle and no link. Rows with the same doc_id are each judged by
    their own text. A null doc_id is never the smallest unless its whole component has
    none; such rows are kept, as nothing tells them apart. Other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    least = agreeing(percent / 100)
    prefix = COORDINATES - least + SHARED
    rows = cut_lineage(sketches(docs, shingle_words))
    sets = cut_lineage(
        rows.where("set_id IS NOT NULL")
        .groupBy("set_id")
        .agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"), F.first("long").alias("long"))
    )

    times = cut_lineage(_key_rows(sets).groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    many = max(2, math.ceil(FREQUENT_SHARE * COORDINATES * sets.count()))
    frequent = {r["key"]: r["n"] for r in times.where(F.col("n") >= many).collect()}

    lists = _postings(sets, frequent, prefix).join(times.select("key"), "key", "left_semi")
    for _ in range(2):
        shared = lists.groupBy("set_id").agg(F.count("*").alias("of_set")).where(F.col("of_set") >= SHARED)
        lists = lists.join(shared.select("set_id"), "set_id", "left_semi")
        lengths = lists.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        lists = cut_lineage(lists.join(lengths, "key").select("key", "set_id", "rank", "n"))
        lists, long_lists = lists.drop("n"), lists
    lists = long_lists
    central = lists.groupBy("set_id").agg(F.sum("n").alias("weight"))
    leader = (
        lists.join(central, "set_id").groupBy("key").agg(F.max(F.struct("weight", "set_id")).alias("top"))
        .select("key", F.col("top.set_id").alias("leader"))
    )
    stars = cut_lineage(
        lists.join(leader, "key").where("leader <> set_id")
        .select(F.least("leader", "set_id").alias("a"), F.greatest("leader", "set_id").alias("b")).distinct()
    )
    signs = sets.select("set_id", "signature", "n_shingles")
    stars = cut_lineage(_agreeing_pairs(stars, signs, least, percent / 100))

    links = cut_lineage(_confirmed(stars, _read_sets(stars, sets, docs, shingle_words), percent))
    found = components(links)
    member = F.coalesce(F.col("component"), F.col("set_id"))
    in_parts = lists.join(found.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("component", member)
    split = (
        in_parts.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
        .where("low <> high").select("key")
    )
    # sets that share SHARED lists of the whole prefix share one without the last lists of each
    open_lists = cut_lineage(in_parts.where(F.col("rank") <= prefix - SHARED).join(split, "key", "left_semi"))
    keys = open_lists.groupBy("set_id").agg(F.collect_list("key").alias("keys"))
    rows_of = open_lists.join(sets.select("set_id", "long", "n_shingles").join(keys, "set_id"), "set_id")
    rest = cut_lineage(_meet_in_blocks(rows_of, percent / 100).join(stars, ["a", "b"], "left_anti"))
    if not rest.isEmpty():
        links = cut_lineage(links.unionByName(_confirmed(rest, _read_sets(rest, sets, docs, shingle_words), percent)))
        found = components(links)

    named = sets.join(found.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("component", member)
    smallest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_set = named.join(smallest, "component").select("set_id", "component_id")
    out = rows.select("doc_id", "n_shingles", "set_id").join(of_set, "set_id", "left")
    component_id = F.coalesce("component_id", "doc_id")
    return out.select(
        "doc_id", "n_shingles", component_id.alias("component_id"), component_id.eqNullSafe(F.col("doc_id")).alias("kept")
    )


def _agreeing_pairs(pairs: DataFrame, signs: DataFrame, least: int, similarity: float) -> DataFrame:
    a = signs.select(F.col("set_id").alias("a"), F.col("signature").alias("of_a"), F.col("n_shingles").alias("n_a"))
    b = signs.select(F.col("set_id").alias("b"), F.col("signature").alias("of_b"), F.col("n_shingles").alias("n_b"))

    def run(batches):
        for batch in batches:
            x, y = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, COORDINATES) for c in ("of_a", "of_b")
            )
            yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= least))

    close = F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b") - 1e-9
    both = pairs.join(b, "b").join(a, "a").where(close).select("a", "b", "of_a", "of_b")
    return both.mapInArrow(run, "a binary, b binary")


def _read_sets(pairs: DataFrame, sets: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """set_id and full set of what ``pairs`` names, from whole texts read again for those only."""
    ids = pairs.select(F.col("a").alias("set_id")).union(pairs.select("b")).distinct()
    wanted = cut_lineage(sets.join(ids, "set_id").select("set_id", F.col("doc_id").alias("wanted")))
    names = wanted.select("wanted").distinct()
    texts = docs.join(names, F.col("doc_id").eqNullSafe(F.col("wanted")), "left_semi")
    full = full_sets(texts, size).join(wanted.select("set_id"), "set_id", "left_semi")
    return cut_lineage(full.dropDuplicates(["set_id"]))
