"""Removal of long byte strings that stand more than once, by suffix arrays of shared passages.

1. Of every window of ``LENGTH`` bytes the smallest hash of ``GRAM`` bytes is its anchor;
   equal windows have equal anchors at the same place. The windows of one anchor are one
   context, a stretch of the text.
2. Anchors whose hash stands once are out, with all their windows; equal contexts are one.
3. The texts of the contexts that are left are sorted by their suffixes, the contexts of an
   anchor hash in one task: only suffixes smaller than their successors are sorted
   directly, the others are induced by scans of the buckets of first bytes. A window that
   shares ``LENGTH`` bytes with a neighbour in that order stands twice.
4. Contexts of an anchor hash that very many different contexts share are cut into pieces
   of few windows and dealt out by what all windows of the piece hold, so that one passage
   in many surroundings does not meet in one task. Windows of what is then still too large
   are counted by their digests.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revtables.llm.texts import prefix_hashes, runs, slices, stretch_hashes, utf8
from revtables.session import cut_lineage

LENGTH = 400
GRAM = 32
#: Different contexts of an anchor hash from which they are cut into pieces, and windows of a piece.
MANY, PIECE = 400, 32
#: Pieces that meet in one task; what is more is counted by digests.
MOST_PIECES = 20_000
#: Contexts are sorted together up to about so many bytes.
SORT_BYTES = 1 << 17
#: Anchors of a longer text are sought in parts of so many windows, so that memory does not grow with it.
PART = 1 << 20

_CONTEXT = "text_id binary, low int, windows int, anchor int, gram long, context long"


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """text, first window, windows, place of the anchor in the context, both hashes of each context."""
    n, width = len(data), length - gram + 1
    valid = np.zeros(n + 1, np.int64)
    long = np.diff(offsets) >= length
    np.add.at(valid, offsets[:-1][long], 1)
    np.add.at(valid, offsets[1:][long] - length + 1, -1)
    valid = np.cumsum(valid)[:n] > 0
    if not valid.any():
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    sums = prefix_hashes(data)
    at = np.arange(n - gram + 1)
    grams = stretch_hashes(sums, at, at + gram)
    bits = np.uint64(max(1, int(n).bit_length()))
    keyed = (grams >> bits << bits) | at.astype(np.uint64)
    blocks = -(-len(keyed) // width)
    padded = np.full(blocks * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[: len(keyed)] = keyed
    table = padded.reshape(blocks, width)
    before = np.minimum.accumulate(table, axis=1).ravel()
    after = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    first = np.flatnonzero(valid)
    least = np.minimum(after[first], before[first + width - 1])
    place = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    text = np.searchsorted(offsets, first, "right") - 1
    new = np.ones(len(first), bool)
    new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    start = np.flatnonzero(new)
    windows = np.diff(np.append(start, len(first)))
    low, anchor, text = first[start], place[start], text[start]
    context = stretch_hashes(sums, low, low + windows + length - 1)
    return text, low - offsets[text], windows, anchor - low, grams[anchor].view(np.int64), context.view(np.int64)


def _contexts(texts: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for a, z in slices(offsets):
                # the windows of an anchor may part at the end of a part; they are two contexts then
                for first in range(0, max(1, int(offsets[z] - offsets[a])), PART) if z == a + 1 else (0,):
                    part = data[offsets[a] + first : offsets[z]][: PART + length - 1 if z == a + 1 else None]
                    own = np.array([0, len(part)]) if z == a + 1 else offsets[a : z + 1] - offsets[a]
                    text, low, *columns = anchors(part, own, length, gram)
                    if len(text):
                        ids = batch.column("text_id").take(pa.array(text + a))
                        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
                        yield pa.RecordBatch.from_arrays(
                            [ids, *(pa.array(c).cast(k) for c, k in zip((low + first, *columns), kinds))], [f.split()[0] for f in _CONTEXT.split(", ")]
                        )

    return texts.mapInArrow(run, _CONTEXT)


def sorted_suffixes(symbols: np.ndarray, inside: np.ndarray, length: int) -> np.ndarray:
    """The places ``inside`` by the first ``length`` bytes of what begins there.

    ``symbols`` ends with its smallest byte. Two stages: suffixes smaller than their
    successors are sorted directly; every other one stands in front of a suffix that comes
    before it, so scans of the buckets of first bytes, in order, put them into place.
    """
    n = len(symbols)
    rising = symbols[:-1] < symbols[1:]
    differs = np.flatnonzero(symbols[:-1] != symbols[1:])
    ahead = np.searchsorted(differs, np.arange(n - 1))
    small = np.zeros(n, bool)
    known = ahead < len(differs)
    small[:-1][known] = rising[differs[ahead[known]]]
    # places outside up to the next small suffix are taken in, for others to be induced from
    wanted = np.zeros(n, bool)
    wanted[inside] = True
    next_small = np.append(np.flatnonzero(small), n - 1)
    ends = next_small[np.searchsorted(next_small, inside)]
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, inside, 1)
    np.add.at(step, ends + 1, -1)
    wanted |= np.cumsum(step)[:n] > 0
    raw = symbols.tobytes()
    direct = np.flatnonzero(wanted & (small | (np.arange(n) == n - 1)))
    order = np.array(sorted(direct.tolist(), key=lambda i: raw[i : i + length]), np.int64)
    by_byte = np.searchsorted(symbols[order], np.arange(257)) if len(order) else np.zeros(257, np.int64)
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    large = wanted & ~small
    large[n - 1] = False
    out = []
    for c in range(256):
        bucket = induced[c]
        fresh = np.concatenate(bucket) if bucket else np.zeros(0, np.int64)
        while len(fresh):  # runs of one byte
            before = fresh[fresh > 0] - 1
            fresh = before[large[before] & (symbols[before] == c)]
            if len(fresh):
                bucket.append(fresh)
        scan = np.concatenate([*bucket, order[by_byte[c] : by_byte[c + 1]]])
        if not len(scan):
            continue
        out.append(scan)
        before = scan[scan > 0] - 1
        before = before[large[before] & (symbols[before] > c)]
        first = symbols[before]
        for d in np.unique(first).tolist():
            induced[d].append(before[first == d])
        # the large suffixes behind the small ones of their own bucket have been put before them
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def common_prefixes(symbols: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """How many bytes each place shares with the one before it in ``order``, up to ``most``."""
    padded = np.concatenate([symbols, np.zeros(most + 8, np.uint8)]).astype(np.uint64)
    n = len(padded) - 7
    eight = np.zeros(n, np.uint64)
    for k in range(8):
        eight |= padded[k : k + n] << np.uint64(8 * k)
    shared = np.zeros(len(order), np.int64)
    live = np.arange(1, len(order))
    for depth in range(0, most, 8):
        differ = eight[order[live] + depth] ^ eight[order[live - 1] + depth]
        same = differ == 0
        low = differ[~same]
        bit = np.log2((low & (~low + np.uint64(1))).astype(np.float64)).astype(np.int64)
        shared[live[~same]] = depth + bit // 8
        live = live[same]
        shared[live] = depth + 8
        if not len(live):
            break
    return np.minimum(shared, most)


def repeated_windows(texts: list[bytes], windows: list[int], length: int) -> list[np.ndarray]:
    """For each context, which of its windows stand in any of the contexts twice."""
    symbols = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    starts = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
    inside = np.concatenate([s + np.arange(w) for s, w in zip(starts.tolist(), windows)])
    order = sorted_suffixes(symbols, inside, length)
    equal = common_prefixes(symbols, order, length) >= length
    own = np.zeros(len(symbols), bool)
    own[inside] = True
    # of one context's windows only those that it has itself count, as only they are whole
    equal[1:] &= own[order[1:]] & own[order[:-1]]
    twice = np.zeros(len(symbols), bool)
    twice[order[equal]] = True
    twice[order[np.flatnonzero(equal) - 1]] = True
    return [twice[s : s + w] for s, w in zip(starts.tolist(), windows)]


def _flags(rows: DataFrame, length: int) -> DataFrame:
    """gram, context and the first and last window of each run of repeated ones.

    ``rows``: key, gram, context, shift (of the first window in the context), windows, body.
    """

    def run(batches):
        held: list[tuple] = []

        def found():
            marks = repeated_windows([r[3] for r in held], [r[2] for r in held], length)
            out = []
            for (gram_context, shift, _, _), mark in zip(held, marks):
                edges = np.flatnonzero(np.diff(np.concatenate([[False], mark, [False]])))
                out += [(*gram_context, shift + a, shift + z - 1) for a, z in zip(edges[::2].tolist(), edges[1::2].tolist())]
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))],
                ["gram", "context", "first", "last"],
            )

        for group in runs(batches, ["key"]):
            columns = [group[c].to_pylist() for c in ("gram", "context", "shift", "windows", "body")]
            held += [((g, c), s, w, b) for g, c, s, w, b in zip(*columns)]
            if sum(len(r[3]) for r in held) >= SORT_BYTES:
                yield found()
        if held:
            yield found()

    dealt = rows.select("key", "gram", "context", "shift", "windows", "body").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "gram long, context long, first int, last int")


def _pieces(contexts: DataFrame, length: int) -> DataFrame:
    """Contexts cut into pieces of ``PIECE`` windows, keyed by what all windows of a piece hold."""
    schema = "key long, gram long, context long, shift int, windows int, body binary"

    def run(batches):
        for batch in batches:
            out = []
            for gram, context, windows, anchor, body in zip(*(batch.column(c).to_pylist() for c in ("gram", "context", "windows", "anchor", "body"))):
                # windows are numbered by how far they begin before the anchor, in every context alike
                for part in range((anchor - windows + 1) // PIECE, anchor // PIECE + 1):
                    first, last = max(0, anchor - part * PIECE - PIECE + 1), min(windows - 1, anchor - part * PIECE)
                    core = body[anchor - part * PIECE : anchor - part * PIECE - PIECE + 1 + length]
                    key = int.from_bytes(hashlib.blake2b(core + struct_of(gram, part), digest_size=8).digest(), "little", signed=True)
                    out.append((key, gram, context, first, last - first + 1, body[first : last + length]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))],
                [f.split()[0] for f in schema.split(", ")],
            )

    return contexts.select("gram", "context", "windows", "anchor", "body").mapInArrow(run, schema)


def struct_of(gram: int, part: int) -> bytes:
    return gram.to_bytes(8, "little", signed=True) + part.to_bytes(4, "little", signed=True)


def _bodies(texts: DataFrame, sources: DataFrame, length: int) -> DataFrame:
    """The bytes of each context, from one text that has it."""
    of_text = sources.groupBy("text_id").agg(F.collect_list(F.struct("gram", "context", "low", "windows", "anchor")).alias("wanted"))
    schema = "gram long, context long, windows int, anchor int, body binary"

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            out = []
            for i, wanted in enumerate(batch.column("wanted").to_pylist()):
                for w in wanted:
                    start = offsets[i] + w["low"]
                    out.append((w["gram"], w["context"], w["windows"], w["anchor"], data[start : start + w["windows"] + length - 1].tobytes()))
                if len(out) > 5000:
                    yield _batch(out)
                    out = []
            yield _batch(out)

    def _batch(out):
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], [f.split()[0] for f in schema.split(", ")]
        )

    return texts.join(of_text, "text_id").select("text", "wanted").mapInArrow(run, schema)


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """text_id (md5 of a text) and ``spans`` (start, end in bytes; sorted, apart) to remove.

    ``docs`` has a column text. Only texts with something to remove have a row.
    """
    texts = docs.select(_text_id().alias("text_id"), _bytes().alias("text")).where(F.length("text") >= length)
    every = cut_lineage(_contexts(texts, length, gram))
    # written, so that the rows of a frequent hash, on the other side of the join, can be split at run time
    often = cut_lineage(every.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"))
    shared = cut_lineage(every.join(often, "gram"))
    distinct = cut_lineage(
        shared.groupBy("gram", "context").agg(
            F.count("*").alias("n"), F.min(F.struct("text_id", "low", "windows", "anchor")).alias("source")
        )
    )
    kinds = distinct.groupBy("gram").agg(F.count("*").alias("kinds")).where("kinds > 1")
    mixed = distinct.join(kinds, "gram").select("gram", "context", "kinds", "source.*")
    bodies = _bodies(texts, mixed, length).dropDuplicates(["gram", "context"])
    bodies = cut_lineage(bodies.join(kinds, "gram"))
    few = bodies.where(F.col("kinds") <= MANY).withColumn("key", F.col("gram")).withColumn("shift", F.lit(0))
    pieces = cut_lineage(_pieces(bodies.where(F.col("kinds") > MANY), length))
    crowded = pieces.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > MOST_PIECES).select("key")
    one = F.explode(F.sequence(F.lit(0), F.col("windows") - 1)).alias("k")
    counted = (
        pieces.join(crowded, "key", "left_semi").select("gram", "context", "shift", "body", one)
        .select("gram", "context", (F.col("shift") + F.col("k")).alias("first"), F.md5(F.substring("body", F.col("k") + 1, F.lit(length))).alias("digest"))
    )
    twice = counted.groupBy("digest").agg(F.count("*").alias("m")).where("m > 1").select("digest")
    flags = (
        _flags(few, length)
        .unionByName(_flags(pieces.join(crowded, "key", "left_anti"), length))
        .unionByName(counted.join(twice, "digest", "left_semi").select("gram", "context", "first", F.col("first").alias("last")))
        .unionByName(
            distinct.where("n > 1").select("gram", "context", F.lit(0).alias("first"), (F.col("source.windows") - 1).alias("last"))
        )
    )
    by_context = cut_lineage(flags.groupBy("gram", "context").agg(F.collect_list(F.struct("first", "last")).alias("runs")))
    found = shared.join(by_context, ["gram", "context"]).select(
        "text_id",
        F.transform("runs", lambda r: F.struct((F.col("low") + r["first"]).alias("start"), (F.col("low") + r["last"] + length).alias("end"))).alias("spans"),
    )
    return found.groupBy("text_id").agg(F.flatten(F.collect_set("spans")).alias("spans"))


def _bytes():
    return F.coalesce(F.col("text").cast("binary"), F.lit(b""))


def _text_id():
    return F.unhex(F.md5(_bytes()))


def with_kept(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs`` (with a column text) and ``dedup``: n_bytes, removed (spans in bytes) and kept (bytes).

    Every byte that a string of ``length`` bytes covers which also begins elsewhere is
    removed, in all places. A null text counts as empty; equal rows are copies of each
    other; texts shorter than ``length`` stay whole. What is kept need not be valid UTF-8.
    A column called dedup is replaced.
    """
    docs = docs.drop("dedup")
    spans = cut_lineage(repeated_spans(docs, length, gram)).withColumnRenamed("text_id", "_id").withColumnRenamed("spans", "_spans")
    # short texts, among them all that are null or empty, have nothing to look up
    long = F.length(_bytes()) >= length
    none = F.lit(None).cast(spans.schema["_spans"].dataType).alias("_spans")
    rows = docs.where(long).join(spans, _text_id() == F.col("_id"), "left").drop("_id").unionByName(docs.where(~long).select("*", none))
    span = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "end")])
    kind = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("removed", T.ArrayType(span)), T.StructField("kept", T.BinaryType())])
    arrow = pa.struct([("n_bytes", pa.int64()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])
    schema = T.StructType([*docs.schema.fields, T.StructField("dedup", kind)])

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            out = []
            for i, found in enumerate(batch.column("_spans").to_pylist()):
                text = data[offsets[i] : offsets[i + 1]]
                merged: list[list[int]] = []
                for s in sorted((s["start"], s["end"]) for s in found or ()):
                    if merged and s[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s[1])
                    else:
                        merged.append([*s])
                edges = [0, *(x for s in merged for x in s), len(text)]
                kept = b"".join(text[a:z].tobytes() for a, z in zip(edges[::2], edges[1::2]))
                out.append({"n_bytes": len(text), "removed": [{"start": a, "end": z} for a, z in merged], "kept": kept})
            columns = [c for c, n in zip(batch.columns, batch.schema.names) if n != "_spans"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out, arrow)], schema.names)

    return rows.mapInArrow(run, schema)

