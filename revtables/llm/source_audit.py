"""How far the sources of a language differ from each other, by their words.

1. Over the text buffer of a slice of documents every start of a word is a pointer. The
   pointers are sorted by the words they point to, by multikey quicksort over characters of
   eight bytes. A run of equal words is a term; its pointers' documents give how often it
   occurs in each source and in how many documents.
2. Spark adds the runs of all slices up. Each language keeps the terms of at least
   ``LEAST_DOCUMENTS`` of its documents.
3. Smoothed shares of the kept terms, as whole numbers, are compared: a source with its
   language term by term, and each two sources of a language over all terms. For the latter
   terms are dealt out in shards; a shard holds shares as a matrix of terms and sources, the
   sources in tiles of bounded size, and only sums leave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revtables.llm.texts import LOWER, runs, slices, utf8, word_bounds
from revtables.session import cut_lineage

LEAST_DOCUMENTS = 10
#: Shares are parts of this.
WHOLE = 1_000_000_000
#: Added to each count.
SMOOTH = 2
#: Terms of a group that are listed.
MOST_TERMS = 10
#: Texts are sorted together in slices of about so many bytes; a longer one is cut into parts.
SLICE_BYTES = 4 << 20
#: Runs of pointers up to this size are sorted outright.
SMALL = 1 << 14
#: Terms of a shard, fewest shards, sources of a tile, and terms that are compared at a time.
SHARD_TERMS, LEAST_SHARDS, TILE, STEP = 4096, 16, 256, 512

#: Words are runs of ASCII letters and of bytes that are not ASCII.
IN_TERM = np.zeros(256, bool)
IN_TERM[65:91] = IN_TERM[97:123] = IN_TERM[128:] = True

_TERMS = "lang string, source string, term string, n long, docs long"


def characters(words: np.ndarray, start: np.ndarray, end: np.ndarray, depth: int) -> np.ndarray:
    """The eight bytes of each word from ``depth`` on as one number; 0 stands behind its end.

    ``words``: at every place the eight bytes from there on, the first one highest.
    """
    left = np.clip(end - start - depth, 0, 8).astype(np.uint64)
    kept = np.where(left > 0, ~np.uint64(0) << (np.uint64(64) - np.maximum(left, np.uint64(1)) * np.uint64(8)), np.uint64(0))
    return words[np.minimum(start + depth, len(words) - 1)] & kept


def eight_bytes(data: np.ndarray) -> np.ndarray:
    """At every place the eight bytes from there on as one number, the first one highest."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    out = np.zeros(len(data) + 1, np.uint64)
    for k in range(8):
        out |= padded[k : k + len(out)].astype(np.uint64) << np.uint64(56 - 8 * k)
    return out


def sorted_pointers(words: np.ndarray, start: np.ndarray, end: np.ndarray, small: int = SMALL) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the words in the order of what they say, and where runs of equal ones begin.

    Multikey quicksort: a range is parted by the character of one of its words at its depth
    into smaller, equal and larger; the equal ones go on with the next character. Ranges that
    have become small are sorted by their character outright, all those of a depth at once.
    Equal words stay in the order in which they stand.
    """
    order = np.arange(len(start))
    begins = np.zeros(len(start), bool)
    begins[:1] = True
    waiting: dict[int, list[np.ndarray]] = {}
    ranges = [(0, len(start), 0)]
    while ranges:
        first, last, depth = ranges.pop()
        if last - first <= small:
            if first < last:
                begins[first] = True
                waiting.setdefault(depth, []).append(np.array([[first, last]]))
            continue
        here = order[first:last]
        keys = characters(words, start[here], end[here], depth)
        sample = np.sort(keys[:: len(keys) // 63 + 1])
        pivot = sample[len(sample) // 2]
        less, more = keys < pivot, keys > pivot
        equal = ~(less | more)
        a = first + int(less.sum())
        z = a + int(equal.sum())
        order[first:last] = np.concatenate([here[less], here[equal], here[more]])
        begins[a] = True
        ranges += [(first, a, depth), (z, last, depth)]
        if pivot & np.uint64(255):  # a word goes on where its last byte here is not the filling
            ranges.append((a, z, depth + 8))
    while waiting:
        depth = min(waiting)
        low, high = np.concatenate(waiting.pop(depth)).T
        number = np.repeat(np.arange(len(low)), high - low)
        place = np.arange(len(number)) + np.repeat(low - np.cumsum(high - low) + (high - low), high - low)
        here = order[place]
        keys = characters(words, start[here], end[here], depth)
        by = np.lexsort((keys, number))
        order[place], keys = here[by], keys[by]
        edge = np.ones(len(keys) + 1, bool)
        edge[1:-1] = (keys[1:] != keys[:-1]) | (number[1:] != number[:-1])
        at = np.flatnonzero(edge)
        begins[place[at[:-1]]] = True
        goes_on = (np.diff(at) > 1) & ((keys[at[:-1]] & np.uint64(255)) != 0)
        if goes_on.any():
            low = place[at[:-1][goes_on]]
            waiting.setdefault(depth + 8, []).append(np.stack([low, low + np.diff(at)[goes_on]], axis=1))
    return order, np.flatnonzero(begins)


def runs_of_terms(data: np.ndarray, offsets: np.ndarray, group: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Terms of some texts with, for each group of texts that has one: term and group, occurrences and documents.

    The terms come as a list, the first array numbers them (term * groups + group).
    """
    data = LOWER[data]
    start, end = word_bounds(data, offsets, IN_TERM)
    order, begins = sorted_pointers(eight_bytes(data), start, end)
    term = np.zeros(len(order), np.int64)
    term[begins] = 1
    term = np.cumsum(term) - 1
    document = np.searchsorted(offsets, start[order], "right") - 1
    # pointers of a run stand in the order of their documents
    new = np.ones(len(order), bool)
    new[1:] = (term[1:] != term[:-1]) | (document[1:] != document[:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(order)))
    groups = int(group.max(initial=0)) + 1
    key, inverse = np.unique(term[at] * groups + group[document[at]], return_inverse=True)
    n = np.bincount(inverse, times, len(key)).astype(np.int64)
    docs = np.bincount(inverse, minlength=len(key)).astype(np.int64)
    raw = data.tobytes()
    first = order[begins]
    return [raw[a:z] for a, z in zip(start[first].tolist(), end[first].tolist())], key, n, docs


def _parts(data: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """A long text in parts of about ``size`` bytes that end between words."""
    first = 0
    while first < len(data):
        last = min(len(data), first + size)
        while last < len(data) and IN_TERM[data[last]]:
            gap = np.flatnonzero(~IN_TERM[data[last : last + size]])
            last = last + int(gap[0]) if len(gap) else min(len(data), last + size)
        yield data[first:last]
        first = last


def _counted(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        names = list(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist()))
        number = {name: k for k, name in enumerate(dict.fromkeys(names))}
        group = np.array([number[name] for name in names], np.int64)
        known = list(number)

        def rows(terms, key, n, docs, groups):
            of_term, of_group = (key // groups).tolist(), (key % groups).tolist()
            columns = [[known[g][0] for g in of_group], [known[g][1] for g in of_group], pa.array([terms[t] for t in of_term], pa.binary()).cast(pa.string()), n, docs]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        for a, z in slices(offsets, size):
            part, own = data[offsets[a] : offsets[z]], group[a:z]
            if len(part) <= size:
                yield rows(*runs_of_terms(part, offsets[a : z + 1] - offsets[a], own), int(own.max(initial=0)) + 1)
                continue
            # one long text: its parts are counted one by one, and a term of several parts is in one document
            total: dict[bytes, int] = {}
            for piece in _parts(part, size):
                terms, _, n, _ = runs_of_terms(piece, np.array([0, len(piece)]), np.zeros(1, np.int64))
                for term, times in zip(terms, n.tolist()):
                    total[term] = total.get(term, 0) + times
            times = np.fromiter(total.values(), np.int64, len(total))
            yield rows(list(total), np.arange(len(total)) * (int(own[0]) + 1) + int(own[0]), times, np.ones(len(total), np.int64), int(own[0]) + 1)


def term_counts(docs: DataFrame, size: int = SLICE_BYTES) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents that have it)."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    found = rows.mapInArrow(lambda batches: _counted(batches, size), _TERMS)
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(WHOLE * (n + SMOOTH) / (total + SMOOTH * terms)), in exact whole numbers."""
    above = F.lit(WHOLE).cast("decimal(10,0)") * (n + SMOOTH).cast("decimal(20,0)")
    return F.when(terms > 0, F.call_function("div", above, (total + SMOOTH * terms).cast("decimal(20,0)")) + 1).otherwise(F.lit(1).cast("long"))


def difference(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)) in exact whole numbers."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def kept_terms(counts: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """lang, source, term, n and of_lang (occurrences in the language) of the terms that a language keeps."""
    term = Window.partitionBy("lang", "term")
    sums = counts.withColumns({"of_lang": F.sum("n").over(term), "in_docs": F.sum("docs").over(term)})
    return sums.where(F.col("in_docs") >= least).select("lang", "source", "term", "n", "of_lang")


def group_sizes(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, terms (kept by the language), total and of_lang (occurrences of those), for every group of documents."""
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    langs = kept.groupBy("lang", "term").agg(F.first("of_lang").alias("n")).groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("of_lang"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sizes = groups.join(langs, "lang", "left").join(totals, ["lang", "source"], "left")
    return sizes.select("lang", "source", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("terms", "total", "of_lang")])


def _compared(group: pa.Table) -> tuple[list[str], list[str], np.ndarray, np.ndarray, np.ndarray, int, int]:
    """Sources of both tiles, the sums of their differences, their shares of absent terms, terms seen and kept."""
    tile, source, p = group["tile"].to_numpy(), np.array(group["source"].to_pylist(), object), group["p"].to_numpy()
    term = group["term"].combine_chunks().dictionary_encode()
    code = term.indices.fill_null(-1).to_numpy()
    seen, terms = len(term.dictionary), int(group["terms"][0].as_py())
    sides = []
    for t in (group["a"][0].as_py(), group["b"][0].as_py()):
        own = (code < 0) & (tile == t)
        names, absent = source[own], p[own]
        place = {name: k for k, name in enumerate(names)}
        rows = np.flatnonzero((code >= 0) & (tile == t))
        sides.append((names, absent, code[rows], np.array([place[s] for s in source[rows]], np.int64), p[rows]))
    (left, left_absent, *_), (right, right_absent, *_) = sides
    sums = np.zeros((len(left), len(right)), np.int64)
    for first in range(0, seen, STEP):
        n = min(STEP, seen - first)
        one, other = (np.tile(absent, (n, 1)) for _, absent, *_ in sides)
        for matrix, (_, _, of, column, value) in zip((one, other), sides):
            now = (of >= first) & (of < first + n)
            matrix[of[now] - first, column[now]] = value[now]
        for i in range(len(left)):
            apart = one[:, i : i + 1] - other
            sums[i] += (apart * apart // (one[:, i : i + 1] + other)).sum(axis=0)
    return left, right, sums, left_absent, right_absent, seen, terms


def _sums(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for group in runs(batches, ["lang", "shard", "a", "b"]):
        left, right, sums, left_absent, right_absent, seen, terms = _compared(group)
        n, m = sums.shape
        columns = [
            [group["lang"][0].as_py()] * (n * m), np.repeat(left, m).tolist(), np.tile(right, n).tolist(), sums.ravel(),
            np.repeat(left_absent, m), np.tile(right_absent, n), np.full(n * m, seen), np.full(n * m, terms),
        ]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def pair_differences(shares: DataFrame, sizes: DataFrame) -> DataFrame:
    """lang, source, item (another source of the language) and value (differences summed over all kept terms)."""
    most = sizes.groupBy("lang", "terms").agg(F.count("*").alias("sources")).agg(F.max("sources"), F.max("terms")).first()
    tiles, shards = -(-(most[0] or 0) // TILE) or 1, max(LEAST_SHARDS, -(-(most[1] or 0) // SHARD_TERMS))
    tile = F.pmod(F.xxhash64("source"), F.lit(tiles)).cast("int").alias("tile")
    absent = sizes.select(
        "lang", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), tile, "source", F.lit(None).cast("string").alias("term"),
        share(F.lit(0).cast("long"), F.col("total"), F.col("terms")).alias("p"), "terms",
    )
    rows = shares.select("lang", F.pmod(F.xxhash64("term"), F.lit(shards)).cast("int").alias("shard"), tile, "source", "term", "p", "terms").unionByName(absent)
    # a tile meets every other one, itself included
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    rows = rows.withColumns({"a": F.least("tile", "_other"), "b": F.greatest("tile", "_other")}).drop("_other")
    key = ["lang", "shard", "a", "b"]
    dealt = rows.repartition(min(20_000, shards * tiles * (tiles + 1) // 2), *key).sortWithinPartitions(*key)
    schema = "lang string, source string, item string, value long, p long, q long, seen long, terms long"
    kinds = pa.schema([(name, pa.string() if kind == "string" else pa.int64()) for name, kind in (f.split() for f in schema.split(", "))])
    sums = dealt.mapInArrow(lambda batches: _sums(batches, kinds), schema).where("source <> item")
    of_pair = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.first("p").alias("p"), F.first("q").alias("q"), F.sum("seen").alias("seen"), F.first("terms").alias("terms"))
    value = F.col("value") + (F.col("terms") - F.col("seen")) * difference(F.col("p"), F.col("q"))
    ways = [of_pair.select("lang", "source", "item", value.alias("value"))]
    if tiles > 1:  # pairs of one tile come both ways out of their shard, those of two tiles one way
        ways.append(of_pair.where(F.pmod(F.xxhash64("source"), F.lit(tiles)) != F.pmod(F.xxhash64("item"), F.lit(tiles))).select("lang", F.col("item").alias("source"), F.col("source").alias("item"), value.alias("value")))
    return ways[0] if len(ways) == 1 else ways[0].unionByName(ways[1])


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, most_terms: int = MOST_TERMS, size: int = SLICE_BYTES) -> DataFrame:
    """lang, source, part, item, value and rank: how the sources of a language differ.

    ``docs`` has columns text, lang and source; nulls count as empty. Part ``pair`` has each
    other source of the language, the most different first; part ``term`` the at most
    ``most_terms`` terms by which a source exceeds its language most. Equal values go by the
    item's bytes. Each row is a document of its own, also if it is repeated. A text without
    words only makes its source occur; if a language keeps no term, its sources differ by 0;
    one that has a single source has no pairs. Other columns are not read, whatever their
    names. No documents give no rows.
    """
    kept = cut_lineage(kept_terms(cut_lineage(term_counts(docs, size)), least))
    sizes = cut_lineage(group_sizes(docs, kept))
    p, q = share(F.col("n"), F.col("total"), F.col("terms")), share(F.col("of_lang"), F.col("_all"), F.col("terms"))
    shares = kept.join(sizes.withColumnRenamed("of_lang", "_all"), ["lang", "source"]).select("lang", "source", "term", p.alias("p"), q.alias("q"), "terms")
    shares = cut_lineage(shares)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), difference(F.col("p"), F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most_terms)
    pairs = pair_differences(shares, sizes).withColumn("rank", F.row_number().over(order))
    parts = [rows.select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank") for name, rows in (("pair", pairs), ("term", terms))]
    return parts[0].unionByName(parts[1])
