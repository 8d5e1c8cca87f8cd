"""Benchmark decontamination: passages of benchmark items inside training texts.

Every shard, some thousand texts, gets a full-text index over its words, and the
phrases of all items are searched in it. Words that no item has can't be part of a match,
so only runs of item words as long as the shortest phrase go into the index; they part it
as the ends of texts do. Words are compared by 64-bit hashes. Items are held in blocks of
bounded size, each searched in all texts; what blocks find is merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revtables.llm.fm_index import FmIndex
from revtables.llm.texts import WORDLIKE, slices, utf8, word_hashes
from revtables.session import cut_lineage

#: Words of a phrase; an item of fewer words is one phrase.
PHRASE_WORDS = 13
#: Item words that are sent to the tasks at a time.
BLOCK_WORDS = 2_000_000
#: Item words of the texts that one index holds; the last text goes in whole.
SHARD_WORDS = 300_000
SPAN = ("start", "end", "word", "words")


def _found(item_id: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("n_words", T.LongType()),
            T.StructField("spans", T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in SPAN]))),
            T.StructField("items", T.ArrayType(item_id)),
        ]
    )


class Phrases:
    """The phrases of a block of items, over the numbered words of the block."""

    def __init__(self, items: list[tuple[int, np.ndarray]], size: int) -> None:
        self.words = np.unique(np.concatenate([w for _, w in items])) if items else np.zeros(0, np.uint64)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        rows: dict[int, list] = {}
        for number, (_, words) in enumerate(items):
            n = min(size, len(words))
            numbers = np.searchsorted(self.words, words) + 1
            windows = np.lib.stride_tricks.sliding_window_view(numbers, n)
            rows.setdefault(n, []).append((windows, np.full(len(windows), number)))
        for n, parts in rows.items():
            lines, inverse = np.unique(np.concatenate([p[0] for p in parts]), axis=0, return_inverse=True)
            owner = np.concatenate([p[1] for p in parts])
            by_line = np.argsort(inverse.ravel(), kind="stable")
            ends = np.searchsorted(inverse.ravel()[by_line], np.arange(len(lines) + 1))
            self.by_length[n] = (lines, owner[by_line], ends)
        self.names = [i for i, _ in items]
        self.shortest = min(rows, default=1)
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.words & np.uint64(0xFFFF)).astype(np.int64)] = True

    def number(self, words: np.ndarray) -> np.ndarray:
        """The number of each word, 0 for those that no item has."""
        out = np.zeros(len(words), np.int64)
        some = np.flatnonzero(self.maybe[(words & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.words, words[some]), len(self.words) - 1)
        out[some] = np.where(self.words[at] == words[some], at + 1, 0)
        return out


def _items(items: DataFrame, item_id: T.DataType, size: int, block_words: int):
    """The items' words, block by block, in the order of their ids."""

    def words(batches):
        for batch in batches:
            hashes, _, _, first = word_hashes(*utf8(batch.column("text")), WORDLIKE)
            lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), lists], ["item_id", "words"])

    table = items.where("item_id IS NOT NULL").select(F.col("item_id").cast(item_id).alias("item_id"), "text")
    table = table.mapInArrow(words, f"item_id {item_id.simpleString()}, words array<long>").where("size(words) > 0").orderBy("item_id")
    block, held = [], 0
    for row in table.toLocalIterator():
        block.append((row["item_id"], np.array(row["words"], np.int64).view(np.uint64)))
        held += len(row["words"])
        if held >= block_words:
            yield Phrases(block, size)
            block, held = [], 0
    if block:
        yield Phrases(block, size)


def _runs(numbers: np.ndarray, first: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the runs of item words in each text, of ``least`` words or more."""
    inside = np.zeros(len(numbers) + 2, bool)
    inside[1:-1] = numbers > 0
    cut = np.zeros(len(numbers) + 1, bool)
    cut[first] = True
    start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
    long = end - start >= least
    return start[long], end[long]


def _search_texts(text: pa.Array, phrases: Phrases) -> list[dict]:
    """``found`` of each text, from one index for every ``SHARD_WORDS`` item words or so."""
    data, offsets = utf8(text)
    out, parts, held = [], [], 0
    for a, z in slices(offsets):
        words, start, end, first = word_hashes(data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a], WORDLIKE)
        numbers = phrases.number(words)
        out += [{"n_words": n, "spans": [], "items": []} for n in np.diff(first).tolist()]
        owner = np.repeat(np.arange(a, z), np.diff(first))
        base = np.repeat(offsets[a:z] - offsets[a], np.diff(first))
        for s, e in zip(*_runs(numbers, first, phrases.shortest)):
            where = np.stack([np.full(e - s, owner[s]), start[s:e] - base[s], end[s:e] - base[s], np.arange(s, e) - first[owner[s] - a]])
            parts.append((np.append(numbers[s:e], 0), np.append(where, np.zeros((4, 1), np.int64), axis=1)))
            held += e - s
        if held >= SHARD_WORDS or z == len(offsets) - 1:
            _search_shard(parts, phrases, out, data, offsets)
            parts, held = [], 0
    return out


def _search_shard(parts: list, phrases: Phrases, out: list[dict], data: np.ndarray, offsets: np.ndarray) -> None:
    if not parts:
        return
    row = np.concatenate([p[0] for p in parts])
    owner, begin, end, word = np.concatenate([p[1] for p in parts], axis=1)
    starts = np.concatenate([[0], np.flatnonzero(row == 0)[:-1] + 1])
    index = FmIndex(row, starts, len(phrases.words))
    here = np.zeros(len(phrases.words) + 1, bool)
    here[row] = True
    items: dict[int, set] = {}
    spans: dict[int, set] = {}
    for size, (lines, owners, ends) in phrases.by_length.items():
        some = np.flatnonzero(here[lines].all(axis=1))
        low, high = index.search(lines[some])
        for i in np.flatnonzero(high > low).tolist():
            names = {phrases.names[k] for k in owners[ends[some[i]] : ends[some[i] + 1]].tolist()}
            for p in index.locate(np.arange(low[i], high[i])).tolist():
                t = int(owner[p])
                items.setdefault(t, set()).update(names)
                spans.setdefault(t, set()).add((int(word[p]), size, p))
    for t, found in spans.items():
        points = np.concatenate([[0], np.cumsum((data[offsets[t] : offsets[t + 1]] & 0xC0) != 0x80)])
        out[t]["items"] = sorted(items[t])
        out[t]["spans"] = _merged(
            {"start": int(points[begin[p]]), "end": int(points[end[p + n - 1]]), "word": w, "words": n} for w, n, p in found
        )


def _merged(spans) -> list[dict]:
    """Spans that overlap or touch as words become one."""
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: (s["word"], s["words"])):
        if out and s["word"] <= out[-1]["word"] + out[-1]["words"]:
            if s["word"] + s["words"] > out[-1]["word"] + out[-1]["words"]:
                out[-1] |= {"end": s["end"], "words": s["word"] + s["words"] - out[-1]["word"]}
        else:
            out.append(dict(s))
    return out


def _both(found: list[dict], more: list[dict]) -> list[dict]:
    return [
        {"n_words": b["n_words"], "spans": _merged(a["spans"] + b["spans"]), "items": sorted({*a["items"], *b["items"]})}
        for a, b in zip(found, more)
    ]


def search_items(docs: DataFrame, items: DataFrame, phrase_words: int = PHRASE_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` (with a column text) and ``found``: n_words, spans and items of each text.

    Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. A span is
    a maximal stretch of the text that occurrences of phrases cover together (start and end
    in code points, its first word and how many words it has); ``items`` are the ids of the items with an occurrence.
    Null texts have no words. Item ids are whole numbers or else texts. Items without an id
    or without words have no phrase; items with the same id count as one. Without items nothing is found. A column called found is
    replaced.
    """
    docs = docs.drop("found")
    item_id = T.LongType() if isinstance(items.schema["item_id"].dataType, T.IntegralType) else T.StringType()
    schema = T.StructType([*docs.schema.fields, T.StructField("found", _found(item_id))])
    name = pa.int64() if isinstance(item_id, T.LongType) else pa.string()
    kind = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([(c, pa.int64()) for c in SPAN]))), ("items", pa.list_(name))])

    def search(frame: DataFrame, phrases: Phrases) -> DataFrame:
        def run(batches):
            for batch in batches:
                found, columns = _search_texts(batch.column("text"), phrases), batch.columns
                if "found" in batch.schema.names:
                    found, columns = _both(batch.column("found").to_pylist(), found), columns[:-1]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(found, kind)], schema.names)

        return frame.mapInArrow(run, schema)

    out = None
    for phrases in _items(items, item_id, phrase_words, block_words):
        out = search(docs if out is None else cut_lineage(out), phrases)
    return search(docs, Phrases([], phrase_words)) if out is None else out


def n_hit(found: str = "found"):
    """Words inside an occurrence."""
    return F.aggregate(F.col(found)["spans"], F.lit(0).cast("long"), lambda n, s: n + s["words"])


def is_contaminated(found: str = "found"):
    """The rule: some words are inside an occurrence, and a twentieth of all or more."""
    return (n_hit(found) > 0) & (20 * n_hit(found) >= F.col(found)["n_words"])
