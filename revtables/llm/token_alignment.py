"""How the tokens of two tokenizers lie over each other, with counts of their pairs.

1. Each text is cut by both tokenizers. Places where tokens of both end cut it into groups;
   a pair of tokens whose bytes overlap is a link. As both cover the same bytes, the ends of
   all tokens part a text into stretches, one a link.
2. A table made once tells for each id of the first tokenizer the id of the second with the
   same bytes. Groups of one token each that agree with it, most of them, need no pair: a task
   counts them in a vector as long as the vocabulary, and the vectors are added up.
3. Only the links of other groups go into a shuffle by pair. A block of texts sends each of its
   pairs once, with its number there; the counts go back to the block, and its texts look
   them up by that number.

A task holds the texts of a block, or one longer text, and numbers for each of their tokens.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revtables.llm.texts import slices, utf8
from revtables.session import cut_lineage

#: Where the files of the tokenizers are, on every machine.
FOLDER = "/opt/tokenizers"
BYTE_LEVEL, PIECES = f"{FOLDER}/byte_bpe_50k.json", f"{FOLDER}/piece_bpe_32k.model"
#: Texts of a block have about so many bytes; a task needs a hundred times as much beside its vocabularies.
BLOCK_BYTES = 1 << 20

#: Texts up to so many characters are cut by the faster library.
LONGEST = 200_000

# Fixed value: how the first tokenizer parts a text before its merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_DOC = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_LISTS = ("same_ids", "same_times", "pair_numbers", "pair_times", "pairs", "pair_counts", "vector")


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Bytes that print as themselves do so; the others have the characters from 256 on.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteLevel:
    """The first tokenizer: cuts a space and the text.

    Where the file says no more than the usual pattern and merges in the order of their ids,
    which is the order in which a table of ranks merges, the faster library of such tables
    cuts the texts; the ids are the same. Its pattern gives up on runs of a million spaces,
    so longer texts go to the other library.
    """

    def __init__(self, path: str):
        from tiktoken import Encoding

        self.path, self.slower = path, None
        alphabet = byte_alphabet()
        told = json.loads(Path(path).read_text())
        special = {t["id"] for t in told["added_tokens"]}
        vocabulary = told["model"]["vocab"] | {t["content"]: t["id"] for t in told["added_tokens"]}
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes[i] = bytes(alphabet[c] for c in token)
        merged = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in told["model"]["merges"]]
        plain = told["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        if plain and not told.get("normalizer") and merged == sorted(set(merged)) and len(merged) + 256 + len(special) == len(vocabulary):
            ranks = {b: i for i, b in enumerate(self.bytes) if b and i not in special}
            self.table = Encoding("table", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        else:
            self.table = None

    def ids(self, texts: list[str]) -> list[list[int]]:
        if self.table is None:
            return self.slower_ids(texts)
        return [self.table.encode_ordinary(" " + t) if len(t) <= LONGEST else self.slower_ids([t])[0] for t in texts]

    def slower_ids(self, texts: list[str]) -> list[list[int]]:
        if self.slower is None:  # its tables are as large again
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.slower = Tokenizer.from_file(self.path)
            self.slower.encode_special_tokens = True
        return [e.ids for e in self.slower.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


class Pieces:
    """The second tokenizer: cuts the text, to which it puts a space itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.tokenizer = SentencePieceProcessor(model_file=path)
        self.is_byte = [self.tokenizer.is_byte(i) for i in range(self.tokenizer.get_piece_size())]
        names = [self.tokenizer.id_to_piece(i) for i in range(self.tokenizer.get_piece_size())]
        self.bytes = [bytes([int(n[3:5], 16)]) if b else n.replace("▁", " ").encode() for n, b in zip(names, self.is_byte)]

    def ids(self, texts: list[str]) -> list[list[int]]:
        return self.tokenizer.encode(texts, num_threads=1)


class Vocabularies:
    """Both tokenizers, what their ids stand for, and the ids of both that stand for the same."""

    def __init__(self, first, second):
        self.first, self.second = first, second
        self.lengths = [np.array([len(b) for b in t.bytes], np.int64) for t in (first, second)]
        by_bytes: dict[bytes, int] = {}
        for i, b in enumerate(second.bytes):  # a piece goes before a single byte of the same value
            if b not in by_bytes or second.is_byte[by_bytes[b]] and not second.is_byte[i]:
                by_bytes[b] = i
        self.same = np.array([by_bytes.get(b, -1) if b else -1 for b in first.bytes], np.int64)
        n = max(len(first.bytes), len(second.bytes))
        names = [str(i).encode() for i in range(n)]
        self.name_length = np.array([len(x) for x in names], np.int64)
        self.names = np.frombuffer(b"".join(x.ljust(len(names[-1])) for x in names), np.uint8).reshape(n, -1)


@lru_cache(maxsize=2)
def vocabularies(first: str, second: str) -> Vocabularies:
    return Vocabularies(ByteLevel(first), Pieces(second))


def _schema(row: T.StructType, others: str) -> T.StructType:
    return T.StructType([T.StructField("row", row), *T.StructType.fromDDL(others).fields])


def _flat(lists: list[list[int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(lists), np.int64, sum(map(len, lists)))


class Block:
    """The texts of a block that both tokenizers give back whole, one behind the other."""

    def __init__(self, vocabularies: Vocabularies, texts: list[str]):
        v = vocabularies
        cut = [t.ids(texts) for t in (v.first, v.second)]
        whole = [bool(t) and all(b"".join(map(s.bytes.__getitem__, ids[k])) == b" " + t.encode() for s, ids in zip((v.first, v.second), cut)) for k, t in enumerate(texts)]
        self.texts = np.flatnonzero(whole)
        lists = [[ids[k] for k in self.texts] for ids in cut]
        self.n_a, self.n_b = (np.array([len(x) for x in side], np.int64) for side in lists)
        self.a, self.b = (_flat(side) for side in lists)
        ends = [np.cumsum(lengths[ids]) for lengths, ids in zip(v.lengths, (self.a, self.b))]
        size = int(ends[0][-1]) if len(self.a) else 0
        is_end = [np.zeros(size + 1, bool) for _ in ends]
        for mark, at in zip(is_end, ends):
            mark[at] = True
        at = np.flatnonzero(is_end[0] | is_end[1])
        of_a, of_b = is_end[0][at], is_end[1][at]
        both = of_a & of_b
        number = lambda marks: np.cumsum(marks) - marks
        self.link_a, self.link_b, group = self.a[number(of_a)], self.b[number(of_b)], number(both)
        self.group_a, self.group_b = group[of_a], group[of_b]
        # a stretch that lies between two common ends is a group of one token each
        self.alone = both.copy()
        self.alone[1:] &= both[:-1]
        text_end = ends[0][np.cumsum(self.n_a) - 1]
        self.link_text = np.searchsorted(text_end, at)
        self.n_links = np.bincount(self.link_text, minlength=len(self.texts))
        self.n_groups = np.bincount(self.link_text[both], minlength=len(self.texts))
        self.v = v

    def written_groups(self) -> list[str]:
        """SHA-256 of each text's groups: ids with commas, ``|`` between the sides, ``;`` between groups."""
        if not len(self.texts):
            return []
        ids = np.concatenate([self.a, self.b])
        order = np.argsort(np.concatenate([self.group_a * 2, self.group_b * 2 + 1]), kind="stable")
        mark = np.full(len(ids), ord(","), np.uint8)
        for group, first, sign in ((self.group_a, 0, "|"), (self.group_b, len(self.a), ";")):
            last = np.append(group[1:] != group[:-1], True)
            mark[first : first + len(group)][last] = ord(sign)
        ids, mark = ids[order], mark[order]
        length = self.v.name_length[ids]
        end = np.cumsum(length + 1)
        start = end - length - 1
        out = np.empty(int(end[-1]), np.uint8)
        for k in range(int(length.max())):
            some = length > k
            out[start[some] + k] = self.v.names[ids[some], k]
        out[end - 1] = mark
        edges = [0, *end[np.cumsum(self.n_a + self.n_b) - 1].tolist()]
        return [hashlib.sha256(out[a : z - 1]).hexdigest() for a, z in zip(edges, edges[1:])]

    def links(self) -> tuple[list, list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each text ids and times of its agreeing groups, and numbers and times of its other pairs; then those pairs with their counts, and the agreeing ids with theirs."""
        n = len(self.texts)
        agrees = self.alone & (self.v.same[self.link_a] == self.link_b)
        pairs, number, counts = np.unique((self.link_a << 32 | self.link_b)[~agrees], return_inverse=True, return_counts=True)
        per_text = []
        for text, what, size in ((self.link_text[agrees], self.link_a[agrees], len(self.v.same)), (self.link_text[~agrees], number, max(1, len(pairs)))):
            key, times = np.unique(text * size + what, return_counts=True)
            edges = np.searchsorted(key, np.arange(n + 1) * size)
            ids, times = (key % size).astype(np.int32), times.astype(np.int32)
            per_text.append([(ids[a:z].tobytes(), times[a:z].tobytes()) for a, z in zip(edges, edges[1:])])
        same, same_counts = np.unique(self.link_a[agrees], return_counts=True)
        return per_text[0], per_text[1], pairs, counts, same, same_counts


def _cut(docs: DataFrame, carry: list[str], text: str, paths: tuple[str, str], size: int) -> DataFrame:
    """A row a text, with its numbers; a row a block, with its pairs; and a row a task, with its vector."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.col(f"`{text}`").alias("text"))
    schema = _schema(rows.schema["row"].dataType, f"block long, {_DOC}, " + ", ".join(f"{c} binary" for c in _LISTS))

    def run(batches):
        v = vocabularies(*paths)
        block = TaskContext.get().partitionId() << 32
        vector = np.zeros(len(v.same), np.int64)
        arrow = None
        for batch in batches:
            if arrow is None:
                numbers = [pa.field(f.split()[0], pa.string() if f.endswith("string") else pa.int64()) for f in _DOC.split(", ")]
                arrow = pa.schema([pa.field("row", batch.schema.field("row").type), pa.field("block", pa.int64()), *numbers, *(pa.field(c, pa.binary()) for c in _LISTS)])
            offsets = utf8(batch.column("text"))[1]
            for first, last in slices(offsets, size):
                cut = Block(v, [t or "" for t in batch.column("text").slice(first, last - first).to_pylist()])
                same, pairs, keys, counts, ids, times = cut.links()
                vector[ids] += times
                n = last - first
                columns = {c: [None] * n for c in _LISTS} | {c: np.zeros(n, np.int64) for c in ("n_a", "n_b", "n_groups", "n_links")} | {"groups_sha256": [""] * n}
                for c in ("n_a", "n_b", "n_groups", "n_links"):
                    columns[c][cut.texts] = getattr(cut, c)
                for at, digest, one, other in zip(cut.texts.tolist(), cut.written_groups(), same, pairs):
                    columns["groups_sha256"][at] = digest
                    for c, value in zip(_LISTS, (*one, *other)):
                        columns[c][at] = value
                columns |= {"block": [block] * n, "row": batch.column("row").slice(first, n)}
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for f in arrow for c in [columns[f.name]]], schema=arrow)
                yield pa.RecordBatch.from_pylist([{"block": block, "pairs": keys.tobytes(), "pair_counts": counts.tobytes()}], arrow)
                block += 1
        if vector.any():
            yield pa.RecordBatch.from_pylist([{"vector": vector.tobytes()}], arrow)

    return rows.mapInArrow(run, schema)


def _vector(cut: DataFrame, n: int) -> np.ndarray:
    """The sum of the tasks' vectors; as long as the vocabulary, whatever the input."""

    def run(batches):
        total = np.zeros(n, np.int64)
        for batch in batches:
            for value in batch.column("vector"):
                total += np.frombuffer(value.as_buffer(), np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    sums = cut.where("vector IS NOT NULL").select("vector").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    out = np.zeros(n, np.int64)
    for row in sums.collect():  # at most one row an id
        out[row["id"]] = row["n"]
    return out


def _pair_rows(cut: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """block, number (of the pair there), pair, n, and whether both ids stand for the same bytes."""
    schema = "block long, number int, pair long, n long, same boolean"

    def run(batches):
        same = vocabularies(*paths).same
        for batch in batches:
            for block, pairs, counts in zip(batch.column("block").to_pylist(), batch.column("pairs"), batch.column("pair_counts")):
                pairs, counts = (np.frombuffer(x.as_buffer(), np.int64) for x in (pairs, counts))
                columns = [np.full(len(pairs), block), np.arange(len(pairs), dtype=np.int32), pairs, counts, same[pairs >> 32] == (pairs & 0xFFFFFFFF)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [f.split()[0] for f in schema.split(", ")])

    return cut.where("pairs IS NOT NULL").select("block", "pairs", "pair_counts").mapInArrow(run, schema)


def _numbers(value: pa.Scalar, kind=np.int32) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), kind) if value.is_valid else np.zeros(0, kind)


def aligned(docs: DataFrame, carry: list[str], text: str = "text", first: str = BYTE_LEVEL, second: str = PIECES, size: int = BLOCK_BYTES) -> DataFrame:
    """The columns ``carry`` of ``docs`` and ``alignment``, a struct for each text.

    ``first`` and ``second`` are the files of a byte-level tokenizer, which cuts a space and the
    text, and of a tokenizer of pieces, which puts the space there itself. n_a and n_b are the
    tokens, n_groups the groups between common ends, n_links the overlapping pairs of tokens,
    n_best those of them whose pair is as frequent as any of its second id in all texts,
    count_sum the sum of the counts of the links' pairs; groups_sha256 is of the written groups.

    A text that is null or empty, or that one of the tokenizers does not give back byte by
    byte, has no tokens: zeros and an empty string. Repeated rows count each. Whatever name a
    carried column has, one called alignment gives way. No rows give none.
    """
    paths = (first, second)
    carry = [c for c in carry if c != "alignment"]
    cut = cut_lineage(_cut(docs, carry, text, paths, size))
    same = vocabularies(*paths).same
    total = _vector(cut, len(same))
    counted = _pair_rows(cut, paths).withColumn("count", F.sum("n").over(Window.partitionBy("pair"))).drop("n")
    counted = cut_lineage(counted)
    # at most one row an id of either tokenizer comes to the driver
    for row in counted.where("same").groupBy("pair").agg(F.first("count").alias("count")).collect():
        total[row["pair"] >> 32] += row["count"]
    most = np.zeros(len(vocabularies(*paths).second.bytes), np.int64)
    np.maximum.at(most, same[same >= 0], total[same >= 0])
    of_second = F.col("pair").bitwiseAND(0xFFFFFFFF).alias("id")
    for row in counted.where("NOT same").groupBy(of_second).agg(F.max("count").alias("count")).collect():
        most[row["id"]] = max(most[row["id"]], row["count"])

    sums = f"{_DOC}, n_best long, count_sum long"
    kept = _schema(cut.schema["row"].dataType, f"block long, {sums}, pair_numbers binary, pair_times binary")

    def agreeing(batches):
        for batch in batches:
            found = []
            for ids, times in zip(batch.column("same_ids"), batch.column("same_times")):
                ids, times = _numbers(ids), _numbers(times)
                found.append((int(times[total[ids] == most[same[ids]]].sum()), int((times * total[ids]).sum())))
            best, count = (pa.array([f[k] for f in found], pa.int64()) for k in (0, 1))
            names = [f for f in batch.schema.names if f not in ("same_ids", "same_times", "pair_numbers", "pair_times")]
            columns = [batch.column(c) for c in names] + [best, count, batch.column("pair_numbers"), batch.column("pair_times")]
            yield pa.RecordBatch.from_arrays(columns, [*names, "n_best", "count_sum", "pair_numbers", "pair_times"])

    numbers = [f.split()[0] for f in _DOC.split(", ")]
    texts = cut.where("row IS NOT NULL").select("row", "block", *numbers, "same_ids", "same_times", "pair_numbers", "pair_times").mapInArrow(agreeing, kept)
    nothing = [F.lit(None).alias(c) for c in ("number", "pair", "count")]
    texts = texts.select("*", *nothing).unionByName(counted.select("block", "number", "pair", "count"), allowMissingColumns=True)
    # the pairs of a block come before its texts
    dealt = texts.repartition("block").sortWithinPartitions("block", F.asc_nulls_last("number"))
    out = _schema(cut.schema["row"].dataType, "alignment struct<" + sums.replace(" long", ": long").replace(" string", ": string") + ">")

    def others(batches):
        block, pairs, counts = None, [], []
        known = None
        for batch in batches:
            is_text = batch.column("number").is_null().to_numpy(zero_copy_only=False)
            blocks = batch.column("block").to_numpy()
            edges = [0, *(np.flatnonzero((blocks[1:] != blocks[:-1]) | (is_text[1:] != is_text[:-1])) + 1).tolist(), batch.num_rows]
            for a, z in zip(edges, edges[1:]):
                part = batch.slice(a, z - a)
                if blocks[a] != block:
                    block, pairs, counts, known = blocks[a], [], [], None
                if not is_text[a]:
                    pairs.append(part.column("pair").to_numpy())
                    counts.append(part.column("count").to_numpy())
                    continue
                if known is None:
                    pair, count = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (pairs, counts))
                    is_same = same[pair >> 32] == (pair & 0xFFFFFFFF)
                    count = np.where(is_same, total[pair >> 32], count)
                    known = count, count == most[pair & 0xFFFFFFFF]
                count, best = known
                more = []
                for ids, times in zip(part.column("pair_numbers"), part.column("pair_times")):
                    ids, times = _numbers(ids), _numbers(times)
                    more.append((int(times[best[ids]].sum()), int((times * count[ids]).sum())))
                fields = [part.column(c) for c in numbers]
                fields += [pa.array(part.column(c).to_numpy() + np.array([m[k] for m in more], np.int64)) for k, c in enumerate(("n_best", "count_sum"))]
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.StructArray.from_arrays(fields, [*numbers, "n_best", "count_sum"])], ["row", "alignment"])

    return dealt.mapInArrow(others, out).select(*[F.col("row").getField(c).alias(c) for c in carry], "alignment")
