"""Best-fit decreasing packing of token sequences.

Lengths are whole numbers up to the capacity, so the packing of any corpus follows from one bounded
histogram: how many pieces have each length. The plan is made from it, longest first: a segment tree
over remaining capacities finds the tightest open bin that still takes the piece, in logarithmic
time, and all bins with the same content are one entry with a count. That is best-fit decreasing to
the letter, because pieces of one length are interchangeable, at a cost that does not grow with the
corpus. Pieces are then numbered within their length, by writing block and by row in the block, and
look their place up in the plan; only block histograms are shuffled and joined, never texts.

Defined cases: a null text is empty and packs as its end mark alone. Repeated rows are packed once
each. A document longer than the capacity is cut; its first piece is the shorter one. The string of an
added token is that token wherever it stands. An empty table gives no sequences. Other columns do not
matter.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import blocks, map_rows, table
from tallyloom.llm.registry import query
from tallyloom.session import materialise

#: How byte-level vocabularies split text before the merges; a fixed value.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class SegmentTree:
    """Which remaining capacities have an open bin; finds the smallest that is large enough."""

    def __init__(self, capacity: int):
        self.size = 1
        while self.size <= capacity:
            self.size *= 2
        self.any = [False] * (2 * self.size)

    def set(self, room: int, there: bool) -> None:
        i = room + self.size
        self.any[i] = there
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def tightest(self, need: int) -> int | None:
        """Smallest room of at least ``need`` that some open bin has."""
        i = need + self.size
        if self.any[i]:
            return need
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                break
            i //= 2
        else:
            return None
        while i < self.size:
            i = 2 * i if self.any[2 * i] else 2 * i + 1
        return i - self.size


def best_fit_plan(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, from, bin, each, offset): pieces number ``from`` on of that length fill bins
    ``bin``, ``bin`` + 1, ..., ``each`` of them one after another from ``offset``.

    Sorted by length and ``from``; the number of rows depends on the lengths that occur, not on counts.
    """
    tree = SegmentTree(capacity)
    #: By remaining room: runs (first bin, count) of bins with the same content.
    open_bins: dict[int, list[tuple[int, int]]] = {}
    rows, bins = [], 0

    def put(room: int, first: int, count: int) -> None:
        if room > 0 and count > 0:
            open_bins.setdefault(room, []).append((first, count))
            tree.set(room, True)

    for length in sorted(histogram, reverse=True):
        left, at = histogram[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:  # as many new bins as the rest of this length fills
                per = capacity // length
                first, count = bins, -(-left // per)
                bins += count
                room = capacity
            else:
                first, count = open_bins[room].pop()
                if not open_bins[room]:
                    tree.set(room, False)
            per = room // length
            full = min(count, left // per)
            rows.append((length, at, first, per, capacity - room))
            if full:
                put(room - full_length(per, length), first, full)
                at += full * per
                left -= full * per
            if full < count and left:  # the last bin takes what is left
                put(room - left * length, first + full, 1)
                at += left
                left = 0
                full += 1
            put(room, first + full, count - full)
    rows.sort()
    return np.array(rows, np.int64).reshape(-1, 5)


def full_length(per: int, length: int) -> int:
    return per * length


def byte_ranks(vocabulary: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Tokens of a byte-level vocabulary file as bytes, with their ids, which are also their merge ranks;
    and its added tokens, which are found in a text before anything else.

    The file writes printable bytes as themselves and every other byte as the next code point from 256 on.
    """
    with open(vocabulary, encoding="utf-8") as f:
        content = json.load(f)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(other)}
    added = {t["content"]: t["id"] for t in content["added_tokens"]}
    if any(t.get(k) for t in content["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("only added tokens that are matched as they stand are known")
    return {bytes(byte_of[c] for c in t): i for t, i in content["model"]["vocab"].items() if t not in added}, added


class PieceReader:
    """Texts to pieces of at most ``capacity`` ids; the string of an added token gets that token's id."""

    def __init__(self, vocabulary: str, end_id: int, capacity: int):
        ranks, added = byte_ranks(vocabulary)
        self.encoding = tiktoken.Encoding("pieces", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens=added)
        self.end, self.capacity = int(end_id).to_bytes(4, "little"), capacity

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids with the end mark."""
        return [self.encoding.encode_to_numpy(t, allowed_special="all").astype("<u4").tobytes() + self.end for t in texts]

    def cut(self, ids: bytes) -> list[tuple[int, bytes]]:
        """(start, ids) of the pieces; the first takes what the full ones leave."""
        n, c = len(ids) // 4, self.capacity
        first = n % c or c
        return [(0, ids[: 4 * first]), *((s, ids[4 * s : 4 * (s + c)]) for s in range(first, n, c))]


@lru_cache(maxsize=2)
def piece_reader(vocabulary: str, end_id: int, capacity: int) -> PieceReader:
    return PieceReader(vocabulary, end_id, capacity)


def token_pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, block, nth): ``nth`` counts a block's pieces of one length.

    ``block`` names the try of the task that wrote the rows, so that rows of another try cannot share it.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        reader, block, seen = piece_reader(vocabulary, end_id, capacity), uuid.uuid4().int >> 65, [0] * (capacity + 1)
        for b in batches:
            for keys, texts in blocks(b["doc_id"], b["text"]):
                out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "block", "nth")}
                for key, ids in zip(keys, reader.ids(texts), strict=True):
                    for piece, (start, part) in enumerate(reader.cut(ids)):
                        n = len(part) // 4
                        for name, value in zip(out, (key, piece, start, n, zlib.crc32(part), block, seen[n]), strict=True):
                            out[name].append(value)
                        seen[n] += 1
                yield out

    return map_rows(
        docs.select("doc_id", "text"), run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, block long, nth long"
    )


def pack(docs: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = materialise(token_pieces(docs, vocabulary, end_id, capacity), "pieces")
    # a count per block and length, and where the block's pieces of that length begin
    counts = pieces.groupBy("block", "length").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = counts.select("block", "length", before.alias("begin"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    shared = docs.sparkSession.sparkContext.broadcast(best_fit_plan(histogram, capacity))
    names = ("doc_id", "piece", "start", "length", "ids_crc32")
    types = dict(pieces.dtypes)

    def place(batches: Iterator[dict]) -> Iterator[dict]:
        plan = shared.value
        key = plan[:, 0] << 40 | plan[:, 1]
        for b in batches:
            if not b["length"]:
                continue
            length, number = np.array(b["length"]), np.array(b["number"])
            row = plan[np.searchsorted(key, length << 40 | number, "right") - 1]
            nth = number - row[:, 1]
            yield {c: b[c] for c in names} | {"sequence_id": row[:, 2] + nth // row[:, 3], "offset": row[:, 4] + nth % row[:, 3] * length}

    numbered = pieces.join(begins, ["block", "length"]).select(*names, (F.col("begin") + F.col("nth")).alias("number"))
    ddl = ", ".join(f"{c} {types[c]}" for c in names) + ", sequence_id long, offset long"
    return map_rows(numbered, place, ddl)


@query("op8_packing")
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as vocabularies

    return pack(table(spark, sf_dir, "documents"), vocabularies.path("byte_bpe_50k.json"))
