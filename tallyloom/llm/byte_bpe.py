"""Byte-level BPE by corpus-level merge replay.

A task reads its share of the corpus block by block. The distinct pre-tokens of a block form one flat
array of byte tokens; an inverted index leads from each pair's rank to the positions where the pair
stands, and the merges are replayed over all words at once in rank order. A merge touches only its
two neighbours: their new pairs are filed in the index. Nothing is shuffled, and a task holds one
block, its words and a bounded cache of encoded chunks.

Defined cases: a null text is empty and has no ids; special tokens are ordinary text; repeated rows
are encoded alike; a text or a word may be of any length; other columns do not matter.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import heapq
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import blocks, map_rows, table
from tallyloom.llm.registry import query

#: Unicode white space, in the sense of ``\s`` in the pattern.
SPACE = "\t-\r \u0085   -     　"
#: A run without white space with the space before it, or white space. Every pre-token lies in one chunk.
CHUNK = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: Chunks that a task remembers.
CACHE = 500_000
#: Words whose merges are replayed together; so many that their arrays stay in the processor's cache.
SLICE = 2_500


def split_pattern(pattern: str) -> regex.Pattern:
    """The pattern with its white space spelled out."""
    return regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]"))


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def split_plain(chunk: str) -> list[str]:
    """Pre-tokens of a chunk of letters with at most one mark behind them; empty for any other chunk."""
    letters = chunk[1:] if chunk[0] == " " else chunk
    if letters.isalpha():
        return [chunk]
    if letters[:-1].isalpha() and letters[-1] in ".,;:!?":
        return [chunk[:-1], chunk[-1]]
    return []


class MergeReplay:
    """Replays ranked merges over many words."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.width = max(ranks.values()) + 1
        self.vocabulary = [b""] * self.width
        #: By left token: right token to rank.
        self.pairs: list[dict[int, int]] = [{} for _ in range(self.width)]
        for token, rank in ranks.items():
            self.vocabulary[rank] = token
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    self.pairs[left][right] = rank
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.first = np.full((256, 256), -1, np.int64)
        for a in range(256):
            for b in range(256):
                self.first[a, b] = ranks.get(bytes([a, b]), -1)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        rest = []
        for k, w in enumerate(words):
            if (whole := self.ranks.get(w)) is not None:
                out[k] = whole.to_bytes(4, "little")
            elif w:
                rest.append(k)
        collecting = gc.isenabled()
        gc.disable()  # the index is many small lists without cycles
        try:
            for at in range(0, len(rest), SLICE):
                part = rest[at : at + SLICE]
                starts = np.cumsum([0, *(len(words[k]) for k in part)])
                ids, kept = self._replay(np.frombuffer(b"".join(words[k] for k in part), np.uint8), starts)
                ends = (np.concatenate([[0], np.cumsum(kept)])[starts] * 4).tolist()
                flat = ids.astype("<u4").tobytes()
                for n, k in enumerate(part):
                    out[k] = flat[ends[n] : ends[n + 1]]
        finally:
            if collecting:
                gc.enable()
        return out

    def _replay(self, raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids that remain of the flat array, and which positions remain."""
        n, pairs, push = len(raw), self.pairs, heapq.heappush
        tokens = self.bytes[raw].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        first = np.full(n, -1, np.int64)
        first[:-1] = self.first[raw[:-1], raw[1:]]
        first[starts[1:] - 1] = -1
        for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            before[s] = after[e - 1] = -1
        at = np.flatnonzero(first >= 0)
        order = at[np.argsort(first[at], kind="stable")]
        found, cuts = np.unique(first[order], return_index=True)
        ends = [*cuts.tolist(), len(order)]
        flat = order.tolist()
        index = {r: flat[ends[k] : ends[k + 1]] for k, r in enumerate(found.tolist())}
        queue = found.tolist()  # sorted, so already a heap
        rank = first.tolist()  # of the pair that begins at a position, -1 without one
        word_of = starts.tolist()
        while queue:
            r = heapq.heappop(queue)
            places = index.pop(r)
            places.sort()
            waiting: set[int] = set()  # words in which a lower rank has come up
            for i in places:
                if rank[i] != r:
                    continue
                if waiting and bisect_right(word_of, i) in waiting:
                    if r in index:
                        index[r].append(i)
                    else:
                        index[r] = [i]
                        push(queue, r)
                    continue
                j = after[i]
                k = after[i] = after[j]
                h = before[i]
                tokens[i] = r
                tokens[j] = rank[j] = rank[i] = -1
                if k >= 0:
                    before[k] = i
                    new = pairs[r].get(tokens[k])
                    if new is not None:
                        rank[i] = new
                        if new in index:
                            index[new].append(i)
                        else:
                            index[new] = [i]
                            push(queue, new)
                        if new < r:
                            waiting.add(bisect_right(word_of, i))
                if h >= 0:
                    new = pairs[tokens[h]].get(r)
                    if new is None:
                        rank[h] = -1
                    else:
                        rank[h] = new
                        if new in index:
                            index[new].append(h)
                        else:
                            index[new] = [h]
                            push(queue, new)
                        if new < r:
                            waiting.add(bisect_right(word_of, i))
        left = np.array(tokens, np.int64)
        kept = left >= 0
        return left[kept], kept


class Codec:
    """Texts to ids and back, with a bounded memory of chunks."""

    def __init__(self, path: str, pattern: str):
        self.replay = MergeReplay(load_ranks(path))
        self.pattern = split_pattern(pattern)
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        if len(self.known) > CACHE:
            self.known.clear()
        chunks = [CHUNK.findall(t) for t in texts]
        known = self.known
        new = list(set().union(*chunks).difference(known))
        parts = [split_plain(c) or self.pattern.findall(c) for c in new]
        words = list({w for p in parts for w in p})
        ids = dict(zip(words, self.replay.encode([w.encode() for w in words]), strict=True))
        for c, p in zip(new, parts, strict=True):
            known[c] = b"".join([ids[w] for w in p])
        return [b"".join([known[c] for c in x]) for x in chunks]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.replay.vocabulary.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One per worker process."""
    return Codec(path, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>, n_tokens) of every document."""
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        c = codec(path, pattern)
        for b in batches:
            for keys, texts in blocks(b["key"], b["text"]):
                ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in c.encode(texts)]
                yield {"key": keys, "ids": ids, "n_tokens": [len(x) for x in ids]}

    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return map_rows(source, run, f"key {kind}, ids array<int>, n_tokens long").withColumnRenamed("key", key)


def decode_documents(encoded: DataFrame, path: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """(key, text) from (key, ids); ids that are not UTF-8 together decode with replacement marks."""
    kind = dict(encoded.dtypes)[key]

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        c = codec(path, pattern)
        for b in batches:
            raw = [c.decode(np.array(x or [], "<u4").tobytes()) for x in b["ids"]]
            yield {"key": b["key"], "text": [x.decode("utf-8", "replace") for x in raw]}

    return map_rows(encoded.select(F.col(key).alias("key"), "ids"), run, f"key {kind}, text string").withColumnRenamed("key", key)


def digest_round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode and decode in one pass; (doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        c = codec(path, pattern)
        for b in batches:
            for keys, texts in blocks(b["doc_id"], b["text"]):
                ids = c.encode(texts)
                yield {
                    "doc_id": keys,
                    "n_tokens": [len(x) // 4 for x in ids],
                    "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
                    "decoded_sha256": [hashlib.sha256(c.decode(x)).hexdigest() for x in ids],
                }

    return map_rows(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


@query("op2_byte_bpe")
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as vocabularies

    docs = table(spark, sf_dir, "documents")
    return digest_round_trip(docs, vocabularies.path("byte_bpe_multi_50k.tiktoken"), vocabularies.PATTERN)
