"""Language identification with hyperdimensional profiles.

Every letter has a random vector of ``DIMENSIONS`` entries +1 or -1, drawn from its code point alone. An n-gram's vector
binds those of its letters: the k-th is rotated by k places and all are multiplied. A text's vector bundles (adds)
the vectors of its n-grams, a language's prototype those of its training texts, each at unit length. A text gets the language
whose prototype has the greatest cosine with its vector. Every run of other characters is one space, and the text has a
space at both ends, so that beginnings and endings of words count.

The learning sample is bounded: about ``MAX_ROWS`` documents, drawn by a hash of the id, with one quota for every
language (of more than ``MAX_ROWS`` languages, the most frequent). Languages are counted first, so that drawing is a
filter where the rows lie. What comes together are the sums of vectors by language. Predicting is one pass without
a shuffle over whole texts, in blocks of about two million characters; the distinct n-grams of a block are bound once.

Defined cases: ``und`` with score 0 for a null text, a text without letters, and where nothing was learned.
Letters are what Unicode calls letters, after lower-casing. Languages with one cosine: the name that sorts first. A null
id counts as empty text, so it is held out. Documents that repeat an id learn once, from the least text. An empty
table gives an empty result. Other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import blocks, map_rows, table
from tallyloom.llm.registry import query
from tallyloom.session import small_table

DIMENSIONS, N = 1024, 3
#: Documents that prototypes are learned from, as the hash draws them.
MAX_ROWS = 8_000
FOLDS = 5
UNKNOWN = "und"
#: Code points below 2^21.
SHIFT = 21


@dataclass
class Letters:
    """Letter vectors, each with its rotations, made when a letter is first seen."""

    rows: dict[int, int] = field(default_factory=dict)
    vectors: list[np.ndarray] = field(default_factory=lambda: [np.empty((0, DIMENSIONS), np.int8)] * N)

    def _add(self, points: list[int]) -> None:
        new = np.stack([np.random.Generator(np.random.Philox(key=p)).integers(0, 2, DIMENSIONS, np.int8) * 2 - 1 for p in points])
        self.rows.update(zip(points, range(len(self.rows), len(self.rows) + len(points)), strict=True))
        self.vectors = [np.concatenate([v, np.roll(new, N - 1 - k, axis=1)]) for k, v in enumerate(self.vectors)]

    def bind(self, grams: np.ndarray) -> np.ndarray:
        """Vectors of n-grams, which are rows of code points."""
        points, where = np.unique(grams, return_inverse=True)
        if new := [p for p in points.tolist() if p not in self.rows]:
            self._add(new)
        at = np.array([self.rows[p] for p in points.tolist()])[where.reshape(grams.shape)]
        out = self.vectors[0][at[:, 0]]
        for k in range(1, N):
            out = out * self.vectors[k][at[:, k]]
        return out



def spaced(text: str) -> np.ndarray:
    """Code points of the lower-cased text with every run of other characters, and both ends, as one space; empty without a letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    kinds, where = np.unique(points, return_inverse=True)
    is_letter = np.array([chr(p).isalpha() for p in kinds.tolist()], bool)
    letter = is_letter[where]
    if not letter.any():
        return np.empty(0, np.int64)
    keep = letter | np.concatenate([[True], letter[:-1]])
    out = np.where(letter, points, 32)[keep]
    out = out if out[0] == 32 else np.concatenate([[32], out])
    return out if out[-1] == 32 else np.concatenate([out, [32]])


def bundle(texts: list[str], letters: Letters) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of the texts that have a letter, at unit length, and their places."""
    places, codes, counts = [], [], []
    for i, t in enumerate(texts):
        s = spaced(t)
        if len(s):
            code = s[: len(s) - N + 1].copy()
            for k in range(1, N):
                code = code << SHIFT | s[k : len(s) - N + 1 + k]
            own, n = np.unique(code, return_counts=True)
            places.append(i)
            codes.append(own)
            counts.append(n)
    if not places:
        return np.empty((0, DIMENSIONS), np.float32), np.empty(0, np.int64)
    every, where = np.unique(np.concatenate(codes), return_inverse=True)
    grams = np.stack([every >> SHIFT * (N - 1 - k) & (1 << SHIFT) - 1 for k in range(N)], axis=1)
    bound = letters.bind(grams).astype(np.float32)
    out, at = np.empty((len(places), DIMENSIONS), np.float32), 0
    for i, n in enumerate(counts):
        rows = where[at : at + len(n)]
        at += len(n)
        out[i] = n.astype(np.float32) @ bound[rows]
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(length > 0, length, 1), np.array(places)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo ``FOLDS``; 0 is held out, and so is a null id."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def _shares(counts: list[tuple[str, int]], rows: int) -> list[tuple[str, float]]:
    """Share of each language's documents, so that all have one quota and together ``rows``; rarer languages go whole."""
    left, out = rows, []
    for k, (lang, n) in enumerate(sorted(counts, key=lambda c: (c[1], c[0]))):
        take = min(n, left / (len(counts) - k))
        left -= take
        out.append((lang, take / n))
    return out


def learn(docs: DataFrame, max_rows: int = MAX_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages in order, and their prototypes at unit length; from rows that are not held out and have a text and a language."""
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL").where(fold(F.col("doc_id")) != 0).select("doc_id", "lang", "text")
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_rows)
    shares = small_table(docs.sparkSession, _shares([(r["lang"], r["n"]) for r in counts.collect()], max_rows), "lang string, share double")
    # at most `max_rows` names and shares
    drawn = rows.join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < F.col("share") * (1 << 40))
    texts = drawn.groupBy("doc_id", "lang").agg(F.min("text").alias("text"))

    def vectors(batches: Iterator[dict]) -> Iterator[dict]:
        letters = Letters()
        for b in batches:
            at = 0
            for langs, part in blocks(b["lang"], b["text"]):
                found, places = bundle(part, letters)
                at += len(part)
                named = np.array(langs, object)[places]
                own = sorted(set(named))
                yield {"lang": own, "vector": [found[named == x].sum(axis=0).tolist() for x in own]}

    total: dict[str, np.ndarray] = {}
    # a language has at most one vector in each block of the sample
    for r in map_rows(texts, vectors, "lang string, vector array<float>").toLocalIterator():
        total[r["lang"]] = total.get(r["lang"], 0) + np.array(r["vector"])
    names = sorted(total)
    found = np.array([total[x] for x in names], np.float32).reshape(len(names), DIMENSIONS)
    length = np.linalg.norm(found, axis=1, keepdims=True)
    return names, found / np.where(length > 0, length, 1)


def predict(docs: DataFrame, names: list[str], prototypes: np.ndarray) -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    kind = dict(docs.dtypes)["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast((names, prototypes))

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        own, profiles = shared.value
        letters = Letters()
        for b in batches:
            for ids, texts in blocks(b["doc_id"], b["text"]):
                langs, scores = [UNKNOWN] * len(ids), np.zeros(len(ids))
                found, places = bundle(texts, letters)
                if own and len(places):
                    cosines = found @ profiles.T
                    best = cosines.argmax(axis=1)
                    scores[places] = np.clip(cosines[np.arange(len(best)), best], 0, 1)
                    for i, k in zip(places.tolist(), best.tolist(), strict=True):
                        langs[i] = own[k]
                yield {"doc_id": ids, "lang_pred": langs, "score": scores}

    return map_rows(docs.select("doc_id", "text"), run, f"doc_id {kind}, lang_pred string, score double")


@query("op12_language_id")
def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = predict(docs, *learn(docs))
    return found.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score")
