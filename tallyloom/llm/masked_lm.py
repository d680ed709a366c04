"""LM scoring by masked pseudo-likelihood with a small bidirectional window network.

A word is predicted from its neighbours on both sides while it is hidden itself: a network reads the
class of the left and of the right neighbour (two embeddings, one tanh layer) and gives the
distribution of the hidden word's class; the class gives the word by its share of the class. The sum
of the conditional log-probabilities over all words of a document is its score.

The most frequent words are classes of their own, all others fall into classes by their ending. The
network therefore needs only one bounded table to learn from every token of the corpus: how often each
class stood between each two classes (at most ``CLASSES`` cubed rows, whatever the corpus). Spark sums it,
and the word counts, over all documents; numpy trains on the sums, in full batches, so the model
does not depend on how rows are partitioned beyond rounding. A trained model is a table of the same
size, which the scoring pass looks up.

Defined cases: a null or wordless text has no words, a log-likelihood of 0 and a null mean. Words are
what white space separates, lower-cased. Repeated rows count as often as they occur and score alike.
An empty table trains nothing and gives an empty result. Other columns do not matter.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import blocks, map_rows, table
from tallyloom.llm.registry import query
from tallyloom.session import materialise

#: Class 0 is the edge of a text, then come the ``OWN`` most frequent words, then the endings.
CLASSES, OWN = 128, 63
ENDINGS = CLASSES - OWN - 1
#: Words with a probability of their own; all others share what is left of their class.
VOCABULARY = 20_000
MEMORY = 400_000


def ending_class(word: str) -> int:
    return OWN + 1 + zlib.crc32(word[-2:].encode()) % ENDINGS


def ending_class_column(word) -> F.Column:
    return (F.crc32(F.substring(word, -2, 2).cast("binary")) % ENDINGS + OWN + 1).cast("int")


@dataclass
class Words:
    """Classes of words, and log-probabilities within the class."""

    known: dict[str, tuple[int, float]]
    #: Log-probability of one unknown word, by class.
    rest: np.ndarray

    def __post_init__(self):
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.classes: list[int] = []
        self.logs: list[float] = []

    def look_up(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Class and log-probability within the class of each word."""
        if len(self.place) > MEMORY:
            self.forget()
        place = self.place
        for w in set(words).difference(place):
            c, p = self.known.get(w) or ((k := ending_class(w)), float(self.rest[k]))
            place[w] = len(self.classes)
            self.classes.append(c)
            self.logs.append(p)
        at = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
        return np.array(self.classes, np.int64)[at], np.array(self.logs)[at]


def split_words(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """All words, and how many each text has."""
    each = [t.lower().split() for t in texts]
    return [w for x in each for w in x], np.array([len(x) for x in each], np.int64)


def with_edges(classes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes with an edge before, between and after texts, and where the words are."""
    at = np.arange(len(classes)) + 1 + np.repeat(np.arange(len(sizes)), sizes)
    out = np.zeros(len(classes) + len(sizes) + 1, np.int64)
    out[at] = classes
    return out, at


def _word_counts(batches: Iterator[dict]) -> Iterator[dict]:
    """Word counts of the task, in bounded portions."""
    seen: Counter[str] = Counter()
    for b in batches:
        for _, texts in blocks(b["text"], b["text"]):
            for t in texts:
                seen.update(t.lower().split())
            if len(seen) > MEMORY:
                yield {"word": list(seen), "n": list(seen.values())}
                seen.clear()
    yield {"word": list(seen), "n": list(seen.values())}


def count_words(docs: DataFrame) -> DataFrame:
    return map_rows(docs.select("text"), _word_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def learn_words(counts: DataFrame) -> Words:
    """The vocabulary, and the totals of each class; both bounded."""
    top = [(r["word"], int(r["n"])) for r in counts.orderBy(F.desc("n"), "word").limit(VOCABULARY).collect()]
    tokens, types = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in counts.groupBy(ending_class_column(F.col("word")).alias("c")).agg(F.sum("n").alias("n"), F.count("*").alias("types")).collect():
        tokens[r["c"]], types[r["c"]] = r["n"], r["types"]
    for w, n in top[:OWN]:  # these leave the class of their ending
        c = ending_class(w)
        tokens[c] -= n
        types[c] -= 1
    total = tokens.copy()
    known = {w: (k + 1, 0.0) for k, (w, _) in enumerate(top[:OWN])}
    for w, n in top[OWN:]:
        c = ending_class(w)
        known[w] = (c, float(np.log(n / total[c])))
        tokens[c] -= n
        types[c] -= 1
    # an unknown word of a class without unknown words is as rare as one more token
    share = np.where(tokens > 0, tokens / np.maximum(total, 1), 1 / (total + 1))
    return Words(known, np.log(share / np.maximum(types, 1)))


def count_windows(docs: DataFrame, words: Words) -> DataFrame:
    """(window, n): how often each (left, middle, right) of classes stands in the corpus."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        own, total = shared.value, np.zeros(CLASSES**3, np.int64)
        for b in batches:
            for _, texts in blocks(b["text"], b["text"]):
                flat, sizes = split_words(texts)
                seq, at = with_edges(own.look_up(flat)[0], sizes)
                total += np.bincount((seq[at - 1] * CLASSES + seq[at]) * CLASSES + seq[at + 1], minlength=CLASSES**3)
        found = np.flatnonzero(total)
        for k in range(0, len(found), 100_000):
            part = found[k : k + 100_000]
            yield {"window": part.astype(np.int32), "n": total[part]}

    return map_rows(docs.select("text"), run, "window int, n long").groupBy("window").agg(F.sum("n").alias("n"))


@dataclass
class Network:
    """softmax(tanh(left[l] + right[r] + hidden) @ out + bias)."""

    left: np.ndarray
    right: np.ndarray
    hidden: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    def log_probabilities(self, l: np.ndarray, r: np.ndarray) -> np.ndarray:  # noqa: E741
        z = np.tanh(self.left[l] + self.right[r] + self.hidden) @ self.out + self.bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def table(self) -> np.ndarray:
        """Log-probability by (left, middle, right), flat."""
        out = np.empty((CLASSES, CLASSES, CLASSES), np.float32)
        everyone = np.arange(CLASSES)
        for l in range(CLASSES):  # noqa: E741
            out[l] = self.log_probabilities(np.full(CLASSES, l), everyone).T
        return out.reshape(-1)


def train_network(windows: np.ndarray, n: np.ndarray, width: int = 32, steps: int = 80, rate: float = 0.03, seed: int = 7) -> Network:
    """Full-batch Adam on the summed windows; each pair of neighbours is one row, weighted by its counts."""
    rng = np.random.default_rng(seed)
    outer = windows // CLASSES**2 * CLASSES + windows % CLASSES
    context, row = np.unique(outer, return_inverse=True)
    counts = np.zeros((len(context), CLASSES), np.float32)
    np.add.at(counts, (row, windows // CLASSES % CLASSES), n)
    total = max(1.0, float(n.sum()))
    counts /= total
    l, r, weight = context // CLASSES, context % CLASSES, counts.sum(axis=1, keepdims=True)  # noqa: E741
    net = Network(
        *(rng.normal(0, 0.1, (CLASSES, width)).astype(np.float32) for _ in range(2)), np.zeros(width, np.float32),
        rng.normal(0, 0.1, (width, CLASSES)).astype(np.float32), np.log(counts.sum(axis=0) + 1e-7).astype(np.float32),
    )
    parts = [net.left, net.right, net.hidden, net.out, net.bias]
    first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    sides = [np.eye(CLASSES, dtype=np.float32)[x] for x in (l, r)]
    for step in range(1, steps + 1):
        h = np.tanh(net.left[l] + net.right[r] + net.hidden)
        z = h @ net.out + net.bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        gap = weight * z / z.sum(axis=1, keepdims=True) - counts
        back = (gap @ net.out.T) * (1 - h * h)
        grads = [sides[0].T @ back, sides[1].T @ back, back.sum(axis=0), h.T @ gap, gap.sum(axis=0)]
        now = rate * min(1.0, 3 * (1 - step / (steps + 1)))
        for p, g, a, b in zip(parts, grads, first, second, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= now * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-9)
    return net


@dataclass
class MaskedModel:
    words: Words
    network: Network

    def score(self, texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(words, log-likelihood) of each text; ``table`` is the network's."""
        flat, sizes = split_words(texts)
        classes, inside = self.words.look_up(flat)
        seq, at = with_edges(classes, sizes)
        logs = table[(seq[at - 1] * CLASSES + seq[at]) * CLASSES + seq[at + 1]].astype(np.float64) + inside
        ends = np.cumsum(sizes)
        return sizes, np.array([logs[e - s : e].sum() for s, e in zip(sizes, ends, strict=True)], np.float64)


def train(docs: DataFrame) -> MaskedModel:
    words = learn_words(materialise(count_words(docs), "words"))
    found = count_windows(docs, words).toArrow()  # at most CLASSES cubed rows
    order = np.argsort(found["window"].to_numpy(), kind="stable")
    return MaskedModel(words, train_network(found["window"].to_numpy()[order].astype(np.int64), found["n"].to_numpy()[order]))


def score_documents(docs: DataFrame, model: MaskedModel) -> DataFrame:
    """(doc_id, n_words, log_likelihood, mean_log_likelihood) of every row."""
    kind = dict(docs.dtypes)["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast((model, model.network.table()))

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        own, logs = shared.value
        for b in batches:
            for keys, texts in blocks(b["doc_id"], b["text"]):
                sizes, scores = own.score(texts, logs)
                yield {"doc_id": keys, "n_words": sizes, "log_likelihood": scores}

    out = map_rows(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_words long, log_likelihood double")
    return out.withColumn("mean_log_likelihood", F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words")))


@query("op5_masked_lm")
def op5_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_documents(docs, train(docs))
