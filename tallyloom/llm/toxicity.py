"""Toxicity: Levenshtein automata over a lexicon trie, and context-window scores.

The lexicon is learned from labelled rows: words and word beginnings that stand almost only in toxic
texts. It becomes a trie. The automaton that accepts every word within one edit of a term is the
intersection of the trie with the terms' Levenshtein automata; its states are made on demand and
remembered, so that a word walks it in a few dictionary look-ups and ordinary words die early.
A window around each hit tells abuse (further hits, second person) from quotation (quotation marks,
reporting verbs); quoted hits count for less. A logistic regression on these counts gives the score.

The training sample has at most ``MAX_LABELLED`` rows (smallest hash of the id); every document is
scored over its whole text. Training documents are scored as if their own text had not been counted
for the lexicon, so that terms with little support do not look better than they are.

Defined cases: a null or empty text has no hits and gets the score of a text without hits. Ids that
are null are never held out and never labelled. Several labels of one id count as toxic if one is;
equal texts count once. Without labelled rows of both classes every score is the share of toxic
labels (0 without any). Repeated rows are scored alike. Columns of the input keep their names; a
column called ``score`` is replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import map_rows, table
from tallyloom.llm.registry import query
from tallyloom.session import materialise

MAX_LABELLED = 8_000
MAX_TERMS = 4_000
THRESHOLD = 0.3
#: Least toxic texts and least share of toxic texts of a term.
SUPPORT, PRECISION = 2, 0.9
#: Lengths of word beginnings that can be terms.
BEGINNINGS = (4, 5, 6, 7)
#: Terms shorter than this match only exactly.
FUZZY_FROM = 5
WINDOW, QUOTED_WEIGHT = 8, 0.25
#: Words and automaton states that a task remembers.
MEMORY = 500_000

_EDGE = ".,;:!?\"'()[]{}<>«»„“”‚‘’…*_-–—/\\|"
_QUOTES = "\"«»„“”‟"
#: Look-alikes inside a word.
_LOOKS = str.maketrans("01345@$!", "oieasasi")
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_REPORTING = frozenset("said says say wrote writes called calls quote quoted quotes term word dit écrit sagte schrieb dijo escribió".split())
_SECOND_PERSON = frozenset("you your you're u ur yourself du dich dir dein ihr euch tu te toi ton vous votre tú tus usted eres".split())


def plain(token: str) -> str:
    """A lower-case token as letters: marks at the edge go, look-alikes are read as letters."""
    t = token.strip(_EDGE)
    if t.isalpha():
        return t
    t = t.translate(_LOOKS) if any(c.isalpha() for c in t) else ""
    return _NOT_LETTERS.sub("", t)


@dataclass
class Term:
    text: str
    beginning: bool
    #: 2: beyond chance among all terms; 1: enough support; by what is left out: nothing, a toxic, a clean text.
    tiers: tuple[int, int, int]
    weight: float


@dataclass
class Lexicon:
    """Terms, and the automaton of their trie."""

    terms: list[Term] = field(default_factory=list)

    def __post_init__(self):
        self.children: list[dict[str, int]] = [{}]
        self.word_at: list[int] = [-1]
        self.beginning_at: list[int] = [-1]
        for n, t in enumerate(self.terms):
            at = 0
            for c in t.text:
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.word_at.append(-1)
                    self.beginning_at.append(-1)
                at = self.children[at][c]
            (self.beginning_at if t.beginning else self.word_at)[at] = n
        self.forget()

    def forget(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.ends: list[tuple[int, int] | None] = []
        self.begins: list[int] = []
        self.words: dict[str, tuple[int, int] | None] = {}
        self.start = self._state({(0, 0)})

    def _state(self, found: set[tuple[int, int]]) -> int:
        """Number of the state, with what a missing letter adds; -1 if it is dead."""
        full = set(found)
        full.update((c, 1) for n, e in found if e == 0 for c in self.children[n].values())
        full -= {(n, 1) for n, e in full if e == 0}
        if not full:
            return -1
        key = frozenset(full)
        if (known := self.ids.get(key)) is not None:
            return known
        self.ids[key] = at = len(self.sets)
        self.sets.append(key)
        self.steps.append({})
        best = None
        begins = -1
        for n, e in key:
            t = self.word_at[n]
            if t >= 0 and (e == 0 or len(self.terms[t].text) >= FUZZY_FROM):
                best = min(best or (9, 0.0, 0), (e, -self.terms[t].weight, t))
            if e == 0 and self.beginning_at[n] >= 0:
                begins = self.beginning_at[n]
        self.ends.append((best[2], best[0]) if best else None)
        self.begins.append(begins)
        return at

    def _step(self, state: int, c: str) -> int:
        out = set()
        for n, e in self.sets[state]:
            below = self.children[n]
            if c in below:
                out.add((below[c], e))
            if e == 0:
                out.add((n, 1))  # a letter too many
                out.update((x, 1) for x in below.values())  # another letter
        self.steps[state][c] = to = self._state(out)
        return to

    def match(self, word: str) -> tuple[int, int] | None:
        """(term, kind) of a word: kind 0 exact, 1 one edit away, 2 begins like the term."""
        state, begins = self.start, -1
        for c in word:
            to = self.steps[state].get(c)
            if to is None:
                to = self._step(state, c)
            if to < 0:
                return (begins, 2) if begins >= 0 else None
            state = to
            if self.begins[state] >= 0:
                begins = self.begins[state]
        end = self.ends[state]
        if end is not None and end[1] == 0:
            return end
        return (begins, 2) if begins >= 0 else end

    def hits(self, tokens: list[str]) -> list[tuple[int, tuple[int, int]]]:
        """(position, match) of the tokens that match."""
        if len(self.words) > MEMORY or len(self.sets) > MEMORY:
            self.forget()
        words = self.words
        for t in set(tokens).difference(words):
            w = plain(t)
            words[t] = self.match(w) if len(w) > 2 else None
        return [(i, m) for i, t in enumerate(tokens) if (m := words[t]) is not None]


FEATURES = 14


def features(text: str | None, lexicon: Lexicon, left_out: int = 0) -> list[float]:
    """Counts of one text; ``left_out`` 1 or 2 takes a toxic or a clean text out of each term's support."""
    tokens = (text or "").lower().split()
    hits = lexicon.hits(tokens) if lexicon.terms else []
    counts, terms, near, person, quoted, heaviest = [0.0] * 6, set(), 0, 0, 0, 0.0
    kept = []
    for i, (t, kind) in hits:
        tier = lexicon.terms[t].tiers[left_out]
        if tier:
            kept.append((i, t, kind, tier))
    for n, (i, t, kind, tier) in enumerate(kept):
        before, behind = tokens[max(0, i - WINDOW) : i + 1], tokens[i : i + WINDOW + 1]
        opened = any(w[0] in _QUOTES for w in before)
        closed = any(w.rstrip(".,;:!?")[-1:] in _QUOTES and w.rstrip(".,;:!?") for w in behind)
        in_quotes = (opened and closed) or (opened or closed) and any(plain(w) in _REPORTING for w in before + behind)
        neighbour = (n > 0 and i - kept[n - 1][0] <= WINDOW) or (n + 1 < len(kept) and kept[n + 1][0] - i <= WINDOW)
        near += neighbour
        person += any(plain(w) in _SECOND_PERSON for w in before + behind)
        quoted += in_quotes
        counts[2 * kind + (tier == 1)] += QUOTED_WEIGHT if in_quotes else 1.0
        terms.add(t)
        heaviest = max(heaviest, lexicon.terms[t].weight * (QUOTED_WEIGHT if in_quotes else 1.0))
    strong = counts[0] + counts[2] + counts[4]
    return [
        *(math.log1p(c) for c in counts), min(10.0, 100.0 * strong / max(1, len(tokens))), heaviest, math.log1p(len(terms)),
        math.log1p(near), math.log1p(person), quoted / max(1, len(kept)), float(strong >= 1), math.log1p(sum(counts)),
    ]


@dataclass
class ToxicModel:
    lexicon: Lexicon
    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        z = float(np.dot(self.weights, features(text, self.lexicon)) + self.bias)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> tuple[np.ndarray, float]:
    """Newton's method with a ridge on all weights but the bias."""
    design = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(design.shape[1])
    keep = np.r_[np.full(x.shape[1], ridge), 1e-3]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gap = design.T @ (p - y) + keep * w
        move = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + np.diag(keep), gap)
        w -= move
        if np.abs(move).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def fold(doc_id) -> F.Column:
    """crc32 of the id as text, modulo 4; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def _divergence(k: int, n: int, base: float) -> float:
    """n times the divergence of a share k/n from the base rate."""
    p, out = k / n, 0.0
    if p > 0:
        out += k * math.log(p / base)
    if p < 1:
        out += (n - k) * math.log((1 - p) / (1 - base))
    return out


def _tier(k: int, c: int, base: float, tested: int) -> int:
    n = k + c
    if k < SUPPORT or k < PRECISION * n:
        return 0
    return 2 if _divergence(k, n, base) > math.log(max(2, tested)) + 3 else 1


def _term_counts(batches: Iterator[dict]) -> Iterator[dict]:
    """Texts with each word and beginning, summed in the task; ``*`` marks a beginning."""
    toxic: dict[str, int] = {}
    every: dict[str, int] = {}

    def out() -> dict:
        return {"term": list(every), "toxic": [toxic.get(t, 0) for t in every], "n": list(every.values())}

    for b in batches:
        for text, y in zip(b["text"], b["toxic"], strict=True):
            words = {w for w in map(plain, set((text or "").lower().split())) if 2 < len(w) <= 40}
            found = words | {f"{w[:k]}*" for w in words for k in BEGINNINGS if len(w) > k}
            for t in found:
                every[t] = every.get(t, 0) + 1
                if y:
                    toxic[t] = toxic.get(t, 0) + 1
            if len(every) > MEMORY:
                yield out()
                toxic.clear()
                every.clear()
    yield out()


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_LABELLED, max_terms: int = MAX_TERMS) -> ToxicModel:
    """Learn from labelled rows that are not held out."""
    sample = labels.where("toxic IS NOT NULL").where(fold(F.col("doc_id")) != 2)
    sample = sample.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # at most `max_rows` pairs of numbers are sent to the executors, and as many texts come together
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy(F.coalesce("text", F.lit("")).alias("text"))
    texts = materialise(texts.agg(F.max("toxic").alias("toxic")), "labelled")
    total = texts.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("k")).first()
    n, k = int(total["n"]), int(total["k"])
    if k == 0 or k == n:
        return ToxicModel(Lexicon(), np.zeros(FEATURES), 30.0 if k else -30.0)
    base = k / n
    counted = map_rows(texts, _term_counts, "term string, toxic long, n long").groupBy("term")
    counted = materialise(counted.agg(F.sum("toxic").alias("k"), F.sum("n").alias("n")), "terms")
    tested = counted.count()
    share = F.col("k") / F.col("n")
    rest = F.when(F.col("k") < F.col("n"), (F.col("n") - F.col("k")) * F.log((1 - share) / (1 - base))).otherwise(F.lit(0.0))
    best = counted.where((F.col("k") >= SUPPORT) & (share >= PRECISION)).withColumn("gain", F.col("k") * F.log(share / base) + rest)
    terms = []
    for r in best.orderBy(F.desc("gain"), "term").limit(max_terms).collect():
        good, bad = int(r["k"]), int(r["n"] - r["k"])
        tiers = tuple(_tier(max(0, a), max(0, b), base, tested) for a, b in ((good, bad), (good - 1, bad), (good, bad - 1)))
        text = r["term"].rstrip("*")
        terms.append(Term(text, r["term"].endswith("*"), tiers, min(3.0, math.log((good + 0.5) / (bad + 0.5) * (1 - base) / base) / 3)))
    lexicon = Lexicon(terms)
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def examples(batches: Iterator[dict]) -> Iterator[dict]:
        own = Lexicon(shared.value)
        for b in batches:
            x = [features(t, own, 1 if y else 2) for t, y in zip(b["text"], b["toxic"], strict=True)]
            yield {"x": x, "y": b["toxic"]}

    rows = map_rows(texts, examples, "x array<double>, y int").collect()  # at most `max_rows`
    rows.sort(key=lambda r: (r["y"], r["x"]))
    return ToxicModel(lexicon, *fit_logistic(np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows], float)))


def score_documents(docs: DataFrame, model: ToxicModel, text: str = "text") -> DataFrame:
    """``docs`` with a column ``score``, 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast((model.lexicon.terms, model.weights, model.bias))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        terms, weights, bias = shared.value
        own = ToxicModel(Lexicon(terms), weights, bias)
        for texts in batches:
            yield pd.Series([own.score(t) for t in texts], dtype="float64")

    return docs.withColumn("score", score(text))


def drop_toxic(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """The rows of ``docs`` below the threshold, with all their own columns."""
    rows = docs.select(F.struct("*").alias("_row"), "text")
    return score_documents(rows, model).where(F.col("score") < THRESHOLD).select("_row.*")


@query("op7_toxicity")
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    out = score_documents(docs, model)
    held = F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
