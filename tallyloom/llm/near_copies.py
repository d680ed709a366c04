"""Near copies for the pipeline: documents whose five-word shingle sets have a Jaccard similarity of 0.8 or more.

SimHash says which texts may be alike: each text has four fingerprints of its five-word shingles, and those that
share a segment up to one left-out bit and differ in at most ten bits link (``simhash.link_fingerprints``). By this
meet 92, 98, 99.8 and 100 % of check_s's pairs of different texts at 0.80-0.85, to 0.90, to 0.95 and above. Such
a radius cannot hold every pair at 0.8, so bands of a MinHash signature add the pairs beyond it: one at exactly 0.8
shares none of the 32 bands of four values with probability 5e-8. Texts that either connects, over any number of
steps, form a group; only the texts of groups are shuffled, and in a group the exact similarity decides. Its
links connect what all pairs of at least 0.8 connect. A large group is dealt into blocks and
every pair of blocks is a task of its own, so memory is bounded and nothing is left out.

Defined cases: words are what white space separates, A-Z as a-z; a text of fewer than five words is one
shingle. Null and wordless texts are alike. Equal texts (by a 64-bit hash) are compared once. Rows
without an id stay, and may connect others. An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import blocks, map_rows
from tallyloom.llm.components import components
from tallyloom.llm.simhash import link_fingerprints, rows_named
from tallyloom.session import materialise

SHINGLE, BANDS, BAND_ROWS = 5, 32, 4
#: Fingerprints of a text, and how many bits linked ones may differ in.
PRINTS, MAX_BITS = 4, 10
#: The similarity as a fraction, so that no rounding decides.
PART, WHOLE = 4, 5
#: Most characters of a block, about.
BLOCK_CHARS = 4_000_000

_RNG = np.random.default_rng(42)
_FACTORS = _RNG.integers(0, 2**63, BANDS * BAND_ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_MASKS = _RNG.integers(0, 2**63, BANDS * BAND_ROWS, np.uint64)
_TURNS, _ODD = _RNG.integers(0, 2**63, (2, PRINTS), np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str) -> set[int]:
    """Hashes of the word shingles."""
    words = text.encode().lower().split()
    if len(words) < SHINGLE:
        return {xxhash.xxh64_intdigest(b" ".join(words))} if words else set()
    return set(map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(words[k:] for k in range(SHINGLE)), strict=False))))


def prints(found: set[int]) -> list[int]:
    """Signed SimHash fingerprints of the set, each from hashes mixed in another way; zero without a shingle."""
    h, total = np.fromiter(found, np.uint64, len(found)), np.zeros((PRINTS, 64), np.int64)
    for at in range(0, len(h), 4096):
        mixed = (h[at : at + 4096, None] ^ _TURNS) * _ODD
        mixed = (mixed ^ (mixed >> np.uint64(32))) * _ODD[::-1]
        mixed ^= mixed >> np.uint64(29)
        total += np.unpackbits(mixed.astype(">u8").view(np.uint8).reshape(-1, PRINTS, 8), axis=2).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * total > len(h), axis=1).view(">i8").ravel().tolist()


def bands(found: set[int]) -> list[int]:
    """One signed key per band."""
    h, least = np.fromiter(found, np.uint64, len(found)), np.full(len(_MASKS), 2**64 - 1, np.uint64)
    for at in range(0, len(h), 4096):
        mixed = (h[at : at + 4096, None] ^ _MASKS) * _FACTORS
        np.minimum(least, (mixed ^ (mixed >> np.uint64(32))).min(axis=0), out=least)
    rows = least.reshape(BANDS, BAND_ROWS)
    return [xxhash.xxh64_intdigest(r.tobytes(), k) - 2**63 for k, r in enumerate(rows)]


def alike(a: set[int], b: set[int]) -> bool:
    if WHOLE * min(len(a), len(b)) < PART * max(len(a), len(b)):
        return False
    both = len(a & b)
    return WHOLE * both >= PART * (len(a) + len(b) - both)


def forest(sets: list[set[int]]) -> list[tuple[int, int]]:
    """Links that connect what all pairs of at least 0.8 connect, fewer than sets.

    Neighbours are linked first; then every set outside the largest part is compared with all others,
    because a pair in two parts has an end outside that part.
    """
    near = np.array([alike(a, b) for a, b in zip(sets, sets[1:], strict=False)], bool)
    part = np.concatenate([[0], np.cumsum(~near)])
    out = [(k, k + 1) for k in np.flatnonzero(near).tolist()]
    sizes = np.array([len(s) for s in sets])
    for k in np.flatnonzero(part != np.bincount(part).argmax()).tolist():
        fits = (WHOLE * np.minimum(sizes, sizes[k]) >= PART * np.maximum(sizes, sizes[k])) & (part != part[k])
        for j in np.flatnonzero(fits).tolist():
            if part[j] != part[k] and alike(sets[k], sets[j]):
                out.append((k, j))
                part[part == part[j]] = part[k]
    return out


def _signatures(batches: Iterator[dict]) -> Iterator[dict]:
    for b in batches:
        for ids, texts in blocks(b["tid"], b["text"]):
            sets = [shingles(t) for t in texts]
            yield {"tid": ids, "prints": [prints(s) for s in sets], "bands": [bands(s) for s in sets]}


def _group_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) within (root, i, j), which the rows are sorted by."""
    key, ids, sets = None, [], []

    def done() -> pa.RecordBatch:
        links = forest(sets) if len(sets) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([ids[x[k]] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    for b in batches:
        for root, i, j, tid, text in zip(*(b.column(c).to_pylist() for c in ("root", "i", "j", "tid", "text")), strict=True):
            if key != (root, i, j):
                yield done()
                key, ids, sets = (root, i, j), [], []
            ids.append(tid)
            sets.append(shingles(text))
    yield done()


def simhash_candidates(signed: DataFrame) -> DataFrame:
    """(a, b): texts with a fingerprint in common, and texts whose fingerprints link."""
    filed = signed.select("tid", F.explode("prints").alias("fp"))
    # one row per fingerprint, as a table of its own, so that the join can split a frequent fingerprint
    least = materialise(filed.groupBy("fp").agg(F.min("tid").alias("least")), "fingerprints")
    same = filed.join(least, "fp").where("tid <> least").select(F.col("tid").alias("a"), F.col("least").alias("b"))
    ends = [least.select(F.col("fp").alias(c), F.col("least").alias(f"text_{c}")) for c in ("a", "b")]
    links = link_fingerprints(least.select("fp"), MAX_BITS).join(ends[0], "a").join(ends[1], "b")
    return same.unionByName(links.select(F.col("text_a").alias("a"), F.col("text_b").alias("b")))


def band_candidates(signed: DataFrame) -> DataFrame:
    """(a, b): texts with a band in common, for pairs beyond the fingerprints' radius."""
    filed = signed.select("tid", F.explode("bands").alias("key"))
    shared = filed.groupBy("key").agg(F.min("tid").alias("least"), F.max("tid").alias("most")).where("least < most").select("key", "least")
    return filed.join(shared, "key").where("tid <> least").select(F.col("tid").alias("a"), F.col("least").alias("b"))


def near_links(texts: DataFrame) -> DataFrame:
    """(a, b): links of the texts (tid, text) that connect all pairs of at least 0.8."""
    signed = map_rows(texts, _signatures, "tid long, prints array<long>, bands array<long>")
    signed = materialise(signed.groupBy("tid").agg(F.first("prints").alias("prints"), F.first("bands").alias("bands")), "signatures")
    maybe = simhash_candidates(signed).unionByName(band_candidates(signed)).distinct()
    groups = materialise(components(maybe).select(F.col("node").alias("tid"), "root"), "groups")
    members = texts.join(groups, "tid").groupBy("root", "tid").agg(F.min("text").alias("text"))
    members = materialise(members, "members")
    parts = members.groupBy("root").agg((F.sum(F.char_length("text")) / BLOCK_CHARS + 1).cast("long").alias("n"))
    dealt = members.join(parts, "root").withColumn("block", F.pmod(F.xxhash64("tid"), "n"))
    # block i meets block j in the task (min, max); a block meets itself there too
    spread = dealt.select("root", "tid", "text", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("other"))
    spread = spread.select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "tid", "text")
    sorted_ = spread.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "tid")
    return sorted_.mapInArrow(_group_links, "a long, b long").distinct()


def keep_distinct(docs: DataFrame) -> DataFrame:
    """The row with the smallest doc_id of each component of near copies, with its columns; rows without an id stay.

    Of repeated rows with one id and one text, one stays.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tid", F.xxhash64("text"))
    nodes = materialise(components(near_links(rows.select("tid", "text"))), "nodes")
    classes = rows.groupBy("tid").agg(F.min("doc_id").alias("least"))
    best = classes.join(nodes.withColumnRenamed("node", "tid"), "tid", "left")
    kept = best.groupBy(F.coalesce("root", "tid")).agg(F.min("least").alias("_kept")).select("_kept").distinct()
    return rows_named(docs, kept)
