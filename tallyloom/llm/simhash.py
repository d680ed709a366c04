"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into three segments. If two fingerprints differ in at most four bits, some
segment differs in at most one, so the two agree on that segment with one of its bits left out. Each
distinct fingerprint is therefore filed under 64 keys (a segment without one bit, for every bit), and
fingerprints that meet under a key are compared in full.

Exact copies share a fingerprint and are one entry. Under a key, a task reads the sorted entries as a
stream and emits at most one link less than there are entries (a spanning forest of the exact links),
never all pairs. A key with more entries than ``BLOCK`` is set aside and compared block against block,
each pair of blocks a task of its own; nothing is left out. Components are found by star contraction.

Defined cases: a null or wordless text has fingerprint zero and links like any other. Repeated rows
share a component. A null doc_id never becomes a component's name; a component in which all ids are
null is called null. An empty table gives an empty result. Other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import blocks, map_rows, table
from tallyloom.llm.components import components
from tallyloom.llm.registry import query
from tallyloom.session import materialise

SHINGLE, SEED, MAX_BITS = 4, 42, 4
#: First bit of each segment, and the end.
SEGMENTS = (0, 22, 43, 64)
#: Most entries of a key that one task holds.
BLOCK = 8192


def fingerprint(text: str) -> int:
    """Unsigned 64-bit SimHash of the word shingles, with repeats; only A-Z are lower-cased."""
    words = text.encode().lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)  # one shingle is its own majority
    total, n = np.zeros(64, np.int64), len(words) - SHINGLE + 1
    for at in range(0, n, 50_000):
        part = words[at : at + 50_000 + SHINGLE - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(SHINGLE)), strict=False))
        h = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], ">u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            for keys, texts in blocks(b["doc_id"], b["text"]):
                yield {"doc_id": keys, "fp": np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)}

    return map_rows(docs.select("doc_id", "text"), run, f"doc_id {kind}, fp long")


def variants(fps: DataFrame) -> DataFrame:
    """(key, fp): 64 rows for each fingerprint; the key names the bit left out and holds the rest of its segment."""
    at, fp = F.col("at"), F.col("fp")
    inside = F.lit(None)
    for low, high in zip(SEGMENTS, SEGMENTS[1:], strict=False):
        mask = (1 << (high - low)) - 1
        inside = F.when((at >= low) & (at < high), F.shiftrightunsigned(fp, low).bitwiseAND(F.lit(mask).cast("long"))).otherwise(inside)
    start = F.lit(0)
    for low in SEGMENTS[1:-1]:
        start = F.when(at >= low, F.lit(low)).otherwise(start)
    hole = F.expr("shiftleft(1L, bit)")
    rows = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("at"))
    rows = rows.select("fp", "at", inside.cast("long").alias("part"), (at - start).alias("bit"))
    rest = F.col("part").bitwiseAND(F.bitwise_not(hole))
    return rows.select((F.shiftleft(rest, 6) + at).alias("key"), "fp")


def forest(fps: np.ndarray, bits: int = MAX_BITS) -> np.ndarray:
    """Rows (i, j): links that connect what all links of at most ``bits`` bits connect, fewer than entries.

    ``fps`` are unsigned. Neighbours in the given order are linked first; then every entry outside the
    largest group is compared with all, because a pair in two groups has an end outside that group.
    """
    near = np.bitwise_count(fps[1:] ^ fps[:-1]) <= bits
    group = np.concatenate([[0], np.cumsum(~near)])
    out = [(k, k + 1) for k in np.flatnonzero(near).tolist()]
    left = int(group[-1]) + 1
    if left > 1:
        for k in np.flatnonzero(group != int(np.bincount(group).argmax())).tolist():
            hit = np.flatnonzero((np.bitwise_count(fps ^ fps[k]) <= bits) & (group != group[k]))
            while len(hit):
                out.append((k, int(hit[0])))
                group[group == group[hit[0]]] = group[k]
                hit = hit[group[hit] != group[k]]
                left -= 1
            if left == 1:
                break
    return np.array(out, np.int64).reshape(-1, 2)


def _keyed(batches: Iterator[pa.RecordBatch], key: list[str], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """From rows sorted by ``key``: (fingerprints, starts of keys, whether a key goes on before and behind).

    Every yield holds whole keys, or at most ``most`` entries of one key that has more. The last
    array has a row (key number among the columns' rows, first entry's place in its key) per start.
    """
    keys: list[np.ndarray] = [np.zeros(0, np.int64) for _ in key]
    fps, seen = np.zeros(0, np.uint64), 0  # entries of the open key that were yielded before
    for b in batches:
        new = [b.column(c).to_numpy() for c in key]
        if not b.num_rows:
            continue
        if seen and not len(fps) and any(x[0] != y for x, y in zip(new, last, strict=True)):
            seen = 0
        keys = [np.concatenate(x) for x in zip(keys, new, strict=True)]
        fps = np.concatenate([fps, b.column("fp").to_numpy().view(np.uint64)])
        last = [k[-1] for k in keys]
        change = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
        starts = np.concatenate([[0], np.flatnonzero(change) + 1])
        end = int(starts[-1])  # the open key begins here
        if end:
            place = np.zeros(len(starts) - 1, np.int64)
            place[0] = seen
            yield fps[:end], starts, np.stack([keys[0][starts[:-1]], place])
            seen, keys, fps = 0, [k[end:] for k in keys], fps[end:]
        while len(fps) > most:
            yield fps[:most], np.array([0, most]), np.array([[keys[0][0]], [seen]])
            seen, keys, fps = seen + most, [k[most:] for k in keys], fps[most:]
    if len(fps):
        yield fps, np.array([0, len(fps)]), np.array([[keys[0][0]], [seen]])


def _forests(fps: np.ndarray, starts: np.ndarray, skip: np.ndarray, bits: int) -> np.ndarray:
    """Links of all keys that are not skipped, as rows of two signed fingerprints."""
    sizes, signed = np.diff(starts), fps.view(np.int64)
    two = starts[:-1][(sizes == 2) & ~skip]
    two = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= bits]  # pairs are compared all at once
    out = [np.stack([signed[two], signed[two + 1]], axis=1)]
    for k in np.flatnonzero((sizes > 2) & ~skip).tolist():
        links = forest(fps[starts[k] : starts[k + 1]], bits)
        if len(links):
            out.append(signed[links + starts[k]])
    return np.concatenate(out)


def _links(batches: Iterator[pa.RecordBatch], bits: int = MAX_BITS) -> Iterator[pa.RecordBatch]:
    """Rows with a link (a, b), or with an entry ``a`` of a key that is set aside and its block."""
    for fps, starts, (key, place) in _keyed(batches, ["key"], BLOCK):
        sizes = np.diff(starts)
        large = (sizes + place > BLOCK) | (sizes == BLOCK)  # a full block may go on
        links = _forests(fps, starts, large, bits)
        out = [(links[:, 0], links[:, 1], None, None)]
        for k in np.flatnonzero(large).tolist():
            at = np.arange(starts[k], starts[k + 1])
            blocks_of = (at - starts[k] + place[k]) // BLOCK
            out.append((fps.view(np.int64)[at], None, np.full(len(at), key[k]), blocks_of))
        for cols in out:
            n = len(cols[0])
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()) if c is None else pa.array(c, pa.int64()) for c in cols], names=["a", "b", "key", "block"])


def _block_links(batches: Iterator[pa.RecordBatch], bits: int = MAX_BITS) -> Iterator[pa.RecordBatch]:
    """Links within pairs of blocks, which are bounded."""
    for fps, starts, _ in _keyed(batches, ["key", "i", "j"], 2 * BLOCK):
        links = _forests(fps, starts, np.zeros(len(starts) - 1, bool), bits)
        yield pa.RecordBatch.from_arrays([pa.array(links[:, k], pa.int64()) for k in (0, 1)], names=["a", "b"])


def link_fingerprints(fps: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """(a, b): links of distinct fingerprints that connect all that lie within ``bits`` bits.

    All of up to five bits meet under a key; of those further apart, the ones that do.
    """
    filed = variants(fps).repartition("key").sortWithinPartitions("key", "fp")
    found = materialise(filed.mapInArrow(partial(_links, bits=bits), "a long, b long, key long, block long"), "links")
    links = found.where("b IS NOT NULL").select("a", "b")
    aside = found.where("b IS NULL").select("key", "block", F.col("a").alias("fp"))
    many = aside.groupBy("key").agg((F.max("block") + 1).alias("n"))
    # block i meets block j in the task (min, max); a block meets itself there too
    spread = aside.join(many, "key").select("key", "fp", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("other"))
    spread = spread.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "fp")
    pairs = spread.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "fp")
    return links.unionByName(pairs.mapInArrow(partial(_block_links, bits=bits), "a long, b long")).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of every row."""
    fps = materialise(fingerprints(docs), "fingerprints")
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    nodes = materialise(components(link_fingerprints(fps.select("fp").distinct())), "nodes")
    named = nodes.join(classes, nodes.node == classes.fp).groupBy("root").agg(F.min("least").alias("name"))
    wider = nodes.join(named, "root").select(F.col("node").alias("fp"), "name")
    # one row per fingerprint, as a table of its own, so that the join can split a frequent fingerprint
    ids = materialise(classes.join(wider, "fp", "left").select("fp", F.coalesce("name", "least").alias("component_id")), "ids")
    return fps.join(ids, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The row with the smallest doc_id of each component, with its columns; rows without an id stay.

    Of repeated rows with one id and one text, one stays.
    """
    return rows_named(docs, near_duplicates(docs).where("doc_id = component_id").select(F.col("doc_id").alias("_kept")).distinct())


def rows_named(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows whose id is in ``kept`` (_kept), repeated rows once, and those without an id."""
    named = docs.join(kept, docs["doc_id"] == kept["_kept"], "left_semi").dropDuplicates(["doc_id", "text"])
    return named.unionByName(docs.where("doc_id IS NULL"))


@query("op10_simhash")
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
