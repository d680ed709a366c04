"""Conversation prefix trie: Z-fast tries whose compacted nodes are found by hashed handles.

A conversation is a sequence of turns, known by the hashes of its prefixes (128 bits each, chained). A
compacted node covers the depths (name, extent] of one edge and is filed in a dictionary under the hash of its
handle, the prefix of two-fattest depth in that interval. ``ZFastTrie.locate`` finds the node where a sequence leaves the trie by fat
binary search, with a number of look-ups logarithmic in its length; ``insert`` locates a whole batch, then hangs
each sequence below its exit node, splitting an edge where it leaves in the middle; ``expand`` walks every edge from
its lower end and gives one row for each depth.

Spark deals the work. Turns are hashed and their words counted where they lie, so texts are never shuffled; one
shuffle brings a conversation beside the one whose turns it takes over. Tasks hold a trie of at most
``MOST_TURNS`` turns, let its nodes go as partial rows and start anew; all values of a node are sums and minima, so
the partial rows of a prefix meet by its hash in an ordinary aggregate, however many conversations share it.
Sums over subtrees need every node counted once, so there are two passes: the first finds the smallest member
of each node, which owns it (a conversation owns the lower end of its own path); the second adds up what each
conversation owns. A conversation is held as an array of 24 bytes a turn. The ids that end at a node are range-sorted
and joined to text in pieces, so what one task hashes for a common conversation is a few long strings.

Defined cases: rows without conv_id are left out. Null roles and texts are empty. Rows of one turn are in order of role, then of the
MD5 digest of their text. Repeated rows are turns of their own. ``c % 20`` has the sign of c, as in SQL.
An empty table gives no node. Other columns do not matter.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tallyloom.llm.common import WORD_PATTERN, table
from tallyloom.llm.conversation_sql import TRIE_SQL
from tallyloom.llm.registry import query
from tallyloom.session import materialise

#: How many conversations share the turns of one, and how many turns at most less one.
FAMILY, HEAD = 20, 4
#: Turns that one trie holds before its nodes leave as partial rows, and turns of a batch.
MOST_TURNS, BATCH_TURNS = 400_000, 20_000
ROOT = hashlib.md5(b"root").digest()
#: Ids whose text one row holds.
PIECE = 20_000


def two_fattest(a: int, b: int) -> int:
    """The number in (a, b] with the most trailing zero bits."""
    return b & -1 << (a ^ b).bit_length() - 1


class Path:
    """A conversation: prefix hashes from depth 0, words of each turn (from depth 1), and what its owner knows.

    ``owned_from`` is the smallest depth that this conversation owns, None if it owns nothing; ``above`` is
    the owner of the node before it; ``leaf`` tells that nothing continues it.
    """

    __slots__ = ("conv_id", "prefixes", "words", "owned_from", "above", "leaf")

    def __init__(self, conv_id: int, prefixes: list[bytes], words: list[int], owned_from=None, above=None, leaf=False):
        self.conv_id, self.prefixes, self.words = conv_id, prefixes, words
        self.owned_from, self.above, self.leaf = owned_from, above, leaf


class Node:
    """A compacted node: depths (name, extent] along ``path``, and what ends at its extent. The extent never changes."""

    __slots__ = ("name", "extent", "path", "parent", "count", "least", "owned", "leaves")

    def __init__(self, name: int, extent: int, path: Path, parent: Node | None):
        self.name, self.extent, self.path, self.parent = name, extent, path, parent
        self.count, self.least, self.owned, self.leaves = 0, None, None, 0


class ZFastTrie:
    def __init__(self):
        self.nodes: list[Node] = []
        #: By the hash of the handle, and by that of the first turn of the edge.
        self.handles: dict[bytes, Node] = {}
        self.starts: dict[bytes, Node] = {}
        self.turns = 0

    def _new(self, name: int, extent: int, path: Path, parent: Node | None) -> Node:
        self.nodes.append(Node(name, extent, path, parent))
        return self.nodes[-1]

    def _file(self, node: Node) -> None:
        prefixes = node.path.prefixes
        self.handles[prefixes[two_fattest(node.name, node.extent)]] = node
        self.starts[prefixes[node.name + 1]] = node

    def locate(self, x: Path, start: Node | None = None) -> tuple[Node, Node | None, int]:
        """(last node all of whose extent ``x`` follows, edge below it that ``x`` leaves or None, depth of agreement).

        ``start`` is a node whose extent is known to be a prefix of ``x``.
        """
        at, high = start or self.nodes[0], len(x.prefixes) - 1
        low = at.extent
        while low < high:
            fat = two_fattest(low, high)
            found = self.handles.get(x.prefixes[fat])
            if found is None:
                high = fat - 1
            elif found.extent < len(x.prefixes) and found.path.prefixes[found.extent] == x.prefixes[found.extent]:
                at, low = found, found.extent
            else:
                return found.parent, found, self._agree(x, found, fat)
        edge = self.starts.get(x.prefixes[low + 1]) if low + 1 < len(x.prefixes) else None
        return at, edge, low if edge is None else self._agree(x, edge, low + 1)

    @staticmethod
    def _agree(x: Path, node: Node, low: int) -> int:
        """The greatest depth of the edge to which ``x`` agrees with it, at least ``low``."""
        y, high = node.path.prefixes, min(node.extent, len(x.prefixes) - 1)
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if x.prefixes[middle] == y[middle] else (low, middle - 1)
        return low

    def _split(self, node: Node, depth: int) -> Node:
        """A node for the upper part of an edge, to ``depth``; ``node`` keeps the lower part and its extent."""
        del self.handles[node.path.prefixes[two_fattest(node.name, node.extent)]]
        upper = self._new(node.name, depth, node.path, node.parent)
        node.name, node.parent = depth, upper
        self._file(upper)
        self._file(node)
        return upper

    def insert(self, batch: list[Path]) -> None:
        """Locate the whole batch, then hang each sequence below its exit node, wherever that is by then."""
        if not self.nodes and batch:
            self._new(0, 0, batch[0], None)
        passed = [self.locate(x)[0] for x in batch]
        for x, start in zip(batch, passed, strict=True):
            node, edge, depth = self.locate(x, start)
            if edge is not None:
                node = self._split(edge, depth) if depth < edge.extent else edge
            if depth < len(x.prefixes) - 1:
                node = self._new(depth, len(x.prefixes) - 1, x, node)
                self._file(node)
                self.turns += node.extent - node.name
            node.count += 1
            node.least = x.conv_id if node.least is None else min(node.least, x.conv_id)
            if x.owned_from is not None:  # of equal sequences, one owns the node
                node.owned, node.leaves = (x.owned_from, x.above), int(x.leaf)

    def expand(self) -> Iterator[tuple]:
        """(prefix, depth, parent, conv_id, continued, n_convs, n_children, n_leaves, saved, above) for each depth of each edge.

        Counted are the sequences of this trie, and of the nodes those that its sequences own.
        """
        below: dict[int, list] = {}
        for node in sorted(self.nodes, key=lambda v: -v.extent):
            count, least, owned, leaves, saved, children, continued = node.count, node.least, node.owned, node.leaves, 0, 0, False
            for c, l, o, k, s, first in below.pop(id(node), ()):
                count, leaves, saved, children, continued = count + c, leaves + k, saved + s, children + first, True
                least = l if least is None else min(least, l)
                owned = o if owned is None else owned if o is None else min(owned, o, key=lambda v: v[0])
            path = node.path
            for depth in range(node.extent, node.name, -1):
                own = owned is not None and owned[0] <= depth
                saved += (count - own) * path.words[depth - 1]
                above = (least if owned[0] < depth else owned[1]) if own else None
                yield path.prefixes[depth], depth, path.prefixes[depth - 1], least, continued, count, children, leaves, saved, above
                children, continued = int(own), True
            if node.parent is None:
                yield path.prefixes[0], 0, None, least, continued, count, children, leaves, saved, None
            else:
                below.setdefault(id(node.parent), []).append((count, least, owned, leaves, saved, children))


NODES = "prefix binary, depth long, parent binary, conv_id long, continued boolean, n_convs long, n_children long, n_leaves long, saved long, above long"


def partial_nodes(paths: DataFrame) -> DataFrame:
    """Nodes of the tries of ``paths`` (conv_id, prefixes, words, owned_from, above, leaf); a prefix may have rows of several tries."""
    schema = StructType.fromDDL(NODES)
    arrow = to_arrow_schema(schema)

    def out(trie: ZFastTrie) -> Iterator[pa.RecordBatch]:
        rows = trie.expand()
        while part := list(islice(rows, 20_000)):
            columns = zip(*part, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, held, size = ZFastTrie(), [], 0
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.append(Path(*row))
                size += len(held[-1].prefixes)
                if size > BATCH_TURNS:
                    trie.insert(held)
                    held, size = [], 0
                    if trie.turns > MOST_TURNS:
                        yield from out(trie)
                        trie = ZFastTrie()
        trie.insert(held)
        yield from out(trie)

    return paths.select("conv_id", "prefixes", "words", "owned_from", "above", "leaf").mapInArrow(run, schema)


def hashed_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, place, words) of the rows that have a conv_id."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    both = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return rows.where("conv_id IS NOT NULL").select(
        "conv_id", "turn", role.alias("role"), F.unhex(F.md5(both.cast("binary"))).alias("digest"), F.md5(text.cast("binary")).alias("place"),
        F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long").alias("words"),
    )


def rebuilt_paths(rows: DataFrame) -> DataFrame:
    """(conv_id, prefixes, words) of every conversation after it took over the head of its family's first."""
    turns = hashed_turns(rows).withColumn("family", F.col("conv_id") - F.col("conv_id") % FAMILY)
    turns = turns.withColumn("own", F.col("conv_id") != F.col("family"))
    dealt = turns.repartition("family").sortWithinPartitions("family", "own", "conv_id", "turn", "role", "place").select("family", "conv_id", "digest", "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, head, now = None, [], None
        turns: list[tuple[bytes, int]] = []
        done: list[tuple] = []
        held = 0

        def close() -> None:
            nonlocal head
            h = zlib.crc32(str(now).encode()) % HEAD
            if now == family:
                head = turns[: HEAD - 1]
            rebuilt = head[:h] + turns[h:]
            prefixes = [ROOT]
            for digest, _ in rebuilt:
                prefixes.append(hashlib.md5(prefixes[-1] + digest).digest())
            done.append((now, prefixes, [w for _, w in rebuilt]))

        for b in batches:
            for f, conv, digest, words in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if conv != now:
                    if now is not None:
                        close()
                        held += len(turns)
                    if f != family:
                        family, head = f, []
                    now, turns = conv, []
                turns.append((digest, words))
            if held > BATCH_TURNS:
                yield _paths(done)
                done, held = [], 0
        if now is not None:
            close()
            yield _paths(done)

    return dealt.mapInArrow(run, "conv_id long, prefixes array<binary>, words array<long>")


def _paths(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64()))
    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=["conv_id", "prefixes", "words"])


def owners(paths: DataFrame) -> DataFrame:
    """(conv_id, owned_from, above, leaf): for each conversation that is the smallest member of a node.

    It owns the nodes of its path from ``owned_from`` on; ``above`` is the owner of the node before.
    """
    bare = paths.withColumns({"owned_from": F.lit(None).cast("long"), "above": F.lit(None).cast("long"), "leaf": F.lit(False)})
    found = partial_nodes(bare).groupBy("prefix").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.max("continued").alias("continued")
    )
    found = materialise(found, "trie-nodes")
    own = found.groupBy("conv_id").agg(F.min("depth").alias("owned_from"), F.min_by("parent", "depth").alias("parent"), (~F.min("continued")).alias("leaf"))
    # most paths leave the trie at its root, whose owner is one number
    root = found.where("depth = 0").first()
    upper = found.where("depth > 0").select(F.col("prefix").alias("parent"), F.col("conv_id").alias("owner"))
    inner = own.where((F.col("owned_from") > 1)).join(upper, "parent", "left").select("conv_id", "owned_from", F.col("owner").alias("above"), "leaf")
    first = F.when(F.col("owned_from") == 1, F.lit(root and root["conv_id"]).cast("long"))
    return inner.unionByName(own.where("owned_from <= 1").select("conv_id", "owned_from", first.alias("above"), "leaf"))


def end_digests(paths: DataFrame) -> DataFrame:
    """(prefix, ends_sha256) of the prefixes at which conversations end: their ids in order, as text."""
    ends = paths.select(F.element_at("prefixes", -1).alias("prefix"), "conv_id")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids = None, []
        for b in batches:
            out: list[tuple] = []
            for prefix, conv in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if prefix != now or len(ids) == PIECE:
                    if ids:
                        out.append((now, ids[0], ",".join(map(str, ids))))
                    now, ids = prefix, []
                ids.append(conv)
            yield _rows(out, "prefix", "least", "ids")
        if ids:
            yield _rows([(now, ids[0], ",".join(map(str, ids)))], "prefix", "least", "ids")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h = None, None
        for b in batches:
            out = []
            for prefix, _, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if prefix != now:
                    if h is not None:
                        out.append((now, None, h.hexdigest()))
                    now, h = prefix, hashlib.sha256(ids.encode())
                else:
                    h.update(b"," + ids.encode())
            yield _rows(out, "prefix", None, "ends_sha256")
        if h is not None:
            yield _rows([(now, None, h.hexdigest())], "prefix", None, "ends_sha256")

    parts = ends.repartitionByRange("prefix", "conv_id").sortWithinPartitions("prefix", "conv_id").mapInArrow(pieces, "prefix binary, least long, ids string")
    return parts.repartition("prefix").sortWithinPartitions("prefix", "least").mapInArrow(digests, "prefix binary, ends_sha256 string")


def _rows(rows: list[tuple], a: str, b: str | None, c: str) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), ()]
    arrays = [pa.array(x, k) for x, k in zip(columns, (pa.binary(), pa.int64(), pa.string()), strict=True)]
    kept = [(x, n) for x, n in zip(arrays, (a, b, c), strict=True) if n]
    return pa.RecordBatch.from_arrays([x for x, _ in kept], names=[n for _, n in kept])


def prefix_trie(rows: DataFrame) -> DataFrame:
    """One row for each distinct prefix of the rebuilt conversations, with ``prefix`` (its hash)."""
    paths = materialise(rebuilt_paths(rows), "paths")
    own = materialise(owners(paths), "owners")
    nodes = partial_nodes(paths.join(own, "conv_id", "left").withColumn("leaf", F.coalesce("leaf", F.lit(False)))).groupBy("prefix").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.max("above").alias("parent_conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves")], F.sum("saved").alias("saved_tokens"),
    )
    out = nodes.join(end_digests(paths), "prefix", "left")
    return out.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())))


@query("op11_conversation_trie", TRIE_SQL)
def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return prefix_trie(rows).select(*names)
