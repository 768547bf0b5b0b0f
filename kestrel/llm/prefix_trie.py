"""The prefix trie of rebuilt conversations, by a splitter skeleton.

Every conversation becomes a path: the 128-bit hashes of its turns side by
side, with the words of each turn. In the byte order of paths a node's members
stand together, so the trie is built from shards of the sorted paths:

* a bounded sample gives the shards' splitters (path and conv_id, so a group
  of equal conversations is split too), each cut to the shortest prefix that
  still separates. The trie of the splitter paths, the skeleton, is broadcast
  after a check of its size;
* a node whose members lie in two shards is a prefix of a splitter, thus in
  the skeleton. Each shard streams its sorted paths over a stack and finishes
  every other node alone; for the skeleton nodes it meets (prefixes of its two
  splitters only) it gives one row of partial aggregates, and the ids that end
  there in chunks of bounded size;
* the partial rows are summed per skeleton node. All aggregates are made
  additive for that: saved tokens are the members' tokens below a node minus
  the tokens of its distinct nodes, and a leaf at a splitter's tip is counted
  at its ancestors after the sums are known.

A digest of the ids that end at a node is sequential by its definition; the
chunks of one node, about 16 kB of ids a row, stream through it in order.

Defined results: rows with a NULL conv_id take no part; turns with equal
numbers are ordered by role, then by the MD5 of role and text; repeated rows
are turns of their own; NULL role or text is empty; ``c % 20`` keeps the sign
of ``c``; an empty table gives no node; extra columns are ignored. The path of
one conversation (20 bytes a turn) has to fit a task.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.llm.tables import saved

HASH_BYTES = 16
SHARD_BYTES = 64 << 20
SAMPLES_PER_SHARD = 10
MAX_SHARDS = 50_000
#: Bound on the splitter paths, and with it on the broadcast skeleton.
SPLITTER_BYTES = 32 << 20
CHUNK_BYTES = 16 << 10
FLUSH_ROWS = 10_000
BASE_STEP, HEAD_CYCLE = 20, 4
_FIRST_ID = -(1 << 63)
_EMPTY_SHA = hashlib.sha256(b"").digest()
_WORD = r"[^\x20\x09-\x0D]+"


def head_turns(conv_id: int) -> int:
    """How many first turns a conversation takes over from its base."""
    return zlib.crc32(str(conv_id).encode()) % HEAD_CYCLE


def _turn_rows(df: DataFrame) -> DataFrame:
    """Turns without their texts: base, conv_id, turn, role, hash and words."""
    role, text = (F.coalesce(df[f"`{c}`"].cast("string"), F.lit("")) for c in ("role", "text"))
    slim = df.select(df["`conv_id`"].cast("long").alias("conv_id"), df["`turn`"].cast("long").alias("turn"), role.alias("role"), text.alias("text")).where("conv_id IS NOT NULL")
    digest = F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))))
    return slim.select((F.col("conv_id") - F.col("conv_id") % BASE_STEP).alias("base"), "conv_id", "turn", "role", digest.alias("hash"), F.regexp_count("text", F.lit(_WORD)).alias("words"))


def _rebuild(batches):
    """Rows sorted by base, the base conversation first, then by conversation
    and turn, to ``conv_id, path, words`` of each rebuilt conversation."""
    base, head, conv, hashes, words = None, (b"", b""), None, [], []
    out: list[tuple] = []

    def close():
        nonlocal head
        if conv is None:
            return
        path, counts = b"".join(hashes), b"".join(words)
        if conv == base:
            head = (path[:(HEAD_CYCLE - 1) * HASH_BYTES], counts[:(HEAD_CYCLE - 1) * 4])
        h = head_turns(conv)
        out.append((conv, head[0][:h * HASH_BYTES] + path[h * HASH_BYTES:], head[1][:h * 4] + counts[h * 4:]))

    def flush():
        ids, paths, counts = zip(*out, strict=True)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(paths, pa.binary()), pa.array(counts, pa.binary())], ["conv_id", "path", "words"])

    for b in batches:
        if not b.num_rows:
            continue
        bases, convs, counts = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(3).to_numpy().astype("<i4")
        raw = b"".join(b.column(2).to_pylist())
        cut = np.flatnonzero(np.r_[True, convs[1:] != convs[:-1]])
        for s, e in zip(cut.tolist(), [*cut[1:].tolist(), len(convs)], strict=True):
            if convs[s] != conv:
                close()
                if bases[s] != base:
                    base, head = int(bases[s]), (b"", b"")
                conv, hashes, words = int(convs[s]), [], []
            hashes.append(raw[s * HASH_BYTES:e * HASH_BYTES])
            words.append(counts[s:e].tobytes())
        if len(out) >= FLUSH_ROWS:
            yield flush()
    close()
    if out:
        yield flush()


def rebuilt_paths(df: DataFrame) -> DataFrame:
    """``conv_id, path, words`` of every rebuilt conversation. A base and its
    followers, twenty conversations, meet in one group; texts are left behind."""
    rows = _turn_rows(df).repartition("base").sortWithinPartitions(F.col("base"), F.col("conv_id") != F.col("base"), "conv_id", "turn", "role", "hash")
    return rows.select("base", "conv_id", "hash", "words").mapInArrow(_rebuild, "conv_id long, path binary, words binary")


def shared_turns(a: bytes, b: bytes) -> int:
    """Turns that two paths have in common at their start."""
    low, high = 0, min(len(a), len(b)) // HASH_BYTES
    while low < high:
        mid = (low + high + 1) // 2
        if a[low * HASH_BYTES:mid * HASH_BYTES] == b[low * HASH_BYTES:mid * HASH_BYTES]:
            low = mid
        else:
            high = mid - 1
    return low


class Skeleton:
    """The splitters and the trie of their paths.

    ``nodes[s]`` numbers the nodes along splitter ``s`` from the root (0);
    ``parent``, ``children`` and ``tokens`` describe them inside the skeleton:
    ``tokens`` is the sum over a node's skeleton subtree, itself included.
    """

    def __init__(self, splitters: list[tuple[bytes, int, bytes]]):
        self.keys = [(path, conv) for path, conv, _ in splitters]
        self.nodes: list[np.ndarray] = []
        parent, words = [-1], [0]
        before, line = b"", [0]
        for path, _, counts in splitters:
            own = np.frombuffer(counts, "<i4")
            line = line[:shared_turns(before, path) + 1]
            for d in range(len(line), len(path) // HASH_BYTES + 1):
                parent.append(line[-1])
                words.append(int(own[d - 1]))
                line.append(len(parent) - 1)
            self.nodes.append(np.array(line, np.int32))
            before = path
        self.parent = np.array(parent, np.int32)
        self.children = np.bincount(self.parent[1:], minlength=len(parent)).astype(np.int64)
        self.tokens = np.array(words, np.int64)
        for i in range(len(parent) - 1, 0, -1):  # a parent has a smaller number
            self.tokens[parent[i]] += self.tokens[i]


def _separator(a: tuple, b: tuple) -> tuple[bytes, int, bytes]:
    """The shortest key above ``a`` and not above ``b``."""
    if a[0] == b[0]:
        return b
    d = shared_turns(a[0], b[0]) + 1
    return b[0][:d * HASH_BYTES], _FIRST_ID, b[2][:d * 4]


def choose_splitters(sample: list[tuple[bytes, int, bytes]], shards: int, max_bytes: int = SPLITTER_BYTES) -> list[tuple[bytes, int, bytes]]:
    """At most ``shards - 1`` splitters of a sample, fewer if they are long."""
    rows = sorted(sample)
    places = sorted({len(rows) * i // shards for i in range(1, shards)} - {0})
    cuts = [_separator(rows[i - 1], rows[i]) for i in places if rows[i - 1][:2] != rows[i][:2]]
    cuts = sorted({c[:2]: c for c in cuts}.values())
    while sum(len(c[0]) for c in cuts) > max_bytes:
        cuts = cuts[1::2]
    return cuts


def skeleton_of(paths: DataFrame, shards: int | None = None) -> Skeleton:
    """Splitters for ``paths`` from a sample by hash: about ten rows a shard."""
    size = paths.agg(F.count("*").alias("n"), F.sum(F.octet_length("path")).alias("b")).first()
    wide = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = shards or min(MAX_SHARDS, max(wide, ((size["b"] or 0) + 24 * size["n"]) // SHARD_BYTES))
    every = max(1, size["n"] // (SAMPLES_PER_SHARD * shards))
    sample = paths.where(F.pmod(F.xxhash64("conv_id"), F.lit(every)) == 0)
    return Skeleton(choose_splitters([(bytes(r["path"]), r["conv_id"], bytes(r["words"])) for r in sample.collect()], shards))


_NODE, _PARTIAL, _IDS = 0, 1, 2
_FOUND = [("kind", "int", pa.int32()), ("skel", "int", pa.int32()), ("conv_id", "long", pa.int64()), ("depth", "long", pa.int64()), ("parent", "long", pa.int64()), ("parent_skel", "int", pa.int32()),
          ("n_convs", "long", pa.int64()), ("n_children", "long", pa.int64()), ("n_leaves", "long", pa.int64()), ("all_tokens", "long", pa.int64()), ("own_tokens", "long", pa.int64()),
          ("sha", "binary", pa.binary()), ("shard", "int", pa.int32()), ("chunk", "long", pa.int64()), ("ids", "string", pa.string())]
_FOUND_DDL = ", ".join(f"{n} {t}" for n, t, _ in _FOUND)


class _Open:
    """A node on the stack of a shard's stream."""

    __slots__ = ("skel", "start", "words", "conv", "children", "leaves", "all_tokens", "own_tokens", "sha", "kids", "ids", "ids_bytes")

    def __init__(self, skel: int, start: int, words: int):
        self.skel, self.start, self.words = skel, start, words
        self.conv, self.sha = None, None
        self.children = self.leaves = self.all_tokens = self.own_tokens = self.ids_bytes = 0
        self.kids: list[tuple] = []
        self.ids: list[str] = []


class _Shard:
    """The stack over one shard's sorted paths; ``out`` gathers result rows."""

    def __init__(self, shard: int, skeleton: Skeleton, out: list[tuple]):
        self.shard, self.out, self.rows, self.chunk = shard, out, 0, 0
        near = [i for i in (shard - 1, shard) if 0 <= i < len(skeleton.keys)]
        self.borders = [(skeleton.keys[i][0], skeleton.nodes[i]) for i in near]
        self.path, self.stack = b"", [_Open(0, 0, 0)]

    def add(self, conv: int, path: bytes, words: bytes):
        if path != self.path:
            keep = shared_turns(path, self.path)
            self.shrink(keep)
            counts = np.frombuffer(words, "<i4")[keep:].tolist()
            skels = [-1] * len(counts)
            for border, nodes in self.borders:
                for d in range(keep + 1, min(shared_turns(path, border), keep + len(counts)) + 1):
                    skels[d - keep - 1] = int(nodes[d])
            self.stack.extend(_Open(s, self.rows, w) for s, w in zip(skels, counts, strict=True))
            self.path = path
        self.rows += 1
        top, text = self.stack[-1], str(conv)
        if top.conv is None or conv < top.conv:
            top.conv = conv
        if top.skel < 0:
            if top.sha is None:
                top.sha = hashlib.sha256(text.encode())
            else:
                top.sha.update(b"," + text.encode())
            return
        top.ids.append(text)
        top.ids_bytes += len(text) + 1
        if top.ids_bytes >= CHUNK_BYTES:
            self.send(top)

    def send(self, node: _Open):
        self.chunk += 1
        self.out.append((_IDS, node.skel, *[None] * 10, self.shard, self.chunk, ",".join(node.ids)))
        node.ids, node.ids_bytes = [], 0

    def shrink(self, depth: int):
        """Close all nodes deeper than ``depth``."""
        while len(self.stack) - 1 > depth:
            self.close()

    def close(self):
        node, depth = self.stack.pop(), len(self.stack)
        n = self.rows - node.start
        node.all_tokens += n * node.words
        up = self.stack[-1] if self.stack else None
        if node.skel >= 0:
            if node.ids:
                self.send(node)
            self.out.append((_PARTIAL, node.skel, node.conv, depth, None, up.skel if up else -1, n, node.children, node.leaves, node.all_tokens, node.own_tokens, None, None, None, None))
        else:
            node.own_tokens += node.words
            node.leaves = node.leaves or 1
            self.out.extend((_NODE, None, *k[:2], node.conv, None, *k[2:], None, None, None) for k in node.kids)
            row = (node.conv, depth, n, node.children, node.leaves, node.all_tokens - node.own_tokens)
            sha = node.sha.digest() if node.sha else _EMPTY_SHA
            if up.skel >= 0:
                self.out.append((_NODE, None, *row[:2], None, up.skel, *row[2:], None, sha, None, None, None))
            else:
                up.kids.append((*row, None, sha))
            up.children += 1
        if up:
            up.leaves += node.leaves
            up.all_tokens += node.all_tokens
            up.own_tokens += node.own_tokens
            if node.conv is not None and (up.conv is None or node.conv < up.conv):
                up.conv = node.conv

    def finish(self):
        self.shrink(0)
        self.close()


def _local_pass(skeleton):
    """Nodes, partial rows and id chunks from rows sorted by shard, path, id."""

    def run(batches):
        out: list[tuple] = []
        state = None

        def flush():
            cols = zip(*out, strict=True)
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, _, t) in zip(cols, _FOUND, strict=True)], [n for n, _, _ in _FOUND])
            out.clear()
            return batch

        for b in batches:
            for shard, conv, path, words in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if state is None or state.shard != shard:
                    if state:
                        state.finish()
                    state = _Shard(shard, skeleton.value, out)
                state.add(conv, path, words)
                if len(out) >= FLUSH_ROWS:
                    yield flush()
        if state:
            state.finish()
        if out:
            yield flush()

    return run


def _digests(batches):
    """The SHA-256 of each skeleton node's chunks, which come in order."""
    node, sha, done = None, None, []
    for b in batches:
        for skel, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if skel == node:
                sha.update(b"," + ids.encode())
                continue
            if node is not None:
                done.append((node, sha.digest()))
            node, sha = skel, hashlib.sha256(ids.encode())
    if node is not None:
        done.append((node, sha.digest()))
    if done:
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.int32()), pa.array([x[1] for x in done], pa.binary())], ["skel", "sha"])


def _reduced(found: DataFrame, skeleton) -> DataFrame:
    """One row for each skeleton node from its partial rows."""
    sums = (found.where(F.col("kind") == _PARTIAL).groupBy("skel", "depth", "parent_skel")
            .agg(F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "all_tokens", "own_tokens"))))

    def with_static(batches):
        """Add what the skeleton itself knows: its own children and tokens."""
        for b in batches:
            at = b.column(0).to_numpy()
            kids, tokens = skeleton.value.children[at], skeleton.value.tokens[at]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(kids), pa.array(tokens)], [*b.schema.names, "skel_children", "skel_tokens"])

    def tips(batches):
        """Each leaf tip counts once at itself and at its ancestors."""
        for b in batches:
            up = []
            for i in b.column(0).to_pylist():
                while i >= 0:
                    up.append(i)
                    i = int(skeleton.value.parent[i])
            yield pa.RecordBatch.from_arrays([pa.array(up, pa.int32())], ["tip_of"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sums.schema)
    whole = saved(sums.mapInArrow(with_static, f"{kinds}, skel_children long, skel_tokens long"))
    leaf = whole.where((F.col("n_children") == 0) & (F.col("skel_children") == 0)).select("skel")
    leaves = leaf.mapInArrow(tips, "tip_of int").groupBy("tip_of").agg(F.count("*").alias("tips"))
    chunks = found.where(F.col("kind") == _IDS).repartition("skel").sortWithinPartitions("skel", "shard", "chunk").select("skel", "ids")
    shas = chunks.mapInArrow(_digests, "skel int, sha binary").withColumnRenamed("skel", "sha_of")
    joined = whole.join(leaves, whole["skel"] == leaves["tip_of"], "left").join(shas, whole["skel"] == shas["sha_of"], "left")
    return saved(joined.select(
        "skel", "conv_id", "depth", "parent_skel", "n_convs", (F.col("n_children") + F.col("skel_children")).alias("n_children"),
        (F.col("n_leaves") + F.coalesce("tips", F.lit(0))).alias("n_leaves"),
        (F.col("all_tokens") - F.col("own_tokens") - F.col("skel_tokens")).alias("saved_tokens"), F.coalesce("sha", F.lit(_EMPTY_SHA)).alias("sha")))


def trie_nodes(df: DataFrame, shards: int | None = None) -> DataFrame:
    """One row for each node of the rebuilt conversations' prefix trie."""
    paths = saved(rebuilt_paths(df))
    skeleton = skeleton_of(paths, shards)
    shared = df.sparkSession.sparkContext.broadcast(skeleton)

    def dealt(batches):
        for b in batches:
            keys = shared.value.keys
            at = [bisect_right(keys, k) for k in zip(b.column(1).to_pylist(), b.column(0).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *b.columns], ["shard", *b.schema.names])

    rows = paths.mapInArrow(dealt, "shard int, conv_id long, path binary, words binary").repartitionById(len(skeleton.keys) + 1, F.col("shard"))
    ordered = rows.sortWithinPartitions("shard", "path", "conv_id")
    found = saved(ordered.mapInArrow(_local_pass(shared), _FOUND_DDL))
    reduced = _reduced(found, shared)
    # as large as the skeleton at most, which is bounded by SPLITTER_BYTES
    tops = F.broadcast(reduced.select(F.col("skel").alias("top"), F.col("conv_id").alias("top_conv")))

    def named(rows: DataFrame, parent: Column, saved_tokens: str) -> DataFrame:
        both = rows.join(tops, rows["parent_skel"] == tops["top"], "left")
        return both.select("conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col(saved_tokens).alias("saved_tokens"), F.lower(F.hex("sha")).alias("ends_sha256"))

    local = found.where(F.col("kind") == _NODE)
    return named(local, F.coalesce("parent", "top_conv"), "all_tokens").unionByName(named(reduced, F.col("top_conv"), "saved_tokens"))
