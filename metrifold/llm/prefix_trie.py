"""Conversation prefix trie: double-array tries per prefix shard, shared upper nodes merged globally.

Turns are numbered within their conversation, reduced to digests (16 bytes and a size), and conversations are rebuilt with the
head of their base conversation. A rebuilt conversation is cut into blocks of ``BLOCK`` turns; equal blocks under an
equal prefix are one row with a count, so copies cost one row however many there are. Blocks are worked from the
deepest level up: a level's totals are what hangs below the last turns of the level above. Conversations
of up to ``BLOCK`` turns, the usual case, are one level.

On a level, each block takes the shortest of its prefixes of 1, 2, 4, ... turns under which at most ``SHARD`` turns
lie: its subtree is small enough for one task, and nodes from there on belong to one shard alone. Those subtrees are dealt
to shards by a hash. A shard gives its turns dense ids in breadth-first order (children of a node get ids side by side),
packs BASE and CHECK arrays over them, walks each block through the arrays to sum members, and folds subtrees from
the leaves up. Nodes above the chosen prefixes are shared by shards: each gives what it has below them, one
grouping merges them, and the merged nodes add their own share to the nodes above.

The members that end at a node are hashed in order: ids are sorted by range, packed into chunks of at most ``CHUNK`` ids,
and one task streams the chunks of a node through SHA-256, so it holds one chunk at a time.

Defined cases: rows with a null conv_id have no conversation and are left out; null role or text is empty; of rows with equal
conv_id and turn, in the order of a digest of role and text, each is a turn; a conversation whose rebuilt form has no turn ends
at the root; an empty table gives no node; extra columns are left out. A turn is told by the 128 bits of its digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metrifold.llm.common import small_batches, written

BLOCK, SEGMENT, SHARD, CHUNK = 4096, 512, 200_000, 8192
_EMPTY = hashlib.sha256(b"").hexdigest()


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, i, dig, size): turns from 0, in segments of turn numbers, so that a long conversation is sorted by many tasks."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    dig = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.floor(F.col("turn") / SEGMENT).cast("long").alias("seg"), dig.alias("dig"), F.octet_length(text).cast("long").alias("size"))
    rows = rows.withColumn("at", F.row_number().over(Window.partitionBy("conv_id", "seg").orderBy(F.asc_nulls_first("turn"), "dig", "size")))
    before = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("seg")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("conv_id", "seg").agg(F.count("*").alias("n")).select(F.col("conv_id").alias("c"), F.col("seg").alias("s"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    joined = rows.join(offsets, (F.col("conv_id") == F.col("c")) & F.col("seg").eqNullSafe(F.col("s")))
    return joined.select("conv_id", (F.col("offset") + F.col("at") - 1).alias("i"), "dig", "size")


def _head_length(conv_id: Column) -> Column:
    return F.pmod(F.crc32(conv_id.cast("string").cast("binary")), F.lit(9))


def rebuilt(turns: DataFrame, family: int = 5, most: int = 8) -> DataFrame:
    """(conv_id, block, last, digs, sizes): every conversation with its base's head, in packed blocks; none has no block, but one row."""
    base = (F.col("conv_id") - F.col("conv_id") % family).alias("base")
    heads = turns.where((F.col("i") < most) & (F.col("conv_id") % family == 0)).groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("i", "dig", "size"))).alias("head"))
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("own"))
    convs = convs.select("conv_id", base, "own", _head_length(F.col("conv_id")).alias("h")).join(heads, "base", "left")
    convs = convs.withColumn("head", F.slice(F.coalesce("head", F.array().cast("array<struct<i:bigint,dig:binary,size:bigint>>")), F.lit(1), F.col("h").cast("int")))
    convs = convs.withColumn("n_head", F.size("head").cast("long")).withColumn("length", F.col("n_head") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    first = convs.select("conv_id", "length", F.explode_outer("head").alias("x")).where("x is not null or length = 0").select("conv_id", "length", F.coalesce("x.i", F.lit(-1)).alias("at"), "x.dig", "x.size")
    own = turns.join(convs.select("conv_id", "h", "n_head", "length"), "conv_id").where("i >= h").select("conv_id", "length", (F.col("i") - F.col("h") + F.col("n_head")).alias("at"), "dig", "size")
    blocks = first.unionByName(own).groupBy("conv_id", "length", F.floor(F.greatest("at", F.lit(0)) / BLOCK).cast("int").alias("block")).agg(F.array_sort(F.collect_list(F.struct("at", "dig", "size"))).alias("x"))
    kind = pa.schema([("conv_id", pa.int64()), ("block", pa.int32()), ("last", pa.bool_()), ("digs", pa.binary()), ("sizes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {n: [] for n in kind.names}
            for r in batch.to_pylist():
                turns = [x for x in r["x"] if x["at"] >= 0]
                out["conv_id"].append(r["conv_id"])
                out["block"].append(r["block"])
                out["last"].append(r["length"] <= (r["block"] + 1) * BLOCK)
                out["digs"].append(b"".join(x["dig"] for x in turns))
                out["sizes"].append(np.array([x["size"] for x in turns], np.int64).tobytes())
            if out["block"]:
                yield pa.RecordBatch.from_pydict(out, schema=kind)

    return blocks.mapInArrow(run, "conv_id long, block int, last boolean, digs binary, sizes binary")


def _keyed(blocks: DataFrame) -> DataFrame:
    """``blocks`` with the digest ``key`` of all blocks before and ``own``, that of all up to this one."""
    w = Window.partitionBy("conv_id").orderBy("block")
    digests = blocks.select("conv_id", "block", F.md5("digs").alias("d")).withColumn("all", F.collect_list("d").over(w))  # one entry for 4,096 turns
    chained = lambda many: F.aggregate(many, F.lit(""), lambda a, x: F.md5(F.concat(a, x).cast("binary")))
    digests = digests.select("conv_id", "block", chained(F.slice("all", F.lit(1), F.size("all") - 1)).alias("key"), chained(F.col("all")).alias("own"))
    return blocks.join(digests, ["conv_id", "block"])


def _ends(last: DataFrame) -> DataFrame:
    """(key, own, ends): SHA-256 of the sorted decimal ids of the conversations that end there."""
    rows = last.select("key", "own", "conv_id")
    ranged = rows.repartitionByRange("key", "own", "conv_id").sortWithinPartitions("key", "own", "conv_id")
    kind = pa.schema([("key", pa.string()), ("own", pa.string()), ("first", pa.int64()), ("ids", pa.binary())])
    done = pa.schema([("key", pa.string()), ("own", pa.string()), ("ends", pa.string())])

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids = None, []

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"key": [held[0]], "own": [held[1]], "first": [ids[0]], "ids": [",".join(map(str, ids)).encode()]}, schema=kind)

        for batch in batches:
            for key, own, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held != (key, own) or len(ids) == CHUNK:
                    if ids:
                        yield packed()
                    held, ids = (key, own), []
                ids.append(conv)
        if ids:
            yield packed()

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = None, None
        for batch in batches:
            out: dict[str, list] = {n: [] for n in done.names}
            for key, own, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held == (key, own):
                    state.update(b"," + ids)
                    continue
                if held:
                    for name, value in zip(done.names, (*held, state.hexdigest()), strict=True):
                        out[name].append(value)
                held, state = (key, own), hashlib.sha256(ids)
            if out["key"]:
                yield pa.RecordBatch.from_pydict(out, schema=done)
        if held:
            yield pa.RecordBatch.from_pydict({"key": [held[0]], "own": [held[1]], "ends": [state.hexdigest()]}, schema=done)

    packed = ranged.mapInArrow(chunks, "key string, own string, first long, ids binary")
    return packed.repartition("key", "own").sortWithinPartitions("key", "own", "first").mapInArrow(digested, "key string, own string, ends string")


class DoubleArray:
    """A trie of id sequences in BASE and CHECK arrays: the child of slot s by id t is slot BASE[s] + t, if its CHECK is s."""

    def __init__(self, sequences: list[np.ndarray]):
        order = sorted(range(len(sequences)), key=lambda i: sequences[i].tolist())
        rows = [sequences[i] for i in order]
        self.base, self.check = np.zeros(1024, np.int64), np.full(1024, -1, np.int64)
        self.check[0] = 0
        self.parent, self.depth, self.slots = {0: 0}, {0: 0}, [0]
        self.first, self.top = 1, 1  # no slot before the first is free, none from top on is taken
        level = [(0, 0, len(rows))]
        depth = 0
        while level:
            below = []
            for slot, lo, hi in level:
                while lo < hi and len(rows[lo]) == depth:
                    lo += 1
                if lo == hi:
                    continue
                ids = np.array([rows[i][depth] for i in range(lo, hi)])
                cuts = np.flatnonzero(np.diff(ids)) + 1
                starts = np.concatenate([[0], cuts])
                kids = ids[starts]
                base = self._place(kids)
                self.base[slot] = base
                self.check[base + kids] = slot
                self.top = max(self.top, base + int(kids[-1]) + 1)
                for kid, a, b in zip(kids.tolist(), starts.tolist(), [*cuts.tolist(), hi - lo], strict=True):
                    at = base + kid
                    self.parent[at], self.depth[at] = slot, depth + 1
                    self.slots.append(at)
                    below.append((at, lo + a, lo + b))
            level, depth = below, depth + 1

    def _place(self, kids: np.ndarray) -> int:
        """A base with free slots for all ``kids``: one that starts at an early free slot, else behind all that is taken."""
        while self.first < len(self.check) and self.check[self.first] >= 0:
            self.first += 1
        free = np.flatnonzero(self.check[self.first : self.first + 64] < 0) + self.first
        for at in free[:16]:
            need = at - kids[0] + kids
            if need[-1] < len(self.check) and (self.check[need] < 0).all():
                return int(at - kids[0])
        at = max(self.first, self.top)
        need = at + int(kids[-1] - kids[0])
        if need >= len(self.check):
            grown = max(need + 1, 2 * len(self.check))
            self.base = np.concatenate([self.base, np.zeros(grown - len(self.base), np.int64)])
            self.check = np.concatenate([self.check, np.full(grown - len(self.check), -1, np.int64)])
        return int(at - kids[0])

    def step(self, slot: int, kid: int) -> int:
        at = int(self.base[slot]) + kid
        if not 0 <= at < len(self.check) or self.check[at] != slot:
            raise KeyError(kid)
        return at


def _dense(many: list[list[bytes]]) -> list[np.ndarray]:
    """Dense ids of turns, given depth by depth over blocks in sorted order, so that a node's children mostly follow each other."""
    ids: dict[bytes, int] = {}
    active, depth = sorted(many), 0
    while active:
        active = [turns for turns in active if len(turns) > depth]
        for turns in active:
            ids.setdefault(turns[depth], len(ids))
        depth += 1
    return [np.array([ids[t] for t in turns], np.int64) for turns in many]


_NODES = [("node", pa.binary()), ("parent", pa.binary()), ("up_of", pa.binary()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("size", pa.int64()), ("ends_sha256", pa.string()), ("shared", pa.bool_()), ("goes_on", pa.string())]
_NODE_KIND = "node binary, parent binary, up_of binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, size long, ends_sha256 string, shared boolean, goes_on string"


def _subtrees(level: int):
    """Nodes of a shard's blocks, one key's trie after another; what lies at or above a block's chosen prefix is marked shared."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.select(["key", "digs", "sizes", "n", "conv_id", "prefix", "ends", "goes_on", "below_children", "below_leaves", "below_saved"]).to_pylist()
        out: dict[str, list] = {name: [] for name, _ in _NODES}
        by_key: dict[str, list[dict]] = {}
        for r in rows:
            by_key.setdefault(r["key"], []).append(r)
        for key, some in by_key.items():
            _trie(key, some, out)
        return pa.table(out, schema=pa.schema(_NODES))

    def _trie(key: str, rows: list[dict], out: dict[str, list]) -> None:
        many = [[r["digs"][i : i + 16] for i in range(0, len(r["digs"]), 16)] for r in rows]
        ids = _dense(many)
        trie = DoubleArray(ids)
        size = len(trie.check)
        members, least, width, upto = np.zeros(size, np.int64), np.full(size, np.iinfo(np.int64).max), np.zeros(size, np.int64), np.full(size, 1 << 40)
        kids, leaves, saved = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
        ends: dict[int, str] = {}
        goes_on: dict[int, str] = {}
        digest: dict[int, bytes] = {0: key.encode()}
        for r, walk, turns in zip(rows, ids, many, strict=True):
            slot = 0
            sizes = np.frombuffer(r["sizes"], np.int64)
            path = [0]
            for kid, turn in zip(walk.tolist(), turns, strict=True):
                slot = trie.step(slot, kid)
                path.append(slot)
                if slot not in digest:
                    digest[slot] = hashlib.md5(digest[path[-2]] + turn).digest()
            members[path] += r["n"]
            least[path] = np.minimum(least[path], r["conv_id"])
            width[path[1:]] = sizes
            # The node of the chosen prefix and all below are this shard's alone; a block with none is shared throughout.
            own = r["prefix"] if r["prefix"] is not None else len(turns) + 1
            upto[path] = np.minimum(upto[path], own)
            if r["ends"] is not None:
                ends[slot] = r["ends"]
            if r["goes_on"] is not None:
                goes_on[slot] = r["goes_on"]
                kids[slot] += r["below_children"]
                leaves[slot] += r["below_leaves"]
                saved[slot] += r["below_saved"]
        shared = lambda at: trie.depth[at] < upto[at]
        for at in reversed(trie.slots):
            if shared(at):
                continue  # its sums are of what this shard owns below; the rest is added once it is merged
            if not kids[at]:
                leaves[at] = 1
            saved[at] += (members[at] - 1) * width[at] if at else 0
            up = trie.parent[at]
            if at:
                kids[up] += 1
                leaves[up] += leaves[at]
                saved[up] += saved[at]
        for at in reversed(trie.slots):  # what is owned below a shared node counts for the shared nodes above it, too
            if shared(at) and at:
                up = trie.parent[at]
                leaves[up] += leaves[at]
                saved[up] += saved[at]
        for at in trie.slots:
            up = trie.parent[at]
            both = shared(at)
            row = (digest[at] if both or at in goes_on else None, digest[up] if at and both else None, digest[up] if at and not both and shared(up) else None, least[at], trie.depth[at] + level * BLOCK, least[up] if at else None, members[at], kids[at], leaves[at], saved[at], width[at], ends.get(at), bool(both), goes_on.get(at))
            for (name, _), value in zip(_NODES, row, strict=True):
                out[name].append(value if value is None or isinstance(value, (bytes, str, bool)) else int(value))

    return run


def _level(blocks: DataFrame, level: int, below: DataFrame | None, ends: DataFrame) -> DataFrame:
    """The nodes of one level of blocks: roots (depth level * BLOCK) are shared nodes without a parent."""
    rows = blocks.groupBy("key", "own", "digs").agg(F.first("sizes").alias("sizes"), F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), F.max(F.when(~F.col("last"), F.col("own"))).alias("goes_on")).join(ends, ["key", "own"], "left")
    if below is None:
        rows = rows.withColumns({c: F.lit(0).cast("long") for c in ("below_children", "below_leaves", "below_saved")})
    else:
        rows = rows.join(below.select(F.col("key").alias("goes_on"), "below_children", "below_leaves", "below_saved"), "goes_on", "left")
    rows = written(rows, f"trie-blocks-{level}")
    kind = pa.schema([("key", pa.string()), ("own", pa.string()), ("turns", pa.int64()), ("prefix", pa.int32()), ("digest", pa.binary())])

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {n: [] for n in kind.names}
            for key, own, digs in zip(*(batch.column(c).to_pylist() for c in ("key", "own", "digs")), strict=True):
                turns, p = len(digs) // 16, 1
                while p <= turns:
                    for name, value in zip(kind.names, (key, own, turns, p, hashlib.md5(digs[: 16 * p]).digest()), strict=True):
                        out[name].append(value)
                    p *= 2
            if out["key"]:
                yield pa.RecordBatch.from_pydict(out, schema=kind)

    each = rows.select("key", "own", "digs").mapInArrow(prefixes, "key string, own string, turns long, prefix int, digest binary")
    # Prefixes with more below them are few (thirteen for each SHARD turns at most); the others need no join partner.
    heavy = written(each.groupBy("key", "prefix", "digest").agg(F.sum("turns").alias("turns")).where(F.col("turns") > SHARD).drop("turns"), f"trie-heavy-{level}")
    chosen = each.drop("turns").join(heavy, ["key", "prefix", "digest"], "left_anti").groupBy("key", "own").agg(F.min(F.struct("prefix", "digest")).alias("x")).select("key", "own", "x.prefix", "x.digest")
    turns = rows.agg(F.coalesce(F.sum(F.octet_length("digs")), F.lit(0))).first()[0] // 16
    shards = 1 + 2 * turns // SHARD
    dealt = rows.join(chosen, ["key", "own"], "left").withColumn("shard", F.pmod(F.xxhash64("key", F.coalesce("digest", F.unhex("own"))), F.lit(shards)))
    return written(dealt.groupBy("shard").applyInArrow(_subtrees(level), _NODE_KIND), f"trie-nodes-{level}")


def _merged(nodes: DataFrame) -> DataFrame:
    """Shared nodes of a level, each once, with what all shards and the shared nodes below give it."""
    shared = nodes.where("shared")
    once = shared.groupBy("node").agg(F.first("parent", ignorenulls=True).alias("parent"), F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"), F.first("size").alias("size"), F.max("ends_sha256").alias("ends_sha256"), F.max("goes_on").alias("goes_on"))
    once = written(once, "trie-shared")
    kids = once.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("more"))
    once = once.join(kids, "node", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0))).drop("more")
    # A shared node's own share, and itself if it is a leaf, go to all shared nodes above it, over paths that double.
    own = once.select("node", "parent", F.when(F.col("depth") > 0, (F.col("n_convs") - 1) * F.col("size")).otherwise(F.lit(0)).alias("saved"), (F.col("n_children") == 0).cast("long").alias("leaf"))
    gain, jump = own.select("node", "saved", "leaf"), own.select("node", "parent")
    rounds = once.where("parent is not null").agg(F.coalesce(F.max("depth") - F.min("depth") + 1, F.lit(0))).first()[0]
    for _ in range(int(rounds).bit_length()):
        up = gain.join(jump.where("parent is not null"), "node").groupBy(F.col("parent").alias("node")).agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf"))
        gain = written(gain.unionByName(up).groupBy("node").agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf")), "trie-gain")
        jump = written(jump.alias("a").join(jump.select(F.col("node").alias("parent"), F.col("parent").alias("next")), "parent", "left").select("node", F.col("next").alias("parent")), "trie-jump")
    above = once.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = once.join(gain.withColumnRenamed("saved", "more_saved"), "node").join(above, "parent", "left")
    return out.withColumns({"n_leaves": F.col("n_leaves") + F.col("leaf"), "saved_tokens": F.col("saved_tokens") + F.col("more_saved")}).drop("leaf", "more_saved")


_COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row for each node of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = conversations.sparkSession
    small_batches(spark)
    turns = written(numbered(conversations), "trie-turns")
    blocks = written(_keyed(written(rebuilt(turns), "trie-rebuilt")), "trie-keyed")
    ends = written(_ends(blocks.where("last")), "trie-ends")
    top = blocks.agg(F.max("block")).first()[0]
    below, parts, roots = None, [], None
    for level in range(top if top is not None else -1, -1, -1):
        nodes = _level(blocks.where(F.col("block") == level), level, below, ends)
        shared = written(_merged(nodes), f"trie-merged-{level}")
        own = nodes.where("not shared").join(shared.select(F.col("node").alias("up_of"), F.col("conv_id").alias("up_conv")), "up_of", "left").withColumn("parent_conv_id", F.coalesce("up_conv", "parent_conv_id"))
        if roots is not None:  # the first nodes of the level below hang on this level's last ones
            last = shared.select("goes_on", "conv_id").unionByName(own.select("goes_on", "conv_id")).where("goes_on is not null").select(F.col("goes_on").alias("key"), F.col("conv_id").alias("above"))
            parts[-1] = parts[-1].join(roots.join(last, "key").select("root_conv", "root", "above"), "root", "left").withColumn("parent_conv_id", F.coalesce("above", "parent_conv_id"))
        first = shared.where(F.col("depth") == level * BLOCK)
        below = first.select(F.col("node").cast("string").alias("key"), F.col("n_children").alias("below_children"), F.col("n_leaves").alias("below_leaves"), F.col("saved_tokens").alias("below_saved"))
        roots = first.select(F.col("node").cast("string").alias("key"), F.col("node").alias("root"), F.col("conv_id").alias("root_conv"))
        kept = shared if level == 0 else shared.where(F.col("depth") > level * BLOCK)
        parts.append(kept.select(*_COLUMNS, F.col("parent").alias("root")).unionByName(own.select(*_COLUMNS, F.col("up_of").alias("root"))))
    if not parts:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    out = parts[0].select(*_COLUMNS)
    for p in parts[1:]:
        out = out.unionByName(p.select(*_COLUMNS))
    return out.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_EMPTY)))
