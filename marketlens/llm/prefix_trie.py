"""The trie of conversation prefixes, from sorted rows and sparse tables over their LCPs.

Conversations are rebuilt, cut into segments of at most ``SEGMENT`` turns, and sorted so
that equal beginnings stand together.  A block of the sorted list knows the length of the
longest common prefix (LCP) of each row with the row before it.  A prefix of depth d at a
row belongs to all rows around it between which no LCP is less than d.  A sparse table
holds the least LCP of every run of 2^k rows, so each prefix finds its left and its right
end by a binary search of its own, and its members are an interval.  All figures of a node
are sums or minima over its interval:

- a row that no next row goes on from, nor equals, is a leaf; leaves add up;
- the words that a row has in common with the row before it, less those above the node,
  are what the node's subtree saves by storing that row's prefix once;
- the rows that end at the node are the first of its interval, in the order of their ids.

No task holds more than a block of rows.  Only the prefixes at a block's edges can go on in
another block; their parts are added up by the prefix's key.  A conversation's later
segments are rows of their own, sorted by what comes before them, so a conversation of any
length is spread over many tasks; what its later segments add to the nodes of earlier ones
is a sum from the back.  Turns enter as digests, so texts are read once and never shuffled.
The key of a prefix is the sum of the digests of its turns with their positions, which
prefix sums find for every segment without going through the conversation in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions.ranking import in_ranges, ranges_of, running_sum
from marketlens.llm.common import WORD, materialise, prefix_sums, text_of

#: A conversation takes its first turns from the first conversation of its family of so many ids.
FAMILY = 20
#: At most so many turns less one are taken, by a checksum of the id.
HEADS = 4
#: Turns of a conversation in one row.
SEGMENT = 256
#: Rows of a block at most.
BLOCK = 4096
#: Rows that a task sorts, on average, and the least number of tasks.
ROWS = 262_144
RANGES = 8
#: Segments of a conversation that are added up in one window.
SEGMENTS = 1024


def rebuild(turns: DataFrame, conv: str, turn: str, role: str, text: str, rows_per_range: int) -> tuple[DataFrame, DataFrame]:
    """(_conv, _pos, _turn, _words) of every rebuilt turn, and (_conv, _n) with the turns of every conversation."""
    said, who = text_of(text), text_of(role)
    digest = F.sha2(F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, said), 256)
    light = turns.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("_conv"), F.col(turn).alias("_at"), digest.alias("_turn"),
                                                        F.regexp_count(said, F.lit(WORD)).cast("long").alias("_words"), F.lit(1).cast("long").alias("_one"))
    light = materialise(light)
    numbered = running_sum(light, ["_conv"], [("_at", True), ("_turn", True)], "_one", "_nth", ranges=max(RANGES, ranges_of(light, rows_per_range)))
    numbered = materialise(numbered.select("_conv", "_nth", "_turn", "_words"))
    heads = F.crc32(F.col("_conv").cast("string").cast("binary")) % HEADS
    family = F.col("_conv") - F.col("_conv") % FAMILY
    convs = numbered.groupBy("_conv").agg(F.count("*").alias("_own")).select("_conv", "_own", heads.alias("_h"), family.alias("_family"))
    first = numbered.where((F.col("_nth") < HEADS) & (F.col("_conv") == family)).select(F.col("_conv").alias("_family"), "_nth", "_turn", "_words")
    taken = materialise(convs.where("_h > 0").join(first, "_family").where("_nth <= _h").select("_conv", F.col("_nth").alias("_pos"), "_turn", "_words"))
    convs = materialise(convs.join(taken.groupBy("_conv").agg(F.count("*").alias("_taken")), "_conv", "left").fillna(0, ["_taken"]))
    # most conversations find as many turns as they look for
    short = convs.where("_taken < _h").select("_conv", "_taken")
    own = numbered.where(F.col("_nth") > heads).join(short, "_conv", "left")
    own = own.select("_conv", (F.col("_nth") - heads + F.coalesce("_taken", heads)).alias("_pos"), "_turn", "_words")
    return taken.unionByName(own), convs.select("_conv", (F.col("_taken") + F.greatest(F.col("_own") - F.col("_h"), F.lit(0))).alias("_n"))


def segments(rebuilt: DataFrame, convs: DataFrame, size: int) -> DataFrame:
    """(_conv, _seg, _before, _turns, _words, _on) of every segment, and one empty segment of every conversation without turns.

    _turns are 12-byte digests of turns with their positions; _before is the sum of those of
    earlier segments; _on tells that the conversation goes on behind the segment.
    """
    mixed = F.substring(F.sha2(F.concat(F.col("_pos").cast("string"), F.lit(":"), F.col("_turn")), 256), 1, 24)
    number = lambda x: F.conv(x, 16, 10).cast("decimal(38,0)")
    amount = (number(F.substring("_hash", 1, 12)) * F.lit(1 << 48).cast("decimal(16,0)") + number(F.substring("_hash", 13, 12))).cast("decimal(38,0)")
    rows = rebuilt.withColumn("_hash", mixed).withColumn("_seg", F.expr(f"(_pos - 1) div {size}"))
    one = F.struct("_pos", F.unhex("_hash").alias("turn"), "_words")
    cut = rows.withColumn("_amount", amount).groupBy("_conv", "_seg").agg(F.array_sort(F.collect_list(one)).alias("_all"), F.sum("_amount").alias("_sum"))
    cut = cut.select("_conv", "_seg", "_sum", F.col("_all.turn").alias("_turns"), F.col("_all._words").alias("_words"))
    long = convs.where(F.col("_n") > size).select("_conv", "_n")
    cut = materialise(cut.join(long, "_conv", "left").withColumn("_on", F.coalesce((F.col("_seg") + 1) * size < F.col("_n"), F.lit(False))))
    zero = F.lit(0).cast("decimal(38,0)")
    out = ["_conv", "_seg", "_before", "_turns", "_words", "_on"]
    many = cut.where("_n is not null").withColumn("_part", F.expr(f"_seg div {SEGMENTS}"))
    summed = prefix_sums(many.select("_conv", "_seg", "_part", "_sum"), ["_conv"], "_part", ["_seg"], "_sum", "_b", kind="decimal(38,0)")
    later = many.join(summed.select("_conv", "_seg", F.col("_b").alias("_before")), ["_conv", "_seg"]).select(out)
    none = convs.where("_n = 0").select("_conv", F.lit(0).cast("long").alias("_seg"), zero.alias("_before"), F.array().cast("array<binary>").alias("_turns"),
                                        F.array().cast("array<bigint>").alias("_words"), F.lit(False).alias("_on"))
    return cut.where("_n is null").withColumn("_before", zero).select(out).unionByName(later).unionByName(none)


def edges(rows: DataFrame) -> DataFrame:
    """(_block, _prev, _next): the last row before and the first row behind every block."""
    key = F.struct("_seg", "_before", "_turns")
    ends = materialise(rows.groupBy("_block").agg(F.min_by(key, "__nth").alias("_first"), F.max_by(key, "__nth").alias("_last")))
    # numbers of blocks have gaps; this window sees one number for each block
    place = ends.select("_block", F.row_number().over(Window.orderBy("_block")).alias("_place"))
    ends = ends.join(place, "_block")
    prev = ends.select((F.col("_place") + 1).alias("_place"), F.col("_last").alias("_prev"))
    following = ends.select((F.col("_place") - 1).alias("_place"), F.col("_first").alias("_next"))
    return ends.select("_block", "_place").join(prev, "_place", "left").join(following, "_place", "left").select("_block", "_prev", "_next")


def common(a: list, b: list) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


class Sparse:
    """Least values of all runs of 2^k entries."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 << len(self.levels) - 1 <= len(values):
            half = 1 << len(self.levels) - 1
            low = self.levels[-1]
            self.levels.append(np.minimum(low[:-half], low[half:]))

    def least(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The least value from ``left`` to ``right``, both inclusive."""
        k = np.frexp((right - left + 1).astype(np.float64))[1] - 1
        out = np.empty(len(left), self.levels[0].dtype)
        for level in np.unique(k):
            at = k == level
            out[at] = np.minimum(self.levels[level][left[at]], self.levels[level][right[at] - (1 << int(level)) + 1])
        return out

    def right_end(self, at: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The last row that can be reached from ``at`` over values of at least ``depth``."""
        at = at.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            fits = at + 1 < len(level)
            go = fits & (level[np.where(fits, at + 1, 0)] >= depth)
            at[go] += 1 << k
        return at

    def left_end(self, at: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The first row that can be reached from ``at`` over values of at least ``depth``."""
        at = at.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            level, start = self.levels[k], at - (1 << k) + 1
            fits = start >= 0
            go = fits & (level[np.where(fits, start, 0)] >= depth)
            at[go] -= 1 << k
        return at


class Block:
    """The rows of one block in order, and the LCP of each with the row before it.

    The LCP counts turns of the segment; it is -1 where two rows have not even the same
    turns before their segments.
    """

    def __init__(self, rows: pa.Table, near: pa.Table):
        rows = self.rows = rows.sort_by("__nth")
        self.conv = rows["_conv"].to_numpy()
        self.seg = rows["_seg"].to_numpy()
        self.before = rows["_before"].to_pylist()
        self.turns = rows["_turns"].to_pylist()
        self.on = rows["_on"].to_numpy(zero_copy_only=False)
        self.words = rows["_words"].to_pylist()
        edge = near.to_pylist()[0]
        keys = [(s, b, t) for s, b, t in zip(self.seg.tolist(), self.before, self.turns)]
        around = [k and (k["_seg"], k["_before"], k["_turns"]) for k in (edge["_prev"], edge["_next"])]

        def lcp(a, b) -> int:
            return common(a[2], b[2]) if a and b and a[:2] == b[:2] else -1

        n = len(keys)
        self.size = np.fromiter(map(len, self.turns), np.int64, n)
        self.lcp = np.array([lcp(around[0], keys[0])] + [lcp(a, b) for a, b in zip(keys, keys[1:])], np.int64)
        follows = np.append(self.lcp[1:], lcp(keys[-1], around[1]))
        #: words of the first k turns of each row's segment
        self.upto = [np.concatenate(([0], np.cumsum(w, dtype=np.int64))) for w in self.words]
        self.shared = np.fromiter((u[max(k, 0)] for u, k in zip(self.upto, self.lcp.tolist())), np.int64, n)
        self.leaf = (~self.on & (follows < self.size)).astype(np.int64)


def row_figures(rows: pa.Table, near: pa.Table) -> pa.Table:
    """Of every row: whether it is a leaf, and its words in common with the row before it."""
    b = Block(rows, near)
    return pa.table({"_conv": b.conv, "_seg": b.seg, "_leaf": b.leaf, "_shared": b.shared})


NODES = "_depth long, _key binary, _parent binary, _n long, _low long, _leaves long, _saved long, _ends binary, _sha string, _edge boolean, _block long"


def node_finder(size: int):
    def nodes(rows: pa.Table, near: pa.Table) -> pa.Table:
        """Every prefix of the block's rows once, with the figures of its interval in the block."""
        number = rows["_block"][0].as_py()
        b = Block(rows, near)
        deeper_leaves, deeper_saved = b.rows["_more_leaves"].to_numpy(), b.rows["_more_saved"].to_numpy()
        n = len(b.conv)
        lcp = b.lcp.copy()
        lcp[0] = -1  # a block begins anew; parts of a prefix meet by their keys
        # a prefix is a candidate where it is not that of the row before; the empty one only in the first segment
        begin = np.where(lcp < 0, np.where(b.seg == 0, 0, 1), lcp + 1)
        count = b.size - begin + 1
        at = np.repeat(np.arange(n), count)
        depth = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin, count)
        table = Sparse(lcp)
        left, right = table.left_end(at, depth), table.right_end(at, depth)
        low = Sparse(b.conv).least(left, right)
        total = lambda x: np.concatenate(([0], np.cumsum(x)))
        within = lambda sums, a, z: sums[z + 1] - sums[a]
        leaves = within(total(b.leaf + deeper_leaves), left, right)
        goes_on = (left == 0) & (b.lcp[0] >= depth)
        above = np.fromiter((b.upto[i][max(d - 1, 0)] for i, d in zip(at.tolist(), depth.tolist())), np.int64, len(at))
        first = left + ~goes_on  # the first row of a node saves nothing
        saved = within(total(b.shared), first, right) - (right - first + 1) * above + within(total(deeper_saved), left, right)
        # rows that end at a node are the first ones of its interval
        same = np.zeros(n, bool)
        same[1:] = (lcp[1:] == b.size[1:]) & (b.size[1:] == b.size[:-1]) & ~b.on[1:]
        stop = np.append(np.flatnonzero(~same), n)
        run_end = stop[np.searchsorted(stop, np.arange(n), "right")]
        ends, shas = [], []
        names = [str(c).encode() for c in b.conv.tolist()]
        keys, parents = [], []
        sums: list[int] = []
        last = -1
        for i, d, g in zip(at.tolist(), depth.tolist(), goes_on.tolist()):
            if i != last:
                run = int(b.before[i])
                sums = [run]
                for t in b.turns[i]:
                    run += int.from_bytes(t, "big")
                    sums.append(run)
                last = i
            keys.append(sums[d].to_bytes(16, "big"))
            parents.append(sums[d - 1].to_bytes(16, "big") if d or b.seg[i] else None)
            ids = b",".join(names[i:run_end[i]]) if d == b.size[i] and not b.on[i] else b""
            cut = ids and (g or run_end[i] == n)
            ends.append(ids if cut else None)
            shas.append(hashlib.sha256(ids).hexdigest() if ids and not cut else None)
        return pa.table({"_depth": depth + size * b.seg[at], "_key": pa.array(keys, pa.binary()), "_parent": pa.array(parents, pa.binary()),
                         "_n": right - left + 1, "_low": low, "_leaves": leaves, "_saved": saved, "_ends": pa.array(ends, pa.binary()),
                         "_sha": pa.array(shas, pa.string()), "_edge": goes_on | (right == n - 1), "_block": np.full(len(at), number)})

    return nodes


def hash_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_depth, _key, _sha) from the parts of the nodes' ends, sorted by node and place; a part at a time is in memory."""
    now, digest = None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"_depth": pa.array([now[0]], pa.int64()), "_key": pa.array([now[1]], pa.binary()), "_sha": pa.array([digest.hexdigest()])})

    for batch in batches:
        for depth, key, part in zip(*(batch.column(c).to_pylist() for c in ("_depth", "_key", "_ends"))):
            if (depth, key) != now:
                if now:
                    yield done()
                now, digest = (depth, key), hashlib.sha256(part)
            else:
                digest.update(b"," + part)
    if now:
        yield done()


def later_figures(rows: DataFrame, near: DataFrame) -> DataFrame:
    """(_conv, _seg, _more_leaves, _more_saved): what later segments of a conversation add to the nodes of an earlier one."""
    many = materialise(rows.where("_on").select("_conv").distinct())
    if many.isEmpty():
        return rows.sparkSession.createDataFrame([], "_conv long, _seg long, _more_leaves long, _more_saved long")
    figures = in_blocks(rows, near, row_figures, "_conv long, _seg long, _leaf long, _shared long").join(many, "_conv", "left_semi")
    more = materialise(figures.withColumn("_part", F.expr(f"_seg div {SEGMENTS}")))
    for value, out in (("_leaf", "_more_leaves"), ("_shared", "_more_saved")):
        summed = prefix_sums(more, ["_conv"], "_part", ["_seg"], value, "_b", total="_t")
        more = summed.withColumn(out, (F.col("_t") - F.col("_b") - F.col(value)).cast("long")).drop("_b", "_t")
    return more.select("_conv", "_seg", "_more_leaves", "_more_saved")


def in_blocks(rows: DataFrame, near: DataFrame, fn, schema: str) -> DataFrame:
    return rows.groupBy("_block").cogroup(near.groupBy("_block")).applyInArrow(fn, schema)


def trie(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", segment: int = SEGMENT,
         block: int = BLOCK, rows_per_range: int = ROWS) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A null role or text is empty, and a null turn comes first.  Turns of a conversation with
    the same number stand in the order of the digests of role and text, so repeated rows are
    turns one after the other and reruns agree.  Rows without a conv_id belong to no
    conversation and are left out.  Texts of any length enter as their digest and their
    number of words.  An empty table has no node, not even the root.  Other columns are not
    read.
    """
    rebuilt, convs = rebuild(turns, conv, turn, role, text, rows_per_range)
    rows = materialise(segments(rebuilt, convs, segment))
    order = [("_seg", True), ("_before", True), ("_turns", True), ("_on", True), ("_conv", True)]
    rows = in_ranges(rows, order, n=max(RANGES, ranges_of(rows, rows_per_range))).withColumn("_block", F.col("__range") * (1 << 32) + F.expr(f"__nth div {block}"))
    near = materialise(edges(rows))
    rows = rows.join(later_figures(rows, near), ["_conv", "_seg"], "left").fillna(0, ["_more_leaves", "_more_saved"])
    found = materialise(in_blocks(rows, near, node_finder(segment), NODES))
    key = ["_depth", "_key"]
    parts = found.where("_edge")
    joined = parts.groupBy(*key).agg(F.first("_parent").alias("_parent"), F.sum("_n").alias("_n"), F.min("_low").alias("_low"),
                                     F.sum("_leaves").alias("_leaves"), F.sum("_saved").alias("_saved"), F.max("_sha").alias("_sha"))
    streamed = (parts.where("_ends is not null").select(*key, "_block", "_ends").repartition(*key).sortWithinPartitions(*key, "_block")
                .select(*key, "_ends").mapInArrow(hash_runs, "_depth long, _key binary, _sha string"))
    joined = joined.join(streamed.withColumnRenamed("_sha", "_long"), key, "left").withColumn("_sha", F.coalesce("_long", "_sha"))
    columns = [*key, "_parent", "_n", "_low", "_leaves", "_saved", "_sha"]
    nodes = materialise(found.where("not _edge").select(columns).unionByName(joined.select(columns)))
    children = nodes.where("_parent is not null").groupBy((F.col("_depth") - 1).alias("_depth"), F.col("_parent").alias("_key")).agg(F.count("*").alias("_children"))
    parents = nodes.select((F.col("_depth") + 1).alias("_depth"), F.col("_key").alias("_parent"), F.col("_low").alias("_above"))
    out = nodes.join(children, key, "left").join(parents, ["_depth", "_parent"], "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select(F.col("_low").alias("conv_id"), F.col("_depth").alias("depth"), F.col("_above").alias("parent_conv_id"), F.col("_n").alias("n_convs"),
                      zero_if_none("_children").alias("n_children"), F.col("_leaves").alias("n_leaves"), F.col("_saved").alias("saved_tokens"),
                      F.coalesce("_sha", F.lit(none)).alias("ends_sha256"))


def zero_if_none(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0)).cast("long")
