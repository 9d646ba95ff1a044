"""Mixing sources to target weights by a min-cost flow.

A document may belong to several sources.  Spark adds up the sizes by membership pattern.
The flow network has an arc from each pattern's supply, its size once for each repetition at
a cost that rises with the repetition, through the pattern to its sources and on to their
quotas.  The cheapest full flow says how many words each pattern gives.  Within a pattern
all documents are taken equally often, and one time more those that come first in a seeded
hash order, up to the pattern's remaining words.

Targets are found in Spark: the level up to which all sources fill is a prefix sum over the
sources in the order in which they are full.  A source whose documents are in no other
source is a network of its own, with one pattern and one way to flow: it gives its quota.
Sources that share documents are joined into connected sets, and each set is solved by
itself, in a task.

The last step is a threshold on the hash, so the choice is a map over the documents, joined
to one row per pattern: broadcast if there are at most ``FEW_PATTERNS``, else with the rows
of a pattern spread over many tasks.  The threshold is found from sums over 4,096 hash
ranges per pattern and the rows of one range, so a source with a third of all documents is
no task of its own.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions.ranking import running_sum
from marketlens.llm.common import WORD, connected, join_spread, materialise, text_of

#: Weights of the sources in code point order, repeated.
WEIGHTS = (1, 2, 3)
MAX_REPEAT = 3
SEED = "mix"
#: Up to so many patterns, of some hundred bytes each, the table of patterns is broadcast.
FEW_PATTERNS = 100_000


class Network:
    """A flow network; arcs are numbered in pairs, an arc and its reverse."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.head: list[int] = []
        self.room: list[int] = []

    def arc(self, a: int, b: int, room: int) -> int:
        self.out[a].append(len(self.head))
        self.out[b].append(len(self.head) + 1)
        self.head += [b, a]
        self.room += [room, 0]
        return len(self.head) - 2

    def levels(self, source: int) -> list[int]:
        """The number of arcs with room from ``source`` to each node; -1 where there is no way."""
        level = [-1] * len(self.out)
        level[source], queue = 0, deque([source])
        while queue:
            u = queue.popleft()
            for e in self.out[u]:
                if self.room[e] and level[self.head[e]] < 0:
                    level[self.head[e]] = level[u] + 1
                    queue.append(self.head[e])
        return level

    def fill(self, source: int, sink: int) -> None:
        """Send as much more as can be sent, along shortest ways in rounds."""
        while (level := self.levels(source))[sink] >= 0:
            at = [0] * len(self.out)
            path: list[int] = []
            u = source
            while True:
                if u == sink:
                    amount = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= amount
                        self.room[e ^ 1] += amount
                    first = next(i for i, e in enumerate(path) if not self.room[e])
                    u = self.head[path[first] ^ 1]
                    del path[first:]
                while at[u] < len(self.out[u]):
                    e = self.out[u][at[u]]
                    if self.room[e] and level[self.head[e]] == level[u] + 1:
                        break
                    at[u] += 1
                if at[u] < len(self.out[u]):
                    path.append(self.out[u][at[u]])
                    u = self.head[path[-1]]
                elif path:
                    u = self.head[path.pop() ^ 1]
                    at[u] += 1
                else:
                    break


def route(patterns: dict, quotas: dict, max_repeat: int) -> dict:
    """Words that each pattern gives so that the sources get their quotas at the least cost of repetition.

    Only the supply arcs cost anything, and no way back through the source can pay.  So the
    cheapest full flow sends all it can with the first repetition's arcs, then adds those of
    the second, and so on: what no way was left for stays without one when dearer arcs come.
    """
    at = {s: 2 + len(patterns) + i for i, s in enumerate(quotas)}
    net = Network(2 + len(patterns) + len(quotas))
    for i, (p, n) in enumerate(patterns.items()):
        for s in p:
            net.arc(2 + i, at[s], max_repeat * n)
    for s, quota in quotas.items():
        net.arc(at[s], 1, quota)
    supplies = []
    for _ in range(max_repeat):
        supplies.append([net.arc(0, 2 + i, n) for i, n in enumerate(patterns.values())])
        net.fill(0, 1)
    return {p: sum(net.room[arcs[i] ^ 1] for arcs in supplies) for i, p in enumerate(patterns)}


def members(docs: DataFrame, source_col: str) -> Column:
    """The sources of a row as a sorted array without repetitions, in JSON."""
    kind = docs.schema[source_col].dataType.typeName()
    names = F.col(source_col) if kind == "array" else F.array(F.col(source_col).cast("string"))
    return F.to_json(F.array_sort(F.array_distinct(F.coalesce(names, F.array(F.lit(None).cast("string"))))))


def ticket(id_col: str, seed: str) -> Column:
    """The seeded order of documents."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> DataFrame:
    """(_id, _members, _size, _ticket) of every row."""
    return docs.select(F.col(id_col).alias("_id"), members(docs, source_col).alias("_members"),
                       F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long").alias("_size"), ticket(id_col, seed).alias("_ticket"))


def targets(sources: DataFrame, total: int, weights, max_repeat: int) -> DataFrame:
    """(s, k, size, target, quota) of ``sources`` (s, size); k is the place in code point order, null last.

    Targets are in proportion to the weights and add up to ``total``; none is above
    ``max_repeat`` times its source's size, and what a full source cannot take is shared again
    by weight among the others.
    """
    placed = running_sum(sources.withColumns({"_one": F.lit(1).cast("long"), "_null": F.col("s").isNull()}), [], [("_null", True), ("s", True)], "_one", "k")
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), ((F.col("k") - 1) % len(weights) + 1).cast("int"))
    # the level at which a source is full, and what is left for a source and all that are full later
    rows = materialise(placed.withColumn("w", weight).withColumn("_full", (F.lit(max_repeat) * F.col("size")).cast("double") / F.col("w")))
    order = [("_full", True), ("k", True)]
    summed = running_sum(running_sum(rows, [], order, "size", "_sizes"), [], order, "w", "_weights")
    every = rows.agg(F.sum("w")).first()[0] or 0
    rest = F.lit(total) - max_repeat * (F.col("_sizes") - F.col("size"))
    level = rest.cast("double") / (F.lit(every) - F.col("_weights") + F.col("w")).cast("double")
    levelled = materialise(summed.withColumn("_level", level))
    open_ = levelled.where(~(F.col("w") * F.col("_level") > max_repeat * F.col("size")))
    # the first source that is not full sets the level for itself and for all that follow
    first = open_.agg(F.min(F.struct("_full", "k", "_level")).alias("_at")).first()
    full = (F.lit(max_repeat) * F.col("size")).cast("double")
    if first is None or first["_at"] is None:
        target = full
    else:
        at = first["_at"]
        before = (F.col("_full") < at["_full"]) | (F.col("_full") == at["_full"]) & (F.col("k") < at["k"])
        target = F.when(before, full).otherwise(F.col("w") * F.lit(at["_level"]))
    out = levelled.withColumn("target", target)
    return out.select("s", "k", "size", "target", F.floor(F.col("target") + 0.5).cast("long").alias("quota"))


def solver(max_repeat: int):
    def solve(set_: pd.DataFrame) -> pd.DataFrame:
        """The words that the patterns of one connected set of sources give."""
        quotas: dict = {}
        patterns = {}
        for ks, qs, n in zip(set_["_ks"], set_["_quotas"], set_["n"]):
            patterns[tuple(ks)] = int(n)
            quotas.update(zip(ks, map(int, qs)))
        given = route(patterns, {k: quotas[k] for k in sorted(quotas)}, max_repeat)
        return pd.DataFrame({"_members": set_["_members"], "_given": [given[tuple(ks)] for ks in set_["_ks"]]})

    return solve


def plan(rows: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """One row per membership pattern: _members, _sizes and _targets of its sources, _times, _cut.

    A document of the pattern is taken _times times, and once more if its ticket is at most _cut.
    """
    patterns = materialise(rows.groupBy("_members").agg(F.sum("_size").alias("n")))
    total = patterns.agg(F.sum("n")).first()[0] or 0
    apart = patterns.select("_members", "n", F.posexplode(F.from_json("_members", "array<string>")).alias("_i", "s"))
    goals = materialise(targets(apart.groupBy("s").agg(F.sum("n").alias("size")), total, weights, max_repeat))
    both = apart.alias("a").join(goals.alias("g"), F.col("a.s").eqNullSafe(F.col("g.s"))).select("_members", "n", "_i", "k", "size", "target", "quota")
    by_pattern = both.groupBy("_members", "n").agg(F.array_sort(F.collect_list(F.struct("_i", "k", "size", "target", "quota"))).alias("_all"))
    by_pattern = materialise(by_pattern.select("_members", "n", F.col("_all.size").alias("_sizes"), F.col("_all.target").alias("_targets"),
                                               F.col("_all.k").alias("_ks"), F.col("_all.quota").alias("_quotas")))
    # sources that share documents are connected; all others give their quota
    alone = by_pattern.select("_members", "_sizes", "_targets", "n", F.least(F.col("_quotas")[0], max_repeat * F.col("n")).alias("_given"))
    shared = by_pattern.where(F.size("_ks") > 1)
    if not shared.isEmpty():
        pairs = shared.select(F.col("_ks")[0].alias("a"), F.explode(F.expr("slice(_ks, 2, size(_ks) - 1)")).alias("b"))
        sets = materialise(connected(materialise(pairs)))
        joined = by_pattern.join(sets, F.col("_ks")[0] == F.col("node")).select("root", "_members", "n", "_ks", "_quotas")
        solved = joined.groupBy("root").applyInPandas(solver(max_repeat), "_members string, _given long")
        alone = (alone.withColumnRenamed("_given", "_alone").join(solved, "_members", "left").withColumn("_given", F.coalesce("_given", "_alone")))
    table = materialise(alone.withColumn("_times", F.expr("if(n = 0, 0L, _given div n)")).withColumn("_rest", F.col("_given") - F.col("_times") * F.col("n")))
    return materialise(table.join(thresholds(rows, table), "_members", "left").select("_members", "_sizes", "_targets", "_times", "_cut"))


def few(table: DataFrame) -> bool:
    """Whether a table of at most one row per pattern is small enough to be broadcast."""
    return table.limit(FEW_PATTERNS + 1).count() <= FEW_PATTERNS


def thresholds(rows: DataFrame, table: DataFrame) -> DataFrame:
    """(_members, _cut): the largest ticket that is within the pattern's remaining words."""
    small = table.where("_rest > 0").select("_members", "_rest")
    hint = F.broadcast if few(small) else lambda df: df
    before = (Window.unboundedPreceding, -1)
    ranges = rows.withColumn("_range", F.substring("_ticket", 1, 3)).groupBy("_members", "_range").agg(F.sum("_size").alias("_n"))
    start = F.coalesce(F.sum("_n").over(Window.partitionBy("_members").orderBy("_range").rowsBetween(*before)), F.lit(0))
    edge = (ranges.withColumn("_start", start).join(hint(small), "_members").where("_start <= _rest and _rest < _start + _n")
            .select("_members", "_range", "_start", "_rest"))
    # one range per pattern
    inside = (rows.withColumn("_range", F.substring("_ticket", 1, 3)).join(hint(edge), ["_members", "_range"])
              .groupBy("_members", "_range", "_start", "_rest", "_ticket").agg(F.sum("_size").alias("_n")))
    at = F.col("_start") + F.coalesce(F.sum("_n").over(Window.partitionBy("_members").orderBy("_ticket").rowsBetween(*before)), F.lit(0))
    # a ticket is taken if its middle is within the rest; if none is, all earlier ranges are
    taken = F.when(2 * F.col("_at") + F.col("_n") <= 2 * F.col("_rest"), F.col("_ticket")).otherwise(F.col("_range"))
    return inside.withColumn("_at", at).groupBy("_members").agg(F.max(taken).alias("_cut"))


def attach(rows: DataFrame, table: DataFrame) -> DataFrame:
    """``rows`` with the plan of their pattern."""
    if few(table):
        return rows.join(F.broadcast(table), "_members")
    return join_spread(rows, table, "_members", F.xxhash64("_ticket"))


def repeats(ticket_col: Column) -> Column:
    return F.col("_times") + F.coalesce(ticket_col <= F.col("_cut"), F.lit(False)).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS,
        max_repeat: int = MAX_REPEAT, seed: str = SEED) -> DataFrame:
    """One row per input row: id, sources, size, source_sizes, targets, times, taken.

    ``source_col`` is a string or an array of strings.  A null source is a source of its own,
    the last one.  The size is the number of words; a null text has none.  Rows with the same
    id, and all null ids, have the same place in the seeded order and are taken together.  If
    no text has words, all targets and taken are 0.  The words of a text of any length are
    counted whole, and it is taken or left as a whole.  An empty table gives an empty result;
    other columns are not read.
    """
    rows = materialise(sized(docs, id_col, text_col, source_col, seed))
    joined = attach(rows, plan(rows, weights, max_repeat)).withColumn("_n", repeats(F.col("_ticket")))
    return joined.select(F.col("_id").alias(id_col), F.from_json("_members", "array<string>").alias("sources"), F.col("_size").alias("size"),
                         F.col("_sizes").alias("source_sizes"), F.col("_targets").alias("targets"), F.col("_n").alias("times"),
                         (F.col("_size") * F.col("_n")).alias("taken"))


def remix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS,
          max_repeat: int = MAX_REPEAT, seed: str = SEED) -> DataFrame:
    """``docs``, all columns, each row as often as the mix takes it; the cases of ``mix`` hold here too."""
    rows = materialise(sized(docs, id_col, text_col, source_col, seed).drop("_id"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    keyed = docs.select(row, members(docs, source_col).alias("_members"), ticket(id_col, seed).alias("_ticket"))
    joined = attach(keyed, plan(rows, weights, max_repeat))
    return joined.select("_row", F.explode(F.array_repeat(F.lit(0), repeats(F.col("_ticket")).cast("int")))).select("_row.*")
