"""Best-fit packing, improved by a swap-based local search.

Documents longer than a sequence are cut into full pieces and a rest.  Full pieces are
sequences of their own; the other pieces are dealt by a hash to groups of about ``GROUP``,
and a task packs a group by best fit, the longest pieces first.  Then it searches: the
least filled bin gives documents to fuller bins that have room left, by a move, by a
one-for-one exchange or by a two-for-one exchange, whichever raises the sum of squared
fills most.  Every step raises it, so the search ends; a bin that has given all it had is
gone.  The search stops when the group has as few bins as its tokens and its longest
pieces allow, or when ``PATIENCE`` bins in a row could not be emptied.

The ``OPEN`` least filled bins of a group stay open.  Sixteen groups send theirs to one
group of the next level, which searches again, and so on up to a single group.  A group of
any level holds at most 16 * OPEN bins, so no task grows with the input; levels grow with
its logarithm.

Only sizes and checksums of pieces are shuffled.  A piece's checksum is computed where its
text is encoded, so ids are never stored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.llm.common import materialise, slices, text_of
from marketlens.llm.tokens import TEXTS, tokenizer, tokenizer_path

LENGTH = 4096
END_ID = 1
#: Pieces that are packed together at first, on average.
GROUP = 2048
#: Groups that send their open bins to one group of the next level, and how many bins each sends.
FAN = 16
OPEN = 32
#: Bins in a row that the search fails to empty before it gives up.
PATIENCE = 8


def piece_sums(path: str, end_id: int, length: int):
    """An Arrow UDF from text bytes to (number of ids with ``end_id`` last, CRC32 of each piece's ids)."""
    schema = T.StructType([T.StructField("n", T.LongType()), T.StructField("crcs", T.ArrayType(T.LongType()))])

    @F.arrow_udf(schema)
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = tokenizer(path)
        end = np.array([end_id], "<u4").tobytes()
        step = 4 * length
        for texts in batches:
            sizes, sums = [], []
            for part in slices(texts, TEXTS):
                for packed in words.encode(part):
                    wide = memoryview(np.frombuffer(packed, words.dtype).astype("<u4").tobytes() + end)
                    sizes.append(len(wide) // 4)
                    sums.append([zlib.crc32(wide[at:at + step]) for at in range(0, len(wide), step)])
            yield pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(sums, pa.list_(pa.int64()))], ["n", "crcs"])

    return encode


def fewest(sizes: np.ndarray, capacity: int) -> int:
    """A number of bins that no packing of ``sizes`` can go below."""
    total = -(-int(sizes.sum()) // capacity)
    return max(total, int((2 * sizes > capacity).sum()))


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item: longest first, each into the fullest bin that has room for it."""
    bins = np.empty(len(sizes), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set if a bin has room r
    n = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, n
            n += 1
        bins[i] = b
        left = room - size
        by_room[left].append(b)
        rooms |= 1 << left
    return bins


class Search:
    """Local search over the bins of one group; ``bins`` changes in place."""

    def __init__(self, sizes: np.ndarray, bins: np.ndarray, capacity: int):
        self.sizes, self.bins, self.capacity = sizes, bins, capacity
        self.fill = np.bincount(bins, weights=sizes).astype(np.int64)

    def squares(self) -> int:
        return int((self.fill.astype(object) ** 2).sum()) if len(self.fill) else 0

    def best(self, low: int, what: np.ndarray, have: np.ndarray, room: np.ndarray, fill: np.ndarray) -> tuple[int, int, int]:
        """(gain, index into ``what``, index into ``have``) of the best exchange with bin ``low``.

        ``what`` are sorted sizes that the bin can give, ``have`` sizes that it would get back
        from a bin with so much room and fill; the largest gift that fits is tried for each.
        """
        at = np.searchsorted(what, have + room, "right") - 1
        more = what[np.maximum(at, 0)] - have
        gain = np.where((at >= 0) & (more > 0), 2 * more * (fill - self.fill[low] + more), 0)
        j = int(gain.argmax()) if len(gain) else 0
        return (int(gain[j]), int(at[j]), j) if len(gain) else (0, 0, 0)

    def exchange(self, low: int) -> bool:
        """Make the exchange of bin ``low`` with an underfull bin that raises the squared fill most; False if none does."""
        own = np.flatnonzero(self.bins == low)
        own = own[np.argsort(self.sizes[own], kind="stable")]
        s = self.sizes[own]
        # of equal sizes two are enough for every exchange
        twice = np.ones(len(s), bool)
        twice[2:] = s[2:] != s[:-2]
        own, s = own[twice], s[twice]
        i, j = np.triu_indices(len(s), 1)
        pairs, at = np.unique(s[i] + s[j], return_index=True)
        room = self.capacity - self.fill
        others = np.flatnonzero((room > 0) & (self.fill > 0))
        others = others[others != low]
        items = np.flatnonzero((self.bins != low) & (room[self.bins] > 0))
        home = self.bins[items]
        found = [(*self.best(low, s, np.zeros(len(others), np.int64), room[others], self.fill[others]), "move"),
                 (*self.best(low, s, self.sizes[items], room[home], self.fill[home]), "one for one")]
        if len(pairs):
            found.append((*self.best(low, pairs, self.sizes[items], room[home], self.fill[home]), "two for one"))
        gain, k, other, kind = max(found, key=lambda x: x[0])
        if gain > 0:
            give = own[[i[at[k]], j[at[k]]]] if kind == "two for one" else own[[k]]
            take, to = (items[[other]], home[other]) if kind != "move" else (items[:0], others[other])
        else:
            first, second = self.pairs_of_others(items, home)
            of = self.bins[first]
            gain, k, other = self.best(low, s, self.sizes[first] + self.sizes[second], room[of], self.fill[of])
            if gain <= 0:
                return False
            give, take, to = own[[k]], np.array([first[other], second[other]]), of[other]
        moved = int(self.sizes[give].sum() - self.sizes[take].sum())
        self.bins[give], self.bins[take] = to, low
        self.fill[to] += moved
        self.fill[low] -= moved
        return True

    def pairs_of_others(self, items: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of items of the same bin that differ in their sizes' places, for two that come back for one."""
        order = np.lexsort((self.sizes[items], home))
        items, home = items[order], home[order]
        s = self.sizes[items]
        twice = np.ones(len(s), bool)
        twice[2:] = (s[2:] != s[:-2]) | (home[2:] != home[:-2])
        items, home = items[twice], home[twice]
        first, second = [items[:0]], [items[:0]]
        for k in range(1, len(items)):
            same = home[k:] == home[:-k]
            if not same.any():
                break
            first.append(items[:-k][same])
            second.append(items[k:][same])
        return np.concatenate(first), np.concatenate(second)

    def run(self, patience: int) -> None:
        least = fewest(self.sizes, self.capacity)
        failed: set[int] = set()
        while len(failed) < patience and int((self.fill > 0).sum()) > least:
            ranked = np.flatnonzero((self.fill > 0) & (self.fill < self.capacity))
            low = next((int(b) for b in ranked[np.argsort(self.fill[ranked], kind="stable")] if int(b) not in failed), None)
            if low is None:
                return
            while self.fill[low] and self.exchange(low):
                pass
            if self.fill[low]:
                failed.add(low)
            else:
                failed.clear()


#: Level and number of the group and of the bin in it make a sequence number.
BIN_BITS, LEVEL_BITS = 16, 5


def group_packer(level: int, capacity: int, keep_open: int, patience: int):
    """Pack (level 0) or improve the pieces of one group; bins that do not stay open get offsets."""

    def one_group(pieces: pa.Table) -> pa.Table:
        sizes = pieces["_length"].to_numpy().astype(np.int64)
        if level:
            _, bins = np.unique(pieces["_bin"].to_numpy(), return_inverse=True)
            bins = bins.astype(np.int64)
        else:
            bins = best_fit(sizes, capacity)
        search = Search(sizes, bins, capacity)
        search.run(patience)
        _, bins = np.unique(search.bins, return_inverse=True)
        fill = np.bincount(bins, weights=sizes).astype(np.int64)
        ranked = np.argsort(fill, kind="stable")
        is_open = np.zeros(len(fill), bool)
        is_open[ranked[:keep_open]] = True
        is_open &= fill < capacity
        order = np.argsort(bins, kind="stable")
        at = np.cumsum(sizes[order]) - sizes[order]
        first = np.searchsorted(bins[order], np.arange(len(fill)))
        offsets = np.empty(len(sizes), np.int64)
        offsets[order] = at - at[first][bins[order]]
        number = ((pieces["_group"][0].as_py() << BIN_BITS | bins) << LEVEL_BITS) | level
        out = pieces.drop_columns(["_bin", "_offset", "_open"])
        for name, values in (("_bin", number), ("_offset", offsets), ("_open", is_open[bins])):
            out = out.append_column(name, pa.array(values))
        return out

    return one_group


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, length: int = LENGTH,
         end_id: int = END_ID, group: int = GROUP, keep_open: int = OPEN, patience: int = PATIENCE) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is a document of the end id alone.  Texts of any length are encoded
    whole, in parts; a document of more than ``length`` ids is cut into pieces of ``length``
    and one shorter rest.  Repeated rows and rows with null ids are packed one by one.  Pieces
    of equal size can take each other's place; rows are told apart by their place in the input,
    which is written down once, so a task that is run again packs alike.  Sequence numbers
    are unique and otherwise arbitrary.  An empty table gives an empty result; other columns
    are not read.
    """
    encoded = docs.select(F.col(id_col).alias("_id"), piece_sums(path or tokenizer_path(), end_id, length)(text_of(text_col).cast("binary")).alias("_t"))
    cut = encoded.select("_id", F.col("_t.n").alias("_n"), F.posexplode("_t.crcs").alias("_piece", "_crc"))
    start = F.col("_piece").cast("long") * length
    pieces = materialise(cut.select("_id", "_piece", start.alias("_start"), F.least(F.lit(length), F.col("_n") - start).cast("int").alias("_length"),
                                    "_crc", F.monotonically_increasing_id().alias("_row")))
    full = pieces.where(F.col("_length") == length).select("*", (-1 - F.col("_row")).alias("_bin"), F.lit(0).cast("long").alias("_offset"))
    rest = pieces.where(F.col("_length") < length)
    groups = max(1, -(-rest.count() // group))
    rest = rest.withColumns({"_group": F.pmod(F.xxhash64("_row"), F.lit(groups)).cast("long"), "_bin": F.lit(0).cast("long"),
                             "_offset": F.lit(0).cast("long"), "_open": F.lit(True)})
    done, level = [full], 0
    while True:
        last = groups == 1
        packed = materialise(rest.groupBy("_group").applyInArrow(group_packer(level, length, 0 if last else keep_open, patience), rest.schema))
        done.append(packed.where("not _open").select(*full.columns))
        if last:
            break
        rest = packed.where("_open").withColumn("_group", F.floor(F.col("_group") / FAN))
        groups, level = -(-groups // FAN), level + 1
    laid = done[0]
    for part in done[1:]:
        laid = laid.unionByName(part)
    return laid.select(F.col("_id").alias(id_col), F.col("_piece").alias("piece"), F.col("_start").alias("start"), F.col("_length").cast("long").alias("length"),
                       F.col("_crc").alias("ids_crc32"), F.col("_bin").alias("sequence_id"), F.col("_offset").alias("offset"))
