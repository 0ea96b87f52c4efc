"""Problem 8: filling fixed-capacity containers with items."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm.common import stored
from codequarry.llm.tokens import DEFAULT_VOCABULARY, token_count


class Bins:
    """Containers of one block; contents are places of items, by size."""

    def __init__(self, sizes: np.ndarray, capacity: int):
        self.size, self.capacity = sizes, capacity
        self.items: list[list[int]] = []
        self.free: list[int] = []
        open_by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        occupied = 0  # bit f: some container has f free
        for i in np.argsort(-sizes, kind="stable").tolist():
            s = int(sizes[i])
            fits = occupied >> s
            if fits:  # best fit: least free space that suffices
                f = s + (fits & -fits).bit_length() - 1
                b = open_by_free[f].pop()
                if not open_by_free[f]:
                    occupied &= ~(1 << f)
            else:
                b, f = len(self.items), capacity
                self.items.append([])
                self.free.append(capacity)
            self.items[b].append(i)
            self.free[b] = f - s
            open_by_free[f - s].append(b)
            occupied |= 1 << (f - s)

    def _move(self, i: int, a: int, b: int) -> None:
        self.items[a].remove(i)
        self.items[b].append(i)
        self.bin_of[i] = b
        self.free[a] += self.size[i]
        self.free[b] -= self.size[i]

    def improve(self) -> None:
        """Local search: size is brought out of the emptiest container by moves, one-for-one and two-for-one exchanges,
        each raising the sum of squared fills, until it is empty or none is left; then out of the next emptiest,
        and round again until a whole round changes nothing or no packing could do with fewer containers."""
        bound = -(-int(self.size.sum()) // self.capacity)
        self.bin_of = np.empty(len(self.size), dtype=np.int64)
        for b, content in enumerate(self.items):
            self.bin_of[content] = b
        self.free = np.array(self.free, dtype=np.int64)
        live, changed = len(self.items), True
        while changed and live > bound:
            changed = False
            for a in np.argsort(-self.free, kind="stable").tolist():
                if live <= bound:
                    return
                if not self.items[a] or not self.free[a]:
                    continue
                while self.items[a] and self._exchange(a):
                    changed = True
                live -= not self.items[a]

    def _exchange(self, a: int) -> bool:
        """The exchange that brings most size out of ``a``; False if there is none."""
        fill = self.capacity - self.free
        mine = sorted(self.items[a], key=lambda i: -self.size[i])
        best, gain = None, 0
        # fuller containers with room: what they gain raises the sum of squares
        open_ = (self.free > 0) & (fill > 0)
        open_[a] = False
        for i in mine:
            fits = np.flatnonzero(open_ & (self.free >= self.size[i]) & (fill + self.size[i] > fill[a]))
            if len(fits):
                best, gain = ([i], None, int(fits[self.free[fits].argmin()])), int(self.size[i])
                break
        others = np.flatnonzero(open_[self.bin_of])
        room, sizes, fills = self.free[self.bin_of[others]], self.size[others], fill[self.bin_of[others]]
        for out in [[i] for i in mine] + [[i, k] for n, i in enumerate(mine) for k in mine[n + 1 :]]:
            total = int(self.size[out].sum())
            if total <= gain:
                continue
            net = total - sizes
            net[(net > room) | (fills + net <= fill[a])] = 0
            j = int(net.argmax()) if len(net) else -1
            if j >= 0 and net[j] > gain:
                best, gain = (out, int(others[j]), int(self.bin_of[others[j]])), int(net[j])
        if best is None:
            return False
        out, back, b = best
        for i in out:
            self._move(i, a, b)
        if back is not None:
            self._move(back, b, a)
        return True

    def assignment(self) -> np.ndarray:
        out = np.full(len(self.size), -1, dtype=np.int64)
        n = 0
        for content in self.items:
            if content:
                out[content] = n
                n += 1
        return out


def _pack_block(capacity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", "doc_id", "piece_no"], kind="stable", ignore_index=True)
        bins = Bins(pdf["tokens"].to_numpy(), capacity)
        pdf["best_fit"] = bins.assignment()
        bins.improve()
        pdf["bin"] = bins.assignment()
        return pdf[["block", "bin", "best_fit", "doc_id", "piece_no", "pieces", "start_token", "tokens"]]

    return run


def pack_documents(documents: DataFrame, capacity: int = 4096, block_items: int = 20_000, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """container_id, best_fit_id, doc_id, piece_no, pieces, start_token, tokens: every document in containers of ``capacity``
    tokens (``best_fit_id``: the container before the local search).

    A document within the capacity is never split; a longer one gives full pieces and a rest, which is
    an item like any other.  Items are spread at random (by hash) over blocks of about ``block_items``,
    each packed by best fit decreasing and then by local search (move, one for one, two for one,
    raising the sum of squared fills until containers empty and nothing is left to gain).  A block wastes at most about one
    container, so blocks of this size lose next to nothing against one global packing and no task
    holds more than a block.

    Repeated rows of a doc_id count once (its largest text, then the smallest loaded row by hash);
    rows with a null doc_id, and null or empty texts (no tokens), are left out.
    """
    sized = documents.select(F.col("doc_id").cast("long").alias("doc_id"), token_count(F.col("text"), vocabulary).alias("_n")).where("doc_id is not null").groupBy("doc_id").agg(F.max("_n").alias("_n")).where("_n > 0")
    sized = stored(sized)  # the tokenizer runs once
    rest, full = F.col("_n") % capacity, F.floor(F.col("_n") / capacity).cast("int")
    pieces = full + (rest > 0).cast("int")
    items = sized.select("doc_id", "_n", pieces.alias("pieces"), F.explode(F.sequence(F.lit(1), pieces)).alias("piece_no"))
    items = items.select("doc_id", "piece_no", "pieces", ((F.col("piece_no") - 1) * capacity).cast("long").alias("start_token"), F.least(F.lit(capacity).cast("long"), F.col("_n") - (F.col("piece_no") - 1) * capacity).alias("tokens"))
    named = ["doc_id", "piece_no", "pieces", "start_token", "tokens"]
    own = F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("-"), F.col("piece_no").cast("string"))
    whole = items.where(F.col("tokens") == capacity).select(own.alias("container_id"), own.alias("best_fit_id"), *named)
    blocks = max(1, round(sized.count() / block_items))
    open_items = items.where(F.col("tokens") < capacity).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("long"))
    packed = open_items.groupBy("block").applyInPandas(_pack_block(capacity), "block long, bin long, best_fit long, doc_id long, piece_no int, pieces int, start_token long, tokens long")
    of = lambda c: F.concat(F.lit("b"), F.col("block").cast("string"), F.lit("-"), F.col(c).cast("string"))
    return whole.unionByName(packed.select(of("bin").alias("container_id"), of("best_fit").alias("best_fit_id"), *named))


def packing_report(packed: DataFrame, capacity: int = 4096) -> DataFrame:
    """Documents, containers, those of best fit alone, tokens, the least number of containers any packing needs, and the mean fill."""
    total = packed.agg(F.countDistinct("container_id").alias("containers"), F.countDistinct("best_fit_id").alias("best_fit_containers"), F.sum("tokens").alias("tokens"), F.countDistinct("doc_id").alias("documents"))
    return total.select("documents", "containers", "best_fit_containers", "tokens", F.ceil(F.col("tokens") / capacity).alias("least_containers"), F.round(F.col("tokens") / (F.col("containers") * capacity), 6).alias("fill"))
