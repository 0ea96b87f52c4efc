"""Problem 2: near-duplicate records, by an inverted join on signature coordinates."""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm.common import TYPES, cut_lineage, discard, newest, stored, struct_of

_WORDS = re.compile(r"[a-z0-9_]+")
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_MEMO_LIMIT = 500_000
_word_hash: dict[str, int] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, k: int, least_words: int) -> np.ndarray | None:
    """Sorted distinct 32-bit hashes of the sequences of ``k`` words, None for texts with too few words."""
    words = _WORDS.findall(text.lower())
    if len(words) < max(k, least_words):
        return None
    if len(_word_hash) > _MEMO_LIMIT:
        _word_hash.clear()
    codes = []
    for w in words:
        h = _word_hash.get(w)
        if h is None:
            h = _word_hash[w] = xxhash.xxh64_intdigest(w)
        codes.append(h)
    a = np.array(codes, dtype=np.uint64)
    h = np.zeros(len(a) - k + 1, dtype=np.uint64)
    for i in range(k):
        h = _mix(h * _M1 + a[i : len(a) - k + 1 + i] * _M2 + _M3)
    return np.unique((h >> np.uint64(32)).astype(np.uint32))


def coordinate_seeds(n: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype=np.uint64) * _M1)


def signature(h: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Least mixed hash under every seed: two sets agree in a coordinate with the probability of their similarity."""
    return _mix(h.astype(np.uint64)[:, None] ^ seeds[None, :]).min(axis=0)


def match_threshold(similarity: float, coordinates: int, miss: float = 0.001) -> int:
    """Most matches m such that a pair of just the given similarity has fewer than m with probability under ``miss``."""
    below, m = 0.0, 0
    while m < coordinates:
        below += comb(coordinates, m) * similarity**m * (1 - similarity) ** (coordinates - m)
        if below > miss:
            break
        m += 1
    return max(1, m)


def _fingerprint(h: np.ndarray) -> bytes:
    return xxhash.xxh128_digest(h.tobytes())


def _described(k: int, least_words: int):
    @F.pandas_udf(struct_of(fp="binary", shingles="binary"))
    def describe(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            rows = []
            for t in texts:
                h = None if t is None else shingles(t, k, least_words)
                rows.append((None, None) if h is None else (_fingerprint(h), h.tobytes()))
            yield pd.DataFrame(rows, columns=["fp", "shingles"])

    return describe


def _elements(sets, seeds: np.ndarray) -> np.ndarray:
    """Posting elements, hashes of (coordinate, value), one row for each set of shingles."""
    sig = np.stack([signature(np.frombuffer(x, dtype=np.uint32), seeds) for x in sets])
    return _mix(sig * _M2 + np.arange(sig.shape[1], dtype=np.uint64)[None, :] * _M1).view(np.int64)


def _split_hot(elements: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(posting keys, rows of the classes): an element that isn't hot is a key, a hot one gives a key with each other element of the class.

    Two classes with s elements in common, of which h are hot, meet under s - h + h (s - h) + h (h - 1) / 2 keys: that
    is 3 or more just if s is."""
    rows, cols = np.nonzero(~hot)
    keys, owners = [elements[rows, cols]], [rows]
    for i in np.flatnonzero(hot.any(axis=1)).tolist():
        places = np.flatnonzero(hot[i])
        a, b = np.repeat(places, elements.shape[1]), np.tile(np.arange(elements.shape[1]), len(places))
        once = (a < b) | ((a > b) & ~hot[i][b])
        low, high = np.minimum(elements[i][a[once]], elements[i][b[once]]), np.maximum(elements[i][a[once]], elements[i][b[once]])
        keys.append((_mix(low.view(np.uint64) * _M1 + _M3) ^ _mix(high.view(np.uint64) * _M2 + _M1)).view(np.int64))
        owners.append(np.full(len(low), i))
    return np.concatenate(keys), np.concatenate(owners)


def _posted(coordinates: int, prefix: int, heavy: dict[int, int], hot_from: float):
    """The first ``prefix`` elements of every class, rare ones first; those that ``hot_from`` or more of the sample hold, in pairs."""

    def post(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seeds = coordinate_seeds(coordinates)
        frequent = np.array(sorted(heavy), dtype=np.int64)
        weights = np.array([heavy[e] for e in sorted(heavy)], dtype=np.int64)
        for part in parts:
            if not len(part):
                continue
            elements = _elements(part["shingles"], seeds)
            weight = np.zeros(elements.shape, dtype=np.int64)
            if len(frequent):
                place = np.minimum(np.searchsorted(frequent, elements), len(frequent) - 1)
                weight = np.where(frequent[place] == elements, weights[place], 0)
            order = np.lexsort((elements, weight), axis=1)[:, :prefix]
            elements, weight = np.take_along_axis(elements, order, axis=1), np.take_along_axis(weight, order, axis=1)
            keys, rows = _split_hot(elements, weight >= hot_from)
            yield pd.DataFrame({"element": keys, "cid": part["cid"].to_numpy()[rows]})

    return post


def _all_elements(coordinates: int):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seeds = coordinate_seeds(coordinates)
        for part in parts:
            if len(part):
                yield pd.DataFrame({"element": _elements(part["shingles"], seeds).ravel()})

    return run


@F.pandas_udf(TYPES["long"])
def _shared(a: pd.Series, b: pd.Series) -> pd.Series:
    """Shingles in both of two sorted sets."""
    return pd.Series([len(np.intersect1d(np.frombuffer(x, dtype=np.uint32), np.frombuffer(y, dtype=np.uint32), assume_unique=True)) for x, y in zip(a, b)], dtype="int64")


class NearDuplicates:
    """Near-duplicate pairs of the records of a table.

    ``records`` has the columns ``id`` (distinct) and ``text``.  Records with the same set of shingles
    form a class, and only classes are compared: ``members`` (fp, id), ``class_pairs`` (fp_a, fp_b,
    each pair once, shared, similarity).  Null texts and texts with fewer than ``least_words`` words take no part.

    A class is posted under (coordinate, value) for the first K - m + l coordinates of its signature in
    a global order, rare values first: two signatures that agree in m of K coordinates share at least l
    of these (prefix), and long lists are only read where a class has little else (skip).  Collisions
    are counted for each pair, pairs with l or more are checked on their shingles, so every pair
    returned has the similarity (of 32-bit hashes of shingles); a pair of just the threshold is missed
    with probability ``miss``.  The global order only has to be the same for all; the frequent values
    are counted on a sample of at most ``order_sample`` classes and at most ``order_values`` of them
    are remembered.

    A value that about ``hot`` classes or more hold (by the sample) would make its list meet itself in full: it is
    posted together with each other value of the class instead, which loses no pair, since three values
    have to be shared (see ``_split_hot``; with another number of collisions values are posted as they are, and the
    join's skew is left to adaptive execution).  Classes of many copies are dealt to parts when pairs are written out.
    """

    #: Records of a class in one part of the join that writes pairs out.
    PART = 1_000

    #: Class ids, 8 bytes each, that may be broadcast to thin out the classes to check; beyond that the join shuffles.
    BROADCAST_IDS = 1_000_000

    def __init__(self, records: DataFrame, similarity: float = 0.8, k: int = 5, least_words: int = 5, coordinates: int = 32, collisions: int = 3, miss: float = 0.001, order_sample: int = 50_000, order_values: int = 20_000, hot: int = 2_000):
        """``records``: id, text; with a column ``at`` the newest row of an id counts, with a column ``wanted`` only if that is true."""
        m = max(collisions, match_threshold(similarity, coordinates, miss))
        has = set(records.columns)
        at = F.col("at") if "at" in has else F.lit(0).alias("at")
        wanted = F.coalesce(F.col("wanted"), F.lit(False)) if "wanted" in has else F.lit(True)
        d = records.where("id is not null").select("id", at, _described(k, least_words)(F.when(wanted, F.col("text"))).alias("_d")).select("id", "at", "_d.*")
        d = newest(d, ["id"], "at", tie=["fp"]).where("fp is not null").select("id", "fp", "shingles")
        d = stored(d)
        self.members = d.select("fp", "id")
        classes = d.select("fp", "shingles").dropDuplicates(["fp"]).withColumn("cid", F.xxhash64("fp"))
        n = d.count()
        part = min(1.0, order_sample / max(1, n))
        sample = d.select("fp", "shingles").where(F.abs(F.xxhash64("fp")) % 1_000_000 < int(part * 1_000_000)).dropDuplicates(["fp"]).select("shingles")
        counts = stored(sample.mapInPandas(_all_elements(coordinates), "element long").groupBy("element").count().where("count >= 5"))
        heavy = {r["element"]: r["count"] for r in counts.orderBy(F.desc("count"), "element").limit(order_values).collect()}
        discard(counts)
        hot_from = max(5.0, hot * part) if collisions == 3 else float("inf")
        posted = stored(classes.select("cid", "shingles").mapInPandas(_posted(coordinates, coordinates - m + collisions, heavy, hot_from), "element long, cid long"))
        met = posted.alias("a").join(posted.alias("b"), "element").where("a.cid < b.cid").select(F.col("a.cid").alias("cid_a"), F.col("b.cid").alias("cid_b"))
        pairs = stored(met.groupBy("cid_a", "cid_b").agg(F.count("*").alias("n")).where(F.col("n") >= collisions).select("cid_a", "cid_b"))
        discard(posted)
        ids = pairs.select(F.col("cid_a").alias("cid")).unionByName(pairs.select(F.col("cid_b").alias("cid"))).distinct()
        few = 2 * pairs.count() <= self.BROADCAST_IDS
        some = d.withColumn("cid", F.xxhash64("fp")).join(F.broadcast(ids) if few else ids, "cid", "left_semi").select("cid", "fp", "shingles").dropDuplicates(["fp"])
        side = lambda s: some.select(F.col("cid").alias(f"cid_{s}"), F.col("fp").alias(f"fp_{s}"), F.col("shingles").alias(f"sh_{s}"))
        both = pairs.join(side("a"), "cid_a").join(side("b"), "cid_b")
        size = lambda s: F.octet_length(f"sh_{s}") / 4
        # sets of too different size can't be similar enough
        both = both.where(F.least(size("a"), size("b")) >= F.lit(similarity) * F.greatest(size("a"), size("b")) - 1e-9)
        both = both.withColumn("shared", _shared("sh_a", "sh_b")).withColumn("_all", size("a") + size("b") - F.col("shared"))
        self.class_pairs = both.where(F.col("shared") >= F.lit(similarity) * F.col("_all") - 1e-9).select("fp_a", "fp_b", "shared", F.round(F.col("shared") / F.col("_all"), 6).alias("similarity"))

    def pairs(self) -> DataFrame:
        """id_a < id_b of all pairs of records, those of a class included."""
        copies = self.members.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1")
        large = stored(copies.where(F.col("n") > self.PART).select("fp", F.ceil(F.col("n") / self.PART).cast("int").alias("parts")))
        parts = F.coalesce("parts", F.lit(1))
        m = self.members.join(large, "fp", "left").select("fp", F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"), "id")
        alike = self.class_pairs.select("fp_a", "fp_b").unionByName(copies.select(F.col("fp").alias("fp_a"), F.col("fp").alias("fp_b")))
        for side in ("a", "b"):
            of = large.select(F.col("fp").alias(f"fp_{side}"), "parts")
            alike = alike.join(of, f"fp_{side}", "left").select("fp_a", "fp_b", *(["part_a"] if side == "b" else []), F.explode(F.sequence(F.lit(0), parts - 1)).alias(f"part_{side}"))
        a, b = (m.select(F.col("fp").alias(f"fp_{s}"), F.col("part").alias(f"part_{s}"), F.col("id").alias(n)) for s, n in (("a", "x"), ("b", "y")))
        both = alike.join(a, ["fp_a", "part_a"]).join(b, ["fp_b", "part_b"]).where((F.col("fp_a") != F.col("fp_b")) | (F.col("x") < F.col("y")))
        return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))

    def groups(self) -> DataFrame:
        """id, group_id (least id reachable through pairs), links (number of near-duplicates of other text), copies (records with the same shingles)."""
        pairs = cut_lineage(self.class_pairs.select("fp_a", "fp_b"))
        edges = pairs.unionByName(pairs.select(F.col("fp_b").alias("fp_a"), F.col("fp_a").alias("fp_b")))
        classes = self.members.groupBy("fp").agg(F.min("id").alias("label"), F.count("*").alias("copies"))
        links = edges.groupBy(F.col("fp_a").alias("fp")).agg(F.count("*").alias("links"))
        labels = cut_lineage(classes.select("fp", "label"))
        while True:
            near = edges.join(labels.select(F.col("fp").alias("fp_b"), "label"), "fp_b").groupBy(F.col("fp_a").alias("fp")).agg(F.min("label").alias("near"))
            stepped = labels.join(near, "fp", "left").select("fp", "label", F.least("label", F.coalesce("near", "label")).alias("next"))
            # a label is the least id of some class: jump to that class's own label
            roots = stepped.groupBy("label").agg(F.min("next").alias("root")).select(F.col("label").alias("next"), "root")
            stepped = cut_lineage(stepped.join(roots, "next", "left").select("fp", F.col("label"), F.least("next", F.coalesce("root", "next")).alias("next")))
            labels = stepped.select("fp", F.col("next").alias("label"))
            if stepped.where("label <> next").isEmpty():
                break
        return self.members.join(labels, "fp").join(classes.select("fp", "copies"), "fp").join(links, "fp", "left").select("id", F.col("label").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"), "copies")
