"""Problem 7: most similar vectors for every vector, through balanced posting lists."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codequarry.llm.common import discard, stored

#: Postings for which a turn of its own is worth its jobs.
TURN = 50_000


# --- vectors ---------------------------------------------------------------------------------------


def _unit(dim: int, coded_too: bool):
    """(id, at, fp), or (fp, code) of valid vectors: codes and fingerprints of unit vectors; the fingerprint is null where the vector is null, of another length, zero or not finite."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column("embedding")
            lengths = np.asarray(column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False), dtype=np.int64)
            flat = column.flatten().cast(pa.float64())
            flat = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False)
            starts = np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0)
            fps: list[bytes | None] = [None] * len(lengths)
            x, places = np.zeros((0, dim), dtype=np.float32), np.flatnonzero(lengths == dim)
            if len(places):
                x = flat[(starts[places][:, None] + np.arange(dim)[None, :])]
                top = np.abs(x).max(axis=1)
                good = np.isfinite(top) & (top > 0)
                places = places[good]
                x = x[good] / top[good][:, None]  # so that squares neither overflow nor vanish
                x = (x / np.sqrt((x * x).sum(axis=1))[:, None]).astype(np.float32)
                for place, row in zip(places.tolist(), x):
                    fps[place] = xxhash.xxh128_digest(row.tobytes())
            if coded_too:
                yield pa.RecordBatch.from_arrays([pa.array([fps[i] for i in places.tolist()], pa.binary()), pa.array(coded(x), pa.binary())], ["fp", "code"])
            else:
                yield pa.RecordBatch.from_arrays([b.column("id").cast(pa.string()), b.column("at"), pa.array(fps, pa.binary())], ["id", "at", "fp"])

    return run


def coded(x: np.ndarray) -> list[bytes]:
    """Rows as a scale and 16-bit numbers, half the bytes; similarities are right to about 0.00001."""
    if not len(x):
        return []
    top = np.abs(x).max(axis=1, keepdims=True)
    codes = np.rint(x / top * 32767).astype("<i2")
    scales = (top[:, 0] / 32767).astype("<f4")
    return [s.tobytes() + c.tobytes() for s, c in zip(scales, codes)]


def decoded(values, dim: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(values), dtype=np.uint8).reshape(-1, 4 + 2 * dim)
    x = np.ascontiguousarray(raw[:, 4:]).view("<i2").astype(np.float32) * np.ascontiguousarray(raw[:, :4]).view("<f4")
    return x / np.linalg.norm(x, axis=1, keepdims=True)


# --- centroids and their graph -------------------------------------------------------------------------


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means; an empty centroid moves to a point of the largest cluster."""
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    label = np.zeros(len(x), dtype=np.int64)
    for _ in range(rounds):
        label = (x @ c.T).argmax(axis=1)
        sizes = np.bincount(label, minlength=k)
        order = np.argsort(label, kind="stable")
        starts = np.searchsorted(label[order], np.arange(k))
        filled = sizes > 0
        sums = np.add.reduceat(x[order], np.minimum(starts, len(x) - 1), axis=0)
        c[filled] = sums[filled]
        if (~filled).any():
            c[~filled] = x[rng.choice(np.flatnonzero(label == sizes.argmax()), int((~filled).sum()))]
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c, (x @ c.T).argmax(axis=1)


def balanced_centroids(x: np.ndarray, count: int, seed: int = 0) -> np.ndarray:
    """About ``count`` centroids on two levels; lists that come out more than twice as long as the mean are divided."""
    rng = np.random.default_rng(seed)
    if len(x) <= count or count <= 2:
        return x[: max(1, count)].copy()
    _, coarse = _kmeans(x, max(1, int(np.sqrt(count))), 6, rng)
    parts = []
    for label in np.unique(coarse):
        members = x[coarse == label]
        parts.append(_kmeans(members, max(1, round(count * len(members) / len(x))), 6, rng)[0])
    c = np.concatenate(parts)
    # a list of more than twice the mean is divided, until none is left (or its vectors can't be told apart)
    mean = max(1.0, len(x) / len(c))
    for _ in range(6):
        label = (x @ c.T).argmax(axis=1)
        sizes = np.bincount(label, minlength=len(c))
        long = np.flatnonzero(sizes > 2 * mean)
        if not len(long):
            break
        c = np.concatenate([np.delete(c, long, axis=0), *(_kmeans(x[label == i], int(np.ceil(sizes[i] / mean)), 4, rng)[0] for i in long)])
    return c


class CentroidGraph:
    """Neighbourhood graph of the centroids; a batch of queries walks it by best-first search.  Up to ``FLAT`` centroids
    are compared directly, which takes less time."""

    FLAT = 2_048

    def __init__(self, centroids: np.ndarray, degree: int = 24, seed: int = 0):
        self.c = centroids
        n = len(centroids)
        self.degree = min(degree, max(1, n - 1))
        links = []
        for at in range(0, n, 1024):
            s = centroids[at : at + 1024] @ centroids.T
            s[np.arange(len(s)), np.arange(at, at + len(s))] = -2
            links.append(np.argpartition(-s, self.degree - 1, axis=1)[:, : self.degree] if n > 1 else np.zeros((len(s), 1), dtype=np.int64))
        self.links = np.concatenate(links)
        self.pivots = np.random.default_rng(seed).permutation(n)[: min(n, 4 * int(np.sqrt(n)) + 8)]

    def search(self, q: np.ndarray, k: int, beam: int = 12, steps: int = 4, widen: int = 3) -> tuple[np.ndarray, np.ndarray]:
        """(places, similarities) of about the k nearest centroids of each query, nearest first."""
        n, beam = len(self.c), max(beam, k)
        if n <= self.FLAT:
            sim = q @ self.c.T
            near = np.argpartition(-sim, k - 1, axis=1)[:, :k]
            near = np.take_along_axis(near, np.argsort(-np.take_along_axis(sim, near, axis=1), axis=1), axis=1)
            return near, np.take_along_axis(sim, near, axis=1)
        sim = q @ self.c[self.pivots].T
        beam = min(beam, n)
        first = np.argsort(-sim, axis=1)[:, :beam]
        nodes, sims = self.pivots[first], np.take_along_axis(sim, first, axis=1)
        opened = np.zeros_like(nodes, dtype=bool)
        for _ in range(steps):
            rank = np.where(opened, -3.0, sims)
            best = np.argsort(-rank, axis=1)[:, :widen]
            np.put_along_axis(opened, best, True, axis=1)
            new = self.links[np.take_along_axis(nodes, best, axis=1)].reshape(len(q), -1)
            new_sim = np.einsum("qd,qnd->qn", q, self.c[new], optimize=False)
            nodes, sims = np.concatenate([nodes, new], axis=1), np.concatenate([sims, new_sim], axis=1)
            opened = np.concatenate([opened, np.zeros_like(new, dtype=bool)], axis=1)
            order = np.lexsort((~opened, nodes), axis=1)  # a node met twice stays once, as opened if it was
            nodes, sims, opened = (np.take_along_axis(a, order, axis=1) for a in (nodes, sims, opened))
            again = np.zeros_like(opened)
            again[:, 1:] = nodes[:, 1:] == nodes[:, :-1]
            sims = np.where(again, -4.0, sims)
            order = np.argsort(-sims, axis=1)[:, :beam]
            nodes, sims, opened = (np.take_along_axis(a, order, axis=1) for a in (nodes, sims, opened))
        return nodes[:, :k], sims[:, :k]


def _assigned(graph_b, dim: int, replicas: int, ratio: float):
    """(id, code, lists): the list of the nearest centroid and those whose distance is within the ratio of the nearest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = graph_b.value
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                nodes, sims = graph.search(decoded(part.column("code").to_pylist(), dim), min(replicas, len(graph.c)))
                dist = np.sqrt(np.maximum(0.0, 2 - 2 * sims))
                keep = (sims > -2) & (dist <= ratio * dist[:, :1] + 1e-6)
                keep[:, 0] = True
                ends = np.concatenate([[0], np.cumsum(keep.sum(axis=1))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(nodes[keep].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("code"), lists], ["id", "code", "lists"])

    return run


def grouped(c: np.ndarray, sizes: np.ndarray, most: int) -> np.ndarray:
    """Group of each list: lists whose centroids are close, together at most ``most`` postings (a longer list is alone)."""
    groups, count, rest = np.zeros(len(c), dtype=np.int64), 0, [np.arange(len(c))]
    rng = np.random.default_rng(0)
    while rest:
        part = rest.pop()
        if len(part) == 1 or sizes[part].sum() <= most:
            groups[part] = count
            count += 1
            continue
        label = _kmeans(c[part], 2, 6, rng)[1]
        if label.min() == label.max():  # centroids that can't be told apart
            label = np.arange(len(part)) % 2
        rest += [part[label == 0], part[label == 1]]
    return groups


def _placed(plan_b, turn: int):
    """(unit, i, j, lists, asks, gives, id, code) of the units of one turn: a vector goes once to each group of its
    lists; of a list that is worked in blocks, to the pairs of its own block and each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, blocks, turns = plan_b.value
        for b in batches:
            rows, units, pairs, held, flags = [], [], [], [], []
            for at, (key, lists) in enumerate(zip(b.column("id").to_pylist(), b.column("lists").to_pylist())):
                own: dict[int, list[int]] = {}
                for one in lists:
                    if turns[groups[one]] != turn:
                        continue
                    if (n := blocks[one]) > 1:
                        mine = xxhash.xxh32_intdigest(key) % n
                        for other in range(n):
                            for pair, asks, gives in [((mine, other), True, other == mine)] + [((other, mine), False, True)] * (other != mine):
                                rows.append(at), units.append(-1 - one), pairs.append(pair), held.append([one]), flags.append((asks, gives))
                    else:
                        own.setdefault(groups[one], []).append(one)
                for group, some in own.items():
                    rows.append(at), units.append(group), pairs.append((0, 0)), held.append(some), flags.append((True, True))
            for at in range(0, len(rows), 10_000):
                cut = slice(at, at + 10_000)
                i, j = np.array(pairs[cut], dtype=np.int32).T
                asks, gives = np.array(flags[cut], dtype=bool).T
                taken = b.select(["id", "code"]).take(pa.array(rows[cut], pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(units[cut], pa.int64()), pa.array(i), pa.array(j), pa.array(held[cut], pa.list_(pa.int32())), pa.array(asks), pa.array(gives), *taken.columns], ["unit", "i", "j", "lists", "asks", "gives", "id", "code"])

    return run


def _nearest(x: np.ndarray, asks: np.ndarray, gives: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows that ask, rows near them, similarities): of ``gives``, in order of their ids, the k most similar."""
    members = x[gives]
    for at in range(0, len(asks), 1024):
        mine = asks[at : at + 1024]
        s = x[mine] @ members.T
        s[mine[:, None] == gives[None, :]] = -9
        many = min(k + 8, s.shape[1])
        near = np.argpartition(-s, many - 1, axis=1)[:, :many] if many < s.shape[1] else np.tile(np.arange(s.shape[1]), (len(mine), 1))
        near.sort(axis=1)  # members are in order of their ids, so that ties go to the smaller
        exact = np.einsum("qd,qnd->qn", x[mine].astype(np.float64), members[near].astype(np.float64))
        exact[np.take_along_axis(s, near, axis=1) < -8] = -9
        order = np.argsort(-np.round(exact, 12), axis=1, kind="stable")[:, :k]
        near, exact = np.take_along_axis(near, order, axis=1), np.take_along_axis(exact, order, axis=1)
        row, col = np.nonzero(exact > -8)
        yield mine[row], gives[near[row, col]], exact[row, col]


def _within(dim: int, k: int):
    """The k most similar members for each vector of a group of posting lists (or of a pair of blocks of a long list)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable", ignore_index=True)
        asks, gives, x = pdf["asks"].to_numpy(), pdf["gives"].to_numpy(), decoded(pdf["code"].to_numpy(), dim)
        held = pdf["lists"].to_numpy()
        rows, lists = np.repeat(np.arange(len(pdf)), [len(one) for one in held]), np.concatenate(held)
        order = np.argsort(lists, kind="stable")
        found = [part for m in np.split(rows[order], np.flatnonzero(np.diff(lists[order])) + 1) if gives[m].any() for part in _nearest(x, m[asks[m]], m[gives[m]], k)]
        own, near, similarity = (np.concatenate(column) for column in zip(*found)) if found else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))
        order = np.lexsort((near, -np.round(similarity, 12), own))
        own, near, similarity = own[order], near[order], similarity[order]
        # a neighbour met in several lists counts once
        first = np.sort(np.unique(own * len(pdf) + near, return_index=True)[1])
        own, near, similarity = own[first], near[first], similarity[first]
        rank = np.arange(len(own)) - np.searchsorted(own, own)
        own, near, similarity = own[rank < k], near[rank < k], similarity[rank < k]
        key = pdf["id"].to_numpy()
        return pd.DataFrame({"id": key[own], "near_id": key[near], "similarity": similarity})

    return run


def most_similar(vectors: DataFrame, k: int = 5, dim: int = 384, list_size: int = 160, max_centroids: int = 8192, sample_rows: int = 30_000, replicas: int = 6, ratio: float = 1.25, block: int = 2048) -> DataFrame:
    """id, near_id, similarity, rank: the ``k`` most similar other vectors of every valid vector.

    ``vectors`` has id, at and embedding; the row with the newest ``at`` counts (null is oldest), and
    an id whose newest vector is null, not of ``dim`` values, zero or not finite takes no part.
    Similarity is the cosine; ties go to the smaller id.

    Equal vectors form a class and are indexed once.  Centroids are fitted on at most about ``sample_rows``
    vectors (the index is fitted on a sample, every vector is indexed); there are about one for each
    ``list_size`` vectors, at most ``max_centroids`` (which bounds what is broadcast).  A vector is
    posted to, and looks into, the lists of those of its ``replicas`` nearest centroids, found on a graph, whose
    distance is within ``ratio`` of the nearest.  Vectors are stored and sent as 16-bit codes.  Lists are worked in groups
    of close ones, to which a vector is sent once, and the groups in turns: shuffled vectors of one turn,
    at most about as many as there are vectors, are removed before the next.  Lists longer than ``block`` are worked in pairs of blocks,
    so no task holds more than the vectors of eight blocks.  Tests hold the recall against brute force.
    """
    spark = vectors.sparkSession
    plain = vectors.schema["embedding"].dataType.simpleString() in ("array<float>", "array<double>")
    src = vectors.select(F.col("id").cast("string").alias("id"), F.col("at").cast("timestamp_ntz").alias("at"), F.col("embedding") if plain else F.col("embedding").cast("array<double>").alias("embedding"))
    # the newest rows are found by their fingerprints alone
    v = src.where("id is not null").mapInArrow(_unit(dim, False), "id string, at timestamp_ntz, fp binary")
    latest = Window.partitionBy("id").orderBy(F.col("at").desc_nulls_last(), F.col("fp").asc_nulls_last())
    members = stored(v.withColumn("_r", F.row_number().over(latest)).where("_r = 1 and fp is not null").select("id", "fp"))
    n = members.count()
    classes = members.groupBy("fp").agg(F.min("id").alias("least_id"), (F.count("*") > 1).alias("many"))
    alike = stored(members.join(classes.where("many"), "fp").select("least_id", "id"))  # all of the classes of several
    codes = src.where("id is not null").select("embedding").mapInArrow(_unit(dim, True), "fp binary, code binary")
    reps = stored(codes.join(classes, "fp").dropDuplicates(["fp"]).select(F.col("least_id").alias("id"), "code"))

    share = min(1.0, sample_rows / max(1, n))
    drawn = reps.where(F.abs(F.xxhash64("id")) % 1_000_000 < int(share * 1_000_000)).select("id", "code").toPandas().sort_values("id")
    x = decoded(drawn["code"].to_numpy(), dim) if len(drawn) else np.zeros((1, dim), dtype=np.float32)
    x = x[np.random.default_rng(0).permutation(len(x))]
    count = int(min(max_centroids, max(1, n // list_size), max(1, len(x))))
    fitted = balanced_centroids(x, count)
    graph = spark.sparkContext.broadcast(CentroidGraph(fitted))

    # assigned once; sizes of the lists are read from the column of lists alone
    posted = stored(reps.mapInArrow(_assigned(graph, dim, replicas, ratio), "id string, code binary, lists array<int>"))
    discard(reps)
    sizes = np.zeros(len(fitted), dtype=np.int64)
    for r in posted.select(F.explode("lists").alias("list")).groupBy("list").count().collect():  # a row for each centroid
        sizes[r["list"]] = r["count"]
    blocks = -(-sizes // block)
    work = np.where(blocks > 1, sizes * (2 * blocks - 1), sizes)
    groups = grouped(fitted, work, 8 * block)
    loads = np.bincount(groups, weights=work)
    count = int(max(1, min(np.ceil(work.sum() / max(1, n)), np.ceil(work.sum() / TURN))))
    # the largest groups are dealt first, each to the turn with the least so far
    turns, total = np.zeros(len(loads), dtype=np.int64), np.zeros(count)
    for group in np.argsort(-loads, kind="stable"):
        turns[group] = total.argmin()
        total[turns[group]] += loads[group]
    plan = spark.sparkContext.broadcast((groups.tolist(), blocks.tolist(), turns.tolist()))
    parts = []
    for turn in range(count):
        placed = posted.mapInArrow(_placed(plan, turn), "unit long, i int, j int, lists array<int>, asks boolean, gives boolean, id string, code binary")
        parts.append(stored(placed.groupBy("unit", "i", "j").applyInPandas(_within(dim, k), "id string, near_id string, similarity double")))
    discard(posted)
    # shuffled once: what follows keeps the division by id
    found = reduce(DataFrame.unionByName, parts).repartition("id").groupBy("id", "near_id").agg(F.max("similarity").alias("similarity"))
    best = Window.partitionBy("id").orderBy(F.round("similarity", 12).desc(), "near_id")
    ranked = found.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).select("id", "near_id", "similarity")

    # from classes to vectors: of each class, own or near, only the k + 1 smallest ids can be among the k
    few = alike.withColumn("_r", F.row_number().over(Window.partitionBy("least_id").orderBy("id"))).where(F.col("_r") <= k + 1).groupBy("least_id").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    own = alike.select("least_id").distinct().select(F.col("least_id").alias("id"), F.col("least_id").alias("near_id"), F.lit(1.0).alias("similarity"))
    asked = ranked.unionByName(own).join(alike.select(F.col("least_id").alias("id"), F.col("id").alias("member")), "id", "left")
    asked = asked.select(F.coalesce("member", "id").alias("id"), "near_id", "similarity").join(few.withColumnRenamed("least_id", "near_id"), "near_id", "left")
    offers = asked.select("id", "similarity", F.explode(F.coalesce("ids", F.array("near_id"))).alias("near_id")).where("id <> near_id")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.round("similarity", 12).desc(), "near_id"))
    return offers.withColumn("rank", rank).where(F.col("rank") <= k).select("id", "near_id", "similarity", "rank")
