"""Groups of linked samples, and neighbour-joining trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, materialize


def connected_components(links: DataFrame, *, src: str = "a", dst: str = "b") -> DataFrame:
    """``(id, comp)`` for each id in ``links``; ``comp`` is the smallest id reachable.

    Each round every id takes the least label among itself and its neighbours, then
    the label of that label.  The sum over a hub's links is combined before the
    shuffle, so a hub costs one row a task.  Labels are written to the shared folder
    each round: nothing is collected, and a lost executor costs one round at most.
    """
    ways = F.array(F.struct(F.col(src).alias("a"), F.col(dst).alias("b")), F.struct(F.col(dst).alias("a"), F.col(src).alias("b")))
    edges = materialize(links.where(F.col(src) != F.col(dst)).select(F.inline(ways)).distinct(), "edges")
    labels = materialize(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("comp")), "labels")
    while True:
        near = edges.join(labels.select(F.col("id").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        step = labels.join(near, labels.id == near.a).select("id", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        jump = step.join(step.select(F.col("id").alias("comp"), F.col("comp").alias("far")), "comp", "left")
        new = materialize(jump.select("id", "old", F.least("comp", "far").alias("comp")), "labels")
        done = new.where("comp <> old").isEmpty()
        discard(labels)
        labels = new.select("id", "comp")
        if done:
            discard(edges)
            return labels


def clone_groups(pairs: DataFrame, called: DataFrame, threshold: float) -> DataFrame:
    """``(comp, ind, best)``: samples linked at the threshold, with each group's best sample (most calls; the higher id of equals)."""
    links = pairs.where(F.col("match_perc") >= threshold).select(F.col("ind1").alias("a"), F.col("ind2").alias("b"))
    members = connected_components(links).withColumnRenamed("id", "ind").join(called, "ind")
    best = members.groupBy("comp").agg(F.max_by("ind", F.struct("genotyped", "ind")).alias("best"))
    return members.join(best, "comp").select("comp", "ind", "best")


def clone_stats(pairs: DataFrame, groups: DataFrame, samples: DataFrame) -> DataFrame:
    """Members, populations and similarities of each group; ``pairs`` are those inside the groups, with their ``comp``."""
    spread = pairs.groupBy("comp").agg(F.min("match_perc").alias("lowest"), F.max("match_perc").alias("highest"))
    who = groups.join(samples.select("ind", "pop"), "ind").groupBy("comp", "best").agg(F.array_join(F.transform(F.array_sort(F.collect_set("ind")), lambda x: x.cast("string")), ",").alias("members"), F.countDistinct("pop").alias("n_pops"))
    return who.join(spread, "comp")


class _Leaves:
    """A square matrix of distances gathered from rows, with the leaves in the order of their names."""

    def __init__(self) -> None:
        self.at: dict = {}
        self.rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, batch: pa.RecordBatch) -> None:
        codes = []
        for column in batch.columns[:2]:
            own = column.dictionary_encode()
            codes.append(np.array([self.at.setdefault(x, len(self.at)) for x in own.dictionary.to_pylist()], np.int32)[own.indices.to_numpy()])
        self.rows.append((*codes, batch.column(2).to_numpy()))

    def matrix(self) -> tuple[list[str], np.ndarray]:
        names = [str(x) for x in self.at]
        order = np.argsort(np.array(names, dtype=object), kind="stable")
        place = np.empty(len(names), np.int64)
        place[order] = np.arange(len(names))
        m = np.zeros((len(names), len(names)))
        while self.rows:
            i, j, d = self.rows.pop()
            m[place[i], place[j]] = m[place[j], place[i]] = d
        return [names[k] for k in order], m


#: Joins after which row sums are added up anew.
RESUM = 256


def _joins(names: list[str], m: np.ndarray) -> Iterator[tuple[str, str, float]]:
    """``(parent, child, length)`` of each edge; works in ``m``.

    With ``u`` a node's sum of distances over the number of nodes less two, the pair of the least ``m[i, j] - u[i] - u[j]``
    is joined.  Of each row the least ``m[i, j] - u[j]`` is kept from when the row was last read; as no ``u`` has grown since
    by more than ``grown`` tells, it bounds the row from below, and only rows whose bound is under the best pair are read again.
    """
    nodes, n, fresh = np.array(names, dtype=object), len(names), 0
    np.fill_diagonal(m, 0.0)
    total = m.sum(axis=1)
    np.fill_diagonal(m, np.inf)
    u, grown, kept = total / max(n - 2, 1), 0.0, np.full(n, -np.inf)
    live = np.ones(n, bool)
    while n > 2:
        bound, least, pair = np.where(live, kept - u, np.inf), np.inf, (0, 0)
        while bound[i := int(bound.argmin())] - grown < least:
            row = m[i] - u
            j = int(row.argmin())
            kept[i], bound[i] = row[j] + grown, np.inf
            if row[j] - u[i] < least:
                least, pair = row[j] - u[i], (i, j)
        a, b = min(pair), max(pair)
        ab, left = m[a, b], m[a, b] / 2 + (u[a] - u[b]) / 2
        parent, fresh = f"inner{fresh}", fresh + 1
        yield parent, nodes[a], float(left)
        yield parent, nodes[b], float(ab - left)
        live[[a, b]] = False
        far = np.where(live, m[a] + m[b], 0.0)
        joined = np.where(live, (far - ab) / 2, np.inf)
        total = np.where(live, total - far + (far - ab) / 2, 0.0)
        m[b], m[:, b] = np.inf, np.inf
        m[a], m[:, a] = joined, joined
        total[a], nodes[a], live[a], n = joined[live].sum(), parent, True, n - 1
        if n > 2 and 2 * n <= len(m):  # half of the places are empty
            m, nodes, total, u, kept = m[np.ix_(live, live)], nodes[live], total[live], u[live], kept[live]
            a = int(live[:a].sum())
            live, joined = np.ones(n, bool), m[a]
        if fresh % RESUM == 0:
            total = np.where(live, np.where(np.isinf(m), 0.0, m).sum(axis=1), 0.0)
        before, u = u, total / max(n - 2, 1)
        before[a] = u[a]
        grown += float((u - before)[live].max())
        kept = np.minimum(kept, joined - u[a] + grown)
        kept[a] = -np.inf
    if n == 2:
        x, y = np.flatnonzero(live)
        if nodes[x] == f"inner{fresh - 1}":
            x, y = y, x
        yield nodes[y], nodes[x], float(m[x, y])


def neighbour_joining(d: DataFrame) -> DataFrame:
    """``(parent, child, length)`` of the tree over a distance table ``(ind1, ind2, d)``.

    The method is sequential in its joins, so one task works in numpy, on the whole matrix: 8 bytes a
    pair of leaves.  The distances are made in as many tasks as they have, and gathered as rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaves = _Leaves()
        for batch in batches:
            leaves.add(batch)
        edges = [*_joins(*leaves.matrix())] if leaves.at else []
        columns = [*zip(*edges, strict=True)] or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.float64()), strict=True)], ["parent", "child", "length"])

    return d.select("ind1", "ind2", "d").repartition(1).mapInArrow(run, "parent string, child string, length double")
