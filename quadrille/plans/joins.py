"""Exact kNN join and range join over a grid or a tree."""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.geometry import axes, distance
from ..operators.knn import ROWS_A_SEARCH, array_lists, by_group, dealt, known_hot, lists_by, local_knn, merge_neighbors, part_limits, range_block, sent_if_few, top_k, whole_knn
from ..operators.overlap import cells_in_reach, overlap_cells, padded, seed_cells, tightened
from ..operators.partition import Grid, Tree, cell_counts, with_cell
from ..sources.stored import StoredTraining
from ..staging import staged
from .grids import GROUP_COST, choose_grid, search_grid

#: Pairs of a ball and a training point that a task of ``range_join`` compares, and gives at most.
RANGE_PAIRS = 1 << 22


def _observed(seen: Observation) -> int:
    try:
        return seen.get["n"]
    except Py4JJavaError:  # Spark dropped a phase that it found to have no rows, and tells nothing of it
        return 0


class JoinCounters:
    """Rows counted by ``DataFrame.observe`` while a ``knn_join`` runs; ``read`` them after an action on its result.

    A task that runs again after a loss is counted again, as Spark's accumulators have it.
    """

    def __init__(self):
        self._seen: dict[str, Observation] = {}

    def watch(self, name: str, df: DataFrame) -> DataFrame:
        self._seen[name] = Observation()
        return df.observe(self._seen[name], F.count(F.lit(1)).alias("n"))

    def read(self) -> dict[str, int]:
        """local_distances, seed_distances, rest_distances: pairs whose distance was computed in cells of their own, in a starved
        query's nearest cells, in the rest; distances: all of them; query_copies: queries sent to other cells;
        pruned_cells: those of a query's overlapped cells that its shrunken ball left out.
        """
        n = {name: _observed(seen) for name, seen in self._seen.items()}
        phases = {f"{p}_distances": n.get(f"{p}_distances", 0) for p in ("local", "seed", "rest")}
        met, sent = n.get("overlaps", 0), n.get("seed_cells", 0) + n.get("rest_cells", 0)
        return phases | {"distances": sum(phases.values()), "overlapped_cells": met, "query_copies": sent, "pruned_cells": met - sent}


def knn_join(queries: DataFrame, training: DataFrame, k: int, partitioning: Grid | Tree | None = None, method: str = "bf", unique_ids: bool = True, exclude_self: bool = False, salts: int = 1, dims: int = 2, counters: JoinCounters | None = None) -> DataFrame:
    """(qid, tid, dist, rank): for every query its min(k, |T|) nearest training points, exactly; ties go to the smaller tid.

    Points must lie in [0, 1) (see ``split_domain`` and ``normalise_points``). unique_ids=False: tids may repeat, and each
    counts once; exclude_self: a point is not its own neighbour. Steps: local lists by cell, a proven radius for each
    query, cells within it, lists from those, merge. Only queries whose ball leaves their cell go on after the first. A
    query without a full local list takes one from the cells near it first, and its ball shrinks to that.

    Without a partitioning a grid of ``dims`` axes is chosen by its cost (see ``choose_grid``). Cells with too many pairs of
    points for one task are dealt to parts, by counts of both sides (see ``hot_cells``); only their rows are copied.
    Without a partitioning the method ``cells`` takes a grid of fewer, larger cells, as it makes no row for each pair.
    counters: filled while the join runs, with method ``bf``.
    """
    if counters is not None and method != "bf":
        raise ValueError("counters need the method bf, whose pairs Spark sees")
    watch = counters.watch if counters is not None else lambda name, df: df
    if partitioning is None:
        partitioning = search_grid(training, dims) if method == "cells" else choose_grid(queries, training, k, dims, GROUP_COST if method == "ps" else 0.0)
    names = axes(partitioning.dims)
    q = with_cell(queries.select("qid", *names), partitioning)
    t = with_cell(training.select("tid", *names), partitioning)
    cells = cell_counts(t)
    # With repeated ids a block's rows may be fewer points; each id is then weighed in one of its cells only.
    weights = cells if unique_ids else cell_counts(t.groupBy("tid").agg(F.min("cell").alias("cell")))
    need = k + exclude_self
    if (weights.agg(F.sum("n")).first()[0] or 0) < need:
        few_rows = unique_ids or (cells.agg(F.sum("n")).first()[0] or 0) < need
        return whole_knn(q, F.broadcast(t), k, partitioning.dims, exclude_self) if few_rows else _few_ids(q, t, k, partitioning, method, exclude_self)
    # Both are read more than once, and the overlaps need all of the lists: stored, they are worked out once.
    limits = part_limits(method)
    hot = None if salts > 1 else known_hot(q, t, **limits)
    local = staged(local_knn(q, t, k, partitioning.dims, method, unique_ids=unique_ids, exclude_self=exclude_self, salts=salts, hot=hot, watch=lambda pairs: watch("local_distances", pairs)).select("qid", "tid", "dist", "rank"), "local-lists")
    overlaps = staged(watch("overlaps", overlap_cells(q, cells, local, k, partitioning, weights, need)), "overlaps")
    hot_balls = known_hot(overlaps, t, **limits)
    # Most lists are whole where cells are large; only those of queries that meet other cells are sent on.
    met = sent_if_few(overlaps.select("qid").distinct()) if method == "cells" else overlaps
    if met is None:
        return local
    whole = local.join(met, "qid", "left_anti") if method == "cells" else None
    local = local.join(met, "qid", "left_semi") if method == "cells" else local
    every = lambda merged: merged if whole is None else whole.unionByName(merged)

    def nearest(balls: DataFrame, phase: str) -> DataFrame:
        q_side, t_side, keys = (balls, t, ["cell"]) if hot_balls is None else dealt(balls, t, hot_balls, dims=partitioning.dims)
        if method == "cells":
            return _lists_in_balls(q_side, t_side, k, partitioning.dims, keys, exclude_self)
        near = _in_balls(q_side, t_side, partitioning.dims, keys, lambda pairs: watch(phase, pairs))
        if exclude_self:
            near = near.where("qid <> tid")
        return top_k(near.select(*keys, "qid", "tid", "dist"), k, [*keys, "qid"], unique_ids).select("qid", "tid", "dist")

    if overlaps.where("starved").isEmpty():
        return every(merge_neighbors(local, nearest(watch("rest_cells", overlaps), "rest_distances"), k=k, disjoint=unique_ids))
    seeds = seed_cells(overlaps, weights, need)
    first = staged(merge_neighbors(local, nearest(watch("seed_cells", seeds), "seed_distances"), k=k, disjoint=unique_ids), "first-lists")
    rest = tightened(overlaps.join(seeds.select("qid", "cell"), ["qid", "cell"], "left_anti"), first, k)
    return every(merge_neighbors(first, nearest(watch("rest_cells", rest), "rest_distances"), k=k, disjoint=unique_ids))


def stored_knn_join(queries: DataFrame, stored: StoredTraining, k: int, method: str = "bf", exclude_self: bool = False) -> DataFrame:
    """``knn_join`` with training points that are stored by cell: queries move to them, and none of theirs is shuffled.

    But for cells with too many pairs for one task, whose points are dealt to parts. The counts are the store's, so points
    are read where they are compared only. A store that has a newer version is refused.
    """
    stored.check()
    partitioning, unique_ids, need = stored.partitioning, stored.unique_ids, k + exclude_self
    names, t = axes(partitioning.dims), stored.points.drop("part")
    q = with_cell(queries.select("qid", *names), partitioning)
    cells, weights = stored.counts.select("cell", "n"), stored.counts.where("weight > 0").select("cell", F.col("weight").alias("n"))
    rows, ids = stored.counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    if ids < need:
        few_rows = unique_ids or rows < need
        return whole_knn(q, F.broadcast(t), k, partitioning.dims, exclude_self) if few_rows else _few_ids(q, t, k, partitioning, method, exclude_self)
    lists = [lists_by(*both, k, partitioning.dims, method, keys, unique_ids, exclude_self) for *both, keys in stored.pairings(q, **part_limits(method))]
    local = staged(merge_neighbors(*lists, k=k, disjoint=unique_ids).select("qid", "tid", "dist"), "local-lists")
    overlaps = staged(overlap_cells(q, cells, local, k, partitioning, weights, need), "overlaps")

    def nearest(balls: DataFrame) -> list[DataFrame]:
        out = []
        for b, points, keys in stored.pairings(balls, **part_limits(method)):
            if method == "cells":
                out.append(_lists_in_balls(b, points, k, partitioning.dims, keys, exclude_self))
                continue
            near = _in_balls(b, points, partitioning.dims, keys)
            if exclude_self:
                near = near.where("qid <> tid")
            out.append(top_k(near.select(*keys, "qid", "tid", "dist"), k, [*keys, "qid"], unique_ids).select("qid", "tid", "dist"))
        return out

    if overlaps.where("starved").isEmpty():
        return merge_neighbors(local, *nearest(overlaps), k=k, disjoint=unique_ids)
    seeds = seed_cells(overlaps, weights, need)
    first = staged(merge_neighbors(local, *nearest(seeds), k=k, disjoint=unique_ids), "first-lists")
    rest = tightened(overlaps.join(seeds.select("qid", "cell"), ["qid", "cell"], "left_anti"), first, k)
    return merge_neighbors(first, *nearest(rest), k=k, disjoint=unique_ids)


def _few_ids(q: DataFrame, t: DataFrame, k: int, partitioning: Grid | Tree, method: str, exclude_self: bool) -> DataFrame:
    """Training rows of at most k ids, any number each: the nearest row of every id, by a join of its own, then ranked."""
    lists, names = [], axes(partitioning.dims)
    for (tid,) in t.select("tid").distinct().collect():
        rows = staged(t.where(F.col("tid") == tid).select(F.monotonically_increasing_id().alias("tid"), *names), "rows-of-id")
        own = q.where(F.col("qid") != tid) if exclude_self else q
        lists.append(knn_join(own, rows, 1, partitioning, method).select("qid", F.lit(tid).cast(t.schema["tid"].dataType).alias("tid"), "dist"))
    return merge_neighbors(*lists, k=k)


def _lists_in_balls(balls: DataFrame, t: DataFrame, k: int, dims: int, keys: list[str], exclude_self: bool) -> DataFrame:
    """(qid, tid, dist): of each ball's points the k nearest, by a search of cell arrays."""
    return array_lists(balls.withColumn("radius", padded(F.col("radius"))), t, k, dims, keys, exclude_self, "radius").select("qid", "tid", "dist")


def _in_balls(balls: DataFrame, t: DataFrame, dims: int, keys: list[str] | None = None, watch: Callable[[DataFrame], DataFrame] = lambda pairs: pairs) -> DataFrame:
    """balls(qid, coordinates, radius, cell) x t(cell, tid, coordinates), with dist, within the radius."""
    names, keys = axes(dims), keys or ["cell"]
    met = balls.join(t.select(*keys, "tid", *(F.col(a).alias(f"_t{a}") for a in names)), keys)
    dist = distance([F.col(a) for a in names], [F.col(f"_t{a}") for a in names])
    return watch(met).withColumn("dist", dist).where(F.col("dist") <= padded(F.col("radius")))


def range_join(balls: DataFrame, training: DataFrame, partitioning: Grid | Tree) -> DataFrame:
    """(qid, tid, dist): all training points within each ball, border included. balls: (qid, x, y[, z], radius)."""
    names = axes(partitioning.dims)
    t = with_cell(training.select("tid", *names), partitioning)
    met = cells_in_reach(balls.select("qid", *names, "radius"), cell_counts(t), partitioning).select("qid", *names, "radius", "cell")
    hot = known_hot(met, t, pairs=RANGE_PAIRS, rows=ROWS_A_SEARCH)
    q_side, t_side, keys = (met, t, ["cell"]) if hot is None else dealt(met, t, hot, dims=partitioning.dims)
    return by_group(q_side, t_side, partitioning.dims, keys, range_block, ("radius",), ranked=False).select("qid", "tid", "dist")
