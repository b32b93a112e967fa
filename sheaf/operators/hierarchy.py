"""Trees and reference graphs by pointer doubling: each round joins every row that still moves to the row it points at, so a
chain of depth d takes log2(d) rounds, whatever its width. Rounds end when no row moves, or when there have been more
steps than there are rows, which only a cycle allows; no depth is too great.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.session import cut, without_constraints


def doubled(state: DataFrame, node: str, combine: dict[str, Callable[[Column, Column], Column]]) -> DataFrame:
    """state with every row moved to the end of its chain: _next is null there, or still set on and before cycles.

    state has node, _next (null at an end) and the columns of combine, each a function of a row's own value and that of
    the row it points at. Only rows that still move are computed and written again.
    """
    c = F.col
    with without_constraints(state.sparkSession):
        whole = cut(state)
        rounds = ceil(log2(whole.count() + 1)) + 1
        moving, done = whole.where("_next is not null"), [whole.where("_next is null")]
        for _ in range(rounds):
            if moving.isEmpty():
                break
            every = reduce(DataFrame.unionByName, done, moving)
            far = every.select(c(node).alias("_n"), c("_next").alias("_far"), *[c(k).alias(f"_f_{k}") for k in combine])
            stepped = cut(moving.join(far, c("_next") == c("_n")).select(node, c("_far").alias("_next"), *[f(c(k), c(f"_f_{k}")).alias(k) for k, f in combine.items()]))
            moving = stepped.where("_next is not null")
            done.append(stepped.where("_next is null"))
    return reduce(DataFrame.unionByName, done, moving)


def pointing(nodes: DataFrame, node: str, parent: str, *columns: Column | str) -> DataFrame:
    """node, _next and columns: a parent that is null or not in the table is no pointer."""
    known = nodes.select(F.col(node).alias("_there")).where("_there is not null")
    return nodes.where(F.col(node).isNotNull()).join(known, F.col(parent) == F.col("_there"), "left").select(node, F.col("_there").alias("_next"), *columns)


def resolve_chain(nodes: DataFrame, node: str, parent: str, attributes: list[str]) -> DataFrame:
    """node, depth, root, cyclic and attributes: each attribute from the node or its nearest ancestor that has one.

    A parent that is null or not in the table ends the chain (R01 to R04). Nodes that reach no end are cyclic: their
    depth and root are null and their attributes are what the walk met. node must be unique.
    """
    c = F.col
    ends = c("_next").isNull()
    state = pointing(nodes, node, parent, *attributes).withColumns({"root": F.when(ends, c(node)), "depth": F.when(ends, 0).otherwise(1).cast("long")})
    first = lambda own, far: F.coalesce(own, far)
    state = doubled(state, node, {"root": first, "depth": lambda own, far: own + far} | {a: first for a in attributes})
    return state.select(node, F.when(ends, c("depth")).cast("int").alias("depth"), F.when(ends, c("root")).alias("root"), (~ends).alias("cyclic"), *attributes)


def cycle_members(edges: DataFrame, source: str, target: str) -> DataFrame:
    """source: the nodes that lie on a cycle of a graph in which each node points at one other.

    Following the pointers for as many steps as there are nodes ends on cycles only; doubling takes log2 of that.
    """
    c = F.col
    step = cut(edges.where(c(source).isNotNull() & c(target).isNotNull()).select(source, target))
    nodes = step.count()
    for _ in range(ceil(log2(nodes + 1)) + 1):
        if step.isEmpty():
            break
        step = cut(step.join(step.select(c(source).alias("_s"), c(target).alias("_t")), c(target) == c("_s")).select(source, c("_t").alias(target)))
    return step.select(c(target).alias(source)).distinct()


def preorder(nodes: DataFrame, node: str, parent: str, order: str) -> DataFrame:
    """node, level and path: the ordinals from the root down; sorted by path, parents come before their children.

    A root has no parent; nodes on or below a cycle, or below a parent that is not in the table, have no place and no
    row. Paths grow by doubling, so a tree of any depth takes few rounds.
    """
    c = F.col
    own = nodes.select(c(node).alias("_id"), c(parent).alias("_up"), c(order).alias("_o"))
    ends = resolve_chain(own, "_id", "_up", []).where("not cyclic").select("_id", "root")
    roots = own.where("_up is null").select(c("_id").alias("root"))
    placed = own.join(ends.join(roots, "root").select("_id"), "_id")
    state = doubled(pointing(placed, "_id", "_up", F.array("_o").alias("path")), "_id", {"path": lambda own, far: F.concat(far, own)})
    return state.select(c("_id").alias(node), F.size("path").alias("level"), "path")


def nearest_ancestor(rows: DataFrame, path: str, declared: DataFrame, declared_path: str, value: str, into: str, separator: str = "/") -> DataFrame:
    """rows with the value of the longest declared path that is the row's own or an ancestor's (R08); null without one.

    A row is opened to its ancestors, as many as it is deep, and joined by equality.
    """
    c = F.col
    parts = F.split(path, f"\\Q{separator}\\E")
    opened = rows.select(path).distinct().select(path, F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), separator))).alias("_up"))
    met = opened.join(declared.select(c(declared_path).alias("_up"), c(value).alias("_v")), "_up")
    best = met.groupBy(path).agg(F.max_by("_v", F.struct(F.length("_up"), "_v")).alias(into))
    return rows.join(best, path, "left")
