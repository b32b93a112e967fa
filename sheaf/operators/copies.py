"""Differences between two copies of a table, row by row and field by field.

Fields are brought to the form in which equal values are written alike and then stand as digests. Identical rows of
one key cancel by multiplicity; what is left of a key on both sides is paired so that the number of differing fields
is least. A single row on each side is its own pairing; larger leftovers are paired exactly by a flow of least cost
through a sparse graph: rows do not meet one by one but through hubs, one for each set of rows of both sides that agree
in the same fields, and a hub of k fields costs the number of fields less k. Sets that only one side has, and those that
a larger set of fields holds in whole, have no hub; where the rest would outgrow the pairs, the pairs themselves stand.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions.keys import null_safe


def agreeing(left: list[tuple], right: list[tuple]) -> Iterator[tuple[int, list[int], list[int]]]:
    """Each largest set of rows of both sides that agree in the same fields: the number of other fields, and both sides' rows.

    Every set of fields is reached from the one without its last field, and once: a set that some earlier field would
    hold in whole is met there.
    """
    fields = len(left[0])

    def alike(a: list[int], b: list[int]) -> set[int]:
        first = left[a[0]]
        return {k for k in range(fields) if all(left[i][k] == first[k] for i in a) and all(right[j][k] == first[k] for j in b)}

    everything = (list(range(len(left))), list(range(len(right))))
    waiting = [(*everything, alike(*everything), 0)]
    while waiting:
        a, b, same, start = waiting.pop()
        yield fields - len(same), a, b
        for k in range(start, fields):
            if k in same:
                continue
            parts: dict = defaultdict(lambda: ([], []))
            for i in a:
                parts[left[i][k]][0].append(i)
            for j in b:
                parts[right[j][k]][1].append(j)
            for x, y in parts.values():
                if x and y:
                    inner = alike(x, y)
                    if all(f in same or f >= k for f in inner):
                        waiting.append((x, y, inner, k + 1))


def assignment(left: list[tuple], right: list[tuple], left_n: list[int], right_n: list[int]) -> list[tuple[int, int, int]]:
    """Pairs of rows as many as the smaller side allows, with the least sum of differing fields: (left, right, how many).

    Rows are tuples of comparable values with multiplicities. A least-cost flow with potentials; each round sends
    a blocking flow along all shortest paths, so the rounds are as many as there are path costs. An empty side has no pairs.
    """
    if not left or not right:
        return []
    heads: list[list[int]] = [[] for _ in range(2 + len(left) + len(right))]
    to: list[int] = []
    room: list[int] = []
    cost: list[int] = []

    def edge(a: int, b: int, n: int, price: int) -> None:
        for x, y, r, p in ((a, b, n, price), (b, a, 0, -price)):
            heads[x].append(len(to))
            to.append(y)
            room.append(r)
            cost.append(p)

    source, sink = 0, 1
    for j, n in enumerate(left_n):
        edge(source, 2 + j, n, 0)
    for j, n in enumerate(right_n):
        edge(2 + len(left) + j, sink, n, 0)
    hubs, members = [], 0
    for hub in agreeing(left, right):
        hubs.append(hub)
        members += len(hub[1]) + len(hub[2])
        if members > len(left) * len(right):
            hubs = [(sum(x != y for x, y in zip(row, other)), [i], [j]) for i, row in enumerate(left) for j, other in enumerate(right)]
            break
    for price, a, b in hubs:
        heads.append([])
        hub = len(heads) - 1
        for i in a:
            edge(2 + i, hub, left_n[i], price)
        for j in b:
            edge(hub, 2 + len(left) + j, right_n[j], 0)
    potential = [0] * len(heads)
    while True:
        far = [1 << 60] * len(heads)
        far[source], queue = 0, [(0, source)]
        while queue:
            d, x = heapq.heappop(queue)
            if d > far[x]:
                continue
            for e in heads[x]:
                if room[e] and (n := d + cost[e] + potential[x] - potential[to[e]]) < far[to[e]]:
                    far[to[e]] = n
                    heapq.heappush(queue, (n, to[e]))
        if far[sink] >= 1 << 60:
            break
        for x, d in enumerate(far):
            potential[x] += min(d, far[sink])
        at, spent = [0] * len(heads), [False] * len(heads)
        path: list[int] = []
        x = source
        on = [False] * len(heads)
        on[source] = True
        while True:  # depth first along edges of no reduced cost, without recursion
            if x == sink:
                n = min(room[e] for e in path)
                for e in path:
                    room[e] -= n
                    room[e ^ 1] += n
                for e in path:
                    on[to[e]] = False
                path, x = [], source
                continue
            while at[x] < len(heads[x]):
                e = heads[x][at[x]]
                y = to[e]
                if room[e] and not spent[y] and not on[y] and cost[e] + potential[x] == potential[y]:
                    break
                at[x] += 1
            if at[x] < len(heads[x]):
                path.append(e)
                on[y] = True
                x = y
                continue
            spent[x] = True
            if x == source:
                break
            on[x] = False
            e = path.pop()
            x = to[e ^ 1]
            at[x] += 1
    # what flows through a hub is dealt out row by row
    pairs: list[tuple[int, int, int]] = []
    for hub in range(2 + len(left) + len(right), len(heads)):
        into = [(to[e], room[e]) for e in heads[hub] if e & 1 and room[e]]
        out = [(to[e], room[e ^ 1]) for e in heads[hub] if not e & 1 and room[e ^ 1]]
        while into and out:
            (x, n), (y, m) = into.pop(), out.pop()
            k = min(n, m)
            pairs.append((x - 2, y - 2 - len(left), k))
            if n > k:
                into.append((x, n - k))
            if m > k:
                out.append((y, m - k))
    return pairs


def counted_rows(a: DataFrame, b: DataFrame, key: str, fields: dict[str, Column], version: str | None) -> DataFrame:
    """_key, the fields' digests _0, _1, ..., na and nb: how often each row of a key is in either copy."""
    digests = [F.unhex(F.md5(null_safe(form))).alias(f"_{i}") for i, form in enumerate(fields.values())]
    own = [f"_{i}" for i in range(len(fields))]
    at = F.col(version) if version else F.lit(0)

    def side(rows: DataFrame, mark: int) -> DataFrame:
        # maps can't be compared as they are; without version whole rows decide what is repeated
        whole = [] if version else [(F.array_sort(F.map_entries(c)) if t.startswith("map") else F.col(c)).alias(f"_w{i}") for i, (c, t) in enumerate(rows.dtypes)]
        return rows.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.coalesce(at.cast("timestamp").cast("double") if version else at, F.lit(float("-inf"))).alias("_at"), F.lit(mark).alias("_side"), *digests, *whole).transform(lambda r: r if version else r.distinct().select("_key", "_at", "_side", *own))

    rows = side(a, 0).unionByName(side(b, 1))
    if version:
        latest = rows.groupBy("_key", "_side").agg(F.max("_at").alias("_at"))
        rows = rows.join(latest, ["_key", "_side", "_at"], "left_semi").distinct()
    in_side = lambda s: F.coalesce(F.sum((F.col("_side") == s).cast("int")), F.lit(0))
    return rows.groupBy("_key", *own).agg(in_side(0).alias("na"), in_side(1).alias("nb"))


def balanced(counted: DataFrame, own: list[str]) -> tuple[DataFrame, DataFrame]:
    """What is left of each row after identical ones cancelled by multiplicity (la, lb), and the sums and any left row of each key."""
    left = counted.withColumns({"la": F.greatest(F.col("na") - F.col("nb"), F.lit(0)), "lb": F.greatest(F.col("nb") - F.col("na"), F.lit(0))})
    sums = [F.sum(n).alias(n) for n in ("na", "nb", "la", "lb")]
    return left, left.groupBy("_key").agg(*sums, F.sum(F.least("na", "nb")).alias("cancelled"), *[F.max(F.when(F.col("la") > 0, F.col(c))).alias(f"a{c}") for c in own], *[F.max(F.when(F.col("lb") > 0, F.col(c))).alias(f"b{c}") for c in own])


def pair_costs(left: DataFrame, per_key: DataFrame, own: list[str]) -> DataFrame:
    """_key, i and n: of keys with leftovers on both sides in how many pairs field i differs; pairs without a difference give no row."""
    differing = F.array_compact(F.array(*[F.when(F.col(f"a{c}") != F.col(f"b{c}"), F.lit(i)) for i, c in enumerate(own)]))
    single = per_key.where("la = 1 and lb = 1").select("_key", F.explode(differing).alias("i"), F.lit(1).cast("long").alias("n"))
    many = per_key.where("la > 0 and lb > 0 and (la > 1 or lb > 1)").select("_key")

    def pair(rows: pd.DataFrame) -> pd.DataFrame:
        one, two = rows[rows["la"] > 0], rows[rows["lb"] > 0]
        x, y = (list(r[own].itertuples(index=False, name=None)) for r in (one, two))
        hit = [0] * len(own)
        for i, j, n in assignment(x, y, one["la"].tolist(), two["lb"].tolist()):
            for k in range(len(own)):
                hit[k] += n * (x[i][k] != y[j][k])
        return pd.DataFrame([(rows["_key"].iloc[0], k, n) for k, n in enumerate(hit) if n], columns=["_key", "i", "n"])

    kind = dict(left.dtypes)["_key"]
    return single.unionByName(left.where("la > 0 or lb > 0").join(many, "_key", "left_semi").groupBy("_key").applyInPandas(pair, f"_key {kind}, i int, n long"))


def copy_differences(a: DataFrame, b: DataFrame, key: str, fields: dict[str, Column], version: str | None = None, names: tuple[str, str] = ("a", "b")) -> DataFrame:
    """key, field_name, diff_kind: rows of keys on one side only, and each field that differs between paired rows.

    fields maps a field's name to its form, the same for both copies; null equals only null. Rows without key do not
    count, rows repeated in all columns count once. Without version all other rows count, those alike in the fields as
    often as they are there; if a key of both copies has more rows on one side, those in no pair are told by a row
    `surplus_` and that side's name. With version, only the rows with a key's latest version count (nulls are the
    earliest), all of them if several tie; these are versions of one row, so rows alike in the fields count once and
    those in no pair differ in nothing. Two empty copies give no rows.
    """
    own = [f"_{i}" for i in range(len(fields))]
    left, per_key = balanced(counted_rows(a, b, key, fields, version), own)
    label = F.array(*map(F.lit, fields))
    row = lambda where, first, second, kind: per_key.where(where).select("_key", F.lit("row").alias("field_name"), F.when(F.expr(first), f"{kind}_{names[0]}").otherwise(f"{kind}_{names[1]}").alias("diff_kind"))
    found = row("na = 0 or nb = 0", "nb = 0", "na = 0", "only").unionByName(pair_costs(left, per_key, own).select("_key", label[F.col("i")].alias("field_name"), F.lit("differs").alias("diff_kind")))
    if not version:
        found = found.unionByName(row("na > 0 and nb > 0 and la <> lb", "la > lb", "la < lb", "surplus"))
    return found.distinct().select(F.col("_key").alias(key), "field_name", "diff_kind")


def copy_balance(a: DataFrame, b: DataFrame, key: str, fields: dict[str, Column], version: str | None = None) -> DataFrame:
    """key, n_cancelled, n_pairs, n_differing, n_surplus of each key of both copies.

    How many rows cancel as identical, how many are paired, in how many fields the pairs differ altogether, which is the
    least possible, and how many rows of the larger side are in no pair. Rows count as in copy_differences.
    """
    own = [f"_{i}" for i in range(len(fields))]
    left, per_key = balanced(counted_rows(a, b, key, fields, version), own)
    costs = pair_costs(left, per_key, own).groupBy("_key").agg(F.sum("n").alias("n_differing"))
    both = per_key.where("na > 0 and nb > 0").join(costs, "_key", "left")
    return both.select(F.col("_key").alias(key), F.col("cancelled").alias("n_cancelled"), F.least("la", "lb").alias("n_pairs"), F.coalesce("n_differing", F.lit(0)).alias("n_differing"), F.abs(F.col("la") - F.col("lb")).alias("n_surplus"))


def inventory_fields() -> dict[str, Column]:
    """The compared fields of an inventory in the form in which equal values are written alike."""
    counts = F.array_sort(F.map_entries(F.map_filter("paragraph_counts", lambda _, v: v.isNull() | (v != 0))))
    return {
        "paragraph_counts": F.to_json(counts),
        "media_hashes": F.to_json(F.array_sort(F.array_distinct(F.transform("media_hashes", lambda x: F.lower(x))))),
        "missing_occurrences": F.to_json(F.array_sort("missing_occurrences")),
        "paragraph_total": F.col("paragraph_total"),
    }
