"""Ordered, interval, tree and layer operators against brute force."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sheaf.functions.jsontree import pointer
from sheaf.operators.candidates import ranked_candidates
from sheaf.operators.clustering import clusters, missing_roles, role_candidates
from sheaf.operators.hierarchy import cycle_members, nearest_ancestor, preorder, resolve_chain
from sheaf.operators.layers import json_leaves, merge_layers
from sheaf.operators.matching import bag_difference, greedy_matches, latest_before, overlay
from sheaf.operators.metrics import per_role, role_metrics
from sheaf.operators.windows import islands, neighbours, numbered, running
from sheaf.sources.files import merged
from tests.oracle import compare, connection

c = F.col


@pytest.fixture
def groups():
    random.seed(11)
    data = []
    for g in "abc":
        for i in range({"a": 300, "b": 5, "c": 1}[g]):
            data.append((g, i * 3, random.choice([None, 1, 2, 3])))
    random.shuffle(data)
    return data


def test_running(spark, groups):
    frame = spark.createDataFrame([*groups, (None, 1, 1)], "g string, o long, v int")
    got = {(r.g, r.o): (r.s, r.l) for r in running(frame, ["g"], ["o"], {"s": c("v")}, {"l": c("v")}, "o", 50).collect()}
    want, s, last = {}, {}, {}
    for g, o, v in sorted(groups, key=lambda x: x[:2]):
        s[g] = s.get(g, 0) + (v or 0)
        last[g] = v if v is not None else last.get(g)
        want[g, o] = (s[g], last[g])
    assert got == want
    assert numbered(frame.limit(0), ["g"], ["o"]).count() == 0


def test_neighbours_and_islands(spark, groups):
    frame = numbered(spark.createDataFrame(groups, "g string, o long, v int"), ["g"], ["o"])
    got = sorted(tuple(r) for r in neighbours(frame, ["g"], "n", ["v"]).select("g", "n", "v", "prev_v", "next_v").collect())
    want, runs = [], []
    for g in "abc":
        vs = [v for x, _, v in sorted(groups, key=lambda x: x[:2]) if x == g]
        want += [(g, i + 1, v, vs[i - 1] if i else None, vs[i + 1] if i + 1 < len(vs) else None) for i, v in enumerate(vs)]
        for i, v in enumerate(vs):
            if i and vs[i - 1] == v:
                runs[-1][3] = i + 1
            else:
                runs.append([g, v, i + 1, i + 1])
    assert got == want
    found = sorted(((r.g, r.v, r["first"], r["last"]) for r in islands(frame.withColumnRenamed("n", "at"), ["g"], "at", "v").collect()), key=lambda r: (r[0], r[2]))
    assert found == [tuple(r) for r in runs]


def test_latest_before(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 5, "y"), ("a", 9, "z"), ("b", 4, "w")], "g string, at long, t string")
    starts = spark.createDataFrame([("a", 5, 50), ("a", 5, 51), ("a", 8, 80), ("c", 1, 1)], "g string, at long, v int")
    pick = lambda ties: {r.t: r.h for r in latest_before(rows, starts, ["g"], "at", "v", "h", ties).collect()}
    assert pick("start") == {"x": None, "y": 51, "z": 80, "w": None}
    assert pick("row") == {"x": None, "y": None, "z": 80, "w": None}


def test_overlay_and_bags(spark):
    one = spark.createDataFrame([("d", 0, 4, "A"), ("d", 6, 9, "B"), ("d", 9, 9, "empty")], "g string, s long, e long, v string")
    two = spark.createDataFrame([("d", 2, 7, "x")], "g string, s long, e long, v string")
    got = sorted(((tuple(r)) for r in overlay(one, two, ["g"], "s", "e", "v").collect()), key=lambda r: r[1])
    assert got == [("d", 0, 2, "A", None), ("d", 2, 4, "A", "x"), ("d", 4, 6, None, "x"), ("d", 6, 7, "B", "x"), ("d", 7, 9, "B", None)]
    left = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "k string")
    right = spark.createDataFrame([("a",), ("b",), ("b",)], "k string")
    assert sorted((tuple(r) for r in bag_difference(left, right, ["k"]).collect()), key=repr) == [("a", 1), (None, 1)]


def test_greedy(spark):
    want = spark.createDataFrame([("d", 1, "a"), ("d", 2, "b"), ("d", 3, "a"), ("d", 4, "b"), ("e", 1, "a")], "g string, o long, k string")
    have = spark.createDataFrame([("d", 10, "b"), ("d", 11, "a"), ("d", 12, "a"), ("d", 13, "b")], "g string, o long, k string")
    got = sorted((r.g, r.o, r.matched) for r in greedy_matches(want, have, "g", "k", "o").collect())
    assert got == [("d", 1, 11), ("d", 2, 13), ("d", 3, None), ("d", 4, None), ("e", 1, None)]
    random.seed(2)
    rows = [[(g, o, random.choice(["a", "b", "c", None])) for g in range(8) for o in range(40)] for _ in range(2)]
    want, plain = [], {}
    for g in range(8):
        cursor = -1
        for _, o, k in (r for r in rows[0] if r[0] == g):
            hit = next((p for x, p, q in rows[1] if x == g and q == k and k and p > cursor), None)
            cursor = cursor if hit is None else hit
            plain[g, o] = hit
    frames = [spark.createDataFrame(r, "g long, o int, k string") for r in rows]
    assert {(r.g, r.o): r.matched for r in greedy_matches(*frames, "g", "k", "o").collect()} == plain


def test_chains(spark):
    styles = spark.createDataFrame([("grand", None, 14.0, True, None), ("parent", "grand", 16.0, None, None), ("child", "parent", None, False, "heavy"), ("x", "y", 1.0, None, None), ("y", "x", None, True, None), ("lost", "nowhere", None, None, "f")], "id string, up string, size double, bold boolean, font string")
    got = {r.id: tuple(r)[1:] for r in resolve_chain(styles, "id", "up", ["size", "bold", "font"]).collect()}
    assert got["child"] == (2, "grand", False, 16.0, False, "heavy") and got["lost"] == (0, "lost", False, None, None, "f")
    assert got["x"][1:4] == (None, True, 1.0) and got["y"][2] is True
    assert {r.id for r in cycle_members(styles.where("up is not null"), "id", "up").collect()} == {"x", "y"}
    long = spark.range(1, 701).select(c("id"), F.when(c("id") > 1, c("id") - 1).alias("up"), F.when(c("id") == 1, "r").alias("v"))
    deep = resolve_chain(long, "id", "up", ["v"])
    assert deep.where("v = 'r' and root = 1 and depth = id - 1").count() == 700
    longer = spark.range(1, 3001).select(c("id"), F.when(c("id") > 1, c("id") - 1).alias("up"))  # no depth is taken for a cycle
    assert resolve_chain(longer, "id", "up", []).where("not cyclic and root = 1 and depth = id - 1").count() == 3000
    ring = spark.range(3000).select(c("id"), ((c("id") + 1) % 3000).alias("up")).union(spark.sql("select 3000L, 7L"))
    assert resolve_chain(ring, "id", "up", []).where("cyclic and root is null and depth is null").count() == 3001
    assert resolve_chain(longer.limit(0), "id", "up", []).count() == 0


def test_preorder_and_ancestors(spark):
    nodes = spark.createDataFrame([(1, None, 1), (2, 1, 2), (3, 1, 1), (4, 3, 1), (5, None, 0)], "id long, up long, o int")
    placed = [r.id for r in preorder(nodes, "id", "up", "o").orderBy("path").collect()]
    assert placed == [5, 1, 3, 4, 2]
    deep = spark.range(1, 102).select(c("id"), F.when(c("id") > 1, c("id") - 1).alias("up"), c("id").alias("o"))
    assert {(r.id, r.level, tuple(r.path)) for r in preorder(deep, "id", "up", "o").collect()} == {(i, i, tuple(range(1, i + 1))) for i in range(1, 102)}
    odd = spark.createDataFrame([(1, 2, 1), (2, 1, 1), (3, 2, 1), (4, 99, 1), (5, None, 1), (6, 5, 9)], "id long, up long, o int")
    assert {r.id: r.path for r in preorder(odd, "id", "up", "o").collect()} == {5: [1], 6: [1, 9]}
    assert preorder(odd.limit(0), "id", "up", "o").count() == 0
    rows = spark.createDataFrame([("/a/b/c",), ("/a/bb",), ("/x",)], "p string")
    declared = spark.createDataFrame([("/a", "1"), ("/a/b", "2")], "d string, v string")
    assert {r.p: r.v for r in nearest_ancestor(rows, "p", declared, "d", "v", "v").collect()} == {"/a/b/c": "2", "/a/bb": "1", "/x": None}


def test_layers_against_plain_merge(spark):
    random.seed(3)

    def value(depth):
        kind = random.random()
        if depth and kind < 0.6:
            return {random.choice("abc"): value(depth - 1) for _ in range(random.randint(0, 3))}
        return random.choice([1, None, [1, {"z": 2}], "s", False])

    def leaves(x, at=""):
        if isinstance(x, dict) and x:
            for k, y in x.items():
                yield from leaves(y, pointer(at, k))
        else:
            yield at, json.dumps(x, separators=(",", ":"))

    rows, want = [], set()
    for g in range(60):
        result = None
        for layer in range(3):
            document = {random.choice("abc"): value(3) for _ in range(3)}
            rows.append((g, layer, json.dumps(document)))
            result = document if layer == 0 else merged(result, document)
        want |= {(g, p, v) for p, v in leaves(result)}
    frame = spark.createDataFrame(rows, "g long, layer int, raw string")
    got = [(r.g, r.pointer, r.value) for r in merge_layers(json_leaves(frame, ["g", "layer"], "raw"), ["g"], "layer").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_layer_null_is_refused(spark):
    rows = spark.createDataFrame([(1, 0, '{"a": null}'), (1, 1, '{"b": null}')], "g long, layer int, raw string")
    with pytest.raises(Exception, match="null at"):
        merge_layers(json_leaves(rows, ["g", "layer"], "raw"), ["g"], "layer", refuse_null=True).collect()


def test_layer_null_is_a_row(spark, tmp_path):
    from sheaf.plans.registry import queries

    files = [(1, "f", '{"a": null, "b": {"x": 1, "y": null}, "c": 2}'), (2, "f", '{"b": {"x": null, "z": 3}, "c": null, "d": [null]}'), (3, "g", '{"a": null}'), (4, "g", "no json"), (5, "h", '{"a": 1}'), (6, "h", "null")]
    spark.createDataFrame(files, "file_id long, format_id string, raw_json string").write.parquet(f"{tmp_path}/format_files.parquet")
    got = {(r.format_id, r.pointer, r.value, r.layer, r.fault) for r in queries()["r04_inherited_packages"](spark, str(tmp_path)).collect()}
    kept = {("f", "/a", "null", 1), ("f", "/b/x", "1", 1), ("f", "/b/y", "null", 1), ("f", "/c", "2", 1), ("f", "/b/z", "3", 2), ("f", "/d", "[null]", 2), ("g", "/a", "null", 3), ("h", "/a", "1", 5)}
    refused = {("f", "/b/x", "null", 2), ("f", "/c", "null", 2), ("h", "", "null", 6)}
    assert got == {(*r, None) for r in kept} | {(*r, "null_refused") for r in refused}


def test_layers_stay_off_the_driver(spark, tmp_path):
    """A few files have many leaves: none of them is broadcast, and one, two and three versions give what the SQL gives."""
    from sheaf.plans.registry import oracle_sql, queries

    random.seed(7)
    value = lambda depth: {random.choice("abc"): value(depth - 1) for _ in range(random.randint(0, 3))} if depth and random.random() < 0.6 else random.choice([1, None, "s", [1]])
    files = [(n, f"f{n % 40 if n < 80 else n % 20}", "no json" if n % 17 == 0 else json.dumps({random.choice("abc"): value(3) for _ in range(3)})) for n in range(100)] + [(100 + n, f"alone{n}", json.dumps({"a": None, "b": n})) for n in range(20)]
    both = spark.createDataFrame(files, "file_id long, format_id string, raw_json string").withColumns({"project_key": c("format_id"), "batch_no": c("file_id").cast("int"), "manifest_id": c("file_id")}).toPandas()
    both.to_parquet(tmp_path / "format_files.parquet")
    both.to_parquet(tmp_path / "manifest_files.parquet")
    for name in ("r04_inherited_packages", "m01_merged_manifests"):
        frame = queries()[name](spark, str(tmp_path))
        compare(connection(tmp_path), oracle_sql()[name], frame)
        assert "Broadcast" not in frame._jdf.queryExecution().executedPlan().toString(), name


def test_metrics(spark):
    make = lambda rows: spark.createDataFrame(rows, "label string, accepted string, candidates array<string>, prediction string")
    h1, h2, h3, none = "heading.1", "heading.2", "heading.3", None
    names = ["heading_detection_precision", "exact_role_auto_precision", "auto_acceptance_coverage", "correct_auto_coverage", "candidate_exact_role_coverage"]
    got = lambda rows: [getattr(role_metrics(make(rows)).first(), n) for n in names]
    assert got([(h1, h1, [h1], h1), (h2, h1, [h1, h2], h1)])[:4] == [1.0, 0.5, 1.0, 0.5]
    assert got([(h1, none, None, none)]) == [None, None, 0.0, 0.0, 0.0]
    assert got([("body", none, None, none)]) == [None] * 5
    assert got([(h1, h1, [h1], h1), (h3, none, [h2], none)])[4] == 0.5
    mixed = role_metrics(make([(h1, h1, None, h1), ("body", h1, None, h1), (none, h1, None, h1)])).first()
    assert mixed.body_as_heading_false_positives == 1 and mixed.unlabelled == 1 and mixed.heading_detection_precision == 0.5
    assert {r.role: (r.support, r.tp, r.fp, r.fn, r.precision) for r in per_role(make([(h1, none, None, h1), (h1, none, None, "body"), ("title", none, None, none)])).collect()} == {h1: (2, 1, 0, 1, 1.0), "body": (0, 0, 1, 0, 0.0), "title": (1, 0, 0, 1, None)}


BLOCK = "doc string, n long, size_pt double, bold boolean, alignment string, structure_type string, visible_text string"


def test_candidates(spark):
    long = "word " * 30
    a = [("a", 1, 12.0, False, "left", "paragraph", long), ("a", 2, 18.0, True, "left", "paragraph", "2026.09.07 notes"), ("a", 3, 12.0, False, "left", "paragraph", long)]
    b = [("b", 1, 18.0, True, "left", "paragraph", "1. Introduction"), ("b", 2, 12.0, False, "left", "paragraph", long), ("b", 3, 14.0, True, "left", "paragraph", "1.1.1. Detailed protocol"), ("b", 4, 12.0, False, "left", "paragraph", long)]
    rest = [("c", 1, None, None, None, "paragraph", None), ("c", 2, None, None, None, "table", "")]
    got = {(r.doc, r.n): r for r in ranked_candidates(spark.createDataFrame(a + b + rest, BLOCK), "doc", "n").collect()}
    assert got["a", 2].selected_role == "body" and got["a", 2].review_status == "pending_review"
    assert got["b", 3].selected_role == "heading.3" and got["b", 3].conflicts == ["numbering_vs_size_level"]
    assert got["b", 1].selected_role == "heading.1" and got["b", 1].review_status == "auto_accepted"
    assert got["b", 2].selected_role == "body" and ("c", 2) not in got and got["c", 1].selected_role in ("body", "caption", "heading.1", "title")
    assert all(len(r.candidates) <= 3 for r in got.values())


def test_clusters_and_roles(spark):
    rows = [("d", i, f"/p[{i}]", None, False, "left", 12.0, False, "Normal", "Normal", "text", None) for i in range(1, 9)]
    rows += [("d", 9, "/p[9]", 1, False, "left", 16.0, True, "H1", "heading 1", "Head", "direct"), ("d", 10, "/p[10]", None, False, "center", 22.0, True, "Title", "Title", " ", None)]
    frame = spark.createDataFrame(rows, "doc string, n int, element_path string, outline_level int, in_table boolean, alignment string, size_pt double, bold boolean, p_style_id string, p_style_name string, visible_text string, outline_source string")
    found = clusters(frame, "doc", ["outline_level", "in_table", "alignment", "size_pt", "bold"], ["n"], "n")
    by = {r.cluster_id: r for r in found.collect()}
    assert by["cluster-01"].n == 8 and len(by["cluster-01"].sample_nodes) == 5 and len(by["cluster-01"].sample_texts) == 3
    roles = role_candidates(found, "doc")
    assert {r.role: r.confidence for r in roles.collect()} == {"body": 0.85, "heading.1": 0.99, "title": 0.9}
    assert {(r.role, r.fallback) for r in missing_roles(roles, frame, "doc").collect()} == {("heading.2", "inherit_from:heading.1"), ("heading.3", "inherit_from:body"), ("table.body", "inherit_from:body")}
