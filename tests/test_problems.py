"""Orphan references, nesting, drift and copies against brute force and in their corner cases."""

import itertools
import json
from collections import Counter, defaultdict
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sheaf.functions.jsontree import NotJson, _deep, parse
from sheaf.operators.copies import agreeing, assignment, copy_balance, copy_differences, inventory_fields
from sheaf.operators.drift import consistent_manifests, schema_changes
from sheaf.operators.nesting import FORMAT, MANIFEST, flat_objects, label_table, label_type, labelled_objects, typed_table, variant_tables, write_variants
from sheaf.operators.references import Parents, References, orphan_references
from sheaf.session import table

DATA = "/root/testdata/sf0.01"
T = lambda d, h=0: datetime(2025, 3, d, h)


def orphans(spark, refs, parents, slice_seconds=86_400):
    r = spark.createDataFrame(refs, "id long, src string, name string, at timestamp, extra string")
    p = spark.createDataFrame(parents, "src string, name string, opened timestamp, closed timestamp, extra string")
    found = orphan_references([References("r", "name", r, "id", "at", ("src", "name"), "p")], [Parents("p", p, ("src", "name"), "opened", "closed")], slice_seconds)
    return sorted((r.record_id, r.ref_month, r.status) for r in found.collect())


def test_references_status(spark):
    parents = [("a", "x", T(5), T(8), None), ("a", "x", T(5), T(8), None), ("a", "late", T(20), None, None), ("a", "never", T(9), T(9), None), ("a", None, T(1), None, None), ("a", "open", None, None, None), ("b", "x", T(1), None, None)]
    refs = [(1, "a", "x", T(5)), (2, "a", "x", T(8)), (3, "a", "x", T(4, 23)), (4, "a", "late", T(6)), (5, "a", "none", T(6)), (6, "a", "never", T(10)), (7, "a", None, T(6)), (8, None, "x", T(6)), (9, "a", "X", T(6)), (10, "a", "open", T(6)), (11, "a", "x", None), (12, "b", "x", T(30)), (2, "a", "x", T(8))]
    want = [(2, "2025-03", "deleted"), (3, "2025-03", "late"), (4, "2025-03", "late"), (5, "2025-03", "missing"), (6, "2025-03", "missing"), (9, "2025-03", "missing"), (10, "2025-03", "missing"), (11, None, "undated")]
    assert orphans(spark, [(*r, None) for r in refs], parents) == want
    assert orphans(spark, [(*r, None) for r in refs], parents, 7 * 86_400) == want


def test_references_empty(spark):
    assert orphans(spark, [], []) == []
    assert orphans(spark, [(1, "a", "x", T(1), None)], []) == [(1, "2025-03", "missing")]


def test_references_keys_do_not_run_together(spark):
    assert orphans(spark, [(1, "a", "bc", T(5), None)], [("ab", "c", T(1), None, None)]) == [(1, "2025-03", "missing")]


def brute_nodes(table_name, number, text):
    try:
        document = json.loads(text, parse_constant=lambda _: 1 / 0)
    except (ValueError, ZeroDivisionError, TypeError):
        return

    def opened(x):
        if isinstance(x, str):
            try:
                y = json.loads(x)
            except ValueError:
                return x
            return y if isinstance(y, (dict, list)) else x
        return x

    def node(x, at, parent):
        x = opened(x)
        if isinstance(x, dict):
            if x.get("title") is not None:
                yield table_name, number, at, parent
            below = opened(x.get("children"))
            if isinstance(below, list):
                for i, y in enumerate(below):
                    yield from node(y, f"{at}/children/{i}", at)
            elif isinstance(below, dict):
                yield from node(below, f"{at}/children", at)

    def role(x, at, parent):
        x = opened(x)
        if isinstance(x, str):
            yield table_name, number, at, parent
        elif isinstance(x, dict):
            if x.get("style") is not None:
                yield table_name, number, at, parent
            for i, y in enumerate(opened(x.get("variants")) or []):
                yield from role(y, f"{at}/variants/{i}", at)

    if table_name == "manifest_files":
        source = opened(document.get("source"))
        for i, x in enumerate((opened(source.get("tree")) if isinstance(source, dict) else None) or []):
            yield from node(x, f"/source/tree/{i}", "")
    else:
        page = opened(document.get("page"))
        if isinstance(page, dict) and page.get("width_mm") is not None:
            yield table_name, number, "/page", ""
        for key, x in (opened(document.get("roles")) or {}).items():
            yield from role(x, "/roles/" + key.replace("~", "~0").replace("/", "~1"), "")


def test_nesting_against_brute_force(spark):
    manifests, formats = table(spark, DATA, "manifest_files"), table(spark, DATA, "format_files")
    want = set()
    for name, number, frame in (("manifest_files", "manifest_id", manifests), ("format_files", "file_id", formats)):
        for r in frame.select(number, "raw_json").collect():
            want |= set(brute_nodes(name, r[0], r[1]))
    got = [tuple(r) for r in labelled_objects(manifests, formats).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 1000


def test_outline_rules_are_flattened(spark, tmp_path):
    from sheaf.plans.registry import queries

    text = '{"source": {"tree": [{"level": 1, "title": "a", "outline_rules": [{"level": 2, "pattern": "^x"}, {"level": "no"}], "children": {"title": "b", "outline_rules": "[{\\"pattern\\": \\"y\\", \\"level\\": 3}]"}}]}}'
    spark.createDataFrame([(1, text), (1, text), (2, "[1")], "manifest_id long, raw_json string").write.parquet(f"{tmp_path}/manifest_files.parquet")
    got = {tuple(r) for r in queries()["p3_outline_rules"](spark, str(tmp_path)).select("file_id", "node_pointer", "parent_pointer", "variant", "depth", "level", "pattern").collect()}
    at = "/source/tree/0"
    assert got == {(1, f"{at}/outline_rules/0", at, "string", 1, 2, "^x"), (1, f"{at}/outline_rules/1", at, "absent", 1, None, None), (1, f"{at}/children/outline_rules/0", f"{at}/children", "string", 2, 3, "y")}


def test_faults_of_rules_and_files(spark, tmp_path):
    from sheaf.plans.registry import queries

    node = lambda file, *rules: {"level": 1, "title": "t", "type": "docx_outline", "file": file, "outline_rules": list(rules)}
    tree = [node("a/../b.docx", {"level": 1, "pattern": "^[0-9]+ "}), node("../b.docx", {"level": 0, "pattern": "(?P<n>x)(?P=n)"}), node("/b.docx", {"level": 2, "pattern": "("}), node("a/../../b.docx", {"level": 1, "pattern": 5}, {"pattern": "x"}), {"level": 1, "title": "t", "type": "folder", "file": "/x", "children": [{"level": 2, "title": "u", "type": "docx_outline", "file": "..b", "outline_rules": [{"level": 1, "pattern": "x"}]}]}]
    spark.createDataFrame([(1, json.dumps({"source": {"tree": tree}}))], "manifest_id long, raw_json string").write.parquet(f"{tmp_path}/manifest_files.parquet")
    got = sorted((r.node_pointer.removeprefix("/source/tree/"), r.fault) for r in queries()["s06_tree_faults"](spark, str(tmp_path)).collect())
    want = [("1", "file_outside"), ("1/outline_rules/0", "rule_level"), ("2", "file_outside"), ("2/outline_rules/0", "pattern"), ("3", "file_outside"), ("3/outline_rules/0", "pattern"), ("3/outline_rules/1", "rule_level"), ("4/children/0/outline_rules/0", "rule_level")]
    assert got == want


def test_nesting_corner_cases(spark):
    text = '{"children": ' * 1500 + '{"title": "end"}' + "}" * 1500
    files = [(1, None), (2, ""), (3, "[1"), (4, '{"source": {"tree": [' + text + "]}}"), (5, '{"source": "{\\"tree\\": [{\\"title\\": \\"a\\", \\"children\\": \\"[{\\\\\\"title\\\\\\": 1}]\\"}]}"}'), (6, '{"source": {"tree": null}, "x": NaN}'), (7, '{"source": {"tree": [{"title": null}, 5, "x"]}}')]
    frame = spark.createDataFrame(files, "manifest_id long, raw_json string")
    got = flat_objects(frame, "manifest_id", "raw_json", MANIFEST)
    by_file = Counter(r.file_id for r in got.select("file_id").collect())
    assert by_file == {4: 1501, 5: 2, 7: 1}
    assert {(r.node_pointer, r.parent_pointer) for r in got.where("file_id = 5").collect()} == {("/source/tree/0", ""), ("/source/tree/0/children/0", "/source/tree/0")}
    roles = spark.createDataFrame([(1, '{"roles": {"a/b": "plain", "~": {"variants": [{"style": "s"}, {"variants": [{"style": 3}]}]}}, "page": {"width_mm": {"value": 2.5, "unit": "mm"}}}')], "file_id long, raw_json string")
    flat = flat_objects(roles, "file_id", "raw_json", FORMAT)
    flat = flat.withColumn("labelled", ~label_type().isin("absent", "null"))
    assert {(r.node_pointer, r.parent_pointer, r.labelled) for r in flat.collect()} == {("/page", "", True), ("/roles/a~1b", "", True), ("/roles/~0", "", False), ("/roles/~0/variants/0", "/roles/~0", True), ("/roles/~0/variants/1", "/roles/~0", False), ("/roles/~0/variants/1/variants/0", "/roles/~0/variants/1", True)}
    assert typed_table(flat, "page").select("width_mm", "width_unit").first()[:] == (2.5, "mm")
    assert flat_objects(frame.limit(0), "manifest_id", "raw_json", MANIFEST).count() == 0


def test_variants_have_tables_of_their_own(spark, tmp_path):
    """Every object in the table of its variant and in no other, its label in the variant's type, no member lost."""
    texts = ['{"page": {"width_mm": {"value": 2.5, "unit": "mm"}, "grid": [1, {"a": null}]}}', '{"page": {"width_mm": "210 mm", "height_mm": "9"}}', '{"page": {"width_mm": 5, "orientation": 3}}', '{"page": {"x": {}}}', '{"roles": {"a": "plain", "b": {"style": 4, "variants": []}, "c": {"style": "s", "variants": [{"style": "t", "when": ["x"]}]}}}']
    flat = flat_objects(spark.createDataFrame(list(enumerate(texts)), "file_id long, raw_json string"), "file_id", "raw_json", FORMAT)
    tables = variant_tables(flat)
    assert set(tables) == {("page", "object"), ("page", "string"), ("page", "number"), ("page", "absent"), ("role", "plain"), ("role", "number+variants:empty"), ("role", "string+variants:list"), ("variant", "string")}
    assert sum(t.count() for t in tables.values()) == flat.count() == 8
    kinds = {k: dict(t.dtypes) for k, t in tables.items()}
    assert kinds["page", "string"]["width_mm"] == "string" and kinds["page", "number"]["width_mm"] == "double" and "width_mm" not in kinds["page", "absent"] and kinds["role", "number+variants:empty"]["style"] == "double"
    first = lambda *k: tables[k].first()
    assert first("page", "object").width_mm == 2.5 and json.loads(first("page", "object").rest) == {"grid": [1, {"a": None}], "width_mm": {"unit": "mm", "value": 2.5}}
    assert first("page", "string")[3:] == ("210 mm", None, 9.0, None, None, '{"height_mm":"9","width_mm":"210 mm"}') or first("page", "string").width_mm == "210 mm"
    assert json.loads(first("page", "number").rest) == {"orientation": 3} and first("page", "absent").rest == '{"x":{}}' and first("variant", "string").rest == '{"when":["x"]}'
    assert label_table(flat, "role", "plain").count() == 1
    write_variants(flat, f"{tmp_path}/v")
    assert spark.read.parquet(f"{tmp_path}/v").where("kind = 'page' and variant = 'object'").count() == 1


@pytest.mark.parametrize("text", ['{"a": [1, -2.5e3, {"b": null}], "c": "x\\n"}', "[]", "{}", ' [ [ ] , { "a" : true } ] ', "3", '"x"'])
def test_deep_parser_agrees(text):
    assert _deep(text) == json.loads(text)


@pytest.mark.parametrize("text", ["", "[", "[1,]", '{"a"}', '{"a": 1,}', "[1] 2", "NaN", '{"a": tru}', "[1 2]", '"x'])
def test_no_json(text):
    with pytest.raises(NotJson):
        parse(text)
    with pytest.raises(NotJson):
        _deep(text)


def test_deep_parser_depth():
    value = parse("[" * 200_000 + "]" * 200_000)
    depth = 0
    while value:
        value, depth = value[0], depth + 1
    assert depth == 199_999


def brute_changes(files):
    """files: (producer, batch, project, text)."""
    held = defaultdict(lambda: (defaultdict(set), defaultdict(lambda: defaultdict(set))))

    def kind(x):
        return "boolean" if isinstance(x, bool) else {str: "string", dict: "object", list: "array", type(None): "null"}.get(type(x), "number")

    def walk(x, path, types, values):
        if path and x is not None:
            types[path].add(kind(x))
            if not isinstance(x, (dict, list)):
                values[path].add((kind(x), x))
        if isinstance(x, dict):
            for k, y in x.items():
                p = f"{path}.{k}" if path else k
                if not k.startswith("_comment") and p != "source.tree":
                    walk(y, p, types, values)
        if isinstance(x, list):
            for y in x:
                walk(y, path + "[]", types, values)

    for producer, batch, project, text in files:
        try:
            document = json.loads(text)
        except (ValueError, TypeError):
            continue
        types, by_project = held[producer, batch]
        walk(document, "", types, by_project[project])
    out = set()
    for producer in {p for p, _ in held}:
        batches = sorted(b for p, b in held if p == producer)
        for a, b in zip(batches, batches[1:]):
            (ta, va), (tb, vb) = held[producer, a], held[producer, b]
            gone, new = set(ta) - set(tb), set(tb) - set(ta)
            renamed = set()
            for o, n in itertools.product(gone, new):
                if "[]" in o + n:
                    continue
                those = [p for p in va if p in vb and va[p].get(o)]
                if those and all(va[p][o] == vb[p].get(n) for p in those):
                    renamed.add((o, n))
            out |= {(producer, b, "renamed", o, n) for o, n in renamed}
            out |= {(producer, b, "removed", o, "") for o in gone - {o for o, _ in renamed}}
            out |= {(producer, b, "added", "", n) for n in new - {n for _, n in renamed}}
            out |= {(producer, b, "retyped", p, p) for p in set(ta) & set(tb) if ta[p] != tb[p]}
    return out


def test_drift_against_brute_force(spark):
    files = table(spark, DATA, "manifest_files")
    want = brute_changes([tuple(r) for r in files.select("producer_id", "batch_no", "project_key", "raw_json").collect()])
    got = [tuple(r) for r in schema_changes(files).collect()]
    assert len(got) == len(set(got)) and set(got) == want and any(r[2] == "renamed" for r in want)


def test_drift_corner_cases(spark):
    make = lambda rows: spark.createDataFrame(rows, "manifest_id long, producer_id long, batch_no int, project_key string, raw_json string, path string")
    rows = [
        (1, 1, 1, "p", '{"a": 1, "k": "v", "_comment": 3, "x": null, "l": [1]}'),
        (2, 1, 4, "p", '{"b": 1.0, "k": 5, "l": ["s", 2]}'),
        (2, 1, 4, "p", '{"b": 1.0, "k": 5, "l": ["s", 2]}'),
        (3, 1, 3, "p", "broken"),
        (4, 1, 5, None, '{"c": 1, "k": 5, "l": ["s", 2]}'),
        (5, None, 1, "p", "{}"),
        (6, 2, 1, "p", "{}"),
    ]
    frame = make([(*r, None) for r in rows])
    got = {tuple(r) for r in schema_changes(frame).collect()}
    assert got == {(1, 4, "renamed", "a", "b"), (1, 4, "retyped", "k", "k"), (1, 4, "retyped", "l[]", "l[]"), (1, 5, "removed", "b", ""), (1, 5, "added", "", "c")}
    assert schema_changes(frame.limit(0)).count() == 0
    table_ = consistent_manifests(make([(1, 1, 1, "p", '{"schema_version": "1", "output": {"compiled_document": "o.docx"}, "cover": {"title": "T"}}', None), (2, 1, 1, "p", '{"schema_version": 3, "toc_depth": 3, "output": {"documents": [{"id": "a", "parts": "cover, toc"}]}}', None), (3, 1, 1, "p", "[]", None)]))
    by = {r.manifest_id: r for r in table_.collect()}
    moved = make([(1, 1, 1, "p", '{"project_name": "P", "cover": {"main_title": "T"}}', None), (2, 1, 2, "p", '{"names": {"own": "P"}, "cover": {"main_title": "T"}}', None), (3, 1, 5, "p", '{"names": {"own": "P"}, "head": "T"}', None), (4, None, 5, "p", '{"project_name": "Q"}', None)])
    rows = {r.manifest_id: (r.project_name, r.main_title, [x for x in r.steps if x.startswith("undo")]) for r in consistent_manifests(moved, schema_changes(moved)).collect()}
    assert rows == {1: ("P", "T", []), 2: ("P", "T", ["undo names.own"]), 3: ("P", "T", ["undo head", "undo names.own"]), 4: ("Q", None, [])}
    assert by[1].main_title == "T" and by[1].schema_version == 1 and by[1].documents[0].filename == "o.docx" and by[1].documents[0].parts == ["cover", "toc", "body"]
    assert by[1].steps == ["rename cover.main_title", "cast schema_version", "default toc_depth", "documents output.documents"]
    assert by[2].documents[0].parts == ["cover", "toc"] and 3 not in by


def test_no_leaf_of_a_manifest_is_lost(spark):
    from collections import Counter

    def scalars(value):
        if isinstance(value, dict):
            return [x for k, v in value.items() if not k.startswith("_comment") for x in scalars(v)]
        return [x for v in value for x in scalars(v)] if isinstance(value, list) else [json.dumps(value)]

    files = table(spark, DATA, "manifest_files")
    raw, typed = {}, ("schema_version", "project_name", "main_title", "author", "cover_date", "source_file", "toc_depth")
    for r in files.collect():
        try:
            raw[r.manifest_id] = parse(r.raw_json)
        except NotJson:
            continue
    raw = {k: v for k, v in raw.items() if isinstance(v, dict)}
    got = {r.manifest_id: r for r in consistent_manifests(files, schema_changes(files)).collect()}
    assert set(got) == set(raw)
    for k, document in raw.items():
        row = got[k].asDict(True)
        kept = scalars([row[c] for c in typed]) + scalars(row["documents"]) + scalars([json.loads(v) for v in row["rest"].values()])
        assert not Counter(scalars(document)) - Counter(kept), k

    deep = "[" * 30_000 + "]" * 30_000
    odd = '{"fonts": {"text": "F"}, "cover": {"title": "T", "date": {"year": 2025, "era": "x"}, "sub_title": null}, "toc_depth": "two", "a/b": {"_comment": 1, "c": [1, {"d": 2}], "e": {}}, "output": {"documents": [{"id": 7, "filename": "f", "parts": "toc", "toc": true}, "loose"]}, "source": {"tree": %s}}' % deep
    make = spark.createDataFrame([(1, 1, "p", 1, odd), (2, 1, "q", 1, '{"output": "x"}')], "manifest_id long, producer_id long, project_key string, batch_no int, raw_json string")
    rest = {r.manifest_id: r.rest for r in consistent_manifests(make).collect()}
    assert rest[1].pop("/source/tree") == deep and rest[2] == {"/output": '"x"'}
    assert rest[1] == {
        "/fonts/body": '"F"', "/cover/date/year": "2025", "/cover/date/era": '"x"', "/cover/sub_title": "null", "/toc_depth": '"two"', "/a~1b/c": '[1, {"d": 2}]', "/a~1b/e": "{}",
        "/output/documents/0/id": "7", "/output/documents/0/parts": '"toc"', "/output/documents/0/toc": "true", "/output/documents/1": '"loose"',
    }


def test_values_that_no_cast_takes(spark):
    """Whole numbers however written are cast; all else is named by a step, kept in rest and replaced by the default."""
    from sheaf.operators.drift import schema_versions

    texts = ['"--5"', '"²"', '"2.0"', '"v3"', "99999999999", "1e999", "true", "4.0", "4.5", "[1]", '" 6 "', "null"]
    rows = [(n, 1, "p", n % 2, f'{{"schema_version": {t}, "toc_depth": 3, "cover": {{"date": {{"year": 1e999, "month": 2.0, "day": "x"}}}}, "output": {{"documents": []}}}}') for n, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "manifest_id long, producer_id long, project_key string, batch_no int, raw_json string")
    got = {r.manifest_id: r for r in consistent_manifests(frame).collect()}
    assert [got[n].schema_version for n in range(len(texts))] == [2, 2, 2, 3, 2, 2, 2, 4, 2, 2, 6, 2]
    rejected = {0, 1, 4, 5, 6, 8, 9}
    for n, t in enumerate(texts):
        steps = [x for x in got[n].steps if "schema_version" in x]
        if n in rejected:
            assert steps[0].startswith("reject schema_version") and steps[1] == "default schema_version" and "/schema_version" in got[n].rest
        else:
            assert steps == (["default schema_version"] if t == "null" else ["cast schema_version"])
    assert got[0].steps[0] == 'reject schema_version "--5"' and got[0].cover_date == "inf-02-x"
    versions = spark.createDataFrame([(1, b, "p", j) for b, j in ((1, '{"a": 1}'), (2, '{"a": "x"}'), (4, '{"a": 2}'), (5, "{"), (6, "{}"))], "producer_id long, batch_no int, project_key string, raw_json string")
    assert sorted((r.batch_no, r.version, r.n_paths) for r in schema_versions(versions).collect()) == [(1, 1, 1), (2, 2, 1), (4, 1, 1), (6, 3, 0)]


def test_assignment_is_least():
    import random

    random.seed(7)
    cost = lambda a, b: sum(x != y for x, y in zip(a, b))
    for _ in range(200):
        f, n, m = random.randint(1, 4), random.randint(1, 5), random.randint(1, 5)
        left, right = ([tuple(random.randint(0, 2) for _ in range(f)) for _ in range(k)] for k in (n, m))
        pairs = assignment(left, right, [1] * n, [1] * m)
        small, large = (left, right) if n <= m else (right, left)
        assert sum(k for *_, k in pairs) == min(n, m)
        assert sum(cost(left[i], right[j]) for i, j, _ in pairs) == min(sum(map(cost, small, q)) for q in itertools.permutations(large, len(small)))


def test_hubs_are_few():
    """One field is the same everywhere, ten differ: no set of fields is met twice, none that one side lacks."""
    left = [("x", *range(i, i + 10)) for i in range(40)]
    right = [("x", *range(i + 1000, i + 1009), i + 9) for i in range(40)]
    hubs = list(agreeing(left, right))
    assert sorted(h[0] for h in hubs) == [9] * 40 + [10]
    wide = [tuple(range(25)), tuple([-1, *range(1, 25)])]
    assert len(list(agreeing(wide, [(0, *range(1, 24), -2), (-1, *range(1, 24), -3)]))) == 3
    assert sum(n for *_, n in assignment(wide * 1, [(0, *range(1, 24), -2)], [3, 1], [2])) == 2


def test_planted_copies_by_key(spark):
    """Keys with several rows on each side, some of them alike, against every way of pairing."""
    import random

    random.seed(11)
    cost = lambda a, b: sum(x != y for x, y in zip(a, b))
    made, want = ([], []), {}
    for key in range(60):
        sides = [[(random.choice([None, 1, 2]), random.choice("ab"), random.choice("xyz")) for _ in range(random.randint(1, 5))] for _ in "ab"]
        for side, rows in enumerate(sides):
            made[side].extend((key, *row, f"{key}/{n}") for n, row in enumerate(rows))
        one, two = (Counter(rows) for rows in sides)
        left, right = list((one - two).elements()), list((two - one).elements())
        small, large = sorted((left, right), key=len)
        want[key] = ((one & two).total(), len(small), min(sum(map(cost, small, q)) for q in itertools.permutations(large, len(small))), len(large) - len(small))
    frames = [spark.createDataFrame(rows + rows[:9], "k int, f int, g string, h string, note string") for rows in made]
    got = {r[0]: tuple(r[1:]) for r in copy_balance(*frames, "k", {c: F.col(c) for c in "fgh"}).collect()}
    assert got == want and sum(v[1] > 1 for v in want.values()) > 20


SCHEMA = "inv_id long, paragraph_counts map<string,int>, media_hashes array<string>, missing_occurrences array<string>, paragraph_total int, extracted_at timestamp, note string"


def test_copies_corner_cases(spark):
    a = [
        (1, {"x": 1, "z": 0}, ["AB", "cd", "ab"], ["m", "m"], 1, T(2), "p"),
        (1, {"x": 9}, None, None, 0, T(1), None),
        (2, None, None, None, None, None, None),
        (3, {}, [], [], 0, T(1), None),
        (4, {"x": 1}, ["a"], ["m"], 1, T(1), None),
        (4, {"x": 1}, ["a"], ["m"], 1, T(1), None),
        (5, {"x": 1}, ["a"], ["m"], 1, T(1), None),
        (None, {}, [], [], 0, T(1), None),
        (7, {"x": 1}, ["a"], ["m"], 1, T(1), None),
        (7, {"x": 2}, ["b"], ["n"], 1, T(1), None),
    ]
    b = [
        (1, {"x": 1}, ["ab", "CD"], ["m", "m"], 1, T(3), "q"),
        (2, None, None, None, None, T(1), None),
        (3, None, None, None, None, T(1), None),
        (4, {"x": 1}, ["a"], ["m", "m"], 1, T(1), None),
        (6, {"x": 1}, ["a"], ["m"], 1, T(1), None),
        (7, {"x": 2}, ["b"], ["n"], 5, T(1), None),
        (7, {"x": 1}, ["a"], ["q"], 1, T(1), None),
    ]
    one, two = spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA)
    got = {tuple(r) for r in copy_differences(one, two, "inv_id", inventory_fields(), "extracted_at", ("prepared", "delivered")).collect()}
    fields = {"paragraph_counts", "media_hashes", "missing_occurrences", "paragraph_total"}
    want = {(3, f, "differs") for f in fields} | {(4, "missing_occurrences", "differs"), (5, "row", "only_prepared"), (6, "row", "only_delivered"), (7, "missing_occurrences", "differs"), (7, "paragraph_total", "differs")}
    assert got == want
    assert copy_differences(one.limit(0), two.limit(0), "inv_id", inventory_fields(), "extracted_at").count() == 0


def test_copies_by_multiplicity(spark):
    x, y, z = ({"x": 1}, ["a"], ["m"], 1, T(1)), ({"x": 2}, ["b"], ["n"], 2, T(1)), ({"x": 1}, ["a"], ["m"], 5, T(1))
    a = [(1, *x, "p"), (1, *y, "p"), (2, *x, "p"), (2, *x, "q"), (3, *x, "p"), (3, *x, "p"), (4, *x, "p"), (5, *x, "p"), (5, *x, "q"), (6, *x, "p"), (7, *x, "p"), (7, *x, "q"), (7, *y, "p")]
    b = [(1, *x, "p"), (2, *x, "p"), (3, *x, "p"), (4, *x, "p"), (4, *y, "p"), (4, *z, "p"), (5, *x, "r"), (5, *z, "p"), (7, *z, "p"), (7, *x, "p")]
    one, two = spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA)
    got = {tuple(r) for r in copy_differences(one, two, "inv_id", inventory_fields()).collect()}
    assert got == {(1, "row", "surplus_a"), (2, "row", "surplus_a"), (4, "row", "surplus_b"), (5, "paragraph_total", "differs"), (6, "row", "only_a"), (7, "paragraph_total", "differs"), (7, "row", "surplus_a")}
