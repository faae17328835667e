"""A small tree, its graph, and every verb on it."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tracegraph import schema
from tracegraph.operators import assemble, layers
from tracegraph.plans import build, documents, page, sqlgate, storage, verbs
from tracegraph.streaming import watch

#: A heating: a pump, a boiler with two makes of sensor, ticks that call back, and fuels behind a pointer.
TREE = {
    "heat/pump.h": "#define CLAMP(v, hi) ((v) < (hi) ? (v) : (hi))\nextern int flow;\nint pump_set(int rate);\n",
    "heat/pump.c": '#include "pump.h"\nint flow = 4;\nstatic int ceiling(void)\n{\n    return 9;\n}\nint pump_set(int rate)\n{\n    flow = CLAMP(rate, ceiling());\n    return flow;\n}\n',
    "boiler.c": '#include "heat/pump.h"\nstatic int\nceiling(void) { return 70; }\nstatic long cycles;\nint boiler_step(void)\n{\n    cycles += flow;\n    if (sense() > ceiling())\n        pump_set(0);\n    return pump_set(3);\n}\n',
    "hw/real.c": "int sense(void) { return 61; }\n",
    "hw/fake.c": "int sense(void) { return 20; }\n",
    "hw/config.h": "#define PERIOD 5\n",
    "heat/config.h": "#define PERIOD 6\n",
    "ticks.c": '#include "config.h"\nstatic void on_tick(int n) { boiler_step(); }\n/* (on_tick, in a comment) */\nvoid begin(void)\n{\n    every(PERIOD, on_tick);\n    log("(on_tick, in a string)", 1);\n}\n',
    "fuel.c": "static int gas(int on) { return on; }\nstatic int oil(int on) { return -on; }\nstruct fuel { int (*light)(int); } G = { .light = gas };\nvoid choose(struct fuel *f) { f->light = oil; }\nint ignite(struct fuel *f)\n{\n    return f->light(1);\n}\nint spark(int on) { return 2 * on; }\n",
}
_DEFS = """flow global heat/pump.c 2 2 | ceiling function heat/pump.c 3 6 static | pump_set function heat/pump.c 7 11 | CLAMP macro heat/pump.h 1 1
ceiling function boiler.c 3 3 static | cycles global boiler.c 4 4 static | boiler_step function boiler.c 5 11 | sense function hw/real.c 1 1 | sense function hw/fake.c 1 1
PERIOD macro hw/config.h 1 1 | PERIOD macro heat/config.h 1 1 | on_tick function ticks.c 2 2 static | begin function ticks.c 4 8
gas function fuel.c 1 1 static | oil function fuel.c 2 2 static | G global fuel.c 3 3 | choose function fuel.c 4 4 | ignite function fuel.c 5 8 | spark function fuel.c 9 9"""
DEFS = [(n, k, f, int(a), int(b), bool(more)) for row in _DEFS.replace("\n", " | ").split(" | ") for n, k, f, a, b, *more in [row.split()]]
_OCCS = """call CLAMP pump_set heat/pump.c 9 | call ceiling pump_set heat/pump.c 9 | ref flow pump_set heat/pump.c 9 | assign flow pump_set heat/pump.c 9 | ref flow pump_set heat/pump.c 10 | ref flow <global> heat/pump.c 2
ref cycles boiler_step boiler.c 7 | assign cycles boiler_step boiler.c 7 | ref flow boiler_step boiler.c 7 | call sense boiler_step boiler.c 8 | call ceiling boiler_step boiler.c 8 | call pump_set boiler_step boiler.c 9 | call pump_set boiler_step boiler.c 10
call boiler_step on_tick ticks.c 2 | call PERIOD begin ticks.c 6 | include pump.h <global> heat/pump.c 1 | include pump.h <global> boiler.c 1 | include config.h <global> ticks.c 1"""
OCCS = [(op, n, scope, f, int(line)) for row in _OCCS.replace("\n", " | ").split(" | ") for op, n, scope, f, line in [row.split()]]
C, CB, FP, M = ("cscope", 0.9), ("callback", 0.7), ("fnptr", 0.8), ("manual", 1.0)
TWO = '{"ambiguous":true,"candidates":2,"rule":"non-static-dup"}'
BASE = '{"ambiguous":true,"rule":"dup-basename"}'
EDGES = {
    ("pump_set", "CLAMP", "expands", "heat/pump.c", 9, *C, "{}"),
    ("pump_set", "heat/pump.c::ceiling", "calls", "heat/pump.c", 9, *C, "{}"),
    ("pump_set", "flow", "writes", "heat/pump.c", 9, *C, "{}"),
    ("pump_set", "flow", "reads", "heat/pump.c", 10, *C, "{}"),
    ("boiler_step", "boiler.c::cycles", "writes", "boiler.c", 7, *C, "{}"),
    ("boiler_step", "boiler.c::cycles", "reads", "boiler.c", 7, *C, '{"rmw":true}'),
    ("boiler_step", "flow", "reads", "boiler.c", 7, *C, "{}"),
    ("boiler_step", "flow", "writes", "boiler.c", 7, *C, '{"rmw":true}'),
    ("boiler_step", "hw/real.c::sense", "calls", "boiler.c", 8, *C, TWO),
    ("boiler_step", "hw/fake.c::sense", "calls", "boiler.c", 8, *C, TWO),
    ("boiler_step", "boiler.c::ceiling", "calls", "boiler.c", 8, *C, "{}"),
    ("boiler_step", "pump_set", "calls", "boiler.c", 9, *C, "{}"),
    ("boiler_step", "pump_set", "calls", "boiler.c", 10, *C, "{}"),
    ("ticks.c::on_tick", "boiler_step", "calls", "ticks.c", 2, *C, "{}"),
    ("begin", "hw/config.h::PERIOD", "expands", "ticks.c", 6, *C, TWO),
    ("begin", "heat/config.h::PERIOD", "expands", "ticks.c", 6, *C, TWO),
    ("heat/pump.c", "heat/pump.h", "includes", "heat/pump.c", 1, *C, "{}"),
    ("boiler.c", "heat/pump.h", "includes", "boiler.c", 1, *C, "{}"),
    ("ticks.c", "hw/config.h", "includes", "ticks.c", 1, *C, BASE),
    ("ticks.c", "heat/config.h", "includes", "ticks.c", 1, *C, BASE),
    ("begin", "ticks.c::on_tick", "callback", "ticks.c", 6, *CB, '{"heur":"fn-as-arg"}'),
    ("ignite", "fuel.c::gas", "fnptr", "fuel.c", 7, *FP, '{"field":"light","handlers":2}'),
    ("ignite", "fuel.c::oil", "fnptr", "fuel.c", 7, *FP, '{"field":"light","handlers":2}'),
    ("ignite", "spark", "fnptr", "fuel.c", 7, *M, '{"field":"light","manual":true,"struct":"fuel"}'),
    ("begin", "spark", "fnptr", "(manual)", 0, *M, '{"manual":true}'),
    ("ignite", "igniter_isr", "fnptr", "(manual)", 0, *M, '{"manual":true}'),
}


def facts(spark, tree=TREE, defs=DEFS, occs=OCCS, **more):
    files = spark.createDataFrame([(p, bytearray(t.encode())) for p, t in tree.items()], "path string, content binary").withColumn("content_hash", F.sha2("content", 256))
    d = spark.createDataFrame([(i, *x, None) for i, x in enumerate(defs)], schema.DEFINITIONS)
    o = spark.createDataFrame([(i, *x, tree[x[3]].splitlines()[x[4] - 1]) for i, x in enumerate(occs)], schema.OCCURRENCES)
    regs = spark.createDataFrame([("light", "spark", "fuel")], schema.REGISTRATIONS)
    links = spark.createDataFrame([("begin", "spark"), ("ignite", "igniter_isr")], schema.LINKS)
    return build.Facts(files, d, o, regs, links, **more)


def flat(edges):
    return {tuple(r) for r in edges.select("src_qname", "dst_qname", "kind", "file", "line", "origin", "confidence", schema.meta_json(F.col("meta"))).collect()}


@pytest.fixture(scope="module")
def graph(spark):
    return build.build(spark, facts(spark, rules=[("^HEAT/", "core")]))


@pytest.fixture(scope="module")
def tables(spark, graph):
    history = build.history_row(spark, "build-full", 10, 1.0)
    return {k: storage.checkpoint(v) for k, v in build.tables(spark, graph, {"root": "/w", "db_label": "t", "engines_run": "[]"}, history).items()}


def test_nodes_and_edges(graph):
    assert flat(graph.edges) == EDGES
    nodes = {(r.qname, r.kind): r for r in graph.nodes.collect()}
    assert len(nodes) == len(DEFS) + len(TREE) + 1
    assert nodes["pump_set", "function"].module == "core" and nodes["begin", "function"].module == "" and nodes["igniter_isr", "function"].origin == "manual"


def test_repeated_qnames_are_told(spark):
    twice = [("f", "function", "a.c", 1, 1, False)] * 3
    with pytest.raises(ValueError, match="more than one node"):
        build.build(spark, facts(spark, {"a.c": "f f f"}, twice, []))


def test_incremental_equals_full(spark, graph):
    """A file grows, one goes (and with it an ambiguity), one comes."""
    tree = {**TREE, "boiler.c": TREE["boiler.c"] + "int drain(void) { return pump_set(-1); }\n", "hw/alarm.c": "int alarm(void) { return sense(); }\n"}
    del tree["hw/fake.c"]
    defs = [d for d in DEFS if d[2] != "hw/fake.c"] + [("drain", "function", "boiler.c", 12, 12, False), ("alarm", "function", "hw/alarm.c", 1, 1, False)]
    occs = OCCS + [("call", "pump_set", "drain", "boiler.c", 12), ("call", "sense", "alarm", "hw/alarm.c", 1)]
    now = facts(spark, tree, defs, occs)
    part, full = build.rebuild(spark, now, graph), build.build(spark, now)
    assert flat(part.edges) == flat(full.edges)
    assert {("boiler_step", "sense", "calls", "boiler.c", 8, *C, "{}"), ("alarm", "sense", "calls", "hw/alarm.c", 1, *C, "{}")} <= flat(part.edges)
    assert build.rebuild(spark, facts(spark), graph) is graph
    assert {(r.path, r.change) for r in build.changes(graph.files, now.files).collect()} == {("boiler.c", "changed"), ("hw/fake.c", "deleted"), ("hw/alarm.c", "added")}


def test_incremental_finds_a_first_source(spark):
    """A scope becomes the only one of its name: its sites in files that no change touches have a source for the first time."""
    tree = {"a.c": "void run(void) {}\n", "b.c": "void run(void) {}\n", "part.inc": "leaf();\n", "leaf.c": "void leaf(void) {}\n"}
    defs = [(n, "function", f, 1, 1, False) for n, f in (("run", "a.c"), ("run", "b.c"), ("leaf", "leaf.c"))]
    occs = [("call", "leaf", "run", "part.inc", 1)]
    before = build.build(spark, facts(spark, tree, defs, occs))
    assert not flat(before.edges.where("origin = 'cscope'"))
    del tree["b.c"]
    now = facts(spark, tree, [d for d in defs if d[2] != "b.c"], occs)
    part, full = build.rebuild(spark, now, before), build.build(spark, now)
    assert flat(part.edges) == flat(full.edges)
    assert ("run", "leaf", "calls", "part.inc", 1, *C, "{}") in flat(part.edges)


def test_semantic_layer(spark, graph):
    """Calls of static functions too: what is defined, and who sees it, is what the graph's nodes say."""
    told = spark.createDataFrame([(1, "pump_set", "boiler_step", "/w/boiler.c", 9), (1, "ceiling", "boiler_step", "boiler.c", 8), (4, "cycles", "boiler_step", "boiler.c", 7), (1, "pump_set", None, "x.c", 1), (1, "pump_set", "no_such", "x.c", 1), (0, "pump_set", "boiler_step", "boiler.c", 1)], schema.SEMANTIC)
    once, counts = build.import_semantic(graph, told, root="/w")
    rows = {(r.dst_qname, r.kind, r.origin, r.line): r for r in once.edges.where("src_qname = 'boiler_step'").collect()}
    assert rows["boiler.c::ceiling", "calls", "clink", 8].confidence == 0.93 and rows["boiler.c::cycles", "writes", "clink", 7].file == "boiler.c"
    for line in (9, 10):  # the pair is confirmed, at all its sites
        assert rows["pump_set", "calls", "cscope", line].meta.semantic == "confirmed" and rows["pump_set", "calls", "cscope", line].confidence == 0.9
    assert rows["boiler.c::ceiling", "calls", "cscope", 8].meta.semantic == "confirmed" and rows["hw/real.c::sense", "calls", "cscope", 8].meta.semantic == "absent"
    assert counts == {"calls": 2, "writes": 1, "confirmed": 4, "absent": 6, "dropped": 1}
    ends = {(r.dst_qname, r.dst_kind) for r in once.edges.collect()}
    assert ends <= {(r.qname, r.kind) for r in once.nodes.collect()}
    again, same = build.import_semantic(once, told, root="/w")
    assert flat(again.edges) == flat(once.edges) and same == counts
    real, _ = build.import_semantic(graph, told, real=True)
    assert {r.confidence for r in real.edges.where("origin = 'clink'").collect()} == {0.95}


@pytest.mark.parametrize("bits", [64, 512])
def test_registered_gives_each_edge_once(spark, monkeypatch, bits):
    """Sites and handlers share several fields, more than have bits: one row for an edge, told by the site's first field."""
    monkeypatch.setattr(layers, "BITS", bits, raising=False)
    draw = random.Random(4)
    calls = [("a.c", line, 100 * line + k, draw.randrange(90)) for line in range(1, 25) for k in range(draw.randrange(1, 30))]
    lines = spark.createDataFrame([(f, line, seq, f"o->f{x}(1);") for f, line, seq, x in calls], "file string, line int, seq long, clean string")
    defs = spark.createDataFrame([(i, f"fn{i}", "function", "a.c", 3 * i + 1, 3 * i + 3, False, f"fn{i}") for i in range(7)], "seq long, name string, kind string, file string, line_start int, line_end int, is_static boolean, qname string")
    pairs = sorted({(draw.randrange(100), draw.randrange(40)) for _ in range(500)})
    by_hand = spark.createDataFrame([(f"f{x}", f"fn{h}", None) for x, h in pairs], schema.REGISTRATIONS)
    got = layers.registered(lines, by_hand, defs, layers.resolve_names(by_hand.select(F.col("handler").alias("symbol")), defs)).collect()
    first = {}
    for f, line, seq, x in calls:
        for y, h in pairs:
            if x == y and (line - 1) // 3 < 7 and h != (line - 1) // 3:
                key = (f"fn{(line - 1) // 3}", f"fn{h}", f, line)
                first[key] = min(first.get(key, (seq, x)), (seq, x))
    assert len(first) > 300 and len(got) == len(first)
    assert {(r.src_qname, r.dst_qname, r.file, r.line): (r["rank"].seq, int(r.meta.field[1:])) for r in got} == first


@pytest.mark.parametrize("bits, fields, dense", [(512, 60, True), (64, 90, True), (512, 5000, False)])
def test_registered_compares_a_site_and_a_handler_once(spark, monkeypatch, bits, fields, dense):
    """Where most sites and handlers share several fields, they don't meet by field, which made a row for each; the edges are the same."""
    monkeypatch.setattr(layers, "BITS", bits, raising=False)
    monkeypatch.setattr(layers, "GROUP", 400, raising=False)  # several parts of both sides
    draw = random.Random(5)
    calls = [("a.c", line, 100 * line + k, draw.randrange(fields)) for line in range(1, 31) for k in range(25)]
    lines = spark.createDataFrame([(f, line, seq, f"o->f{x}(1);") for f, line, seq, x in calls], "file string, line int, seq long, clean string")
    defs = spark.createDataFrame([(i, f"fn{i}", "function", "a.c", 3 * i + 1, 3 * i + 3, False, f"fn{i}") for i in range(9)], "seq long, name string, kind string, file string, line_start int, line_end int, is_static boolean, qname string")
    given = {(x, h): draw.choice([None, "", f"s{x}"]) for x, h in ((draw.randrange(fields), draw.randrange(50)) for _ in range(1000))}
    by_hand = spark.createDataFrame([(f"f{x}", f"fn{h}", s) for (x, h), s in given.items()], schema.REGISTRATIONS)
    edges = layers.registered(lines, by_hand, defs, layers.resolve_names(by_hand.select(F.col("handler").alias("symbol")), defs))
    first = {}
    for f, line, seq, x in calls:
        for (y, h), s in given.items():
            if x == y and (line - 1) // 3 < 9 and h != (line - 1) // 3:
                key = (f"fn{(line - 1) // 3}", f"fn{h}", f, line)
                first[key] = min(first.get(key, (seq, x, s or None)), (seq, x, s or None))
    got = edges.collect()
    assert len(first) > 80 and len(got) == len(first)
    assert {(r.src_qname, r.dst_qname, r.file, r.line): (r["rank"].seq, int(r.meta.field[1:]), r.meta.struct) for r in got} == first
    plan = edges.select("src_qname", "dst_qname")._jdf.queryExecution().optimizedPlan().toString()
    by_field = [j for j in plan.splitlines() if "Join Inner" in j and "field#" in j]
    assert any("__g#" in j for j in plan.splitlines() if "Join Inner" in j) == dense
    assert bool(by_field) == (not dense or fields > bits)


def test_co_changes(spark):
    commits = [("1", "a"), ("1", "b"), ("2", "a"), ("2", "b"), ("2", "c"), ("3", "c")] + [("4", f"x{i}") for i in range(30)] + [("5", f"x{i}") for i in range(30)]
    df = spark.createDataFrame(commits, schema.COMMITS)
    assert [tuple(r) for r in layers.co_change_pairs(df).collect()] == [("a", "b", 2)]
    edges = assemble.first_wins(layers.co_changes(df, df.select("path").distinct()))
    assert [tuple(r) for r in verbs.co_changed(edges, "b").collect()] == [("a", 2)] and edges.first().confidence == 0.5


def test_verbs(tables):
    doc = documents.sectioned(tables, "callers", "pump_set")
    assert [(i["qname"], i["site"], i["sites"], i["origins"]) for i in doc["definitions"][0]["items"]] == [("boiler_step", "boiler.c:9", 2, ["cscope"])]
    assert {i["qname"] for i in documents.sectioned(tables, "callees", "boiler_step")["definitions"][0]["items"]} == {"pump_set", "boiler.c::ceiling", "hw/real.c::sense", "hw/fake.c::sense"}
    assert {i["qname"] for i in documents.sectioned(tables, "callees", "pump_set")["definitions"][0]["items"]} == {"CLAMP", "heat/pump.c::ceiling"}
    both = documents.sectioned(tables, "callers", "ceiling")["definitions"]
    assert {(d["qname"], tuple(i["qname"] for i in d["items"])) for d in both} == {("heat/pump.c::ceiling", ("pump_set",)), ("boiler.c::ceiling", ("boiler_step",))}
    assert documents.sectioned(tables, "callers", "nothing")["definitions"] == []
    cut = documents.sectioned(tables, "callees", "boiler_step", limit=1)["definitions"][0]
    assert (len(cut["items"]), cut["total"], cut["truncated"]) == (1, 4, True)
    e = documents.explore(tables, "boiler_step")["definitions"][0]
    assert {(x["access"], x["qname"]) for x in e["globals"]} == {(k, g) for k in ("reads", "writes") for g in ("flow", "boiler.c::cycles")} and e["callers_total"] == 1
    assert documents.impact(tables, "pump_set", 4)["definitions"][0]["depths"] == {"1": ["boiler_step"], "2": ["ticks.c::on_tick"], "3": ["begin"]}
    assert documents.impact(tables, "pump_set", 1)["definitions"][0]["by_file"] == {"boiler.c": [{"name": "boiler_step", "line": 5}]}
    sense = documents.impact(tables, "sense", 1)["definitions"]
    assert len(sense) == 2 and all(d["affects"] == 0 and d["hint"].startswith("1 ambiguous") for d in sense)
    assert all(d["depths"] == {"1": ["boiler_step"]} for d in documents.impact(tables, "sense", 1, ambiguous=True)["definitions"])
    assert documents.global_users(tables, "flow")["definitions"] == [{"qname": "flow", "writers": ["boiler_step", "pump_set"], "readers": []}]
    assert documents.variables_of(tables, "pump_set")["items"] == [{"qname": "flow", "access": "reads", "site": "heat/pump.c:10"}, {"qname": "flow", "access": "writes", "site": "heat/pump.c:9"}]
    assert documents.includers(tables, "pump.h")["files"] == ["boiler.c", "heat/pump.c"] and documents.includers(tables, "nope.h")["files"] == []
    assert documents.includers(tables, "config.h")["files"] == ["ticks.c"]
    for f in (documents.impact, documents.global_users):
        with pytest.raises(verbs.UnknownSymbol):
            f(tables, "nothing")
    assert "boiler_step" in documents.text_of(doc) and "not found" in documents.text_of(documents.sectioned(tables, "callers", "nothing"))
    assert documents.notice(40, 50).startswith("… +10 more") and documents.notice(40, 40) == ""


def test_verbs_with_names_of_very_many_definitions(tables, monkeypatch):
    """Joins in place of filters give the same."""
    before = documents.sectioned(tables, "callers", "ceiling"), documents.impact(tables, "pump_set", 4), documents.global_users(tables, "flow")
    monkeypatch.setattr(verbs, "FEW", 0)
    monkeypatch.setattr("tracegraph.operators.traverse.FEW", 0)
    assert (documents.sectioned(tables, "callers", "ceiling"), documents.impact(tables, "pump_set", 4), documents.global_users(tables, "flow")) == before


def test_introspection(spark, graph, tables):
    doc = verbs.schema_document(tables)
    assert doc["nodes"]["macro"] == 3 and {"kind": "fnptr", "origin": "manual", "count": 3} in doc["edges"]
    assert [p["origin"] for p in doc["pending"]] == ["clangd", "clink"] and doc["warnings"] == []
    assert verbs.schema_document(tables, "new hash")["warnings"] == ["STALE: the manual table is new"]
    assert verbs.dump_document(tables, "p")["schema_version"] == "2"
    deps = {tuple(r) for r in tables["file_deps"].collect()}
    assert ("boiler.c", "heat/pump.c", "calls") in deps and ("(manual)", "fuel.c", "fnptr") in deps


GOOD = {"schema_version": "2", "root": "/w"}
TOOLS = {"ctags": {"path": "ctags", "version": "Universal Ctags 6", "flavor": "universal"}, "cscope": {"path": "cscope", "version": "15.9", "flavor": None}, "clink": {"path": "clink", "version": None, "flavor": None}}


@pytest.mark.parametrize(
    ("meta", "more", "codes", "health"),
    [
        (None, {}, {"NO_GRAPH"}, "ERROR"),
        (GOOD, {}, set(), "OK"),
        (GOOD | {"root": "/other"}, {}, {"ROOT_MISMATCH"}, "ERROR"),
        (GOOD | {"schema_version": "1"}, {}, {"SCHEMA_OLD"}, "WARN"),
        (GOOD | {"git_head": "a"}, {"head": "b"}, {"GIT_MOVED"}, "OK"),
        (GOOD | {"compile_db": "synthesized"}, {}, {"CLINK_SYNTHESIZED"}, "OK"),
        (GOOD, {"env_unknown": ["X"]}, {"ENV_UNKNOWN_VARS"}, "WARN"),
        (GOOD, {"tools": TOOLS}, {"CLINK_MISSING", "SKILL_MISSING"}, "OK"),
        (GOOD, {"tools": TOOLS, "skill": "stale"}, {"CLINK_MISSING", "SKILL_STALE"}, "WARN"),
        (GOOD, {"tools": {"ctags": TOOLS["ctags"] | {"flavor": "bsd"}}, "skill": "current"}, {"CTAGS_NOT_UNIVERSAL"}, "ERROR"),
        (GOOD, {"tools": {"cscope": TOOLS["clink"], "ctags": TOOLS["clink"]}, "skill": "current"}, {"TOOL_MISSING_CSCOPE", "TOOL_MISSING_CTAGS"}, "ERROR"),
    ],
)
def test_status_codes(meta, more, codes, health):
    doc = verbs.status_document(None, meta, "/w", **more)
    assert {i["code"] for i in doc["issues"]} == codes and doc["health"] == health
    assert {i["severity"] for i in doc["issues"]} <= {"info", "warn", "error"}


def test_status_of_drift(spark, graph):
    drift = build.changes(graph.files, facts(spark, {**TREE, **{f"n{i}.c": "" for i in range(7)}}).files)
    doc = verbs.status_document(drift, GOOD, "/w")
    assert doc["health"] == "WARN" and [i["code"] for i in doc["issues"]] == ["STALE_GRAPH"]
    assert doc["drift"] == {"changed": 0, "added": 7, "deleted": 0, "total": 7, "files": [f"n{i}.c" for i in range(5)], "truncated": True}
    assert len(verbs.status_document(drift, GOOD, "/w", full=True)["drift"]["files"]) == 7


def test_view_and_page(tables):
    view = verbs.view_document(tables, focus="pump_set", depth=1)
    assert {n["id"] for n in view["nodes"]} == {"pump_set", "boiler_step", "heat/pump.c::ceiling"} and [n["id"] for n in view["nodes"] if n["focus"]] == ["pump_set"]
    assert {x["id"] for x in verbs.view_document(tables, focus="ceiling", depth=1)["nodes"]} == {"pump_set", "boiler_step", "heat/pump.c::ceiling", "boiler.c::ceiling"}
    for solid in (True, False):
        text = page.html_page(view, solid)
        assert "boiler_step" in text and f"solid={str(solid).lower()}" in text and "http" not in text
    assert "</script><script>" not in page.html_page({"nodes": [{"id": "</script><script>"}], "links": [], "focus": None}, True)
    whole, few = verbs.view_document(tables), verbs.view_document(tables, most=2)
    assert whole["total"] == few["total"] == len(whole["links"]) and len(few["links"]) == 2 and {x for e in few["links"] for x in (e["source"], e["target"])} == {n["id"] for n in few["nodes"]}
    assert "2 of" in page.html_page(few)


def test_publish_load_drop(spark, tables, tmp_path):
    folder = f"file://{tmp_path}/g"
    with pytest.raises(FileNotFoundError):
        storage.load(spark, folder)
    first = storage.publish(spark, folder, tables)
    second = storage.publish(spark, folder, tables)
    assert second != first
    again = storage.load(spark, folder)
    assert flat(again["edges"]) == EDGES and documents.sectioned(again, "callers", "pump_set")["definitions"][0]["total"] == 1
    assert documents.sectioned(again, "callees", "pump_set")["definitions"][0]["total"] == 2
    # versions before the last one are removed
    third = storage.publish(spark, folder, tables)
    assert {p.name for p in (tmp_path / "g").iterdir() if p.is_dir()} == {second, third} and (tmp_path / "g/.gitignore").read_text() == "*\n"
    assert {"_CURRENT", ".gitignore", second, third} <= set(storage.drop(spark, folder)) and storage.drop(spark, folder) == []


def test_a_crash_while_publishing_leaves_the_old_graph(spark, tables, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/g"
    old = storage.publish(spark, folder, tables)

    def crash(*_):
        raise OSError("the machine is gone")

    for name in ("write_text", "_replace"):
        with monkeypatch.context() as m:
            m.setattr(storage, name, crash)
            with pytest.raises(OSError, match="gone"):
                storage.publish(spark, folder, tables)
        assert storage.current(spark, folder) == old and flat(storage.load(spark, folder)["edges"]) == EDGES


def test_a_few_names_are_filtered_for(spark, tables, tmp_path):
    folder = f"file://{tmp_path}/g"
    storage.publish(spark, folder, tables)
    t = storage.load(spark, folder)
    for end, name in (("dst", "pump_set"), ("src", "boiler_step")):
        formatted = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        plan = verbs.neighbours(verbs.pairs_of(t, end), t["nodes"], name, end)._jdf.queryExecution().explainString(formatted)
        assert f"EqualTo({end}_qname,{name})" in plan or f"In({end}_qname, [{name}])" in plan


def test_sql_gate(spark, tables):
    rows, more = sqlgate.run(spark, "WITH x AS (SELECT kind, count(*) AS n FROM edges GROUP BY kind HAVING n > 0) SELECT * FROM x ORDER BY kind", tables, 3)
    assert len(list(rows)) == 3 and more
    rows, more = sqlgate.run(spark, "SELECT 1", tables, 1)
    assert (list(rows), more) == ([(1,)], False)
    rows, more = sqlgate.run(spark, "SELECT qname FROM nodes", tables, 0)
    assert len(list(rows)) == tables["nodes"].count() and not more


@pytest.mark.parametrize(
    "text",
    [
        "SELECT kind, upper(name), row_number() OVER (PARTITION BY kind ORDER BY qname) AS r FROM nodes WHERE name LIKE 'p%' ORDER BY 1, 3 LIMIT 5",
        "SELECT * FROM nodes n JOIN edges e ON n.qname = e.src_qname AND e.kind IN (SELECT kind FROM edge_pairs WHERE site_count > 1)",
        "SELECT e.meta.field, (SELECT max(line) FROM edges) AS top FROM edges e WHERE EXISTS (SELECT 1 FROM nodes WHERE qname = e.dst_qname)",
        "SELECT o FROM edge_pairs LATERAL VIEW explode(split(origins, ',')) t AS o",
        "WITH RECURSIVE t(n) AS (VALUES (1) UNION ALL SELECT n + 1 FROM t WHERE n < 4) SELECT sum(n) FROM t",
        "SELECT * FROM range(3) UNION ALL SELECT count(*) FROM files",
    ],
)
def test_sql_gate_lets_queries_through(spark, tables, text):
    rows, _ = sqlgate.run(spark, text, tables)
    assert list(rows)


CALLS = ("reflect('java.lang.System', 'getProperty', 'user.dir')", "`reflect`('java.lang.System', 'getProperty', 'user.dir')", "reflect/**/('java.lang.System', 'getProperty', 'user.dir')", "java_method('java.lang.System', 'exit', 1)", "try_reflect('a', 'b')", "system.builtin.reflect('a', 'b')", "IDENTIFIER('reflect')('a', 'b')", "input_file_name()")


@pytest.mark.parametrize("text", ["DROP TABLE edges", "INSERT INTO edges SELECT * FROM edges", "CREATE TABLE t AS SELECT 1", "SET a=b", "CACHE TABLE edges", "DESCRIBE edges", "SHOW TABLES", "SELECT * FROM text.`/etc/hostname`", "SELECT * FROM parquet.`/x`", "SELECT * FROM default.edges", "SELECT * FROM other", "SELECT 1 WHERE 1 IN (SELECT value FROM text.`/etc/hostname`)", "SELECT TRANSFORM (qname) USING 'cat' FROM nodes", "SELECT * FROM IDENTIFIER('edges')", "SELECT :x", *(f"SELECT {c}" for c in CALLS), *(f"SELECT 1 WHERE EXISTS (SELECT {c})" for c in CALLS), *(f"WITH x AS (SELECT {c} AS y) SELECT * FROM x" for c in CALLS[:3]), f"SELECT * FROM nodes, LATERAL (SELECT {CALLS[0]})", f"SELECT count(*) OVER (ORDER BY {CALLS[0]}) FROM nodes", f"SELECT filter(array(1), x -> {CALLS[0]} = 'a')", f"SELECT * FROM nodes ORDER BY {CALLS[0]}", "SELECT * FROM python_worker_logs()"])
def test_sql_gate_refuses(spark, tables, text):
    with pytest.raises(sqlgate.Refused):
        sqlgate.run(spark, text, tables)


def test_watch_rebuilds_for_landed_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.c").write_text("int a;")
    seen = []
    q = watch.watch(spark, str(tmp_path / "in"), str(tmp_path / "ck"), lambda df, n: seen.append((n, df.count())), once=True)
    q.awaitTermination(60)
    assert seen == [(0, 1)]


def test_history_rows(spark):
    row = build.history_row(spark, "build-full", 3, 1.26, git="abc").first()
    assert (row.files, row.seconds, row.details) == (3, 1.3, '{"git": "abc"}') and datetime.datetime.fromisoformat(row.ts)


def test_a_cluster_needs_a_shared_folder():
    class Nothing:
        master = "spark://somewhere:7077"

        def get(self, *_):
            return None

        def getCheckpointDir(self):
            return None

    session = type("Session", (), {"conf": Nothing(), "sparkContext": Nothing()})()
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(session)
