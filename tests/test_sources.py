import json

import pytest
from pyspark.sql import functions as F

from tracegraph import schema
from tracegraph.sources import config, crossref, files

HEAD = "cscope 15 /srv/mail -c               0000000042"


def record(number, *parts):
    """A record from its first text, then symbols and texts in turn."""
    return "\n".join([f"{number} {parts[0]}", *parts[1:]]) + "\n\n"


def section(file, *items):
    return f"{file}\n\n" + "".join(items)


def told(*items):
    return {(op, name, scope) for op, name, scope, *_ in crossref.read_section(section("m.c", *items))}


def test_what_stands_in_a_function():
    rows = list(crossref.read_section(section("m.c", record(12, "void ", "\t$deliver", "(box *b) { ", "queue", " <<= ", "\t`depth", "(b); if (", "limit", " == ", "queue", ") ", "\t`drop", "(b); ", "\t}", "}"))))
    text = "void deliver(box *b) { queue <<= depth(b); if (limit == queue) drop(b); }"
    assert {r[5] for r in rows} == {text} and {r[3:5] for r in rows} == {("m.c", 12)}
    assert {r[:3] for r in rows} == {("ref", "deliver", "deliver"), ("ref", "queue", "deliver"), ("assign", "queue", "deliver"), ("ref", "depth", "deliver"), ("call", "depth", "deliver"), ("ref", "limit", "deliver"), ("ref", "drop", "deliver"), ("call", "drop", "deliver")}
    assert len(rows) == 8  # queue is told once


@pytest.mark.parametrize(("after", "assigned"), [(" = 1", True), ("\t*= 2", True), (" >>= 2", True), (" |= x", True), (" == 1", False), ("++", False), (" <= 1", False), ("", False)])
def test_assignments(after, assigned):
    assert (("assign", "n", "<global>") in told(record(1, "", "n", after))) == assigned


def test_scope_ends_and_symbols_outside():
    assert told(record(1, "", "\t$open", "() {", "\t}", "}"), record(2, "x = ", "\t`later", "();")) >= {("call", "later", "<global>")}
    # a bare mark between records ends a function, or begins one
    assert ("call", "mid", "late") in told("\t$late\n", record(4, "", "\t`mid", "()"))
    assert ("call", "mid", "<global>") in told("\t$late\n\t}\n", record(4, "", "\t`mid", "()"))
    # what was last seen in a function stays there, unless its mark is a letter
    items = [record(1, "", "\t$fill", "() { ", "tank", " = 1; ", "\t}", "}")]
    assert told(*items, record(9, "", "tank", " = 2")) == {("ref", "fill", "fill"), ("ref", "tank", "fill"), ("assign", "tank", "fill")}
    assert ("ref", "tank", "<global>") in told(*items, record(9, "", "\tgtank", " = 2"))


def test_macros():
    body = record(3, "", "\t#ROUND", "(v) ", "\t`up", "(v)", "\t)", "")
    assert told(body) == {("ref", "ROUND", "<global>"), ("ref", "up", "ROUND"), ("call", "up", "ROUND")}
    # a macro within a function: its body is its own, what follows is the function's; it isn't remembered as a place
    inner = [record(1, "", "\t$mill", "() {"), record(2, "", "\t#ROUND", "(v) ", "\t`up", "(v)", "\t)", ""), record(3, "", "\t`up", "(1)")]
    assert {x for x in told(*inner) if x[:2] == ("call", "up")} == {("call", "up", "ROUND"), ("call", "up", "mill")}
    assert told(body, record(8, "", "up", "")) - told(body) == {("ref", "up", "<global>")}


def test_a_function_in_a_function_counts_for_both():
    items = [record(5, "class ", "\t$Outer", " : "), record(6, "", "\t$inner", "(x)"), record(7, "", "\t`work", "();"), "\t}\n", record(8, "", "\t`work", "();")]
    assert {x[2] for x in told(*items) if x[:2] == ("call", "work")} == {"inner", "Outer"} | {"inner"}
    again = [record(1, "", "\t$a", ""), record(2, "", "\t$b", ""), record(3, "", "\t$a", ""), record(4, "", "\t`w", "")]
    assert {x[2] for x in told(*again) if x[:2] == ("call", "w")} == {"a", "b"}


def test_includes_by_base_name():
    assert told(record(1, "#include ", '\t~"net/smtp.h', '"'), record(2, "", "\t~<stdio.h", ">")) == {("include", "smtp.h", "<global>"), ("include", "stdio.h", "<global>")}


def test_read_crossref(spark, tmp_path):
    parts = [section("a.c", record(1, "int ", "\t$send", "(", "mail", " m) {"), record(2, "", "sent", " += 1; ", "\t`log", "();", "\t}", ""), record(3, "", '\t~"net/smtp.h', '"')), section("b.c", record(2, "", "\t$seen", "() { return ", "sent", " == 3; ", "\t}", "}"))]
    (tmp_path / "x.out").write_text("\n\t@".join([HEAD, *(x.removesuffix("\n") for x in parts), "\n0\n"]))
    got = crossref.read_crossref(spark, str(tmp_path / "x.out"))
    assert {r.file for r in got.collect()} == {"a.c", "b.c"}
    assert got.where("op = 'assign' and file = 'b.c'").count() == 0 and got.where("op = 'ref' and file = 'b.c' and name = 'sent' and scope = 'seen'").count() == 1
    defs = spark.createDataFrame([(0, "send", "function", "a.c", 1, 2, False, None), (1, "sent", "global", "a.c", 9, 9, False, None), (2, "log", "macro", "a.c", 9, 9, False, None)], schema.DEFINITIONS)
    kept = crossref.wanted(got, defs)
    assert {(r.op, r.name) for r in kept.collect()} == {("call", "log"), ("ref", "sent"), ("assign", "sent"), ("include", "smtp.h")}
    (tmp_path / "part.out").write_text("\n\t@".join([HEAD, "a.c\n\n9x9 \nname\n\n", section("b.c", record(1, "", "\t`log", "()")).removesuffix("\n"), "\n0\n"]))
    part = crossref.read_crossref(spark, str(tmp_path / "part.out"))
    assert [r.file for r in crossref.bad_sections(crossref.wanted(part, defs)).collect()] == ["a.c"] and part.where("op = 'call'").count() == 1
    (tmp_path / "bad.out").write_text("cscope 15 /srv 000\n\t@\n")
    with pytest.raises(crossref.CrossrefError, match="format"):
        crossref.read_crossref(spark, str(tmp_path / "bad.out"))
    (tmp_path / "cut.out").write_text(HEAD + "\n\t@a.c\n\n1 x\n\n")
    with pytest.raises(crossref.CrossrefError, match="trailer"):
        crossref.read_crossref(spark, str(tmp_path / "cut.out"))


def test_tree_tags_and_static(spark, tmp_path):
    root = tmp_path / "tree"
    (root / "sub").mkdir(parents=True)
    (root / ".git").mkdir()
    (root / "a.c").write_bytes(b"static int\nf(void) { return 1; } \xff\nint g(void) { /* x\n g( */ }\n")
    (root / "sub/b.h").write_text("#define M 1\n")
    (root / ".git/c.c").write_text("int no;")
    (root / "readme.txt").write_text("no")
    tree = files.source_files(spark, str(root))
    assert {r.path for r in tree.collect()} == {"a.c", "sub/b.h"}
    lines = files.source_lines(tree)
    assert [(r.line, r.clean) for r in lines.where("file = 'a.c'").orderBy("line").collect()] == [(1, "static int"), (2, "f(void) { return 1; } �"), (3, "int g(void) { "), (4, " }")]
    (tmp_path / "tags").write_text("\n".join([json.dumps({"_type": "tag", "name": "f", "path": "a.c", "line": 2, "end": 2, "kind": "function"}), "not json", json.dumps({"_type": "tag", "name": "g", "path": "./a.c", "line": 3, "kind": "function", "signature": "(void)"}), json.dumps({"_type": "tag", "name": "M", "path": "sub/b.h", "line": 1, "kind": "macro"}), json.dumps({"_type": "tag", "name": "t", "path": "a.c", "line": 9, "kind": "typedef"})]))
    defs = files.mark_static(config.read_tags(spark, str(tmp_path / "tags")), lines)
    assert {(r.name, r.kind, r.file, r.line_start, r.line_end, r.is_static) for r in defs.collect()} == {("f", "function", "a.c", 2, 2, True), ("g", "function", "a.c", 3, 3, False), ("M", "macro", "sub/b.h", 1, 1, False)}


def test_manual_rules_and_commits(spark, tmp_path):
    assert config.parse_manual(None) == ([], [], None)
    links, regs, digest = config.parse_manual('{"links": [{"src": "a", "dst": "b"}], "registrations": [{"field": "f", "handler": "h"}]}')
    assert links == [("a", "b")] and regs == [("f", "h", None)] and len(digest) == 64
    for bad in ('{"links": [{"src": "a"}]}', '{"registrations": [{"field": "a"}]}', "{"):
        with pytest.raises(ValueError):
            config.parse_manual(bad)
    for bad in ("a\n", "[,x\n"):
        with pytest.raises(ValueError):
            config.parse_module_rules(bad)
    (tmp_path / "log").write_text("a" * 40 + "\n\nx.c\ny.c\n" + "b" * 40 + "\n\nx.c\n" + "c" * 40 + "\nz.c\n")
    assert {tuple(r) for r in config.read_commit_log(spark, str(tmp_path / "log"), 2).collect()} == {("a" * 40, "x.c"), ("a" * 40, "y.c"), ("b" * 40, "x.c")}


def test_paths(spark):
    rows = [("/w/./a", "b.c", "/w/a/b.c"), ("/w/a/..", "../x.c", "/x.c"), ("/", "/abs/./y.c", "/abs/y.c"), ("rel", "../../z.c", "../z.c"), ("/w", "../../../t.c", "/t.c")]
    df = spark.createDataFrame(rows, "d string, f string, want string")
    assert [(r.got, r.want) for r in df.select(config.joined_path(F.col("d"), F.col("f")).alias("got"), "want").where("got != want").collect()] == []


def test_compile_databases(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"directory": "/w", "file": "s.c", "command": "cc s.c"}, {"directory": "/w", "file": "a.c", "arguments": ["cc", "a.c"]}]))
    (tmp_path / "b.json").write_text(json.dumps([{"directory": "/w/x", "file": "../s.c", "command": "cc -O2 s.c"}, {"directory": "/w", "file": "b.c", "command": "cc b.c"}]))
    first, conflicts = config.merge_compile_entries(config.read_compile_databases(spark, [str(tmp_path / "a.json"), str(tmp_path / "b.json")]))
    assert {(r.key, r.db_prio) for r in first.collect()} == {("/w/s.c", 0), ("/w/a.c", 0), ("/w/b.c", 1)}
    assert [tuple(r) for r in conflicts.collect()] == [("/w/s.c", 1, 0)]
