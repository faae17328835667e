import json
import os

import pytest
from pyspark.sql import functions as F

from tracegraph import cli, schema
from tracegraph.plans import storage
from tracegraph.sources import tools

from .test_graph import DEFS, TREE

KINDS = {"function": "function", "global": "variable", "macro": "macro"}


@pytest.fixture(scope="module")
def project(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, text in TREE.items():
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_text(text)
    (root / "fnptr.json").write_text('{"links": [{"src": "begin", "dst": "spark"}], "registrations": [{"field": "light", "handler": "spark", "struct": "fuel"}]}')
    (root / "tags.json").write_text("\n".join(json.dumps({"_type": "tag", "name": n, "kind": KINDS[k], "path": f, "line": a, "end": b}) for n, k, f, a, b, _ in DEFS))
    return root


@pytest.fixture(scope="module")
def run(spark, project):
    def go(*args):
        return cli.main([*args, "-p", str(project), "--tags", str(project / "tags.json")], spark)

    go("build")
    return go


def test_verbs_print(run, capsys, tmp_path):
    assert run("callers", "pump_set", "--json") == 0
    assert {i["qname"] for i in json.loads(capsys.readouterr().out)["definitions"][0]["items"]} == {"boiler_step"}
    assert run("impact", "ceiling", "-d", "2") == 0 and "boiler_step" in capsys.readouterr().out
    assert run("impact", "nothing") == 1 and "not found" in capsys.readouterr().err
    assert run("who-includes", "pump.h") == 0 and "boiler.c" in capsys.readouterr().out
    assert run("sql", "SELECT kind, count(*) FROM nodes GROUP BY kind ORDER BY kind", "--limit", "1") == 0 and "more rows" in capsys.readouterr().out
    assert run("sql", "SELECT `reflect`('java.lang.System', 'getProperty', 'user.dir')") == 1 and "isn't allowed" in capsys.readouterr().err
    assert run("schema") == 0 and json.loads(capsys.readouterr().out)["warnings"] == []
    assert run("dumpdb") == 0 and len(json.loads(capsys.readouterr().out)["history"]) == 1
    assert run("skill") == 0 and "impact" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        run("callers")


def test_drawings(run, project, capsys, tmp_path):
    assert run("viz", "--format", "json", "--focus", "pump_set", "-d", "1") == 0 and json.loads(capsys.readouterr().out)["focus"] == "pump_set"
    for form in ("html3d", "html2d"):
        assert run("viz", "--format", form, "--out", str(tmp_path / form)) == 0 and "nodes" in capsys.readouterr().out
        assert "boiler_step" in (tmp_path / form).read_text() and ("solid=true" in (tmp_path / form).read_text()) == (form == "html3d")
    assert run("viz", "--focus", "nothing") == 1
    (project / "late.c").write_text("int late;\n")
    assert run("viz", "--out", str(tmp_path / "x")) == 0 and "older than its sources" in capsys.readouterr().err
    (project / "late.c").unlink()


def fake_tool(folder, name, script):
    path = folder / name
    path.write_text("#!/bin/sh\n" + script)
    path.chmod(0o755)
    return str(path)


def test_status(run, project, capsys, tmp_path, monkeypatch, spark):
    ask = lambda: (run("status"), json.loads(capsys.readouterr().out))[1]
    codes = lambda doc: {i["code"] for i in doc["issues"]}
    for name in tools.NAMES:
        monkeypatch.setenv(f"TRACEGRAPH_{name.upper()}_PATH", str(tmp_path / "none"))
    assert codes(ask()) == {"TOOL_MISSING_CTAGS", "TOOL_MISSING_CSCOPE", "CLINK_MISSING", "SKILL_MISSING"}
    monkeypatch.setenv("TRACEGRAPH_CTAGS_PATH", fake_tool(tmp_path, "ctags", "echo 'Exuberant Ctags 5.8'"))
    assert "CTAGS_NOT_UNIVERSAL" in codes(ask())
    monkeypatch.setenv("TRACEGRAPH_CTAGS_PATH", fake_tool(tmp_path, "uctags", "echo 'Universal Ctags 6.1'"))
    monkeypatch.setenv("TRACEGRAPH_CSCOPE_PATH", fake_tool(tmp_path, "cscope", "echo 'version 15.9' >&2"))
    monkeypatch.setenv("TRACEGRAPH_CLINK_PATH", fake_tool(tmp_path, "clink", "echo 1"))
    monkeypatch.setattr(cli, "SKILL_FOLDERS", (str(tmp_path),))
    (tmp_path / "SKILL.md").write_text(cli.HELP + "\n")
    doc = ask()
    assert codes(doc) == set() and doc["health"] == "OK" and doc["artifact"]["nodes"] > 20 and doc["products"]["size"] > 0
    (tmp_path / "SKILL.md").write_text("old")
    monkeypatch.setenv("TRACEGRAPH_CTAG_PATH", "x")
    doc = ask()
    assert codes(doc) == {"SKILL_STALE", "ENV_UNKNOWN_VARS"} and doc["health"] == "WARN"
    monkeypatch.delenv("TRACEGRAPH_CTAG_PATH")
    (tmp_path / "SKILL.md").unlink()
    other = tmp_path / "elsewhere"
    other.mkdir()
    assert cli.main(["status", "-p", str(other), "--db", str(project / ".tracegraph")], spark) == 0
    doc = json.loads(capsys.readouterr().out)
    assert {"ROOT_MISMATCH", "STALE_GRAPH"} <= codes(doc) and doc["health"] == "ERROR"
    assert cli.main(["status", "-p", str(other)], spark) == 0 and "NO_GRAPH" in codes(json.loads(capsys.readouterr().out))
    storage.write_text(spark, f"file://{other}/.tracegraph/_CURRENT", json.dumps({"version": "x", "schema_version": 1}))
    assert cli.main(["status", "-p", str(other)], spark) == 0 and "SCHEMA_OLD" in codes(json.loads(capsys.readouterr().out))


def test_extract_runs_the_tools(run, project, capsys, tmp_path, monkeypatch):
    monkeypatch.setenv("TRACEGRAPH_CTAGS_PATH", fake_tool(tmp_path, "ctags", 'case "$1" in --version) echo "Universal Ctags 6";; *) while [ "$1" != -f ]; do shift; done; echo "{}" > "$2";; esac'))
    monkeypatch.setenv("TRACEGRAPH_CSCOPE_PATH", fake_tool(tmp_path, "cscope", 'echo "$1" > "$3"'))
    monkeypatch.setenv("TRACEGRAPH_GIT_PATH", fake_tool(tmp_path, "git", "echo 0123456789012345678901234567890123456789"))
    assert run("extract", "--out", str(tmp_path / "out")) == 0
    found = json.loads(capsys.readouterr().out)
    assert set(found) == {"tags", "crossref", "commits"} and open(found["crossref"]).read() == "-bckR\n"
    assert run("extract", "--out", str(tmp_path / "out"), "--incremental") == 0 and open(found["crossref"]).read() == "-bckRu\n"
    monkeypatch.setenv("TRACEGRAPH_CSCOPE_PATH", fake_tool(tmp_path, "bad", "echo broken >&2; exit 3"))
    capsys.readouterr()
    assert run("extract", "--out", str(tmp_path / "out")) == 1 and "broken" in capsys.readouterr().err
    monkeypatch.setenv("TRACEGRAPH_CTAGS_PATH", fake_tool(tmp_path, "bsd", "exit 1"))
    assert run("extract", "--out", str(tmp_path / "out")) == 1 and "Universal" in capsys.readouterr().err


def test_semantic_import_uses_the_graphs_own_definitions(run, spark, project, capsys, tmp_path):
    """A static callee: its node is the one that the import's edges lead to, and a rebuild keeps what is said of the layer."""
    rows = [(1, "ceiling", "boiler_step", str(project / "boiler.c"), 8), (1, "sense", "boiler_step", "boiler.c", 8), (1, "sense", "nobody", "boiler.c", 8)]
    spark.createDataFrame(rows, schema.SEMANTIC).write.parquet(str(tmp_path / "told"))
    assert run("semantic-import", str(tmp_path / "told")) == 0 and "dropped=1" in capsys.readouterr().out
    t = storage.load(spark, str(project / ".tracegraph"))
    layer = t["edges"].where("origin = 'clink'")
    assert {r.dst_qname for r in layer.collect()} == {"boiler.c::ceiling", "hw/real.c::sense", "hw/fake.c::sense"}
    assert layer.join(t["nodes"].select(F.col("qname").alias("dst_qname")), "dst_qname", "left_anti").isEmpty()
    static = t["edges"].where("origin = 'cscope' and kind = 'calls' and dst_qname = 'boiler.c::ceiling' and src_qname = 'boiler_step'")
    assert {r.meta.semantic for r in static.collect()} == {"confirmed"}
    (project / "hw/real.c").write_text("int sense(void) { return 62; }\n")
    run("build", "--incremental")
    meta = {r.key: r.value for r in storage.load(spark, str(project / ".tracegraph"))["meta"].collect()}
    assert meta["compile_db"] == "synthesized" and [e["engine"] for e in json.loads(meta["engines_run"])] == ["tags+crossref+heuristics", "semantic"]
    run("status")
    assert "CLINK_SYNTHESIZED" in capsys.readouterr().out


def test_compile_databases(run, project, capsys, tmp_path):
    out = str(tmp_path / "made")
    run("compile-db", "--out", out)
    assert any("-std=gnu11" in p.read_text() for p in (tmp_path / "made").glob("part-*")) and (tmp_path / "made.mode.txt").read_text() == "synthesized"
    capsys.readouterr()
    (project / "build").mkdir()
    (project / "build/compile_commands.json").write_text(json.dumps([{"directory": str(project), "file": "boiler.c", "command": "cc boiler.c"}]))
    run("compile-db", "--out", out)
    assert "it was synthesized: parse everything again" in capsys.readouterr().out
    run("compile-db", "--out", out)
    assert "again" not in capsys.readouterr().out
    (tmp_path / "b.json").write_text(json.dumps([{"directory": str(project), "file": "boiler.c", "command": "cc -O2 boiler.c"}]))
    run("compile-db", "--out", out, "--compdb", f"{project}/build/compile_commands.json,{tmp_path}/b.json")
    told = capsys.readouterr()
    assert "another rule" in told.err and "merged" in told.out


def test_incremental_and_reset(run, project, capsys):
    run("build", "--incremental")
    assert "up to date" in capsys.readouterr().out
    (project / "hw/fake.c").write_text("int sense(void) { return pump_set(1); }\n")
    run("status")
    assert json.loads(capsys.readouterr().out)["drift"]["changed"] == 1
    run("build", "--incremental")
    assert run("callers", "pump_set", "--json") == 0
    assert {i["qname"] for i in json.loads(capsys.readouterr().out.splitlines()[-1])["definitions"][0]["items"]} == {"boiler_step", "hw/fake.c::sense"}
    assert run("reset") == 0 and run("schema") == 1
    assert not os.path.exists(project / ".tracegraph")
