"""The verbs as commands: ``python -m tracegraph.cli VERB [ARGUMENT]``.

Facts come from files that extractors wrote (``extract`` runs them): tags as JSON lines, an uncompressed cross-reference, a name-only commit log,
the manual table ``fnptr.json`` in the root, and for the semantic import a Parquet table of (category, name, parent, path, line).
"""

from __future__ import annotations

import argparse
import hashlib
import json
import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .plans import build as B
from .plans import documents, page, sqlgate, storage, verbs
from .schema import LIST_LIMIT, MIN_CONFIDENCE, SQL_LIMIT
from .sources import config, crossref, files, tools

HELP = """Build a graph, then ask it:

  schema                  what the graph has: nodes, edges by layer, layers that are missing
  explore X               a function: its definition, callers, callees and globals
  callers X / callees X   one step
  impact X -d N           everything that reaches X in N steps
  globals V / vars-of F   who reads and writes a global; what a function touches
  who-includes H          files that include a header
  co-changed F            files that changed with a file
  sql "SELECT ..."        read-only Spark SQL over nodes, edges, files, meta, edge_pairs, file_deps

Confidence says how accurate an engine is; edges below --min-conf are left out. Ambiguous edges may lead elsewhere."""

#: Where the help document may be installed, for agents to read.
SKILL_FOLDERS = ("~/.tracegraph",)
#: What a rebuild keeps of what the graph said about itself, as it keeps the layers.
INHERITED = ("compile_db",)


def _facts(spark: SparkSession, a: argparse.Namespace) -> B.Facts:
    tree = files.source_files(spark, a.root)
    lines = storage.checkpoint(files.source_lines(tree))
    definitions = storage.checkpoint(files.mark_static(config.read_tags(spark, a.tags), lines))
    if a.crossref:
        # sections are read once, whatever uses their facts
        occurrences = storage.checkpoint(crossref.wanted(crossref.read_crossref(spark, a.crossref), definitions))
        bad = crossref.bad_sections(occurrences).count()
        if bad:
            print(f"WARNING: {bad} sections of the cross-reference can't be read", file=sys.stderr)
    else:
        from .operators.resolve import enclosing, qualify

        guessed = files.lexical_occurrences(lines)
        inside = enclosing(guessed.where("op = 'call'"), qualify(definitions).where("kind = 'function'"))
        columns = guessed.columns
        occurrences = inside.withColumn("scope", F.col("src_name")).select(*columns).unionByName(guessed.where("op = 'include'"))
    links, registrations, digest = config.read_manual(spark, os.path.join(a.root, "fnptr.json"))
    rules = config.parse_module_rules(storage.read_text(spark, a.module_map) or "") if a.module_map else []
    commits = config.read_commit_log(spark, a.commits) if a.commits else None
    return B.Facts(tree, definitions, occurrences, registrations, links, commits, rules=rules, manual_hash=digest, lines=lines)


def _told(old: dict) -> dict[str, str]:
    return {r.key: r.value for r in old["meta"].collect()} if "meta" in old else {}


def _build(spark: SparkSession, a: argparse.Namespace) -> None:
    began, facts = time.time(), _facts(spark, a)
    try:
        old = storage.load(spark, a.db)
    except (FileNotFoundError, ValueError) as e:  # none, or of another version
        old = None
        if a.incremental:
            print(f"{e}; building in full")
    meta, before = _told(old or {}), None
    if a.incremental and old is not None:
        before = B.Graph(old["files"], old["nodes"], old["edges"])
        moved = meta.get("manual_src_hash") != facts.manual_hash or bool(a.module_map) or bool(a.commits)
        graph = B.rebuild(spark, facts, before, moved)
        if graph is before:
            print("up to date: nothing changed")
            return
    else:
        graph = B.build(spark, facts)
    seconds, action = time.time() - began, "build-incremental" if before is not None else "build-full"
    row = B.history_row(spark, action, graph.files.count(), seconds, module_map=a.module_map or "", git=tools.git_head(a.root) or "")
    history = row if old is None or "history" not in old else old["history"].unionByName(row)
    # a rebuild keeps the semantic layer, so it keeps what is said of it
    kept = {k: v for k, v in meta.items() if k in INHERITED} if before is not None else {}
    engines = [e for e in json.loads(meta.get("engines_run", "[]")) if before is not None and e["engine"] == "semantic"]
    engines.insert(0, {"engine": "tags+crossref+heuristics", "mode": action, "seconds": round(seconds, 1)})
    about = kept | {"root": os.path.realpath(a.root), "db_label": os.path.basename(a.db.rstrip("/")), "engines_run": json.dumps(engines)}
    for key, value in (("manual_src_hash", facts.manual_hash), ("git_head", tools.git_head(a.root))):
        if value:
            about[key] = value
    storage.publish(spark, a.db, B.tables(spark, graph, about, history))
    print("done: " + ", ".join(f"{r.kind}={r.n}" for r in graph.edges.groupBy("kind").agg(F.count("*").alias("n")).orderBy("kind").collect()))


def _import(spark: SparkSession, a: argparse.Namespace) -> None:
    """The semantic layer of a built graph, whose own nodes say what is defined."""
    began, old = time.time(), storage.load(spark, a.db)
    graph, told = B.import_semantic(B.Graph(old["files"], old["nodes"], old["edges"]), spark.read.parquet(a.arg), bool(a.compdb), os.path.realpath(a.root))
    mode = "given" if a.compdb else "synthesized"
    seconds = round(time.time() - began, 1)
    meta = {k: v for k, v in _told(old).items() if k != "schema_version"}
    engines = [e for e in json.loads(meta.get("engines_run", "[]")) if e["engine"] != "semantic"] + [{"engine": "semantic", "mode": mode, "seconds": seconds}]
    meta |= {"compile_db": mode, "engines_run": json.dumps(engines)}
    history = old["history"].unionByName(B.history_row(spark, "semantic-import", graph.files.count(), seconds, mode=mode, **{k: str(v) for k, v in told.items()}))
    storage.publish(spark, a.db, B.tables(spark, graph, meta, history))
    print(f"done: +calls={told['calls']}, +writes={told['writes']}; dropped={told['dropped']}; confirmed={told['confirmed']}, absent={told['absent']}")


def _compile_database(spark: SparkSession, a: argparse.Namespace) -> None:
    """What compile commands there are: the databases given, merged; else one in the root or its folder build; else one that is made up. Beside
    the result ``<out>.mode.txt`` says which; if that is another than before, what was made from the old commands has to be made again."""
    found = a.compdb.split(",") if a.compdb else [p for d in ("", "build") if os.path.exists(p := os.path.join(a.root, d, "compile_commands.json"))][:1]
    if found:
        first, conflicts = config.merge_compile_entries(config.read_compile_databases(spark, found))
        told = conflicts.count()
        for r in conflicts.orderBy("key", "db_prio", "pos").limit(5).collect():
            print(f"WARNING: {r.key} has another rule in database {r.db_prio}", file=sys.stderr)
        if told > 5:
            print(f"WARNING: and {told - 5} more", file=sys.stderr)
        entries, mode = first.select("directory", "file", "arguments", "command"), f"{'merged' if a.compdb else 'found'} {','.join(found)}"
    else:
        entries, mode = config.synthesize_compile_entries(files.source_files(spark, a.root).select("path"), os.path.realpath(a.root)), "synthesized"
    entries.write.mode("overwrite").json(a.out)
    before = storage.read_text(spark, f"{a.out}.mode.txt")
    storage.write_text(spark, f"{a.out}.mode.txt", mode)
    print(f"{mode}" + (f"; it was {before}: parse everything again" if before not in (None, mode) else ""))


def _skill() -> str | None:
    """Whether the help document is installed, as it is now."""
    there = [p for d in SKILL_FOLDERS if os.path.exists(p := os.path.join(os.path.expanduser(d), "SKILL.md"))]
    if not there:
        return None
    digests = set()
    for p in there:
        with open(p, "rb") as f:
            digests.add(hashlib.sha256(f.read().rstrip(b"\n")).hexdigest())
    return "current" if digests == {hashlib.sha256(HELP.encode()).hexdigest()} else "stale"


def _status(spark: SparkSession, a: argparse.Namespace) -> dict:
    root = os.path.realpath(a.root)
    about = {"head": tools.git_head(root) if os.path.isdir(root) else None, "tools": {n: tools.describe(n) for n in tools.NAMES}, "env_unknown": tools.unknown_settings(), "skill": _skill(), "full": a.full, "products": storage.products(spark, a.db)}
    found = storage.pointer(spark, a.db)
    if found is None:
        return verbs.status_document(None, None, root, **about)
    if str(found.get("schema_version")) != str(verbs.schema.SCHEMA_VERSION):  # its tables may be of other shapes
        return verbs.status_document(None, {"schema_version": str(found.get("schema_version"))}, root, **about)
    old = storage.load(spark, a.db)
    drift = B.changes(old["files"], files.source_files(spark, root)) if os.path.isdir(root) else None
    history = [r.asDict() | json.loads(r.details) for r in old["history"].orderBy("ts").collect()]
    return verbs.status_document(drift, _told(old), root, history=history, counts={"nodes": old["nodes"].count(), "edges": old["edges"].count()}, **about)


def _draw(spark: SparkSession, a: argparse.Namespace, t: dict) -> dict | None:
    view = verbs.view_document(t, a.focus, a.depth, a.min_conf, a.full)
    if a.focus and not view["nodes"]:
        raise verbs.UnknownSymbol(a.focus)
    if os.path.isdir(a.root) and not B.changes(t["files"], files.source_files(spark, a.root)).isEmpty():
        print("WARNING: the graph is older than its sources; build incrementally", file=sys.stderr)
    if a.format == "json":
        return view
    solid = a.format in ("html3d", "html")
    out = a.out or f"graph-{'3d' if solid else '2d'}.html"
    with open(out, "w", encoding="utf-8") as f:
        f.write(page.html_page(view, solid))
    print(f"wrote {out}: {len(view['nodes'])} nodes, {len(view['links'])} links")
    return None


def _ask(spark: SparkSession, a: argparse.Namespace) -> dict | None:
    verb, arg, least = a.verb, a.arg, a.min_conf
    limit = a.limit if a.limit is not None else LIST_LIMIT
    if verb == "status":
        return _status(spark, a)
    t = storage.load(spark, a.db)
    if verb == "schema":
        digest = config.parse_manual(storage.read_text(spark, os.path.join(a.root, "fnptr.json")))[2]
        return verbs.schema_document(t, digest)
    if verb == "dumpdb":
        return verbs.dump_document(t, a.db)
    if verb == "viz":
        return _draw(spark, a, t)
    if verb == "sql":
        rows, more = sqlgate.run(spark, arg, {k: t[k] for k in storage.TABLES if k in t}, a.limit if a.limit is not None else SQL_LIMIT)
        for r in rows:
            print("|".join("" if x is None else str(x) for x in r))
        if more:
            print("… more rows; --limit 0 shows all")
        return None
    ask = {
        "callers": lambda: documents.sectioned(t, "callers", arg, least, limit),
        "callees": lambda: documents.sectioned(t, "callees", arg, least, limit),
        "explore": lambda: documents.explore(t, arg, least, limit),
        "impact": lambda: documents.impact(t, arg, a.depth, least, a.ambiguous),
        "globals": lambda: documents.global_users(t, arg, least),
        "vars-of": lambda: documents.variables_of(t, arg, least),
        "who-includes": lambda: documents.includers(t, arg),
        "co-changed": lambda: documents.co_changed(t, arg),
    }
    return ask[verb]()


VERBS = ("extract", "build", "semantic-import", "compile-db", "schema", "explore", "callers", "callees", "impact", "globals", "vars-of", "who-includes", "co-changed", "viz", "status", "dumpdb", "reset", "skill", "sql")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="tracegraph", description=HELP, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("verb", choices=VERBS)
    p.add_argument("arg", nargs="?")
    p.add_argument("-p", "--root", default=".")
    p.add_argument("--db", default=None, help="folder of the graph")
    p.add_argument("--tags")
    p.add_argument("--crossref")
    p.add_argument("--commits")
    p.add_argument("--module-map")
    p.add_argument("--compdb")
    p.add_argument("--out")
    p.add_argument("--incremental", action="store_true")
    p.add_argument("-d", "--depth", type=int, default=2)
    p.add_argument("--min-conf", type=float, default=MIN_CONFIDENCE)
    p.add_argument("--ambiguous", action="store_true")
    p.add_argument("--focus")
    p.add_argument("--full", action="store_true")
    p.add_argument("--format", choices=("html3d", "html2d", "html", "json"), default="html3d")
    p.add_argument("--json", action="store_true")
    p.add_argument("--limit", type=int)
    a = p.parse_args(argv)
    a.db = a.db or os.path.join(a.root, ".tracegraph")
    if a.verb == "skill":
        print(HELP)
        return 0
    if a.verb == "extract":
        try:
            print(json.dumps(tools.extract(a.root, a.out or os.path.join(a.db, "extracted"), a.incremental)))
        except tools.ToolError as e:
            print(e, file=sys.stderr)
            return 1
        return 0
    session = spark or SparkSession.builder.appName("tracegraph").getOrCreate()
    if a.verb in ("build", "semantic-import", "compile-db"):
        {"build": _build, "semantic-import": _import, "compile-db": _compile_database}[a.verb](session, a)
        return 0
    if a.verb == "reset":
        for name in storage.drop(session, a.db):
            print(f"deleted {name}")
        return 0
    if a.verb in ("explore", "callers", "callees", "impact", "globals", "vars-of", "who-includes", "co-changed", "sql") and not a.arg:
        p.error(f"{a.verb} needs an argument")
    try:
        document = _ask(session, a)
    except verbs.UnknownSymbol as e:
        print(f"{e}: not found", file=sys.stderr)
        return 1
    except sqlgate.Refused as e:
        print(e, file=sys.stderr)
        return 1
    except FileNotFoundError as e:
        print(f"{e}; build first", file=sys.stderr)
        return 1
    if document is not None:
        print(json.dumps(document, ensure_ascii=False) if a.json or "verb" not in document else documents.text_of(document))
    return 0


if __name__ == "__main__":
    sys.exit(main())
