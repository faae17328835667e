"""Extractors: where they are, what they are, and running them. Their output files are all that the engine reads."""

from __future__ import annotations

import os
import shutil
import subprocess
from pathlib import Path

PREFIX = "TRACEGRAPH_"
#: Programs that can be set by a variable of their own, ``TRACEGRAPH_<NAME>_PATH``.
NAMES = ("ctags", "cscope", "clink", "git")
SETTINGS = tuple(f"{PREFIX}{n.upper()}_PATH" for n in NAMES)
SECONDS = 20


class ToolError(RuntimeError):
    """A program is missing, of the wrong kind, or has failed."""


def path_of(name: str) -> str:
    return os.environ.get(f"{PREFIX}{name.upper()}_PATH", name)


def unknown_settings() -> list[str]:
    """Variables with our prefix that nothing reads."""
    return sorted(k for k in os.environ if k.startswith(PREFIX) and k not in SETTINGS)


def flavor_of(version: str) -> str:
    """What a program for tags says it is; one that doesn't know the question is the oldest kind."""
    return next((f for f in ("universal", "exuberant") if f"{f} ctags" in version.lower()), "bsd")


def describe(name: str) -> dict:
    """path, version (None if it can't be run) and, of ctags, flavor."""
    path = path_of(name)
    try:
        said = subprocess.run([path, "--version"], capture_output=True, text=True, timeout=SECONDS)
    except (OSError, subprocess.TimeoutExpired):
        return {"path": path, "version": None, "flavor": None}
    told = (said.stdout or said.stderr).strip()
    return {"path": path, "version": told.split("\n")[0] or "?", "flavor": flavor_of(told) if name == "ctags" else None}


def run(command: list[str], folder: str) -> str:
    """The output of a program that must succeed."""
    if shutil.which(command[0]) is None:
        raise ToolError(f"{command[0]} isn't there")
    done = subprocess.run(command, cwd=folder, capture_output=True, text=True)
    if done.returncode:
        raise ToolError(f"{command[0]} failed with {done.returncode}: {done.stderr.strip()[:300]}")
    return done.stdout


def git_head(folder: str) -> str | None:
    try:
        return run([path_of("git"), "rev-parse", "HEAD"], folder).strip() or None
    except ToolError:
        return None


def extract(root: str, out: str, again: bool = False) -> dict[str, str]:
    """Run the extractors over ``root`` into the folder ``out``: tags, an uncompressed cross-reference and, in a repository, the commit log. ``again`` makes the
    cross-reference from scratch although files look unchanged. Gives the path of each."""
    ctags = describe("ctags")
    if ctags["version"] is None or ctags["flavor"] != "universal":
        raise ToolError(f"Universal Ctags is needed for ends of definitions as JSON; {ctags['path']} is {ctags['flavor'] or 'not there'}")
    folder = Path(out).absolute()
    folder.mkdir(parents=True, exist_ok=True)
    found = {k: str(folder / name) for k, name in (("tags", "tags.json"), ("crossref", "crossref.out"))}
    run([ctags["path"], "--output-format=json", "--fields=+neS", "--languages=C,C++", "--kinds-C=fvd", "--kinds-C++=fvd", "-R", "-f", found["tags"], "."], root)
    run([path_of("cscope"), "-bckRu" if again else "-bckR", "-f", found["crossref"]], root)
    if git_head(root):
        found["commits"] = str(folder / "commits.log")
        Path(found["commits"]).write_text(run([path_of("git"), "log", "--name-only", "--pretty=format:%H", "-n", "500"], root))
    return found
