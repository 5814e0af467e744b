"""Reading logs and documents from file trees (A).

Listing and guards run on the driver, contents are read by Spark. A file of JSON lines is read
whole and split, so that lines keep their number; a file is a session's log, which is small,
and files are read in parallel.
"""

from __future__ import annotations

import datetime
import json
import os
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import description_of

#: Directories that hold no files of a project's own, and instruction files by name.
SKIPPED_DIRS = {".git", "node_modules", "__pycache__", ".venv", "venv", "vendor", ".claude", "target", "dist", "build"}
INSTRUCTION_FILES = {"CLAUDE.md": "claude_md", "AGENTS.md": "agents_md", "PROJECT.md": "project_md"}
LINES_SCHEMA = "file string, pos int, line string, modified timestamp"


class Refused(ValueError):
    """Something outside what may be read or written."""


def resolve_within(root: str, path: str) -> str:
    """``path`` with links resolved, if it lies in ``root`` by components."""
    base, real = os.path.realpath(root), os.path.realpath(os.path.join(root, path))
    if real != base and not real.startswith(base + os.sep):
        raise Refused(f"{path} lies outside {root}")
    return real


def log_files(root: str, pattern: str = ".jsonl", since: float | None = None) -> list[str]:
    """Log files below ``root`` in order of path; an absent root has none, a directory that
    cannot be listed is an error, files last written before ``since`` are left out unopened."""
    if not os.path.isdir(root):
        return []

    def refuse(error: OSError):
        raise Refused(f"cannot list {error.filename}") from error

    found = []
    for where, dirs, names in os.walk(root, onerror=refuse):
        dirs.sort()
        found += [os.path.join(where, n) for n in sorted(names) if n.endswith(pattern)]
    inside = os.path.realpath(root) + os.sep
    found = [f for f in found if os.path.realpath(f).startswith(inside)]
    return sorted(f for f in found if since is None or os.path.getmtime(f) >= since)


def session_files(root: str, project: str | None = None, since: float | None = None) -> list[str]:
    """A1: logs in the project directories of ``root``; a project is compared whole."""
    return [f for f in log_files(root, since=since) if project is None or os.path.relpath(f, root).split(os.sep)[0] == project]


def read_lines(spark: SparkSession, root: str, files: list[str] | None = None) -> DataFrame:
    """Lines of files with their position from 1 and the file's path below ``root``."""
    files = log_files(root) if files is None else files
    if not files:
        return spark.createDataFrame([], LINES_SCHEMA)
    whole = spark.read.text(files, wholetext=True).select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_modification_time").alias("modified"), "value")
    base = re.escape(os.path.realpath(root).rstrip("/"))
    rel = F.regexp_replace(F.regexp_replace(F.url_decode("p"), "^file:/*", "/"), f"^{base}/", "")
    return whole.select(rel.alias("file"), F.posexplode(F.split(F.regexp_replace("value", "\n\\z", ""), "\n", -1)).alias("pos", "line"), "modified").select("file", (F.col("pos") + 1).alias("pos"), "line", "modified")


def period_start(days: int, now: datetime.datetime | None = None) -> datetime.datetime:
    """C25."""
    return (now or datetime.datetime.now(datetime.UTC)) - datetime.timedelta(days=days)


def read_text(path: str) -> str | None:
    """UTF-8 with replacement; null if it cannot be read."""
    try:
        return Path(path).read_bytes().decode("utf-8", "replace")
    except OSError:
        return None


#: Why a file could not be read.
READ_FAULTS = ((PermissionError, "permission-denied"), (FileNotFoundError, "not-found"))


def read_fault(error: OSError) -> str:
    """J9."""
    return next((name for kind, name in READ_FAULTS if isinstance(error, kind)), "io-error")


def unreadable(paths: list[str]) -> list[tuple[str, str]]:
    """Paths that cannot be read, each with its fault."""
    found = []
    for path in paths:
        try:
            with open(path, "rb"):
                pass
        except OSError as error:
            found.append((path, read_fault(error)))
    return found


def read_tree(spark: SparkSession, root: str, suffixes: tuple[str, ...] = (".md", ".py", ".sh", ".txt")) -> DataFrame:
    """Files of a tree as ``path, content``; bytes that are no UTF-8 are replaced, skipped directories stay out."""
    files = [str(p) for p in sorted(Path(root).rglob("*")) if p.is_file() and not p.is_symlink() and p.suffix in suffixes and not SKIPPED_DIRS & set(p.relative_to(root).parts[:-1])]
    if not files:
        return spark.createDataFrame([], "path string, content string, raw binary")
    base = re.escape(os.path.realpath(root).rstrip("/"))
    rows = spark.read.format("binaryFile").load(files)
    return rows.select(F.regexp_replace(F.regexp_replace(F.url_decode("path"), "^file:/*", "/"), f"^{base}/", "").alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"), F.col("content").alias("raw"))


def collect_targets(root: str, memory_dir: str | None = None, global_dir: str | None = None) -> tuple[list[dict], list[str]]:
    """Instruction files, rules, memories and global files that can be read; and what is missing."""
    found, skipped = [], []

    def add(path: str, kind: str, category: str, base: str) -> None:
        content = read_text(path)
        if content is None:
            skipped.append(path)
        else:
            found.append({"path": path, "rel": os.path.relpath(path, base), "kind": kind, "category": category, "content": content})

    for name, kind in INSTRUCTION_FILES.items():
        add(os.path.join(root, name), kind, "instruction", root)
    for where, kind, category in ((os.path.join(root, ".claude", "rules"), "rules", "instruction"), (memory_dir, "memory", "memory"), (global_dir, "global_rules", "instruction")):
        if where and os.path.isdir(where):
            for name in sorted(n for n in os.listdir(where) if n.endswith(".md")):
                add(os.path.join(where, name), kind, category, where if category == "memory" else root)
    return found, skipped


def memory_dir_of(store: str, cwd: str) -> str | None:
    """The memory directory of a working directory, exactly two levels inside its store."""
    slug = re.sub("[^A-Za-z0-9]", "-", cwd)
    try:
        found = resolve_within(store, os.path.join(slug, "memory"))
    except Refused:
        return None
    return found if len(os.path.relpath(found, os.path.realpath(store)).split(os.sep)) == 2 and os.path.isdir(found) else None


def skill_files(root: str) -> list[str]:
    """Entry documents of the first layout that has any; symbolic links and dot directories stay out,
    a document below another skill's is left to that one."""
    for layout in ("skills/*/SKILL.md", "*/SKILL.md", "SKILL.md", "**/SKILL.md"):
        found = [p for p in sorted(Path(root).glob(layout)) if p.is_file() and not any(x.is_symlink() for x in (p, *list(p.parents)[: len(p.relative_to(root).parts) - 1])) and not any(part.startswith(".") for part in p.relative_to(root).parts)]
        homes = [p.parent for p in found]
        found = [p for p in found if not any(h in p.parent.parents for h in homes)]
        if found:
            return [str(p) for p in found]
    return []


def skill_descriptions(spark: SparkSession, root: str) -> DataFrame:
    """``name, description`` of each skill; two skills of one bare name are an error."""
    files = skill_files(root)
    rows = [(Path(f).parent.name, read_text(f) or "") for f in files]
    names = [n for n, _ in rows]
    if len(set(names)) < len(names):
        raise Refused("a skill name stands twice: " + ", ".join(sorted({n for n in names if names.count(n) > 1})))
    return spark.createDataFrame(rows, "name string, content string").select("name", description_of(F.col("content")).alias("description"))


def load_json_object(path: str, defaults: dict | None = None, strict: bool = False) -> dict:
    """A JSON object with defaults; unreadable is empty, or an error where ``strict``."""
    try:
        found = json.loads(Path(path).read_text(encoding="utf-8"))
        if not isinstance(found, dict):
            raise ValueError("no object")
    except FileNotFoundError:
        found = {}
    except (OSError, ValueError) as error:
        if strict:
            raise Refused(f"{path}: {error}") from error
        found = {}
    return {**(defaults or {}), **found}


def check_backends(registry: dict) -> list[str]:
    """Faults of a registry ``name -> {argv: [..]}``: shape, empty commands, unknown placeholders."""
    faults = []
    for name, entry in sorted(registry.items()):
        argv = entry.get("argv") if isinstance(entry, dict) else None
        if not isinstance(argv, list) or not argv or not all(isinstance(a, str) for a in argv):
            faults.append(f"{name}: argv must be a list of strings")
            continue
        strange = {p for a in argv for p in re.findall(r"\{([^{}]*)\}", a)} - {"prompt_file", "output_file", "cwd"}
        faults += [f"{name}: unknown placeholder {p}" for p in sorted(strange)]
    return faults


def resolve_argv(argv: list[str], values: dict[str, str]) -> list[str]:
    """Placeholders filled; one without a value is an error."""

    def fill(m: re.Match) -> str:
        if m.group(1) not in values:
            raise Refused(f"no value for {m.group(1)}")
        return values[m.group(1)]

    return [re.sub(r"\{([^{}]*)\}", fill, a) for a in argv]


def substitute_shas(text: str, baseline: str, commits: list[str]) -> str:
    """Placeholders of commits filled; a misspelt one is an error."""

    def fill(m: re.Match) -> str:
        inner = re.fullmatch(r"\{\{fixture:sha:(?:baseline|commits\[(\d+)\])\}\}", m.group())
        if not inner or inner.group(1) and int(inner.group(1)) >= len(commits):
            raise Refused(f"unknown placeholder {m.group()}")
        return commits[int(inner.group(1))] if inner.group(1) else baseline

    return re.sub(r"\{\{fixture:sha:[^}]*\}\}", fill, text)
