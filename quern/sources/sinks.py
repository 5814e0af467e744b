"""Writing reports and harvests (A44-A50): small results, written on the driver under guards."""

from __future__ import annotations

import json
import os
import subprocess
import tempfile

from pyspark.sql import DataFrame

from quern.sources.files import Refused, resolve_within


def write_json(path: str, value) -> None:
    """Sorted keys, through a temporary file that replaces the target at once."""
    where = os.path.dirname(os.path.abspath(path))
    os.makedirs(where, exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=where, suffix=".part")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as out:
            json.dump(value, out, ensure_ascii=False, indent=2, sort_keys=True)
            out.write("\n")
        os.replace(temporary, path)
    except BaseException:
        os.unlink(temporary)
        raise


def new_output(path: str, allowed: str) -> str:
    """A file that does not exist yet, in an allowed directory."""
    real = resolve_within(allowed, path)
    if os.path.lexists(os.path.join(allowed, path)):
        raise Refused(f"{path} exists")
    if not os.path.isdir(os.path.dirname(real)):
        raise Refused(f"no directory for {path}")
    return real


def is_git_ignored(path: str) -> bool:
    """Only a clear yes counts; any failure is a no."""
    try:
        return subprocess.run(["git", "check-ignore", "-q", path], cwd=os.path.dirname(os.path.abspath(path)), capture_output=True, timeout=10).returncode == 0
    except (OSError, subprocess.SubprocessError):
        return False


def write_records(rows: DataFrame, path: str, allowed: str) -> int:
    """One JSON object a line, streamed by partition into a new private file; returns the count."""
    real, n = new_output(path, allowed), 0
    handle = os.open(real, os.O_WRONLY | os.O_CREAT | os.O_EXCL | getattr(os, "O_NOFOLLOW", 0), 0o600)
    with os.fdopen(handle, "w", encoding="utf-8") as out:
        for text in rows.toJSON().toLocalIterator():
            out.write(text + "\n")
            n += 1
    return n


def render_markdown(findings: list[dict]) -> str:
    """Findings in their order, a section per rule."""
    lines = [f"# Findings ({len(findings)})"]
    rule = None
    for f in findings:
        if f["rule"] != rule:
            rule = f["rule"]
            lines += ["", f"## {rule}"]
        lines.append(f"- **{f['severity']}** {f['place']}: {f['what']} ({f['action']})")
    return "\n".join(lines) + "\n"


def apply_texts(fixed: DataFrame, root: str) -> int:
    """corrected texts written in place, each inside ``root``."""
    n = 0
    for row in fixed.toLocalIterator():
        with open(resolve_within(root, row["rel"]), "w", encoding="utf-8", newline="") as out:
            out.write(row["fixed"])
        n += 1
    return n
