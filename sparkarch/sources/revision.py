"""Commit and branch of a checked-out tree, read from its files without running anything."""

from __future__ import annotations

import os
import re


def _folder(root: str) -> str | None:
    path = os.path.join(root, ".git")
    if os.path.isfile(path):  # a work tree names its folder in a file
        with open(path) as f:
            found = re.match(r"gitdir: (.+)", f.read().strip())
        path = os.path.normpath(os.path.join(root, found[1])) if found else ""
    return path if os.path.isdir(path) else None


def _read(path: str) -> str | None:
    try:
        with open(path) as f:
            return f.read().strip()
    except OSError:
        return None


def branch(root: str) -> str | None:
    """Name of the current branch; None outside a repository or on a commit of its own."""
    folder = _folder(root)
    head = _read(os.path.join(folder, "HEAD")) if folder else None
    return head.removeprefix("ref: refs/heads/") if head and head.startswith("ref: refs/heads/") else None


def commit(root: str) -> str | None:
    """Hash of the current commit, from its own file or the packed ones; None if there is none yet."""
    folder = _folder(root)
    head = _read(os.path.join(folder, "HEAD")) if folder else None
    if not head:
        return None
    if not head.startswith("ref: "):
        return head
    name = head[5:]
    common = _read(os.path.join(folder, "commondir"))
    for base in filter(None, (folder, os.path.normpath(os.path.join(folder, common)) if common else None)):
        if found := _read(os.path.join(base, name)):
            return found
        for line in (_read(os.path.join(base, "packed-refs")) or "").splitlines():
            if line.endswith(f" {name}"):
                return line.split()[0]
    return None


def header(root: str, source: str, when: str) -> dict[str, str | None]:
    """What stands at the head of a report."""
    return {"root": root, "data_source": source, "branch": branch(root), "commit": commit(root), "generated_at": when}
