"""Markdown mirrors of scenes and personas: small local artifacts, written where the operator runs (not on executors)."""

from __future__ import annotations

import hashlib
import os
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass
from pathlib import Path


def slug(readable: str, identity: str) -> str:
    return re.sub("[^A-Za-z0-9_-]", "-", readable) + "-" + hashlib.sha256(identity.encode()).hexdigest()[:10]


def directory(root: str | os.PathLike, space: str, kind: str) -> Path:
    return Path(root) / "spaces" / slug(space, space) / kind


def scene_text(title: str, body: str) -> str:
    return f"# {title}\n\n{body}\n"


def write(path: Path, text: str) -> Path:
    """By a rename, so that a reader sees the old text or the new one."""
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(f".{path.name}.{os.getpid()}")
    part.write_text(text, encoding="utf-8")
    os.replace(part, path)
    return path


def remove(path: Path) -> None:
    path.unlink(missing_ok=True)


@dataclass(frozen=True)
class Move:
    source: Path
    target: Path
    verdict: str  # ready, migrated (the same text is there), collision


def plan(old: Path, new: Path) -> list[Move]:
    """For every Markdown file of a folder, by name."""
    moves = []
    for source in sorted(old.glob("*.md")) if old.is_dir() else []:
        target = new / source.name
        verdict = "ready" if not target.exists() else "migrated" if target.read_bytes() == source.read_bytes() else "collision"
        moves.append(Move(source, target, verdict))
    return moves


def counts(moves: Iterable[Move]) -> dict[str, int]:
    return dict(Counter(m.verdict for m in moves))


def apply(moves: Iterable[Move]) -> int:
    """Copies what is ready without ever writing over a file; the number of collisions."""
    clashes = 0
    for m in moves:
        if m.verdict == "ready":
            m.target.parent.mkdir(parents=True, exist_ok=True)
            part = m.target.with_name(f".{m.target.name}.{os.getpid()}")
            part.write_bytes(m.source.read_bytes())
            try:
                os.link(part, m.target)
            except FileExistsError:
                clashes += m.target.read_bytes() != m.source.read_bytes()
            finally:
                part.unlink()
        clashes += m.verdict == "collision"
    return clashes
