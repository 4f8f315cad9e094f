"""Who last touched a function, by git, as a table of lines; what git doesn't tell is left out.

One log tells every file's last commit, one incremental blame a file's lines.
"""

from __future__ import annotations

import subprocess
from functools import cached_property, lru_cache
from pathlib import Path
from typing import NamedTuple

#: Seconds that one call may take.
PATIENCE = 5

# Bytes that no name, date or subject holds.
_COMMIT, _FIELD = "\x1e", "\x1f"


class Commit(NamedTuple):
    last_author: str
    last_commit_date: str
    last_commit_message: str


class Span(NamedTuple):
    first: int
    last: int
    author: str


class History:
    """What git knows of the files below a folder."""

    def __init__(self, folder: str) -> None:
        self.folder = Path(folder)
        self.spans = lru_cache(maxsize=256)(self._spans)

    def _lines(self, *args: str) -> list[str]:
        """git's output; nothing if it fails or takes too long."""
        try:
            return subprocess.run(["git", "-c", "core.quotePath=false", *args], cwd=self.folder, capture_output=True, text=True, errors="replace", timeout=PATIENCE, check=True).stdout.split("\n")
        except (OSError, subprocess.SubprocessError):
            return []

    @cached_property
    def commits(self) -> dict[str, Commit]:
        """The latest commit of every file, by its path from the folder."""
        out: dict[str, Commit] = {}
        now = None
        for line in self._lines("log", "--relative", "--name-only", "--date=short", f"--format={_COMMIT}%an{_FIELD}%ad{_FIELD}%s"):
            if line.startswith(_COMMIT):
                now = Commit(*line[1:].split(_FIELD, 2))
            elif line and now:
                out.setdefault(line, now)
        return out

    def _spans(self, file: str) -> list[Span]:
        """Stretches of the file's lines with their author; each commit's author is told once."""
        authors: dict[str, str] = {}
        out, commit, first, n = [], "", 0, 0
        for line in self._lines("blame", "--incremental", "--", file):
            words = line.split(" ")
            if len(words) == 4 and len(words[0]) >= 40 and words[1].isdigit():
                commit, first, n = words[0], int(words[2]), int(words[3])
            elif line.startswith("author "):
                authors[commit] = line[len("author ") :]
            elif line.startswith("filename "):  # ends a stretch
                out.append(Span(first, first + n - 1, authors[commit]))
        return out

    def tell(self, file: str, start: int | None, end: int | None) -> dict | None:
        """last_author, last_commit_date, last_commit_message of the file, blame_authors of its lines."""
        path = Path(file)
        known = self.commits.get((path.relative_to(self.folder.resolve()) if path.is_absolute() and path.is_relative_to(self.folder.resolve()) else path).as_posix())
        if known is None:
            return None
        held = {s.author for s in self.spans(file) if start and s.first <= (end or start) and s.last >= start}
        return known._asdict() | ({"blame_authors": sorted(held)} if held else {})


def provenance(repo: str):
    """A function of file, first and last line that tells who touched them."""
    return History(repo).tell
