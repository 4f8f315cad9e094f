"""Ignore files: lines of git's wildcard patterns, the last that matches decides."""

from __future__ import annotations

import re


def _segment(text: str) -> str:
    out, k = "", 0
    while k < len(text):
        c = text[k]
        if c == "*":
            out += "[^/]*"
            while k + 1 < len(text) and text[k + 1] == "*":
                k += 1
        elif c == "?":
            out += "[^/]"
        elif c == "[" and (end := text.find("]", k + 2 if text[k + 1 : k + 2] in ("!", "]") else k + 1)) > 0:
            body = text[k + 1 : end]
            out += "[" + ("^" + body[1:] if body[:1] in ("!", "^") else body).replace("\\", "\\\\") + "]"
            k = end
        elif c == "\\" and k + 1 < len(text):
            k += 1
            out += re.escape(text[k])
        else:
            out += re.escape(c)
        k += 1
    return out


def compiled(line: str) -> tuple[bool, re.Pattern] | None:
    """(ignores, pattern on a path relative to the root) of a line; None if the line says nothing."""
    line = line.rstrip("\n")
    while line.endswith(" ") and not line.endswith("\\ "):
        line = line[:-1]
    if not line or line.startswith("#"):
        return None
    ignores = not line.startswith("!")
    line = line[1:] if not ignores else line
    if line.startswith(("\\#", "\\!")):
        line = line[1:]
    if line in ("", "/"):
        return None
    only_dirs = line.endswith("/")
    parts = line.strip("/").split("/") if line.strip("/") else []
    if not parts:
        return None
    anchored = line.startswith("/") or len(parts) > 1
    out = "" if anchored else "(?:.*/)?"
    for k, part in enumerate(parts):
        last = k == len(parts) - 1
        if part == "**":
            out += ".+" if last else "(?:.*/)?"
        else:
            out += _segment(part) + ("" if last else "/")
    # a directory's pattern covers what is below it; a file's may be a directory's
    tail = "" if parts[-1] == "**" else "/.*" if only_dirs else "(?:/.*)?"
    return ignores, re.compile(out + tail + r"\Z", re.S)


class Ignore:
    """The rules of one ignore file."""

    def __init__(self, text: str = "") -> None:
        self.rules = [r for line in text.splitlines() if (r := compiled(line))]

    def __call__(self, rel: str) -> bool:
        verdict = False
        for ignores, pattern in self.rules:
            if pattern.match(rel):
                verdict = ignores
        return verdict
