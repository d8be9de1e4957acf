"""Strict parsers of markup bodies and patches, applied to columns in Arrow batches.

A body or a patch that doesn't fit gives a status and no partial result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame, types as T

#: The tags of neutral bodies; those that stand alone, and those that end a line.
BODY_TAGS = frozenset("p div br ul ol li strong em b i code pre blockquote".split())
BODY_VOID, BODY_BLOCKS = frozenset({"br"}), frozenset("p div br ul ol li pre blockquote".split())
_TOKEN = re.compile(r"<(/?)([a-z]+)(/?)>|&(?:amp|lt|gt|quot|apos|nbsp|#\d{1,7}|#x[0-9a-f]{1,6});|[^<&>]+")
MOST_BODY_BYTES = 64 << 10


def body_text(raw: str | None, form: str) -> tuple[str | None, str]:
    """(text, status) of a plain or neutral HTML body; status is ok, null, format, limit, input or markup.

    Tags have no attributes and must be balanced; blocks start new lines; references are decoded once.
    """
    if raw is None:
        return None, "null"
    if form not in ("plain", "html"):
        return None, "format"
    if len(raw.encode()) > MOST_BODY_BYTES:
        return None, "limit"
    if "\0" in raw:
        return None, "input"
    if form == "plain":
        return raw, "ok"
    open_tags, out, at = [], [], 0
    for token in _TOKEN.finditer(raw):
        if token.start() != at:
            return None, "markup"
        at = token.end()
        close, tag, alone = token.group(1), token.group(2), token.group(3)
        if tag is None:
            out.append(unescape(token.group(0)))
            continue
        if tag not in BODY_TAGS or (alone or close) and (tag in BODY_VOID) == bool(close) or alone and tag not in BODY_VOID:
            return None, "markup"
        if tag in BODY_BLOCKS:
            out.append("\n")
        if close:
            if not open_tags or open_tags.pop() != tag:
                return None, "markup"
        elif tag not in BODY_VOID:
            open_tags.append(tag)
    if at != len(raw) or open_tags:
        return None, "markup"
    lines = (" ".join(line.split()) for line in "".join(out).split("\n"))
    return "\n".join(line for line in lines if line), "ok"


_OLD = re.compile(r"^--- (?:a/(.+?)|/dev/null)\t?$", re.M)
_HEADER = re.compile(r"a/(\S+) b/(\S+)$")
_RENAMED = re.compile(r"^rename from (.+)$", re.M)


def _canonical(path: str) -> bool:
    return bool(path) and not path.startswith(("/", '"')) and not any(p in ("", ".", "..") for p in path.split("/"))


def patch_paths(patch: str | None, most_bytes: int = 1 << 20) -> dict:
    """Old paths of a patch's blocks, sorted; counts of blocks, new files, unsupported and repeated ones; and why it failed.

    Only a block's header lines count: what follows its first @@ is the body, whatever it looks like.
    """
    out = {"paths": [], "blocks": 0, "new_files": 0, "unsupported": 0, "repeated": 0, "failure": ""}
    if patch is None or not patch.strip():
        return out | {"failure": "blank"}
    if len(patch.encode()) > most_bytes:
        return out | {"failure": "oversized"}
    starts: list[int] = []
    inside = 0  # lines of a hunk that are still to come
    at = 0
    for line in patch.split("\n"):
        hunk = re.match(r"@@ -\d+(?:,(\d+))? \+\d+(?:,(\d+))? @@", line)
        if inside > 0 and line[:1] in (" ", "-", "+", "\\"):
            inside -= 2 if line[:1] == " " else line[:1] != "\\"
        elif hunk:
            inside = sum(int(n) if n is not None else 1 for n in hunk.groups())
        elif line.startswith("diff --git "):
            starts.append(at)
            inside = 0
        at += len(line) + 1
    if not starts:
        return out | {"failure": "none"}
    if patch[: starts[0]].strip():
        return out | {"failure": "preamble"}
    seen: list[str] = []
    for start, end in zip(starts, [*starts[1:], len(patch)]):
        block = patch[start:end]
        head = block.split("\n@@", 1)[0]
        out["blocks"] += 1
        renamed, old, first = _RENAMED.search(head), _OLD.search(head), _HEADER.search(head.split("\n", 1)[0])
        if "\nnew file mode " in head or old and old.group(1) is None:
            out["new_files"] += 1
            continue
        path = renamed.group(1) if renamed else old.group(1) if old else first.group(1) if first else ""
        if _canonical(path):
            seen.append(path)
        else:
            out["unsupported"] += 1
    out["paths"] = sorted(set(seen))
    out["repeated"] = len(seen) - len(out["paths"])
    return out


def with_body_text(rows: DataFrame, keep: list[str], raw: Column, form: Column) -> DataFrame:
    given = rows.select(*keep, raw.alias("__raw"), form.alias("__form"))
    out = given.drop("__raw", "__form").schema.add("body", T.StringType()).add("status", T.StringType())

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [body_text(r, f) for r, f in zip(part.pop("__raw"), part.pop("__form"))]
            yield part.assign(body=[t for t, _ in found], status=[s for _, s in found])

    return given.mapInPandas(parse, out)


def with_patch_paths(rows: DataFrame, keep: list[str], patch: Column) -> DataFrame:
    given = rows.select(*keep, patch.alias("__patch"))
    out = given.drop("__patch").schema.add("paths", T.ArrayType(T.StringType()))
    for name in ("blocks", "new_files", "unsupported", "repeated"):
        out = out.add(name, T.IntegerType())
    out = out.add("failure", T.StringType())

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [patch_paths(p) for p in part.pop("__patch")]
            yield part.assign(**{n: [f[n] for f in found] for n in out.names if n not in part.columns})

    return given.mapInPandas(parse, out)
