"""Markdown files to titles, metadata, links and sections: a line scanner, run over Arrow batches.

Front matter is YAML between two ``---`` lines, the first of them line 1. Headings are ATX and Setext
headings outside of fences, quotes, lists and indented code. A section is a heading and the source text up to
the next one; its path is the open headings under the title.
"""

from __future__ import annotations

import datetime
import json
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.functions.ids import estimate_py, normalize_py

_ATX = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_SETEXT = re.compile(r"^ {0,3}(=+|-+)[ \t]*$")
_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})(.*)$")
_LIST = re.compile(r"^ {0,3}(?:[-+*]|\d{1,9}[.)])(?:[ \t]+|$)")
_LINK = re.compile(r"!?\[(?:[^\[\]]|\[[^\]]*\])*\]\(\s*<?([^\s<>()]*(?:\([^\s()]*\)[^\s<>()]*)*)>?(?:\s+(?:\"[^\"]*\"|'[^']*'))?\s*\)|<((?:https?|mailto|ftp):[^\s<>]+)>")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"'”’)\]]*\s+")


@dataclass
class Parsed:
    title: str = ""
    metadata: dict = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)
    links: list[str] = field(default_factory=list)
    #: (heading path, text)
    sections: list[tuple[list[str], str]] = field(default_factory=list)


def front_matter(text: str) -> tuple[dict, str, list[str]]:
    """(mapping, body, warnings). Without a closing line there is no front matter; YAML that is no mapping counts as empty."""
    lines = text.split("\n")
    if lines[0].rstrip() != "---":
        return {}, text, []
    end = next((i for i, x in enumerate(lines[1:], 1) if x.rstrip() == "---"), None)
    if end is None:
        return {}, text, []
    body = "\n".join(lines[end + 1 :])
    import yaml

    try:
        found = yaml.safe_load("\n".join(lines[1:end]))
    except yaml.YAMLError:
        return {}, body, ["front matter is not valid YAML"]
    if found is None:
        return {}, body, []
    return (found, body, []) if isinstance(found, dict) else ({}, body, ["front matter is not a mapping"])


def _plain(x):
    if isinstance(x, (datetime.datetime, datetime.date)):
        return x.isoformat()
    if isinstance(x, dict):
        return {str(k): _plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple, set)):
        return [_plain(v) for v in x]
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return x
    return float(x) if isinstance(x, (int, float)) else str(x)


def lift(found: dict) -> dict:
    """title, tags, aliases and the rest: lists from scalars, trimmed, without repeats whatever their case."""
    out = {"title": None, "tags": [], "aliases": [], "additional": {}}
    lists = {"tags": "tags", "tag": "tags", "aliases": "aliases", "alias": "aliases"}
    for key, value in sorted(found.items(), key=lambda kv: str(kv[0]).lower() not in ("tags", "aliases")):
        name = str(key).lower()
        if name == "title" and isinstance(value, (str, int, float)):
            out["title"] = str(value).strip() or None
        elif name in lists:
            seen = {x.lower() for x in out[lists[name]]}
            for x in value if isinstance(value, list) else [value]:
                x = "" if x is None else str(x).strip()
                if x and x.lower() not in seen:
                    seen.add(x.lower())
                    out[lists[name]].append(x)
        else:
            out["additional"][str(key)] = _plain(value)
    return out


def plain_heading(text: str) -> str:
    text = re.sub(r"!?\[([^\]]*)\]\([^)]*\)", r"\1", text)
    text = re.sub(r"(`+)(.+?)\1", r"\2", text)
    return re.sub(r"(\*\*|__|\*|~~|(?<!\w)_|_(?!\w))", "", text).strip()


def headings(body: str) -> list[tuple[int, int, int, str]]:
    """(first line, line after, level, text) of the top-level headings."""
    out, lines = [], body.split("\n")
    fence, inside, paragraph = None, False, None
    for i, line in enumerate(lines):
        if fence:
            m = _FENCE.match(line)
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not m[2].strip():
                fence = None
            continue
        m = _FENCE.match(line)
        if m and not (m[1][0] == "`" and "`" in m[2]):
            fence, paragraph = m[1], None
            continue
        blank = not line.strip()
        indented = line.startswith(("    ", "\t"))
        if blank:
            paragraph = None
            continue
        if _LIST.match(line) or re.match(r"^ {0,3}>", line):
            inside, paragraph = True, None
            continue
        if inside and (indented or line.startswith("  ")):
            continue
        m = _ATX.match(line)
        if m:
            inside = False
            out.append((i, i + 1, len(m[1]), plain_heading(m[2] or "")))
            paragraph = None
            continue
        m = _SETEXT.match(line)
        if m and paragraph is not None and not inside:
            out.append((paragraph, i + 1, 1 if m[1][0] == "=" else 2, plain_heading(" ".join(x.strip() for x in lines[paragraph:i]))))
            paragraph = None
            continue
        if inside and (i == 0 or lines[i - 1].strip()):
            continue  # a lazy line of the quote or list
        inside = False
        if paragraph is None and not indented:
            paragraph = i
    return out


def links(body: str) -> list[str]:
    kept, fence = [], None
    for line in body.split("\n"):
        m = _FENCE.match(line)
        if m and (fence is None or m[1].startswith(fence)):
            fence = m[1] if fence is None else None
            continue
        if fence is None:
            kept.append(re.sub(r"(`+)(.+?)\1", "", line))
    return [m[1] or m[2] for m in _LINK.finditer("\n".join(kept)) if m[1] or m[2]]


def parse(text: str, stem: str = "") -> Parsed:
    found, body, warnings = front_matter(text.replace("\r\n", "\n"))
    metadata = lift(found)
    heads = headings(body)
    title = metadata["title"] or next((t for _, _, level, t in heads if level == 1 and t), None) or stem
    out = Parsed(title, metadata, warnings, links(body))
    lines = body.split("\n")
    first = "\n".join(lines[: heads[0][0]] if heads else lines).strip()
    root = [title] if title else []
    if first:
        out.sections.append((root, first))
    stack: list[tuple[int, str]] = []
    for k, (_, after, level, name) in enumerate(heads):
        stop = heads[k + 1][0] if k + 1 < len(heads) else len(lines)
        while stack and stack[-1][0] >= level:
            stack.pop()
        stack.append((level, name))
        path = [n for _, n in stack if n]
        if path and stack[0][0] == 1 and normalize_py(path[0]) == normalize_py(title):
            path = path[1:]
        content = "\n".join(lines[after:stop]).strip()
        if content or not (k + 1 < len(heads) and heads[k + 1][2] > level):
            out.sections.append((root + path, content))
    return out


def units(text: str) -> list[tuple[str, bool]]:
    """(text, is a fence) of the paragraphs, fences whole; one that never closes is one too."""
    out, now, fence = [], [], None

    def close(is_fence: bool) -> None:
        if now:
            out.append(("\n".join(now).strip("\n"), is_fence))
            now.clear()

    for line in text.split("\n"):
        m = _FENCE.match(line)
        if fence:
            now.append(line)
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not m[2].strip():
                close(True)
                fence = None
        elif m:
            close(False)
            fence = m[1]
            now.append(line)
        elif line.strip():
            now.append(line)
        else:
            close(False)
    close(fence is not None)
    return out


def words_of(text: str, most: int) -> list[str]:
    w, n = text.split(), max(1, int(most / 1.3))
    return [" ".join(w[i : i + n]) for i in range(0, len(w), n)]


def _packed(parts: list[str], most: int, glue: str) -> list[str]:
    out, now, used = [], [], 0
    for p in parts:
        n = estimate_py(p)
        if now and used + n > most:
            out.append(glue.join(now))
            now, used = [], 0
        now.append(p)
        used += n
    return out + ([glue.join(now)] if now else [])


def sentences(text: str, most: int) -> list[str]:
    """Sentences packed to most tokens; one that is longer is cut into words."""
    out: list[str] = []
    run: list[str] = []
    for s in _SENTENCE.split(text.strip()):
        if estimate_py(s) > most:
            out += _packed(run, most, " ") + words_of(s, most)
            run = []
        elif s:
            run.append(s)
    return out + _packed(run, most, " ")


def split(text: str, most: int) -> list[str]:
    """A section's text in pieces of most tokens; a fence that is longer stays whole."""
    if estimate_py(text) <= most:
        return [text]
    out: list[str] = []
    run: list[str] = []
    for unit, is_fence in units(text):
        if estimate_py(unit) <= most:
            run.append(unit)
            continue
        out += _packed(run, most, "\n\n") + ([unit] if is_fence else sentences(unit, most))
        run = []
    return out + _packed(run, most, "\n\n")


def merge(sections: list[tuple[list[str], str]], least: int, most: int) -> list[tuple[list[str], str]]:
    """Each section that follows one of fewer than ``least`` tokens joins it under its own heading, if both fit."""
    out: list[tuple[list[str], str]] = []
    for path, text in sections:
        if out and estimate_py(out[-1][1]) < least and estimate_py(out[-1][1]) + estimate_py(text) <= most:
            head = f"## {path[-1]}\n\n" if path else ""
            out[-1] = (out[-1][0], f"{out[-1][1]}\n\n{head}{text}")
        else:
            out.append((path, text))
    return out


def chunked(parsed: Parsed, least: int, most: int) -> list[tuple[list[str], str]]:
    """(heading path, content) of a document's chunks."""
    return [(path, piece) for path, text in merge(parsed.sections, least, most) for piece in (split(text, most) if text else [""])]


SCHEMA = "path string, document_id string, title string, front_title string, tags array<string>, aliases array<string>, additional string, links array<string>, warnings array<string>, chunks array<struct<heading_path:array<string>,content:string>>"


def parsed(files: DataFrame, least: int, most: int) -> DataFrame:
    """files (path, document_id, text) parsed and cut into chunks, by document."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            rows = []
            for path, doc, text in zip(*(batch.column(c).to_pylist() for c in ("path", "document_id", "text"))):
                p = parse(text or "", path.rsplit("/", 1)[-1].rsplit(".", 1)[0])
                m = p.metadata
                rows.append({"path": path, "document_id": doc, "title": p.title, "front_title": m["title"], "tags": m["tags"], "aliases": m["aliases"], "additional": json.dumps(m["additional"], sort_keys=True), "links": p.links, "warnings": p.warnings, "chunks": [{"heading_path": h, "content": c} for h, c in chunked(p, least, most)]})
            strings = pa.list_(pa.string())
            kinds = [("path", pa.string()), ("document_id", pa.string()), ("title", pa.string()), ("front_title", pa.string()), ("tags", strings), ("aliases", strings), ("additional", pa.string()), ("links", strings), ("warnings", strings), ("chunks", pa.list_(pa.struct([("heading_path", strings), ("content", pa.string())])))]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(kinds))

    return files.select("path", "document_id", F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
