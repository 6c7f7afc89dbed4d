"""The engine as tools for agents: pure functions from arguments to text, behind a set of allowed names."""

from __future__ import annotations

from noteloom.engine import Engine

NAMES = ("search", "answer", "lookup", "traverse")
PRESETS = {"all": NAMES, "retrieval": ("search", "lookup", "traverse"), "none": ()}


def allowed(text: str) -> tuple[str, ...]:
    """A preset, or names between commas; anything else is an error."""
    text = text.strip().lower()
    if text in PRESETS:
        return PRESETS[text]
    names = tuple(dict.fromkeys(x.strip() for x in text.split(",") if x.strip()))
    if not names or set(names) - set(NAMES):
        raise ValueError(f"tools are {', '.join(NAMES)}, or one of {', '.join(PRESETS)}")
    return names


def call(engine: Engine, name: str, arguments: dict, tools: tuple[str, ...] = NAMES) -> str:
    if name not in tools:
        raise PermissionError(f"{name} is not offered")
    if name == "search":
        found = engine.search(arguments["query"], max(1, min(50, int(arguments.get("limit", 8)))), arguments.get("tags"))
        lines = [f"{i}. {r.citation} ({r.score:.4f})\n{' '.join(r.content.split())[:240]}" for i, r in enumerate(found.results.collect(), 1)]
        return "\n\n".join([*(lines or ["No results."]), *(f"Note: {d}" for d in found.degradations)])
    if name == "answer":
        got = engine.answer(arguments["question"])
        return "\n".join([got.text, *(f"[{i}] {c}" for i, c in enumerate(got.citations, 1))])
    if name == "lookup":
        rows = engine.lookup_entity(arguments["name"]).collect()
        return "\n".join(f"{r.canonical_name} ({r.type}), {r.mentions} mentions" + (f"; also {', '.join(r.aliases)}" if r.aliases else "") for r in rows) or "No such entity."
    near, around = engine.traverse(arguments["name"], max(1, min(2, int(arguments.get("hops", 1)))))
    lines = [f"{r.source} {r.type} {r.target} ({r.confidence:.2f})" for r in near.orderBy("source", "type", "target").limit(100).collect()]
    return "\n".join(lines + [f"- {r.heading}" for r in around.collect()]) or "Nothing around it."
