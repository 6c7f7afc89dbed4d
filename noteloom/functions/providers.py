"""Model providers and their deterministic doubles.

A provider is an object with some of: embed(texts), extract(text), adjudicate(name, kind, candidates), generate(prompt).
Errors are Transient (try again later) or Permanent.
"""

from __future__ import annotations

import hashlib
import json
import urllib.error
import urllib.request
from collections.abc import Iterator

import numpy as np


#: The kinds that an extraction may name, which are also those of the graph.
ENTITY_TYPES = ("Person", "Project", "Technology", "Concept", "Document", "Component")
RELATION_TYPES = ("uses", "part-of", "depends-on", "related-to", "authored-by", "contradicts")


class Transient(Exception):
    pass


class Permanent(Exception):
    pass


def classify(status: int | None, missing_model: bool = False) -> type[Exception]:
    """No answer, a server's fault or a model that isn't there yet: transient; other faults stay."""
    return Transient if status is None or status >= 500 or missing_model else Permanent


class HashEmbedder:
    """Vectors from SHA-256: the same text, the same vector; no meaning."""

    name = "deterministic"

    def __init__(self, dimensions: int = 768):
        self.dimensions = dimensions

    def one(self, text: str) -> list[float]:
        raw, counter = b"", 0
        while len(raw) < 4 * self.dimensions:
            raw += hashlib.sha256(f"{counter}\x1f{text}".encode()).digest()
            counter += 1
        x = (np.frombuffer(raw[: 4 * self.dimensions], ">u4").astype(np.float64) / 4294967295.0 * 2 - 1).astype(np.float32)
        norm = np.float32(0)
        for v in x:  # summed in order, in single precision
            norm = np.float32(norm + v * v)
        norm = np.sqrt(norm)
        return [float(v) for v in (x / norm if norm > 0 else x)]

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [self.one(t) for t in texts]


class FixtureExtractor:
    """What texts that hold a key are said to hold: the first key that is in the text."""

    name = "fixture"

    def __init__(self, fixtures: dict[str, dict] | None = None):
        self.fixtures = fixtures or {}

    def extract(self, text: str) -> dict:
        return next((found for key, found in self.fixtures.items() if key in text), {"entities": [], "relations": []})


class FixtureAdjudicator:
    """Says for given names which candidate is meant; no other name is one of its candidates."""

    name = "fixture"

    def __init__(self, same: dict[str, str] | None = None):
        self.same = same or {}

    def adjudicate(self, name: str, kind: str, candidates: list[str]) -> str | None:
        meant = self.same.get(name)
        return meant if meant in candidates else None


class FixedGenerator:
    name = "fixed"

    def __init__(self, answer: str = "An answer from the excerpts."):
        self.answer = answer

    def generate(self, prompt: str) -> Iterator[str]:
        for k, word in enumerate(self.answer.split(" ")):
            yield word if k == 0 else " " + word


def collect(tokens: Iterator[str]) -> str:
    return "".join(tokens).strip()


def object_schema(properties: dict, required: list[str] | None = None) -> dict:
    return {"type": "object", "properties": properties, "required": [*properties] if required is None else required}


def array_schema(items: dict) -> dict:
    return {"type": "array", "items": items}


def string_schema(options: list[str] | None = None) -> dict:
    return {"type": "string"} | ({"enum": options} if options else {})


def extraction_schema(entity_types: list[str], relation_types: list[str]) -> dict:
    entity = object_schema({"name": string_schema(), "type": string_schema([*entity_types])})
    relation = object_schema({"source": string_schema(), "type": string_schema([*relation_types]), "target": string_schema(), "confidence": {"type": "number"}})
    return object_schema({"entities": array_schema(entity), "relations": array_schema(relation)})


class HttpModel:
    """A model server with /api/embed, /api/generate and /api/tags. Off unless it is given."""

    def __init__(self, base: str, model: str, timeout: float = 120.0, schema: dict | None = None):
        self.base, self.name, self.timeout, self.schema = base.rstrip("/"), model, timeout, schema

    def _open(self, path: str, body: dict | None = None):
        data = None if body is None else json.dumps(body).encode()
        request = urllib.request.Request(self.base + path, data, {"Content-Type": "application/json"})
        try:
            return urllib.request.urlopen(request, timeout=self.timeout)
        except urllib.error.HTTPError as e:
            raise classify(e.code, e.code == 404)(f"{path}: {e.code}") from e
        except OSError as e:
            raise Transient(f"{path}: {e}") from e

    def embed(self, texts: list[str]) -> list[list[float]]:
        with self._open("/api/embed", {"model": self.name, "input": texts}) as r:
            found = json.load(r).get("embeddings")
        if not isinstance(found, list) or len(found) != len(texts):
            raise Permanent("the number of embeddings is not that of the texts")
        return found

    def _asked(self, prompt: str, schema: dict) -> dict:
        with self._open("/api/generate", {"model": self.name, "prompt": prompt, "format": schema, "stream": False}) as r:
            try:
                found = json.loads(json.load(r)["response"])
            except (KeyError, TypeError, ValueError) as e:
                raise Permanent("malformed response") from e
        if not isinstance(found, dict):
            raise Permanent("malformed response")
        return found

    def extract(self, text: str) -> dict:
        return self._asked(text, self.schema or extraction_schema(ENTITY_TYPES, RELATION_TYPES))

    def adjudicate(self, name: str, kind: str, candidates: list[str]) -> str | None:
        """Which of the candidates the name means, if any."""
        listed = "\n".join(f"- {c}" for c in candidates)
        found = self._asked(f"Is the {kind} {name!r} one of these?\n{listed}\nAnswer with the one that it is, or with none.", object_schema({"same": string_schema([*candidates, "none"])}))
        return found.get("same") if found.get("same") in candidates else None

    def generate(self, prompt: str, temperature: float = 0.2) -> Iterator[str]:
        with self._open("/api/generate", {"model": self.name, "prompt": prompt, "stream": True, "options": {"temperature": temperature}}) as r:
            for line in r:
                if line.strip():
                    yield json.loads(line).get("response", "")

    def health(self) -> dict:
        """Whether the server answers, and whether it has the model; a name without a tag means its latest."""
        try:
            with self._open("/api/tags") as r:
                names = {m["name"] for m in json.load(r).get("models", [])}
        except (Transient, Permanent) as e:
            return {"reachable": False, "missing": [self.name], "reason": str(e)}
        full = self.name if ":" in self.name else f"{self.name}:latest"
        return {"reachable": True, "missing": [] if full in names or self.name in names else [self.name], "reason": None}


def embedded(texts, embedder, column: str = "text", batch: int = 16, dimensions: int | None = None):
    """texts with ``embedding`` and ``error``: one call for each batch of rows; a batch that fails is asked row by row, so that one bad text fails alone."""
    from pyspark.sql.types import ArrayType, FloatType, StringType, StructField, StructType

    schema = StructType([*texts.schema.fields, StructField("embedding", ArrayType(FloatType())), StructField("error", StringType())])

    def ask(part):
        try:
            found = embedder.embed(part)
            if len(found) != len(part) or dimensions and any(len(v) != dimensions for v in found):
                raise Permanent("the embeddings are not of the number or dimension that was asked for")
            return [(v, None) for v in found]
        except (Transient, Permanent) as e:
            if len(part) == 1:
                return [(None, f"{'transient' if isinstance(e, Transient) else 'permanent'}: {e}")]
            return [x for t in part for x in ask([t])]

    def run(frames):
        for frame in frames:
            values = frame[column].tolist()
            found = [x for i in range(0, len(values), batch) for x in ask(values[i : i + batch])]
            yield frame.assign(embedding=[v for v, _ in found], error=[e for _, e in found])

    return texts.mapInPandas(run, schema)
