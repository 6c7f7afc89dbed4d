"""Content-derived identities and the two name keys, as Spark columns; ``py`` twins for code inside Arrow functions."""

from __future__ import annotations

import hashlib
import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Joins the parts of a digest.
UNIT = "\x1f"
#: Joins the headings of a path.
RECORD = "\x1e"


def _latin() -> tuple[str, str]:
    """Letters with marks and the letters without, for translate()."""
    ranges = (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))
    pairs = [(chr(c), "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x))) for c in ranges]
    pairs = [(a, b) for a, b in pairs if len(b) == 1 and a != b and a == a.lower()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_MARKED, _PLAIN = _latin()


def digest(*parts: Column | str) -> Column:
    """32 hex digits of the SHA-256 of the parts."""
    return F.substring(F.sha2(F.concat_ws(UNIT, *parts), 256), 1, 32)


def digest_py(*parts: str) -> str:
    return hashlib.sha256(UNIT.join(parts).encode()).hexdigest()[:32]


def document_id(path: Column | str) -> Column:
    return digest(F.lit("document"), path)


def canonical_path(headings: Column) -> Column:
    return F.array_join(F.transform(headings, normalize_name), RECORD)


def chunk_id(document: Column | str, headings: Column, occurrence: Column) -> Column:
    return digest(F.lit("chunk"), document, canonical_path(headings), occurrence.cast("string"))


def entity_id(kind: Column | str, name: Column) -> Column:
    return digest(F.lit("entity"), kind, normalize_name(name))


def relation_id(source: Column | str, kind: Column | str, target: Column | str, chunk: Column | str) -> Column:
    return digest(F.lit("relation"), source, kind, target, chunk)


def content_hash(text: Column) -> Column:
    """All of the SHA-256, line ends as one character."""
    return F.sha2(F.replace(text, F.lit("\r\n"), F.lit("\n")), 256)


def content_hash_py(text: str) -> str:
    return hashlib.sha256(text.replace("\r\n", "\n").encode()).hexdigest()


def fold(text: Column) -> Column:
    """Lower case, Latin letters without their marks."""
    return F.translate(F.lower(text), _MARKED, _PLAIN)


_FOLDED = str.maketrans(_MARKED, _PLAIN)


def fold_py(text: str) -> str:
    return text.lower().translate(_FOLDED)


def normalize_name(name: Column) -> Column:
    """The key that ids are made of: folded; hyphens, slashes and underscores are spaces; no other signs; single spaces."""
    x = F.regexp_replace(fold(name), r"[-/_]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"[\p{P}\p{S}]", ""), r"\s+", " "))


def normalize_py(name: str) -> str:
    x = fold_py(name)
    x = re.sub(r"[-/_]", " ", x)
    x = "".join(c for c in x if unicodedata.category(c)[0] not in "PS")
    return " ".join(x.split())


def _singular(w: Column) -> Column:
    cut = lambda n: F.substring(w, F.lit(1), F.length(w) - n)
    return (
        F.when(F.length(w) <= 3, w)
        .when(w.endswith("ies"), F.concat(cut(3), F.lit("y")))
        .when(w.rlike("(s|x|z)es$"), cut(2))
        .when(w.endswith("s") & ~w.rlike("(ss|us)$"), cut(1))
        .otherwise(w)
    )


def match_key(name: Column) -> Column:
    """The key that lookups compare: normalize_name with each word's plural ending taken off."""
    return F.array_join(F.transform(F.split(normalize_name(name), " "), _singular), " ")


def match_key_py(name: str) -> str:
    def one(w: str) -> str:
        if len(w) <= 3:
            return w
        if w.endswith("ies"):
            return w[:-3] + "y"
        if w.endswith(("ses", "xes", "zes")):
            return w[:-2]
        return w[:-1] if w.endswith("s") and not w.endswith(("ss", "us")) else w

    return " ".join(map(one, normalize_py(name).split(" ")))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def estimate_tokens(text: Column) -> Column:
    """0 for the empty text, else 1.3 for each word, rounded down, at least 1."""
    return F.when(text == "", F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(word_count(text) * F.lit(1.3)).cast("int")))


def estimate_py(text: str) -> int:
    return max(1, int(len(text.split()) * 1.3)) if text else 0
