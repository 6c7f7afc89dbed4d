"""Keyword retrieval: analyzers, postings, corpus statistics and BM25."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from noteloom.functions.ids import fold, fold_py

TERM = r"[\p{L}\p{N}]+"
STOP = frozenset(
    "about all and are been but can did does for from has have her his how into its more most much not one only other our out some "
    "such than that the their them then there these they this those very was were what when where which who why will with would you your".split()
)
K1, B = 1.2, 0.75
HEADING_WEIGHT = 2
FLOOR = 1e-6
#: Scores are ranked on so many decimals, so that the order of summation decides nothing.
DECIMALS = 9


def query_terms(query: str) -> list[str]:
    """Lower-cased terms without stop words and single characters; all of them, if nothing else is left."""
    found = [t for t in re.findall(r"[^\W_]+", query.lower())]
    return list(dict.fromkeys([t for t in found if len(t) > 1 and t not in STOP] or found))


def query_terms_column(query: Column) -> Column:
    found = F.regexp_extract_all(F.lower(query), F.lit(TERM), F.lit(0))
    kept = F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(*sorted(STOP)))
    return F.array_distinct(F.when(F.size(kept) > 0, kept).otherwise(found))


def tokens(text: Column) -> Column:
    """Folded terms of a document, in order."""
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))


#: Rows of one batch of counts.
COUNTS = 1 << 17


def counted(chunks: DataFrame, *more: Column | str) -> DataFrame:
    """(chunk_id, more, dl, term, tf_heading, tf_content) of each row of chunks (chunk_id, heading, content).

    A row's tokens are counted where it is read: what goes on is a row for each of its terms, and nothing is shuffled.
    """
    joined = lambda c: F.array_join(tokens(F.col(c)), " ")
    read = chunks.select("chunk_id", *more, joined("heading").alias("__h"), joined("content").alias("__c"))
    kept = read.schema.names[:-2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, (head, body) = batch.select(kept), (batch.column(c).to_pylist() for c in ("__h", "__c"))
            row, dl, term, in_head, in_body = [], [], [], [], []

            def made() -> pa.RecordBatch:  # noqa: B023
                found = own.take(pa.array(np.repeat(np.array([r for r, _ in row], np.int64), [n for _, n in row])))  # noqa: B023
                counts = [pa.array(np.repeat(np.array(dl, np.int32), [n for _, n in row])), pa.array(term, pa.string()), pa.array(in_head, pa.int32()), pa.array(in_body, pa.int32())]  # noqa: B023
                return pa.RecordBatch.from_arrays([*found.columns, *counts], [*kept, "dl", "term", "tf_heading", "tf_content"])

            for r in range(len(head)):
                h, c = (Counter(x[r].split(" ") if x[r] else ()) for x in (head, body))
                dl.append(h.total() + c.total())
                before = len(term)
                for t, n in h.items():
                    term.append(t)
                    in_head.append(n)
                    in_body.append(c.pop(t, 0))
                term.extend(c)
                in_head.extend([0] * len(c))
                in_body.extend(c.values())
                row.append((r, len(term) - before))
                if len(term) >= COUNTS:
                    yield made()
                    row, dl, term, in_head, in_body = [], [], [], [], []
            if term:
                yield made()

    kinds = [f for f in read.schema.fields if f.name in kept]
    return read.mapInArrow(run, StructType([*kinds, StructField("dl", IntegerType()), StructField("term", StringType()), StructField("tf_heading", IntegerType()), StructField("tf_content", IntegerType())]))


def _added(counts: DataFrame, *keys: str) -> DataFrame:
    return counts.groupBy(*keys).agg(F.sum("tf_heading").cast("int").alias("tf_heading"), F.sum("tf_content").cast("int").alias("tf_content"))


def repeats(chunks: DataFrame) -> bool:
    """Whether a chunk_id comes more than once: only then must the counts of several rows be added up."""
    return not chunks.groupBy("chunk_id").count().filter("count > 1").isEmpty()


def postings(chunks: DataFrame, only: list[str] | None = None) -> DataFrame:
    """(term, chunk_id, tf_heading, tf_content) of chunks (chunk_id, heading, content); of some terms only, if given."""
    each = counted(chunks)
    if only is not None:
        each = each.filter(F.col("term").isin(*only) if only else F.lit(False))
    return _added(each, "term", "chunk_id") if repeats(chunks) else each.select("term", "chunk_id", "tf_heading", "tf_content")


def doc_freq(posted: DataFrame) -> DataFrame:
    return posted.groupBy("term").agg(F.count("*").alias("df"))


def length(heading: Column, content: Column) -> Column:
    return F.size(tokens(heading)) + F.size(tokens(content))


def folded_terms(query: str) -> list[str]:
    """A query's terms as an index has them, before stems."""
    return [fold_py(t) for t in query_terms(query)]


def lengths(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", (F.size(tokens(F.col("heading"))) + F.size(tokens(F.col("content")))).alias("dl"))


def bm25(chunks: DataFrame, terms: list[str], k1: float = K1, b: float = B, heading_weight: int = HEADING_WEIGHT) -> DataFrame:
    """(chunk_id, score) of the chunks that hold any of the terms. One scan counts what all chunks hold of the terms and their lengths."""
    terms = [*dict.fromkeys(terms)]
    if not terms:
        return chunks.select("chunk_id", F.lit(0.0).alias("score")).limit(0)
    head, body = tokens(F.col("heading")), tokens(F.col("content"))
    counted = chunks.select("chunk_id", head.alias("h"), body.alias("c"))
    hits = lambda a, t: F.size(F.filter(F.col(a), lambda x: x == F.lit(t)))
    tf = F.array(*((hits("h", t) * heading_weight + hits("c", t)).cast("double") for t in terms))
    counted = counted.select("chunk_id", (F.size("h") + F.size("c")).alias("dl"), tf.alias("tf"))
    stats = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *(F.count_if(F.col("tf")[i] > 0).alias(f"df{i}") for i in range(len(terms))))
    idf = [F.greatest(F.lit(FLOOR), F.ln((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))) for i in range(len(terms))]
    idf = [F.when(F.col("n") - F.col(f"df{i}") + 0.5 <= F.col(f"df{i}") + 0.5, F.lit(FLOOR)).otherwise(x) for i, x in enumerate(idf)]
    norm = k1 * (1 - b + b * F.col("dl") / F.nullif(F.col("avgdl"), F.lit(0.0)))
    score = sum((idf[i] * F.col("tf")[i] * (k1 + 1) / (F.col("tf")[i] + norm) for i in range(len(terms))), F.lit(0.0))
    found = counted.filter(F.exists("tf", lambda x: x > 0)).crossJoin(F.broadcast(stats))  # stats: one row
    return found.select("chunk_id", F.round(score, DECIMALS).alias("score"))


# The stored index

#: Directories that the terms of an index are spread over.
BUCKETS = 32
POSTED = "term string, chunk_id {}, tf_heading int, tf_content int, dl int, version string, bucket int"


def bucket(term: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def posted(chunks: DataFrame, stem: bool = False, version: Column | None = None, buckets: int = BUCKETS) -> DataFrame:
    """(term, chunk_id, tf_heading, tf_content, dl, version, bucket) of chunks (chunk_id, heading, content): what an index holds.

    dl is the chunk's length, so that a query needs no other table of chunks; version tells which state of the chunk this is.
    """
    out = counted(chunks, (version if version is not None else F.lit(None)).cast("string").alias("version"))
    keys = ("term", "chunk_id", "dl", "version")
    if stem:
        out = _added(stemmed(out).drop("term").withColumnRenamed("stem", "term"), *keys)
    elif repeats(chunks):
        out = _added(out, *keys)
    return out.select("term", "chunk_id", "tf_heading", "tf_content", "dl", "version", bucket(F.col("term"), buckets).alias("bucket"))


def write_index(rows: DataFrame, path: str, mode: str = "error") -> None:
    """Postings by bucket, in each file by term, so that a query reads its terms' buckets and in them its terms' row groups.

    A bucket is split by chunk where there are more partitions than buckets, so a term of very many chunks is no single task's work.
    """
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // BUCKETS)
    place = F.col("bucket") * parts + F.pmod(F.xxhash64("chunk_id"), F.lit(parts)).cast("int")
    rows.repartitionById(BUCKETS * parts, place).sortWithinPartitions("bucket", "term").write.partitionBy("bucket").mode(mode).parquet(path)


def bm25_index(index: DataFrame, n: int, average: float | None, terms: list[str], k1: float = K1, b: float = B, heading_weight: int = HEADING_WEIGHT, buckets: int = BUCKETS, alive: DataFrame | None = None) -> DataFrame:
    """(chunk_id, score) as bm25() gives it, from an index of n chunks of so many terms on average.

    alive (chunk_id, version): the chunks that there are now, if the index may hold others.
    """
    terms = [*dict.fromkeys(terms)]
    if not terms or not n:
        return index.select("chunk_id", F.lit(0.0).alias("score")).limit(0)
    asked = index.sparkSession.createDataFrame([(t,) for t in terms], "term string").select(bucket(F.col("term"), buckets)).distinct().collect()  # as many rows as terms at most
    hit = index.filter(F.col("bucket").isin(*(r[0] for r in asked)) & F.col("term").isin(*terms))
    if alive is not None:
        hit = hit.join(alive, ["chunk_id", "version"], "left_semi")
    df = hit.groupBy("term").agg(F.count("*").alias("df"))  # one row for each term
    ratio = (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)
    idf = F.when(ratio <= 1, F.lit(FLOOR)).otherwise(F.greatest(F.lit(FLOOR), F.ln(ratio)))
    tf = (F.col("tf_heading") * heading_weight + F.col("tf_content")).cast("double")
    norm = k1 * (1 - b + b * F.col("dl") / F.lit(average or None).cast("double"))
    scored = hit.join(F.broadcast(df.select("term", idf.alias("idf"))), "term")
    return scored.groupBy("chunk_id").agg(F.round(F.sum(F.col("idf") * tf * (k1 + 1) / (tf + norm)), DECIMALS).alias("score"))


def top(scored: DataFrame, limit: int, key: str = "chunk_id", by: str = "score", largest: bool = True) -> DataFrame:
    order = F.desc(by) if largest else F.asc(by)
    return scored.orderBy(order, key).limit(limit)


_STEPS2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
_STEPS3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEPS4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def stem(w: str) -> str:
    """The stem of a term of Latin letters; other terms stay."""
    return porter(w) if w.isascii() and w.isalpha() else w


def porter(w: str) -> str:
    """The stem of a lower-case word by Porter's rules (1980)."""
    if len(w) < 3:
        return w

    def vowel(s: str, i: int) -> bool:
        return s[i] in "aeiou" or s[i] == "y" and i > 0 and not vowel(s, i - 1)

    def measure(s: str) -> int:
        kinds = [vowel(s, i) for i in range(len(s))]
        return sum(a and not b for a, b in zip(kinds, kinds[1:]))

    def has(s: str) -> bool:
        return any(vowel(s, i) for i in range(len(s)))

    def double(s: str) -> bool:
        return len(s) > 1 and s[-1] == s[-2] and not vowel(s, len(s) - 1)

    def cvc(s: str) -> bool:
        n = len(s)
        return n > 2 and not vowel(s, n - 3) and vowel(s, n - 2) and not vowel(s, n - 1) and s[-1] not in "wxy"

    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    again = False
    if w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) > 0 else w
    elif w.endswith("ed") and has(w[:-2]):
        w, again = w[:-2], True
    elif w.endswith("ing") and has(w[:-3]):
        w, again = w[:-3], True
    if again:
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif double(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif measure(w) == 1 and cvc(w):
            w += "e"
    if w.endswith("y") and has(w[:-1]):
        w = w[:-1] + "i"
    for steps in (_STEPS2, _STEPS3):
        for end, to in sorted(steps, key=lambda s: -len(s[0])):
            if w.endswith(end):
                w = w[: -len(end)] + to if measure(w[: -len(end)]) > 0 else w
                break
    for end in sorted((*_STEPS4, "ion"), key=len, reverse=True):
        if w.endswith(end):
            stem = w[: -len(end)]
            if measure(stem) > 1 and (end != "ion" or stem[-1:] in ("s", "t")):
                w = stem
            break
    if w.endswith("e"):
        stem = w[:-1]
        if measure(stem) > 1 or measure(stem) == 1 and not cvc(stem):
            w = stem
    return w[:-1] if measure(w) > 1 and double(w) and w[-1] == "l" else w


def stemmed(terms: DataFrame, column: str = "term") -> DataFrame:
    """terms with ``stem``, by an Arrow function."""
    @F.pandas_udf("string")
    def stems(s: pd.Series) -> pd.Series:
        return s.map({w: stem(w) for w in s.dropna().unique()})

    return terms.withColumn("stem", stems(F.col(column)))
