"""The engine's own queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noteloom.functions import ids
from noteloom.functions import vectors as V
from noteloom.operators import chunking, diff, fusion, graph, keyword, knn, queue, versions
from noteloom.plans import projection as P
from noteloom.plans.projection import table
from noteloom.streaming import watch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

QUERY = "Which license version and token?"
TERMS = keyword.query_terms(QUERY)
NEAR = 7  # the vector that single queries ask for


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _norm(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_replace(strip_accents(lower({x})), '[-/_]', ' ', 'g'), '[\\p{{P}}\\p{{S}}]', '', 'g'), '\\s+', ' ', 'g'))"


def _digest(*parts: str) -> str:
    return f"substr(sha256(concat_ws(chr(31), {', '.join(parts)})), 1, 32)"


def _estimate(x: str) -> str:
    return f"CASE WHEN {x} = '' THEN 0 ELSE greatest(1, CAST(floor(len(regexp_extract_all({x}, '\\S+')) * 1.3::DOUBLE) AS INTEGER)) END"


def _key(x: str) -> str:
    w = "w"
    one = f"CASE WHEN length({w}) <= 3 THEN {w} WHEN {w} LIKE '%ies' THEN left({w}, -3) || 'y' WHEN regexp_matches({w}, '(s|x|z)es$') THEN left({w}, -2) WHEN {w} LIKE '%s' AND NOT regexp_matches({w}, '(ss|us)$') THEN left({w}, -1) ELSE {w} END"
    return f"array_to_string(list_transform(string_split({_norm(x)}, ' '), lambda w: {one}), ' ')"


# Identity


@query(f"SELECT doc_id, {_digest(chr(39) + 'document' + chr(39), 'source || chr(47) || doc_id')} AS document_id, sha256(replace(text, chr(13) || chr(10), chr(10))) AS content_hash FROM documents")
def ids_document(spark, sf):
    path = F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"))
    return table(spark, sf, "documents").select("doc_id", ids.document_id(path).alias("document_id"), ids.content_hash(F.col("text")).alias("content_hash"))


@query(f"SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, {_digest(chr(39) + 'relation' + chr(39), 'l_partkey::VARCHAR', chr(39) + 'uses' + chr(39), 'l_suppkey::VARCHAR', 'l_orderkey::VARCHAR')} AS relation_id FROM lineitem")
def ids_relation(spark, sf):
    d = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey").distinct()
    return d.select("*", ids.relation_id(F.col("l_partkey").cast("string"), F.lit("uses"), F.col("l_suppkey").cast("string"), F.col("l_orderkey").cast("string")).alias("relation_id"))


@query(f"SELECT doc_id, {_norm('text')} AS name FROM documents")
def name_normalize(spark, sf):
    return table(spark, sf, "documents").select("doc_id", ids.normalize_name(F.col("text")).alias("name"))


@query(f"SELECT doc_id, {_key('text')} AS key FROM documents")
def name_match_key(spark, sf):
    return table(spark, sf, "documents").select("doc_id", ids.match_key(F.col("text")).alias("key"))


@query(f"SELECT doc_id, {_estimate('text')} AS tokens FROM documents")
def token_estimate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", ids.estimate_tokens(F.col("text")).alias("tokens"))


# Change detection

_CHANGES = """WITH indexed AS (SELECT doc_id AS document_id, source || '/' || doc_id || '.md' AS path, sha256(text) AS content_hash FROM documents),
found AS (SELECT CASE WHEN doc_id % 10 = 0 THEN 'archive/' || doc_id || '.md' ELSE source || '/' || doc_id || '.md' END AS path,
  sha256(CASE WHEN doc_id % 10 = 1 THEN text || ' x' ELSE text END) AS content_hash FROM documents WHERE doc_id % 10 <> 2),
vanished AS (SELECT * FROM indexed WHERE path NOT IN (SELECT path FROM found)),
appeared AS (SELECT * FROM found WHERE path NOT IN (SELECT path FROM indexed)),
old AS (SELECT * FROM vanished QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY path) = 1),
new AS (SELECT * FROM appeared QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY path) = 1),
renames AS (SELECT document_id, old.path AS old_path, new.path AS new_path, content_hash FROM old JOIN new USING (content_hash)),
outcomes AS (
  SELECT coalesce(i.path, f.path) AS path, document_id,
    CASE WHEN i.path IS NULL THEN 'added' WHEN f.path IS NULL THEN 'removed' WHEN i.content_hash = f.content_hash THEN 'unchanged' ELSE 'modified' END AS outcome, NULL::VARCHAR AS old_path
  FROM indexed i FULL JOIN found f ON i.path = f.path
  WHERE coalesce(i.path, f.path) NOT IN (SELECT old_path FROM renames) AND coalesce(i.path, f.path) NOT IN (SELECT new_path FROM renames)
  UNION ALL SELECT new_path, document_id, 'renamed', old_path FROM renames)
"""


@query(_CHANGES + "SELECT path, document_id, content_hash FROM vanished")
def vanished_paths(spark, sf):
    return diff.vanished(*P.changes(spark, sf)).select("path", "document_id", "content_hash")


@query(_CHANGES + "SELECT path, content_hash FROM appeared")
def appeared_paths(spark, sf):
    return diff.appeared(*P.changes(spark, sf))


@query(_CHANGES + "SELECT * FROM renames")
def rename_pairs(spark, sf):
    return diff.renames(*P.changes(spark, sf))


@query(_CHANGES + "SELECT * FROM outcomes")
def document_outcomes(spark, sf):
    return diff.documents(*P.changes(spark, sf))


@query(_CHANGES + "SELECT outcome, count(*) AS n FROM outcomes GROUP BY outcome")
def sync_summary(spark, sf):
    return diff.summary(diff.documents(*P.changes(spark, sf)))


@query("SELECT sha256(text) AS content_hash, count(*) AS copies, min(source || '/' || doc_id || '.md') AS first_path FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_hash_duplicates(spark, sf):
    return diff.duplicates(P.changes(spark, sf)[0])


_LINES = "SELECT doc_id AS document_id, u - 1 AS ordinal, source, lang, p[u] AS text FROM (SELECT *, string_split(text, chr(10)) AS p FROM documents), unnest(range(1, len(p) + 1)) AS x(u)"


@query(
    f"""WITH lines AS ({_LINES}), old AS (SELECT document_id || ':' || ordinal AS chunk_id, ordinal, sha256(text) AS h FROM lines),
    new AS (SELECT document_id || ':' || ordinal AS chunk_id, ordinal + (document_id % 3 = 0)::INT AS ordinal, sha256(CASE WHEN document_id % 10 = 1 THEN text || ' x' ELSE text END) AS h FROM lines WHERE document_id % 10 <> 2
      UNION ALL SELECT document_id || ':new', 0, sha256(text) FROM lines WHERE ordinal = 0)
    SELECT coalesce(o.chunk_id, n.chunk_id) AS chunk_id, CASE WHEN o.h IS NULL THEN 'added' WHEN n.h IS NULL THEN 'removed' WHEN o.h = n.h THEN 'unchanged' ELSE 'modified' END AS change, coalesce(o.ordinal <> n.ordinal, false) AS moved
    FROM old o FULL JOIN new n ON o.chunk_id = n.chunk_id"""
)
def chunk_diff_classes(spark, sf):
    lines = P.paragraphs(spark, sf)
    key = F.concat_ws(":", F.col("document_id").cast("string"), F.col("ordinal").cast("string"))
    old = lines.select(key.alias("chunk_id"), "ordinal", ids.content_hash(F.col("text")).alias("content_hash"))
    text = F.when(F.col("document_id") % 10 == 1, F.concat("text", F.lit(" x"))).otherwise(F.col("text"))
    new = lines.filter("document_id % 10 <> 2").select(key.alias("chunk_id"), (F.col("ordinal") + (F.col("document_id") % 3 == 0).cast("int")).alias("ordinal"), ids.content_hash(text).alias("content_hash"))
    more = lines.filter("ordinal = 0").select(F.concat(F.col("document_id").cast("string"), F.lit(":new")).alias("chunk_id"), F.lit(0).alias("ordinal"), ids.content_hash(F.col("text")).alias("content_hash"))
    return diff.chunks(old, new.unionByName(more))


# Chunks


@query(
    f"""WITH RECURSIVE lines AS (SELECT *, {_estimate('text')} AS n FROM ({_LINES})),
    packs AS (
      SELECT document_id, ordinal, n, 0 AS chunk, n AS used FROM lines WHERE ordinal = 0
      UNION ALL
      SELECT l.document_id, l.ordinal, l.n, CASE WHEN p.used + l.n > 128 THEN p.chunk + 1 ELSE p.chunk END, CASE WHEN p.used + l.n > 128 THEN l.n ELSE p.used + l.n END
      FROM packs p JOIN lines l ON l.document_id = p.document_id AND l.ordinal = p.ordinal + 1)
    SELECT document_id, chunk, CAST(min(ordinal) AS INTEGER) AS first_ordinal, CAST(count(*) AS INTEGER) AS paragraphs, CAST(sum(n) AS INTEGER) AS tokens FROM packs GROUP BY document_id, chunk"""
)
def chunk_pack_greedy(spark, sf):
    return chunking.packed(P.paragraphs(spark, sf), 128).select("document_id", "chunk", "first_ordinal", "paragraphs", "tokens")


@query("""WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+') AS w FROM documents)
SELECT doc_id, CAST(i AS INTEGER) AS piece, array_to_string(w[i * 393 + 1:i * 393 + 393], ' ') AS text FROM w, unnest(range(0, (len(w) + 392) // 393)) AS x(i)""")
def chunk_word_split(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(chunking.word_split(F.col("text"), 512)).alias("piece", "text"))
    return d.select("doc_id", "piece", "text")


@query(
    f"""WITH lines AS ({_LINES}), placed AS (SELECT *, row_number() OVER (PARTITION BY document_id, source, lang ORDER BY ordinal) - 1 AS occurrence FROM lines)
    SELECT document_id, ordinal, CAST(occurrence AS INTEGER) AS occurrence, {_digest(chr(39) + 'chunk' + chr(39), 'document_id::VARCHAR', _norm('source') + ' || chr(30) || ' + _norm('lang'), 'occurrence::VARCHAR')} AS chunk_id, sha256(text) AS content_hash FROM placed"""
)
def chunk_occurrence_ids(spark, sf):
    d = P.paragraphs(spark, sf).withColumn("document_id", F.col("document_id").cast("string")).withColumnRenamed("text", "content")
    return chunking.mint(d).select(F.col("document_id").cast("long").alias("document_id"), F.col("ordinal").cast("long").alias("ordinal"), F.col("occurrence").cast("int").alias("occurrence"), "chunk_id", "content_hash")


# Keyword arm

_TOKENS = "regexp_extract_all(strip_accents(lower({})), '[\\p{{L}}\\p{{N}}]+')".format
_POSTED = f"""WITH toks AS (
  SELECT doc_id AS chunk_id, unnest({_TOKENS("source || ' ' || lang")}) AS term, 1 AS h, 0 AS c FROM documents
  UNION ALL SELECT doc_id, unnest({_TOKENS('text')}), 0, 1 FROM documents),
posted AS (SELECT term, chunk_id, CAST(sum(h) AS INTEGER) AS tf_heading, CAST(sum(c) AS INTEGER) AS tf_content FROM toks GROUP BY term, chunk_id)
"""
_LIST = ", ".join(f"'{t}'" for t in TERMS)
_BM25 = _POSTED + f""", sizes AS (SELECT doc_id AS chunk_id, len({_TOKENS("source || ' ' || lang")}) + len({_TOKENS('text')}) AS dl FROM documents),
stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM sizes),
dfs AS (SELECT term, count(*) AS df FROM posted WHERE term IN ({_LIST}) GROUP BY term),
scored AS (
  SELECT chunk_id, round(sum((CASE WHEN n - df + 0.5::DOUBLE <= df + 0.5::DOUBLE THEN 0.000001::DOUBLE ELSE greatest(0.000001::DOUBLE, ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))) END)
    * (2 * tf_heading + tf_content) * 2.2::DOUBLE / ((2 * tf_heading + tf_content) + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 9) AS score
  FROM posted JOIN dfs USING (term) JOIN sizes USING (chunk_id), stats GROUP BY chunk_id)
"""


@query(_POSTED + "SELECT * FROM posted")
def postings(spark, sf):
    return keyword.postings(P.chunks(spark, sf))


@query(_POSTED + "SELECT term, count(*) AS df FROM posted GROUP BY term")
def doc_freq(spark, sf):
    return keyword.doc_freq(keyword.postings(P.chunks(spark, sf)))


@query(_BM25 + "SELECT * FROM scored")
def keyword_bm25_weighted(spark, sf):
    """Without an index."""
    return keyword.bm25(P.chunks(spark, sf), TERMS)


@query(_BM25 + "SELECT * FROM scored ORDER BY score DESC, chunk_id LIMIT 50")
def keyword_bm25(spark, sf):
    return keyword.top(keyword.bm25_index(*P.keyword_index(spark, sf), TERMS), 50)


@query(_POSTED + "SELECT term, chunk_id, tf_heading, tf_content FROM posted")
def keyword_index(spark, sf):
    """The stored postings."""
    return P.keyword_index(spark, sf)[0].select("term", "chunk_id", "tf_heading", "tf_content")


@query(_POSTED + "SELECT term, chunk_id, tf_heading, tf_content FROM posted WHERE chunk_id % 10 <> 2")
def keyword_index_increment(spark, sf):
    """An index that a tenth of the chunks was taken from and added to again, without those of another tenth: what is alive of it is what a rebuild holds."""
    chunks = P.chunks(spark, sf)
    k = F.col("chunk_id") % 10
    old = keyword.posted(chunks.withColumn("content", F.when(k == 1, F.concat("content", F.lit(" former"))).otherwise(F.col("content"))), version=F.when(k == 1, F.lit("1")).otherwise(F.lit("2")))
    new = keyword.posted(chunks.filter(k == 1), version=F.lit("2"))
    alive = chunks.filter(k != 2).select("chunk_id", F.lit("2").alias("version"))
    return old.unionByName(new).join(alive, ["chunk_id", "version"], "left_semi").select("term", "chunk_id", "tf_heading", "tf_content")


_STOPS = ", ".join(f"'{t}'" for t in sorted(keyword.STOP))


@query(
    f"""WITH raw AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS t FROM conversations),
    kept AS (SELECT *, list_filter(t, lambda x: length(x) > 1 AND x NOT IN ({_STOPS})) AS k FROM raw), used AS (SELECT conv_id, turn, CASE WHEN len(k) > 0 THEN k ELSE t END AS t FROM kept)
    SELECT conv_id, turn, array_to_string(list_transform(list_filter(list_zip(t, range(1, len(t) + 1)), lambda p: list_position(t, p[1]) = p[2]), lambda p: p[1]), ' ') AS terms FROM used"""
)
def query_terms(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(keyword.query_terms_column(F.col("text")), " ").alias("terms"))


# Vectors

_PAIRS = "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings), q AS (SELECT e AS q FROM v WHERE vec_id = 7) "


def _vectors(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings")


def _asked(spark, sf) -> list[float]:
    """One row by its key."""
    row = _vectors(spark, sf).filter(F.col("vec_id") == NEAR).select("embedding").first()
    return list(row.embedding)


def _beside(spark, sf) -> DataFrame:
    """Each vector beside the one of the next id of its label."""
    v = _vectors(spark, sf)
    w = W.partitionBy("label").orderBy("vec_id")
    return v.withColumn("other", F.lead("embedding").over(w)).filter("other is not null")


_BESIDE = "WITH p AS (SELECT vec_id, embedding::DOUBLE[] AS a, embedding AS fa, lead(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS b, lead(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS fb FROM embeddings QUALIFY b IS NOT NULL) "
_FOLDS = {
    "l2": "list_distance(a, b)",
    "l1": "list_sum(list_transform(list_zip(a, b), lambda x: abs(x[1] - x[2])))",
    "cosine": "1 - list_inner_product(a, b) / (sqrt(list_inner_product(a, a)) * sqrt(list_inner_product(b, b)))",
}


def _distance_query(metric: str) -> None:
    def f(spark, sf):
        return _beside(spark, sf).select("vec_id", F.round(V.METRICS[metric](F.col("embedding"), F.col("other")), 9).alias("distance"))

    f.__name__ = f"vec_{metric}"
    query(_BESIDE + f"SELECT vec_id, round({_FOLDS[metric]}, 9) AS distance FROM p")(f)


for _m in _FOLDS:
    _distance_query(_m)


@query(_BESIDE + "SELECT vec_id, CAST(len(list_filter(list_zip(a, b), lambda x: (x[1] > 0) <> (x[2] > 0))) AS INTEGER) AS distance FROM p")
def vec_hamming(spark, sf):
    d = _beside(spark, sf).select("vec_id", V.pack_bits(V.vec_quantize_binary(F.col("embedding"))).alias("a"), V.pack_bits(V.vec_quantize_binary(F.col("other"))).alias("b"))
    return d.select("vec_id", V.vec_distance_hamming(F.col("a"), F.col("b")).alias("distance"))


@query(_BESIDE + "SELECT vec_id, u AS i, (fa[u] + fb[u])::DOUBLE AS added, (fa[u] - fb[u])::DOUBLE AS taken FROM p, unnest(range(1, len(a) + 1)) AS x(u)")
def vec_add_sub(spark, sf):
    d = _beside(spark, sf).select("vec_id", F.arrays_zip(V.vec_add(F.col("embedding"), F.col("other")).alias("added"), V.vec_sub(F.col("embedding"), F.col("other")).alias("taken")).alias("z"))
    return d.select("vec_id", F.posexplode("z").alias("i", "x")).select("vec_id", (F.col("i") + 1).cast("long").alias("i"), F.col("x.added").cast("double").alias("added"), F.col("x.taken").cast("double").alias("taken"))


@query("SELECT vec_id, i - 9 AS i, embedding[i]::DOUBLE AS x FROM embeddings, unnest(range(9, 17)) AS u(i)")
def vec_slice(spark, sf):
    return _vectors(spark, sf).select("vec_id", F.posexplode(V.vec_slice(F.col("embedding"), 8, 16)).alias("i", "x")).select("vec_id", F.col("i").cast("long").alias("i"), F.col("x").cast("double").alias("x"))


@query("SELECT vec_id, i - 1 AS i, embedding[i]::DOUBLE AS x FROM embeddings, unnest(range(1, len(embedding) + 1)) AS u(i)")
def vec_each(spark, sf):
    return _vectors(spark, sf).select("vec_id", F.posexplode("embedding").alias("i", "x")).select("vec_id", F.col("i").cast("long").alias("i"), F.col("x").cast("double").alias("x"))


@query("WITH v AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * 3 + 1) AS e FROM embeddings), n AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS s FROM v) SELECT vec_id, i - 1 AS i, round(e[i] / s, 9) AS x FROM n, unnest(range(1, len(e) + 1)) AS u(i)")
def vec_normalize(spark, sf):
    d = _vectors(spark, sf).select("vec_id", F.transform(F.col("embedding").cast("array<double>"), lambda x: x * 3 + 1).alias("e"))
    return d.select("vec_id", F.posexplode(V.vec_normalize(F.col("e"))).alias("i", "x")).select("vec_id", F.col("i").cast("long").alias("i"), F.round("x", 9).alias("x"))


@query("SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dims, 'float32' AS type, 'v0.1.9' AS version FROM embeddings")
def vec_length(spark, sf):
    v = _vectors(spark, sf)
    return v.select("vec_id", V.vec_length(F.col("embedding")).alias("dims"), F.lit(V.vec_type(dict(v.dtypes)["embedding"])).alias("type"), F.lit(V.VERSION).alias("version"))


@query("SELECT vec_id, '[' || array_to_string(list_transform(embedding, lambda x: printf('%.6f', x::DOUBLE)), ',') || ']' AS json FROM embeddings")
def vec_to_json(spark, sf):
    return _vectors(spark, sf).select("vec_id", V.vec_to_json(F.col("embedding")).alias("json"))


@query("SELECT vec_id, i - 1 AS i, CAST(trunc(greatest(-128::DOUBLE, least(127::DOUBLE, (embedding[i]::DOUBLE + 1) / (2::DOUBLE / 255::DOUBLE) - 128))) AS INTEGER) AS q FROM embeddings, unnest(range(1, len(embedding) + 1)) AS u(i)")
def vec_quantize_int8(spark, sf):
    return _vectors(spark, sf).select("vec_id", F.posexplode(V.vec_quantize_int8(F.col("embedding"))).alias("i", "q")).select("vec_id", F.col("i").cast("long").alias("i"), F.col("q").cast("int").alias("q"))


@query("SELECT vec_id, i - 1 AS i, embedding[i] > 0 AS bit FROM embeddings, unnest(range(1, len(embedding) + 1)) AS u(i)")
def vec_quantize_binary(spark, sf):
    return _vectors(spark, sf).select("vec_id", F.posexplode(V.vec_quantize_binary(F.col("embedding"))).alias("i", "bit")).select("vec_id", F.col("i").cast("long").alias("i"), "bit")


_DIST = {"l2": "list_distance(e, q)", "l1": "list_sum(list_transform(list_zip(e, q), lambda x: abs(x[1] - x[2])))", "cosine": "1 - list_inner_product(e, q) / (sqrt(list_inner_product(e, e)) * sqrt(list_inner_product(q, q)))"}


def _near(metric: str, where: str = "true", k: int = 10) -> str:
    return _PAIRS + f"SELECT vec_id, round({_DIST[metric]}, 9) AS distance FROM v, q WHERE {where} ORDER BY distance, vec_id LIMIT {k}"


def _knn_query(metric: str) -> None:
    def f(spark, sf):
        return knn.knn(_vectors(spark, sf), _asked(spark, sf), 10, metric)

    f.__name__ = f"vector_knn_{metric}"
    query(_near(metric))(f)


for _m in _DIST:
    _knn_query(_m)


@query(_near("l2", "label IN (2, 3) AND label >= 2"))
def knn_filtered_label(spark, sf):
    return knn.knn(_vectors(spark, sf), _asked(spark, sf), 10, where=F.col("label").isin(2, 3) & (F.col("label") >= 2))


@query(_near("l2", "vec_id IN (SELECT doc_id FROM labels WHERE quality = 1)"))
def knn_id_in(spark, sf):
    good = table(spark, sf, "labels").filter("quality = 1").select(F.col("doc_id").alias("vec_id")).distinct()
    return knn.knn(_vectors(spark, sf), _asked(spark, sf), 10, ids=good)


@query(_near("l2", "round(list_distance(e, q), 9) >= 1.1 AND round(list_distance(e, q), 9) <= 1.3", 25))
def knn_distance_range(spark, sf):
    return knn.knn(_vectors(spark, sf), _asked(spark, sf), 25, within=(1.1, 1.3))


@query(_PAIRS + "SELECT vec_id, CAST(len(list_filter(list_zip(e, q), lambda x: (x[1] > 0) <> (x[2] > 0))) AS INTEGER) AS distance FROM v, q ORDER BY distance, vec_id LIMIT 10")
def knn_hamming(spark, sf):
    bits = _vectors(spark, sf).select("vec_id", V.vec_quantize_binary(F.col("embedding")).alias("embedding"))
    return knn.knn(bits, [float(x > 0) for x in _asked(spark, sf)], 10, "hamming").select("vec_id", F.col("distance").cast("int").alias("distance"))


@query("WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings) SELECT a.vec_id AS query_id, b.vec_id, round(list_distance(a.e, b.e), 9) AS distance, CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_distance(a.e, b.e), 9), b.vec_id) AS INTEGER) AS rank FROM v a, v b WHERE a.vec_id % 100 = 0 QUALIFY rank <= 5")
def knn_per_query(spark, sf):
    """Every vector whose id is divisible by 100 asks all vectors."""
    v = _vectors(spark, sf)
    return knn.knn_per_query(v, v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 5)


@query(_PAIRS + "SELECT vec_id, distance, round(1 / (1 + distance), 9) AS similarity, CASE WHEN 1 / (1 + distance) >= 0.92 THEN 'same' WHEN 1 / (1 + distance) >= 0.75 THEN 'ask' ELSE 'new' END AS decision FROM (SELECT vec_id, round(list_distance(e, q), 9) AS distance FROM v, q ORDER BY distance, vec_id LIMIT 10)")
def entity_similarity(spark, sf):
    s = knn.similarity(F.col("distance"))
    d = knn.knn(_vectors(spark, sf), _asked(spark, sf), graph.NEAREST)
    return d.select("vec_id", "distance", F.round(s, 9).alias("similarity"), F.when(s >= graph.RESOLVE, "same").when(s >= graph.ADJUDICATE, "ask").otherwise("new").alias("decision"))


# Graph


def _eid(kind: str, name: str) -> str:
    return _digest("'entity'", f"'{kind}'", _norm(name))


def _cid(key: str) -> str:
    return _digest("'chunk'", f"({key})::VARCHAR")


_GRAPH = f"""WITH part_ AS (SELECT p_partkey, p_name || ' ' || p_partkey AS name, {_eid('Component', "p_name || ' ' || p_partkey")} AS id FROM part),
supplier_ AS (SELECT s_suppkey, s_name AS name, s_nationkey, {_eid('Technology', 's_name')} AS id FROM supplier),
customer_ AS (SELECT c_custkey, c_name AS name, c_nationkey, {_eid('Person', 'c_name')} AS id FROM customer),
nation_ AS (SELECT n_nationkey, n_regionkey, n_name AS name, {_eid('Project', 'n_name')} AS id, {_cid("'N' || n_nationkey")} AS chunk_id FROM nation),
region_ AS (SELECT r_regionkey, r_name AS name, {_eid('Concept', 'r_name')} AS id FROM region),
entities AS (SELECT id AS entity_id, type, name AS canonical_name, {_key('name')} AS normalized_name FROM (
  SELECT id, 'Component' AS type, name FROM part_ UNION ALL SELECT id, 'Technology', name FROM supplier_ UNION ALL SELECT id, 'Person', name FROM customer_
  UNION ALL SELECT id, 'Project', name FROM nation_ UNION ALL SELECT id, 'Concept', name FROM region_)),
aliases AS (SELECT entity_id, name, {_key('name')} AS normalized_name FROM (SELECT id AS entity_id, 'P' || p_partkey AS name FROM part_ UNION ALL SELECT id, 'S' || s_suppkey FROM supplier_)),
lines_ AS (SELECT l_orderkey, p.id AS part_id, s.id AS supplier_id, l_discount, {_cid('l_orderkey')} AS chunk_id FROM lineitem JOIN part_ p ON l_partkey = p_partkey JOIN supplier_ s ON l_suppkey = s_suppkey),
mentions AS (
  SELECT c.id AS entity_id, {_cid('o_orderkey')} AS chunk_id, CASE WHEN o_orderstatus = 'F' THEN 'front_matter' ELSE 'extraction' END AS source FROM orders JOIN customer_ c ON o_custkey = c_custkey
  UNION ALL SELECT entity_id, chunk_id, CASE WHEN o_orderstatus = 'F' THEN 'front_matter' ELSE 'extraction' END
  FROM (SELECT l_orderkey, chunk_id, part_id AS entity_id FROM lines_ UNION SELECT l_orderkey, chunk_id, supplier_id FROM lines_) JOIN orders ON l_orderkey = o_orderkey),
relations_ AS (
  SELECT part_id AS source_id, 'uses' AS type, supplier_id AS target_id, chunk_id AS supporting_chunk_id, round(max(1 - l_discount), 9) AS confidence FROM lines_ GROUP BY ALL
  UNION ALL SELECT DISTINCT c.id, 'related-to', part_id, chunk_id, 1.0::DOUBLE FROM lines_ JOIN orders ON l_orderkey = o_orderkey JOIN customer_ c ON o_custkey = c_custkey
  UNION ALL SELECT x.id, 'part-of', n.id, n.chunk_id, 1.0::DOUBLE FROM (SELECT id, s_nationkey AS k FROM supplier_ UNION ALL SELECT id, c_nationkey FROM customer_) x JOIN nation_ n ON k = n_nationkey
  UNION ALL SELECT n.id, 'part-of', r.id, n.chunk_id, 1.0::DOUBLE FROM nation_ n JOIN region_ r ON n_regionkey = r_regionkey),
relations AS (SELECT {_digest('source_id', "type", 'target_id', 'supporting_chunk_id').replace('concat_ws(chr(31), ', "concat_ws(chr(31), 'relation', ")} AS relation_id, * FROM relations_),
ends AS (SELECT source_id AS entity_id, target_id AS other_id, supporting_chunk_id, confidence FROM relations UNION ALL SELECT target_id, source_id, supporting_chunk_id, confidence FROM relations),
seeds AS (SELECT DISTINCT entity_id FROM aliases WHERE normalized_name IN ('p1', 's1'))
"""
_EXPAND = _GRAPH + """, hop1 AS (SELECT e.* FROM ends e JOIN seeds USING (entity_id)),
front AS (SELECT DISTINCT other_id AS entity_id FROM hop1 WHERE other_id NOT IN (SELECT entity_id FROM seeds)),
steps AS (SELECT chunk_id, 0 AS hop, 1.0::DOUBLE AS confidence FROM mentions JOIN seeds USING (entity_id) UNION ALL SELECT supporting_chunk_id, 1, confidence FROM hop1
  UNION ALL SELECT supporting_chunk_id, 2, confidence FROM ends JOIN front USING (entity_id)),
expanded AS (SELECT chunk_id, hop, max(confidence) AS confidence FROM steps GROUP BY chunk_id, hop QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY hop) = 1)
"""


def _mentions(spark, sf):
    return lambda entities: P.mentions(P.near(spark, sf, entities))


def _relations(spark, sf):
    return lambda entities: P.relations(P.near(spark, sf, entities))


def _seeds(spark, sf) -> DataFrame:
    return P.aliases(spark, sf).filter(F.col("normalized_name").isin("p1", "s1")).select("entity_id").distinct()


@query(_GRAPH + "SELECT * FROM entities")
def graph_entities(spark, sf):
    return P.entities(spark, sf)


@query(_GRAPH + """, names AS (SELECT normalized_name AS key, entity_id FROM entities UNION SELECT normalized_name, entity_id FROM aliases)
SELECT key, entity_id, type, canonical_name, coalesce((SELECT string_agg(name, ',' ORDER BY name) FROM aliases a WHERE a.entity_id = e.entity_id), '') AS aliases, (SELECT count(*) FROM mentions m WHERE m.entity_id = e.entity_id) AS mentions
FROM names JOIN entities e USING (entity_id) WHERE key IN ('p1', 'p2', 's3', 'france', 'customer 000000001')""")
def graph_entity_lookup(spark, sf):
    keys = spark.createDataFrame([(k,) for k in ("p1", "p2", "s3", "france", "customer 000000001")], "key string")
    return graph.lookup(P.entities(spark, sf), P.aliases(spark, sf), _mentions(spark, sf), keys).withColumn("aliases", F.array_join("aliases", ","))


@query(_GRAPH + "SELECT relation_id, source_id, type, target_id, supporting_chunk_id, confidence FROM relations WHERE source_id IN (SELECT entity_id FROM seeds) OR target_id IN (SELECT entity_id FROM seeds)")
def graph_neighbors(spark, sf):
    return graph.neighbors(_relations(spark, sf), _seeds(spark, sf)).select("relation_id", "source_id", "type", "target_id", "supporting_chunk_id", "confidence")


@query(_EXPAND + "SELECT * FROM expanded")
def graph_two_hop(spark, sf):
    return graph.expand(_mentions(spark, sf), _relations(spark, sf), _seeds(spark, sf), 2)


@query(_EXPAND + "SELECT * FROM expanded ORDER BY hop, confidence DESC, chunk_id LIMIT 50")
def graph_chunk_rank(spark, sf):
    return graph.chunk_rank(graph.expand(_mentions(spark, sf), _relations(spark, sf), _seeds(spark, sf), 2))


_KEPT = f", gone AS (SELECT {_cid('o_orderkey')} AS chunk_id FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT chunk_id FROM nation_), m AS (SELECT * FROM mentions WHERE chunk_id NOT IN (SELECT chunk_id FROM gone)), r AS (SELECT * FROM relations WHERE supporting_chunk_id NOT IN (SELECT chunk_id FROM gone)) "


@query(_GRAPH + _KEPT + "SELECT * FROM entities e WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.entity_id = e.entity_id) AND NOT EXISTS (SELECT 1 FROM r WHERE r.source_id = e.entity_id) AND NOT EXISTS (SELECT 1 FROM r WHERE r.target_id = e.entity_id)")
def graph_orphans(spark, sf):
    gone = table(spark, sf, "orders").filter("o_orderstatus <> 'P'").select("o_orderkey")
    return graph.orphans(P.entities(spark, sf), P.held(spark, sf, gone))


ASKED = "Does Supplier 000000001 ship P12 to France, or P3?"


@query(_GRAPH + ", names AS (SELECT normalized_name AS key, entity_id FROM entities UNION SELECT normalized_name, entity_id FROM aliases), grams(key, start, length) AS (VALUES ('supplier 000000001', 1, 2), ('p12', 4, 1), ('france', 6, 1), ('p3', 8, 1)) SELECT entity_id, start, length FROM names JOIN grams USING (key)")
def graph_ngram_seeds(spark, sf):
    return graph.seeds(ASKED, graph.names(P.entities(spark, sf), P.aliases(spark, sf)))


@query(_GRAPH + f"SELECT DISTINCT entity_id FROM mentions WHERE chunk_id IN (SELECT {_cid('o_orderkey')} FROM (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10))")
def graph_chunk_seeds(spark, sf):
    best = table(spark, sf, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10).select("o_orderkey")
    near = P.near_orders(spark, sf, best)
    return P.mentions(near).select("entity_id").distinct()


@query("SELECT p_partkey, CASE lower(p_type) WHEN 'component' THEN 'Component' WHEN 'person' THEN 'Person' WHEN 'concept' THEN 'Concept' WHEN 'project' THEN 'Project' WHEN 'technology' THEN 'Technology' WHEN 'document' THEN 'Document' END AS type FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'concept' WHEN 2 THEN 'Component' ELSE p_type END AS p_type FROM part)")
def vocab_canonical(spark, sf):
    k = F.col("p_partkey") % 4
    kind = F.when(k == 0, "PERSON").when(k == 1, "concept").when(k == 2, "Component").otherwise(F.col("p_type"))
    return table(spark, sf, "part").select("p_partkey", graph.canonical(kind, graph.ENTITY_TYPES).alias("type"))


_EXTRACTED = "SELECT l_orderkey AS chunk_id, l_partkey AS a, l_suppkey AS b, l_linenumber AS n, l_quantity / 25 AS confidence, CASE l_linenumber % 3 WHEN 0 THEN 'USES' WHEN 1 THEN 'part-of' ELSE 'owns' END AS type FROM lineitem"


@query(f"""WITH x AS ({_EXTRACTED}), declared AS (SELECT DISTINCT chunk_id, 'p' || a AS key FROM x UNION SELECT DISTINCT chunk_id, 's' || b FROM x WHERE b % 2 = 0)
SELECT chunk_id, 'p' || a AS source, CASE type WHEN 'USES' THEN 'uses' ELSE type END AS type, 's' || b AS target, least(1, greatest(0, confidence))::DOUBLE AS confidence
FROM x WHERE type <> 'owns' AND (chunk_id, 's' || b) IN (SELECT chunk_id, key FROM declared)""")
def extraction_sanitize(spark, sf):
    x = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("chunk_id"),
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("source"),
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("target"),
        F.col("l_suppkey").alias("b"),
        (F.col("l_quantity") / 25).alias("confidence"),
        F.when(F.col("l_linenumber") % 3 == 0, "USES").when(F.col("l_linenumber") % 3 == 1, "part-of").otherwise("owns").alias("type"),
    )
    named = x.select("chunk_id", F.lit("component").alias("type"), F.explode(F.array("source", F.when(F.col("b") % 2 == 0, F.col("target")))).alias("name")).filter("name is not null").withColumn("position", F.lit(0))
    declared = graph.sanitized_entities(named, F.lower("name"))
    return graph.sanitized_relations(x, declared, F.lower("source"), F.lower("target")).select("chunk_id", "source", "type", "target", "confidence")


# Fusion and search

_ARMS = _BM25 + f""", kw AS (SELECT chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id) AS r FROM (SELECT * FROM scored ORDER BY score DESC, chunk_id LIMIT 50)),
v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT e AS q FROM v WHERE vec_id = 7),
vec AS (SELECT vec_id AS chunk_id, row_number() OVER (ORDER BY d, vec_id) AS r FROM (SELECT vec_id, round(list_distance(e, q), 9) AS d FROM v, q ORDER BY d, vec_id LIMIT 50)),
gr AS (SELECT doc_id AS chunk_id, row_number() OVER (ORDER BY quality DESC, doc_id) AS r FROM (SELECT doc_id, quality FROM labels ORDER BY quality DESC, doc_id LIMIT 50))
"""
_FUSE = """, fused AS (SELECT chunk_id, round(coalesce(1.0::DOUBLE / (60 + kw.r), 0) + coalesce(1.0::DOUBLE / (60 + vec.r), 0) + coalesce({} / (60 + gr.r), 0), 9) AS score,
 CAST(kw.r AS INTEGER) AS keyword_rank, CAST(vec.r AS INTEGER) AS vector_rank, CAST({} AS INTEGER) AS graph_rank FROM kw FULL JOIN vec USING (chunk_id) FULL JOIN {} USING (chunk_id)) """
_TWO = _ARMS + _FUSE.format("0::DOUBLE", "NULL", "(SELECT * FROM gr WHERE false) gr")
_THREE = _ARMS + _FUSE.format("0.7::DOUBLE", "gr.r", "gr")


def _arms(spark, sf) -> list[DataFrame]:
    kw = fusion.ranked(keyword.bm25_index(*P.keyword_index(spark, sf), TERMS), "keyword", "chunk_id", F.desc("score"))
    near = knn.knn(_vectors(spark, sf), _asked(spark, sf), fusion.CANDIDATES).withColumnRenamed("vec_id", "chunk_id")
    linked = table(spark, sf, "labels").select(F.col("doc_id").alias("chunk_id"), "quality")
    return [kw, fusion.ranked(near, "vector", "chunk_id", F.asc("distance")), fusion.ranked(linked, "graph", "chunk_id", F.desc("quality"))]


@query(_TWO + "SELECT * FROM fused")
def rrf_two_arms(spark, sf):
    return fusion.rrf(_arms(spark, sf)[:2])


@query(_THREE + "SELECT * FROM fused")
def rrf_three_arms(spark, sf):
    return fusion.rrf(_arms(spark, sf))


def _documents(spark, sf) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf, "documents")
    chunks = d.select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("document_id"), F.col("text").alias("content"), F.array("source", "lang").alias("heading_path"))
    return chunks, d.select(F.col("doc_id").alias("document_id"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.array(F.upper("lang"), "source").alias("tags"))


def _search(spark, sf, limit: int, tags: list[str] | None = None) -> DataFrame:
    chunks, documents = _documents(spark, sf)
    return fusion.hydrate(fusion.rrf(_arms(spark, sf)), chunks, documents, limit, tags)


_HYDRATED = ", full_ AS (SELECT chunk_id, score, source || '/' || doc_id || '.md — ' || source || ' > ' || lang AS citation, text AS content, lang, source FROM {} JOIN documents ON doc_id = chunk_id) "


@query(_THREE + _HYDRATED.format("(SELECT * FROM fused ORDER BY score DESC, chunk_id LIMIT 10)") + "SELECT chunk_id, score, citation, content FROM full_")
def search_hybrid(spark, sf):
    return _search(spark, sf, 10).select("chunk_id", "score", fusion.citation(F.col("path"), F.col("heading_path")).alias("citation"), "content")


@query(_THREE + _HYDRATED.format("fused") + "SELECT chunk_id, score, citation FROM full_ WHERE lang = 'en' ORDER BY score DESC, chunk_id LIMIT 10")
def search_with_tags(spark, sf):
    return _search(spark, sf, 10, ["EN"]).select("chunk_id", "score", fusion.citation(F.col("path"), F.col("heading_path")).alias("citation"))


@query(_THREE + _HYDRATED.format("(SELECT * FROM fused ORDER BY score DESC, chunk_id LIMIT 8)") + f""", sized AS (SELECT chunk_id, score, {_estimate('content')} AS tokens FROM full_),
packed AS (SELECT chunk_id, tokens, CAST(row_number() OVER w AS INTEGER) AS position, CAST(sum(tokens) OVER w AS BIGINT) AS used FROM sized WINDOW w AS (ORDER BY score DESC, chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT * FROM packed WHERE used <= 3000 OR position = 1""")
def answer_context(spark, sf):
    return fusion.context(_search(spark, sf, 8), 3000).select("chunk_id", "tokens", "position", F.col("used").cast("long").alias("used"))


# Queue, versions, diagnostics

_JOBS = """WITH RECURSIVE a AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'embed' ELSE 'extract' END AS kind, user_id::VARCHAR AS target_id, round(epoch_us(ts) / 1000000::DOUBLE, 6) AS at,
  CASE WHEN event_type IN ('purchase', 'signup') THEN 'success' WHEN event_type = 'error' THEN 'permanent' ELSE 'transient' END AS outcome, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
f AS (SELECT kind, target_id, 0::BIGINT AS i, 'pending' AS state, 0 AS attempts, 0::DOUBLE AS next_after FROM (SELECT DISTINCT kind, target_id FROM a)
  UNION ALL SELECT f.kind, f.target_id, a.i,
   CASE WHEN f.state IN ('done', 'failed') THEN f.state WHEN outcome = 'success' THEN 'done' WHEN outcome = 'permanent' AND f.attempts + 1 >= 3 THEN 'failed' ELSE 'pending' END,
   CASE WHEN f.state NOT IN ('done', 'failed') AND outcome = 'permanent' THEN f.attempts + 1 ELSE f.attempts END,
   CASE WHEN f.state IN ('done', 'failed') OR outcome = 'success' OR outcome = 'permanent' AND f.attempts + 1 >= 3 THEN f.next_after WHEN outcome = 'permanent' THEN a.at + least(300, 2 * pow(4, f.attempts)) ELSE a.at + 2 END
  FROM f JOIN a ON a.kind = f.kind AND a.target_id = f.target_id AND a.i = f.i + 1 WHERE f.state NOT IN ('done', 'failed')),
jobs AS (SELECT kind, target_id, state, attempts, next_after FROM f QUALIFY row_number() OVER (PARTITION BY kind, target_id ORDER BY i DESC) = 1)
"""


@query(_JOBS + "SELECT * FROM jobs")
def queue_fail_transition(spark, sf):
    return queue.folded(P.attempts(spark, sf))


@query(_JOBS + "SELECT kind, count(*) FILTER (state = 'pending') AS pending, count(*) FILTER (state = 'running') AS running, count(*) FILTER (state = 'failed') AS failed FROM jobs GROUP BY kind")
def queue_depth(spark, sf):
    return queue.depth(queue.folded(P.attempts(spark, sf)))


_EVENT_JOBS = "SELECT 'embed' AS kind, event_id::VARCHAR AS target_id, 'pending' AS state, round(epoch_us(ts) / 1000000::DOUBLE, 6) AS next_after FROM events WHERE event_type = 'error'"


def _event_jobs(spark, sf) -> DataFrame:
    at = F.round(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6, 6)
    return table(spark, sf, "events").filter("event_type = 'error'").select(F.lit("embed").alias("kind"), F.col("event_id").cast("string").alias("target_id"), F.lit("pending").alias("state"), F.lit(0).alias("attempts"), at.alias("next_after"), F.lit(None).cast("string").alias("last_error"), at.alias("created_at"))


@query(f"SELECT kind, target_id, next_after FROM ({_EVENT_JOBS}) WHERE next_after <= 1704672000 ORDER BY next_after, target_id LIMIT 16")
def queue_claim(spark, sf):
    return queue.claimable(_event_jobs(spark, sf), "embed", 16, 1704672000.0).select("kind", "target_id", "next_after")


@query("SELECT n AS attempts, least(300, 2 * pow(4, n - 1))::DOUBLE AS delay FROM (SELECT DISTINCT l_linenumber AS n FROM lineitem)")
def queue_backoff(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("attempts")).distinct().select("attempts", queue.backoff(F.col("attempts")).alias("delay"))


@query(f"SELECT coalesce(greatest(1, least(60, min(next_after) - 1704067200)), 5)::DOUBLE AS seconds FROM ({_EVENT_JOBS})")
def queue_next_due(spark, sf):
    return queue.next_due(_event_jobs(spark, sf), 1704067200.0)


_COVERED = "SELECT sha256(text) AS content_hash, CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN sha256(text) ELSE 'old' END AS embedded_hash, CASE WHEN doc_id % 5 = 0 THEN sha256(text) END AS extracted_hash FROM documents"


def _covered(spark, sf) -> DataFrame:
    h, k = ids.content_hash(F.col("text")), F.col("doc_id")
    return table(spark, sf, "documents").select(k.alias("chunk_id"), h.alias("content_hash"), F.when(k % 3 == 1, h).when(k % 3 == 2, F.lit("old")).alias("embedded_hash"), F.when(k % 5 == 0, h).alias("extracted_hash"))


@query(f"SELECT count(*) AS chunks, count(*) FILTER (embedded_hash = content_hash) AS embedded, count(*) FILTER (extracted_hash = content_hash) AS extracted FROM ({_COVERED})")
def coverage(spark, sf):
    return versions.coverage(_covered(spark, sf))


@query(_JOBS.replace("WITH RECURSIVE", f"WITH RECURSIVE c AS ({_COVERED}),") + ", s AS (SELECT count(*) FILTER (state = 'pending') AS pending, count(*) FILTER (state = 'failed') AS failed FROM jobs) SELECT (SELECT count(*) FROM c) AS chunks, (SELECT count(*) FROM c WHERE embedded_hash = content_hash) AS embedded, pending, failed FROM s")
def diagnostics(spark, sf):
    jobs = queue.folded(P.attempts(spark, sf)).agg(F.count_if(F.col("state") == "pending").alias("pending"), F.count_if(F.col("state") == "failed").alias("failed"))
    return versions.coverage(_covered(spark, sf)).select("chunks", "embedded").crossJoin(jobs)  # one row each


@query("""WITH stored(key, value) AS (VALUES ('schema', '1'), ('chunker', 'heading-1:64:512'), ('embedding_model', 'a'), ('extraction_vocabulary', 'x')),
running(key, value) AS (VALUES ('schema', '1'), ('chunker', 'heading-1:32:512'), ('embedding_model', 'b'), ('embedding_dimensions', '768'), ('extraction_vocabulary', 'x')),
actions(key, action) AS (VALUES ('chunker', 'rechunk'), ('embedding_model', 'reembed'), ('embedding_dimensions', 'reembed'), ('extraction_vocabulary', 'reextract'), ('schema', 'none'))
SELECT key, s.value AS stored, r.value AS running, action FROM running r JOIN stored s USING (key) JOIN actions USING (key) WHERE s.value <> r.value""")
def version_plan(spark, sf):
    kv = lambda **x: spark.createDataFrame([*x.items()], "key string, value string")
    stored = kv(schema="1", chunker="heading-1:64:512", embedding_model="a", extraction_vocabulary="x")
    running = kv(schema="1", chunker="heading-1:32:512", embedding_model="b", embedding_dimensions="768", extraction_vocabulary="x")
    return versions.plan(stored, running)


# Watching

_WATCH = """WITH e AS (SELECT ts, user_id || '.md' AS path, (props->>'$.k')::INT % 20 = 0 AS dropped FROM events),
g AS (SELECT *, sum(opens) OVER (ORDER BY ts) AS s FROM (SELECT *, coalesce(ts - lag(ts) OVER (ORDER BY ts) > INTERVAL {} MINUTE, true)::INT AS opens FROM e)),
w AS (SELECT min(ts) AS start, max(ts) + INTERVAL {} MINUTE AS "end", count(DISTINCT path) AS n_paths, bool_or(dropped) AS dropped, string_agg(DISTINCT path, ',' ORDER BY path) AS paths FROM g GROUP BY s)
""".format


@query(_WATCH(1, 1) + """SELECT start, "end", CAST(n_paths AS INTEGER) AS n_paths FROM w""")
def watch_debounce(spark, sf):
    d = watch.debounced(P.watched(spark, sf), "1 minute", 1 << 30)
    return d.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n_paths")


@query(_WATCH(2, 2) + "SELECT start, CASE WHEN dropped OR n_paths >= 3 THEN 'bulk' ELSE 'changed' END AS kind, CASE WHEN dropped OR n_paths >= 3 THEN '' ELSE paths END AS paths FROM w")
def watch_burst(spark, sf):
    d = watch.debounced(P.watched(spark, sf), "2 minutes", 3)
    return d.select(F.col("start").cast("timestamp_ntz").alias("start"), "kind", F.array_join("paths", ",").alias("paths"))


@query("SELECT doc_id, path FROM (SELECT doc_id, source || '/' || lang || '/' || CASE doc_id % 4 WHEN 0 THEN '.' ELSE '' END || doc_id || CASE doc_id % 3 WHEN 0 THEN '.MD' WHEN 1 THEN '.draft.md' ELSE '.md' END AS path, lang FROM documents) WHERE doc_id % 4 <> 0 AND doc_id % 3 <> 1 AND lang <> 'de'")
def watch_ignore(spark, sf):
    k = F.col("doc_id")
    name = F.concat("source", F.lit("/"), "lang", F.lit("/"), F.when(k % 4 == 0, ".").otherwise(""), k.cast("string"), F.when(k % 3 == 0, ".MD").when(k % 3 == 1, ".draft.md").otherwise(".md"))
    return table(spark, sf, "documents").select("doc_id", name.alias("path")).filter(watch.accepted(F.col("path"), ["*.draft.md", "/de/"]))
