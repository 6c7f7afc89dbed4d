"""MinHash near-dedup on bottom-k sketches of one hash function.

1. Every document's shingles (runs of SHINGLE words) are hashed once; the K
   smallest distinct values are its sketch. Documents with the same shingle set
   are copies (similarity 1) and go on as one representative.
2. Inverted lists of retained values generate overlaps. A pair whose union
   sketch shows the least admitted similarity shares at least
   ``ceil(e * s)`` of the s values of each side, so each document lists only
   its ``s - ceil(e * s) + MEETINGS`` rarest values (document frequency, then value);
   an admitted pair meets in MEETINGS lists then, and passages that many documents share come last.
3. In each list the most central member meets all others; then, over lists
   whose members are still in several groups, the pairs across groups
   meet too, if they do so often enough and where their sizes say. Members of one group need no further comparison: the groups come
   out the same, and a group of n copies costs about n comparisons.
4. Union-sketch estimates filter pairs; exact Jaccard similarity verifies them.
5. Groups are the connected components.

Cases: a null text is an empty one; a text without words is in no group. Rows
without doc_id are ignored. Rows that repeat a doc_id are one document, for which the row of the
lowest digest speaks. Ties go to the lowest doc_id. Very long texts are read whole. An empty table gives an empty result. Other columns,
whatever their names, are kept by keep_one() and not read otherwise.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _shared as S
from ._text import U64, Grid, blocks, handled, shingle_sets

SHINGLE = 2
K = 64
THRESHOLD = 0.6
#: The estimate's standard deviation at the threshold is 0.061; 2.5 of them below it are admitted to verification.
SLACK = 0.15
#: A pair across groups must meet in so many lists; each document lists as many values more.
MEETINGS = 4
#: Edges that the driver may join at once; more are joined on the cluster.
DRIVER_EDGES = 2_000_000
#: A sketch value in more than this share of the documents has its frequency handed out by broadcast (at most K / share values).
HOT_SHARE = 1e-4

#: Bytes of shingle sets that one portion of an owner's comparisons holds.
PORTION = 8 << 20


def sketches(docs: DataFrame, shingle: int = SHINGLE, k: int = K) -> DataFrame:
    """(doc_id, sig, n, sketch): the digest and size of each shingle set and its k smallest hashes, of rows with words."""
    import hashlib

    def run(batches):
        for batch in batches:
            for b in blocks(batch, "text"):
                ids, sigs, ns, sk = [], [], [], []
                for doc, s in zip(b.column("doc_id").to_pylist(), shingle_sets(Grid(b.column("text")), shingle)):
                    if doc is not None and len(s):
                        ids.append(doc)
                        sigs.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                        ns.append(len(s))
                        sk.append((s[:k] ^ U64(1 << 63)).view(np.int64))  # signed order is now the hashes' order
                if ids:
                    off = np.cumsum([0, *map(len, sk)]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sigs, pa.binary()), pa.array(ns, pa.int32()), pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(sk)))], ["doc_id", "sig", "n", "sketch"])

    return S.texts(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, sig binary, n int, sketch array<long>")


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, lengths of their sketches, and all values one after another."""
    lists = batch.column("sketch")
    flat = lists.flatten().to_numpy(zero_copy_only=False).view(U64)
    return batch.column("doc_id").to_numpy(zero_copy_only=False), np.asarray(lists.value_lengths()), flat


def admitted(s: int | np.ndarray, threshold: float, slack: float):
    """Values of a sketch of s that a list must hold."""
    return s - np.ceil((threshold - slack) * s - 1e-9).astype(np.int64) + 1


_PAIR = np.dtype([("v", "u8"), ("doc", "i8")])
_FREQ = np.dtype([("doc", "i8"), ("v", "u8"), ("df", "i8")])
_LIST = np.dtype([("v", "u8"), ("doc", "i8"), ("central", "f8"), ("place", "i4"), ("s", "i4"), ("n", "i4")])


def lists(reps: DataFrame, threshold: float, slack: float) -> DataFrame:
    """(v, doc, central, place, s, n): the inverted lists with at least two members, made of every document's rarest values.

    place: the value's rank among the document's s, rarest first; n: the size of its shingle set.
    """
    spark = reps.sparkSession
    n = S.buckets(spark)
    total = reps.count()
    hot_least = max(1000, int(total * HOT_SHARE))

    def count(batches):
        p = S.Packer(n)
        for b in batches:
            v, c = np.unique(_flat(b)[2], return_counts=True)
            rec = np.empty(len(v), np.dtype([("v", "u8"), ("c", "i8")]))
            rec["v"], rec["c"] = v, c
            yield from p.add(v, rec[:])
        yield from p.flush()

    def sums(rec):
        rec = rec[np.argsort(rec["v"], kind="stable")]
        at, _ = S.groups(rec["v"])
        c = np.add.reduceat(rec["c"], at) if len(at) else np.zeros(0, np.int64)
        hot = c >= hot_least
        return pa.table({"v": rec["v"][at][hot].view(np.int64), "df": c[hot]})

    hot_rows = S.by_bucket(reps.mapInArrow(count, S.PACKED), sums, np.dtype([("v", "u8"), ("c", "i8")]), "v long, df long").toArrow() if total >= hot_least else pa.table({"v": np.zeros(0, np.int64), "df": np.zeros(0, np.int64)})
    hot_v = hot_rows.column("v").to_numpy().view(U64)
    order = np.argsort(hot_v)
    hot = spark.sparkContext.broadcast((hot_v[order], hot_rows.column("df").to_numpy()[order]))

    def spread(batches):  # values to their lists, hot ones straight to frequencies
        p = S.Packer(n)
        for b in batches:
            docs, sizes, flat = _flat(b)
            rec = np.empty(len(flat), _PAIR)
            rec["v"], rec["doc"] = flat, np.repeat(docs, sizes)
            hv = hot.value[0]
            if len(hv):
                i = np.minimum(np.searchsorted(hv, flat), len(hv) - 1)
                rec = rec[hv[i] != flat]
            yield from p.add(rec["v"], rec)
        yield from p.flush()

    def frequencies(rec):  # only values of two documents or more go on, to their documents
        rec = rec[np.argsort(rec["v"], kind="stable")]
        at, size = S.groups(rec["v"])
        df = np.repeat(size, size)
        keep = df > 1
        out = np.empty(int(keep.sum()), _FREQ)
        out["doc"], out["v"], out["df"] = rec["doc"][keep], rec["v"][keep], df[keep]
        parts = list(S.pack((out["doc"] % n).astype(np.int32), out))
        return pa.Table.from_batches(parts) if parts else pa.table({"bucket": pa.array([], pa.int32()), "blob": pa.array([], pa.binary())})

    def hot_part(batches):
        p = S.Packer(n)
        for b in batches:
            docs, sizes, flat = _flat(b)
            whole = b.column("n").to_numpy(zero_copy_only=False).astype(U64)
            hv, hd = hot.value
            own = np.repeat(docs, sizes)
            i = np.minimum(np.searchsorted(hv, flat), max(len(hv) - 1, 0))
            is_hot = (hv[i] == flat) if len(hv) else np.zeros(len(flat), bool)
            rec = np.empty(int(is_hot.sum()) + len(docs), _FREQ)
            rec["doc"][: len(docs)], rec["v"][: len(docs)], rec["df"][: len(docs)] = docs, sizes.astype(U64) | whole << U64(16), 0  # df 0: the sizes of sketch and set
            rec["doc"][len(docs) :], rec["v"][len(docs) :] = own[is_hot], flat[is_hot]
            rec["df"][len(docs) :] = hd[i[is_hot]] if len(hv) else 0
            yield from p.add((rec["doc"] % n).astype(U64), rec)
        yield from p.flush()

    def rarest(rec):  # per document: how many of its rarest values are listed, and which of them have company
        rec = rec[np.lexsort((rec["v"], rec["df"], rec["doc"]))]
        at, size = S.groups(rec["doc"])
        s, whole = (rec["v"][at] & U64(0xFFFF)).astype(np.int64), (rec["v"][at] >> U64(16)).astype(np.int64)  # the df 0 record comes first
        shared = size - 1
        take = np.clip(admitted(s, threshold, slack) + MEETINGS - 1 - (s - shared), 0, shared)
        pos = np.arange(len(rec)) - np.repeat(at, size)
        keep = (pos >= 1) & (pos <= np.repeat(take, size))
        central = np.repeat(np.add.reduceat(rec["df"].astype(np.float64), at) if len(at) else np.zeros(0), size)
        out = np.empty(int(keep.sum()), _LIST)
        out["v"], out["doc"], out["central"] = rec["v"][keep], rec["doc"][keep], central[keep]
        out["place"] = (pos + np.repeat(s - shared, size))[keep]
        out["s"], out["n"] = np.repeat(s, size)[keep], np.repeat(whole, size)[keep]
        parts = list(S.pack((out["v"] % U64(n)).astype(np.int32), out))
        return pa.Table.from_batches(parts) if parts else pa.table({"bucket": pa.array([], pa.int32()), "blob": pa.array([], pa.binary())})

    def members(rec):
        rec = rec[np.lexsort((rec["doc"], rec["v"]))]
        _, size = S.groups(rec["v"])
        rec = rec[np.repeat(size, size) > 1]
        return pa.table({"v": rec["v"].view(np.int64), **{x: rec[x] for x in ("doc", "central", "place", "s", "n")}})

    freq = S.by_bucket(reps.mapInArrow(spread, S.PACKED), frequencies, _PAIR, S.PACKED)
    freq = freq.unionByName(reps.mapInArrow(hot_part, S.PACKED))
    listed = S.by_bucket(freq, rarest, _FREQ, S.PACKED)
    return S.by_bucket(listed, members, _LIST, "v long, doc long, central double, place int, s int, n int")


def hub_pairs(members: DataFrame, meetings: int = 1) -> DataFrame:
    """(a, b, owner): each list's most central member (then the lowest id) with each other member, if they meet so in enough lists."""
    hub = members.groupBy("v").agg(F.max(F.struct("central", (-F.col("doc")).alias("id"))).alias("hub"))
    both = members.join(hub, "v").select((-F.col("hub.id")).alias("h"), "doc").filter("h <> doc")
    return both.groupBy(F.least("h", "doc").alias("a"), F.greatest("h", "doc").alias("b")).agg(F.count("*").alias("met"), F.min("h").alias("owner")).filter(F.col("met") >= meetings).select("a", "b", "owner")


def counted_pairs(members: DataFrame, labels: DataFrame, threshold: float, slack: float) -> DataFrame:
    """Pairs in different groups that meet often enough, early enough, and are near enough in size.

    Sets of n and r * n shingles (r at most 1) that are similar enough share a part
    f = t / (1 + t) * (1 + r) of the larger one, so of its s sketch values about s * f are in both sketches;
    o is that less 2.5 standard deviations, and at least what admission asks of either sketch. Then at least MEETINGS values are in both
    documents' first s - o + MEETINGS ones (all that are shared, if o is less).
    """
    m = _mixed(members, labels)
    a = m.select("v", *(F.col(x).alias(f"{x}_a") for x in ("doc", "label", "place", "s", "n")))
    b = m.select("v", *(F.col(x).alias(f"{x}_b") for x in ("doc", "label", "place", "s", "n")))
    low, high = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    f = F.lit(threshold / (1 + threshold)) * (1 + low / high)
    s = F.when(F.col("n_a") >= F.col("n_b"), F.col("s_a")).otherwise(F.col("s_b"))
    asked = F.ceil((threshold - slack) * F.greatest("s_a", "s_b") - 1e-9)
    o = F.greatest(F.lit(1), asked, F.ceil(s * f - 2.5 * F.sqrt(F.greatest(F.lit(0.0), s * f * (1 - f))) - 1e-9))
    need = F.least(F.lit(MEETINGS), o)
    early = (F.col("place_a") <= F.col("s_a") - o + need) & (F.col("place_b") <= F.col("s_b") - o + need)
    both = a.join(b, "v").filter((F.col("doc_a") < F.col("doc_b")) & (F.col("label_a") != F.col("label_b")) & (low >= high * threshold - 1e-9) & early)
    met = both.groupBy(F.col("doc_a").alias("a"), F.col("doc_b").alias("b")).agg(F.count("*").alias("met"), F.min(need).alias("need"))
    return met.filter("met >= need").select("a", "b", F.col("a").alias("owner"))


def _mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members with their groups, of the lists that hold several groups."""
    m = members.join(labels.withColumnRenamed("id", "doc"), "doc", "left").withColumn("label", F.coalesce("label", "doc"))
    mixed = m.groupBy("v").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("v")
    return m.join(mixed, "v", "left_semi")


def cross_pairs(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs of one list in different groups."""
    m = _mixed(members, labels).select("v", "doc", "label")
    n = m.select("v", F.col("doc").alias("b"), F.col("label").alias("lb"))
    return m.select("v", F.col("doc").alias("a"), F.col("label").alias("la")).join(n, "v").filter("a < b and la <> lb").select("a", "b", F.col("a").alias("owner")).distinct()


def verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, shingle: int, k: int, threshold: float, slack: float, repeated: bool) -> DataFrame:
    """(a, b, similarity) of the pairs (a, b, owner) whose union sketch admits them and whose exact similarity reaches the threshold.

    Each text is read once. Its shingle set goes to the owners that it is compared with, and an owner's own set to each
    portion (of about PORTION bytes) of what is compared with it, so an owner of very many pairs is no single task's work.
    """
    spark = docs.sparkSession
    for x in "ab":
        pairs = pairs.join(reps.select(F.col("doc_id").alias(x), F.col("sketch").alias(f"s{x}"), F.col("n").alias(f"n{x}")), x)
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    common = F.size(F.array_intersect(union, F.array_intersect("sa", "sb")))
    near = (common >= (threshold - slack) * F.size(union) - 1e-9) & (F.least("na", "nb") >= F.greatest("na", "nb") * threshold - 1e-9)
    other = F.when(F.col("owner") == F.col("a"), F.struct(F.col("b").alias("doc"), F.col("nb").alias("n"))).otherwise(F.struct(F.col("a").alias("doc"), F.col("na").alias("n")))
    admit = S.cut(pairs.filter(near).select("owner", other.alias("o")).select("owner", "o.doc", "o.n"))
    owners = S.cut(admit.groupBy("owner").agg(F.ceil(F.sum("n") * 8 / PORTION).cast("int").alias("portions"), F.sum("n").alias("size")))
    total = owners.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0] * 8
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PORTION))
    bucket = F.pmod(F.xxhash64("owner", "portion"), F.lit(buckets)).cast("int").alias("bucket")
    member = admit.join(S.small(owners), "owner").select("doc", "owner", F.pmod(F.xxhash64("doc"), F.col("portions")).cast("int").alias("portion"))
    own = owners.select(F.col("owner").alias("doc"), "owner", F.explode(F.sequence(F.lit(0), F.col("portions") - 1)).alias("portion"))
    goals = member.unionByName(own).select("doc", F.struct("owner", bucket).alias("goal")).groupBy("doc").agg(F.collect_set("goal").alias("goals"))
    if repeated:  # of the rows that repeat a doc_id, the one whose digest speaks for it
        goals = goals.join(reps.select(F.col("doc_id").alias("doc"), "sig"), "doc")
    goals = S.cut(goals)
    kept = ["doc", "text", "goals", *(["sig"] if repeated else [])]
    read = S.texts(docs).select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text"))

    def spread(batches):
        import hashlib

        for batch in batches:
            for b in blocks(batch, "text"):
                docs_of, sets = b.column("doc").to_pylist(), list(shingle_sets(Grid(b.column("text")), shingle))
                keep = np.array([not repeated or hashlib.blake2b(s.tobytes(), digest_size=16).digest() == b.column("sig")[i].as_py() for i, s in enumerate(sets)], bool)
                goals = b.column("goals")
                row = np.repeat(np.arange(len(b)), np.asarray(goals.value_lengths()))
                flat = goals.flatten()
                use = keep[row]
                row, to = row[use], flat.filter(pa.array(use))
                blobs = [s.tobytes() for s in sets]
                for a in range(0, len(row), 256):  # few at a time: one text may go to many owners
                    r = row[a : a + 256]
                    yield pa.RecordBatch.from_arrays([to.field("bucket")[a : a + 256], to.field("owner")[a : a + 256], pa.array([docs_of[i] for i in r], pa.int64()), pa.array([blobs[i] for i in r], pa.binary())], ["bucket", "owner", "doc", "set"])

    def compare(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        owner, doc, sets = t.column("owner").to_numpy(), t.column("doc").to_numpy(), t.column("set").chunks[0] if len(t) else []
        order = np.lexsort((doc, owner))
        at, size = S.groups(owner[order])
        of = lambda i: np.frombuffer(sets[i].as_buffer(), U64)
        out = []
        for a, n in zip(at, size):
            mine = order[a : a + n]
            whole = of(next(i for i in mine if doc[i] == owner[i]))
            before = None
            for i in mine:
                if doc[i] == owner[i] or doc[i] == before:  # equal rows may come twice
                    continue
                before, x = doc[i], of(i)
                both = int((whole[np.minimum(np.searchsorted(whole, x), len(whole) - 1)] == x).sum())
                j = both / (len(x) + len(whole) - both)
                if j >= threshold - 1e-12:
                    out.append((min(doc[i], owner[i]), max(doc[i], owner[i]), j))
        handled(t.nbytes)
        a, b, j = zip(*out) if out else ((), (), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "similarity": pa.array(j, pa.float64())})

    sent = read.join(S.small(goals), "doc").select(*kept).mapInArrow(spread, "bucket int, owner long, doc long, set binary")
    out = S.cut(sent.groupBy("bucket").applyInArrow(compare, "a long, b long, similarity double"))
    S.drop(admit, owners, goals)
    return out


def components(edges: DataFrame, most: int = DRIVER_EDGES) -> DataFrame:
    """(id, label): the lowest id of the connected component of each end of the edges (a, b)."""
    spark = edges.sparkSession
    if edges.count() <= most:
        t = edges.select("a", "b").toArrow()
        a, b = t.column("a").to_numpy(), t.column("b").to_numpy()
        ids = np.unique(np.concatenate([a, b]))
        a, b = np.searchsorted(ids, a), np.searchsorted(ids, b)
        label = np.arange(len(ids))
        while True:
            low = np.minimum(label[a], label[b])
            new = label.copy()
            for x in (a, b, label[a], label[b]):
                np.minimum.at(new, x, low)
            new = new[new]
            if (new == label).all():
                break
            label = new
        return spark.createDataFrame(pa.table({"id": ids.astype(np.int64), "label": ids[label].astype(np.int64)}))
    both = S.cut(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    label = S.cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = both.join(label.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        step = label.join(near, "id").select("id", "label", F.least("label", "near").alias("to"))
        jump = label.select(F.col("id").alias("to"), F.col("label").alias("far"))
        step = S.cut(step.join(jump, "to").select("id", F.col("label").alias("old"), F.least("to", "far").alias("label")))
        moved = step.filter("old <> label").limit(1).count()
        S.drop(label)
        label = step.drop("old")
        label._noteloom_path = step._noteloom_path
        if not moved:
            S.drop(both)
            return label


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, k: int = K, threshold: float = THRESHOLD, slack: float = SLACK, driver_edges: int = DRIVER_EDGES) -> DataFrame:
    """(doc_id, group_id, kept) of every document in a group of two or more; group_id is the lowest doc_id, the one kept."""
    sk = S.cut(sketches(docs, shingle, k))
    rows, ids = sk.agg(F.count("*"), F.count_distinct("doc_id")).first()
    repeated = rows > ids
    one = sk.groupBy("doc_id").agg(F.min(F.struct("sig", "n", "sketch")).alias("x")).select("doc_id", "x.*") if repeated else sk
    # Copies: one representative for each digest.
    rep = S.cut(one.groupBy("sig").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
    reps = S.cut(one.join(rep.select("sig", F.col("rep").alias("doc_id")), ["doc_id", "sig"], "left_semi"))
    digests = S.cut(one.select("doc_id", "sig"))
    S.drop(sk)
    members = S.cut(lists(reps, threshold, slack))
    pairs = S.cut(hub_pairs(members, 2))
    edges = verified(pairs, reps, docs, shingle, k, threshold, slack, repeated)
    labels = S.cut(components(edges, driver_edges))
    rest = S.cut(counted_pairs(members, labels, threshold, slack))
    S.drop(members, pairs)
    if not rest.isEmpty():
        more = verified(rest, reps, docs, shingle, k, threshold, slack, repeated)
        S.drop(labels)
        labels = S.cut(components(edges.unionByName(more), driver_edges))
        S.drop(more)
    S.drop(reps, rest, edges)
    of_rep = rep.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("sig", "copies", F.col("label").isNotNull().alias("near"), F.coalesce("label", "rep").alias("group_id"))
    of_rep = of_rep.filter("copies > 1 or near").drop("copies", "near")
    out = S.cut(digests.join(of_rep, "sig").select("doc_id", "group_id", (F.col("doc_id") == F.col("group_id")).alias("kept")))
    S.drop(digests, rep, labels)
    return out


def keep_one(docs: DataFrame, **params) -> DataFrame:
    """docs without all but one document of each group; rows that repeat a doc_id of a group stay once, as the row whose values come first."""
    found = near_duplicates(docs, **params)
    key = S.fresh(docs, "id")
    gone = S.cut(found.filter("not kept").select(F.col("doc_id").alias(key)))
    S.drop(found)
    left = docs.join(S.small(gone), F.col("doc_id").cast("long") == F.col(key), "left_anti")
    ids = S.cut(docs.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias(key)).count().filter("count > 1").select(key))
    if ids.isEmpty():
        S.drop(ids)
        return left
    again = F.col("doc_id").cast("long") == F.col(key)
    single = left.join(ids, again, "left_anti")
    return single.unionByName(left.join(ids, again, "left_semi").dropDuplicates(["doc_id"]))
