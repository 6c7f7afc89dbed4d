"""Near-dedup, embedding codes, quality, toxicity and the pipeline against brute force and held-out labels; the stated cases."""

import brute
import numpy as np
import oracle
import pyarrow as pa
import pytest

import corpus_pipeline
from noteloom.llm import decontaminate, embedding_dedup, near_dedup, packing, pii, quality, queries, toxicity

EMPTY = [(1, None), (2, ""), (3, "  \n "), (None, "words without any id at all")]


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, group_id string")


# Near-dedup


def test_near_dedup_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    want, pairs = brute.jaccard_groups(rows, near_dedup.THRESHOLD)
    got = brute.found_groups(queries.op1_near_dedup(spark, "/root/testdata/sf0.01").collect())
    at = {d: k for k, g in enumerate(got) for d in g}
    assert sum(a in at and at[a] == at.get(b) for a, b in pairs) >= 0.95 * len(pairs)
    assert not [g for g in got if not any(g <= w for w in want)]


def test_near_dedup_cases(spark):
    base = " ".join(f"word{i}" for i in range(300))
    long = " ".join(f"t{i % 5000}u{i}" for i in range(40_000))
    rows = [*EMPTY, (10, base), (11, base + " tail"), (12, base.replace("word7 ", "other ")), (13, "Word0 " + base[6:]), (20, "two words"), (21, "Two, words!"), (30, long), (31, long + " end"), (40, base), (40, base)]
    rows += [(100 + i, " ".join(f"word{j}" if j != i else "new" for j in range(300))) for i in range(60)] + [(500, "solo text that nobody shares")]
    docs = _docs(spark, rows)
    found = near_dedup.near_duplicates(docs, driver_edges=5).collect()
    assert brute.found_groups([r.asDict() for r in found]) == {frozenset({10, 11, 12, 13, 40, *range(100, 160)}), frozenset({20, 21}), frozenset({30, 31})}
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=lambda x: (x is None, x)) == [1, 2, 3, 10, 20, 30, 500, None]
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0 and near_dedup.keep_one(docs.limit(0)).count() == 0


# Embeddings


def test_codes_are_unbiased_and_bounded():
    rng = np.random.default_rng(1)
    a = rng.standard_normal((400, 64))
    b = 0.9 * a + 0.4 * rng.standard_normal((400, 64))
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b))
    t = pa.table({"vec_id": list(range(400)), "embedding": pa.array(a.astype(np.float32).tolist(), pa.list_(pa.float32()))})
    batch = t.to_batches()[0]
    ((at, x),) = embedding_dedup.by_dim(batch.column("vec_id"), batch.column("embedding"))
    code = np.concatenate([np.packbits(x @ embedding_dedup.rotation(64, k).T > 0, axis=1) for k in range(4)], 1)
    factor = np.stack([np.abs(x @ embedding_dedup.rotation(64, k).T).sum(1) / 8 for k in range(4)], 1)
    est, spread = embedding_dedup.estimate(code, factor, b.astype(np.float32))
    off = est - (a * b).sum(1)
    assert abs(off.mean()) < 0.01 and (np.abs(off) <= embedding_dedup.BOUND * spread).mean() > 0.999


def test_embedding_groups_reach_the_recall(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((700, 64))
    rows = [c + s * rng.standard_normal(64) for c in centres for s in (0, 0.12, 0.2, 0.28)]
    e = np.array(rows, np.float32)
    df = spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(e)], "vec_id long, embedding array<float>")
    got = embedding_dedup.near_duplicates(df).collect()
    at = {r.vec_id: r.group_id for r in got}
    u = e / np.linalg.norm(e, axis=1, keepdims=True)
    i, j = np.nonzero(np.triu(u.astype(np.float64) @ u.T.astype(np.float64) >= embedding_dedup.THRESHOLD, 1))
    hit = sum(a in at and at[a] == at.get(b) for a, b in zip(i.tolist(), j.tolist()))
    assert len(i) > 1000 and hit >= 0.95 * len(i)
    assert brute.found_groups([r.asDict() for r in got], "vec_id") <= {frozenset(g) for g in brute.groups(range(len(e)), zip(i.tolist(), j.tolist()))} or hit < len(i)


def test_embedding_cases(spark):
    v = [1.0, 2.0, 3.0, 4.0, -1.0, 0.5, 0.25, 2.0]
    rows = [(1, v), (2, v), (2, v), (3, [2 * x for x in v]), (4, None), (5, []), (6, [0.0] * 8), (7, [float("nan")] + v[1:]), (8, [None] + v[1:]), (None, v), (9, v[:4]), (10, v[:4]), (11, [-x for x in v])]
    df = spark.createDataFrame([(i, x, 1) for i, x in rows], "vec_id long, embedding array<float>, sig int")
    assert brute.found_groups([r.asDict() for r in embedding_dedup.near_duplicates(df).collect()], "vec_id") == {frozenset({1, 2, 3}), frozenset({9, 10})}
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


# Quality


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.scores(docs, labels.filter("doc_id % 2 = 0")).join(labels.filter("doc_id % 2 = 1"), "doc_id").toPandas()
    low, high = got[got.quality == 0], got[got.quality == 1]
    # about a fifth of the documents labelled low here are sound prose: these labels are noisy
    assert len(low) > 100 and (~low.keep).mean() > 0.75 and high.keep.mean() > 0.97


def test_quality_votes_equal_brute_force():
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "Delta!", "42", "ÉTÉ"], 30)) for _ in range(60)]
    c = quality.counts(pa.array(texts))
    ids, q = np.arange(40) * 2, np.arange(40) % 2
    voter = quality.Voter(ids, q, c[:40], 60, (c > 0).sum(0), rank=8, neighbours=5)
    got = voter.score(np.where(np.arange(60) < 40, np.arange(60) * 2, -1), c)
    d = quality.unit(quality.weighted(c, voter.idf) @ voter.v)
    for k in range(60):
        sim = sorted((-round(float(d[k] @ z), 6), i) for i, z in zip(ids, voter.z) if not (k < 40 and i == k * 2))[:5]
        w = [max(0, -s) for s, _ in sim]
        assert abs(got[k] - sum(a * q[i // 2] for a, (_, i) in zip(w, sim)) / sum(w)) < 1e-3


def test_quality_cases(spark):
    good = " ".join(f"plain sentence number {i}." for i in range(20))
    bad = "!! @@ ## " * 60
    rows = [*EMPTY, *((10 + i, good + f" {i}") for i in range(10)), *((30 + i, bad + f"{i}") for i in range(10)), (10, good), (50, (good + " ") * 3000)]
    docs = _docs(spark, rows)
    labels = spark.createDataFrame([*((10 + i, 1) for i in range(9)), *((30 + i, 0) for i in range(9)), (19, 0), (19, 1), (31, None), (None, 1)], "doc_id long, quality int")
    got = {(r.doc_id, r.keep) for r in quality.scores(docs, labels, neighbours=5).collect()}
    assert {(10, True), (19, True), (50, True), (39, False), (1, False), (2, False)} <= got and not {(10, False), (30, True)} & got
    kept = quality.keep_good(docs, labels, neighbours=5)
    assert kept.columns == docs.columns and kept.filter("doc_id between 10 and 19").count() == 11 and kept.filter("doc_id between 30 and 39 or doc_id < 10").count() == 0
    none = quality.scores(docs, labels.limit(0)).collect()
    assert all(r.score is None for r in none) and {r.doc_id for r in none if not r.keep} == {1, 2}
    assert quality.scores(docs.limit(0), labels).count() == 0


# Toxicity


def _toxic_table(spark):
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("aeinorst"), rng.integers(2, 8))) for _ in range(400)]
    text = lambda: " ".join(rng.choice(words, 40))
    rows, labels = [], []
    for i in range(300):
        t = text()
        if i % 5 == 0:
            bad = ["dumbhead", "scoundrel"][i // 5 % 2]
            t = t[:60] + f" {bad} " + t[60:]
        rows.append((i, t))
        labels.append((i, int(i % 5 == 0)))
    return rows, labels, text


def test_toxicity_sees_through_the_channel(spark):
    rows, labels, text = _toxic_table(spark)
    hidden = ["DUMBHEAD", "dumbh3ad", "d u m b h e a d", "d.u.m.b.h.e.a.d", "duuuumbhead", "sc0undr3l", "$coundrel", "s-c-o-u-n-d-r-e-l", "dumbheads"]
    rows += [(1000 + k, f"{text()} {h} {text()}") for k, h in enumerate(hidden)] + [(2000 + k, text()) for k in range(30)] + [(2100, "x" * 100_000), (2101, text() + " 1 2 3 4 5 a b c"), *EMPTY, (0, None)]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, score double")
    lab = spark.createDataFrame([*labels, (1, 1), (None, 1), (7, None)], "doc_id long, toxic int")
    got = {}
    for r in toxicity.scores(docs, lab).collect():
        got.setdefault(r.doc_id, []).append(r.toxic)
    assert all(got[1000 + k] == [True] for k in range(len(hidden))), [h for k, h in enumerate(hidden) if not got[1000 + k][0]]
    assert not any(got[2000 + k][0] for k in range(30)) and got[2100] == [False] and got[1] == [False, False] and got[2] == [False, False]
    assert sorted(got[0]) == [False, True]
    assert all(got[i] == [i % 5 == 0] for i in range(4, 300))
    assert not toxicity.scores(docs, lab.limit(0)).filter("toxic").count() and toxicity.scores(docs.limit(0), lab).count() == 0


def test_toxicity_on_the_test_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.scores(docs, labels.filter("doc_id % 2 = 0")).join(labels.filter("doc_id % 2 = 1").withColumnRenamed("toxic", "label"), "doc_id").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert got[got.label == 0].toxic.mean() < 0.02 and got[got.label == 1].toxic.mean() > 0.85
    for lang in ("de", "fr", "es"):  # no language is a sign of toxicity
        assert got[(got.label == 0) & (got.lang == lang)].toxic.mean() < 0.08, lang  # some documents with toxic words are labelled clean here
    flagged = queries.op5_toxicity(spark, sf).toPandas()
    assert list(flagged.columns) == ["doc_id", "score"] and 0 < len(flagged) < 2000 and (flagged.score >= toxicity.THRESHOLD).all()


def test_toxic_words_are_caught_in_every_language(spark):
    """Planted words in four made-up languages, one of which has more toxic documents than the others."""
    rng = np.random.default_rng(8)
    letters = {"a": "aeinorst", "b": "bduiknm", "c": "éèeaqvl", "d": "öüäßchg"}
    words = {k: ["".join(rng.choice(list(v), rng.integers(2, 8))) for _ in range(300)] for k, v in letters.items()}
    bad = {"a": ["dumbhead", "scoundrel"], "b": ["nitwit", "buffoon"], "c": ["crétinal", "idiotèse"], "d": ["schurkig", "dummbatz"]}
    text = lambda k, n=40: " ".join(rng.choice(words[k], n))
    rows, labels, i = [], [], 0
    for k in letters:
        for j in range(240):
            every = 3 if k == "c" else 8
            toxic = j % every == 0
            rows.append((i, f"{text(k)} {bad[k][j // every % 2]} {text(k)}" if toxic else text(k, 80)))
            labels.append((i, int(toxic)))
            i += 1
    hide = [lambda w: w, str.upper, lambda w: w + "s", lambda w: " ".join(w), lambda w: ".".join(w), lambda w: w.replace("i", "1"), lambda w: w.replace("o", "0"), lambda w: w[:3] + w[3] * 4 + w[4:]]
    planted = [(10_000 + n, f"{text(k)} {h(w)} {text(k)}") for n, (k, w, h) in enumerate((k, w, h) for k in letters for w in bad[k] for h in hide)]
    clean = [(20_000 + n, text(k, 120)) for n, k in enumerate(list(letters) * 40)]
    docs = spark.createDataFrame(rows + planted + clean, "doc_id long, text string")
    found = {r.doc_id for r in toxicity.flagged(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert len(found & {i for i, _ in planted}) >= 0.95 * len(planted) and not found & {i for i, _ in clean}


def test_long_words_and_runs_are_read_whole():
    language = toxicity.Language(*toxicity.grams("loooong words of the text\nworthlessness worthlessly"))
    assert any(x == "o" * 9 for x, _ in toxicity.lattice("l" + "o" * 9)[1]) and any(x == "t" * 9 for x, _ in toxicity.lattice("a" + "+" * 9)[1])
    model = toxicity.Model(language, {b"worthlessness ": 0.9})
    assert list(model.score(pa.array(["worthlessness", "worthlessly", None, "", "w0rthlessness"]))) == [0.9, 0, 0, 0, 0.9]
    got = toxicity.learnt(pa.array(["worthless worthlessly", "worth"]), np.array([1, 0]), language, {}).to_pydict()
    assert dict(zip(got["feature"], zip(got["toxic"], got["total"]))) == {b"wort": (1, 2), b"worth": (1, 2), b"worth ": (0, 1)} | {b"worthlessly "[:k]: (1, 1) for k in range(6, 13)} | {b"worthless ": (1, 1)}


def test_viterbi_equals_all_paths():
    import itertools

    codes, ns = toxicity.grams("the token then toast test tested best stone notes\nidiot")
    language = toxicity.Language(codes, ns)
    for token in ("t0a5t", "1d10t", "n0t3$", "teeest"):
        best = None
        for path in itertools.product(*toxicity.lattice(token)):
            cost, c = 0.0, ""
            for meant, channel in path:
                cost += channel
                if meant == " ":
                    cost += language.log(c, "") if c else 0
                    c = ""
                for letter in meant if meant != " " else "":
                    cost += language.log(c, letter)
                    c = (c + letter)[-3:]
            cost += language.log(c, "") if c else 0
            if best is None or cost > best[0]:
                best = (cost, " ".join("".join(m for m, _ in path).split()))
        assert toxicity.restore(token, language) == best[1]
    assert abs(sum(language.p([20, 15], x) for x in range(len(toxicity._ALPHABET) + 2)) - 1) < 1e-9


# Pipeline


def test_pipeline_equals_its_parts(spark):
    """Each stage's decisions, taken by the brute-force versions, give the same sequences' contents."""
    sf = oracle.SF
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    keep = {r.doc_id for r in quality.scores(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect() if r.keep}
    left = {i: t for i, t in rows.items() if i in keep}
    groups, _ = brute.jaccard_groups([*left.items()], near_dedup.THRESHOLD)
    gone = {d for g in groups for d in g if d != min(g)}
    left = {i: t for i, t in left.items() if i not in gone}
    tests = {tuple(w[p : p + decontaminate.WINDOW]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if (w := brute.words(r.text)) for p in range(max(1, len(w) - decontaminate.WINDOW + 1))}
    sizes = {len(t) for t in tests}
    left = {i: t for i, t in left.items() if not any(tuple(w[p : p + n]) in tests for w in [brute.words(t)] for n in sizes for p in range(len(w) - n + 1))}
    left = {i: pii.redacted(t) for i, t in left.items()}
    ranks = packing.vocabulary()
    want = {i: len(packing._encoder(ranks).encode_ordinary(t)) if ranks else int(packing.estimated(pa.array([t]))[0]) for i, t in left.items() if t}
    got = corpus_pipeline.run(spark, sf).groupBy("doc_id").sum("n_tokens").collect()
    assert {r[0]: r[1] for r in got} == {i: n for i, n in want.items() if n}


def test_pipeline_with_odd_rows(spark, tmp_path):
    """Nulls, repeated rows, a very long text, and columns whose names the operators use, through all stages."""
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("aeinorstlm"), rng.integers(3, 9))) for _ in range(300)]
    good = [" ".join(rng.choice(words, 30)) + f" is note {i}." for i in range(8)]
    long = " ".join(f"{good[i % 8]} Part {i} follows here." for i in range(4000))
    rows = [(1, None), (2, ""), (None, good[0] + " No id."), (3, good[1]), (3, good[1]), (4, good[2] + " Mail to ann@mail.example.org."), (5, good[3]), (6, good[3].replace("note 3", "paper 3")), (7, long), (8, good[4] + " The answer of the secret test is forty two point five exactly."), (9, good[5])]
    extra = ", ".join(f"{c} string" for c in ("id", "_id", "bad", "group_id", "kept", "owner", "score", "seq_id", "n_tokens", "__gone", "__bad"))
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), *["x"] * 11) for i, t in rows], f"doc_id long, text string, lang string, source string, n_chars long, {extra}")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(3, 1, 0), (5, 1, 0), (9, 1, None), (None, 1, 1), (4, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "the answer of the secret test is forty two point five exactly"), (2, None), (None, "plain words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, str(tmp_path))
        assert out.columns == docs.columns, name
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == {None, 3, 4, 5, 7, 9}
    assert sum(r.doc_id == 3 for r in got) == 1 and sum(r.n_tokens for r in got if r.doc_id == 7) > 90_000


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{oracle.SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, oracle.SF)
        assert out.columns == docs.columns and stage(spark, docs.limit(0), oracle.SF).count() == 0, name
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "near-dedup", "benchmark decontamination", "PII", "best-fit packing"]


@pytest.mark.parametrize("name", [*queries.QUERIES])
def test_queries_run_on_an_empty_table(spark, name, tmp_path):
    for t in ("documents", "labels", "embeddings", "benchmark"):
        spark.read.parquet(f"{oracle.SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0
