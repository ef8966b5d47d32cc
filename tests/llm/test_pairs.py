"""N-gram join, searches and the pipeline against brute force."""

import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from sparkgauge.llm import learned_ann, maxscore, ngram_join, queries

from ..conftest import SMALL, rows
from .conftest import SCHEMA, prose

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def gram_set(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    if not w:
        return set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def brute_components(docs):
    sets = {i: gram_set(t) for i, t in docs}
    of = {i: i for i in sets}

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((root(a), root(b)))
                    of[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def variants():
    """Texts at all similarities around the threshold, of many lengths, with a common passage."""
    import random

    rng, out = random.Random(5), []
    passage = " ".join(f"shared{i}" for i in range(30))
    for n in (3, 5, 6, 12, 33, 70, 150, 400):
        words = [f"w{n}x{i}" for i in range(n)]
        out += [" ".join(words)] * 2
        for edits in (1, 2, 3, 5, 8, 13):
            w = list(words)
            for _ in range(edits):
                w[rng.randrange(len(w))] = f"e{rng.random()}"
            out.append(" ".join(w))
            out.append(" ".join(words[: max(1, n - edits)]))
        out.append(" ".join(words) + " " + passage)
    out += [passage + " " + " ".join(f"own{i}y{j}" for j in range(20)) for i in range(40)]
    return list(enumerate(out))


def test_join_matches_brute_force(spark):
    docs = variants()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_components(docs)


def test_join_of_awkward_documents(docs, empty):
    known = [(r.doc_id, r.text) for r in docs.dropDuplicates(["doc_id"]).collect() if r.doc_id is not None]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(docs).collect()}
    assert {k: v for k, v in got.items() if k is not None} == brute_components(known)
    assert got[None][1] is None
    assert ngram_join.join(empty).count() == 0


def test_keep_one(docs):
    kept = ngram_join.keep_one(docs)
    ids = sorted(str(r.doc_id) for r in kept.collect())
    assert kept.columns == docs.columns and len(ids) == len(set(ids))
    assert {"1", "None", "6", "7", "8"} <= set(ids) and not {"2", "3"} & set(ids)


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 2**63), min_size=1, max_size=300), st.integers(0, 60), st.integers(0, 10**6))
def test_similar_sets_share_a_signature(base, changes, seed):
    rng = np.random.default_rng(seed)
    a = np.unique(np.array(sorted(base), np.uint64))
    drop = min(len(a) - 1, int(rng.integers(0, changes + 1)))
    b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(0, 2**62, changes - min(changes, drop)).astype(np.uint64)]))
    both = len(np.intersect1d(a, b))
    common = np.sort(rng.permutation(a)[: len(a) // 3])
    if 100 * both >= 80 * (len(a) + len(b) - both):
        sa, sb = (ngram_join.signatures(x, common)[0] for x in (a, b))
        assert np.intersect1d(sa, sb).size
        apart = np.bitwise_count((ngram_join.bitmap(a) ^ ngram_join.bitmap(b)).view(np.uint64)).sum()
        assert 4 * apart <= min(len(a), len(b))  # the bitmap never rules a link out


def test_similar_large_sets_share_a_subset():
    """Bands that enumerate subsets of parts, at the threshold, over both bands and with common features."""
    rng = np.random.default_rng(7)
    for n in (520, 640, 1000, 1030, 1100, 2000, 5000):
        for trial in range(20):
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            k = len(a) // 9 if trial % 2 else 0  # swap k elements, or add a quarter
            b = np.unique(np.concatenate([rng.permutation(a)[k:], rng.integers(0, 2**63, k if k else len(a) // 4).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            assert 100 * both >= 80 * (len(a) + len(b) - both)
            common = np.sort(rng.permutation(a)[: len(a) // (2 + trial % 5)])
            sa, sb = (ngram_join.signatures(x, common) for x in (a, b))
            assert np.intersect1d(sa[0], sb[0]).size
            assert len(sa[0]) == len(sa[1]) < 1.25 * len(a)  # near a band's lower edge in two bands
    other = np.unique(rng.integers(0, 2**63, 5000).astype(np.uint64))
    assert not np.intersect1d(ngram_join.signatures(a, common)[0], ngram_join.signatures(other, common)[0]).size


def test_keep_one_shuffles_no_texts_that_stay(spark):
    """Rows whose ids neither go nor repeat pass a bit table, not the exchange of an anti-join."""
    docs = [(i, f"w{i} " * 3 + " ".join(f"v{i}x{j}" for j in range(20))) for i in range(40)]
    df = spark.createDataFrame([*docs, (90, docs[3][1]), (91, docs[3][1]), (5, docs[5][1]), (None, docs[3][1])], "doc_id long, text string")
    kept = ngram_join.keep_one(df)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted([str(i) for i in range(40)] + ["None"])
    assert re.search(r"Union\n\W*MapInArrow", kept._jdf.queryExecution().sparkPlan().toString())


def test_join_in_rounds_matches_brute_force(spark, monkeypatch):
    """Signatures that meet in eight rounds find what one round finds."""
    monkeypatch.setattr(ngram_join, "ROUND_DOCS", 10)
    docs, names = variants(), []
    write = ngram_join.written
    monkeypatch.setattr(ngram_join, "written", lambda df, name: names.append(name) or write(df, name))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_components(docs) and names.count("met") == ngram_join.ROUNDS


def test_wide_bitmaps_tell_large_sets_apart():
    """Sets at the threshold pass in every size; large sets with a third of their features in common do not."""
    rng = np.random.default_rng(8)
    for n in (100, 1000, 2040, 5000, 20_000):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        near = np.unique(np.concatenate([a, rng.integers(0, 2**63, len(a) // 4).astype(np.uint64)]))
        far = np.unique(np.concatenate([a[: n // 2], rng.integers(0, 2**63, n - n // 2).astype(np.uint64)]))
        for other, passes in ((near, True), (far, False)):
            x, y = (ngram_join.wide_bitmap(s) for s in (a, other))
            longs = min(len(x), len(y))
            apart = int(np.bitwise_count((ngram_join.folded(x, longs) ^ ngram_join.folded(y, longs)).view(np.uint64)).sum())
            assert (4 * apart <= min(len(a), len(other))) == passes
        assert (ngram_join.folded(ngram_join.wide_bitmap(a)) == ngram_join.bitmap(a)).all()


def test_rows_that_share_an_id(spark):
    rows = [(1, "a b c d e f", "x"), (1, "g h i j k l", "y"), (1, "g h i j k l", "x"), (2, "a b c d e f", "z"), (None, "m", "n"), (None, "m", "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, note string")
    first = sorted(tuple(map(str, r)) for r in ngram_join.keep_one(df).collect())
    assert first == sorted(tuple(map(str, r)) for r in ngram_join.keep_one(df.repartition(7)).collect())
    assert [r[0] for r in first].count("1") == 1 and [r[0] for r in first].count("None") == 2


def test_join_query_matches_sql(spark, duck):
    got = queries.op10_ngram_join(spark, SMALL).toPandas()
    assert rows(got) == rows(duck.execute(queries.ORACLE_SQL["op10_ngram_join"]).df())


def vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 16)) + 3 * rng.normal(size=(6, 16))[rng.integers(0, 6, 300)]
    data = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    data += [(300 + i, data[7][1]) for i in range(30)]  # one vector many times
    data += [(400, None), (420, [float("nan")] * 16), (440, [float("inf")] * 16), (460, [None] * 16), (480, [0.0] * 16)]
    return spark.createDataFrame(data, "vec_id long, embedding array<double>"), data


def exact(data, every, k, score):
    good = [(i, np.array(v)) for i, v in data if v and all(x is not None and np.isfinite(x) for x in v)]
    out = {}
    for i, q in good:
        if i % every == 0:
            out[i] = sorted(((score(q, v), -j) for j, v in good if j != i), reverse=True)[:k]
    return out


def test_maxscore_is_exact(spark):
    df, data = vectors(spark)
    got = maxscore.topk(df, F.col("id") % 20 == 0).collect()
    want = exact(data, 20, 5, lambda a, b: int(np.floor(256 * a) @ np.floor(256 * b)))
    assert {(r.query_id, r["rank"]): (r.score, r.vec_id) for r in got} == {(i, n + 1): (s, -j) for i, top in want.items() for n, (s, j) in enumerate(top)}


def test_maxscore_of_little(spark):
    few = spark.createDataFrame([(0, [1.0]), (1, [0.5])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.vec_id, r.score) for r in maxscore.topk(few, F.col("id") == 0).collect()] == [(0, 1, 256 * 128)]
    assert maxscore.topk(few.limit(0), F.col("id") == 0).count() == 0


def test_maxscore_query_matches_sql(spark, duck):
    got = queries.op4_maxscore(spark, SMALL).toPandas()
    assert rows(got) == rows(duck.execute(queries.ORACLE_SQL["op4_maxscore"]).df())


def test_neighbours_found(spark):
    df, data = vectors(spark)
    data = [(i, v) for i, v in data if i != 480]
    got = learned_ann.nearest(df, F.col("id") % 20 == 0).collect()
    want = exact(data, 20, 20, lambda a, b: float(a @ b))
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == set(want)
    hit = 0
    for i, found in by.items():
        found.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == list(range(1, 21))
        assert sorted(found, key=lambda r: (-r.score, r.vec_id)) == found
        hit += len({r.vec_id for r in found} & {-j for _, j in want[i]})
    assert hit >= 0.9 * 20 * len(by)


def test_neighbours_of_little(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [0.5, 0.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in learned_ann.nearest(few, F.col("id") == 0).orderBy("rank").collect()] == [(0, 1, 1, 0.5), (0, 2, 2, 0.5)]
    assert learned_ann.nearest(few.limit(0), F.col("id") == 0).count() == 0


def test_items_of_several_vectors(spark):
    """Rows that share an id are one item; columns of other names do not matter."""
    rows = [(0, [1.0, 0.0], 1), (0, [0.0, 2.0], 1), (1, [0.5, 0.0], 2), (1, [0.5, 0.0], 2), (2, [0.0, 0.25], 3), (2, [0.25, 0.0], 3), (None, [9.0, 9.0], 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    got = learned_ann.nearest(df, F.col("id") == 0).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 0.5), (2, 0.5)]
    got = maxscore.topk(df, F.col("id") == 0).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 256 * 128), (2, 512 * 64)]


def clusters(spark, n, centres, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 16)) + 6 * rng.normal(size=(centres, 16))[rng.integers(0, centres, n)]
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>"), list(enumerate(x.tolist()))


def test_parts_prune_and_grow(spark, monkeypatch):
    """Clustered vectors: high recall with a small share of the rows scored, also when parts are cut again."""
    df, data = clusters(spark, 4000, 40)
    want = exact(data, 20, 20, lambda a, b: float(a @ b))
    for part_rows in (8_192, 60):
        monkeypatch.setattr(learned_ann, "PART_ROWS", part_rows)
        report = {}
        got = learned_ann.nearest(df, F.col("id") % 20 == 0, report=report).toPandas()
        hit = sum(len(set(g.vec_id) & {-j for _, j in want[q]}) for q, g in got.groupby("query_id"))
        assert hit >= 0.9 * 20 * len(want) and report["scored"] <= 0.3
        assert (report["parts"] > 32) == (part_rows == 60)


def test_recall_of_query(spark):
    got = queries.op2_learned_ann(spark, SMALL).toPandas()
    e = spark.read.parquet(f"{SMALL}/embeddings.parquet").toPandas()
    want = exact(list(zip(e.vec_id, [[float(x) for x in v] for v in e.embedding])), 20, 20, lambda a, b: float(a @ b))
    hit = sum(len(set(g.vec_id) & {-j for _, j in want[q]}) for q, g in got.groupby("query_id"))
    assert hit >= 0.9 * 20 * len(want)


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert [name for name, _ in p.STAGES] == ["toxicity", "near_duplicates", "secrets", "packing"]
    clean = p.drop_toxic(spark, docs, SMALL)
    assert clean.columns == docs.columns and 0 < clean.count() <= docs.count()
    kept = p.drop_near_duplicates(spark, docs, SMALL)
    want = brute_components([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in want.items() if i == c)
    masked = p.mask_secrets(spark, docs, SMALL)
    assert masked.columns == docs.columns and masked.count() == docs.count()
    assert masked.where("text rlike 'token = \"[0-9a-f]{40}'").count() == 0
    assert masked.where("n_chars <> length(text)").count() == 0
    out = p.run(spark, SMALL)
    assert out.columns[0] == "doc_id" and out.count() > 0


def test_pipeline_of_awkward_documents(spark, docs, empty, tmp_path):
    import corpus_pipeline as p

    for frame in (docs, empty, spark.createDataFrame([(1, prose(1), "en", "s", 1, "r", 0.0)], SCHEMA)):
        for name, stage in p.STAGES:
            frame_out = stage(spark, frame, SMALL)
            if name != "packing":
                assert frame_out.columns == frame.columns
            frame_out.count()
