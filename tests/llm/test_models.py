"""Language, quality and nearest neighbours: held-out accuracy, recall against brute force, odd rows."""

import random
import zlib

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from geostrata.llm import language, neighbours, quality

SYLLABLES = {"aa": ["ka", "lo", "mi", "ten", "sur"], "bb": ["sch", "ung", "ver", "ein", "ich"], "cc": ["eau", "ois", "elle", "tion", "ré"]}


def some_texts(n=240):
    r = random.Random(4)
    rows = []
    for k in range(n):
        lang = ["aa", "bb", "cc"][k % 3]
        words = ["".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(20, 80))]
        good = k % 4 != 0
        text = " ".join(words) if good else " ".join(w + "###" for w in words)
        rows.append((k, text, lang, int(good), "clash"))
    return rows


def held_out(k):
    return zlib.crc32(str(k).encode()) % 5 == 0


def test_language_on_held_out_rows_and_odd_texts(spark):
    rows = some_texts()
    odd = [(9000, None, "aa", 1, ""), (9001, "", "bb", 1, ""), (9002, "1234 ...", None, 1, ""), (None, "ka lo mi", "aa", 1, ""), (9003, "kalomi " * 40000, "aa", 1, "")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score int, key string")
    model = language.fit_dictionaries(docs.where(language.training_rows(F.col("doc_id"))))
    assert sorted(model) == ["aa", "bb", "cc"]
    got = {x["key"]: x for x in language.identify(docs, model).collect()}
    test = [x for x in rows if held_out(x[0])]
    assert np.mean([got[k]["lang_pred"] == lang for k, _, lang, *_ in test]) > 0.95
    assert all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 for k in (9000, 9001, 9002))
    assert got[9003]["lang_pred"] == "aa" and all(0 <= x["score"] <= 1 for x in got.values())
    assert language.identify(docs.where("false"), model).count() == 0
    assert language.identify(docs, {}).where("lang_pred <> 'und'").count() == 0


def test_narrow_margins_are_rejected():
    model = language.LanguageClassifier({"aa": b"ka lo mi ten sur " * 50, "ab": b"ka lo mi ten sur " * 50})
    assert model("ka lo mi")[1] == 0.0


def test_quality_on_held_out_rows_and_odd_texts(spark):
    rows = some_texts(400)
    docs = spark.createDataFrame(rows + [(9000, None, "x", 1, ""), (9001, "", "x", 1, ""), (None, "a b", "x", 1, ""), (9003, "word " * 60000, "x", 1, "")], "doc_id long, text string, lang string, score int, label string")
    labels = spark.createDataFrame([(k, q) for k, _, _, q, _ in rows] + [(None, 1), (9001, None), (5, 1), (77777, 0)], "doc_id long, quality int")
    model = quality.fit_quality(docs, labels)
    got = quality.score_quality(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= x["score"] <= 1 for x in got)
    score = {x["key"]: x["score"] for x in got}
    test = [(score[k], q) for k, _, _, q, _ in rows if held_out(k)]
    assert np.mean([(s >= 0.3) == bool(q) for s, q in test]) > 0.95
    kept = quality.keep_good(docs, model, 0.3)
    assert kept.columns == docs.columns and kept.count() == sum(s["score"] >= 0.3 for s in got)
    empty = quality.fit_quality(docs, labels.where("false"))
    assert quality.score_quality(docs, empty).where("score <> 0.5").count() == 0
    assert quality.score_quality(docs.where("false"), model).count() == 0


def test_pairs_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((3000, len(quality.FEATURES)))
    y = ((x[:, 2] > 0.5) ^ (x[:, 7] > 0.5)).astype(float)
    model = quality.fit_additive(x[:2000], y[:2000])
    assert np.mean((model.score(x[2000:]) > 0.5) == y[2000:]) > 0.9
    assert (7, 2) in {(i, j) for i, j, *_ in model.pairs}


def test_neighbours_recall_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(8)
    d = 10
    x = np.concatenate([rng.normal(size=(1500, d)), np.repeat(rng.normal(size=(1, d)), 60, 0)]).astype(np.float32)
    rows = [(k, v.tolist(), 1) for k, v in enumerate(x)]
    odd = [(5000, None, 1), (5100, [0.0] * d, 1), (5200, [float("nan")] * d, 1), (5300, [1.0], 1), (None, [1.0] * d, 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, score int")
    index, model = neighbours.build_index(df)
    got = neighbours.search(index, model, df.where("vec_id % 100 = 0 or vec_id = 1550"), k=10).toPandas()
    assert set(got["query_id"]) == {*range(0, 1501, 100), 1550}
    u, hits = x.astype(float), 0
    for q, part in got.groupby("query_id"):
        distance = np.sqrt(((u - u[q]) ** 2).sum(1))
        distance[q] = np.inf
        best = np.lexsort((np.arange(len(u)), distance))[:10]
        part = part.sort_values("rank")
        assert part["rank"].tolist() == list(range(1, 11))
        assert np.allclose(part["score"], distance[part["vec_id"]], rtol=0, atol=1e-12)
        hits += len(set(best) & set(part["vec_id"]))
    assert hits >= 0.9 * 10 * got["query_id"].nunique()
    assert sorted(got[got["query_id"] == 1550]["vec_id"]) == list(range(1500, 1510))
    none, model = neighbours.build_index(df.where("false"))
    assert neighbours.search(none, model, df).count() == 0
    two, model = neighbours.build_index(df.where("vec_id < 2"))
    assert neighbours.search(two, model, df.where("vec_id = 0")).count() == 1


def test_codes_weigh_parallel_error_more():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(800, 8))
    flat, sharp = neighbours.fit_quantiser(x, parallel=1.0), neighbours.fit_quantiser(x, parallel=8.0)

    def parallel_error(m):
        c = m.encode(x)
        back = np.concatenate([m.books[j][c[:, j]] for j in range(len(m.books))], 1)[:, :8]
        return float((((x - back) * x).sum(1) ** 2 / (x * x).sum(1)).mean())

    assert parallel_error(sharp) < parallel_error(flat)


@pytest.mark.parametrize("jitter", [0.02, 0.1, 0.3])
def test_scan_finds_all_neighbours_in_a_group_of_near_copies(jitter):
    """A full block with a third of its rows around one point, whose codes are almost equal."""
    rng = np.random.default_rng(5)
    n, d, k = neighbours.SCAN_ROWS, 64, 10
    x = rng.normal(size=(n, d))
    hot = rng.permutation(n)[: n // 3]
    x[hot] = x[hot[0]] + jitter * rng.normal(size=(len(hot), d))
    model = neighbours.fit_quantiser(x[:1500], rounds=2)
    asked = np.concatenate([hot[:20], np.setdiff1d(np.arange(n), hot)[:20]])
    codes = model.encode(x)
    got, ranked = neighbours._scan(model, neighbours.Block(np.arange(n), x, codes, *model.leftover(x, codes)), asked, x[asked], k)
    for q in asked:
        distance = np.sqrt(((x - x[q]) ** 2).sum(1))
        distance[q] = np.inf
        assert got.vec_id[got.query_id == q].tolist() == np.lexsort((np.arange(n), distance))[:k].tolist()
    assert ranked < 0.05 * n * len(asked)


def test_scan_ranks_few_rows_exactly():
    """The given vectors: all neighbours found, less than a twentieth of the rows ranked exactly for the average query."""
    import pyarrow.parquet

    folder = os.environ.get("TEST_SF_LARGE", "/root/testdata/sf0.1")
    rows = pyarrow.parquet.read_table(f"{folder}/embeddings.parquet").to_pandas()
    good = rows["embedding"].map(lambda v: v is not None and len(v) > 0 and np.isfinite(np.asarray(v, float)).all() and bool(np.any(v)))
    ids, x = rows.loc[good, "vec_id"].to_numpy(), np.stack(rows.loc[good, "embedding"]).astype(float)
    model = neighbours.fit_quantiser(x)
    codes = model.encode(x)
    asked = np.flatnonzero(ids % 100 == 0)
    got, ranked = neighbours._scan(model, neighbours.Block(ids, x.astype(np.float32) if (x.astype(np.float32) == x).all() else x, codes, *model.leftover(x, codes)), ids[asked], x[asked], 10)
    for k in asked:
        distance = np.sqrt(((x - x[k]) ** 2).sum(1))
        distance[k] = np.inf
        assert got.vec_id[got.query_id == ids[k]].tolist() == ids[np.lexsort((ids, distance))[:10]].tolist()
    assert ranked < 0.05 * len(ids) * len(asked)
