"""Every numbered query on the smallest tables: against SQL where there is some, else against brute force."""

import glob
import hashlib
import os
import re
import zlib

import numpy as np
import pandas as pd
import pytest
import zstandard
from pyspark.sql import functions as F

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
from geostrata.llm import language, quality, queries  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet").toPandas()


def texts_of(spark):
    docs = table(spark, "documents")
    return {k: t or "" for k, t in zip(docs["doc_id"].tolist(), docs["text"], strict=True)}


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def library(name):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    t = tokenizers.Tokenizer.from_file(public_tokenizers.path(name))
    t.no_truncation()
    t.no_padding()
    return t


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_match_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    got, want = queries.QUERIES[name](spark, SF), con.execute(queries.ORACLE_SQL[name])
    columns = [x[0] for x in want.description]
    assert sorted(got.columns) == sorted(columns)
    in_order = lambda rows: sorted(map(tuple, rows), key=repr)
    assert in_order(got.select(*columns).collect()) == in_order(want.fetchall())


def test_language_query(spark):
    """Sizes of all blocks under every dictionary, one by one."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    books = language.fit_dictionaries(docs.where(language.training_rows(F.col("doc_id"))))
    codecs = {k: zstandard.ZstdCompressor(level=language.LEVEL, dict_data=zstandard.ZstdCompressionDict(v, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False) for k, v in books.items()}
    got = {x["doc_id"]: x for x in queries.QUERIES["op2_language"](spark, SF).collect()}
    texts = texts_of(spark)
    assert set(got) == set(texts) and all(len(v) <= language.DICTIONARY_BYTES for v in books.values())
    for k, t in texts.items():
        assert got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0)
        want, margin = "und", 0.0
        if any(map(str.isalpha, t)):
            raw = t.lower().encode("utf-8", "replace")
            sizes = sorted((sum(len(c.compress(raw[at : at + language.BLOCK])) for at in range(0, len(raw), language.BLOCK)), name) for name, c in codecs.items())
            want, margin = sizes[0][1], (sizes[1][0] - sizes[0][0]) / sizes[1][0]
        assert got[k]["lang_pred"] == want and abs(got[k]["score"] - margin / (margin + language.MARGIN)) < 1e-9


def test_quality_query(spark):
    """Scores as plain sums of table entries."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    m = quality.fit_quality(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    got = {x["doc_id"]: x for x in queries.QUERIES["op6_quality"](spark, SF).collect()}
    texts = texts_of(spark)
    assert set(got) == set(texts)
    for k, t in texts.items():
        x = quality.features(t)
        z = m.intercept + sum(table[sum(e <= v for e in edges)] for v, edges, table in zip(x, m.edges, m.tables, strict=True))
        z += sum(table[sum(e <= x[i] for e in a), sum(e <= x[j] for e in b)] for i, j, a, b, table in m.pairs)
        assert abs(got[k]["score"] - 1 / (1 + np.exp(-z))) < 1e-9
        assert got[k]["predicted"] == int(got[k]["score"] >= 0.3) and got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0)


def test_neighbours_query(spark):
    rows = table(spark, "embeddings")
    ids, x = rows["vec_id"].to_numpy(), rows["embedding"].map(lambda v: None if v is None else np.asarray(v, float))
    good = x.map(lambda v: v is not None and len(v) > 0 and np.isfinite(v).all() and bool((v != 0).any())).to_numpy()
    ids, x = ids[good], np.stack(x[good])
    got = queries.QUERIES["op4_neighbours"](spark, SF).toPandas()
    found = 0
    for q in np.flatnonzero(ids % 100 == 0):
        distance = np.sqrt(((x - x[q]) ** 2).sum(1))
        order = [k for k in np.lexsort((ids, distance)) if k != q][:10]
        mine = got[got["query_id"] == ids[q]].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 11)) and mine["score"].is_monotonic_increasing
        assert all(abs(s - distance[np.flatnonzero(ids == v)[0]]) < 1e-12 for v, s in zip(mine["vec_id"], mine["score"], strict=True))
        found += len(set(mine["vec_id"]) & set(ids[order]))
    assert found >= 0.9 * len(got) and set(got["query_id"]) == set(ids[ids % 100 == 0])


def test_token_file_query(spark):
    t, start = library("word_bpe_49k.json"), 0
    got = queries.QUERIES["op5_token_files"](spark, SF).toPandas().set_index("doc_id")
    texts = texts_of(spark)
    assert sorted(got.index) == sorted(texts)
    for k in sorted(texts):
        ids = t.encode(texts[k], add_special_tokens=False).ids + [2]
        assert (got.loc[k, "start"], got.loc[k, "n_tokens"], got.loc[k, "ids_crc32"]) == (start, len(ids), crc(ids))
        start += len(ids)


def test_packing_query(spark):
    t = library("word_bpe_49k.json")
    got = queries.QUERIES["op7_packing"](spark, SF).toPandas()
    texts = texts_of(spark)
    assert set(got["doc_id"]) == set(texts)
    for k, pieces in got.sort_values("start").groupby("doc_id"):
        ids = t.encode(texts[k], add_special_tokens=False).ids + [1]
        assert (pieces["doc_tokens"] == len(ids)).all() and pieces["length"].sum() == len(ids)
        assert pieces["start"].tolist() == np.concatenate([[0], np.cumsum(pieces["length"])[:-1]]).tolist()
        assert all(crc(ids[s : s + n]) == c for s, n, c in zip(pieces["start"], pieces["length"], pieces["ids_crc32"], strict=True))
    for _, pieces in got.sort_values("offset").groupby("sequence_id"):
        assert pieces["offset"].tolist() == np.concatenate([[0], np.cumsum(pieces["length"])[:-1]]).tolist() and pieces["length"].sum() <= 2048
    assert sorted(got["sequence_id"].unique()) == list(range(got["sequence_id"].nunique()))
    assert got["length"].sum() > 0.97 * 2048 * (got["sequence_id"].nunique() - 1)


def test_secrets_query(spark):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    got = {x["doc_id"]: x for x in queries.QUERIES["op9_secrets"](spark, SF).collect()}
    texts = texts_of(spark)
    assert set(got) == set(texts)
    for k, t in texts.items():
        found = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 12] + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        found = sorted(found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16])
        base = [f"{('assign', 'access', 'hex')[kind]}:{a}:{b}" for a, kind, b in found]
        assert [got[k][f"n_{x}"] for x in ("assign", "access", "hex")] == [sum(kind == j for _, kind, _ in found) for j in range(3)]
        assert got[k]["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest() and set(base) <= set(got[k]["spans"].split(",")) | {""}


def test_bpe_query(spark):
    t = library("byte_bpe_50k.json")
    got = {x["doc_id"]: x for x in queries.QUERIES["op10_bpe"](spark, SF).collect()}
    texts = texts_of(spark)
    assert set(got) == set(texts)
    for k, text in texts.items():
        ids = t.encode(text, add_special_tokens=False).ids
        assert got[k]["n_tokens"] == len(ids) and got[k]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[k]["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_null_keys_stay_null_in_token_files(spark, tmp_path):
    from geostrata.llm import token_files

    docs = spark.createDataFrame([(None, "one two"), (-1, "three"), (5, None), (5, "four")], "doc_id long, text string")
    files = token_files.write_token_files(docs, public_tokenizers.path("word_bpe_49k.json"), f"{tmp_path}/t", 2, partitions=2)
    got = token_files.read_token_files(spark.createDataFrame(files.collect(), files.schema)).orderBy("start").collect()
    assert [x["key"] for x in got] == [None, -1, 5, 5] and got[0]["start"] == 0


def test_vectors_of_other_sizes_meet_their_own(spark):
    from geostrata.llm import embedding_dedup, neighbours

    rng = np.random.default_rng(1)
    rows = [(k, rng.normal(size=6).tolist(), 1) for k in range(40)] + [(100, [1.0, 2.0], 1), (101, [2.0, 4.0], 1), (102, [1.0, -2.0], 1), (103, [2.0, 4.0], 2), (None, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {x["key"]: (x["n_links"], x["component"]) for x in embedding_dedup.near_duplicates(df).collect()}
    assert (got[100], got[101], got[102], got[103], got[None]) == ((1, 100), (1, 100), (0, 102), (0, 103), (0, None))
    index, model = neighbours.build_index(df)
    found = neighbours.search(index, model, df.where("vec_id = 100")).orderBy("rank").collect()
    assert [(x["vec_id"], round(x["score"], 9)) for x in found] == [(101, round(5**0.5, 9)), (103, round(5**0.5, 9)), (102, 4.0)]


def test_stages_keep_clashing_columns_and_odd_rows(spark, tmp_path):
    import corpus_pipeline as cp

    names = ["bucket", "kept", "n_words", "n_removed", "secret_base", "secret_linked", "key", "row", "band", "component", "score"]
    passage = " ".join(f"w{k}" for k in range(30))
    rows = [(1, f"a {passage}", 5), (2, f"b {passage} token=abcdef0123456789", 5), (2, f"b {passage} token=abcdef0123456789", 5), (None, f"c {passage}", 5), (None, None, None), (3, "", 0), (4, "long " * 30_000, 5)]
    docs = spark.createDataFrame([(*r, *[f"own {n}" for n in names]) for r in rows], "doc_id long, text string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in cp.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns, name
        held = got.toPandas()
        assert all((held[n] == f"own {n}").all() for n in names), name
        assert len(held) == len(rows) or name == "near_duplicates"
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0
    assert cp.pack_windows(spark, docs, str(tmp_path)).agg(F.countDistinct("sequence_id")).first()[0] > 1
    cut = cp.cut_repeats(spark, docs, str(tmp_path)).toPandas()
    assert cut.loc[cut["doc_id"] == 1, "text"].iloc[0] == f"a {passage}" and (cut.loc[cut["doc_id"] == 2, "text"] == "b token=abcdef0123456789").all()
    assert cut.loc[cut["doc_id"].isna() & cut["text"].notna(), "text"].iloc[0] == "c" and pd.isna(cut.loc[cut["n_chars"].isna(), "text"]).all()
