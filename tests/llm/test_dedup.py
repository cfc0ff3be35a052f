"""Near-duplicates, substrings and embeddings against brute force, on small tables with every odd row."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from geostrata.llm import embedding_dedup, minhash, substrings

SCHEMA = "doc_id long, text string, lang string, component long, n_words long, bucket int, band long"


def some_docs():
    r = random.Random(5)
    words = [f"w{k}" for k in range(300)]
    base = [" ".join(r.choice(words) for _ in range(60)) for _ in range(6)]
    out = []
    for k, text in enumerate(base):
        out += [text, text, text.upper().replace("W", "w"), " ".join(["zz", *text.split()[1:]]), "\n".join(text.split()) + " tail", " ".join(text.split()[:30] + base[k - 1].split()[:30])]
    passage = " ".join(f"p{k}" for k in range(25))
    out += [f"a{k} {passage} b{k} " + " ".join(r.choice(words) for _ in range(20)) for k in range(8)]
    out += [None, "", "   ", "one", "one", "one two", "a b c d", "a b c d", "x " * 3000, " ".join(r.choice(words) for _ in range(5000)), "é ü\x0bß\tÉ q r", passage]
    rows = [(k, t, None if k % 5 == 0 else "en", k, 1, 2, 3) for k, t in enumerate(out)]
    return rows + [rows[0]]


def jaccard_classes(rows):
    sets = {}
    for d, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(s), root(d)) for d, s in sets.items()}


def test_minhash_matches_brute_force(spark):
    rows = some_docs()
    want = jaccard_classes(rows)
    docs = spark.createDataFrame(rows, SCHEMA)
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert {x["doc"]: (x["n"], x["component"]) for x in got} == want


def test_minhash_links_between_edited_copies(spark):
    """Edited copies of one text in shared buckets: the many with more edits link with nothing, the few others only with each other."""
    r = random.Random(11)
    base = [f"w{k}" for k in range(400)]
    texts = []
    for edits in [13] * 45 + [6, 7, 8] * 5 + [13] * 45:
        words = list(base)
        for at in r.sample(range(400), edits):
            words[at] = f"e{r.random()}"
        texts.append(" ".join(words))
    ids = list(range(1000, 1000 + len(texts)))
    r.shuffle(ids)
    rows = list(zip(ids, texts, strict=True))
    want = jaccard_classes(rows)
    got = {x["doc"]: (x["n"], x["component"]) for x in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len({c for _, c in want.values()}) == 98
    assert got == want


def families():
    """4 families of 30 texts: 404 common words, then 22 of each text's own of which a pair of texts shares 6: background similarity 0.743, the pairs 0.763."""
    r, out = random.Random(3), []
    for f in range(4):
        common = " ".join(f"f{f}c{k}" for k in range(404))
        for k in range(15):
            shared = " ".join(f"f{f}p{k}s{j}" for j in range(6))
            out += [f"{common} {shared} " + " ".join(f"o{r.random()}" for _ in range(64)) for _ in range(2)]
    r.shuffle(out)
    return [(1000 + k, t) for k, t in enumerate(out)]


@pytest.mark.parametrize("tiles", [None, (2_000, 5_000)])
def test_minhash_links_pairs_within_families(spark, monkeypatch, tiles):
    """Pairs barely above the threshold among families barely below it; once more with tiles of a few texts."""
    if tiles:
        for name, value in zip(("TILE_HUBS", "TILE_MEMBERS"), tiles, strict=True):
            monkeypatch.setattr(minhash, name, value)
    rows = families()
    want = jaccard_classes(rows)
    got = {x["doc"]: (x["n"], x["component"]) for x in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert 4 < len({c for _, c in want.values()}) < 120
    assert got == want


def test_minhash_follows_drifting_copies(spark, monkeypatch):
    """A chain of copies, each linked with its neighbours alone, in stars cut to three ends and tiles of a few texts."""
    for name, value in (("STAR", 3), ("TILE_HUBS", 2_000), ("TILE_MEMBERS", 4_000)):
        monkeypatch.setattr(minhash, name, value)
    r, rows = random.Random(8), []
    base = [f"w{k}" for k in range(500)]
    for k in range(60):
        words = list(base)
        for at in range(0, 2 * k, 1):
            words[(at * 7) % 500] = f"c{at}"
        rows.append((k * 37 % 61, " ".join(words)))
    r.shuffle(rows)
    want = jaccard_classes(rows)
    got = {x["doc"]: (x["n"], x["component"]) for x in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_minhash_null_keys_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (4, "a b c d e f")], "doc_id long, text string")
    got = {(x["doc"], x["component"]) for x in minhash.near_duplicates(docs).collect()}
    assert got == {(None, None), (3, 3), (4, 3)}
    assert minhash.near_duplicates(docs.where("false")).count() == 0


def test_signature_agreement_estimates_similarity():
    rng = np.random.default_rng(1)
    for n, share in ((40, 0.6), (2000, 0.8)):
        both = rng.integers(0, 2**63, int(n * share), dtype=np.uint64)
        sets = [np.unique(np.concatenate([both, rng.integers(0, 2**63, n - len(both), dtype=np.uint64)]) * np.uint64(2) + np.uint64(1)) for _ in range(2)]
        true = len(both) / (2 * n - len(both))
        assert abs(float((minhash.signature(sets[0]) == minhash.signature(sets[1])).mean()) - true) < 0.2


def brute_substrings(rows, w):
    first, split = {}, []
    for d, t, *_ in rows:
        words = (t or "").encode().split()
        split.append((-1 if d is None else d, words))
        for i in range(len(words) - w + 1):
            at = tuple(words[i : i + w])
            first[at] = min(first.get(at, (1 << 62, 0)), (-1 if d is None else d, i))
    out = []
    for d, words in split:
        gone = [False] * len(words)
        for i in range(len(words) - w + 1):
            if first[tuple(words[i : i + w])] < (d, i):
                gone[i : i + w] = [True] * w
        kept = b" ".join(x for x, g in zip(words, gone) if not g).decode()
        out.append((d, len(words), sum(gone), kept))
    return sorted(out)


@pytest.mark.parametrize("window", [3, 10, 20, 25])
def test_substrings_match_brute_force(spark, window):
    rows = [*some_docs(), (None, "no key " * 30, "en", 1, 2, 3, 4)]
    out = substrings.dedup_substrings(spark.createDataFrame(rows, SCHEMA), window=window)
    got = sorted((-1 if x["doc_id"] is None else x["doc_id"], x["n_words"], x["n_removed"], x["kept"]) for x in out.collect())
    assert got == brute_substrings(rows, window)
    assert substrings.dedup_substrings(spark.createDataFrame([], SCHEMA), window=window).count() == 0


def test_substring_digest_and_cover():
    for v, cover in substrings.COVERS.items():
        for i in range(v):
            for j in range(v):
                assert any((i + s) % v in cover and (j + s) % v in cover for s in range(v))
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


def test_embedding_dedup_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    d = 8
    centre = rng.normal(size=(12, d))
    x = np.concatenate([centre[rng.integers(0, 12, 300)] + rng.normal(size=(300, d)) * 0.15, centre[:1].repeat(40, 0), 2 * centre[:1]]).astype(np.float32)
    rows = [(k, v.tolist(), None if k % 17 == 0 else k % 2, "x") for k, v in enumerate(x)]
    bad = [(1000, None, 1, "x"), (1001, [], 1, "x"), (1002, [0.0] * d, 1, "x"), (1003, [float("nan")] + [1.0] * (d - 1), 1, "x"), (1004, [None] + [1.0] * (d - 1), 1, "x"), (1005, [1.0], 1, "x"), (1006, [float("inf")] * d, 1, "x")]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int, same string")
    got = {r["key"]: (r["n_links"], r["component"]) for r in embedding_dedup.near_duplicates(df).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    label = np.array([-1 - k if k % 17 == 0 else k % 2 for k in range(len(x))])
    near = (u @ u.T >= 0.93) & (label[:, None] == label[None])
    np.fill_diagonal(near, False)
    comp = np.arange(len(x))
    for _ in range(len(x)):
        comp = np.minimum(comp, np.where(near, comp[None], 1 << 30).min(1))
    for k in range(len(x)):
        assert got[k] == (near[k].sum(), comp[k])
    assert all(got[k] == (0, k) for k, *_ in bad)
    assert embedding_dedup.near_duplicates(df.where("false")).count() == 0


def test_components_of_chains_and_loops(spark):
    from geostrata.llm.common import connected_components

    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 101), (101, 102), (102, 100), (7, 7), (200, 200)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(41)) and got[102] == got[101] == 100 and got[200] == 200
    assert connected_components(spark.createDataFrame([(None, 1)], "a long, b long")).where(F.col("component") > 1).count() == 0
