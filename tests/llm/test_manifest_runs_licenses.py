"""Manifests, periodic runs and license scans against brute force, and their odd rows."""

import hashlib
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from geostrata.llm import licenses, merkle, periodic, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def test_manifest_of_odd_rows_and_large_groups(spark):
    """Null and repeated keys, null and empty groups, groups of 1 to 5,000 rows, and columns called like the added ones."""
    sizes = {None: 3, "": 2, "a": 1, "b": 16, "c": 17, "d": 257, "e": 5000, **{f"s{k}": 2 for k in range(30)}}
    rows = [(None if k == 1 else k // 2 * 2, g, digest(f"{g}{k // 3}"), "own", "mine") for g, n in sizes.items() for k in range(n)]
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, source string, leaf string, pos string, path string")
    got = merkle.merkle_manifest(docs, keep=["doc_id", "source", "leaf", "pos", "path"]).collect()
    assert got[0].__fields__ == ["doc_id", "source", "leaf", "pos", "subroot", "root", "path"] and {x["pos"] for x in got} == {"own"}
    groups = {}
    for key, g, leaf, *_ in rows:
        groups.setdefault(g, []).append((key is not None, key or 0, leaf))
    trees = {g: levels([x[2] for x in sorted(v)]) for g, v in groups.items()}
    order = sorted(trees, key=lambda g: (g is not None, (g or "").encode()))
    top = levels([trees[g][-1][0] for g in order])
    want = []
    for g, v in groups.items():
        for i, (held, key, leaf) in enumerate(sorted(v)):
            path, node = [], leaf
            for tree, at in ((trees[g], i), (top, order.index(g))):
                for level in tree[:-1]:
                    run, k = level[at // 16 * 16 :][:16], at % 16
                    path.append(("".join(run[:k]), "".join(run[k + 1 :])))
                    at //= 16
            want.append((key if held else None, g, leaf, trees[g][-1][0], top[-1][0], path))
    mine = [(x["doc_id"], x["source"], x["leaf"], x["subroot"], x["root"], [tuple(p) for p in x["path"]]) for x in got]
    assert sorted(mine, key=repr) == sorted(want, key=repr)
    once = merkle.merkle_manifest(docs).select("root", merkle.folded(F.col("leaf"), F.col("path")).alias("again"))
    assert once.where("root <> again").count() == 0


def test_manifest_of_no_and_one_row(spark):
    one = spark.createDataFrame([(7, None, "x")], "doc_id long, source string, leaf string")
    assert merkle.merkle_manifest(one.where("false")).count() == 0
    got = merkle.merkle_manifest(one).first()
    assert (got["subroot"], got["root"], got["path"]) == ("x", "x", [])


def runs_brute(w):
    found, n = {}, len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q) and j > i:
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, size, q) for (s, size), q in found.items())


@pytest.mark.parametrize("at_once", [1 << 18, 3])
def test_runs_are_those_of_brute_force(monkeypatch, at_once):
    monkeypatch.setattr(periodic, "CHUNK_CANDIDATES", at_once)
    rng = random.Random(5)
    for _ in range(120):
        texts = []
        for _ in range(rng.choice([1, 3, 20])):
            n, k = rng.choice([0, 3, 6, 7, 20, 100, 200]), rng.choice([1, 2, 3, 50])
            w = [rng.randrange(k) for _ in range(n)]
            if n and rng.random() < 0.5:
                a = rng.randrange(n)
                p = 1 + (n - a) // (3 + rng.randrange(8))
                w = w[:a] + [w[a + i % p] for i in range(n - a)]
            texts.append(w)
        found = periodic.runs_of([np.array(w, np.int64) for w in texts])
        assert [[tuple(map(int, x)) for x in runs] for runs in found] == [runs_brute(w) for w in texts]


def test_grammar_extensions_are_exact():
    rng = random.Random(2)
    for _ in range(100):
        n, k = rng.choice([5, 50, 400]), rng.choice([1, 2, 4])
        s = np.array([k] + [rng.randrange(k) for _ in range(n)] + [k + 1])
        grammar = periodic.recompress(s)
        x = np.array([rng.randrange(1, n) for _ in range(50)])
        y = np.array([rng.randrange(a + 1, n + 1) for a in x.tolist()])
        forward, back = periodic.extension(grammar, x, y, True), periodic.extension(grammar, x, y, False)
        for a, b, f, r in zip(x, y, forward, back, strict=True):
            assert (s[a : a + f] == s[b : b + f]).all() and s[a + f] != s[b + f]
            assert (s[a - r + 1 : a + 1] == s[b - r + 1 : b + 1]).all() and s[a - r] != s[b - r]


def test_runs_of_odd_rows(spark):
    rows = [(1, "a b " * 5 + "c", "own"), (1, "a b " * 5 + "c", "own"), (None, None, None), (2, "", "own"), (3, "x y \x0b" * 50_000, "own"), (4, "one two", "own")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string").withColumn("row", F.lit(3))
    got = periodic.periodic_runs(docs)
    assert got.columns == ["doc_id", "text", "row", "n_words", "runs", "collapsed"]
    held = sorted((x["doc_id"] or 0, x["n_words"], [tuple(r) for r in x["runs"]], x["collapsed"]) for x in got.collect())
    assert held == [(0, 0, [], ""), (1, 11, [(0, 10, 2)], "a b c"), (1, 11, [(0, 10, 2)], "a b c"), (2, 0, [], ""), (3, 50_000, [(0, 50_000, 1)], "x y"), (4, 2, [], "one two")]
    assert periodic.periodic_runs(docs.where("false")).count() == 0


def test_automaton_has_all_runs_and_places():
    rng = random.Random(3)
    for _ in range(100):
        k = rng.choice([2, 3, 6])
        some = lambda n, k=k: " ".join(f"w{rng.randrange(k)}" for _ in range(n))
        templates, phrases = [(f"t{i}", some(rng.randrange(1, 15))) for i in range(rng.randrange(1, 5))], [("p0", some(2)), ("p1", some(3))]
        automaton, words = licenses.LicenseAutomaton(templates, phrases), licenses.words_of(some(rng.randrange(40)) + " zz " + some(10))
        places, every = {}, set()
        for j, (_, text) in enumerate(templates + phrases):
            w = licenses.words_of(text)
            for a in range(len(w)):
                for b in range(a + 1, len(w) + 1):
                    every.add(tuple(w[a:b]))
                    if j < len(templates):
                        places.setdefault(tuple(w[a:b]), set()).add((j, b))
        for i, (state, n) in enumerate(automaton.statistics(words)):
            assert n == max(x for x in range(i + 2) if not x or tuple(words[i + 1 - x : i + 1]) in every)
            a, b = automaton.slice[state]
            assert not n or set(automaton.places[a:b]) == places.get(tuple(words[i + 1 - n : i + 1]), set())
        want = [(label, i) for i in range(len(words)) for label, t in phrases if words[i:][: len(licenses.words_of(t))] == licenses.words_of(t)]
        assert automaton.scan(words)[0] == want


def test_edited_licenses_are_found():
    rng, automaton = random.Random(4), licenses.LicenseAutomaton(list(licenses.TEMPLATES), list(licenses.PHRASES))
    for label, text in licenses.TEMPLATES:
        w = text.split()
        for k in rng.sample(range(len(w)), 2 if len(w) > 30 else 0):
            w[k] = "something else"
        spans = automaton.scan(licenses.words_of("before that " + " ".join(w) + " after it"))[1]
        found = [x for x in spans if x[0] == label]
        assert found and found[0][1] >= 2 and found[0][3] >= licenses.COVER
    assert automaton.scan(licenses.words_of("the software is free of any license and in no event of the same kind " * 50))[1] == []


def test_many_copies_are_all_found():
    """Thousands of notices in one text, without the square of their number."""
    automaton = licenses.LicenseAutomaton(list(licenses.TEMPLATES), list(licenses.PHRASES))
    spans = [x for x in automaton.scan(licenses.words_of("licensed under CC BY-NC 4.0\nand " * 30_000))[1] if x[0] == "cc-by-nc"]
    assert len(spans) == 30_000 and all(b - a == 7 and c == 1 for _, a, b, c in spans) and len({a for _, a, _, _ in spans}) == 30_000


def test_licenses_of_odd_rows(spark):
    rows = [(1, "The MIT\nLicense, an Apache-License", "own"), (1, "The MIT\nLicense, an Apache-License", "own"), (None, None, None), (2, "", "own"), (3, "word " * 100_000 + "gnu General public license", "own")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string").withColumn("row", F.lit(3))
    got = licenses.scan_licenses(docs)
    assert got.columns == ["doc_id", "text", "row", "n_words", "phrases", "spans"]
    held = sorted((x["doc_id"] or 0, x["n_words"], [tuple(p) for p in x["phrases"]]) for x in got.collect())
    one = (1, 6, [("mit", 1), ("apache", 4)])
    assert held == [(0, 0, []), one, one, (2, 0, []), (3, 100_004, [("gpl", 100_001)])]
    assert licenses.scan_licenses(docs.where("false")).count() == 0


def test_license_query(spark):
    """Phrases by plain search in whole texts."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    got = {x["doc_id"]: x for x in queries.QUERIES["op13_licenses"](spark, SF).collect()}
    assert set(got) == set(docs["doc_id"])
    for k, text in zip(docs["doc_id"].tolist(), docs["text"], strict=True):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = "".join(c if c.isdigit() and c.isascii() or "a" <= c <= "z" or ord(c) > 127 else " " for c in low).split(" ")
        words = [w for w in words if w]
        places = [(i, label) for label, phrase in licenses.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        x = got[k]
        assert (x["n_words"], x["n_base"]) == (len(words), len(places))
        assert (x["first_word"], x["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        base = {label for _, label in places}
        assert x["base_labels"] == ",".join(sorted(base)) and base <= set(x["labels"].split(",")) and 0 <= x["score"] <= 1
