"""Token files, packing and the BPE automaton: exact round trips and comparison with the tokenizers library."""

import io
import random
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")

from geostrata.llm import packing, token_files  # noqa: E402
from geostrata.llm.bpe_automaton import ByteBpe, TokenAutomaton, encode_decode  # noqa: E402
from geostrata.llm.bytes_tokens import PieceEncoder  # noqa: E402

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", "don't STOP it's", "ΑΣ ΑΣ. ΣΑΣ", "a <|endoftext|> b<|endoftext|>c", "İstanbul ſ K é ́x", "x\xa0y z", "a\x0bb\x0cc\x1cd\x85e", "😀 ﬁ Ǆ", "가 ᄀ", "½ ² ª", "  lead\n\n\ttail  ", "aaaa" * 50, "----====", "'S 'LL we'LL <|", "x" * 3000]
DOCS = [(k, t, "s", 1, 2) for k, t in enumerate([*ODD, None, "word " * 5000, "same text", "same text"])]
SCHEMA = "doc_id long, text string, part string, start int, ids int"


def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@pytest.fixture(scope="module")
def byte_bpe():
    return ByteBpe(BYTE)


@pytest.fixture(scope="module")
def word_encoder():
    return PieceEncoder(WORD)


def as_bytes(ids):
    return np.asarray(ids, "<u4").tobytes()


def test_pieces_match_the_library(word_encoder):
    t = library(WORD)
    for some in (ODD, [None, *ODD]):
        assert word_encoder.encode(some) == [as_bytes(t.encode(x or "", add_special_tokens=False).ids) for x in some]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text_matches_the_library(text):
    try:
        text.encode()
    except UnicodeEncodeError:
        return
    t, e, b = _models()
    assert e.encode([text]) == [as_bytes(t.encode(text, add_special_tokens=False).ids)]
    want = _byte_library().encode(text, add_special_tokens=False).ids
    assert b.ids(text) == want
    assert b.decode(want) == _byte_library().decode(want, skip_special_tokens=False)


_held = {}


def _models():
    if "m" not in _held:
        _held["m"] = library(WORD), PieceEncoder(WORD), ByteBpe(BYTE)
    return _held["m"]


def _byte_library():
    if "b" not in _held:
        _held["b"] = library(BYTE)
    return _held["b"]


def test_automaton_on_odd_texts(byte_bpe):
    t = library(BYTE)
    r = random.Random(2)
    letters = ["a", "e", "th", " ", "\n", "!", "9", "é", "漢", "ing", "'s", "AAAA", "--", "<|endoftext|>"]
    for text in [*ODD, *("".join(r.choice(letters) for _ in range(30)) for _ in range(500))]:
        ids = t.encode(text, add_special_tokens=False).ids
        assert byte_bpe.ids(text) == ids and byte_bpe.decode(ids) == t.decode(ids, skip_special_tokens=False)


def brute_bpe(word, merges):
    parts = [word[i : i + 1] for i in range(len(word))]
    for left, right in merges:
        i = 0
        while i < len(parts) - 1:
            if parts[i] == left and parts[i + 1] == right:
                parts[i : i + 2] = [left + right]
            i += 1
    return parts


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=8), st.binary(max_size=20).map(lambda b: bytes(97 + x % 3 for x in b)))
def test_automaton_of_any_merges(choices, word):
    tokens, merges = [b"a", b"b", b"c"], []
    for i, j in choices:
        left, right = tokens[i % len(tokens)], tokens[j % len(tokens)]
        if left + right not in tokens and brute_bpe(left + right, merges) == [left, right]:
            merges.append((left, right))
            tokens.append(left + right)
    vocabulary = {t: k for k, t in enumerate(tokens)}
    machine = TokenAutomaton(vocabulary, merges)
    assert [machine.label[i] for i in machine.encode_word(word)] == brute_bpe(word, merges)


def test_encode_decode_keeps_rows(spark):
    out = encode_decode(spark.createDataFrame([*DOCS, (None, "x", None, None, None)], SCHEMA), BYTE).collect()
    assert len(out) == len(DOCS) + 1
    assert {x["key"]: x["decoded"] for x in out if x["key"] is not None} == {k: t or "" for k, t, *_ in DOCS}
    assert encode_decode(spark.createDataFrame([], SCHEMA), BYTE).count() == 0


def test_token_files_round_trip(spark, tmp_path, word_encoder):
    docs = spark.createDataFrame(DOCS, SCHEMA).repartition(3)
    files = token_files.write_token_files(docs, WORD, str(tmp_path / "t"), end_id=2, partitions=3).cache()
    got = {x["key"]: (x["start"], bytes(x["ids"])) for x in token_files.read_token_files(files).collect()}
    at = 0
    for k, t, *_ in DOCS:
        ids = word_encoder.encode([t])[0] + as_bytes([2])
        assert got[k] == (at, ids)
        at += len(ids) // 4
    assert files.agg({"n_docs": "sum"}).first()[0] == len(DOCS)
    assert token_files.write_token_files(docs.where("false"), WORD, str(tmp_path / "e"), 2).count() == 0


def test_frames_are_independent_and_checked():
    out = io.BytesIO()
    writer = token_files.TokenFileWriter(out, frame_bytes=64)
    docs = [(k, as_bytes(range(k * 7))) for k in range(40)]
    for k, ids in docs:
        writer.add(k, ids)
    writer.close()
    raw = out.getvalue()
    assert struct.unpack("<I", raw[-4:])[0] == 0x8F92EAB1
    reader = token_files.TokenFileReader(io.BytesIO(raw), len(raw))
    assert list(reader.documents()) == docs
    assert list(reader.documents([7, 31])) == [docs[7], docs[31]]
    broken = bytearray(raw)
    broken[int(reader.begins[2]) + int(reader.entries[2, 0]) - 1] ^= 0xFF
    reader = token_files.TokenFileReader(io.BytesIO(bytes(broken)), len(broken))
    with pytest.raises(Exception):
        reader.frame(2)
    import zstandard

    assert zstandard.ZstdDecompressor().decompress(raw[: int(reader.entries[0, 0])], max_output_size=1 << 20) == b"".join(x for _, x in docs)[: int(reader.entries[0, 1])]


def plain_best_fit(lengths, window):
    free = []
    for length in sorted(lengths, reverse=True):
        fits = [r for r in free if r >= length]
        if fits:
            free.remove(min(fits))
            free.append(min(fits) - length)
        else:
            free.append(window - length)
    return sorted(free)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120))
def test_plan_is_best_fit_decreasing(lengths):
    window = 40
    counts = {k: lengths.count(k) for k in set(lengths)}
    used = {}
    plan = packing.best_fit_decreasing(counts, window)
    for length, rank, first, each, offset in plan:
        later = [x[1] for x in plan if x[0] == length and x[1] > rank]
        for nth in range((min(later) if later else counts[length]) - rank):
            at = used.setdefault(first + nth // each, set())
            span = set(range(offset + nth % each * length, offset + (nth % each + 1) * length))
            assert not span & at
            at |= span
    assert sorted(window - len(x) for x in used.values()) == plain_best_fit(lengths, window)
    assert sorted(used) == list(range(len(used)))


def test_packing_covers_every_id(spark, word_encoder):
    docs = spark.createDataFrame([*DOCS, (None, "no key", "s", 1, 2)], SCHEMA)
    rows = packing.pack(docs, WORD, end_id=1, window=64).toPandas()
    texts = {-1 if k is None else k: t for k, t, *_ in [*DOCS, (None, "no key")]}
    rows["doc_id"] = rows["doc_id"].fillna(-1)
    for k, part in rows.groupby("doc_id"):
        ids = word_encoder.encode([texts[k]])[0] + as_bytes([1])
        part = part.sort_values("start")
        assert part["start"].tolist() == [0, *part["length"].cumsum().tolist()[:-1]] and part["length"].sum() == len(ids) // 4 == part["doc_tokens"].iloc[0]
        for x in part.itertuples():
            assert zlib.crc32(ids[4 * x.start : 4 * (x.start + x.length)]) == x.ids_crc32
    for _, part in rows.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert part["offset"].tolist() == [0, *part["length"].cumsum().tolist()[:-1]] and part["length"].sum() <= 64
    assert sorted(rows["sequence_id"].unique()) == list(range(rows["sequence_id"].nunique()))
    assert packing.pack(docs.where("false"), WORD, 1).count() == 0
