"""Byte-level BPE by a tokenization automaton, and decoding by its arc labels.

The automaton reads token sequences and accepts exactly those that the merge rules produce. It starts
with one state and an arc for each byte. Each merge (a, b -> c), in order of rank, is then applied by one
gadget: the target of the a-arcs is split off as a new state that lacks the b-arc (after a, an unmerged b
may no longer follow), and every state with an a-arc gets a c-arc to where b leads. As all arcs of one
token lead to one state, a gadget adds one state. A state is kept as its token and the rank of its gadget,
and what it shares with older states is not copied, so that compiling takes time and memory in proportion
to the merges: a state lacks what the gadgets of its token took away up to its rank, and before that what
the state of its token's right part lacked. An arc's presence is found along these parts once and then kept
in the transition table.

Encoding: every prefix of a word has one proper tokenization, so one state per position is reachable, and
one left-to-right pass over the word with the transition table finds the path. Decoding emits the labels
(byte strings) of the arcs that the ids name.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geostrata.llm.common import byte_letters, small_batches

CACHE_WORDS = 1_000_000
#: Fixed value: the public pre-token pattern of byte-level BPE.
PRE_TOKENS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


class TokenAutomaton:
    """The automaton of a list of merges over byte strings, compiled gadget by gadget."""

    def __init__(self, vocabulary: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        self.label = {i: token for token, i in vocabulary.items()}
        self.target: dict[int, int] = {}  # token: the state to which its arcs lead
        self.parts: dict[int, tuple[int, int, int]] = {}  # token: rank of its gadget, left and right part
        self.gadgets: dict[tuple[int, int], int] = {}  # (left, right): rank
        self.owner, self.rank = [-1], [-1]  # by state; state 0 has all arcs
        for byte in range(256):
            if (i := vocabulary.get(bytes([byte]))) is not None:
                self.target[i], self.parts[i] = 0, (-1, -1, -1)
        for rank, (left, right) in enumerate(merges):
            self._gadget(rank, vocabulary[left], vocabulary[right], vocabulary[left + right])
        self.begins: dict[int, list] = {}  # the tokens as a tree by byte: [branches, token]
        for token, i in vocabulary.items():
            branches, leaf = self.begins, None
            for byte in token:
                leaf = branches.setdefault(byte, [{}, None])
                branches = leaf[0]
            if leaf is not None:
                leaf[1] = i
        self.table: dict[tuple[int, int], bool] = {}

    def _gadget(self, rank: int, a: int, b: int, c: int) -> None:
        if c in self.parts or not self.arc(self.target[a], b):
            raise ValueError("each token needs one merge, of parts that can still meet")
        after = self.target[b]
        self.owner.append(a)
        self.rank.append(rank)
        self.gadgets[a, b] = rank
        self.target[a] = len(self.owner) - 1
        self.target[c], self.parts[c] = after, (rank, a, b)

    def arc(self, state: int, token: int) -> bool:
        """Whether state has an arc for token.

        A token's arcs begin as those of its left part at its gadget's time, so the check goes back along the
        left parts; a state begins as that of its token's right part, so it goes back along those as well. A
        gadget counts if it ran before the time that the walk has gone back to; that of a doubled token also
        at its own time, as after its part neither part nor pair may follow.
        """
        gadgets, parts, until = self.gadgets, self.parts, len(self.gadgets)
        while token >= 0:
            owner, held = self.owner[state], self.rank[state]
            while owner >= 0:
                rank = gadgets.get((owner, token))
                if rank is not None and rank <= held and rank <= until:
                    return False
                made, _, right = parts[owner]
                owner, held = right, made - 1
            until, token, _ = parts[token]
        return True

    def encode_word(self, word: bytes) -> list[int]:
        """Ids of one pre-token. A byte without an id raises KeyError."""
        n, table, target, begins = len(word), self.table, self.target, self.begins
        last, begin = [-1] * (n + 1), [0] * (n + 1)
        reached = [0] + [-1] * n
        for at in range(n):
            state, branches, end = reached[at], begins, at
            if state < 0:
                continue
            while end < n and (leaf := branches.get(word[end])) is not None:
                branches, token = leaf
                end += 1
                if token is None or reached[end] >= 0:
                    continue
                key = (state, token)
                there = table.get(key)
                if there is None:
                    if len(table) >= 2_000_000:
                        table.clear()
                    there = table[key] = self.arc(state, token)
                if there:
                    reached[end], last[end], begin[end] = target[token], token, at
        if n and reached[n] < 0:
            raise KeyError(word)
        out = []
        while n:
            out.append(last[n])
            n = begin[n]
        return out[::-1]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.label.__getitem__, ids))


class ByteBpe:
    """Encodes and decodes whole texts with the automaton of a byte-level tokenizer file; added tokens are found first, as the file's library does."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as source:
            spec = json.load(source)
        letters = byte_letters()

        def raw(token: str) -> bytes:
            return bytes(letters[x] for x in token)

        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        vocabulary = {raw(k): v for k, v in spec["model"]["vocab"].items() if k not in self.added}
        merges = [x if isinstance(x, list) else x.split(" ") for x in spec["model"]["merges"]]
        self.automaton = TokenAutomaton(vocabulary, [(raw(a), raw(b)) for a, b in merges])
        self.automaton.label |= {i: k.encode() for k, i in self.added.items()}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.known: dict[str, tuple[str, int, bytes]] = {}

    def __call__(self, text: str | None) -> tuple[int, str, bytes]:
        """(number of ids, decimal ids joined by commas, decoded text as bytes)."""
        text, words = text or "", []
        for part in self.split.split(text) if self.split and any(x in text for x in self.added) else [text]:
            words += [part] if part in self.added else PRE_TOKENS.findall(part)
        known = self.known
        if len(known) >= CACHE_WORDS:
            known.clear()
        try:
            found = list(map(known.__getitem__, words))
        except KeyError:
            for word in words:
                if word not in known:
                    ids = [self.added[word]] if word in self.added else self.automaton.encode_word(word.encode())
                    known[word] = (",".join(map(str, ids)), len(ids), self.automaton.decode(ids))
            found = list(map(known.__getitem__, words))
        return sum(x[1] for x in found), ",".join(x[0] for x in found), b"".join(x[2] for x in found)

    def ids(self, text: str | None) -> list[int]:
        joined = self(text)[1]
        return list(map(int, joined.split(","))) if joined else []

    def decode(self, ids: list[int]) -> str:
        return self.automaton.decode(ids).decode("utf-8", "replace")


@functools.cache
def byte_bpe(path: str) -> ByteBpe:
    """One automaton for all tasks that a Python worker runs; compiling it takes about a second."""
    return ByteBpe(path)


def encode_decode(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids, decoded): ids as text joined by commas, decoded text; one row per input row.

    Null text counts as empty: no ids and an empty decoded text. Repeated, tied and null keys keep
    their rows. Other columns are left out, whatever their names. Texts of any length are encoded whole.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = byte_bpe(tokenizer)
        for frame in frames:
            for at in range(0, len(frame), 256):
                part = frame.iloc[at : at + 256]
                got = [bpe(x) for x in part["text"]]
                yield pd.DataFrame({"key": part["key"].astype("Int64"), "n_tokens": [x[0] for x in got], "ids": [x[1] for x in got], "decoded": [x[2].decode("utf-8", "replace") for x in got]})

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInPandas(run, "key long, n_tokens long, ids string, decoded string")


def op10_bpe(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids and of the decoded text of every document."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return out.select(F.col("key").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
