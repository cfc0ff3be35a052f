"""Token ids of whole texts by a public tokenizer file; pieces seen before are not encoded again."""

from __future__ import annotations

import functools
import os
import re

import numpy as np

from geostrata.llm.common import byte_letters

#: Entries of the younger half of the cache of words; with the older half a worker keeps at most twice as many, of some 200 bytes each.
CACHE_WORDS = 120_000
#: No normaliser, added token or pre-token of word_bpe_49k.json reaches across these characters.
_PIECES = re.compile(r"[^ \n\t\r]+")
#: Without these, normalising is lower-casing per character.
_NOT_PLAIN = re.compile(r"[^\x00-\x1b\x20-\xff]")
#: Fixed value: the pre-tokens of word_bpe_49k.json, with the letters and numbers up to U+00FF spelt out.
_PRE_TOKENS = re.compile("[a-zªµºß-öø-ÿ]+|'s|'t|'re|'ve|'m|'ll|'d|[^a-zªµºß-öø-ÿ0-9²³¹¼½¾\\s]+|[0-9²³¹¼½¾]")


class PieceEncoder:
    """Ids of texts as little-endian unsigned 32-bit integers. Encodes the distinct words that the cache lacks, many at once.

    A plain text is lower-cased and cut into pre-tokens here, and the library's BPE model encodes these, told
    apart by the tokens that end a word. Any other text is cut at white space and its pieces go through the
    library's whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        suffix, vocabulary = self.tokenizer.model.end_of_word_suffix, self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for x, i in vocabulary.items() if x.endswith(suffix)]] = True
        self.letters = str.maketrans({chr(b): x for x, b in byte_letters().items()})
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _spelt(self, word: str) -> str:
        """The word in the letters that the vocabulary writes for its bytes."""
        return word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.letters)

    def _learn_words(self, new: list[str]) -> None:
        for at in range(0, len(new), 4096):
            some = new[at : at + 4096]
            spelt = list(map(self._spelt, some))
            found = self.bare.encode_batch_fast([" ".join(spelt[k : k + 64]) for k in range(0, len(spelt), 64)], add_special_tokens=False)
            ids = np.concatenate([np.array(x.ids, "<u4") for x in found])
            raw, cuts = ids.tobytes(), [0, *(4 * np.flatnonzero(self.ends[ids]) + 4).tolist()]
            self.known.update({x: raw[a:b] for x, a, b in zip(some, cuts[:-1], cuts[1:], strict=True)})

    def _learn_pieces(self, new: list[str]) -> None:
        for piece, found in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
            self.known[piece] = np.array(found.ids, "<u4").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """One entry per text, with no end id; null and empty texts give no ids."""
        known, older, out, late = self.known, self.older, [], []
        words: set[str] = set()
        pieces: set[str] = set()
        for text in texts:
            plain = not text or not ("<|" in text or _NOT_PLAIN.search(text))
            parts = [] if not text else _PRE_TOKENS.findall(text.lower()) if plain else _PIECES.findall(text)
            ids = list(map(known.get, parts))
            out.append(ids)
            if None in ids:
                lack = [k for k, x in enumerate(ids) if x is None]
                late.append((ids, lack, parts))
                (words if plain else pieces).update([parts[k] for k in lack])
        known.update([(x, older[x]) for x in words | pieces if x in older])
        self._learn_words([x for x in words if x not in known])
        self._learn_pieces([x for x in pieces if x not in known])
        for ids, lack, parts in late:
            for k in lack:
                ids[k] = known[parts[k]]
        if len(known) >= CACHE_WORDS:
            self.known, self.older = {}, known
        return list(map(b"".join, out))


@functools.cache
def piece_encoder(path: str) -> PieceEncoder:
    """One encoder for all tasks that a Python worker runs, so that what one task has encoded serves the next."""
    return PieceEncoder(path)
