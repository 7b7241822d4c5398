"""Token ids by public tokenizer files. The files are never part of the library; their paths are parameters."""

from __future__ import annotations

import base64
import json
import os
import unicodedata
from functools import cache
from itertools import chain

import numpy as np

TAIL = b".,;:!?"


class WordTokenizer:
    """Ids of a tokenizers file, remembered by word where that gives the library's own ids.

    A tokenizer that lower-cases and drops white space before its merges gives a text the ids of its white-space
    separated words, one after the other, and a word that ends in a letter and then ASCII punctuation the ids of the
    two. Such ids are kept for words seen before, up to limit words. Other tokenizers, and texts with special tokens in
    them, are given to the library whole.
    """

    def __init__(self, path: str, limit: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.limit, self.known = Tokenizer.from_file(path), limit, {}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        folds = {x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers") or []}
        self.by_word = steps[0].get("behavior") == "Removed" and steps[0].get("invert") is True and "Lowercase" in folds
        self.special = [x["content"].encode() for x in spec.get("added_tokens") or []]
        self.letters = Tokenizer.from_file(path)
        self.letters.normalizer = None
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: set[bytes]) -> None:
        known, cores, tails = self.known, set(), []
        for w in words:
            core = w.rstrip(TAIL)
            if core != w and core and 97 <= core[-1] <= 122:
                tails.append((w, core, w[len(core) :]))
                cores |= {core, w[len(core) :]}
            else:
                cores.add(w)
        plain, rest = [], []
        for c in cores:
            if c not in known:
                word = c.decode()
                (plain if word.isalpha() and (c.isascii() or (word == word.lower() and unicodedata.is_normalized("NFC", word))) else rest).append(word)
        # a run of normal letters is one word to the tokenizer as it is, and its last id is marked as an end
        rows = [plain[i : i + 400] for i in range(0, len(plain), 400)]
        for row, found in zip(rows, self.letters.encode_batch_fast([" ".join(r) for r in rows], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(row):
                data = ids.tobytes()
                known.update(zip(map(str.encode, row), (data[4 * a : 4 * b] for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True)), strict=True))
            else:
                rest += row
        known.update(zip(map(str.encode, rest), (np.array(ids, "<u4").tobytes() for ids in self._encode(rest)), strict=True))
        for w, core, tail in tails:
            known[w] = known[core] + known[tail]

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text in UTF-8, as little-endian 32-bit numbers."""
        special = [not self.by_word or any(s in t for s in self.special) for t in texts]
        lists = [[] if x else t.lower().split() for x, t in zip(special, texts, strict=True)]
        words = set(chain.from_iterable(lists))
        if len(self.known) > self.limit:
            self.known.clear()
        self._learn(words.difference(self.known))
        get = self.known.__getitem__
        return [np.array(self._encode([t.decode()])[0], "<u4").tobytes() if x else b"".join(map(get, ws)) for x, t, ws in zip(special, texts, lists, strict=True)]


@cache
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


@cache
def rank_encoding(path: str, pattern: str):
    """The tiktoken encoding of a rank file, without special tokens."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
