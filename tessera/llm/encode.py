"""Whole-text token ids, encoding each distinct word once.

For a tokenizer that drops white space and never joins characters across it, a text's ids are its words' ids in a row. A
final full stop or comma after an ASCII letter is a word of its own to it, and A-Z are lower-cased by it, so both are
taken off before words are compared.
"""

from __future__ import annotations

import json
import os
import unicodedata
from functools import cache
from pathlib import Path

import numpy as np

from tessera.llm.words import LOWER, Block, word_hashes

WORD_TOKENIZER = "word_bpe_49k.json"
REMEMBERED = 400_000  # words whose ids a worker keeps; others are encoded again where they occur
LETTER = np.zeros(256, bool)
LETTER[97:123] = True


def tokenizer_path(name: str = WORD_TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Ids of texts by a lower-casing word tokenizer, equal to encoding each text as a whole."""

    split_tails = True
    most = REMEMBERED

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        bare = json.loads(Path(path).read_text()) | {"normalizer": None, "pre_tokenizer": None, "added_tokens": []}
        self.letters = Tokenizer.from_str(json.dumps(bare))  # for words that normalising and splitting leave as they are
        self.letters.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        self.known: dict[int, int] = {}
        self.ids, self.ends = np.zeros(1 << 16, np.uint16), np.zeros(1 << 15, np.int64)

    def remember(self, hashes: list[int], words: list[str]) -> np.ndarray:
        """Encode new words; each one's number among the remembered."""
        plain = np.array([w.isalpha() and w.lower() == w and unicodedata.is_normalized("NFC", w) for w in words])
        some, others = np.flatnonzero(plain), np.flatnonzero(~plain)
        joined = self.letters.encode(" ".join([words[i] for i in some.tolist()]), add_special_tokens=False)
        parts = [x.ids for x in self.tokenizer.encode_batch_fast([words[i] for i in others.tolist()], add_special_tokens=False)]
        counts = [np.bincount(np.array(joined.word_ids, np.int64), minlength=len(some)), np.fromiter(map(len, parts), np.int64, len(parts))]
        flat = np.concatenate([np.array(joined.ids, np.uint16), np.fromiter((i for p in parts for i in p), np.uint16)])
        return self.store(hashes, np.concatenate([some, others]), np.concatenate(counts), flat)

    def store(self, hashes: list[int], order: np.ndarray, counts: np.ndarray, flat: np.ndarray) -> np.ndarray:
        """Append ids of words that come in `order`; each one's number."""
        n, at = len(self.known), int(self.ends[len(self.known) - 1]) if self.known else 0
        words = hashes
        ends = at + np.cumsum(counts)
        if at + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(at + 2 * len(flat), np.uint16)])
        if n + len(words) > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros(n + 2 * len(words), np.int64)])
        self.ids[at : at + len(flat)] = flat
        self.ends[n : n + len(words)] = ends
        numbers = np.zeros(len(words), np.int64)
        numbers[order] = np.arange(n, n + len(words))
        self.known.update(zip(hashes, numbers.tolist(), strict=True))
        return numbers

    def encode(self, b: Block) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the block's texts, one after another, and how many each text has."""
        texts = b.last - b.first
        starts, ends, row = b.words()
        if not len(starts):
            return np.zeros(0, np.uint16), np.zeros(texts, np.int64)
        if len(self.known) > self.most:
            self.known.clear()
        low = LOWER[b.data]
        final = low[ends - 1]
        tail = np.full(len(starts), self.split_tails) & ((final == 44) | (final == 46)) & (ends - starts > 1)
        tail &= LETTER[low[np.maximum(ends - 2, 0)]]
        spot = np.flatnonzero(tail)
        if len(spot):
            place = np.concatenate([np.arange(len(starts)), spot + 0.5])
            order = np.argsort(place, kind="stable")
            starts = np.concatenate([starts, ends[spot] - 1])[order]
            row = np.concatenate([row, row[spot]])[order]
            ends = np.concatenate([ends - tail, ends[spot]])[order]
        hashes, first, which = np.unique(word_hashes(low, starts, ends), return_index=True, return_inverse=True)
        listed = hashes.tolist()
        numbers = np.array([self.known.get(h, -1) for h in listed], np.int64)
        new = np.flatnonzero(numbers < 0)
        if len(new):
            raw = low.tobytes()
            words = [raw[a:z].decode() for a, z in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)]
            numbers[new] = self.remember([listed[i] for i in new.tolist()], words)
        each = numbers[which]
        end = self.ends[each]
        begin = np.where(each > 0, self.ends[np.maximum(each - 1, 0)], 0)
        n = end - begin
        until = np.cumsum(n)
        ids = self.ids[np.repeat(begin - until + n, n) + np.arange(until[-1])]
        return ids, np.bincount(row, weights=n, minlength=texts).astype(np.int64)


class ByteEncoder(WordEncoder):
    """Ids of texts by a byte-level vocabulary: A-Z lower-cased, each word with one space before it."""

    split_tails = False
    most = 1_000_000

    def __init__(self, path: str):
        import base64

        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
        self.tokenizer = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known = {}
        self.ids, self.ends = np.zeros(1 << 16, np.uint16), np.zeros(1 << 15, np.int64)

    def remember(self, hashes: list[int], words: list[str]) -> np.ndarray:
        parts = [self.tokenizer.encode_ordinary(" " + w) for w in words]
        flat = np.fromiter((i for p in parts for i in p), np.uint16)
        return self.store(hashes, np.arange(len(words)), np.fromiter(map(len, parts), np.int64, len(parts)), flat)


@cache
def byte_encoder(path: str) -> ByteEncoder:
    return ByteEncoder(path)


@cache
def word_encoder(path: str) -> WordEncoder:
    """One encoder a worker process, so that what it remembers serves all its tasks."""
    return WordEncoder(path)
