"""Exact token ids with the tokenizers library, each distinct word of a worker encoded once.

Byte-level BPE splits a text before a space that a non-space follows, so ids of such pieces can be joined. Words are
found, hashed and looked up as arrays; only new ones become strings and are encoded. A word that is found is compared with
the stored one byte by byte, so equal hashes are no matter: the texts of another word with the hash are encoded whole, as
are texts where the split doesn't hold (runs of spaces, special-token strings).
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa

from .textvec import BASE, U, mix, utf8

#: Stops that are a piece of their own after a letter, and one token.
STOPS = ".,"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def word_hash(eights: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[begin:end], by runs of eight bytes; one to one for words of one length of up to eight bytes.

    eights[i]: the eight bytes from i on as a number.
    """
    size = end - begin
    tail = np.minimum(size, 8)
    out = mix(eights[begin] & KEEP[tail])
    left = np.flatnonzero(size > 8)
    at, size = begin[left] + 8, size[left] - 8
    while len(left):
        out[left] = mix(out[left] * U(BASE) + (eights[at] & KEEP[np.minimum(size, 8)]))
        go = size > 8
        left, at, size = left[go], at[go] + 8, size[go] - 8
    return out


#: Masks of the first k of eight bytes.
KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], U)


class HashTable:
    """Word hashes to codes by open addressing on arrays; a second check of 32 bits stands beside each hash."""

    def __init__(self, bits: int):
        self.shift, self.mask = U(64 - bits), (1 << bits) - 1
        self.keys, self.checks, self.codes = np.zeros(1 << bits, U), np.zeros(1 << bits, np.uint32), np.zeros(1 << bits, np.int32)
        self.used = 0

    def find(self, keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """Codes, -1 where there is none."""
        out = np.full(len(keys), -1, np.int32)
        slot = (keys >> self.shift).astype(np.int64)
        left = np.arange(len(keys))
        while len(left):
            at = slot[left]
            have = self.keys[at]
            hit = (have == keys[left]) & (self.checks[at] == checks[left])
            out[left[hit]] = self.codes[at[hit]]
            left = left[~hit & (have != 0)]
            slot[left] = (slot[left] + 1) & self.mask
        return out

    def insert(self, keys: np.ndarray, checks: np.ndarray, codes: np.ndarray) -> None:
        """Distinct new keys."""
        slot = (keys >> self.shift).astype(np.int64)
        left = np.arange(len(keys))
        while len(left):
            at = slot[left]
            free = np.flatnonzero(self.keys[at] == 0)
            _, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.keys[at[put]], self.checks[at[put]], self.codes[at[put]] = keys[left[put]], checks[left[put]], codes[left[put]]
            rest = np.ones(len(left), bool)
            rest[put] = False
            left = left[rest]
            slot[left] = (slot[left] + 1) & self.mask
        self.used += len(keys)


class Encoder:
    #: log2 of the table's places; at 70 % it starts anew. A place takes 16 bytes.
    BITS = 21

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        #: The same model (shared, not a copy) for words of letters: they are cut at spaces alone.
        self.letters = Tokenizer(self.tokenizer.model)
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "merged_with_next"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.opens = np.array([(self.tokenizer.id_to_token(i) or "").startswith("Ġ") for i in range(size)])
        self.stops = {c: int(self._ids(c)[0]) for c in STOPS}
        self._clear()

    def _clear(self) -> None:
        self.table = HashTable(self.BITS)
        self.pool, self.start, self.length = np.zeros(0, self.dtype), np.zeros(0, np.int32), np.zeros(0, np.int32)
        #: The bytes of all words with a code, and where each code's word is in them. Eight zeros follow the last.
        self.bytes, self.word_at, self.word_size = np.zeros(8, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _remember(self, codes: np.ndarray, words: list[bytes]) -> None:
        """Store the bytes of words by their codes (-2: none)."""
        some = np.flatnonzero(codes >= 0)
        sizes = np.array([len(words[i]) for i in some], np.int64)
        grown = np.zeros(len(self.length) - len(self.word_at), np.int64)
        self.word_at, self.word_size = np.concatenate([self.word_at, grown]), np.concatenate([self.word_size, grown - 1])
        self.word_at[codes[some]] = len(self.bytes) - 8 + np.cumsum(sizes) - sizes
        self.word_size[codes[some]] = sizes
        self.bytes = np.concatenate([self.bytes[:-8], np.frombuffer(b"".join(words[i] for i in some), np.uint8), np.zeros(8, np.uint8)])

    def _differ(self, codes: np.ndarray, keys: np.ndarray, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Places of words data[begin:end] with a code of another word; data ends with eight bytes that are no word's.

        Short words have the code of their own bytes, as hash and length tell them apart, but for the key that stands for two.
        """
        some = np.flatnonzero((codes >= 0) & ((end - begin > 8) | (keys <= U(1))))
        at, own, left = begin[some], self.word_at[codes[some]], end[some] - begin[some]
        wrong = [some[left != self.word_size[codes[some]]]]
        here, there = (np.ndarray(len(x) - 7, "<u8", x, strides=(1,)) for x in (data, self.bytes))
        while len(some):
            unlike = (here[at] ^ there[own]) & KEEP[np.minimum(left, 8)]
            wrong.append(some[unlike != 0])
            go = np.flatnonzero((left > 8) & (unlike == 0))
            some, at, own, left = some[go], at[go] + 8, own[go] + 8, left[go] - 8
        return np.concatenate(wrong)

    def _ids(self, text: str, tokenizer=None) -> np.ndarray:
        return np.array((tokenizer or self.tokenizer).encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.dtype)

    def _append(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Codes of new words with these ids, one word after another."""
        first = len(self.length)
        self.start = np.concatenate([self.start, (len(self.pool) + np.cumsum(sizes) - sizes).astype(np.int32)])
        self.length = np.concatenate([self.length, np.asarray(sizes, np.int32)])
        self.pool = np.concatenate([self.pool, ids])
        return np.arange(first, first + len(sizes), dtype=np.int32)

    def _encode_words(self, words: list[str], tokenizer) -> np.ndarray:
        """Codes of words that a space precedes, 2,000 a call; a token that opens with a space begins the next word."""
        parts, sizes = [np.zeros(0, self.dtype)], [np.zeros(0, np.int64)]
        for at in range(0, len(words), 2000):
            some = words[at : at + 2000]
            ids = self._ids(" " + " ".join(some), tokenizer)
            begins = np.flatnonzero(self.opens[ids])
            if len(begins) == len(some):
                parts.append(ids)
                sizes.append(np.diff(begins, append=len(ids)))
            else:
                each = [self._ids(" " + w) for w in some]
                parts += each
                sizes.append(np.array([len(x) for x in each]))
        return self._append(np.concatenate(parts), np.concatenate(sizes))

    def _learn(self, words: list[str], first: np.ndarray, stems: np.ndarray) -> np.ndarray:
        """Codes of new words, -2 where a text with the word must be encoded whole.

        first: the word opens its text, so no space precedes it. stems: the code of the word without its last character,
        or -1. Words of letters alone, and those with one full stop or comma after them, are one or two pieces for sure, so
        no pattern has to split them.
        """
        codes = np.full(len(words), -2, np.int32)
        letters: dict[str, int] = {}
        plain, stopped, other, opening = [], [], [], []
        for i, (w, opens) in enumerate(zip(words, first.tolist(), strict=True)):
            if opens:
                if "<|" not in w:
                    opening.append(i)
            elif w.isalpha():
                letters[w] = len(letters)
                plain.append(i)
            elif w and w[-1] in STOPS and w[:-1].isalpha():
                stopped.append(i)
            elif w and not w[0].isspace() and "<|" not in w:
                other.append(i)
        for i in stopped:
            if stems[i] < 0:
                letters.setdefault(words[i][:-1], len(letters))
        of_letters = self._encode_words(list(letters), self.letters)
        codes[plain] = of_letters[: len(plain)]
        codes[other] = self._encode_words([words[i] for i in other], self.tokenizer)
        if opening:
            each = [self._ids(words[i]) for i in opening]
            codes[opening] = self._append(np.concatenate(each), np.array([len(x) for x in each]))
        if stopped:
            stem = np.array([stems[i] if stems[i] >= 0 else of_letters[letters[words[i][:-1]]] for i in stopped])
            sizes = self.length[stem] + 1
            ends = np.cumsum(sizes)
            at = np.repeat(self.start[stem] - (ends - sizes), sizes) + np.arange(ends[-1])
            at[ends - 1] = 0
            ids = self.pool[at]
            ids[ends - 1] = [self.stops[words[i][-1]] for i in stopped]
            codes[stopped] = self._append(ids, sizes)
        return codes

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the offsets of each text in it. Null counts as empty."""
        if self.table.used > 0.7 * len(self.table.keys):
            self._clear()
        data, offsets = utf8(texts)
        spaces = np.flatnonzero(data == 32)
        ptr = np.arange(len(offsets)) + np.searchsorted(spaces, offsets)
        begin, end = np.sort(np.concatenate([offsets[:-1], spaces + 1])), np.sort(np.concatenate([spaces, offsets[1:]]))
        first = np.zeros(len(begin), bool)
        first[ptr[:-1]] = True
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        eights = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))

        def hashed(begin: np.ndarray, end: np.ndarray, first: np.ndarray | bool) -> tuple[np.ndarray, np.ndarray]:
            key = word_hash(eights, begin, end)
            key = np.where(first, mix(key + U(1)), key)
            key = np.where(key == 0, U(1), key)  # zero marks a free place
            check = (end - begin).astype(np.uint32) << np.uint32(16) ^ padded[begin].astype(np.uint32) << np.uint32(8) ^ padded[np.maximum(end - 1, begin)]
            return key, check ^ np.asarray(first).astype(np.uint32) << np.uint32(31)

        keys, checks = hashed(begin, end, first)
        codes = self.table.find(keys, checks)
        new = np.flatnonzero(codes == -1)
        if len(new):
            _, at = np.unique(keys[new] ^ (checks[new].astype(U) << U(32)), return_index=True)
            one = new[at]
            blob = data.tobytes()
            words = [blob[a:b].decode("utf-8", "surrogatepass") for a, b in zip(begin[one].tolist(), end[one].tolist(), strict=True)]
            stem_end = np.maximum(end[one] - 1, begin[one])
            of_stems = hashed(begin[one], stem_end, False)
            stems = self.table.find(*of_stems)
            stems[self._differ(stems, of_stems[0], padded, begin[one], stem_end)] = -1
            learnt = self._learn(words, first[one], stems)
            self._remember(learnt, [blob[a:b] for a, b in zip(begin[one].tolist(), end[one].tolist(), strict=True)])
            self.table.insert(keys[one], checks[one], learnt)
            codes[new] = self.table.find(keys[new], checks[new])
        codes[self._differ(codes, keys, padded, begin, end)] = -2
        whole = np.unique(np.searchsorted(ptr, np.flatnonzero(codes == -2), "right") - 1)
        good = np.maximum(codes, 0)
        lengths = self.length[good] * (codes >= 0) if len(self.length) else np.zeros(len(codes), np.int32)
        ends = np.cumsum(lengths, dtype=np.int32)
        shift = (self.start[good] if len(self.start) else lengths) - (ends - lengths)
        at = np.repeat(shift, lengths)
        at += np.arange(len(at), dtype=np.int32)
        ids = self.pool[at]
        offsets = np.concatenate([[0], ends])[ptr]
        if len(whole):
            parts, at = [], 0
            sizes = np.diff(offsets)
            for d in whole:
                own = self._ids(texts[int(d)].as_py())
                parts += [ids[at : offsets[d]], own]
                at, sizes[d] = offsets[d + 1], len(own)
            ids = np.concatenate([*parts, ids[at:]])
            offsets = np.concatenate([[0], np.cumsum(sizes)])
        return ids, offsets


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per Python worker."""
    return Encoder(path)
