"""Token ids of whole texts by public tokenizer files, as tokenizers.Tokenizer.encode(text, add_special_tokens=False) gives them."""

from __future__ import annotations

import json
from collections import defaultdict
from itertools import chain, count, islice

import numpy as np

from tallyforge.llm.common import per_worker, ragged

#: Distinct words kept by a Python worker before its table starts anew.
MAX_WORDS = 400_000
#: Fixed value: the splitting pattern of byte-level BPE files.
BYTE_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Fixed value: the splitting pattern of word BPE files.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_letters() -> list[str]:
    """The printable character that byte-level files write for each byte: itself where it is printable Latin-1, else one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = count(0x100)
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


@per_worker
def word_tokenizer(path: str) -> WordTokenizer:
    """One for each Python worker, with the words that its earlier tasks met."""
    return WordTokenizer(path)


@per_worker
def byte_tokenizer(path: str) -> ByteTokenizer:
    """One for each Python worker."""
    return ByteTokenizer(path)


class ByteTokenizer:
    """Byte-level BPE. The file's vocabulary is read as merge ranks, which encode several times as fast as the file's own
    pipeline and give the same ids; a text that holds the name of a special token goes through the file's own pipeline."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        self.special = [t["content"] for t in data.get("added_tokens", [])]
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in data["model"]["vocab"].items() if t not in self.special}
        self.fast = tiktoken.Encoding("vocabulary", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the number of ids of each text."""
        ids = [self.own.encode(t, add_special_tokens=False).ids if any(s in t for s in self.special) else self.fast.encode_ordinary(t) for t in texts]
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(counts.sum())), counts


class WordTokenizer:
    """BPE with word ends, which drops white space: the ids of a text are those of its words in a row, and each
    distinct word is encoded once per Python worker. Plain words are cut as the file's pipeline does; their pieces are
    merged by the file's vocabulary read as merge ranks, with one byte in the place of the word end. Words with other
    characters go through the file's own pipeline one by one."""

    #: Bytes that no plain word has: the end of a piece, and what stands between words.
    END, NEXT = "\x01", "\x02"
    #: Fixed value: the mark of a word's end in word BPE files.
    SUFFIX = "</w>"

    def __init__(self, path: str):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        special = {t["content"] for t in data.get("added_tokens", [])}
        byte_of = {c: b for b, c in enumerate(byte_letters())}

        def raw(token: str) -> bytes:
            ends = token.endswith(self.SUFFIX)
            return bytes(map(byte_of.__getitem__, token.removesuffix(self.SUFFIX) if ends else token)) + self.END.encode() * ends

        ranks = {raw(t): i for t, i in data["model"]["vocab"].items() if t not in special}
        self.fast = tiktoken.Encoding("vocabulary", pat_str=r"\x02|[^\x01\x02]+\x01", mergeable_ranks=ranks, special_tokens={})
        self.next = ranks[self.NEXT.encode()]
        self.plain = regex.compile(r"[\x21-\x7EÀ-ÖØ-öø-ÿ]+")
        self.cut = regex.compile(WORD_PATTERN.replace(r"[^\s", r"[^\s\x02"))
        self._clear()

    def _clear(self) -> None:
        self.index: dict = defaultdict(count().__next__)
        self.flat, self.start, self.length = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words in a row, and the number of ids of each."""
        texts = [w.decode() for w in words]
        odd = [i for i, t in enumerate(texts) if "<|" in t or not self.plain.fullmatch(t)]
        own = [self.own.encode(texts[i], add_special_tokens=False).ids for i in odd]
        for i in odd:
            texts[i] = ""
        line = self.cut.sub(lambda m: m[0] + self.END, self.NEXT.join([*texts, ""]).lower())
        ids = np.array(self.fast.encode_ordinary(line), np.uint32)
        ends = np.flatnonzero(ids == self.next)
        length = np.diff(ends, prepend=-1) - 1
        ids = np.delete(ids, ends)
        if odd:
            ids = np.insert(ids, np.repeat(np.cumsum(length)[odd], [len(x) for x in own]), np.fromiter(chain.from_iterable(own), np.uint32))
            length[odd] = [len(x) for x in own]
        return ids, length

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the number of ids of each text."""
        if len(self.index) > MAX_WORDS:
            self._clear()
        known, get, codes = len(self.index), self.index.__getitem__, []
        for text in texts:
            words = text.encode().split()
            codes.append(np.fromiter(map(get, words), np.int64, len(words)))
        if len(self.index) > known:
            ids, length = self._words(list(islice(self.index, known, None)))
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(length) - length])
            self.length = np.concatenate([self.length, length])
            self.flat = np.concatenate([self.flat, ids])
        words_of = np.fromiter(map(len, codes), np.int64, len(codes))
        code = np.concatenate(codes) if codes else np.empty(0, np.int64)
        length = self.length[code]
        ends = np.concatenate([[0], np.cumsum(length)])[np.cumsum(words_of)]
        return self.flat[ragged(self.start[code], length)], np.diff(ends, prepend=0)
