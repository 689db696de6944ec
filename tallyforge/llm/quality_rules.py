"""Quality rules by tokeniser fertility.

A public vocabulary with byte fallback is a yardstick for text: prose of a language that it knows takes
many characters per token, no byte tokens and a broad mix of tokens; junk takes few characters, bytes,
or the same tokens again and again. Each text gets three measures (characters per token, share of byte
tokens, entropy of its tokens relative to the most that its length allows). A second vocabulary, of byte
pairs, measures characters per token too; where it is given, a text has too few only if both say so, as a
word that one vocabulary happens to lack is no sign of junk. Each language, or script
where a row names no language, gets bands from the quartiles of all its documents, apart for each class
of length (powers of two of the tokens), as short texts spread more and have more entropy; a text outside a
band on the bad side is rejected, and so is one that fails the base rules (too few words, or too many
words in repeated five-word windows).

Null, empty and blank texts have no words and fail the base rules. A null doc_id is kept as it is.
Rows that repeat are measured and decided row by row, ties get the same verdict. Other columns of the
input are left alone; those named like a result are replaced.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import SPACE, as_bytes, cut, lean, mix, per_worker, ragged, raw_text, sized_broadcast, text_slices
from tallyforge.llm.tokens import BYTE_PATTERN

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, script string, n_tokens long, chars_per_token double, byte_share double, token_entropy double, chars_per_pair_token double"


@dataclass(frozen=True)
class Rules:
    """min_words, repeat_percent: base rules. reach, entropy_reach: quartile ranges that a band extends beyond the quartiles.

    A class of length with fewer than min_group texts is judged by its language or script as a whole,
    with a wider band of characters for short texts, and there only a text that is also worse than the
    floor is rejected. byte_floor always holds: a language without byte tokens has a band of no width.
    min_spread: the least quartile range, so that a band doesn't close in on texts that are all alike.
    min_tokens: shorter texts say too little to judge.
    """

    min_words: int = 10
    repeat_percent: int = 20
    reach: float = 2.5
    entropy_reach: float = 1.5
    min_group: int = 50
    min_spread: float = 0.02
    chars_floor: float = 1.9
    byte_floor: float = 0.02
    entropy_floor: float = 0.5
    min_tokens: int = 30


_SYMBOL = np.zeros(256, np.bool_)
_SYMBOL[list(b"#*$%&|<>")] = True
#: Scripts by the lead bytes of their UTF-8 forms; ASCII letters are Latin.
_SCRIPTS = ("latin", "greek", "cyrillic", "hebrew_arabic", "indic", "east_asian", "other")
_SCRIPT_OF = np.full(256, -1, np.int64)
_SCRIPT_OF[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC3, 0xCA)]] = 0
_SCRIPT_OF[0xCD:0xD0] = 1
_SCRIPT_OF[0xD0:0xD5] = 2
_SCRIPT_OF[0xD6:0xDE] = 3
_SCRIPT_OF[0xE0] = 4
_SCRIPT_OF[0xE1:0xEE] = 5
_SCRIPT_OF[0xEE:0xF8] = 6


@per_worker
def _processor(model: str):
    """One for each Python worker; the tables of words go with the task, so that later stages have their memory."""
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=model)


@per_worker
def _pairs(path: str):
    """A file of byte-pair ranks (a token in base 64 and its rank on each line); one for each Python worker."""
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("pairs", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})


class _Pieces:
    """The piece ids of words; distinct words are encoded once until the table is full. pairs: how many tokens the second vocabulary needs for each."""

    def __init__(self, model: str, second: str | None = None, most: int = 200_000):
        self.model, self.second, self.most = _processor(model), _pairs(second) if second else None, most
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.vocab_size())])
        self._clear()

    def _clear(self) -> None:
        self.index: dict = defaultdict(count().__next__)
        self.flat, self.start, self.length, self.bytes = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.pairs = np.empty(0, np.int64)

    def codes(self, words: list[list[bytes]]) -> np.ndarray:
        """A number for each word, the same for the same word."""
        if len(self.index) > self.most:
            self._clear()
        known, get = len(self.index), self.index.__getitem__
        out = [np.fromiter(map(get, w), np.int64, len(w)) for w in words]
        if len(self.index) > known:
            new = [w.decode() for w in islice(self.index, known, None)]
            ids = self.model.encode(new, num_threads=1)
            if self.second:
                cut_ = self.second.encode_ordinary
                self.pairs = np.concatenate([self.pairs, np.fromiter((len(cut_(f" {w}")) for w in new), np.int64, len(new))])
            length = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter((i for x in ids for i in x), np.int64, int(length.sum()))
            ends = np.cumsum(length)
            n_bytes = np.concatenate([[0], np.cumsum(self.is_byte[flat])])
            self.start = np.concatenate([self.start, len(self.flat) + ends - length])
            self.bytes = np.concatenate([self.bytes, n_bytes[ends] - n_bytes[ends - length]])
            self.length, self.flat = np.concatenate([self.length, length]), np.concatenate([self.flat, flat])
        return np.concatenate(out) if out else np.empty(0, np.int64)


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of values up to each end, from the end before."""
    return np.diff(np.concatenate([[0], np.cumsum(values)])[ends], prepend=0)


def _repeated(codes: np.ndarray, doc: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Per document, the words in five-word windows that the document has twice or more."""
    n = len(codes)
    if n < 5:
        return np.zeros(len(ends), np.int64)
    key = mix(codes[: n - 4].astype(np.uint64))
    for k in range(1, 5):
        key = mix(key + codes[k : n - 4 + k].astype(np.uint64))
    inside = doc[: n - 4] == doc[4:]
    at = np.flatnonzero(inside)
    key = mix(key[at] + mix(doc[at].astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(at), np.bool_)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + 5, -1)
    return _sums(np.cumsum(edge[:n]) > 0, ends)


def measures(docs: DataFrame, model: str, keep: list[str], second: str | None = None) -> DataFrame:
    """The columns of keep with MEASURES of every whole text; the last is null without a second vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _Pieces(model, second)
        for b in text_slices(batches, column=0):
            raw, offsets = raw_text(b.column(0))
            texts = as_bytes(b.column(0))
            words = [t.split() for t in texts]
            n_words = np.fromiter(map(len, words), np.int64, len(words))
            ends, doc = np.cumsum(n_words), np.repeat(np.arange(len(words)), n_words)
            codes = pieces.codes(words)
            chars = _sums(~SPACE[raw] & (raw & 0xC0 != 0x80), offsets[1:])
            symbols = _sums(_SYMBOL[raw], offsets[1:])
            lines = np.zeros(len(texts), np.int64)
            for i, t in enumerate(texts):
                if b"\n" in t:
                    worded = [x for x in t.split(b"\n") if not x.isspace() and x]
                    lines[i] = len(worded) - len(set(worded))
            kind = _SCRIPT_OF[raw]
            letter = kind >= 0
            of = np.repeat(np.arange(len(texts)), np.diff(offsets))
            by_script = np.bincount(of[letter] * len(_SCRIPTS) + kind[letter], minlength=len(texts) * len(_SCRIPTS)).reshape(-1, len(_SCRIPTS))
            length = pieces.length[codes]
            n_tokens = _sums(length, ends)
            tokens = pieces.flat[ragged(pieces.start[codes], length)] + np.repeat(np.arange(len(texts)), n_tokens) * len(pieces.is_byte)
            tokens.sort()
            first = np.flatnonzero(np.diff(tokens, prepend=-1))
            times = np.diff(first, append=len(tokens))
            owner = tokens[first] // len(pieces.is_byte)
            n = np.maximum(n_tokens, 1)
            entropy = np.log2(n) - np.bincount(owner, times * np.log2(times), len(texts)) / n
            out = [
                n_words, chars, symbols, lines, _repeated(codes, doc, ends),
                np.array(_SCRIPTS)[by_script.argmax(1)], n_tokens, chars / n,
                _sums(pieces.bytes[codes], ends) / n, entropy / np.log2(np.maximum(n, 2)),
            ]
            pairs = pa.array(chars / np.maximum(_sums(pieces.pairs[codes], ends), 1)) if second else pa.nulls(len(texts), pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *map(pa.array, out), pairs], names=[*b.schema.names[1:], *(x.split()[0] for x in MEASURES.split(", "))])

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), MEASURES])
    return docs.select("text", *keep).mapInArrow(lean(run, _processor, _pairs), schema)


def judge(measured: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Adds base_failed, the band's verdicts and kept. The bands are quartiles over all rows of a language or script and length."""
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.repeat_percent * F.col("n_words"))
    length = F.least(F.greatest(F.length(F.bin("n_tokens")), F.lit(6)), F.lit(12))
    rows = measured.withColumn("band", F.coalesce("lang", F.concat(F.lit("script:"), "script"))).withColumn("base_failed", failed).withColumn("_length", length)
    spread = lambda c: F.expr(f"percentile(round({c}, 3), array(0.25, 0.75))").alias(c)  # noqa: E731  rounding bounds what a group keeps
    span = lambda c: F.greatest(F.col(c)[1] - F.col(c)[0], F.lit(rules.min_spread))
    most = F.greatest(F.col("byte_share")[1] + rules.reach * (F.col("byte_share")[1] - F.col("byte_share")[0]), F.lit(rules.byte_floor))
    least = F.col("token_entropy")[0] - rules.entropy_reach * span("token_entropy")

    def bands(*by: str) -> DataFrame:
        return rows.where(~F.col("base_failed")).groupBy(*by).agg(F.count("*").alias("n"), F.expr("percentile(n_tokens, 0.5)").alias("usual"), spread("chars_per_token"), spread("byte_share"), spread("token_entropy"), spread("chars_per_pair_token"))

    narrow = bands("band", "_length").where(F.col("n") >= rules.min_group).select("band", "_length", (F.col("chars_per_token")[0] - rules.reach * span("chars_per_token")).alias("_chars"), most.alias("_bytes"), least.alias("_entropy"), (F.col("chars_per_pair_token")[0] - rules.reach * span("chars_per_pair_token")).alias("_pairs"))
    wide = bands("band").select("band", F.col("chars_per_token")[0].alias("_low"), (rules.reach * span("chars_per_token")).alias("_reach"), "usual", most.alias("_all_bytes"), F.least(least, F.lit(rules.entropy_floor)).alias("_all_entropy"), F.col("chars_per_pair_token")[0].alias("_low_pairs"), (rules.reach * span("chars_per_pair_token")).alias("_reach_pairs"))
    # a mean over fewer tokens spreads more, by the root of their number
    shorter = F.sqrt(F.greatest(F.col("usual") / F.col("n_tokens"), F.lit(1.0)))
    least_chars = F.coalesce("_chars", F.least(F.col("_low") - F.col("_reach") * shorter, F.lit(rules.chars_floor)))
    least_pairs = F.coalesce("_pairs", F.least(F.col("_low_pairs") - F.col("_reach_pairs") * shorter, F.lit(rules.chars_floor)))
    agreed = F.col("chars_per_pair_token").isNull() | (F.col("chars_per_pair_token") < least_pairs)
    long_enough = F.col("n_tokens") >= rules.min_tokens
    return (
        rows.join(sized_broadcast(narrow, 10_000), ["band", "_length"], "left")
        .join(sized_broadcast(wide, 10_000), "band", "left")
        .withColumn("few_chars", long_enough & (F.col("chars_per_token") < least_chars) & agreed)
        .withColumn("many_bytes", long_enough & (F.col("byte_share") > F.coalesce("_bytes", "_all_bytes")))
        .withColumn("low_entropy", long_enough & (F.col("token_entropy") < F.coalesce("_entropy", "_all_entropy")))
        .withColumn("kept", ~(F.col("base_failed") | F.coalesce(F.col("few_chars") | F.col("many_bytes") | F.col("low_entropy"), F.lit(False))))
        .drop("_length", "_chars", "_bytes", "_entropy", "_low", "_reach", "usual", "_all_bytes", "_all_entropy", "_pairs", "_low_pairs", "_reach_pairs")
    )


def score(docs: DataFrame, model: str, rules: Rules = Rules(), second: str | None = None) -> DataFrame:
    """Per row: doc_id, the measures, the language or script it is judged by, and kept."""
    return judge(cut(measures(docs, model, ["doc_id", "lang"], second)), rules)


def keep_good(docs: DataFrame, model: str, rules: Rules = Rules(), second: str | None = None) -> DataFrame:
    """The rows of docs that pass, with the columns of docs."""
    own = [c for c in docs.columns if c not in ("text", "lang")]
    clash = {c: f"_own_{i}" for i, c in enumerate(own)}
    renamed = docs.select("text", "lang", F.col("text").alias("_own_text"), *(F.col(f"`{c}`").alias(clash[c]) for c in own))
    judged = judge(cut(measures(renamed, model, ["lang", "_own_text", *clash.values()], second)), rules)
    back = {new: old for old, new in clash.items()} | {"_own_text": "text", "lang": "lang"}
    order = {old: new for new, old in back.items()}
    return judged.where("kept").select(*(F.col(f"`{order[c]}`").alias(c) for c in docs.columns))
