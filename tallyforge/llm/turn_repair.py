"""Repair of the turns of conversations by least-cost edits, worked out once for each shared prefix.

damaged() plants faults: rows get a number, the crc32 of "conv_id:turn" modulo 20; 0 drops a row, 1 empties its
text, 2 takes its [.!?] out, 3 repeats it (same turn), 4 makes its role user. Nulls (conv_id and turn in that
name, role, text) count as one space.

repaired() takes each conversation's rows by turn (nulls first; rows of one turn by role and a hash of the text,
so that copies are neighbours). A row's first fault counts: blank (no character beside [\\x20\\x09-\\x0D]),
duplicate (role and text came earlier), truncated (the last such character is not one of [.!?]). Edits: K keeps a
row (0), R makes it a user or assistant (2), D deletes it (3; the only edit of blank and duplicate rows), I inserts
a user or assistant without text (2); a truncated row that stays costs 1 more. The cheapest edits that give role
initials (s?(ua)+)? are taken, of equals the ASCII-least.

A row says nothing to this but its sign: the role's initial (o: another), in capitals if truncated, or X if it must
go. The signs of a conversation are its signature. Signatures are dealt in ranges and sorted, which walks the
trie of them branch by branch: a layer (the least cost of each state after so many rows) is worked out when the
branch grows and kept while later signatures share it, and a terminal node's answer serves all conversations that
end there. Only the branch at hand is held.

Places in a conversation come from a sort in ranges, so rows of one conversation may stand in several tasks, and
signatures are put together from the ranges' parts; texts are dealt once, for the hash of the repaired text, which
is fed row by row: SHA-256 is sequential, so one task reads a conversation, but no task holds its texts. What a
conversation holds at once is one sign and one edit for each row, as its result does.

A null conv_id is a conversation of its own. Repeated rows are duplicates. Other columns are not looked at. An empty
table gives no rows; a conversation without rows after damage has zeros, an empty audit and the hash of nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import cut, shuffle_partitions

_BLANK = " \t\n\x0b\f\r"
#: States: nothing yet, after s, after u, after a; a conversation may end in the first and the last.
_ENDS = (0, 3)
#: By state: where an inserted or renamed row leads, and the letter of its role.
_NEXT = (2, 2, 3, 2)
_ROLE = "uuau"
_FAR = 1 << 60


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, dropped (rows that are, without effect on others), nth (of repeated rows)."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn"))), F.lit(20))
    role, text = named("role"), named("text")
    return rows.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), (kind == 0).alias("dropped"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("nth"),
    )


def grown(layer: tuple[int, ...], sign: str) -> tuple[int, ...]:
    """The least cost of each state after one more row of this sign (an empty sign: before any row)."""
    out = [_FAR] * 4 if sign else list(layer)
    for state, cost in enumerate(layer) if sign else ():
        for _, more, to in _edits(state, sign):
            out[to] = min(out[to], cost + more)
    for _ in range(3):
        for state, to in enumerate(_NEXT):
            out[to] = min(out[to], out[state] + 2)
    return tuple(out)


def _edits(state: int, sign: str) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of what may be done with a row, letters in order."""
    out = [("D", 3, state)]
    if sign != "X":
        late, initial = int(sign.isupper()), sign.lower()
        if initial == "s" and state == 0:
            out.append(("K", late, 1))
        elif initial == _ROLE[state]:
            out.append(("K", late, _NEXT[state]))
        out.append(("R", 2 + late, _NEXT[state]))
    return out


class Trie:
    """The branch of the trie that leads to the last signature: its layers, and the answer at its end."""

    def __init__(self) -> None:
        self.signs, self.layers = "", [grown((0, _FAR, _FAR, _FAR), "")]
        self.answer = self._told()

    def enter(self, signs: str) -> tuple[int, str, list[str]]:
        """Cost, audit and, for each row and what follows the last, what comes of it: inserted u and a, then k (kept), U or A (renamed) or nothing."""
        if signs != self.signs:
            same = next((i for i, (x, y) in enumerate(zip(signs, self.signs, strict=False)) if x != y), min(len(signs), len(self.signs)))
            del self.layers[same + 1 :]
            for sign in signs[same:]:
                self.layers.append(grown(self.layers[-1], sign))
            self.signs = signs
            self.answer = self._told()
        return self.answer

    def _told(self) -> tuple[int, str, list[str]]:
        """Of the cheapest ways to the end, found backwards, the ASCII-least, walked forwards."""
        last = self.layers[-1]
        best = min(last[s] for s in _ENDS)
        ahead = [set() for _ in self.layers]
        ahead[-1] = {s for s in _ENDS if last[s] == best}
        for i in range(len(self.layers) - 1, -1, -1):
            layer = self.layers[i]
            for _ in range(3):
                ahead[i] |= {s for s in range(4) if _NEXT[s] in ahead[i] and layer[s] + 2 == layer[_NEXT[s]]}
            if i:
                before = self.layers[i - 1]
                ahead[i - 1] = {s for s in range(4) if any(to in ahead[i] and before[s] + cost == layer[to] for _, cost, to in _edits(s, self.signs[i - 1]))}
        i, state, audit, steps, held = 0, 0, [], [], ""
        while i < len(self.signs) or not (state in _ENDS and last[state] == best):
            here = self.layers[i]
            options = [(letter, i + 1, to) for letter, cost, to in _edits(state, self.signs[i]) if to in ahead[i + 1] and here[state] + cost == self.layers[i + 1][to]] if i < len(self.signs) else []
            if _NEXT[state] in ahead[i] and here[state] + 2 == here[_NEXT[state]]:
                options.append(("I", i, _NEXT[state]))
            letter, i, to = min(options)
            audit.append(letter)
            if letter == "I":
                held += _ROLE[state]
            else:
                steps.append(held + {"D": "", "K": "k", "R": _ROLE[state].upper()}[letter])
                held = ""
            state = to
        return best, "".join(audit), [*steps, held]


def signatures(rows: DataFrame) -> DataFrame:
    """Per conversation of damaged rows: conv_id, gaps, blank, duplicate, truncated, illegal, signs."""
    bare = F.rtrim("text", F.lit(_BLANK))
    facts = rows.select(
        "conv_id", "dropped", "turn", "role", F.unhex(F.sha2("text", 256)).alias("mark"), F.monotonically_increasing_id().alias("tie"), (bare == "").alias("blank"),
        (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("truncated"),
    )
    order = ("conv_id", "dropped", "turn", "role", "mark", "tie")
    ranged = facts.repartitionByRange(shuffle_partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    placed = cut(ranged.drop("tie").withColumn("place", F.monotonically_increasing_id()), "places")
    live = placed.where("NOT dropped")
    first = live.groupBy("conv_id", "role", "mark").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("first"))
    initial = F.when(F.left("role", F.lit(1)).isin("s", "u", "a"), F.left("role", F.lit(1))).otherwise("o")
    gone = F.col("blank") | F.col("first").isNull()
    sign = F.when(gone, "X").when(F.col("truncated"), F.upper(initial)).otherwise(initial)
    number = lambda c: F.count(F.when(c, 1))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.col(c).alias("x")))), lambda r: r["x"]), "")
    parts = live.join(first, "place", "left").withColumn("sign", sign).withColumn("initial", initial).groupBy("conv_id", F.shiftright("place", 33).alias("place")).agg(
        joined("sign").alias("sign"), joined("initial").alias("initial"), number(F.col("blank")).alias("blank"), number(~F.col("blank") & F.col("first").isNull()).alias("duplicate"), number(~gone & F.col("truncated")).alias("truncated")
    )
    whole = parts.groupBy("conv_id").agg(joined("sign").alias("signs"), joined("initial").alias("initials"), *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")))
    turn = F.when(~F.col("dropped"), F.col("turn").cast("long"))
    every = placed.groupBy("conv_id").agg(F.coalesce(F.max(turn) - F.min(turn) + 1 - F.count_distinct(turn), F.lit(0)).cast("long").alias("gaps"))
    met = every.join(whole.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
    illegal = F.greatest(F.length("initials") - 1, F.lit(0)) - F.regexp_count("initials", F.lit("s(?=u)|u(?=a)|a(?=u)"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return met.select("conv_id", "gaps", *(zero(F.col(c)).alias(c) for c in ("blank", "duplicate", "truncated")), zero(illegal).alias("illegal"), F.coalesce("signs", F.lit("")).alias("signs"))


def answers(signed: DataFrame) -> DataFrame:
    """signed (with signs) with cost, audit and steps (as of Trie.enter()), one range of signatures in a task."""
    names = [c for c in signed.columns if c != "signs"]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in signed.schema if f.name in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie()
        for b in batches:
            if not b.num_rows:
                continue
            cost, audit, steps = zip(*map(trie.enter, b.column(len(names)).to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(cost, pa.int64()), pa.array(audit, pa.string()), pa.array(steps, pa.list_(pa.string()))], names=[*names, "cost", "audit", "steps"])

    dealt = signed.repartitionByRange(shuffle_partitions(signed.sparkSession), "signs", "conv_id").sortWithinPartitions("signs", "conv_id")
    return dealt.select(*names, "signs").mapInArrow(run, f"{kinds}, cost long, audit string, steps array<string>")


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_OWN = {"U": "user", "A": "assistant"}


def hashed(told: DataFrame, rows: DataFrame) -> DataFrame:
    """told (of answers()) with repaired_sha256 in the place of steps; rows are the damaged ones, fed to the hash in their order."""
    keys = ("conv_id", "head", "turn", "role", "mark")
    some = rows.where("NOT dropped").select("conv_id", F.lit(1).alias("head"), "turn", "role", F.unhex(F.sha2("text", 256)).alias("mark"), "text")
    heads = told.withColumn("head", F.lit(0))
    both = heads.unionByName(some, allowMissingColumns=True).repartition(shuffle_partitions(rows.sparkSession), "conv_id").sortWithinPartitions(*keys)
    kind = rows.schema["conv_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        head, steps, at, sha, begun = None, [], 0, None, False

        def feed(lines: list[str]) -> None:
            nonlocal begun
            for line in lines:
                sha.update((f"\n{line}" if begun else line).encode())
                begun = True

        def inserted(step: str) -> list[str]:
            return [f"{ {'u': 'user', 'a': 'assistant'}[x] }:" for x in step if x in "ua"]

        def close() -> None:
            if head is not None:
                feed(inserted(steps[-1]))
                done.append((*head, sha.hexdigest()))

        for b in batches:
            for is_row, role, text, conv_id, audit, its, *counts in zip(*(b.column(i).to_pylist() for i in range(12)), strict=True):
                if not is_row:
                    close()
                    head, steps, at, sha, begun = (conv_id, *counts, audit), its, 0, hashlib.sha256(), False
                    continue
                step, at = steps[at], at + 1
                feed(inserted(step))
                if step[-1:] in ("k", "U", "A"):
                    feed([f"{_OWN.get(step[-1], role)}:{text}"])
            if len(done) >= 1000:
                yield out(done)
                done.clear()
        close()
        if done:
            yield out(done)

    def out(done: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*done, strict=True))
        types = [None, *[pa.int64()] * len(_COUNTS), pa.string(), pa.string()]
        arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names=["conv_id", *_COUNTS, "audit", "repaired_sha256"])

    if kind.typeName() == "long":  # a batch of nulls alone has no type of its own
        typed = out

        def out(done: list[tuple]) -> pa.RecordBatch:  # noqa: F811
            got = typed(done)
            return got.set_column(0, "conv_id", got.column(0).cast(pa.int64()))

    counts = ", ".join(f"{c} long" for c in _COUNTS)
    return both.select("head", "role", "text", "conv_id", "audit", "steps", *_COUNTS).mapInArrow(run, f"conv_id {kind.simpleString()}, {counts}, audit string, repaired_sha256 string")


def repaired(rows: DataFrame) -> DataFrame:
    """Per conversation of damaged rows: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    return hashed(answers(signatures(rows)), rows)
