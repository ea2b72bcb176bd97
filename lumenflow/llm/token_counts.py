"""Operator 4: token counts that follow edits.

A document keeps its pre-tokens in blocks below a binary tree whose nodes sum characters and tokens. An edit finds its place by the
sums, pre-tokenises again from two characters before it until a new boundary falls on an old one, encodes those pre-tokens only, and
renews the sums on the way to the root. A match of the pre-token pattern looks two characters past its end at most and never back,
so everything outside that region keeps its tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenflow.llm.bpe import Codec, codec
from lumenflow.llm.common import stored, table

#: Pre-tokens of a new block; a block of eight times as many makes the tree be built anew.
BLOCK = 64
LOOK = 2
EDITS = "array<struct<start:int,length:int,replacement:string>>"


class Tree:
    """Pre-token segment tree of one text."""

    def __init__(self, c: Codec, text: str, leaves: tuple[list[int], list[int]] | None = None):
        """``leaves``: characters and tokens of each pre-token, if they are known."""
        self.codec = c
        if leaves is None:
            found = c.find(text)
            leaves = [len(w) for w in found], [len(c.words[w]) // 4 for w in found]
        self._build(text, *leaves)

    def _build(self, text: str, chars: list[int], tokens: list[int]) -> None:
        n = max(1, -(-len(chars) // BLOCK))
        self.size = 1 << (n - 1).bit_length()
        self.chars = [chars[i * BLOCK : (i + 1) * BLOCK] for i in range(n)]
        self.tokens = [tokens[i * BLOCK : (i + 1) * BLOCK] for i in range(n)]
        self.texts, at = [], 0
        self.sums = [[0] * 2 * self.size, [0] * 2 * self.size]
        for i in range(n):
            length = sum(self.chars[i])
            self.texts.append(text[at : at + length])
            self.sums[0][self.size + i], self.sums[1][self.size + i] = length, sum(self.tokens[i])
            at += length
        for s in self.sums:
            for i in range(self.size - 1, 0, -1):
                s[i] = s[2 * i] + s[2 * i + 1]

    @property
    def n_tokens(self) -> int:
        return self.sums[1][1]

    @property
    def n_chars(self) -> int:
        return self.sums[0][1]

    @property
    def text(self) -> str:
        return "".join(self.texts)

    def leaves(self) -> tuple[list[int], list[int]]:
        return [x for b in self.chars for x in b], [x for b in self.tokens for x in b]

    def _find(self, at: int) -> tuple[int, int, int]:
        """Block, place in it, and start of the pre-token that holds character ``at`` (the last block's end beyond the text)."""
        if at >= self.n_chars:
            b = len(self.chars) - 1
            while b > 0 and not self.chars[b]:
                b -= 1
            k = max(0, len(self.chars[b]) - 1)
            return b, k, self.n_chars - (self.chars[b][k] if self.chars[b] else 0)
        node, before, chars = 1, 0, self.sums[0]
        while node < self.size:
            node *= 2
            if before + chars[node] <= at:
                before += chars[node]
                node += 1
        b = node - self.size
        for k, n in enumerate(self.chars[b]):
            if before + n > at:
                return b, k, before
            before += n
        raise AssertionError

    def _renew(self, b: int) -> None:
        for s, values in zip(self.sums, (self.chars, self.tokens), strict=True):
            i = self.size + b
            s[i] = sum(values[b])
            while i > 1:
                i //= 2
                s[i] = s[2 * i] + s[2 * i + 1]

    def edit(self, start: int, length: int, replacement: str) -> int:
        """Replaces ``length`` characters from ``start`` on, and returns how many pre-tokens were encoded. Places beyond the text
        stand for its end."""
        start = min(max(0, start), self.n_chars)
        end = min(start + max(0, length), self.n_chars)
        b, k, first = self._find(max(0, start - LOOK))
        old: list[int] = []  # the old boundaries from ``first`` on, up to the end of block ``last``
        last, reach = b, first
        for n in self.chars[b][k:]:
            old.append(reach := reach + n)
        before = sum(self.chars[b][:k])
        text = self.texts[b][before:]
        shift = len(replacement) - (end - start)
        while True:
            done = reach == self.n_chars
            if reach > end + LOOK or done:
                new = text[: start - first] + replacement + text[end - first :]
                known, at, made = {x + shift for x in old if x >= end}, first, []
                for w in self.codec.find(new):
                    at += len(w)
                    if at > first + len(new) - LOOK and not done:
                        break  # what follows could still change this match
                    made.append(w)
                    if at >= start + len(replacement) and at in known:
                        done = True
                        break
                if done:
                    break
            last += 1
            for n in self.chars[last]:
                old.append(reach := reach + n)
            text += self.texts[last]
        stay = sum(1 for x in old if x > at - shift)  # old pre-tokens behind the region, up to the end of block ``last``
        chars, tokens = ([v for i in range(b, last + 1) for v in x[i]] for x in (self.chars, self.tokens))
        kept = len(chars) - stay
        self.texts[b] = self.texts[b][:before] + "".join(made) + text[at - shift - first :]
        self.chars[b] = chars[:k] + [len(w) for w in made] + chars[kept:]
        self.tokens[b] = tokens[:k] + [len(self.codec.words[w]) // 4 for w in made] + tokens[kept:]
        for i in range(b + 1, last + 1):
            self.chars[i], self.tokens[i], self.texts[i] = [], [], ""
            self._renew(i)
        self._renew(b)
        if len(self.chars[b]) > 8 * BLOCK:
            self._build(self.text, *self.leaves())
        return len(made)


def trees(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id_col, text, chars, tokens): every whole text with its tree's leaves, to be kept as a table; null counts as empty. The
    characters and tokens of all pre-tokens are little-endian 32-bit integers end to end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            chars, tokens = [], []
            for t in batch.column(1).to_pylist():
                found = c.find(t)
                chars.append(np.fromiter(map(len, found), "<i4", len(found)).tobytes())
                tokens.append((np.fromiter(map(len, map(c.words.__getitem__, found)), "<i4", len(found)) // 4).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chars, pa.binary()), pa.array(tokens, pa.binary())], ["id", "text", "chars", "tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text")).mapInArrow(run, f"id {kind}, text string, chars binary, tokens binary")
    return out.withColumnRenamed("id", id_col)


def attach(kept: DataFrame, edits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``kept`` (from :func:`trees`) with the column ``edits``: those of (id_col, edit_no, start, length, replacement), in order of
    edit_no. Documents without edits stay, and edits without a document go. Places count in the text as earlier edits left it."""
    each = edits.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("edit_no", "start", "length", "replacement"))).alias("e"))
    each = each.select(id_col, F.transform("e", lambda e: F.struct(e["start"], e["length"], e["replacement"])).cast(EDITS).alias("edits"))
    return kept.join(each, id_col, "left").withColumn("edits", F.coalesce("edits", F.array().cast(EDITS)))


def recount(kept: DataFrame, id_col: str = "doc_id", path: str | None = None) -> DataFrame:
    """(id_col, n_chars, n_tokens, edited_chars, edited_tokens, pretokens, reencoded) of rows with ``text`` and ``edits``.

    Rows of :func:`trees` bring the leaves of their trees; for others the tree is made here, once, before the edits follow.
    ``reencoded`` counts the pre-tokens that the edits had encoded. A null text counts as empty and can be edited; repeated rows
    give repeated results; a null replacement is empty."""
    held = {"chars", "tokens"} <= set(kept.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            out = []
            for text, edits, *leaves in zip(*(col.to_pylist() for col in batch.columns[1:]), strict=True):
                tree = Tree(c, text or "", tuple(np.frombuffer(x, "<i4").tolist() for x in leaves) if held else None)
                n, t = tree.n_chars, tree.n_tokens
                again = sum(tree.edit(e["start"], e["length"], e["replacement"] or "") for e in edits)
                out.append((n, t, tree.n_chars, tree.n_tokens, sum(map(len, tree.chars)), again))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in zip(*out, strict=True))] if out else [batch.column(0)] + [pa.array([], pa.int64())] * 6, NAMES)

    kind = kept.schema[id_col].dataType.simpleString()
    rows = kept.select(F.col(id_col).alias("id"), "text", "edits", *(["chars", "tokens"] if held else [])).mapInArrow(run, f"id {kind}, " + ", ".join(f"{x} long" for x in NAMES[1:]))
    return rows.withColumnRenamed("id", id_col)


NAMES = ["id", "n_chars", "n_tokens", "edited_chars", "edited_tokens", "pretokens", "reencoded"]


def sample_edits(text: str = "text"):
    """Three edits of any text: ten characters go at its third quarter, a word comes at the middle, five give way to another at the
    first quarter."""
    n = F.length(text)
    one = lambda part, length, word: F.struct(F.floor(n * part).cast("int").alias("start"), F.lit(length).alias("length"), F.lit(word).alias("replacement"))
    return F.array(one(0.75, 10, ""), one(0.5, 0, " edited"), one(0.25, 5, "X1 ")).cast(EDITS).alias("edits")


def query(spark, sf_dir: str) -> DataFrame:
    """op4: token counts of every document before and after three edits. The trees are kept as a table, which the edits open again."""
    kept = stored(trees(table(spark, sf_dir, "documents")))
    return recount(kept.withColumn("edits", sample_edits()))
