"""Operator 6: byte-level BPE encoding and decoding.

Bytes are mapped to Latin-1 so that an Aho-Corasick automaton over the vocabulary lists, in one pass, all tokens that start at each
position. The encoder takes the longest and goes back to shorter ones where two adjacent tokens could not stand side by side after
the merges; whether they can is memoised. A position that led nowhere is never tried again, so the work is linear in the
pre-token's length. Long pre-tokens are passed piece by piece, so that the lists of matches stay short. Where many short pre-tokens
are at hand together, all of them are merged at once, one merge of each a round.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import chain
from struct import pack

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Entries of the caches of one Python worker; a full cache starts anew.
WORDS, PAIRS = 250_000, 250_000
#: Texts that a task holds as Python objects at a time.
ROWS = 64
#: Positions of a pre-token whose matches are listed at a time.
SPAN = 4096
#: Longest pre-tokens that are merged many at a time, and how many at most.
SHORT, TOGETHER = 64, 1 << 16
#: What stands for no token.
NONE = (1 << 20) - 1


def vocabulary(path: str | None = None) -> list[bytes]:
    """Tokens in the order of their ids, from a file of ranks. The default is the installed public vocabulary."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    with open(path, "rb") as f:
        ranks = {int(rank): base64.b64decode(token) for token, rank in (line.split() for line in f if line.strip())}
    return [ranks[i] for i in range(len(ranks))]


def _slot(key: np.ndarray, slots: int) -> np.ndarray:
    return (key * 0x9E3779B97F4A7C1 >> 40) % slots


class _Words(dict):
    """Pre-tokens to their ids as little-endian 32-bit integers; a bounded cache, filled on demand."""

    def __init__(self, encode_piece):
        self.encode_piece = encode_piece

    def __missing__(self, word: str) -> bytes:
        ids = self.encode_piece(word.encode("utf-8"))
        out = pack(f"<{len(ids)}I", *ids)
        if len(word) <= 64:
            if len(self) >= WORDS:
                self.clear()
            self[word] = out
        return out


class Codec:
    """Encodes and decodes with a list of byte tokens whose index is both id and rank of merge."""

    def __init__(self, tokens: list[bytes], pattern: str | None = None):
        if pattern is None:
            import public_tokenizers

            pattern = public_tokenizers.PATTERN
        self.tokens = tokens
        self.ids = {t: i for i, t in enumerate(tokens)}
        self.find = regex.compile(pattern).findall
        self.lengths = [len(t) for t in tokens]
        #: The two tokens whose merge makes each token; None for single bytes and for tokens that merging never makes.
        self.halves: list[tuple[int, int] | None] = [None] * len(tokens)
        #: Merges: left << 20 | right to the token they make.
        self.merges: dict[int, int] = {}
        self.memo: dict[int, bool] = {}
        self.words = _Words(self.encode_piece)
        self.automaton = ahocorasick.Automaton()  # tokens that merging can make, by their bytes as Latin-1
        self.most = 1
        for i, t in enumerate(tokens):
            if len(t) > 1:
                self.halves[i] = self._split(i)
                if self.halves[i] is None:
                    continue
                left, right = self.halves[i]
                self.merges[left << 20 | right] = i
            self.automaton.add_word(t.decode("latin-1"), i)
            self.most = max(self.most, len(t))
        self.automaton.make_automaton()

    def _split(self, token: int) -> tuple[int, int] | None:
        """Called in the order of ids, when the merges of all lower ranks are known and no others."""
        b = self.tokens[token]
        for cut in range(1, len(b)):
            left, right = self.ids.get(b[:cut], token), self.ids.get(b[cut:], token)
            if left < token and right < token and all(self.lengths[x] == 1 or self.halves[x] for x in (left, right)) and self._adjacent(left, right):
                return left, right
        return None

    def _adjacent(self, a: int, b: int) -> bool:
        """Whether the merges leave these two tokens side by side.

        Undoes the latest merge on either side of the boundary, again and again. If at some time the two pieces that touch had
        a merge of lower rank than the merge undone last, the boundary would have vanished."""
        halves, merges, cap = self.halves, self.merges, len(self.tokens)
        while True:
            if merges.get(a << 20 | b, cap) < cap:
                return False
            left, right = halves[a], halves[b]
            if left and (a > b or not right):
                cap, a = a, left[1]
            elif right:
                cap, b = b + 1, right[0]
            else:
                return True

    def adjacent(self, left: int, right: int) -> bool:
        good = self.memo.get(key := left << 20 | right)
        if good is None:
            if len(self.memo) >= PAIRS:
                self.memo.clear()
            good = self.memo[key] = self._adjacent(left, right)
        return good

    def _starts(self, s: str, first: int) -> list[list[int]]:
        """Of the SPAN positions from ``first`` on, the tokens that match there, the longest last."""
        end = min(first + SPAN, len(s))
        starts: list[list[int]] = [[] for _ in range(first, end)]
        lengths = self.lengths
        for last, token in self.automaton.iter(s, first, min(len(s), end + self.most - 1)):
            at = last + 1 - lengths[token]
            if at < end:
                starts[at - first].append(token)
        return starts

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self.ids.get(piece)
        if whole is not None:
            return [whole]
        s, n, lengths = piece.decode("latin-1"), len(piece), self.lengths
        memo, adjacent = self.memo.get, self.adjacent
        out: list[int] = []
        dead: set[int] = set()  # positions from which no way leads to the end
        first, starts = 0, self._starts(s, 0)
        at, last, k = 0, -1, len(starts[0]) if n else 0
        while at < n:
            # The longest match that leads on; ``k`` counts those of this position that are still to be tried.
            fits = starts[at - first]
            while k:
                k -= 1
                token = fits[k]
                if at + lengths[token] not in dead:
                    if last < 0:
                        break
                    good = memo(last << 20 | token)
                    if good or good is None and adjacent(last, token):
                        break
            else:
                token = -1
            if token >= 0:
                out.append(token)
                last, at = token, at + lengths[token]
                if at < n:
                    if at >= first + SPAN:
                        first, starts = at - at % SPAN, self._starts(s, at - at % SPAN)
                    k = len(starts[at - first])
            else:
                dead.add(at)
                token = out.pop()
                at -= lengths[token]
                if at < first:
                    first, starts = at - at % SPAN, self._starts(s, at - at % SPAN)
                k = starts[at - first].index(token)
                last = out[-1] if out else -1
        return out

    @cached_property
    def _pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of single bytes (NONE where there is none), merges of two bytes, and a hash table of all merges: pairs and tokens."""
        single = np.array([self.ids.get(bytes([b]), NONE) for b in range(256)])
        key, token = (np.fromiter(x, np.int64, len(self.merges)) for x in (self.merges.keys(), self.merges.values()))
        slots = 4 << len(key).bit_length()
        held, made = np.full(slots, -1), np.full(slots, NONE)
        slot = _slot(key, slots)
        while len(key):  # one of those that want a slot takes it, the others try the next one
            free = held[slot] < 0
            held[slot[free]] = key[free]
            mine = held[slot] == key
            made[slot[mine]] = token[mine]
            key, token, slot = key[~mine], token[~mine], (slot[~mine] + 1) % slots
        both = np.array([[self.merges.get(int(a) << 20 | int(b), NONE) for b in single] for a in single])
        return single, both, held, made

    def _merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The token that each pair makes, or NONE."""
        _, _, held, made = self._pairs
        key = left << 20 | right
        out, on, slot = np.full(len(key), NONE), np.arange(len(key)), _slot(key, len(held))
        while len(on):
            there = held.take(slot)
            mine = there == key
            out[on[mine]] = made.take(slot[mine])
            more = np.flatnonzero(~mine & (there >= 0))
            on, key, slot = on.take(more), key.take(more), (slot.take(more) + 1) % len(held)
        return out

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode_piece`` for many pre-tokens: ids end to end, and how many there are of each."""
        if len(pieces) > TOGETHER:
            parts = [self.encode_pieces(pieces[i : i + TOGETHER]) for i in range(0, len(pieces), TOGETHER)]
            return np.concatenate([ids for ids, _ in parts]), np.concatenate([n for _, n in parts])
        out = [None if 1 < len(x) <= SHORT and x not in self.ids else self.encode_piece(x) for x in pieces]
        single, both, _, _ = self._pairs
        some = [i for i, x in enumerate(out) if x is None]
        if some and (single == NONE).any():
            for i in some:
                out[i] = self.encode_piece(pieces[i])
            some = []
        n = np.fromiter((0 if x is None else len(x) for x in out), np.int64, len(out))
        if not some:
            return np.fromiter(chain.from_iterable(out), np.int32, int(n.sum())), n
        # Slots of all bytes, a bar before, between and after the pieces; a merge leaves its left slot and takes the right one out.
        text = np.frombuffer(b"".join(pieces[i] for i in some), np.uint8)
        size = np.fromiter((len(pieces[i]) for i in some), np.int64, len(some))
        first = np.cumsum(size + 1) - size
        at = np.arange(len(text)) + np.repeat(first - (np.cumsum(size) - size), size)
        token = np.full(len(text) + len(some) + 1, NONE)
        token[at] = single[text]
        there = token != NONE
        after, before = np.arange(1, len(token) + 1), np.arange(-1, len(token) - 1)
        inner = np.ones(len(text), bool)
        inner[np.cumsum(size) - 1] = False
        inner = np.flatnonzero(inner)
        # A pair's rank is the token that it makes; with its slot, the least is a piece's next merge, the leftmost of equal ones.
        bits = len(token).bit_length()
        rank = np.full(len(token), NONE << bits)
        rank[at[inner]] = both[text[inner], text[inner + 1]] << bits | at[inner]
        while True:
            least = np.minimum.reduceat(rank, first)
            least = least[least < NONE << bits]
            if not len(least):
                break
            slot, made = least & (1 << bits) - 1, least >> bits
            gone = after.take(slot)
            right, left = after.take(gone), before.take(slot)
            token[slot], there[gone], rank[gone] = made, False, NONE << bits
            after[slot], before[right] = right, slot
            rank[slot] = self._merged(made, token.take(right)) << bits | slot
            rank[left] = self._merged(token.take(left), made) << bits | left
        n[some] = np.add.reduceat(there, first, dtype=np.int64)
        ids, mine = np.empty(int(n.sum()), np.int32), np.zeros(len(out), bool)
        mine[some] = True
        mine = np.repeat(mine, n)
        ids[mine] = token[there]
        ids[~mine] = np.fromiter(chain.from_iterable(x for x in out if x is not None), np.int32)
        return ids, n

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        words = self.words
        return b"".join([words[w] for w in self.find(text)])

    def forget(self) -> None:
        """Empties the caches, so that an idle worker holds little."""
        self.words.clear()
        self.memo.clear()

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(2)
def codec(path: str | None = None) -> Codec:
    """One codec for each Python worker."""
    return Codec(vocabulary(path))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Ids of every whole text and their decoding: (id_col, ids binary, decoded binary).

    Null counts as empty; an empty text has no ids. Texts are taken one by one, whatever their length; repeated rows give
    repeated results; other columns are ignored. ``path`` names a file of ranks that every executor has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                ids = [c.encode(t) if t else b"" for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array(map(c.decode, ids), pa.binary())], ["id", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, ids binary, decoded binary")
    return out.withColumnRenamed("id", id_col)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Digest columns of :func:`encode`, made where the ids are made, so that ids never leave the worker. A column ``place`` stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        pa.default_memory_pool().release_unused()  # of what this worker did before
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                n, first, second = [], [], []
                for t in part.column(1).to_pylist():
                    ids = c.encode(t) if t else b""
                    n.append(len(ids) // 4)
                    first.append(hashlib.sha256(ids).hexdigest())
                    second.append(hashlib.sha256(c.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(first), pa.array(second), *part.columns[2:]], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *place])
        c.forget()

    kind = docs.schema["doc_id"].dataType.simpleString()
    place = [c for c in docs.columns if c == "place"]
    return docs.select("doc_id", "text", *place).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in place))


def query(spark, sf_dir: str) -> DataFrame:
    """op6: digests of the ids and of the decoded bytes of every document."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))

