"""Operator 5: near-duplicate components by a chosen-path set similarity join.

Every document's set of five-word shingles is embedded as 64 minwise tokens. A tree branches documents: a node picks one or two
token positions, and documents go on together while they have the same token there. A node with few documents compares them
exhaustively; a node with many compares all with its first document and branches further. Independent trees are repeated until
the recall is as wanted. Every link is confirmed on the full sets. Equal sets are one class from the start, so copies cost nothing.

A large node whose documents nearly all resemble its first one (a large group of near copies) would not fall apart by branching.
It is finished exactly, as are nodes that are still large at the last level: whatever is not yet in one component with the rest of
its node is compared with all of the node that an exact bound leaves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenflow.llm.common import by_ids, pieces, raw_texts, small, stored, table, utf8
from lumenflow.llm.shingles import common, mix, shingle_sets

SIMILARITY = 75  # in hundredths
POSITIONS = 64
#: Independent trees. Two documents of similarity 0.75 share a token at a position with probability 0.75; the roots of all trees
#: use 20 different positions, so a pair is missed at the first level with probability 0.25 ** 20.
TREES = 12
#: Positions that a node picks on average: 1 / 0.6, more than 1 / 0.75, so that a similar pair survives each level.
SECOND = 0.667
LEVELS = 4
NODE = 32  # documents that a node compares exhaustively
#: Share of a large node's documents that resemble its first one, from which on the node is finished exactly and not branched.
COHERENT = 0.875
SALTS = 16
#: Documents of a block, about. Those of a block that are in one node are one row: a large node is a few rows of each block.
DOCUMENTS = 1024
#: Equal tokens that a candidate needs: of 64, a pair of similarity 0.75 has 34 or more with probability over 0.9999.
MATCHES = 34

_rng = np.random.default_rng(5)
_A = _rng.integers(1, 1 << 63, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, POSITIONS, dtype=np.uint64)


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """Minwise tokens, a row of 64 for each set; zeros for an empty set."""
    sizes = np.array([len(s) for s in sets])
    out = np.zeros((len(sets), POSITIONS), np.uint32)
    full = np.flatnonzero(sizes)
    if len(full):
        flat = np.concatenate([sets[i] for i in full])
        starts = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
        for k in range(POSITIONS):
            out[full, k] = np.minimum.reduceat((flat * _A[k] + _B[k]) >> np.uint64(32), starts)
    return out


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n_shingles, digest, sketch) of every text; digest names the set and is null for an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(1))
            for i, j in pieces(at, 1 << 20):
                sets = shingle_sets(raw_texts(data, at, i, j))
                tokens = sketch(sets)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                        pa.array([t.tobytes() for t in tokens], pa.binary()),
                    ],
                    ["id", "n_shingles", "digest", "sketch"],
                )

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, "id long, n_shingles long, digest binary, sketch binary")


def _tokens(column: pa.Array) -> np.ndarray:
    return np.frombuffer(utf8(column)[0].tobytes(), np.uint32).reshape(-1, POSITIONS)


def _ids(a: np.ndarray) -> pa.Array:
    return pa.array(a.astype(np.int64) if a.dtype != np.uint64 else a.view(np.int64), pa.int64())


def _child(node: np.ndarray, position: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix(mix(node ^ (position.astype(np.uint64) << np.uint64(40))) + token.astype(np.uint64))


#: Positions that the roots pick, a tree after the other.
SPOTS = np.random.default_rng(7).permutation(POSITIONS)[: round(TREES * (1 + SECOND))]


def _root_nodes(t: np.ndarray) -> np.ndarray:
    """The children of the trees' roots that documents are in, a column for each pick."""
    return np.stack([_child(np.full(len(t), k % TREES, np.uint64), np.full(len(t), p), t[:, p]) for k, p in enumerate(SPOTS.tolist())], 1)


def _picks(node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The one or two positions that nodes pick, and whether there are two."""
    x = mix(node + np.uint64(99))
    first, second = (x & np.uint64(63)).astype(np.int64), ((x >> np.uint64(6)) & np.uint64(63)).astype(np.int64)
    return first, second, ((x >> np.uint64(32)) % np.uint64(1000) < np.uint64(round(1000 * SECOND))) & (first != second)


def _packed(node: np.ndarray, ids: np.ndarray, block: int) -> pa.Table:
    """(node, block, ids): the documents of each node, a row for each node."""
    order = np.argsort(node, kind="stable")
    node = node[order]
    new = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1]))) if len(node) else np.zeros(0, np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.append(new, len(node)), pa.int32()), _ids(ids[order]))
    return pa.table([_ids(node[new]), pa.array(np.full(len(new), block), pa.int64()), lists], ["node", "block", "ids"])


PACKS = "node long, block long, ids array<long>"


def blocks(tokens: DataFrame) -> DataFrame:
    """(block, id, sketch): documents dealt by a hash of the id to blocks of about DOCUMENTS."""
    many = max(1, -(-tokens.count() // DOCUMENTS))
    return tokens.select(F.pmod(F.xxhash64("id"), F.lit(many)).alias("block"), "id", "sketch")


def roots(dealt: DataFrame) -> DataFrame:
    """(node, block, ids): the documents of each block that are in each child of the trees' roots."""

    def run(docs: pa.Table) -> pa.Table:
        nodes = _root_nodes(_tokens(docs["sketch"]))
        return _packed(nodes.reshape(-1), np.repeat(docs["id"].to_numpy(), nodes.shape[1]), docs["block"][0].as_py())

    return dealt.groupBy("block").applyInArrow(run, PACKS)


def _entries(docs: pa.Table, packs: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of a block's documents; and for each document of each of the block's packs, its place among the former and the pack."""
    order = np.argsort(docs["id"].to_numpy())
    lists = packs["ids"].combine_chunks()
    place = order[np.searchsorted(docs["id"].to_numpy()[order], lists.flatten().to_numpy())] if len(packs) else np.zeros(0, np.int64)
    return _tokens(docs["sketch"]), place, np.repeat(np.arange(len(packs)), np.diff(lists.offsets.to_numpy()))


def likenesses(large: DataFrame, dealt: DataFrame) -> DataFrame:
    """Two kinds of rows out of packs (node, block, ids, pivot): (id, pivot) of the documents that have MATCHES tokens of a first document
    before them, and (node, likes, n), how many of the n documents of a pack have so many, itself included.

    The packs of a block meet its documents as one group. A document meets the same first document in many nodes: they are compared
    once. Who is in a node is nowhere written as a row for each."""
    schema = pa.schema([("id", pa.int64()), ("pivot", pa.int64()), ("node", pa.int64()), ("likes", pa.int64()), ("n", pa.int64())])

    def run(docs: pa.Table, packs: pa.Table) -> pa.Table:
        if not len(packs):
            return schema.empty_table()
        t, place, of = _entries(docs, packs)
        pivots, which = np.unique(packs["pivot"].to_numpy(), return_inverse=True)
        first = np.zeros((len(pivots), POSITIONS), np.uint32)
        first[which] = _tokens(packs["first"])
        met, back = np.unique(which[of] * len(t) + place, return_inverse=True)
        pivot, doc = np.divmod(met, len(t))
        same = lambda i: (t[doc[i : i + 16384]] == first[pivot[i : i + 16384]]).sum(1) >= MATCHES
        like = np.concatenate([same(i) for i in range(0, len(met), 16384)])
        ids, pivot = docs["id"].to_numpy()[doc], pivots[pivot]
        star = like & (ids > pivot)
        n = np.bincount(of, minlength=len(packs))
        none = lambda k: pa.nulls(k, pa.int64())
        pairs = pa.table([_ids(ids[star]), _ids(pivot[star]), *[none(int(star.sum()))] * 3], schema=schema)
        counts = pa.table([*[none(len(n))] * 2, packs["node"], _ids(np.bincount(of, like[back], len(n))), _ids(n)], schema=schema)
        return pa.concat_tables([pairs, counts])

    # A third of all documents can have one first document: its sketch is repeated for SALTS parts of the blocks.
    firsts = dealt.join(large.select(F.col("pivot").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("pivot"), F.col("sketch").alias("first"))
    firsts = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    packs = large.withColumn("salt", F.pmod("block", F.lit(SALTS)).cast("int")).join(firsts, ["pivot", "salt"]).select("block", "node", "ids", "pivot", "first")
    return dealt.groupBy("block").cogroup(packs.groupBy("block")).applyInArrow(run, "id long, pivot long, node long, likes long, n long")


def branches(large: DataFrame, dealt: DataFrame) -> DataFrame:
    """(node, block, ids): the one or two children that each document of packs (node, block, ids) goes on to."""

    def run(docs: pa.Table, packs: pa.Table) -> pa.Table:
        if not len(packs):
            return _packed(np.zeros(0, np.uint64), np.zeros(0, np.int64), 0)
        t, place, of = _entries(docs, packs)
        node = packs["node"].to_numpy().view(np.uint64)[of]
        first, second, two = _picks(node)
        ids = docs["id"].to_numpy()[place]
        child = np.concatenate([_child(node, first, t[place, first]), _child(node[two], second[two], t[place[two], second[two]])])
        return _packed(child, np.concatenate([ids, ids[two]]), docs["block"][0].as_py())

    return dealt.groupBy("block").cogroup(large.select("block", "node", "ids").groupBy("block")).applyInArrow(run, PACKS)


def node_pairs(rows: DataFrame) -> DataFrame:
    """(a, b): all pairs of nodes of at most NODE documents, from (node, id, sketch), that have MATCHES equal tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in _then_none(batches):
            if batch is not None:
                node, ids, t = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _tokens(batch.column(2))
                if left is not None:
                    node, ids, t = (np.concatenate(p) for p in zip(left, (node, ids, t), strict=True))
                cut = np.searchsorted(node == node[-1], True) if len(node) else 0  # the last node may go on
                left = (node[cut:], ids[cut:], t[cut:])
                node, ids, t = node[:cut], ids[:cut], t[:cut]
            elif left is not None:
                node, ids, t = left
            else:
                continue
            # Rows are sorted by node: compare each with the one k places further while that is in the same node.
            for k in range(1, NODE):
                at = np.flatnonzero(node[k:] == node[:-k]) if k < len(node) else np.zeros(0, np.int64)
                if not len(at):
                    break
                for i in range(0, len(at), 65536):
                    u, v = at[i : i + 65536], at[i : i + 65536] + k
                    good = ((t[u] == t[v]).sum(1) >= MATCHES) & (ids[u] != ids[v])
                    if good.any():
                        a, b = ids[u[good]], ids[v[good]]
                        yield pa.RecordBatch.from_arrays([_ids(np.minimum(a, b)), _ids(np.maximum(a, b))], ["a", "b"])

    return rows.select("node", "id", "sketch").repartition("node").sortWithinPartitions("node", "id").mapInArrow(run, "a long, b long")


def _then_none(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def candidates(tokens: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Candidate pairs (a, b) of documents with different sets, and (node, id) of the large nodes that are left to be finished."""
    dealt = blocks(tokens)
    frontier, few, stars, rest = stored(roots(dealt), even=True), [], [], []
    for level in range(LEVELS):
        size = frontier.groupBy("node").agg(F.sum(F.size("ids")).alias("n"), F.min(F.array_min("ids")).alias("pivot")).filter("n > 1")
        rows = stored(frontier.join(size, "node"), even=True)
        few.append(rows.filter(f"n <= {NODE}").select("node", "ids"))
        large = rows.filter(f"n > {NODE}")
        if large.isEmpty():
            break
        met = stored(likenesses(large, dealt), even=True)
        stars.append(met.filter("node is null").select(F.col("pivot").alias("a"), F.col("id").alias("b")))
        if level < LEVELS - 1:
            alike = stored(met.filter("node is not null").groupBy("node").agg((F.sum("likes") / F.sum("n")).alias("share")), even=True)
            mixed = alike.filter(f"share < {COHERENT}").select("node")
            rest.append(large.join(alike.filter(f"share >= {COHERENT}").select("node"), "node").select("node", "ids"))
            if mixed.isEmpty():
                break
            frontier = stored(branches(large.join(mixed, "node"), dealt), even=True)
        else:
            rest.append(large.select("node", "ids"))
    each = lambda packs: _all(packs).select("node", F.explode("ids").alias("id"))
    pairs = node_pairs(each(few).join(tokens, "id"))
    return stored(_all([pairs, *stars]).distinct(), even=True), each(rest) if rest else None


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def overlaps(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(a, b, na, nb, both): sizes of the full sets of pairs (a, b), a stored table, and of their intersections."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            a_ids = batch.column(0).to_pylist()
            (da, ata), (db, atb) = utf8(batch.column(2)), utf8(batch.column(3))
            out = []
            for i, j in pieces(atb, 1 << 20):
                theirs = shingle_sets(raw_texts(db, atb, i, j))
                for k in range(i, j):
                    if last is None or a_ids[k] != last:
                        last, held = a_ids[k], shingle_sets(raw_texts(da, ata, k, k + 1))[0]
                    out.append((len(held), len(theirs[k - i]), common(held, theirs[k - i])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else ((), (), ())))], ["a", "b", "na", "nb", "both"])

    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))
    texts = by_ids(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), ids, "id", "left_semi")
    of = lambda c: texts.select(F.col("id").alias(c), F.col("text").alias(f"t{c}"))
    return pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long, na long, nb long, both long")


def confirmed(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Of pairs (a, b), those whose full sets are similar."""
    return overlaps(pairs, docs, id_col, text_col).filter(f"100 * both >= {SIMILARITY} * (na + nb - both)").select("a", "b")


def components(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(id, root): every id of ``links`` (a, b) that is not the smallest of its connected component, with that smallest.

    ``known`` is the result for earlier links, which count too. A round is a large-star and a small-star step; the number of rounds
    goes with the logarithm of the size. The rounds end when every id has one root and no root has another."""
    stars = links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).filter("u < v")
    if known is not None:
        stars = stars.unionByName(known.select(F.col("id").alias("v"), F.col("root").alias("u")))
    while True:
        sent = F.broadcast if small(stars) else lambda d: d
        both = stars.unionByName(stars.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        large = both.join(sent(least), "v").filter("u > v").select(F.col("u").alias("v"), F.col("m").alias("u"))
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        moved = large.join(sent(least), "v").filter("u > m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        stars = stored(least.select("v", F.col("m").alias("u")).unionByName(moved).distinct(), even=True)
        ends = stars.select(F.col("v").alias("x"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(stars.select(F.col("u").alias("x"), F.lit(0).alias("below"), F.lit(1).alias("above")))
        if ends.groupBy("x").agg(F.sum("below").alias("below"), F.max("above").alias("above")).filter("below > 1 or below = 1 and above = 1").isEmpty():
            return stars.select(F.col("v").alias("id"), F.col("u").alias("root"))


def _across(pairs: DataFrame, roots_: DataFrame) -> DataFrame:
    """Pairs (a, b) whose ends are not in one component yet."""
    of = lambda c: roots_.select(F.col("id").alias(c), F.col("root").alias(f"r{c}"))
    out = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return out.filter("coalesce(ra, a) <> coalesce(rb, b)").select("a", "b")


def _mixed(rest: DataFrame, roots_: DataFrame) -> DataFrame:
    """(node, id, root) of the nodes that hold more than one component."""
    held = stored(rest.join(roots_, "id", "left").select("node", "id", F.coalesce("root", "id").alias("root")), even=True)
    several = held.groupBy("node").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least < most")
    return stored(held.join(stored(several.select("node"), even=True), "node"), even=True)


def _shared(ids: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, alone): of the documents ``ids``, how many shingles of each no other of them has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(1))
            who = batch.column(0).to_numpy()
            for i, j in pieces(at, 1 << 20):
                sets = shingle_sets(raw_texts(data, at, i, j))
                yield pa.RecordBatch.from_arrays([_ids(np.repeat(who[i:j], [len(s) for s in sets])), _ids(np.concatenate(sets))], ["id", "shingle"])

    texts = by_ids(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), ids, "id", "left_semi")
    each = texts.mapInArrow(run, "id long, shingle long").groupBy("shingle").agg(F.min("id").alias("id"), F.max("id").alias("last"))
    alone = each.filter("id = last").groupBy("id").agg(F.count(F.lit(1)).alias("alone"))
    return ids.join(alone, "id", "left").select("id", F.coalesce("alone", F.lit(0)).alias("alone"))


#: Rows of a block of a large node, about.
BLOCK = 1024


def _block_pairs(known: DataFrame) -> DataFrame:
    """(a, b): from (node, id, root, main, n, p, r, sketch, nodes), the documents outside the main component of their node with those
    of other components, as far as the bound and MATCHES equal tokens leave them. Two documents that meet in several nodes (``nodes``
    lists those of a document) are a pair in the first of them only.

    Both sides are cut into blocks by a hash of the id, and every pair of blocks is a group of its own: groups are of bounded size,
    and a large node is spread over many tasks."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        sides = []
        for side, none in ((left, 0), (right, 1)):
            t = np.frombuffer(b"".join(side["sketch"].to_pylist()), np.uint32).reshape(-1, POSITIONS)
            lists = side["nodes"].to_pylist()
            nodes = np.full((len(lists), max(map(len, lists), default=0)), none, np.int64)
            for k, its in enumerate(lists):
                nodes[k, : len(its)] = its
            sides.append(([side[f].to_numpy() for f in ("id", "root", "n", "p", "r")], t, nodes))
        (x, s, of_x), (y, t, of_y) = sides
        (i, root, n, p, r), (j, root2, n2, p2, r2) = ([v[:, None] for v in x], [v[None, :] for v in y])
        most = np.minimum(p, p2) + np.maximum(0, np.minimum(r, r2))
        u, v = np.nonzero((root != root2) & (100 * most >= SIMILARITY * (n + n2 - most)))
        good = np.concatenate([np.zeros(0, bool), *((s[u[m : m + 16384]] == t[v[m : m + 16384]]).sum(1) >= MATCHES for m in range(0, len(u), 16384))])
        u, v = u[good], v[good]
        here, open_ = np.zeros(len(u), bool), np.arange(len(u))
        for k in range(of_x.shape[1] if len(u) else 0):  # nodes are sorted: the first that both have decides
            mine = of_x[u[open_], k]
            met = (mine[:, None] == of_y[v[open_]]).any(1)
            here[open_[met]] = mine[met] == left["node"][0].as_py()
            open_ = open_[~met]
        a, b = i[u[here], 0], j[0, v[here]]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)}, schema=pa.schema({"a": pa.int64(), "b": pa.int64()}))

    parts = lambda n: F.ceil(n / BLOCK).cast("int")
    size = known.groupBy("node").agg(parts(F.count(F.lit(1))).alias("many"), parts(F.count_if(F.col("root") != F.col("main"))).alias("few")).filter("few > 0")
    dealt = known.join(stored(size, even=True), "node")
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = lambda: [F.col(c).alias(c) for c in ("node", "id", "root", "n", "p", "r", "sketch", "nodes")]
    outside = dealt.filter("root <> main").select(own("few").alias("k"), every("many").alias("l"), *columns())
    whole = dealt.select(every("few").alias("k"), own("many").alias("l"), *columns())
    return outside.groupBy("node", "k", "l").cogroup(whole.groupBy("node", "k", "l")).applyInArrow(run, "a long, b long")


def _finish(rest: DataFrame, roots_: DataFrame, sizes: DataFrame, tokens: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Components after the large nodes that are left are finished.

    A node's pivot is the document with the fewest shingles that no other document of these nodes has. Two documents share at most
    the lesser of what each shares with the pivot, and of what each has beside it that is not its own alone. This bound leaves few
    pairs of the documents outside the pivot's component with those of other components; they are compared."""
    held = _mixed(rest, roots_)
    if held.isEmpty():
        return roots_
    nodes = stored(held.groupBy("id").agg(F.sort_array(F.collect_set("node")).alias("nodes")), even=True)  # as many as there are ways down, at most
    alone = _shared(nodes.select("id"), docs, id_col, text_col).join(sizes, "id").join(nodes, "id").select("id", "n", "alone", "nodes")
    rows = held.join(stored(alone, even=True), "id")
    pivot = rows.groupBy("node").agg(F.min(F.struct("alone", "id", "root")).alias("p")).select("node", F.col("p.id").alias("pivot"), F.col("p.root").alias("main"))
    rows = stored(rows.join(stored(pivot, even=True), "node"), even=True)
    to_try = stored(rows.filter("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct(), even=True)
    tried = stored(overlaps(to_try, docs, id_col, text_col), even=True)
    links = tried.filter(f"100 * both >= {SIMILARITY} * (na + nb - both)").select("a", "b")
    # What a link with the pivot joins belongs to the pivot's component now.
    both = tried.select(F.col("a").alias("pivot"), F.col("b").alias("id"), "both", F.expr(f"100 * both >= {SIMILARITY} * (na + nb - both)").alias("linked"))
    met = rows.join(both, ["pivot", "id"], "left")
    joined = met.groupBy("node", "root").agg(F.max(F.coalesce("linked", F.lit(False))).alias("joined")).filter("joined")
    known = met.join(stored(joined, even=True), ["node", "root"], "left").join(tokens, "id")
    known = stored(known.selectExpr("node", "id", "if(joined, main, root) as root", "main", "n", "coalesce(both, n) as p", "n - alone - coalesce(both, n) as r", "sketch", "nodes"), even=True)
    left = _block_pairs(known).distinct().join(tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    left = stored(left, even=True)
    return components(links if left.isEmpty() else links.unionByName(stored(confirmed(left, docs, id_col, text_col), even=True)), roots_)


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (id_col, n_shingles, component_id, kept).

    Null counts as empty; texts without words are linked with nothing. Texts of one to four words are one shingle. Rows without
    an id are linked with nothing and kept, with a null component. Rows that repeat an id stand for one document. Other columns
    are ignored."""
    docs = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias(text_col))
    every = stored(sketches(docs, id_col, text_col))
    sets = every.filter("id is not null and digest is not null")
    # Equal sets have equal sketches: a class is named by its smallest id.
    classes = stored(sets.groupBy("digest").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"), F.any_value("sketch").alias("sketch")), even=True)
    tokens = classes.select(F.col("rep").alias("id"), "sketch")
    copies = sets.select("id", "digest").join(classes.filter("n > 1").select("digest", "rep"), "digest").select("id", "rep")
    pairs, rest = candidates(tokens)
    # First one pair for each document, to its smallest and its largest candidate; then only pairs that could still join components.
    first = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b").unionByName(pairs.groupBy("a").agg(F.max("b").alias("b")).select("a", "b"))
    first = stored(first.distinct(), even=True)
    links = confirmed(first, docs, id_col, text_col)
    twice = sets.groupBy("id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("id")
    if not twice.isEmpty():  # an id that stands in several classes joins them
        several = sets.join(twice, "id").select("id", "digest").join(classes, "digest")
        links = links.unionByName(several.select(F.col("rep").alias("a"), F.col("id").alias("b")))
    links = stored(links, even=True)
    named = stored(links.filter("a < b").groupBy("b").agg(F.min("a").alias("root")).withColumnRenamed("b", "id"), even=True)
    left = stored(_across(pairs.join(first, ["a", "b"], "left_anti"), named), even=True)
    roots_ = components(links if left.isEmpty() else links.unionByName(stored(confirmed(left, docs, id_col, text_col), even=True)))
    if rest is not None:
        roots_ = _finish(rest, roots_, sets.groupBy("id").agg(F.max("n_shingles").alias("n")), tokens, docs, id_col, text_col)
    of_copies = copies.filter("id > rep").join(roots_.select(F.col("id").alias("rep"), "root"), "rep", "left").select("id", F.coalesce("root", "rep").alias("root"))
    labels = of_copies.unionByName(roots_).groupBy("id").agg(F.min("root").alias("root"))
    component = F.coalesce("root", "id")
    out = every.select("id", "n_shingles").join(labels, "id", "left")
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def unique(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: one document of each component. All columns stay."""
    gone = stored(near_components(docs, id_col, text_col).filter("not kept").select(id_col).distinct())
    return by_ids(docs, gone, id_col, "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    """op5: component of every document."""
    return near_components(table(spark, sf_dir, "documents"))
