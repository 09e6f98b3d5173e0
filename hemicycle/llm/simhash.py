"""SimHash near-dedup (8) over Gray-order hierarchical indexes.

Fingerprints are 64 bits; a bit is 1 if it is set in more than half of the text's shingle hashes.
Equal fingerprints are one node. An index holds the nodes in Gray order, where neighbours share most
leading bits. Its upper nodes are the blocks of equal leading bits; two blocks are never compared in
an index whose upper nodes differ. Within a block the sorted fingerprints stand under a 16-way
hierarchy whose nodes hold the masked pattern their members share; pairs of nodes whose accumulated
differences exceed the radius are pruned with all below them, and so are nodes that one component
holds already. A block returns a spanning forest of its links, never all pairs of a group, and
components are joined by distributed star operations.

`simhash_components` is exact: the 64 bits are cut into radius + 1 segments, and each has an index of
the fingerprints rotated to begin with it; two fingerprints within the radius agree on one segment
at least, so they meet in that index's block. `drop_near_copies` searches indexes of independent
fingerprints and confirms every link by the exact similarity of the shingle sets.

null and empty texts, and texts without words, have fingerprint zero (near copies: no shingles) and
link like any other. A null doc_id is a row of its own that never names a component. Repeated rows
share a fingerprint, so a component. Ties do not arise: components are named by their least doc_id.
Very long texts are fingerprinted whole, in bounded pieces. Other columns are kept by
`drop_near_copies`, whatever their names, and ignored elsewhere. Empty table: no rows.
"""

from __future__ import annotations

import math
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hemicycle.llm._shared import long_id, materialise, mix64, partitions, slices
from hemicycle.llm.components import components

LEAF = 16


def shingle_hashes(text: str, k: int) -> np.ndarray:
    """XXH64 (seed 42) of each k-word shingle, of the whole sequence if shorter; none without words."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    h = xxhash.xxh64_intdigest
    if len(words) <= k:
        return np.array([h(joined, 42)], np.uint64)
    return np.array([h(joined[a : b - 1], 42) for a, b in zip([0, *ends], ends[k - 1 :], strict=False)], np.uint64)


def majorities(hashes: np.ndarray, extra: int = 0) -> list[int]:
    """The 64 bits set in more than half of the hashes, as an unsigned integer; then those of `extra` remixings of the hashes."""
    ones = np.zeros(64 * (extra + 1), np.int64)
    salt = np.arange(extra + 1, dtype=np.uint64)
    for lo in range(0, len(hashes), 2040):
        h = hashes[lo : lo + 2040, None]
        mixed = np.concatenate([h, mix64(h + salt[1:])], 1) if extra else h
        bits = np.unpackbits(mixed.astype(">u8").view(np.uint8), axis=1)
        for at in range(0, len(bits), 255):  # whose sums fit in a byte
            ones += np.add.reduce(bits[at : at + 255], axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes)).view(">u8").tolist()


def majority(hashes: np.ndarray) -> int:
    return majorities(hashes)[0]


def fingerprints(docs: DataFrame, k: int = 5, extra: int = 0, distinct: bool = False) -> DataFrame:
    """doc_id, text_hash, content (a hash of the lower-cased words) and the fingerprint's 64-bit parts f0, f1, ...

    f0 is the fingerprint of the shingles' own hashes; `extra` more parts come from remixed hashes.
    A repeated shingle counts each time, or once if `distinct`.
    """
    names = [f"f{i}" for i in range(extra + 1)]

    def work(batches):
        for b in slices(batches, "text"):
            rows, content = [], []
            for text in b.column(2).to_pylist():
                h = shingle_hashes(text or "", k)
                rows.append(majorities(np.unique(h) if distinct else h, extra))
                content.append(xxhash.xxh64_intdigest(b" ".join((text or "").encode().lower().split()), 7))
            parts = np.array(rows, np.uint64).reshape(-1, extra + 1).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(np.array(content, np.uint64).view(np.int64)), *(pa.array(parts[:, i].copy()) for i in range(extra + 1))],
                names=["doc_id", "text_hash", "content", *names],
            )

    narrow = docs.select(long_id("doc_id").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text"))
    return narrow.mapInArrow(work, "doc_id long, text_hash long, content long, " + ", ".join(f"{n} long" for n in names))


def gray_rank(x: np.ndarray) -> np.ndarray:
    """A code's place in the reflected Gray sequence."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


class _Tree:
    """The masked patterns that runs of 16, 256, ... sorted fingerprints share."""

    def __init__(self, x: np.ndarray):
        self.n = len(x)
        pad = -(-self.n // LEAF) * LEAF
        self.leaves = np.concatenate([x, np.repeat(x[-1:], pad - self.n)]).reshape(-1, LEAF)
        ones, some = np.bitwise_and.reduce(self.leaves, 1), np.bitwise_or.reduce(self.leaves, 1)
        self.levels = [(ones, ~(ones ^ some))]
        while len(ones) > 64:
            pad = -(-len(ones) // LEAF) * LEAF - len(ones)
            ones = np.bitwise_and.reduce(np.concatenate([ones, np.repeat(ones[-1:], pad)]).reshape(-1, LEAF), 1)
            some = np.bitwise_or.reduce(np.concatenate([some, np.repeat(some[-1:], pad)]).reshape(-1, LEAF), 1)
            self.levels.append((ones, ~(ones ^ some)))


class _Forest:
    """Disjoint sets of array positions."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            nxt = self.up[self.up]
            if (nxt == self.up).all():
                return self.up
            self.up = nxt

    def join(self, p: np.ndarray, q: np.ndarray) -> None:
        r = self.roots()
        ends = np.unique(np.sort(np.stack([r[p], r[q]], 1), axis=1), axis=0)
        up = self.up
        for a, b in ends[ends[:, 0] != ends[:, 1]].tolist():
            while up[a] != a:
                a = up[a]
            while up[b] != b:
                b = up[b]
            up[max(a, b)] = min(a, b)

    def whole(self, levels: int) -> list[np.ndarray]:
        """By tree level, the component that all positions under each tree node belong to, or -1."""
        now, out = self.roots(), []
        for _ in range(levels):
            now = np.concatenate([now, np.repeat(now[-1:], -len(now) % LEAF)]).reshape(-1, LEAF)
            now = np.where((now == now[:, :1]).all(1), now[:, 0], -1)
            out.append(now)
        return out


def near_pairs(x: np.ndarray, y: np.ndarray | None, radius: int, forest: _Forest | None = None):
    """Yield index arrays (i, j) of fingerprints within the radius; y None: pairs within x, i < j. Sorted inputs prune best.

    With a forest over x (and y None), groups that are one tree of it by now are passed over: pairs
    inside one component, which add nothing to it, may be left out.
    """
    a = _Tree(x)
    b = _Tree(y) if y is not None else a
    same = y is None
    depth = min(len(a.levels), len(b.levels)) - 1
    i, j = np.divmod(np.arange(len(a.levels[depth][0]) * len(b.levels[depth][0])), len(b.levels[depth][0]))
    stack = [(depth, i, j)]
    joined, work = None, 0
    if forest is not None and (forest.up != np.arange(a.n)).any():
        joined = forest.whole(len(a.levels))
    while stack:
        level, i, j = stack.pop()
        if same:
            i, j = i[i <= j], j[i <= j]
        (pa_, ma), (pb, mb) = a.levels[level], b.levels[level]
        ok = np.bitwise_count((pa_[i] ^ pb[j]) & ma[i] & mb[j]) <= radius
        if forest is not None:
            work += len(i) * (LEAF if level else LEAF * LEAF)
            if work >= 16 * a.n:
                joined, work = forest.whole(len(a.levels)), 0
            if joined is not None:
                ok &= (joined[level][i] < 0) | (joined[level][i] != joined[level][j])
        i, j = i[ok], j[ok]
        step = 2048
        if len(i) > step:
            stack += [(level, i[s : s + step], j[s : s + step]) for s in range(0, len(i), step)]
            continue
        if level:
            kids = np.arange(LEAF)
            ci = np.broadcast_to((i * LEAF)[:, None, None] + kids[:, None], (len(i), LEAF, LEAF)).ravel()
            cj = np.broadcast_to((j * LEAF)[:, None, None] + kids, (len(j), LEAF, LEAF)).ravel()
            ok = (ci < len(a.levels[level - 1][0])) & (cj < len(b.levels[level - 1][0]))
            stack.append((level - 1, ci[ok], cj[ok]))
            continue
        hit = np.flatnonzero(np.bitwise_count(a.leaves[i][:, :, None] ^ b.leaves[j][:, None, :]).ravel() <= radius)
        at, place = np.divmod(hit, LEAF * LEAF)
        p, q = i[at] * LEAF + place // LEAF, j[at] * LEAF + place % LEAF
        ok = (p < a.n) & (q < b.n) & ((p < q) if same else True)
        if ok.any():
            yield p[ok], q[ok]


def _runs(batches):
    """The rows of each run of equal keys (first column) as one array."""
    held: list[np.ndarray] = []
    for b in batches:
        rows = np.stack([np.asarray(c, np.int64) for c in b.columns], 1)
        pieces = np.split(rows, np.flatnonzero(np.diff(rows[:, 0])) + 1) if len(rows) else []
        if pieces and held and held[0][0, 0] == pieces[0][0, 0]:
            held.append(pieces.pop(0))
        if pieces:
            if held:
                yield np.concatenate(held)
            yield from pieces[:-1]
            held = pieces[-1:]
    if held:
        yield np.concatenate(held)


def block_links(rows: DataFrame, radius: int, both: int | None = None) -> DataFrame:
    """Edges (a, b) from each node to the least of its component in each block of rows(key, node, code[, check[, tree]]).

    A block is the rows of one key: codes that share their leading bits. Codes link within `radius`
    bits and, if `both` is given, code and check together within `both`. place is the node's number
    (from 0) among its component's nodes in the block. With a column tree, nodes of one tree are
    joined already and only edges that join trees are given (place 0).
    """
    trees = "tree" in rows.columns

    def search(batches):
        for rows in _runs(batches):
            if len(rows) < 2:
                continue
            rows = rows[np.argsort(gray_rank(rows[:, 2].copy().view(np.uint64)), kind="stable")]
            node, code = rows[:, 1].copy(), rows[:, 2].copy().view(np.uint64)
            forest = _Forest(len(rows))
            if trees:
                _, head, of = np.unique(rows[:, 4], return_index=True, return_inverse=True)
                forest.up = head[of]
                start = np.flatnonzero(forest.up == np.arange(len(rows)))
            for p, q in near_pairs(code, None, radius, forest):
                if both is not None:
                    check = rows[:, 3].copy().view(np.uint64)
                    far = np.bitwise_count(code[p] ^ code[q]) + np.bitwise_count(check[p] ^ check[q])
                    p, q = p[far <= both], q[far <= both]
                if len(p):
                    forest.join(p, q)
            roots = forest.roots()
            if trees:
                moved = start[roots[start] != start]
                if len(moved):
                    yield pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[roots[moved]]), pa.array(np.zeros(len(moved), np.int64))], names=["a", "b", "place"])
                continue
            order = np.lexsort((node, roots))
            first = np.searchsorted(roots[order], roots[order], "left")
            place = np.arange(len(order)) - first
            moved = np.flatnonzero(place)
            if len(moved):
                yield pa.RecordBatch.from_arrays([pa.array(node[order[moved]]), pa.array(node[order[first[moved]]]), pa.array(place[moved])], names=["a", "b", "place"])

    return rows.repartition(partitions(rows.sparkSession), "key").sortWithinPartitions("key").mapInArrow(search, "a long, b long, place long")


def _leading(code, bits: int):
    return F.shiftrightunsigned(code, 64 - bits) if bits else F.lit(0).cast("long")


def link_nodes(nodes: DataFrame, radius: int, block: int = 1024, most_blocks: int = 1 << 20) -> DataFrame:
    """Edges (a, b) that span every component of nodes(node, f0) under Hamming distance <= radius, exactly.

    `block` is the mean number of nodes in a block that is aimed at, within what the radius and
    `most_blocks` allow.
    """
    n, segments = nodes.count(), radius + 1
    bits = max(0, min(64 // segments, (max(n, 1) // block).bit_length(), most_blocks.bit_length() - 1))
    turned = []
    for i in range(segments if bits else 1):
        at = i * 64 // segments
        code = F.shiftleft("f0", at).bitwiseOR(F.shiftrightunsigned("f0", 64 - at)) if at else F.col("f0")
        turned.append(F.struct((_leading(code, bits) * segments + i).alias("key"), "node", code.alias("code")))
    rows = nodes.select(F.explode(F.array(*turned)).alias("r")).select("r.*")
    return block_links(rows, radius).select("a", "b")


def simhash_components(docs: DataFrame, k: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable) of each row."""
    prints = materialise(fingerprints(docs, k).select("doc_id", "f0"), "prints")
    nodes = materialise(prints.groupBy("f0").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(link_nodes(nodes.select(F.col("f0").alias("node"), "f0"), radius))
    named = nodes.join(roots, nodes["f0"] == roots["node"], "left").select("f0", "least", F.coalesce("root", "f0").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = materialise(named.join(least, "root").select("f0", "component_id"), "components")
    return prints.join(of, "f0").select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def similar_pairs(docs: DataFrame, members: DataFrame, k: int, percent: int, cell: int = 1024, cell_shingles: int = 400_000, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """Edges (a, b) that span, within each group of members(node, root, __id, __hash), the links of texts whose k-shingle sets have a Jaccard similarity of percent / 100 or more.

    Exact on the sets, and no pair is compared that links found before already join. A group is cut
    into cells of about `cell` texts or `cell_shingles` shingles. First each cell's texts are
    compared; then one text of each component found, of all cells of a group; then, if the group is not
    one component by now, each text outside its largest component with every text of the group.
    """
    near = F.broadcast(members) if members.count() * 40 <= broadcast_bytes else members
    texts = docs.select(long_id("doc_id").alias("doc_id"), "text").join(near, F.col("doc_id").eqNullSafe(F.col("__id")) & F.xxhash64("text").eqNullSafe(F.col("__hash")))

    def shingle_sets(batches):
        seen: set[int] = set()  # of repeated rows one is enough
        for b in slices(batches, "text"):
            rows = [(node, root, text) for node, root, text in zip(*(c.to_pylist() for c in b.columns), strict=True) if node not in seen and not seen.add(node)]
            sets = [np.unique(shingle_hashes(text or "", k)).tobytes() for _, _, text in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(sets, pa.binary())], names=["node", "root", "shingles"])

    sets = materialise(texts.select("node", "root", "text").mapInArrow(shingle_sets, "node long, root long, shingles binary"), "sets")
    cells = F.ceil(F.greatest(F.count("*") / cell, F.sum(F.length("shingles")) / (8 * cell_shingles)))
    many = materialise(sets.groupBy("root").agg(cells.alias("cells")).where("cells > 1"), "many-cells")
    few = many.count()
    if not few:
        return _compare(sets.withColumns({"cell": F.lit(0).cast("long"), "probe": F.lit(True), "tree": F.col("node")}), percent)
    dealt = sets.join(F.broadcast(many) if few * 16 <= broadcast_bytes else many, "root", "left").withColumn("cells", F.coalesce("cells", F.lit(1).cast("long")))
    dealt = dealt.withColumns({"cell": F.pmod(F.xxhash64("node"), F.col("cells")), "probe": F.lit(True), "tree": F.col("node")})
    inside = materialise(_compare(dealt, percent), "links-inside")
    found = components(inside)
    large = dealt.where("cells > 1").drop("tree").join(found.select("node", F.col("root").alias("tree")), "node", "left").withColumn("tree", F.coalesce("tree", "node"))
    first = large.where(F.col("tree") == F.col("node")).withColumn("cell", F.pmod(F.xxhash64("node"), F.ceil(F.col("cells") / cell)))
    across = materialise(_compare(first, percent), "links-across")
    found = components(inside.unionByName(across))
    large = large.drop("tree").join(found.select("node", F.col("root").alias("tree")), "node", "left").withColumn("tree", F.coalesce("tree", "node"))
    trees = large.groupBy("root", "tree").agg(F.count("*").alias("n"))
    main = trees.groupBy("root").agg(F.max(F.struct("n", "tree"))["tree"].alias("main"), F.count("*").alias("trees")).where("trees > 1")
    large = large.join(main, "root").withColumn("probe", F.col("tree") != F.col("main"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1))
    own = large.select("root", "cell", "node", "tree", "shingles", F.lit(False).alias("probe"))
    sent = large.where("probe").select("root", every.alias("cell"), "node", "tree", "shingles", "probe")
    return inside.unionByName(across).unionByName(_compare(own.unionByName(sent), percent))


def _compare(rows: DataFrame, percent: int) -> DataFrame:
    """Links within each (root, cell) of rows(root, cell, node, tree, shingles, probe): of probes with all texts that are not of one tree."""

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by([("node", "ascending"), ("probe", "descending")])  # a text that is here twice counts as probe
        node, at = np.unique(np.asarray(table.column("node").combine_chunks()), return_index=True)
        probe = table.column("probe").to_numpy(zero_copy_only=False)[at]
        _, head, tree = np.unique(np.asarray(table.column("tree").combine_chunks())[at], return_index=True, return_inverse=True)
        blobs = table.column("shingles")
        sets = [np.frombuffer(blobs[i].as_py(), np.uint64) for i in at.tolist()]
        size = np.array([len(x) for x in sets])
        _, ids, shared = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(node)), size)
        keep = shared[ids] > 1
        ids, owner = ids[keep], owner[keep]
        ends = np.searchsorted(owner, np.arange(len(node) + 1))
        mark = np.zeros(len(shared), bool)
        forest = _Forest(len(node))
        forest.up = head[tree]
        start = forest.up.copy()
        for i in np.flatnonzero(probe).tolist():
            roots = forest.roots()
            if (roots == roots[0]).all():
                break
            mine = ids[ends[i] : ends[i + 1]]
            mark[mine] = True
            common = np.bincount(owner[mark[ids]], minlength=len(node))
            mark[mine] = False
            hit = np.flatnonzero((100 * common >= percent * (size[i] + size - common)) & (roots != roots[i]))
            if len(hit):
                forest.join(np.full(len(hit), i), hit)
        roots = forest.roots()
        moved = np.flatnonzero(roots != start)
        return pa.table({"a": node[moved], "b": node[roots[moved]]})

    held = rows.select("root", "cell", "node", "tree", "shingles", "probe")
    return held.groupBy("root", "cell").applyInArrow(compare, "a long, b long")


def meeting(leading: int, radius: int, both: int, percent: int) -> float:
    """The chance that two texts of that similarity agree on the leading bits of an index and link there."""
    p = math.acos(2 * percent / (100 + percent)) / math.pi  # that a bit differs
    chance = lambda n, d: math.comb(n, d) * p**d * (1 - p) ** (n - d)
    rest = 64 - leading
    return (1 - p) ** leading * sum(chance(rest, d) * sum(chance(64, e) for e in range(both - d + 1)) for d in range(min(radius, rest) + 1))


def plan_indexes(n: int, radius: int, both: int, percent: int, recall: float, block: int) -> tuple[int, int]:
    """Leading bits for blocks of about `block` nodes, and how many indexes then find a pair at the threshold with probability `recall`."""
    leading = max(0, math.ceil(math.log2(max(n, 1) / block)))
    return leading, max(2, math.ceil(math.log(1 - recall) / math.log(1 - meeting(leading, radius, both, percent))))


def candidate_links(nodes: DataFrame, leading: int, indexes: int, radius: int, both: int, reps: int, salt_rows: int, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """Edges (a, b) that span the components of nodes(node, f0, f1, ...) that link in any of the indexes (one of each part).

    A first pass over the first index, whose blocks are salted by a hash of the node, finds large
    groups: of a group of more than `reps` nodes in a salted block the least `reps` go through the
    indexes first, so a block of a third of all nodes is no larger than others by more than that.
    The others follow: each block that holds one of them and is not one component by now is cut into
    cells of about `salt_rows` nodes, and the nodes outside its largest component meet every cell.
    So all nodes are searched in all indexes, whatever `reps` is.
    """
    salts = max(1, nodes.count() // salt_rows)
    key = _leading(F.col("f0"), leading) * salts + F.pmod(F.xxhash64("node"), F.lit(salts))
    thin = materialise(block_links(nodes.select(key.alias("key"), "node", F.col("f0").alias("code"), F.col("f1").alias("check")), radius, both), "first-links")
    late = thin.where(F.col("place") >= reps).select(F.col("a").alias("node")).distinct()
    keys = [_leading(F.col(f"f{i}"), leading) * indexes + i for i in range(indexes)]

    def indexed(nodes: DataFrame, *more: str) -> DataFrame:
        rows = [F.struct(keys[i].alias("key"), "node", F.col(f"f{i}").alias("code"), F.col(f"f{(i + 1) % indexes}").alias("check"), *more) for i in range(indexes)]
        return nodes.select(F.explode(F.array(*rows)).alias("r")).select("r.*")

    links = thin.unionByName(block_links(indexed(nodes.join(late, "node", "left_anti")), radius, both)).select("a", "b")
    held = lambda rows, n: F.broadcast(rows) if n * 24 <= broadcast_bytes else rows
    open_keys = materialise(nodes.join(late, "node", "left_semi").select(F.explode(F.array(*keys)).alias("key")).distinct(), "open-keys")
    n = open_keys.count()
    if not n:
        return links
    links = materialise(links, "links")
    dealt = materialise(nodes.join(components(links).withColumnRenamed("root", "tree"), "node", "left").withColumn("tree", F.coalesce("tree", "node")), "trees")
    trees = indexed(dealt, "tree").join(held(open_keys, n), "key", "left_semi").groupBy("key", "tree").agg(F.count("*").alias("n"))
    blocks = trees.groupBy("key").agg(F.max(F.struct("n", "tree"))["tree"].alias("main"), F.ceil(F.sum("n") / salt_rows).alias("cells"), F.count("*").alias("trees")).where("trees > 1").drop("trees")
    blocks = materialise(blocks, "open-blocks")
    n = blocks.count()
    if not n:
        return links
    own, every = F.array(F.pmod(F.xxhash64("node"), F.col("cells"))), F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)
    rows = indexed(dealt, "tree").join(held(blocks, n), "key").withColumn("cell", F.explode(F.when(F.col("tree") == F.col("main"), own).otherwise(every)))
    rest = block_links(rows.select(F.xxhash64("key", "cell").alias("key"), "node", "code", "check", "tree"), radius, both)
    return links.unionByName(rest.select("a", "b"))


def drop_near_copies(docs: DataFrame, k: int = 5, percent: int = 80, recall: float = 0.98, radius: int = 13, both: int = 28, block: int = 4096, reps: int = 64, salt_rows: int = 65_536, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """The rows of docs without near copies: of each group the row with the smallest doc_id (null last) stays.

    Texts of equal words are copies. Others are linked if the Jaccard similarity of their k-word
    shingle sets is percent / 100 or more, compared exactly among the texts of a candidate group.
    Candidate groups come from Gray-order indexes of independent fingerprints of the distinct shingles
    (64-bit parts, each checked against the next one): links of equal leading bits that differ in at most
    `radius` bits of the part and `both` of the two. The leading bits follow the number of texts, and the number
    of indexes follows from them such that a pair at the threshold is found with the probability `recall`
    (more alike pairs more surely), at any size and in groups of any size. Blocks keep their size, so the work of an index is in
    proportion to the texts; the indexes grow with their number to the power of 0.24.
    """
    leading, indexes = plan_indexes(docs.count(), radius, both, percent, recall, block)
    parts = [f"f{i}" for i in range(indexes)]
    prints = materialise(fingerprints(docs, k, extra=indexes - 1, distinct=True), "prints")
    # texts of equal words are one node from here on: their least row and their number are aggregates
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    nodes = materialise(prints.groupBy(F.col("content").alias("node")).agg(F.min(row).alias("row"), F.count("*").alias("n"), *(F.first(c).alias(c) for c in parts)), "nodes")
    near = components(candidate_links(nodes.drop("row", "n"), leading, indexes, radius, both, reps, salt_rows, broadcast_bytes))
    near = near.unionByName(near.select(F.col("root").alias("node"), "root").distinct())
    least = nodes.select("node", "row").join(near, "node")
    members = materialise(least.select("node", "root", F.col("row.doc_id").alias("__id"), F.col("row.text_hash").alias("__hash")), "candidates")
    roots = components(similar_pairs(docs, members, k, percent, broadcast_bytes=broadcast_bytes))
    of = nodes.select("node", "row", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = of.groupBy("root").agg(F.min("row").alias("kept"), F.sum("n").alias("n"))
    groups = materialise(of.select("node", "root").join(first.where("n > 1").select("root", "kept"), "root").select(F.col("node").alias("content"), "kept"), "groups")
    copies = materialise(prints.select("doc_id", "text_hash", "content").join(groups, "content").withColumn("stays", row.eqNullSafe(F.col("kept"))).groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "stays").agg(F.count("*").alias("n")), "copies")
    n, repeats = copies.agg(F.count("*"), F.count(F.when(F.col("stays") & (F.col("n") > 1), 1))).first()

    def on(rows: DataFrame, how: str) -> DataFrame:
        rows = F.broadcast(rows) if n * 24 <= broadcast_bytes else rows
        return docs.join(rows, docs["doc_id"].cast("long").eqNullSafe(rows["__id"]) & (F.xxhash64(docs["text"]) == rows["__hash"]), how)

    if not repeats:
        return on(copies.where("not stays").select("__id", "__hash"), "left_anti")
    again = copies.where("not stays or n > 1").select("__id", "__hash")
    once = on(copies.where("stays and n > 1").select("__id", "__hash"), "left_semi")
    return on(again, "left_anti").unionByName(once.dropDuplicates(["doc_id", "text"]))
