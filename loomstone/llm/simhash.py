"""SimHash near-duplicates: fingerprints, links within a Hamming radius through shard BK-trees, classes.

Fingerprints that differ in at most ``radius`` of 64 bits agree fully on at least two of ``radius + 2``
bit blocks, so every pair of blocks deals the distinct fingerprints into shards such that each link lies
inside some shard. A shard builds one BK-tree and follows only edges within the radius. The trees are
dealt out with their rows instead of broadcast: together they are as large as the corpus. A shard with
more than ``tree_limit`` fingerprints is split into several trees that its other members visit as queries.

Defined results: a null or wordless text has fingerprint zero and links like any other; repeated rows and
rows with a null doc_id are linked by their text and keep their rows; doc_id null comes out as null and
never names a class unless the whole class has no other id. Only doc_id and text are read, so other
columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm.components import components
from loomstone.llm.scratch import cut, discard, discard_since, join_hot, small_batches, sweep, written
from loomstone.llm.textcore import SPACE_WORDS, passes, releasing, run_hashes, scan, word_hashes

SHINGLE_WORDS = 4
RADIUS = 4
TREE_LIMIT = 2048
_SIGN = 1 << 63


def fingerprints_of(texts: pa.Array, shingle: int = SHINGLE_WORDS, seed: int = 42) -> np.ndarray:
    """Unsigned 64-bit SimHash of each text over XXH64 of its lower-cased word shingles."""
    words = scan(texts, SPACE_WORDS, lower=True)
    buf, starts, ends = words.joined()
    data, counts = buf.tobytes(), words.counts
    # One shingle starts at each word with shingle - 1 words behind it in its text; short texts give one.
    has = counts > 0
    n_shingles = np.where(has, np.maximum(counts - shingle + 1, 1), 0)
    doc = np.repeat(np.arange(len(counts)), n_shingles)
    first_of_doc = np.cumsum(n_shingles) - n_shingles
    at = words.first[doc] + np.arange(len(doc)) - first_of_doc[doc]
    last = np.minimum(at + shingle, words.first[doc + 1]) - 1
    digest = xxhash.xxh64_digest
    joined = b"".join([digest(data[a:b], seed) for a, b in zip(starts[at].tolist(), ends[last].tolist(), strict=True)])
    out = np.zeros(len(counts), dtype=np.uint64)
    if len(at):
        bits = np.unpackbits(np.frombuffer(joined, dtype=np.uint8).reshape(-1, 8), axis=1)
        ones = np.add.reduceat(bits, first_of_doc[has], axis=0, dtype=np.int32)
        major = 2 * ones > n_shingles[has][:, None]
        out[has] = np.packbits(major, axis=1).view(">u8").ravel()
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE_WORDS, seed: int = 42) -> DataFrame:
    """Rows (doc_id, fp long), one for each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in passes(batch, "text", 1 << 20):
                fp = fingerprints_of(part.column("text"), shingle, seed).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


class BKTree:
    """Values in a tree whose children are keyed by their integer Hamming distance to the parent."""

    __slots__ = ("root", "children")

    def __init__(self) -> None:
        self.root: int | None = None
        self.children: dict[int, dict[int, int]] = {}

    def add(self, value: int) -> None:
        if self.root is None:
            self.root, self.children[value] = value, {}
            return
        node = self.root
        while distance := (node ^ value).bit_count():
            below = self.children[node]
            if distance not in below:
                below[distance], self.children[value] = value, {}
                return
            node = below[distance]

    def within(self, value: int, radius: int) -> list[int]:
        """Values of the tree at ``radius`` or fewer bits; follows edges in [d - radius, d + radius] only."""
        found, stack = [], [] if self.root is None else [self.root]
        while stack:
            node = stack.pop()
            distance = (node ^ value).bit_count()
            if distance <= radius:
                found.append(node)
            below = self.children[node]
            if below:
                stack += [child for d, child in below.items() if -radius <= d - distance <= radius]
        return found


def block_bounds(blocks: int) -> list[tuple[int, int]]:
    """(shift, width) of ``blocks`` nearly equal bit blocks of 64 bits."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def shard_keys(fp, radius: int):
    """The shard keys of a fingerprint column: two of radius + 2 bit blocks, with the pair's number."""
    keys = []
    for number, pair in enumerate(combinations(block_bounds(radius + 2), 2)):
        key = F.lit(number).cast("long")
        for shift, width in pair:
            key = F.shiftleft(key, width).bitwiseOR(F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1)))
        keys.append(key)
    return F.array(*keys)


def _star_links(members: list[tuple[int, int]], radius: int) -> list[tuple[int, int]]:
    """Links of one shard as stars; members: (fingerprint, 1 if it belongs into the tree else 0)."""
    tree, parent = BKTree(), {}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for value, own in sorted(members, key=lambda m: -m[1]):
        parent.setdefault(value, value)
        for other in tree.within(value, radius):
            a, b = find(value), find(other)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if own:
            tree.add(value)
    return [(x, r) for x in parent if (r := find(x)) != x]


def links(distinct_fps: DataFrame, radius: int = RADIUS, tree_limit: int = TREE_LIMIT) -> DataFrame:
    """Edges (u, v) between distinct fingerprints whose closure is all links at ``radius`` or fewer bits."""
    keyed = distinct_fps.select("fp", F.explode(shard_keys(F.col("fp"), radius)).alias("shard"))
    sizes = keyed.groupBy("shard").agg(F.count("*").alias("n")).where("n > 1")
    trees = F.ceil(F.col("n") / tree_limit).cast("int")
    dealt = (
        keyed.join(sizes, "shard")
        .withColumn("own", F.pmod(F.xxhash64("fp"), trees).cast("int"))
        .select("fp", "shard", "own", F.explode(F.sequence(F.lit(0), "own")).alias("tree"))
        .select("shard", "tree", "fp", (F.col("own") == F.col("tree")).cast("int").alias("inside"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(members: list, out: list) -> None:
            if len(members) > 1:
                out += _star_links(members, radius)

        key, members = None, []
        for batch in batches:
            out: list[tuple[int, int]] = []
            shard, tree, fp, inside = (batch.column(i).to_pylist() for i in range(4))
            for k in zip(shard, tree, fp, inside, strict=True):
                if k[:2] != key:
                    flush(members, out)
                    key, members = k[:2], []
                members.append((k[2] & 0xFFFFFFFFFFFFFFFF, k[3]))
            if out:
                yield edge_batch(out)
        out = []
        flush(members, out)
        yield edge_batch(out)

    def edge_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
        ends = np.array(pairs, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["u", "v"])

    return dealt.repartition("shard", "tree").sortWithinPartitions("shard", "tree").mapInArrow(releasing(run), "u long, v long").distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE_WORDS, seed: int = 42, tree_limit: int = TREE_LIMIT) -> DataFrame:
    """Rows (doc_id, fp, component_id): component_id is the smallest doc_id reachable over links."""
    small_batches(docs.sparkSession)
    prints = cut(fingerprints(docs, shingle, seed), "simhash")
    least = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "simhash-distinct")
    roots = components(links(least.select("fp"), radius, tree_limit), "simhash-links").withColumnsRenamed({"node": "fp"})
    linked = least.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = cut(linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "simhash-classes")
    # One row for each fingerprint, whose class and whose own rows may both be large.
    classes = cut(join_hot(linked.withColumnRenamed("n", "rows"), named, "root", "n").select("fp", "component_id", "rows"), "simhash-named")
    discard(least, named)
    return join_hot(prints, classes, "fp", "rows").select("doc_id", "fp", "component_id")


# Documents of a given similarity: fingerprints and shared shingles propose, the exact shingle sets decide.
SIMILARITY = 0.8
PROPOSAL_RADIUS = 3
#: Members of a shingle's list that are compared with each other at a time; results do not depend on it.
LIST_BLOCK = 256
#: Proposals before all pairs are compared: pairs of each node, and how far in a list; results do not depend on them.
PROPOSALS, REACH = 4, 32
#: Bits of a set's sketch.
SKETCH_BITS = 512
#: One text in so many is counted to tell frequent shingles; it orders the shingles, and results do not depend on it.
COUNTED = 16
_SLACK = 1e-6


def _majority_bits(hashes: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """SimHash (uint64) of the runs of ``hashes`` that begin at ``first``; all sizes are positive."""
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return np.packbits(2 * np.add.reduceat(bits, first, axis=0, dtype=np.int32) > sizes[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def _distinct(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (hash, doc), sorted by doc and hash."""
    order = np.lexsort((hashes, doc))
    h, d = hashes[order], doc[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return h[new], d[new]


def shingle_sets_of(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's SimHash of distinct words; all texts' distinct shingle hashes, sorted in each text; n + 1 offsets of the texts in them."""
    words = scan(texts, SPACE_WORDS, lower=True)
    hashes, counts = word_hashes(words), words.counts
    prints, offsets = np.zeros(len(counts), dtype=np.uint64), np.zeros(len(counts) + 1, dtype=np.int64)
    has = np.flatnonzero(counts)
    if not len(has):
        return prints, np.zeros(0, dtype=np.uint64), offsets
    h, d = _distinct(hashes, words.doc_of())
    first = np.searchsorted(d, has)
    prints[has] = _majority_bits(h, first, np.diff(np.append(first, len(d))))
    # Shingles: of a text with fewer words, all its words.
    runs = run_hashes(np.append(hashes, np.zeros(shingle - 1, dtype=np.uint64)), shingle)
    n = np.maximum(counts[has] - shingle + 1, 1)
    first = np.cumsum(n) - n
    runs = runs[np.repeat(words.first[has] - first, n) + np.arange(n.sum())]
    for i in np.flatnonzero(counts[has] < shingle).tolist():
        own = hashes[words.first[has[i]] : words.first[has[i] + 1]]
        runs[first[i]] = run_hashes(own, len(own))[0] ^ np.uint64(len(own))
    runs, d = _distinct(runs, np.repeat(has, n))
    return prints, runs, np.searchsorted(d, np.arange(len(counts) + 1))


def similar_documents(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = 5, radius: int = PROPOSAL_RADIUS, tree_limit: int = TREE_LIMIT, carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows (doc_id, ``carry``, component_id, class_id): classes of documents linked by shingle sets of Jaccard ``similarity`` or more.

    A link is decided by the two exact sets of distinct shingles (64-bit hashes). Sets of that similarity share one
    of their n - ceil(similarity * n) + 1 rarest shingles, so the lists of these shingles hold every link. SimHash
    fingerprints of the distinct words within ``radius``, by the BK-trees of shards, and neighbours in the lists propose first;
    then members of lists whose classes still differ propose a few others each, so that a large class needs few
    comparisons; at last every pair of a list that is not of one class is compared, so that no link is missed. Sketches of
    the sets (parities of their shingles by residue) rule most pairs out for certain where the lists are read.
    Wordless texts are similar to each other only. component_id is the smallest doc_id of a class; class_id tells classes apart.
    """
    spark, mark = docs.sparkSession, written()
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in passes(batch, "text", 1 << 20):
                prints, node, sets = _nodes_of(part.column("text"), shingle)
                parities = [_parities(np.frombuffer(x, dtype=np.uint64)) for x in sets]
                arrays = [pa.array(node), pa.array(prints.view(np.int64)), pa.array([len(x) // 8 for x in sets]), pa.array([_folded(x, SKETCH_BITS // 8).tobytes() for x in parities], type=pa.binary()), pa.array(parities, type=pa.binary())]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "carried", "content")), *arrays], names=["doc_id", "carried", "content", "node", "fp", "size", "sketch", "parities"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (F.struct(*carry) if carry else F.lit(0)).alias("carried"), F.xxhash64("text").alias("content"))
    # Equal sets are one node.
    schema = f"doc_id long, carried {source.schema['carried'].dataType.simpleString()}, content long, node long, fp long, size long, sketch binary, parities binary"
    rows = cut(source.mapInArrow(run, schema), "shingle-nodes")
    # Sets are as large as the texts: those that must be compared are taken from the texts again, by the texts' hashes.
    texts = docs.select("text", F.xxhash64("text").alias("content"))
    verified = lambda pairs: _verified(pairs, rows, texts, shingle, similarity)
    lists = _shared_shingles(docs, shingle, similarity)
    members = cut(lists.select("node").distinct(), "listed-nodes")
    listed = lambda pairs: pairs.join(members.withColumnRenamed("node", "u"), "u", "left_semi").join(members.withColumnRenamed("node", "v"), "v", "left_semi")
    prints = _print_pairs(rows.select("node", "fp").distinct(), radius, tree_limit)
    links = verified(listed(prints).select("u", "v").union(_list_pairs(lists, similarity)))
    roots = components(links, "set-links")
    discard(links)
    sketches = rows.select("node", "sketch").dropDuplicates(["node"])
    for all_pairs in (False, True):
        # Lists whose members are not all of one class yet.
        rooted = lists.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        mixed = rooted.groupBy("shingle").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b")
        open_lists = cut(rooted.join(mixed.select("shingle"), "shingle", "left_semi"), "open-lists")
        discard(lists)
        lists = open_lists.drop("root")
        lists._scratch_path = open_lists._scratch_path
        sweep(spark)
        links = verified(_class_pairs(open_lists.join(sketches, "node"), similarity, all_pairs))
        # A class goes on as the star that it is by now, not by its links again: few rounds are left.
        roots = components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).union(links), "set-links")
        discard(links)
    discard(lists, members)
    sweep(spark)
    # Many rows may be one node, and many nodes one class.
    nodes = rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).join(roots, "node", "left").withColumn("class_id", F.coalesce("root", "node"))
    nodes = cut(nodes.select("node", "least", "n", "class_id"), "set-nodes")
    named = cut(nodes.groupBy("class_id").agg(F.min("least").alias("component_id"), F.count("*").alias("times")), "set-classes")
    labels = cut(join_hot(nodes, named, "class_id", "times").select("node", "n", "component_id", "class_id"), "set-labels")
    discard(nodes, named)
    labelled = cut(join_hot(rows.select("doc_id", "carried", "node"), labels, "node", "n").drop("node"), "set-rows")
    discard_since(spark, mark, labelled)
    sweep(spark)
    return labelled.select("doc_id", *(["carried.*"] if carry else []), "component_id", "class_id")


def _nodes_of(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Fingerprints, nodes (hashes of the sets) and shingle sets of texts."""
    prints, runs, offsets = shingle_sets_of(texts, shingle)
    data, ends = runs.tobytes(), (8 * offsets).tolist()
    sets = [data[a:b] for a, b in zip(ends, ends[1:], strict=False)]
    return prints, np.array([xxhash.xxh64_intdigest(s) for s in sets], dtype=np.uint64).view(np.int64), sets


def _parities(shingles: np.ndarray) -> bytes:
    """One bit for each of SKETCH_BITS or more residues, at least four times as many as there are shingles: whether their number is odd."""
    bits = max(SKETCH_BITS.bit_length() - 1, (4 * len(shingles)).bit_length())
    odd = (np.bincount((shingles & np.uint64((1 << bits) - 1)).astype(np.int64), minlength=1 << bits) & 1).astype(np.uint8)
    return np.packbits(odd).tobytes()


def _folded(parities: bytes, size: int) -> np.ndarray:
    """Parities by residues of fewer bits: of 2^k residues the highest bit goes, again and again."""
    out = np.frombuffer(parities, dtype=np.uint8)
    while len(out) > size:
        out = out[: len(out) // 2] ^ out[len(out) // 2 :]
    return out


def _difference(a: bytes, b: bytes) -> int:
    """A bound from below of how many shingles are in one of the two sets only: the residues of which odd numbers differ."""
    size = min(len(a), len(b))
    return int(np.bitwise_count(_folded(a, size) ^ _folded(b, size)).sum())


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """Rows (node, shingles) of the texts, each node once from a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in passes(batch, "text", 1 << 20):
                _, node, sets = _nodes_of(part.column("text"), shingle)
                at = [i for i, n in enumerate(node.tolist()) if not (n in seen or seen.add(n))]
                if at:
                    yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array([sets[i] for i in at], type=pa.binary())], names=["node", "shingles"])

    return texts.select("text").mapInArrow(run, "node long, shingles binary")


def _print_pairs(nodes: DataFrame, radius: int, tree_limit: int) -> DataFrame:
    """Pairs (u, v) of nodes with equal fingerprints or in one star of ``links``."""
    least = nodes.groupBy("fp").agg(F.min("node").alias("least"))
    same = nodes.join(least, "fp").where("node <> least").select(F.col("node").alias("u"), F.col("least").alias("v"))
    ends = links(least.select("fp"), radius, tree_limit)
    for end in ("u", "v"):
        ends = ends.join(least.withColumnsRenamed({"fp": end, "least": f"node_{end}"}), end)
    return same.union(ends.select("node_u", "node_v"))


def _shared_shingles(docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Rows (shingle, node, size, pos) of the rarest shingles of each node that another node has among its own."""
    spark = docs.sparkSession

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(batch.column("shingles").to_pylist()), dtype=np.int64))], names=["shingle"])

    counts = _sets(docs.where(F.pmod(F.xxhash64("text"), F.lit(COUNTED)) == 0), shingle).select("shingles").mapInArrow(releasing(spread), "shingle long").groupBy("shingle").agg(F.count("*").alias("n"))
    counts = cut(counts.where("n > 1"), "shingle-counts")
    # At most about a million frequent shingles go out.
    least = max(4, (counts.agg(F.sum("n")).first()[0] or 0) >> 20)
    found = counts.where(F.col("n") >= least).toArrow()
    keys, times = found.column("shingle").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(keys)
    frequent = spark.sparkContext.broadcast((keys[order], times[order]))
    discard(counts)

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, times = frequent.value
        for batch in batches:
            nodes, texts = batch.column("node").to_pylist(), batch.column("shingles").to_pylist()
            taken = [i for i, t in enumerate(texts) if t]
            if not taken:
                continue
            sizes = np.array([len(texts[i]) // 8 for i in taken])
            shingles = np.frombuffer(b"".join([texts[i] for i in taken]), dtype=np.uint64)
            doc, count = np.repeat(np.arange(len(taken)), sizes), np.zeros(len(shingles), dtype=np.int64)
            if len(known):
                place = np.minimum(np.searchsorted(known, shingles), len(known) - 1)
                count = np.where(known[place] == shingles, times[place], 0)
            order = np.lexsort((shingles, count, doc))
            pos = np.arange(len(shingles)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            lead = sizes - np.ceil(similarity * sizes - _SLACK).astype(np.int64) + 1
            keep = pos < lead[doc]
            own = np.array([nodes[i] for i in taken], dtype=np.int64)
            yield _table(shingle=shingles[order][keep].view(np.int64), node=own[doc[keep]], size=sizes[doc[keep]], pos=pos[keep])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last row waits for the next batch; known: whether the row before it is of its list.
        known = False
        for (shingle, node, size, pos), kept, last in _overlapping(batches, 1):
            new = np.append(True, (node[1:] != node[:-1]) | (shingle[1:] != shingle[:-1]))  # a node comes once from each task that has a copy
            shingle, node, size, pos = (c[new] for c in (shingle, node, size, pos))
            same = np.concatenate([[bool(kept) and known], shingle[1:] == shingle[:-1], [False]])
            keep = same[1:] | same[:-1]
            known = bool(same[:-1][-1])
            if not last:
                keep[-1] = False
            if keep.any():
                yield _table(shingle=shingle[keep], node=node[keep], size=size[keep], pos=pos[keep])

    lists = "shingle long, node long, size long, pos long"
    found = cut(_in_lists(_sets(docs, shingle).mapInArrow(releasing(rarest), lists)).mapInArrow(releasing(shared), lists), "shingle-lists")
    sweep(spark)
    return found


def _in_lists(rows: DataFrame) -> DataFrame:
    return rows.repartition("shingle").sortWithinPartitions("shingle", "size", "node")


def _table(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns.values()], names=list(columns))


def _overlapping(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[list[np.ndarray], int, bool]]:
    """The columns of each batch behind the last ``rows`` of those before; how many these are; whether it is the last batch."""
    held, before = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            yield held, before, False
            columns = [np.concatenate([h[-rows:], c]) for h, c in zip(held, columns, strict=True)]
            before = min(rows, len(held[0]))
        held, before = columns, before or 0
    if held is not None:
        yield held, before, True


def _whole_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of the batches, cut only where the first column changes."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(columns[0]):
            continue
        begin = int(np.searchsorted(columns[0], columns[0][-1]))
        if begin or (held and held[-1][0][-1] != columns[0][0]):
            yield [np.concatenate(c) for c in zip(*held, [c[:begin] for c in columns], strict=True)]
            held = []
        held.append([c[begin:] for c in columns])
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _may(similarity: float, size: np.ndarray, pos: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether sizes and places in a list allow the similarity.

    A pair's first common shingle stands in both their lists, and no shingle before it is common: that bounds what they share.
    """
    least = similarity / (1 + similarity) * (size[i] + size[j])
    return (np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]) - _SLACK) & (np.minimum(size[i] - pos[i], size[j] - pos[j]) >= least - _SLACK)


def _list_pairs(lists: DataFrame, similarity: float) -> DataFrame:
    """Pairs (u, v) of neighbours in a list whose sizes and places allow ``similarity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (shingle, node, size, pos), _, _ in _overlapping(batches, 1):
            i = np.flatnonzero(shingle[1:] == shingle[:-1])
            i = i[_may(similarity, size, pos, i, i + 1)]
            yield _table(u=node[i], v=node[i + 1])

    return _in_lists(lists.select("shingle", "node", "size", "pos")).mapInArrow(releasing(run), "u long, v long")


def _class_pairs(lists: DataFrame, similarity: float, all_pairs: bool) -> DataFrame:
    """Pairs (u, v) of different roots in a list whose sizes, places and sketches allow ``similarity``.

    All of them, or PROPOSALS for each node, drawn by hash from members at most REACH places on. Members of a list's largest
    class are compared with the others only, so a list of one large class costs no more than its other members are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = ((columns, 0) for columns in _whole_lists(batches)) if all_pairs else ((columns, kept) for columns, kept, _ in _overlapping(batches, REACH))
        for (shingle, node, size, pos, root, sketch), kept in parts:
            bits = np.frombuffer(b"".join(sketch.tolist()), dtype=np.uint64).reshape(len(node), -1)

            def good(i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
                keep = (root[i] != root[j]) & _may(similarity, size, pos, i, j)  # noqa: B023
                i, j = i[keep], j[keep]
                apart = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64)  # noqa: B023
                common = (size[i] + size[j] - apart) // 2  # noqa: B023
                keep = common >= similarity * (size[i] + size[j] - common) - _SLACK  # noqa: B023
                return _table(u=node[i[keep]], v=node[j[keep]])  # noqa: B023

            if not all_pairs:
                for step in range(1, REACH + 1):
                    i = np.flatnonzero(shingle[step:] == shingle[:-step])
                    i = i[i + step >= kept]
                    if len(i):
                        yield good(i, i + step)
                continue
            first = np.flatnonzero(np.append(True, shingle[1:] != shingle[:-1]))
            for begin, end in zip(first.tolist(), [*first[1:].tolist(), len(shingle)], strict=True):
                own, times = np.unique(root[begin:end], return_counts=True)
                most = begin + np.flatnonzero(root[begin:end] == own[times.argmax()])
                others = begin + np.flatnonzero(root[begin:end] != own[times.argmax()])
                for at in range(0, len(others), LIST_BLOCK):
                    i = others[at : at + LIST_BLOCK]
                    # Members are in order of size: those that may be similar to one of the block.
                    for rest in (others[at:], most):
                        low, high = np.searchsorted(size[rest], [similarity * size[i[0]] - _SLACK, size[i[-1]] / similarity + _SLACK])
                        for b in range(int(low), int(high), LIST_BLOCK):
                            j = rest[b : min(b + LIST_BLOCK, int(high))]
                            x, y = np.repeat(i, len(j)), np.tile(j, len(i))
                            if rest is not most:
                                x, y = x[x < y], y[x < y]
                            yield good(x, y)

    pairs = _in_lists(lists.select("shingle", "node", "size", "pos", "root", "sketch")).mapInArrow(releasing(run), "u long, v long")
    if all_pairs:
        return pairs
    both = pairs.union(pairs.select("v", "u"))
    drawn = both.groupBy("u").agg(*(F.min(F.struct(F.xxhash64("u", "v", F.lit(i)), "v"))["v"].alias(f"v{i}") for i in range(PROPOSALS)))
    return drawn.select("u", F.explode(F.array(*(f"v{i}" for i in range(PROPOSALS)))).alias("v"))


def _verified(pairs: DataFrame, rows: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The distinct pairs (u, v) whose shingle sets have a Jaccard similarity of at least ``similarity``.

    Parities of the sets, a fraction of their size, rule most others out for certain; the sets decide the rest.
    rows: nodes with size, parities and the hash of their text; texts: text and its hash.
    """

    def wanted(pairs: DataFrame) -> DataFrame:
        return rows.join(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "node", "left_semi")

    def joined(pairs: DataFrame, few: DataFrame) -> DataFrame:
        for end in ("u", "v"):
            pairs = pairs.join(few.withColumnsRenamed({c: end if c == "node" else f"{c}_{end}" for c in few.columns}), end)
        return pairs

    def decide(keep):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                columns = [batch.column(c).to_pylist() for c in batch.schema.names[2:]]
                kept = np.array([keep(*row) for row in zip(*columns, strict=True)], dtype=bool)
                yield _table(u=batch.column("u").to_numpy()[kept], v=batch.column("v").to_numpy()[kept])

        return run

    def possible(m: int, n: int, a: bytes, b: bytes) -> bool:
        common = (m + n - _difference(a, b)) // 2
        return common >= similarity * (m + n - common) - _SLACK

    def similar(a: bytes, b: bytes) -> bool:
        both = np.sort(np.concatenate([np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)]), kind="stable")
        common = int((both[1:] == both[:-1]).sum())
        return common >= similarity * (len(both) - common) - _SLACK

    proposed = cut(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "proposed")
    known = wanted(proposed).select("node", "size", "parities").dropDuplicates(["node"])
    likely = cut(joined(proposed, known).select("u", "v", "size_u", "size_v", "parities_u", "parities_v").mapInArrow(releasing(decide(possible)), "u long, v long"), "likely")
    # One text of each node, and its set.
    # Written, so that its size is known when it is joined to the texts.
    chosen = cut(wanted(likely).groupBy("node").agg(F.min("content").alias("content")).select("content"), "chosen-texts")
    sets = _sets(texts.join(chosen, "content", "left_semi"), shingle).dropDuplicates(["node"])
    kept = cut(joined(likely, sets).select("u", "v", "shingles_u", "shingles_v").mapInArrow(releasing(decide(similar)), "u long, v long"), "similar")
    discard(proposed, likely, chosen)
    sweep(rows.sparkSession)
    return kept


def hex_fingerprint(fp):
    """16 lowercase hex digits of a fingerprint column."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
