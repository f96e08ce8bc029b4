"""Join of documents whose sets of five-word shingles have a Jaccard similarity of at least a threshold.

1. Texts with equal shingle sets are one class; from here on a class counts once.
2. MinHash LSH forest: TREES tries of signatures of DEPTH values. A trie is kept as rows sorted by prefix; its node of a
   depth is a run of rows with equal prefixes. All classes begin at full depth and are held against those that share a
   node with them, by their signatures. Then prefixes are shortened, class by class: a class whose estimated recall has
   reached the target is closed, and only nodes with open classes are looked at again at the next depth. At the last
   depth a pair at the threshold is found with the target recall, however few its neighbours are.
3. The pairs that agree well enough give a spanning forest of each node, never the pairs themselves; of these edges, not of
   the nodes, components are made, so that unlike texts in one node don't draw components together.
4. Exact verification within each component, in blocks: a pair of blocks of bounded size is one unit of work with the
   shingle sets of its classes. It counts the links of each class and gives a spanning forest of the links, so that
   what comes out grows with the classes and not with the pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.llm.common import id_and_text, map_arrow, slices
from loomstone.llm.shingles import WordHasher, mix, shingle_set, words_of
from loomstone.operators.components import connected_components
from loomstone.plans.session import partitions_for, written
from loomstone.plans.skew import hot_join

THRESHOLD, RECALL = 0.8, 0.999
TREES, DEPTH = 16, 8
#: Pairs whose signatures agree in less than the threshold minus this are not verified. For a pair at the threshold this is
#: over five standard deviations of the agreement: one in 10^8 such pairs is lost. With a margin of 1 all are verified.
MARGIN = 0.2
#: Bounds of a block: classes, and shingles on average.
BLOCK_CLASSES, BLOCK_SHINGLES = 128, 1 << 20
#: Classes of a node in one block of the comparison of signatures.
NODE_CLASSES = 512
#: Rows of that comparison that are worth a task and a file of their own: on a local folder, each file that is made starts processes.
TASK_ROWS = 4096
COLUMNS = 1 << 13

MULTIPLIERS = mix(np.arange(1, TREES * DEPTH + 1, dtype=np.uint64)) | np.uint64(1)
OFFSETS = mix(np.arange(10_001, 10_001 + TREES * DEPTH, dtype=np.uint64))


def depth_for(threshold: float, recall: float, trees: int = TREES, depth: int = DEPTH) -> int:
    """Shorten the prefix from its full depth until a pair at the threshold is found with the wanted probability."""
    for k in range(depth, 1, -1):
        if 1 - (1 - threshold**k) ** trees >= recall:
            return k
    return 1


def depths(threshold: float, recall: float) -> list[int]:
    """Depths at which nodes are looked at: the full one, then two values shorter each time, last the one of depth_for."""
    last = depth_for(threshold, recall)
    return [*range(DEPTH, last, -2), last]


def found_at(similarity: np.ndarray | float, depth: int) -> np.ndarray | float:
    """Chance that a pair shares a prefix of this depth in some tree."""
    return 1 - (1 - similarity**depth) ** TREES


def signature(shingles: np.ndarray) -> np.ndarray:
    """TREES * DEPTH minima, the upper 16 bits of each; of many shingles, block by block."""
    out = np.full(len(MULTIPLIERS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 512):
        block = (shingles[None, at : at + 512] ^ OFFSETS[:, None]) * MULTIPLIERS[:, None]
        np.minimum(out, block.min(axis=1), out=out)
    return (mix(out) >> np.uint64(48)).astype(np.uint16)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, text -> doc_id, fp binary(16) (of the shingle set; null: no words), n (shingles), sig binary."""

    def make():
        hasher = WordHasher()

        def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
            fps, sizes, sigs = [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(hasher(words_of(text)))
                sizes.append(len(s))
                fps.append(fingerprint(s))
                sigs.append(signature(s).tobytes() if len(s) else None)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary())], ["doc_id", "fp", "n", "sig"])

        return fn

    return map_arrow(docs, make, "doc_id long, fp binary, n long, sig binary", rows=256)


def fingerprint(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def shingle_sets(docs: DataFrame) -> DataFrame:
    """doc_id, text -> fp, set (binary of sorted uint64)."""

    def make():
        hasher = WordHasher()

        def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingle_set(hasher(words_of(t))) for t in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([pa.array([fingerprint(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["fp", "set"])

        return fn

    return map_arrow(docs, make, "fp binary, set binary", rows=256)


def forest_of(classes: DataFrame, at: list[int]) -> DataFrame:
    """cid, sig -> cid and, for each depth, d<depth>: the hash of the tree's number and of the prefix. One row for each tree; the
    nodes of a depth lie within those of the depths below it."""

    def make():
        def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
            cids = np.asarray(batch.column(0))
            sigs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(len(cids), TREES, DEPTH)
            keys = np.broadcast_to(np.arange(TREES, dtype=np.uint64), (len(cids), TREES))
            found = {}
            for k in range(max(at)):
                keys = mix(keys * np.uint64(31) + sigs[:, :, k].astype(np.uint64) + np.uint64(1))
                found[k + 1] = pa.array(keys.reshape(-1).view(np.int64))
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(cids, TREES)), *(found[d] for d in at)], ["cid", *(f"d{d}" for d in at)])

        return fn

    return map_arrow(classes.select("cid", "sig"), make, "cid long, " + ", ".join(f"d{d} long" for d in at), rows=2048)


def agreements(rows: list[tuple], within: bool, threshold: float, margin: float, depth: int) -> list[tuple[int, int, int, float]]:
    """Rows of one pair of blocks of a node: cid, side (0 or 1), open, sig. Pairs of which one side is open are compared.

    Gives cid, root (a class it agrees with, through pairs of these rows), near (classes that agree as far as the threshold),
    missed (how many such classes are expected to be missed for these, as they share no prefix of this depth).
    """
    sides = [[r for r in rows if r[1] == s] for s in (0, 1)]
    a, b = sides[0], sides[0] if within else sides[1]
    if not b or len(a) < 1 + within:
        return []
    sig = [np.frombuffer(b"".join(r[3] for r in x), np.uint16).reshape(len(x), -1) for x in (a, b)]
    is_open = [np.array([r[2] for r in x]) for x in (a, b)]
    size = sig[0].shape[1]
    chance = found_at(np.maximum(np.arange(size + 1) / size, threshold), depth)
    near, missed = [np.zeros(len(x), np.int64) for x in (a, b)], [np.zeros(len(x)) for x in (a, b)]
    parent = list(range(len(a) if within else len(a) + len(b)))
    shift, used = 0 if within else len(a), set()
    for i in range(len(a)):
        first = i + 1 if within else 0
        same = (sig[1][first:] == sig[0][i]).sum(axis=1)
        same[~(is_open[1][first:] | is_open[0][i])] = -1
        for j in (np.flatnonzero(same >= max(0, (threshold - margin) * size)) + first).tolist():
            x, y = find(parent, i), find(parent, j + shift)
            used |= {i, j + shift}
            if x != y:
                parent[max(x, y)] = min(x, y)
        hits = np.flatnonzero(same >= threshold * size)
        rest = 1 / chance[same[hits]] - 1
        near[0][i] += len(hits)
        missed[0][i] += rest.sum()
        np.add.at(near[1], hits + first, 1)
        np.add.at(missed[1], hits + first, rest)
    if within:
        return [(a[i][0], a[find(parent, i)][0], int(near[0][i] + near[1][i]), float(missed[0][i] + missed[1][i])) for i in sorted(used)]
    both = [*a, *b]
    n, m = np.concatenate(near), np.concatenate(missed)
    return [(both[i][0], both[find(parent, i)][0], int(n[i]), float(m[i])) for i in sorted(used)]


def in_groups(rows: DataFrame, keys: int, work: Callable[[list[tuple], tuple], list[tuple]], schema: str) -> DataFrame:
    """Rows that are sorted by their first columns, the keys of a unit of work -> what ``work`` makes of each unit; one unit
    at a time is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = zip(*(x.split() for x in schema.split(", ")), strict=True)
        types = [{"long": pa.int64(), "double": pa.float64()}[t] for t in types]

        def made(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

        key, held, out = None, [], []
        for batch in batches:
            for part in slices(batch, 1024):
                for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if row[:keys] != key:
                        out += work(held, key) if held else []
                        key, held = row[:keys], []
                        if len(out) > 5000:
                            yield made(out)
                            out = []
                    held.append(row[keys:])
        out += work(held, key) if held else []
        if out:
            yield made(out)

    return rows.mapInArrow(run, schema)


def candidates(classes: DataFrame, threshold: float, recall: float, margin: float, parts: int) -> DataFrame:
    """cid, root: edges that join all classes whose signatures agree, as far as the forest finds them."""
    at = depths(threshold, recall)
    last = f"d{at[-1]}"
    forest = written(forest_of(classes, at), "near-forest")
    shared = written(forest.groupBy(last).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "near-shared")
    # Rows of nodes with one class only, nearly all, go for good: nodes get larger only up to the last depth.
    forest = written(hot_join(forest, shared, [last], "n", classes.count() * TREES).drop("n").withColumn("open", F.lit(True)), "near-forest")
    sigs = written(classes.select("cid", "sig").join(forest.select("cid").distinct().hint("merge"), "cid", "left_semi"), "near-signatures-shared")
    edges, first = None, F.lit(0).cast("long")
    for depth in at:
        total = forest.count()
        of_node = forest.groupBy(F.col(f"d{depth}").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.count_if("open").alias("n_open"), F.min("cid").alias("least"), F.bit_xor(F.xxhash64("cid")).alias("members"))
        of_node = of_node.where("n > 1 and n_open > 0")
        # Of nodes with the same classes, as copies have in most trees, one is looked at.
        of_node = of_node.groupBy("members", "least", "n").agg(F.min("node").alias("node")).select("node", "n")
        of_node = written(of_node, "near-nodes")
        in_node = hot_join(forest.select(F.col(f"d{depth}").alias("node"), "cid", "open"), of_node, ["node"], "n", total)
        blocks = F.ceil(F.col("n") / NODE_CLASSES)
        n_work = of_node.agg(F.sum(F.col("n") * blocks)).first()[0] or 0
        in_node = in_node.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("cid"), "blocks")).join(sigs.hint("merge"), "cid")
        work_rows = in_node.select("node", F.explode(pairs_of_blocks()).alias("p"), "cid", "open", "sig").select("node", "p.i", "p.j", "cid", "p.side", "open", "sig")
        work_rows = work_rows.repartition(max(1, min(parts, -(-n_work // TASK_ROWS))), "node", "i", "j").sortWithinPartitions("node", "i", "j")

        def work(rows: list[tuple], key: tuple, depth: int = depth) -> list[tuple]:
            return [(key[0], *x) for x in agreements(rows, key[1] == key[2], threshold, margin, depth)]

        found = written(in_groups(work_rows, 3, work, "node long, cid long, root long, near long, missed double"), "near-edges")
        edges = found.select("cid", "root") if edges is None else edges.unionByName(found.select("cid", "root"))
        if depth == at[-1]:
            return edges
        near = found.groupBy("node", "cid").agg(F.sum("near").alias("near"), F.sum("missed").alias("missed")).groupBy("cid").agg(F.max(F.struct("near", "missed")).alias("best"))
        # One more neighbour, at the threshold, may not have been found.
        reached = 1 - (F.col("best.missed") + (1 - found_at(threshold, depth))) / (F.col("best.near") + 1)
        closed = near.where(reached >= recall).select("cid", F.lit(True).alias("closed"))
        forest = forest.join(closed.hint("merge"), "cid", "left").withColumn("open", F.col("open") & F.col("closed").isNull()).drop("closed")
        forest = written(forest, "near-forest")
    return edges


def pairs_of_blocks() -> Column:
    """Of a row with ``block`` and ``blocks``: i, j, side of each pair of blocks that it takes part in."""
    return F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j"), (F.col("block") > o).cast("int").alias("side")))


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets on the left with all on the right, by products of 0/1 blocks."""
    if len(left) * len(right) <= 4:
        return np.array([[len(np.intersect1d(a, b, assume_unique=True)) for b in right] for a in left], np.int64)
    where = [(np.repeat(np.arange(len(x)), [len(s) for s in x]), np.concatenate(x)) for x in (left, right)]
    shared = np.intersect1d(where[0][1], where[1][1])
    sides = []
    for row, value in where:
        col = np.searchsorted(shared, value)
        hit = (col < len(shared)) & (shared[np.minimum(col, max(0, len(shared) - 1))] == value) if len(shared) else np.zeros(len(value), bool)
        sides.append((row[hit], col[hit]))
    out = np.zeros((len(left), len(right)), np.float64)
    for at in range(0, len(shared), COLUMNS):
        dense = []
        for (row, col), n in zip(sides, (len(left), len(right)), strict=True):
            m = np.zeros((n, min(COLUMNS, len(shared) - at)), np.float32)
            inside = (col >= at) & (col < at + COLUMNS)
            m[row[inside], col[inside] - at] = 1
            dense.append(m)
        out += dense[0] @ dense[1].T
    return np.rint(out).astype(np.int64)


def find(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def links_in(rows: list[tuple], threshold: float, within: bool, margin: float = MARGIN) -> list[tuple[int, int, int]]:
    """Rows of one pair of blocks: cid, side (0 or 1), weight, n, sig, set. Within one block all are on side 0; of two blocks
    one may be empty, and there are no pairs.

    Gives cid, root (a class it is linked with, through links of these rows), links (documents it is linked to here).
    """
    sides = [[r for r in rows if r[1] == s] for s in (0, 1)]
    a, b = sides[0], sides[0] if within else sides[1]
    if not b or len(a) < 1 + within:
        return []
    sig = [np.frombuffer(b"".join(r[4] for r in x), np.uint16).reshape(len(x), -1) for x in (a, b)]
    least = (threshold - margin) * sig[0].shape[1]
    close = np.stack([(sig[1] == s).sum(axis=1) >= least for s in sig[0]])
    if within:
        close = np.triu(close, 1)
    use_a, use_b = np.flatnonzero(close.any(axis=1)), np.flatnonzero(close.any(axis=0))
    if not len(use_a):
        return []
    shared = intersections([np.frombuffer(a[i][5], np.uint64) for i in use_a], [np.frombuffer(b[j][5], np.uint64) for j in use_b])
    na, nb = np.array([a[i][3] for i in use_a]), np.array([b[j][3] for j in use_b])
    linked = close[np.ix_(use_a, use_b)] & (shared >= threshold * (na[:, None] + nb[None, :] - shared) - 1e-9)
    wa, wb = np.array([a[i][2] for i in use_a]), np.array([b[j][2] for j in use_b])
    counts: dict[int, int] = {}
    nodes = [a[i][0] for i in use_a] + [b[j][0] for j in use_b]
    for cids, weights in ((use_a, linked @ wb), (use_b, linked.T @ wa)):
        part = a if cids is use_a else b
        for i, w in zip(cids, weights, strict=True):
            counts[part[i][0]] = counts.get(part[i][0], 0) + int(w)
    place = {c: k for k, c in enumerate(dict.fromkeys(nodes))}
    parent, names = list(range(len(place))), list(place)
    for i in range(len(use_a)):
        for j in np.flatnonzero(linked[i]):
            x, y = find(parent, place[a[use_a[i]][0]]), find(parent, place[b[use_b[j]][0]])
            if x != y:
                parent[max(x, y)] = min(x, y)
    return [(c, names[find(parent, place[c])], n) for c, n in counts.items() if n]


def verified(members: DataFrame, threshold: float, margin: float = MARGIN) -> DataFrame:
    """Rows component, i, j, cid, side, weight, n, sig, set -> cid, root, links."""
    return in_groups(members, 3, lambda rows, key: links_in(rows, threshold, key[1] == key[2], margin), "cid long, root long, links long")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """One row per input row: doc_id, class_id, n_links, class_size.

    Two documents are linked if their shingle sets have a Jaccard similarity of at least ``threshold``; class_id is the
    least doc_id that can be reached over links, n_links the number of other documents (rows) linked to this
    one, class_size the rows of its class. Equal sets are linked. A text without words (null, empty) is linked to
    none. Null ids take part; a class of null ids only has a null class_id. Rows that repeat an id each count as a
    document. An empty table gives an empty table; other columns are left out.
    """
    rows = id_and_text(docs, id_col, text_col)
    parts = partitions_for(docs, 8 << 20)
    signed = written(signatures(rows), "near-signatures")
    classes = signed.where("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("weight"), F.max("n").alias("n"), F.max("sig").alias("sig"))
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()), "near-classes")  # ids hold from here on

    found = connected_components(candidates(classes, threshold, recall, margin, parts), "cid", "root")
    members = written(classes.join(found.withColumnRenamed("node", "cid").hint("merge"), "cid").select("cid", "rep", "fp", "component", "weight", "n", "sig"), "near-members")
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("total"))
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK_CLASSES), F.ceil(F.col("total") / BLOCK_SHINGLES))
    sizes = written(sizes.select("component", "size", blocks.alias("blocks")), "near-sizes")
    placed = hot_join(members, sizes, ["component"], "size", members.count()).withColumn("block", F.pmod(F.xxhash64("cid"), "blocks"))
    placed = written(placed.select("cid", "rep", "fp", "component", "blocks", "block", "weight", "n", "sig"), "near-members")
    # The texts again, of one document of each candidate class: by a merge join at every size, as the ids grow with the input.
    texts = rows.join(placed.select("rep").distinct().hint("merge"), F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi")
    sets = shingle_sets(texts).groupBy("fp").agg(F.first("set").alias("set"))  # one of each, also where ids repeat
    work = placed.join(sets, "fp").select("component", F.explode(pairs_of_blocks()).alias("p"), "cid", "weight", "n", "sig", "set")
    work = work.select("component", "p.i", "p.j", "cid", "p.side", "weight", "n", "sig", "set")
    work = work.repartition(parts, "component", "i", "j").sortWithinPartitions("component", "i", "j")
    found = written(verified(work, threshold, margin), "near-links")

    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    joined = connected_components(found, "cid", "root")
    labels = classes.select("fp", "cid", "rep", "weight").join(joined.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    labels = written(labels, "near-labels")
    of_component = labels.groupBy("component").agg(F.min("rep").alias("class_id"), F.sum("weight").alias("class_size"), F.count(F.lit(1)).alias("classes"))
    labels = hot_join(labels, written(of_component, "near-components"), ["component"], "classes", labels.count()).join(links.hint("merge"), "cid", "left")
    labels = written(labels.select("fp", "weight", "class_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "class_size"), "near-labels")
    linked = hot_join(signed.select("doc_id", "fp").where("fp is not null"), labels, ["fp"], "weight", signed.count()).select("doc_id", "class_id", "n_links", "class_size")
    alone = signed.where("fp is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("class_size"))
    return linked.unionByName(alone)


def without_near_copies(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, all columns as they are, whose doc_id is the least of their class; rows with a null id stay.

    Rows that repeat the kept id stay as well: an id stands for one document.
    """
    found = written(near_duplicates(docs, threshold, id_col=id_col, text_col=text_col), "near-classes-of-documents")
    gone = found.where("doc_id <> class_id").select(F.col("doc_id").alias("__gone")).distinct().hint("merge")
    return docs.join(gone, docs[id_col].cast("long") == gone["__gone"], "left_anti")
