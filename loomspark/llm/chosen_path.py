"""N-gram Jaccard join by chosen paths.

Documents with equal shingle sets are one class.  A run sends every class down a path: sets are split on the values
at sampled positions of their sketches (shared tokens), buckets are split again on further positions until they are
small or their members alike, and small buckets are compared by brute force.  Runs with other positions repeat this
until the target recall.  What is found links classes loosely; every loose group is then compared exactly, set by
set, so links, their counts and the final groups rest on true Jaccard similarities of whole texts.
"""

from __future__ import annotations

from math import ceil, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_columns, fresh, grid, slices, written
from .components import components
from .shingles import WIDTH, forget_words, pair_counts, shingles, sketch

#: A bucket compared by brute force; paths below a split; members of a bucket that one task takes; shingles of a
#: group that one task takes (larger groups are compared in a grid of blocks); sets compared at once in a task.
LEAF, BRANCHES, TASK_BUCKET, TASK_SHINGLES, TILE = 128, 3, 16_384, 2_000_000, 1024
DEEPEST = 4


def runs(similarity: float, recall: float, levels: int = 2 * DEEPEST) -> int:
    """Runs until a pair of the given similarity meets with the given probability.

    A pair survives the first split with its similarity, and each of ``levels`` further splits (those of large buckets
    and those within a task, all of them in the worst case) where one of its branches keeps it together.
    """
    one = similarity * (1 - (1 - similarity) ** BRANCHES) ** levels
    return max(1, ceil(log(1 - recall) / log(1 - one)))


def _mix(key: np.ndarray | int, salt: int) -> np.ndarray:
    x = (np.atleast_1d(np.asarray(key, np.uint64)) ^ np.uint64(salt * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def positions(path: int, branches: int) -> list[int]:
    """The sampled positions below a path: different ones, the same for all sets on it."""
    return np.random.default_rng(path % (1 << 63)).choice(WIDTH, branches, replace=False).tolist()


def child(path: int, position: int, value: np.ndarray) -> np.ndarray:
    return _mix(_mix(path, position + 1) ^ value.astype(np.uint64), 7)


def _near(rows: np.ndarray, other: np.ndarray, least: int) -> np.ndarray:
    """Which pairs agree at ``least`` positions or more."""
    out = np.empty((len(rows), len(other)), bool)
    step = max(1, 16_000_000 // max(1, len(other) * WIDTH))
    for i in range(0, len(rows), step):
        out[i : i + step] = (rows[i : i + step, None, :] == other[None]).sum(2, dtype=np.int16) >= least
    return out


def link(sketches: np.ndarray, at: np.ndarray, least: int, root: np.ndarray) -> None:
    """Join the groups of all near pairs among rows ``at``: what joins a group is compared with what has not yet."""
    left = at
    while len(left) > 1:
        new, left = left[:1], left[1:]
        own = [new]
        while len(new) and len(left):
            hit = np.zeros(len(left), bool)
            for i in range(0, len(new), 256):
                hit |= _near(sketches[new[i : i + 256]], sketches[left], least).any(0)
            new, left = left[hit], left[~hit]
            own.append(new)
        group = np.concatenate(own)
        if len(group) > 1:
            _join(root, group)


def _find(root: np.ndarray, i: int) -> int:
    while root[i] != i:
        root[i] = root[root[i]]
        i = root[i]
    return i


def _join(root: np.ndarray, group: np.ndarray) -> None:
    tops = {_find(root, int(i)) for i in group}
    low = min(tops)
    for t in tops:
        root[t] = low


def descend(sketches: np.ndarray, at: np.ndarray, path: int, least: int, root: np.ndarray, depth: int = 0) -> None:
    """Split rows ``at`` of a bucket until small, alike or deep, and link what is near."""
    if len(at) <= LEAF or depth >= DEEPEST:
        link(sketches, at, least, root)
        return
    # members alike would meet again in every bucket below: compare them here
    middle = sketches[at[:: max(1, len(at) // 32)]]
    if _near(middle, middle, least).mean() > 0.5:
        link(sketches, at, least, root)
        return
    for p in positions(path, BRANCHES):
        values = sketches[at, p]
        order = np.argsort(values, kind="stable")
        cuts = np.flatnonzero(np.diff(values[order].astype(np.int64))) + 1
        for group in np.split(at[order], cuts):
            if len(group) > 1:
                descend(sketches, group, int(child(path, p, sketches[group[:1], p])[0]), least, root, depth + 1)


def _linked_tiles(sets: list[np.ndarray], pairs: list[tuple[np.ndarray, np.ndarray]], similarity: float):
    """(rows, columns, linked) of each tile of the row sets and column sets in ``pairs``; a set is never its own link.

    Where rows and columns are the same, a tile below the diagonal is left out.
    """
    sizes = np.array([len(s) for s in sets], float)
    for rows, columns in pairs:
        same = rows is columns
        for a in range(0, len(rows), TILE):
            for b in range(a if same else 0, len(columns), TILE):
                r, c = rows[a : a + TILE], columns[b : b + TILE]
                both = pair_counts([sets[i] for i in r], [sets[i] for i in c])
                yield r, c, (both >= similarity * (sizes[r, None] + sizes[None, c] - both) - 1e-9) & (r[:, None] != c[None])


def compare_sets(sets: list[np.ndarray], copies: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """For each set the copies of all sets linked to it and the first set that links lead to, tile by tile."""
    counts, top = np.zeros(len(sets), np.int64), np.arange(len(sets))
    for rows, columns, linked in _linked_tiles(sets, pairs, similarity):
        counts[rows] += linked @ copies[columns]
        if rows[0] != columns[0]:
            counts[columns] += copies[rows] @ linked
        for i in np.flatnonzero(linked.any(1)):
            tops = np.unique(top[np.append(columns[linked[i]], rows[i])])
            if len(tops) > 1:
                top[np.isin(top, tops)] = tops[0]
    return counts, top


def _stars(names: list, root: np.ndarray) -> tuple[list, list]:
    """Edges from each member to its group's first."""
    a, b = [], []
    for i in range(len(names)):
        r = _find(root, i)
        if r != i:
            a.append(names[i])
            b.append(names[r])
    return a, b


def sketched(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, key (for finding the text again), print (a hash of the text), cls (of equal sets; null without words),
    size, sketch.

    Null texts are empty; null ids stay null, their key is a hash of the text; equal texts, repeated rows among them,
    have equal print, cls and sketch; an empty table gives no row; other columns are dropped.
    """

    def run(batches):
        for b in batches:
            cls, sizes, sketches = [], [], []
            for text in b.column(3):
                own = shingles(text.as_py(), n)
                sizes.append(len(own))
                cls.append(xxhash.xxh3_128_hexdigest(own.tobytes()) if len(own) else None)
                sketches.append(sketch(own).tobytes() if len(own) else None)
            yield pa.record_batch([*b.columns[:3], pa.array(cls, pa.string()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary())], names=["doc_id", "key", "print", "cls", "size", "sketch"])

    own = doc_columns(docs)
    own = own.select("doc_id", F.coalesce("doc_id", F.xxhash64("text")).alias("key"), F.xxhash64("text").alias("print"), "text")
    return own.mapInArrow(run, "doc_id long, key long, print long, cls string, size long, sketch binary")


def _loose(classes: DataFrame, similarity: float, least: int, times: int, task_bucket: int, cell: int = 1024) -> DataFrame:
    """Edges (a, b) between classes that are near by their sketches."""

    def first(batches):
        roots = [(path, positions(path, 1)[0]) for path in (int(_mix(r, 99)[0]) for r in range(times))]
        for b in batches:
            own = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(b.num_rows, WIDTH)
            keys = np.stack([child(path, p, own[:, p]) for path, p in roots], 1).astype(np.int64)
            yield pa.record_batch([b.column(0), pa.array(list(keys), pa.list_(pa.int64()))], names=["cls", "keys"])

    def split(batches):
        for b in batches:
            own = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint16).reshape(b.num_rows, WIDTH)
            out = []
            for path, row in zip(b.column(1).to_pylist(), own):
                out.append([int(child(path % (1 << 64), p, row[p : p + 1]).astype(np.int64)[0]) for p in positions(path, BRANCHES)])
            yield pa.record_batch([b.column(0), pa.array(out, pa.list_(pa.int64()))], names=["cls", "keys"])

    def bucket(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        names = table["cls"].to_pylist()
        own = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint16).reshape(len(names), WIDTH)
        root = np.arange(len(names))
        descend(own, np.arange(len(names)), key[0].as_py() % (1 << 64), least, root)
        a, b = _stars(names, root)
        return pa.table({"a": pa.array(a, pa.string()), "b": pa.array(b, pa.string())})

    spark = classes.sparkSession
    keyed = classes.select("cls", "sketch").mapInArrow(first, "cls string, keys array<long>").select("cls", F.explode("keys").alias("path"))
    edges = None
    for depth in range(DEEPEST + 1):
        keyed = written(keyed, spark, "paths")
        sizes = keyed.groupBy("path").agg(F.count("*").alias("members")).where("members > 1")
        met = keyed.join(sizes, "path").join(classes.select("cls", "sketch"), "cls")
        met = written(met, spark, "buckets")
        # at the greatest depth all that is left is compared; a bucket above a task's share is compared cell by cell
        fits = F.lit(True) if depth == DEEPEST else F.col("members") <= task_bucket
        found = grid(met.where(fits), "cls", least=cell).groupBy("path", "i", "j").applyInArrow(bucket, "a string, b string")
        edges = found if edges is None else edges.union(found)
        large = met.where(~fits)
        if depth == DEEPEST or large.isEmpty():
            return written(edges, spark, "loose")
        keyed = large.select("cls", "path", "sketch").mapInArrow(split, "cls string, keys array<long>").select("cls", F.explode("keys").alias("path"))
    raise AssertionError("unreachable")


def links(docs: DataFrame, n: int = 5, similarity: float = 0.8, recall: float = 0.998, task_bucket: int = TASK_BUCKET, task_shingles: int = TASK_SHINGLES) -> DataFrame:
    """One row per document: doc_id, class_id and n_links.

    Documents of Jaccard similarity ``similarity`` or more over sets of ``n`` lower-case words are linked; class_id is
    the smallest doc_id that links lead to, n_links the number of other documents linked directly (copies included).
    Texts without a word (null, empty, blank) have no link and are their own class; repeated rows count as copies;
    a null ``doc_id`` stays null and is never a class_id unless all of its class have none; an empty table gives no
    row; other columns are ignored.
    """
    return _linked(docs, n, similarity, recall, task_bucket, task_shingles).drop("print", "lead")


def _linked(docs: DataFrame, n: int, similarity: float, recall: float = 0.998, task_bucket: int = TASK_BUCKET, task_shingles: int = TASK_SHINGLES) -> DataFrame:
    """The rows of ``links`` with a hash of each text, and whether it is the one of its group that stays: the smallest
    doc_id (null last), then the smallest hash; of texts without a word each."""
    spark = docs.sparkSession
    rows = written(sketched(docs, n), spark, "sketches")
    classes = rows.where("cls is not null").groupBy("cls").agg(F.min("key").alias("key"), F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.min("size").alias("size"), F.min("sketch").alias("sketch"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "print")).alias("lead"))
    classes = written(classes, spark, "classes")
    # a sketch estimates similarity with a deviation of about sqrt(s (1 - s) / WIDTH); 3.5 of them below is near
    least = int(WIDTH * (similarity - 3.5 * (similarity * (1 - similarity) / WIDTH) ** 0.5))
    loose = _loose(classes, similarity, least, runs(similarity, recall), task_bucket)
    groups = components(loose)
    members = groups.join(classes.select("cls", "key", "copies", "size"), groups.node == classes.cls).drop("node")
    sums = members.groupBy("label").agg(F.sum("size").alias("total"))
    blocks = F.ceil(F.col("total") / F.lit(task_shingles)).cast("long")
    members = members.join(sums, "label").select("cls", "key", "copies", "label", blocks.alias("blocks"))
    # the texts of one document of each class in a group; a key may be shared, so the class is computed again
    near = doc_columns(docs).select(F.coalesce("doc_id", F.xxhash64("text")).alias("key"), "text").join(members, "key")

    def again(batches):
        for b in batches:
            for start, end in slices(b.column(0)):
                part = b.slice(start, end - start)
                cls, keep, sets = part.column(1).to_pylist(), [], []
                for i, text in enumerate(part.column(0)):
                    own = shingles(text.as_py(), n)
                    if len(own) and xxhash.xxh3_128_hexdigest(own.tobytes()) == cls[i]:
                        keep.append(i)
                        sets.append(own.tobytes())
                kept = part.take(pa.array(keep, pa.int64()))
                yield pa.record_batch([*kept.columns[1:], pa.array(sets, pa.binary())], names=["cls", "copies", "label", "blocks", "own"])

    sets = near.select("text", "cls", "copies", "label", "blocks").mapInArrow(again, "cls string, copies long, label string, blocks long, own binary")
    sets = sets.withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")))
    # cell (i, j), i <= j, of a group's grid; a group that fits one task has the one cell (0, 0)
    cells = sets.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cells = cells.withColumn("i", F.least("block", "with")).withColumn("j", F.greatest("block", "with"))
    schema = pa.schema([("cls", pa.string()), ("links", pa.int64()), ("top", pa.string()), ("blocks", pa.int64())])

    def compare(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        firsts: dict[str, int] = {}
        for at, c in enumerate(table["cls"].to_pylist()):
            firsts.setdefault(c, at)
        table = table.take(pa.array(list(firsts.values()), pa.int64()))
        forget_words()
        names, copies, block = table["cls"].to_pylist(), table["copies"].to_numpy(), table["block"].to_numpy()
        own = [np.frombuffer(x, np.uint64) for x in table["own"].to_pylist()]
        i, j = key[1].as_py(), key[2].as_py()
        rows = np.flatnonzero(block == i)
        # between two blocks: pairs inside one belong to its own cell
        counts, top = compare_sets(own, copies, [(rows, rows if i == j else np.flatnonzero(block == j))], similarity)
        tops = [names[t] for t in top.tolist()]
        return pa.table([pa.array(names), pa.array(counts, pa.int64()), pa.array(tops), table["blocks"]], schema=schema)

    compared = cells.groupBy("label", "i", "j").applyInArrow(compare, "cls string, links long, top string, blocks long")
    compared = written(compared, spark, "compared")
    found = compared.groupBy("cls").agg(F.sum("links").alias("links"), F.min("top").alias("top"), F.max("blocks").alias("blocks"))
    grid = compared.where("blocks > 1 and cls <> top").select(F.col("cls").alias("a"), F.col("top").alias("b"))
    if not grid.isEmpty():
        labels = components(grid)
        found = found.join(labels, found.cls == labels.node, "left").withColumn("top", F.when(F.col("blocks") > 1, F.coalesce("label", "cls")).otherwise(F.col("top"))).drop("node", "label")
    joined = classes.select("cls", "first", "copies", "lead").join(found.select("cls", "links", "top"), "cls", "left").withColumn("top", F.coalesce("top", "cls"))
    firsts = joined.groupBy("top").agg(F.min("first").alias("class_id"), F.min("lead").alias("group_lead"))
    answer = joined.join(firsts, "top").select("cls", "class_id", F.when(F.col("lead") == F.col("group_lead"), F.col("lead")).alias("lead"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = rows.select("doc_id", "print", "cls").join(answer, "cls", "left")
    leads = F.col("cls").isNull() | F.coalesce(F.col("doc_id").eqNullSafe(F.col("lead.doc_id")) & (F.col("print") == F.col("lead.print")), F.lit(False))
    return out.select("doc_id", "print", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), leads.alias("lead"))


def keep_firsts(docs: DataFrame, n: int = 5, similarity: float = 0.8) -> DataFrame:
    """Rows of ``docs``, all columns as they are, with one document of each group of links: the smallest doc_id.

    Of equal doc_ids in a group the text of the smallest hash stays, of repeated rows (equal doc_id and text) one.
    Documents without doc_id stay where no other of their group has one, one for each group.  Texts without a word
    (null, empty, blank) are no copies of each other: all stay, repeated rows once.  An empty table stays empty.
    """
    id_, print_, first = fresh(docs, "_id"), fresh(docs, "_print"), fresh(docs, "_first")
    firsts = _linked(docs, n, similarity).where("lead").select(F.col("doc_id").alias(first), F.col("print").alias(print_)).distinct()
    hashed, own_id = fresh(docs, "_text_hash"), F.col("doc_id").cast("long")
    own = docs.withColumns({hashed: F.xxhash64(F.coalesce(F.col("text"), F.lit(""))), id_: own_id})
    kept = own.join(firsts, F.col(id_).eqNullSafe(F.col(first)) & (F.col(hashed) == F.col(print_)), "left_semi")
    return kept.dropDuplicates([id_, hashed]).select(*docs.columns)
