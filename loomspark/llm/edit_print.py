"""Document fingerprints by randomised edit embedding.

A shared random walk reads a text: at step t the current character is written, and a coin that all texts share for
(t, character) decides whether to move on.  Texts a few edits apart fall back into step, so their embeddings differ
in few places: edit distance becomes Hamming distance.  A fingerprint samples the same steps of every embedding; a
band joins several samples, texts that share a band are candidates, and candidates are verified by all samples.

The walk over a whole text is one table lookup a character: entry (character, step) is the step at which the walk
leaves that character.  Steps are sampled by shared random orders, the first in order below a walk's length, so texts
of somewhat different length sample mostly the same steps.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chosen_path import _join, _stars
from .common import doc_columns, grid, written
from .components import components

#: Samples of a fingerprint (one byte each), samples of a band, period of the shared coins, characters of a sample.
SAMPLES, BAND, PERIOD, GRAM = 128, 4, 4096, 4
#: Share of equal samples from which a candidate pair is verified as near.
VERIFIED = 0.5
_RNG = np.random.default_rng(20160618)
_COINS = _RNG.integers(0, 2, (256, PERIOD)).astype(bool)
_FACTORS = _RNG.integers(1, 1 << 62, GRAM, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _leaving() -> list[list[int]]:
    """For each character class and step (modulo the period) the step behind its next winning coin."""
    out = []
    for coins in _COINS:
        wins = np.flatnonzero(coins)
        ahead = np.concatenate([wins, wins[:1] + PERIOD])
        out.append(((ahead[np.searchsorted(ahead, np.arange(PERIOD))] + 1) % PERIOD).tolist())
    return out


def _records() -> np.ndarray:
    """Per sample the steps at which a shared random order reaches a new minimum, padded with a huge step."""
    rng, rows = np.random.default_rng(19970601), []
    for _ in range(SAMPLES):
        at, low, row = 0, rng.random(), [0]
        while at < 1 << 45:
            at += int(rng.geometric(low))
            low *= rng.random()
            row.append(at)
        rows.append(row)
    out = np.full((SAMPLES, max(map(len, rows))), 1 << 62, np.int64)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


_LEAVE, _STEPS = _leaving(), _records()


def classes_of(text: str) -> bytes:
    """A byte for each code point: itself below 256, folded above."""
    try:
        return text.encode("latin-1")
    except UnicodeEncodeError:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        return np.where(points < 256, points, (points * np.uint32(2654435761)) >> np.uint32(24)).astype(np.uint8).tobytes()


def walk(own: bytes, step: int = 0) -> np.ndarray:
    """The step (modulo the period) after each character, from ``step`` on."""
    leave = _LEAVE.__getitem__
    return np.array([step := row[step] for row in map(leave, own)], np.int64)


def fingerprint(own: bytes, states: np.ndarray) -> str:
    """Hexadecimal samples of the embedding of characters ``own`` whose walk is ``states``."""
    if not len(own):
        return "00" * SAMPLES
    moves = np.diff(states, prepend=0) % PERIOD
    ends = np.cumsum(moves)
    steps = _STEPS[np.arange(SAMPLES), (_STEPS < ends[-1]).sum(1) - 1]
    at = np.searchsorted(ends, steps, "right")
    padded = np.zeros(len(own) + GRAM, np.uint64)
    padded[: len(own)] = np.frombuffer(own, np.uint8)
    grams = padded[at[:, None] + np.arange(GRAM)] + np.uint64(1)
    mixed = (grams * _FACTORS).sum(1, dtype=np.uint64)
    mixed ^= mixed >> np.uint64(33)
    mixed *= np.uint64(0xFF51AFD7ED558CCD)
    return (mixed >> np.uint64(56)).astype(np.uint8).tobytes().hex()


def likeness(a: str, b: str) -> float:
    """Share of equal samples."""
    x, y = np.frombuffer(bytes.fromhex(a), np.uint8), np.frombuffer(bytes.fromhex(b), np.uint8)
    return float((x == y).mean())


def shares_band(a: str, b: str, size: int = BAND) -> bool:
    """Whether two fingerprints agree in all samples of some band: what makes them candidates."""
    x, y = (np.frombuffer(bytes.fromhex(p), np.uint8).reshape(-1, size) for p in (a, b))
    return bool((x == y).all(1).any())


def of(text: str) -> str:
    own = classes_of(text)
    return fingerprint(own, walk(own))


class _Own:
    """A text with its walk."""

    __slots__ = ("classes", "doc_id", "states", "text", "_print")

    def __init__(self, doc_id: int | None, text: str):
        self.doc_id, self.text, self.classes = doc_id, text, classes_of(text)
        self.states, self._print = walk(self.classes), None

    @property
    def print(self) -> str:
        if self._print is None:
            self._print = fingerprint(self.classes, self.states)
        return self._print


def _compared(a: _Own, b: _Own) -> tuple:
    """The result row of ``a`` with next document ``b``; only the replaced end is walked anew."""
    n = len(a.classes)
    m = n // 4
    end = b.classes[:m]
    states = a.states[: n - m]
    edited = fingerprint(a.classes[: n - m] + end, np.concatenate([states, walk(end, int(states[-1]) if n > m else 0)]))
    sha = hashlib.sha256((a.text[: n - m] + b.text[:m]).encode("utf-8", "surrogatepass")).hexdigest()
    near_edited, near_next = likeness(a.print, edited), likeness(a.print, b.print)
    found = [shares_band(a.print, other) for other in (edited, b.print)]
    return (a.doc_id, n, sha, a.print, edited, near_edited, near_next, *found, found[0] and near_edited >= VERIFIED, found[1] and near_next >= VERIFIED)


COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, candidate_edited boolean, candidate_next boolean, verified_edited boolean, verified_next boolean"
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.bool_()]
_NAMES = [x.split()[0] for x in COLUMNS.split(", ")]


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts and of their edited texts, whose last quarter is replaced by as many first
    characters of the next document in ascending doc_id (behind the last comes the first).

    ``near_`` columns are shares of equal samples; a pair is a candidate where its fingerprints share a whole band, and
    verified where all samples together reach ``VERIFIED``.

    Null text is empty; null ids come first and stay null; equal ids go by a hash of their text; repeated rows follow
    each other; an only document is its own next; an empty table gives no row; other columns are ignored.
    """
    spark = docs.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches):
        part, last, rows, edges = TaskContext.get().partitionId(), None, [], []

        def batch():
            nonlocal rows, edges
            k = len(rows)
            cols = [[*c, *([None] * len(edges))] for c in (zip(*rows) if rows else [[]] * len(_TYPES))]
            arrays = [pa.array(c, t) for c, t in zip(cols, _TYPES)]
            arrays += [pa.array([part] * (k + len(edges)), pa.int32())]
            arrays += [pa.array([0] * k + [e[0] for e in edges], pa.int32()), pa.array([None] * k + [e[1] for e in edges], pa.int64()), pa.array([None] * k + [e[2] for e in edges], pa.string())]
            rows, edges = [], []
            return pa.record_batch(arrays, names=[*_NAMES, "part", "edge", "edge_id", "edge_text"])

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = _Own(doc_id, text)
                if last is None:
                    edges.append((1, doc_id, text))
                else:
                    rows.append(_compared(last, own))
                last = own
            yield batch()
        if last is not None:
            edges.append((2, last.doc_id, last.text))
            yield batch()

    keyed = doc_columns(docs).withColumn("tie", F.xxhash64("text"))
    ordered = keyed.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie").select("doc_id", "text")
    done = ordered.mapInArrow(run, f"{COLUMNS}, part int, edge int, edge_id long, edge_text string")
    prints = ("fingerprint", "edited_fingerprint")
    done = written(done.withColumns({c: F.unhex(c) for c in prints}), spark, "fingerprints").withColumns({c: F.lower(F.hex(c)) for c in prints})
    # two texts of each partition are left over: its last meets the first of the next partition that has rows
    parts = sorted(r.part for r in done.where("edge = 1").select("part").collect())
    following = spark.createDataFrame(list(zip(parts, [*parts[1:], *parts[:1]])), "part int, other int")
    tails = done.where("edge = 2").select("part", F.col("edge_id").alias("a_id"), F.col("edge_text").alias("a_text")).join(F.broadcast(following), "part")
    heads = done.where("edge = 1").select(F.col("part").alias("other"), F.col("edge_id").alias("b_id"), F.col("edge_text").alias("b_text"))

    def meet(batches):
        for b in batches:
            rows = [_compared(_Own(r["a_id"], r["a_text"]), _Own(r["b_id"], r["b_text"])) for r in b.to_pylist()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(_TYPES), _TYPES)], names=_NAMES)

    over = tails.join(heads, "other").select("a_id", "a_text", "b_id", "b_text").mapInArrow(meet, COLUMNS)
    return done.where("edge = 0").select(*_NAMES).unionByName(over)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every whole text.

    Null texts are empty; a null ``doc_id`` stays null; equal texts, repeated rows among them, have equal fingerprints;
    an empty table gives no row; other columns are ignored.
    """

    def run(batches):
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([of(t) for t in b.column(1).to_pylist()], pa.string())], names=["doc_id", "fingerprint"])

    return doc_columns(docs).mapInArrow(run, "doc_id long, fingerprint string")


def near_classes(docs: DataFrame, least: float = 0.8, cell: int = 1024) -> DataFrame:
    """doc_id, class_id: documents whose fingerprints are ``least`` alike, directly or through others.

    Equal fingerprints are one entry; entries that share a band meet in a bucket and are verified by all samples.  A
    bucket of very many entries is compared in a grid of blocks.  Null and empty texts are one class; a null ``doc_id``
    stays null and names no class unless all of its class have none; an empty table gives no row; other columns are
    ignored.
    """
    prints = written(fingerprints(docs), docs.sparkSession, "prints")
    own = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first"))
    size = 2 * BAND
    bands = F.transform(F.sequence(F.lit(0), F.lit(SAMPLES // BAND - 1)), lambda i: F.struct(i.alias("band"), F.substring("fingerprint", i * size + 1, F.lit(size)).alias("value")))
    keyed = own.select("fingerprint", F.explode(bands).alias("key")).select("fingerprint", "key.*")
    shared = keyed.groupBy("band", "value").agg(F.count("*").alias("members")).where("members > 1")

    def bucket(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        names = sorted(table["fingerprint"].to_pylist())
        x = np.frombuffer(bytes.fromhex("".join(names)), np.uint8).reshape(len(names), SAMPLES)
        root = np.arange(len(names))
        left = np.arange(len(names))
        while len(left) > 1:
            new, left, group = left[:1], left[1:], [left[:1]]
            while len(new) and len(left):
                hit = np.zeros(len(left), bool)
                for i in new:
                    hit |= (x[left] == x[i]).mean(1) >= least
                new, left = left[hit], left[~hit]
                group.append(new)
            if len(all_ := np.concatenate(group)) > 1:
                _join(root, all_)
        a, b = _stars(names, root)
        return pa.table({"a": pa.array(a, pa.string()), "b": pa.array(b, pa.string())})

    met = grid(keyed.join(shared, ["band", "value"]), "fingerprint", least=cell)
    edges = met.select("fingerprint", "band", "value", "i", "j").groupBy("band", "value", "i", "j").applyInArrow(bucket, "a string, b string")
    labels = components(edges)
    tops = own.join(labels, own.fingerprint == labels.node, "left").select("fingerprint", "first", F.coalesce("label", "fingerprint").alias("top"))
    firsts = tops.groupBy("top").agg(F.min("first").alias("class_id"))
    return prints.join(tops.join(firsts, "top").select("fingerprint", "class_id"), "fingerprint").select("doc_id", "class_id")
