"""Helpers shared by the corpus operators: column access, written stages, words of a batch."""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.staging import drop, new_folder  # noqa: F401

#: Entries a worker keeps in a word cache before it starts afresh; bounds memory, never results.
CACHE_ENTRIES = 600_000
#: Characters of texts whose words are encoded together (a longer text alone).
TEXT_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below the application's own in ``spark.checkpoint.dir``; it goes when the driver ends."""
    return new_folder(spark)


def written(df: DataFrame, spark: SparkSession, name: str = "stage") -> DataFrame:
    """Write a stage to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = f"{shared_dir(spark)}/{name}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stage = path
    return out


def fresh(df: DataFrame, name: str) -> str:
    """``name``, longer where a column of ``df`` has it already (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def grid(rows: DataFrame, own: str, members: str = "members", least: int = 1024, shares: int = 16, most: int = 50_000) -> DataFrame:
    """Rows of buckets with the cells (i, j) of their bucket's grid, in which every two rows of a bucket meet.

    A bucket of up to ``least`` rows is the one cell (0, 0).  A larger one is dealt into blocks by a hash of column
    ``own``; cell (i, j), i < j, holds two blocks, so no task takes a hot bucket whole.  Rows are copied at most
    ``shares`` times until blocks reach ``most`` rows; only beyond that do copies grow with the bucket.
    """
    block = F.greatest(F.lit(least), F.least(F.ceil(F.col(members) / shares), F.lit(most)))
    out = rows.withColumn("blocks", F.ceil(F.col(members) / block).cast("int")).withColumn("block", F.pmod(F.xxhash64(own), F.col("blocks")).cast("int"))
    other = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: (F.col("blocks") == 1) | (x != F.col("block")))
    out = out.withColumn("other", F.explode(other))
    return out.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("blocks", "block", "other")


def doc_columns(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` (null text becomes empty); other columns, of whatever name, are dropped."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def filtered(docs: DataFrame, keep) -> DataFrame:
    """Rows of ``docs``, all columns as they are, whose text ``keep`` (texts to booleans, on the workers) accepts."""
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            for i, j in slices(b.column(at)):
                part = b.slice(i, j - i)
                yield part.filter(pa.array(keep([t or "" for t in part.column(at).to_pylist()]), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


class TokenizerWords:
    """Token ids of whole texts through the ``tokenizers`` library, every distinct word encoded once while
    the worker remembers it.

    A text is cut only where the tokenizer's own pre-tokenizer always cuts, so the joined ids of its words equal the
    ids of the whole text.  ``spaced`` vocabularies (byte level, a space belongs to the word behind it) are cut
    before a space that stands in front of a visible character; the others (lower case, white space dropped) at
    spaces, line ends and before a comma or full stop that ends a word.  Words are cut, numbered and put together as
    Arrow and NumPy columns; the library sees one long string of the distinct words and its ids are cut again at
    tokens that begin with a space, or at a mark between the words.

    A text that holds the string of a special token goes whole to the library, which gives that token's id; with
    ``special_as_text`` such strings are ordinary text, as the vocabularies' own notes set it.
    """

    MARK, CUT = "\x01", "\x00"

    def __init__(self, path: str, spaced: bool, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker per core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        added = self.tokenizer.get_added_tokens_decoder().values()
        names = [t.content for t in added if t.content and not (special_as_text and t.special)]
        self.special = re.compile("|".join(map(re.escape, names)), re.IGNORECASE) if names else None
        self.spaced = spaced
        self.odd = re.compile(r" (?=\s|\Z)")
        self.before_word = re.compile(r" (?=\S)")
        self.stops = re.compile("(?<=[^\\W\\d_\u0130])([.,])(?=[ \\n]|\\Z)")  # the lower case of U+0130 ends in a mark
        self.beyond_latin = re.compile("[\u0130\u0250-\U0010ffff]")
        if spaced:
            vocabulary = self.tokenizer.get_vocab()
            self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
            for token, i in vocabulary.items():
                self.begins[i] = token.startswith("\u0120")
        else:
            (self.mark,) = self._one(self.MARK)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.starts, self.sizes = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _numbers(self, words: list[str]) -> np.ndarray:
        """Numbers of distinct words in ``starts`` and ``sizes``; new words are encoded, all at once."""
        if len(self.known) > CACHE_ENTRIES:
            self._forget()
        known = self.known
        if new := [w for w in words if w not in known]:
            ids, starts, sizes = self._words(new)
            known.update(zip(new, range(len(known), len(known) + len(new))))
            self.starts = np.concatenate([self.starts, starts + len(self.ids)])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.ids = np.concatenate([self.ids, ids])
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def _one(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _cut(self, text: str) -> str:
        """The text with ``CUT`` at every place where it is cut."""
        if self.spaced:
            return self.before_word.sub(self.CUT, text) if self.odd.search(text) else text.replace(" ", self.CUT)
        if not self.beyond_latin.search(text):
            text = text.lower()  # beyond these characters case is left to the library
        return self.stops.sub(f"{self.CUT}\\1", text).replace(" ", self.CUT).replace("\n", self.CUT)

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all words one after another, and begin and length of each word's."""
        sizes = np.zeros(len(words), np.int64)
        alone = {i: self._one(f" {w}" if self.spaced else w) for i, w in enumerate(words) if (" " if self.spaced else self.MARK) in w}
        plain = [i for i in range(len(words)) if i not in alone] if alone else range(len(words))
        found = []
        for a in range(0, len(plain), 20_000):
            own = [words[i] for i in plain[a : a + 20_000]]
            if self.spaced:
                ids = self._one(" " + " ".join(own))
                begins = np.flatnonzero(self.begins[ids])
                lengths = np.diff(begins, append=len(ids))
            else:
                ids = self._one(f" {self.MARK} ".join(own))
                marks = np.flatnonzero(ids == self.mark)
                lengths = np.diff(np.concatenate([[-1], marks, [len(ids)]])) - 1
                ids = np.delete(ids, marks)
            if len(lengths) != len(own):
                raise ValueError("words and ids do not match")
            sizes[list(plain[a : a + 20_000])] = lengths
            found.append(ids)
        starts = np.zeros(len(words), np.int64)
        order = np.fromiter(plain, np.int64, len(plain))
        starts[order] = np.cumsum(sizes[order]) - sizes[order]
        at = int(sizes[order].sum())
        for i, ids in alone.items():
            starts[i], sizes[i] = at, len(ids)
            at += len(ids)
            found.append(ids)
        return np.concatenate(found) if found else np.zeros(0, "<u4"), starts, sizes

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(texts)
        special = self.special.search if self.special else lambda _: None
        whole = {i for i, t in enumerate(texts) if self.CUT in t or special(t)}
        for i in whole:
            out[i] = self._one(texts[i]).tobytes()
        at = [i for i, t in enumerate(texts) if t and i not in whole]
        if not at:
            return out
        rows = pc.split_pattern(pa.array([self._cut(texts[i]) for i in at], pa.large_string()), self.CUT)
        words = rows.flatten().dictionary_encode()
        place, bounds = words.indices.to_numpy(), rows.offsets.to_numpy() - rows.offsets[0].as_py()
        number = self._numbers(words.dictionary.to_pylist())[place]
        ids, starts, sizes = self.ids, self.starts, self.sizes
        heads = [b""] * len(at)
        if self.spaced:
            first = words.dictionary.take(pa.array(place[bounds[:-1]])).to_pylist()
            heads = [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(first, add_special_tokens=False)]
        step = 256
        for a in range(0, len(at), step):
            z = min(a + step, len(at))
            own = number[bounds[a] : bounds[z]]
            size = sizes[own]
            if self.spaced:
                size[bounds[a:z] - bounds[a]] = 0  # the head stands for itself
            ends = np.cumsum(size)
            total = int(ends[-1])
            flat = ids[np.repeat(starts[own] - (ends - size), size) + np.arange(total)].tobytes()
            cuts = np.concatenate([[0], ends[bounds[a + 1 : z + 1] - bounds[a] - 1]]) * 4
            for k in range(z - a):
                out[at[a + k]] = heads[a + k] + flat[cuts[k] : cuts[k + 1]]
        return out


_ENCODERS: dict[tuple[str, bool, bool], TokenizerWords] = {}


def tokenizer_words(path: str, spaced: bool, special_as_text: bool = False) -> TokenizerWords:
    """The worker's encoder for a vocabulary."""
    key = (path, spaced, special_as_text)
    if key not in _ENCODERS:
        _ENCODERS[key] = TokenizerWords(*key)
    return _ENCODERS[key]


def slices(texts: list[str] | pa.Array, most_bytes: int = 4 << 20):
    """Index ranges of at most ``most_bytes`` characters, or bytes of an Arrow column (a longer text alone), to bound
    a worker's memory."""
    sizes = map(len, texts) if isinstance(texts, list) else pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    start, size = 0, 0
    for i, own in enumerate(sizes):
        if size and size + own > most_bytes:
            yield start, i
            start, size = i, 0
        size += own
    if start < len(texts):
        yield start, len(texts)
