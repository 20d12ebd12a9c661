"""Language identification by segmentation-marginalised unigrams.

Every language has probabilities over the pieces of one fixed public vocabulary.  A word's probability is the sum
over all its segmentations into pieces, by a forward algorithm; a text's score is the sum over its words.  Piece
probabilities are fitted by expectation-maximisation on a bounded sample of labelled texts.  Words are scored once
per worker, all new words of a batch together.
"""

from __future__ import annotations

import re
import sys
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHE_ENTRIES, filtered, slices

#: Labelled texts of each language that the model is fitted on at most, in the order of a hash of their doc_id.
SAMPLE_PER_LANG, MOST_LANGS = 150, 500
#: Longer runs of letters are scored in parts of this many characters (segmentations across a cut are not summed);
#: rounds of fitting.
RUN, ROUNDS = 32, 4
UNKNOWN = "und"


def _letters() -> str:
    """A character class of letters: word characters but digits, the underscore and numerals that are no letters."""
    points = [i for i in range(128, sys.maxunicode + 1) if not 0xD800 <= i < 0xE000 and (c := chr(i)).isalnum() and not (c.isalpha() or c.isdecimal())]
    runs: list[list[int]] = []
    for i in points:
        if runs and runs[-1][1] == i - 1:
            runs[-1][1] = i
        else:
            runs.append([i, i])
    return r"[^\W\d_" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs) + "]"


_WORDS = re.compile(_letters() + "+")


def held_out(doc_id) -> F.Column:
    """True where crc32 of the id as text leaves 2 modulo 4; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def vocabulary(model_path: str) -> list[str]:
    """Lower-case letter pieces of the vocabulary in alphabetical order; ``_`` marks the beginning of a word."""
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=model_path)
    own = {lib.id_to_piece(i).lower().replace("▁", "_") for i in range(lib.get_piece_size()) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i))}
    return sorted(p for p in own if _WORDS.fullmatch(p.removeprefix("_")))


def words_of(text: str) -> list[str]:
    """Runs of letters of the text in lower case; long runs in parts."""
    found = _WORDS.findall(text.lower())
    if found and max(map(len, found)) > RUN:
        found = [w[i : i + RUN] for w in found for i in range(0, len(w), RUN)]
    return found


class Lattice:
    """All pieces in all words: arrays of (word, begin, end, piece), by ascending end.

    A character that is no piece of its own has the edge ``len(vocabulary)``, so every word has a segmentation.
    """

    def __init__(self, words: list[str], index: dict[str, int]):
        at, begin, end, piece = [], [], [], []
        get, none = index.get, len(index)
        longest = max(map(len, index), default=1)
        for i, w in enumerate(words):
            w = "_" + w
            n = len(w)
            for e in range(1, n + 1):
                if e == 1:
                    at.append(i)
                    begin.append(0)
                    end.append(1)
                    piece.append(none)
                    continue
                if get(w[e - 1 : e]) is None:
                    at.append(i)
                    begin.append(e - 1)
                    end.append(e)
                    piece.append(none)
                for b in range(max(0, e - longest), e):
                    if (p := get(w[b:e])) is not None:
                        at.append(i)
                        begin.append(b)
                        end.append(e)
                        piece.append(p)
        self.n = len(words)
        self.length = np.fromiter((len(w) + 1 for w in words), np.int32, self.n)
        order = np.argsort(np.array(end, np.int32), kind="stable")
        self.at, self.begin, self.end, self.piece = (np.array(x, np.int32)[order] for x in (at, begin, end, piece))
        self.cuts = np.searchsorted(self.end, np.arange(1, (self.length.max() if self.n else 0) + 2))

    def forward(self, p: np.ndarray) -> np.ndarray:
        """alpha[word, position, language]; ``p`` has a row for each piece and one for unknown characters."""
        width, langs = len(self.cuts), p.shape[1]
        alpha = np.zeros((self.n, width, langs))
        alpha[:, 0] = 1
        for e, (a, z) in enumerate(zip(self.cuts, self.cuts[1:]), 1):
            v = alpha[self.at[a:z], self.begin[a:z]] * p[self.piece[a:z]]
            for k in range(langs):
                alpha[:, e, k] = np.bincount(self.at[a:z], weights=v[:, k], minlength=self.n)
        return alpha

    def backward(self, p: np.ndarray) -> np.ndarray:
        beta = np.zeros((self.n, len(self.cuts), p.shape[1]))
        beta[np.arange(self.n), self.length] = 1
        for a, z in zip(self.cuts[-2::-1], self.cuts[:0:-1]):
            if z > a:
                v = beta[self.at[a:z], self.end[a:z]] * p[self.piece[a:z]]
                np.add.at(beta, (self.at[a:z], self.begin[a:z]), v)
        return beta

    def scores(self, p: np.ndarray) -> np.ndarray:
        """log P(word) by language."""
        if not self.n:
            return np.zeros((0, p.shape[1]))
        return np.log(np.maximum(self.forward(p)[np.arange(self.n), self.length], 1e-300))


@dataclass
class LanguageModel:
    langs: list[str]
    index: dict[str, int]
    p: np.ndarray
    known: dict[str, int] = field(default_factory=dict, repr=False)
    table: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)), repr=False)

    def __getstate__(self):
        return {**self.__dict__, "known": {}, "table": np.zeros((0, 0))}

    def log_likelihoods(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sum over the words of each text by language, and the number of words."""
        if len(self.known) > CACHE_ENTRIES:
            self.known.clear()
        if not self.known:
            self.table = np.zeros((0, len(self.langs)))
        rows = [words_of(t) for t in texts]
        known = self.known
        new = [w for w in set().union(*rows) if w not in known] if rows else []
        new.sort(key=len)  # words of like length share a lattice without empty columns
        found = [Lattice(new[i : i + 8192], self.index).scores(self.p) for i in range(0, len(new), 8192)]
        size = len(known)
        known.update(zip(new, range(size, size + len(new))))
        if size + len(new) > len(self.table):
            grown = np.zeros((2 * (size + len(new)), len(self.langs)))
            grown[:size] = self.table[:size]
            self.table = grown
        if found:
            self.table[size : size + len(new)] = np.concatenate(found)
        out = np.zeros((len(texts), len(self.langs)))
        get = known.__getitem__
        for i, row in enumerate(rows):
            if row:
                out[i] = self.table[np.fromiter(map(get, row), np.int64, len(row))].sum(0)
        return out, np.array([len(r) for r in rows])

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and its probability; ties go to the alphabetically first; no letter: ``und`` and 0."""
        like, n = self.log_likelihoods(texts)
        best = like.argmax(1)
        share = 1 / np.exp(like - like.max(1, keepdims=True)).sum(1)
        return [self.langs[k] if m else UNKNOWN for k, m in zip(best.tolist(), n.tolist())], np.where(n > 0, share, 0.0)


def fit(rows: list, model_path: str) -> LanguageModel | None:
    """Fit on rows with ``text`` and ``lang``; None without any."""
    by: dict[str, Counter] = defaultdict(Counter)
    for r in rows:
        by[r.lang].update(words_of(r.text or ""))
    langs = sorted(lang for lang, words in by.items() if words)
    if not langs:
        return None
    index = {p: i for i, p in enumerate(vocabulary(model_path))}
    words = sorted(set().union(*by.values()), key=lambda w: (len(w), w))
    counts = np.array([[by[lang][w] for lang in langs] for w in words], float)
    size = len(index)
    lattices = [(Lattice(words[i : i + 8192], index), counts[i : i + 8192]) for i in range(0, len(words), 8192)]
    p = np.full((size + 1, len(langs)), 1.0 / size)
    p[size] = 1e-6
    for _ in range(ROUNDS):
        seen = np.zeros((size + 1, len(langs)))
        for lattice, c in lattices:
            alpha, beta = lattice.forward(p), lattice.backward(p)
            total = np.maximum(alpha[np.arange(lattice.n), lattice.length], 1e-300)
            for k in range(len(langs)):
                gamma = alpha[lattice.at, lattice.begin, k] * p[lattice.piece, k] * beta[lattice.at, lattice.end, k] * (c[:, k] / total[:, k])[lattice.at]
                seen[:, k] += np.bincount(lattice.piece, weights=gamma, minlength=size + 1)
        seen[size] = 0
        p = (seen + 0.05) / (seen[:size] + 0.05).sum(0)
        p[size] = 1e-6
    return LanguageModel(langs, index, p)


def sample(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG) -> list:
    """About ``per_lang`` labelled texts of each language outside the held-out fold, by a hash of doc_id.

    Of more than ``MOST_LANGS`` values of ``lang`` the most frequent are learned: a corpus with a value for every row is
    no labelling, and the plan would hold a branch for each.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id"))
    counts = {r.lang: r["count"] for r in own.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGS).collect()}
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, per_lang / n))).otherwise(share)
    return own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20)).select("text", "lang").limit(2 * per_lang * max(1, len(counts))).collect()


def train(docs: DataFrame, model_path: str, per_lang: int = SAMPLE_PER_LANG) -> LanguageModel | None:
    return fit(sample(docs, per_lang), model_path)


def predict(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score.

    Null texts and texts without a letter are ``und`` with score 0, as is everything where no language was learned;
    a null ``doc_id`` stays null; repeated rows score alike; an empty table gives no row; other columns are ignored.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # bounded by vocabulary times languages

    def run(batches):
        own = shipped.value
        for b in batches:
            texts = b.column(1).to_pylist()
            langs, scores = [], []
            for i, j in slices(texts):
                got = own.predict(texts[i:j]) if own else ([UNKNOWN] * (j - i), np.zeros(j - i))
                langs += got[0]
                scores += got[1].tolist()
            yield pa.record_batch([b.column(0), b.column(2), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), held_out("doc_id").alias("held_out"))
    return own.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep(docs: DataFrame, model: LanguageModel | None, least: float = 0.5) -> DataFrame:
    """Rows of ``docs``, all columns as they are, with a language of probability ``least`` or more.

    Null texts and texts without a letter go; where no language was learned, all texts with a letter stay, for none
    can be rejected.  Null ids stay null, repeated rows are judged alike, an empty table stays empty.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def accept(texts):
        if shipped.value is None:
            return [bool(words_of(t)) for t in texts]
        langs, scores = shipped.value.predict(texts)
        return [lang != UNKNOWN and score >= least for lang, score in zip(langs, scores.tolist())]

    return filtered(docs, accept)
