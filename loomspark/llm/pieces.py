"""SentencePiece encoding by a score-ordered agenda of adjacent symbol pairs, and decoding.

For merge-type vocabularies: symbols start as characters, the agenda yields the adjacent pair whose joined piece
scores highest (ties: the leftmost), and stale pairs are skipped.  A text is cut where no piece of the vocabulary
holds the two neighbouring characters side by side, for no merge can cross such a place; each distinct part is
encoded once and kept.  Every text's ids are compared with the ``sentencepiece`` library, batch by batch.
"""

from __future__ import annotations

import hashlib
import heapq
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import doc_columns, slices

SPACE = "▁"
#: Words, and parts, that a worker keeps before it starts afresh; bounds memory, never results.
KNOWN = 1_000_000
#: Longest part whose agenda is a plain list; its score where a pair is no piece.
SHORT, WORST = 20, float("inf")
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class PieceAgenda:
    """Encoder for one merge-type vocabulary with byte fallback, a leading space and unchanged characters."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self._check_model(path)
        n = lib.get_piece_size()
        self.unknown = lib.unk_id()
        names = [lib.id_to_piece(i) for i in range(n)]
        self.bytes = [0] * 256
        self.rank: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        for i, piece in enumerate(names):
            if lib.is_byte(i):
                self.bytes[int(piece[1:-1], 16)] = i
            elif not (lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i)):
                self.rank[piece], self.ids[piece] = -lib.get_score(i), i
        self.has_bytes = any(self.bytes)
        self.inner = {p[i : i + 2] for p in self.rank for i in range(len(p) - 1)}
        # words are cut before a space mark unless a piece holds one behind another character
        self.by_space = not any(a != SPACE and b == SPACE for a, b in self.inner)
        self.parts: dict[str, tuple[int, ...]] = {}
        self.words: dict[str, tuple[int, ...]] = {}

    @staticmethod
    def _check_model(path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not spec.escape_whitespaces:
            raise ValueError("only merge-type models with unchanged characters and a leading space are encoded")
        if any(p.type == 4 for p in model.pieces):
            raise ValueError("user-defined pieces are not encoded")

    def _part(self, text: str) -> tuple[int, ...]:
        """Ids of a part, by the agenda: a plain list of pair scores for short parts, a heap for long ones."""
        rank = self.rank
        symbols: list[str | None] = list(text)
        n = len(symbols)
        if n <= SHORT:
            scores = [rank.get(x + y, WORST) for x, y in zip(symbols, symbols[1:])]
            while scores and (best := min(scores)) is not WORST:
                i = scores.index(best)
                x = symbols[i] = symbols[i] + symbols.pop(i + 1)
                del scores[i]
                if i < len(scores):
                    scores[i] = rank.get(x + symbols[i + 1], WORST)
                if i:
                    scores[i - 1] = rank.get(symbols[i - 1] + x, WORST)
        else:
            before, after = list(range(-1, n - 1)), [*range(1, n), -1]
            pairs = ((rank.get(text[i : i + 2]), i) for i in range(n - 1))
            agenda = [(score, i, i + 1, 2) for score, i in pairs if score is not None]
            heapq.heapify(agenda)
            while agenda:
                _, a, b, size = heapq.heappop(agenda)
                x, y = symbols[a], symbols[b]
                if x is None or y is None or after[a] != b or len(x) + len(y) != size:
                    continue
                symbols[a] = x = x + y
                symbols[b] = None
                c = after[a] = after[b]
                if c >= 0:
                    before[c] = a
                    if (score := rank.get(x + symbols[c])) is not None:
                        heapq.heappush(agenda, (score, a, c, size + len(symbols[c])))
                c = before[a]
                if c >= 0 and (score := rank.get(symbols[c] + x)) is not None:
                    heapq.heappush(agenda, (score, c, a, size + len(symbols[c])))
        out: list[int] = []
        for s in symbols:
            if s is None:
                continue
            if (i := self.ids.get(s)) is not None:
                out.append(i)
            elif self.has_bytes:
                out.extend(self.bytes[x] for x in s.encode())
            else:
                out.append(self.unknown)
        return tuple(out)

    def _word(self, word: str) -> tuple[int, ...]:
        """Ids of a word, part by part."""
        inner, parts, out, start = self.inner, self.parts, [], 0
        for i in range(1, len(word)):
            if word[i - 1 : i + 1] not in inner:
                part = word[start:i]
                if (ids := parts.get(part)) is None:
                    ids = parts[part] = self._part(part)
                out.extend(ids)
                start = i
        part = word[start:]
        if (ids := parts.get(part)) is None:
            ids = parts[part] = self._part(part)
        out.extend(ids)
        return tuple(out)

    def encode(self, texts: list[str]) -> list[list[int]]:
        if len(self.words) > KNOWN:
            self.words.clear()
        if len(self.parts) > KNOWN:
            self.parts.clear()
        words, out = self.words, []
        for text in texts:
            if not text:
                out.append([])
                continue
            text = text.replace(" ", SPACE)
            if not self.by_space:
                out.append(list(self._word(SPACE + text)))
                continue
            row = text.split(SPACE)
            # a run of marks stays with the word behind it: glue empty words to the next
            if "" in row:
                glued, run = [], ""
                for x in row[:-1]:
                    if x:
                        glued.append(run + x)
                        run = ""
                    else:
                        run += SPACE
                glued.append(run + row[-1])
                row = glued
            for w in row:
                if w not in words:
                    words[w] = self._word(SPACE + w)
            out.append(list(chain.from_iterable(map(words.__getitem__, row))))
        return out

    def decode(self, rows: list[list[int]]) -> list[str]:
        return self.library.decode(rows, num_threads=1) if rows else []


_AGENDAS: dict[str, PieceAgenda] = {}


def agenda(path: str) -> PieceAgenda:
    """The worker's encoder for a model; it outlives a task where Spark reuses the worker."""
    if path not in _AGENDAS:
        _AGENDAS[path] = PieceAgenda(path)
    return _AGENDAS[path]


def _mapped(docs: DataFrame, model_path: str, schema: str, types: list, names: list[str], row) -> DataFrame:
    def run(batches):
        own = agenda(model_path)
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, j in slices(texts):
                rows = own.encode(texts[i:j])
                if rows != own.library.encode(texts[i:j], num_threads=1):
                    raise ValueError("the agenda's ids differ from the library's")
                out = [(d, *row(r, t)) for d, r, t in zip(ids[i:j], rows, own.decode(rows))]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), types)], names=names)

    return doc_columns(docs).mapInArrow(run, schema)


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids and decoded text of every whole text (null: empty, which has no ids)."""
    types = [pa.int64(), pa.list_(pa.int32()), pa.string()]
    return _mapped(docs, model_path, "doc_id long, ids array<int>, decoded string", types, ["doc_id", "ids", "decoded"], lambda r, t: (r, t))


def digests(docs: DataFrame, model_path: str) -> DataFrame:
    """Per document the number of its ids and digests of ids and decoded text.

    Null and empty texts have no ids; a null ``doc_id`` stays null; repeated rows give repeated rows; an empty table
    gives none; other columns are ignored.  A difference from the library ends the job with an error.
    """
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return _mapped(
        docs, model_path, SCHEMA, [pa.int64(), pa.int64(), pa.string(), pa.string()], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        lambda r, t: (len(r), sha(",".join(map(str, r))), sha(t)),
    )
