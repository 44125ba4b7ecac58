"""SentencePiece encoding and decoding by a Viterbi pass over a trie of words.

A piece never holds a word-boundary mark after another character, so a text splits into marked words (a run of marks
and what follows it) that are encoded on their own. The distinct marked words of a batch are sorted, which lays them
out as the depth-first order of their trie, and the forward pass goes down that trie: each character's state is
computed once for all words that share the prefix up to it.

The lattice has an edge for every piece that ends at a position. For a unigram model every path counts and the state
is the best sum of scores. For a BPE model a path is admissible only if merging would leave every two neighbouring
pieces apart; exactly one admissible path leads to each position, so the forward pass finds the pieces that merging
would, without merging.
"""

from __future__ import annotations

import itertools
import os.path
import re
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, outlasting

MARK = "▁"
UNIGRAM, BPE = 1, 2


class PieceModel:
    """The pieces of a model file that has byte fallback and no normalisation beyond the mark."""

    def __init__(self, content: bytes):
        from sentencepiece import sentencepiece_model_pb2

        m = sentencepiece_model_pb2.ModelProto()
        m.ParseFromString(content)
        if m.normalizer_spec.precompiled_charsmap or not m.normalizer_spec.escape_whitespaces or m.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("models with a normalisation of their own are not supported")
        if not m.trainer_spec.byte_fallback or m.trainer_spec.model_type not in (UNIGRAM, BPE):
            raise ValueError("a unigram or BPE model with byte fallback is needed")
        self.kind, self.dummy_prefix = m.trainer_spec.model_type, m.normalizer_spec.add_dummy_prefix
        normal = m.SentencePiece.NORMAL
        self.id = {p.piece: i for i, p in enumerate(m.pieces) if p.type == normal}
        if bad := [p for p in self.id if re.search(f"[^{MARK}]{MARK}", p)]:
            raise ValueError(f"pieces across words: {bad[:3]}")
        self.score = {p.piece: p.score for p in m.pieces if p.type == normal}
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(m.pieces) if p.type == m.SentencePiece.BYTE}
        of_byte = {i: bytes([b]) for b, i in self.byte.items()}
        self.bytes = [of_byte.get(i, p.piece.encode()) for i, p in enumerate(m.pieces)]
        self.spelled = pa.array([b.replace(MARK.encode(), b" ") for b in self.bytes], pa.binary())
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.longest = max(map(len, self.id), default=1)
        self.remembered = 100
        #: all pieces that end at a place of a word
        self.ending = ahocorasick.Automaton()
        for p, i in self.id.items():
            self.ending.add_word(p, (len(p), p, self.score[p], array("i", [i]).tobytes()))
        self.ending.make_automaton()
        #: in a unigram model an unknown character costs ten more than the worst piece
        self.unknown = min(self.score.values(), default=0.0) - 10
        self._apart: dict[tuple[str, str], bool] = {}

    # ------------------------------------------------------------ BPE: which pieces merging leaves

    def _merged(self, text: str) -> list[str]:
        """The pieces into which merging turns the characters of a short text: best score first, leftmost of equals."""
        parts = list(text)
        while True:
            best = None
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best[0]):
                    best = (s, i)
            if best is None:
                return parts
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    def apart(self, left: str, right: str) -> bool:
        """Whether merging the characters of left + right ends with these two pieces ('' on the left: with right)."""
        key = (left, right)
        if key not in self._apart:
            if len(self._apart) > 200_000:
                self._apart.clear()
            self._apart[key] = self._merged(left + right) == [x for x in key if x]
        return self._apart[key]

    # ------------------------------------------------------------ forward pass

    def encode_sorted(self, words: list[str]):
        """Yields (word, ids as int32 bytes) for sorted distinct words, keeping the states of the prefix shared with the word before.

        The state of a position: score of the best path to it, that path's last piece and the ids of that piece (int32
        bytes). The piece's length points back to the state before it, so memory grows with a word's length alone.
        """
        extend = self._extend_bpe if self.kind == BPE else self._extend_unigram
        scores, pieces, coded = array("d", [0.0]), [""], [b""]
        last = ""
        for word in words:
            shared = len(os.path.commonprefix([last, word]))
            del scores[shared + 1 :], pieces[shared + 1 :], coded[shared + 1 :]
            last = word
            extend(word, shared, scores, pieces, coded)
            path, at = [], len(word)
            while at:
                path.append(coded[at])
                at -= len(pieces[at])
            path.reverse()
            yield word, b"".join(path)

    def _extend_bpe(self, word: str, done: int, scores: array, pieces: list, coded: list) -> None:
        """Adds the states after `done`; the first admissible edge is the only one."""
        apart = self._apart.get
        for at, (size, piece, score, ids) in self.ending.iter(word, max(0, done + 1 - self.longest)):
            if at < done:
                continue
            while done < at:
                self._add_bytes(word, done, scores, pieces, coded)
                done += 1
            start = at + 1 - size
            ok = apart((pieces[start], piece))
            if ok is None:
                ok = self.apart(pieces[start], piece)
            if ok:
                scores.append(scores[start] + score)
                pieces.append(piece)
                coded.append(ids)
                done = at + 1
        while done < len(word):
            self._add_bytes(word, done, scores, pieces, coded)
            done += 1

    def _extend_unigram(self, word: str, done: int, scores: array, pieces: list, coded: list) -> None:
        """Adds the states after `done`; of equal sums the longer last piece wins."""
        ending = itertools.groupby(self.ending.iter(word, max(0, done + 1 - self.longest)), lambda e: e[0])
        place, edges = next(ending, (len(word), ()))
        for at in range(done, len(word)):
            while place < at:
                place, edges = next(ending, (len(word), ()))
            best = max(((scores[at + 1 - e[0]] + e[2], e[0], e) for _, e in edges), default=None) if place == at else None
            if word[at] not in self.id and (best is None or scores[at] + self.unknown > best[0]):
                self._add_bytes(word, at, scores, pieces, coded)
            else:
                _, piece, _, ids = best[2]
                scores.append(best[0])
                pieces.append(piece)
                coded.append(ids)

    def _add_bytes(self, word: str, at: int, scores: array, pieces: list, coded: list) -> None:
        """The state after a character that is no piece: an edge of its own, its bytes stand for it."""
        if word[at] in self.id:
            raise ValueError(f"no admissible path to {at + 1} of a word of {len(word)} characters")
        scores.append(scores[at] + self.unknown)
        pieces.append(word[at])
        coded.append(array("i", [self.byte[b] for b in word[at].encode("utf-8", "surrogatepass")]).tobytes())

    # ------------------------------------------------------------ whole texts, column by column

    def encode_texts(self, texts: pa.Array, cache: int = 150_000) -> pa.ListArray:
        """The ids of each text; null is empty. Words seen before are remembered, at most about twice `cache` of them."""
        texts = pc.replace_substring(pc.fill_null(texts, ""), MARK, " ")
        if self.dummy_prefix:
            texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", pc.binary_join_element_wise(" ", texts, ""))
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        # a word begins at a text's begin and at a space after another byte
        begin = data == 32
        begin[1:] &= data[:-1] != 32
        begin[offsets[:-1][offsets[:-1] < len(data)]] = True
        starts = np.flatnonzero(begin)
        words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(data)).astype(np.int32)), pa.py_buffer(data.tobytes())).dictionary_encode()
        distinct = [w.replace(" ", MARK) for w in words.dictionary.to_pylist()]
        if len(self.known) > cache:  # words not met again for a while are forgotten
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        fresh = set(distinct) - known.keys()
        again = fresh & older.keys()
        known.update((w, older[w]) for w in again)
        for word, ids in self.encode_sorted(sorted(fresh - again)):
            known[word] = ids
        coded = [known[w] for w in distinct]
        for word in distinct:  # only short words are worth the memory
            if len(word) > self.remembered:
                known.pop(word, None)
        bounds = np.cumsum([0, *map(len, coded)]) // 4
        by_word = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.frombuffer(b"".join(coded), np.int32)))
        ids = by_word.take(words.indices)
        at = np.append(0, np.cumsum(np.diff(bounds)[words.indices.to_numpy()]))[np.searchsorted(starts, offsets)]
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), ids.flatten())

    def decode_ids(self, ids: pa.ListArray) -> pa.Array:
        """The text of each list of ids (null: empty); a mark in the text that was encoded comes back as a space."""
        flat = self.spelled.take(ids.flatten())
        ends = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy()))
        at = np.frombuffer(flat.buffers()[1], np.int32)[: len(flat) + 1][ends].astype(np.int64)
        data = np.frombuffer(flat.buffers()[2] or b"", np.uint8)[: at[-1]]
        if self.dummy_prefix:  # the first space of a text is not its own
            first = at[:-1][at[1:] > at[:-1]]
            first = first[data[first] == 32]
            data = np.delete(data, first)
            at = at - np.searchsorted(first, at)
        out = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data.tobytes())])
        return out.cast(pa.string())


@outlasting
@lru_cache(maxsize=2)
def piece_model(content: bytes) -> PieceModel:
    """One model for each worker, whose memory of words outlasts a task but not the worker's next run of another kind."""
    return PieceModel(content)


# ---------------------------------------------------------------- DataFrames


def _parts(batch: pa.RecordBatch, limit: int = 2 << 20):
    """Slices of a batch of about `limit` bytes each."""
    n = max(1, -(-batch.nbytes // limit))
    step = max(1, -(-batch.num_rows // n))
    for i in range(0, batch.num_rows, step):
        yield batch.slice(i, step)


_FIELDS = {"doc_id": "long", "text": "string", "ids": "array<int>", "decoded": "string"}


def encode(docs: DataFrame, content: bytes, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """One row per row of docs: (doc_id, text, ids array<int>), as the model's library encodes the text.

    content: the bytes of a model file. decoded adds the text of the ids, decoded in the same pass. Null and empty texts
    have no ids; repeated rows repeat their ids; an empty table gives an empty table; other columns are not read. There
    is no shuffle; a worker remembers a bounded number of words.
    """
    names = list(_FIELDS)[: 4 if decoded else 3]

    def run(batches):
        model = piece_model(content)
        for batch in batches:
            for part in _parts(batch):
                ids = model.encode_texts(part.column(1))
                yield pa.RecordBatch.from_arrays([*part.columns, ids, *([model.decode_ids(ids)] if decoded else [])], names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(run, "piece_model"), ", ".join(f"{n} {_FIELDS[n]}" for n in names))


def decode(encoded: DataFrame, content: bytes) -> DataFrame:
    """Adds `decoded`, the text of ids, to (doc_id, text, ids). Null ids decode to an empty text."""

    def run(batches):
        model = piece_model(content)
        for batch in batches:
            for part in _parts(batch):
                yield pa.RecordBatch.from_arrays([*part.columns, model.decode_ids(part.column(2))], list(_FIELDS))

    return encoded.select("doc_id", "text", "ids").mapInArrow(lean(run, "piece_model"), ", ".join(f"{n} {t}" for n, t in _FIELDS.items()))


def round_trip():
    """Whether the decoded text is the original one (null: empty), whose marks (U+2581) count as spaces."""
    return F.col("decoded") == F.replace(F.coalesce("text", F.lit("")), F.lit(MARK), F.lit(" "))


def encode_and_decode(docs: DataFrame, content: bytes) -> DataFrame:
    """(doc_id, n_ids, ids_sha256, text_sha256, round_trip): digests of the ids (decimal, comma-joined) and of the decoded text."""
    df = encode(docs, content, decoded=True)
    return df.select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("text_sha256"), round_trip().alias("round_trip"))


#: The default model file; every operator takes the bytes of any other.
MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"


def model_content(path: str = MODEL_FILE) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def query(spark: SparkSession, sf_dir: str, model_file: str = MODEL_FILE) -> DataFrame:
    return encode_and_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), model_content(model_file))
