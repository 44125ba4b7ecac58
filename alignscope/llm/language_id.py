"""Language ID by multilingual mixture inference.

Every word has a likelihood under each language from the character trigrams of that language's labelled documents.
Expectation-maximisation estimates the language proportions of a document as weights of a mixture of word
likelihoods; the set of its languages is the one with the best penalised likelihood among the sets of its largest
proportions.

Rows are worked off in chunks of bounded size. A text that is longer than a chunk is read piece by piece, several times
over, so that memory does not grow with it; the result is the same.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FOLD, chunks, lean

LETTER = re.compile(r"[^\W\d_]")
IS_LETTER = np.zeros(256, bool)
IS_LETTER[65:91] = IS_LETTER[97:123] = IS_LETTER[128:] = True
#: Bytes as the trigrams see them: A-Z folded, everything but letters (and bytes from 0x80 on) a space.
SEEN = np.where(IS_LETTER, FOLD, 32).astype(np.uint32)
BUCKETS = 1 << 16
#: Up to so many languages a task counts in one table; beyond that, chunk by chunk, and chunks to predict are smaller.
DENSE = 64
#: Bytes of a long text that are held at a time.
PIECE = 1 << 20


def pieces(data: np.ndarray, size: int):
    """Letters of one text, `size` bytes at a time."""
    for i in range(0, len(data), size):
        part = data[i : i + size]
        yield Letters(part, np.array([0, len(part)]), int(data[i - 1]) if i else 32, int(data[i + size]) if i + size < len(data) else 32)


class Letters:
    """The letters of a chunk: bucket of the trigram around each, and the words and documents they form.

    left, right: the bytes around a chunk that is a piece of a text.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, left: int = 32, right: int = 32):
        seen = SEEN[data]
        inside = IS_LETTER[data]
        before, after = np.full(len(data), SEEN[left], np.uint32), np.full(len(data), SEEN[right], np.uint32)
        before[1:], after[:-1] = seen[:-1], seen[1:]
        before[offsets[:-1][offsets[:-1] < len(data)]] = 32
        after[offsets[1:][offsets[1:] > 0] - 1] = 32
        if len(data):
            before[0], after[-1] = SEEN[left], SEEN[right]
        at = np.flatnonzero(inside)
        tri = (before[at] << np.uint32(16)) | (seen[at] << np.uint32(8)) | after[at]
        self.bucket = ((tri * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)
        first = before[at] == 32
        self.word_start = np.flatnonzero(first)  # in letters
        self.doc_letters = np.searchsorted(at, offsets)
        self.doc_words = np.searchsorted(self.word_start, self.doc_letters)


def _counts(langs: list[str]):
    place = {x: i for i, x in enumerate(langs)}

    def found(batches):
        """(language, bucket) of every letter as one number."""
        for batch in batches:
            for part, data, offsets in chunks(batch, "text"):
                of = np.array([place[x] for x in part.column(0).to_pylist()], np.int64)
                for letters in [Letters(data, offsets)] if len(part) > 1 or len(data) <= PIECE else pieces(data, PIECE):
                    yield np.repeat(of, np.diff(letters.doc_letters)) * BUCKETS + letters.bucket

    def few(batches):
        n = np.zeros((len(langs), BUCKETS), np.int64)
        for key in found(batches):
            n += np.bincount(key, minlength=n.size).reshape(n.shape)
        i, j = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(n[i, j], pa.int64())], ["lang", "bucket", "n"])

    def many(batches):
        for key in found(batches):
            key, n = np.unique(key, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key // BUCKETS, pa.int32()), pa.array(key % BUCKETS, pa.int32()), pa.array(n, pa.int64())], ["lang", "bucket", "n"])

    return lean(few if len(langs) <= DENSE else many)


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray, smoothing: float = 0.5):
        self.langs = langs
        p = counts + smoothing
        self.log_p = np.log(p / p.sum(1, keepdims=True)).astype(np.float32) if len(langs) else np.zeros((0, BUCKETS), np.float32)


def train(labelled: DataFrame) -> Model:
    """Trigram counts of all labelled rows (text, lang), for every label."""
    labelled = labelled.where("text is not null and lang is not null")
    langs = sorted(r.lang for r in labelled.select("lang").distinct().collect())
    counts = np.zeros((len(langs), BUCKETS))
    if langs:
        rows = labelled.select("lang", "text").mapInArrow(_counts(langs), "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
        counts[rows.lang, rows.bucket] = rows.n
    return Model(langs, counts)


def _sums(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, starts, axis=-1) if len(starts) else np.zeros((*x.shape[:-1], 0), x.dtype)


ROUNDS, SETTLED = 40, 1e-3


def mixture(loglik: np.ndarray, starts: np.ndarray, rounds: int = ROUNDS, penalty: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (languages x documents, zero outside the chosen set) and the score of each document.

    loglik: languages x words; starts: the first word of each document, each with one word at least. EM ends when no
    proportion moves by more than SETTLED, or after `rounds`. A further language has to raise the log-likelihood by more
    than penalty * (1 + log(words)) / 2. Sets grow as long as the next language has a share of more than 0.01 and of one
    word at least. The score is the largest proportion of a set; that of a single language is its likelihood among all
    single languages.
    """
    n_lang, n_words = loglik.shape
    doc = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n_words)))
    words = np.bincount(doc, minlength=len(starts))
    top = loglik.max(0)
    p = np.exp(loglik - top)

    def fit(p, doc, starts, words, share, rounds):
        for _ in range(rounds):
            r = p * share[:, doc]
            r /= np.maximum(r.sum(0), 1e-300)
            was, share = share, _sums(r, starts) / words
            if np.abs(share - was).max() <= SETTLED:
                break
        total = (p * share[:, doc]).sum(0)
        return share, _sums(np.log(np.maximum(total, 1e-300)), starts)

    share, _ = fit(p, doc, starts, words, np.full((n_lang, len(starts)), 1 / n_lang), rounds)
    singles = _sums(np.maximum(loglik - top, -690), starts)
    best = singles.argmax(0)
    chosen = np.zeros_like(share)
    chosen[best, np.arange(len(starts))] = 1
    value = singles.max(0)
    with np.errstate(under="ignore"):
        score = 1 / np.exp(np.clip(singles - singles.max(0), -700, 0)).sum(0)
    # documents whose second language has a share worth a test
    order = np.argsort(-share, axis=0, kind="stable")
    for k in range(2, n_lang + 1):
        kth = np.take_along_axis(share, order[k - 1 : k], 0)[0]
        some = np.flatnonzero((kth * words >= 1) & (kth > 0.01))
        if not len(some):
            break
        pick = np.isin(doc, some)
        mask = np.zeros((n_lang, len(some)))
        np.put_along_axis(mask, order[:k, some], 1 / k, 0)
        sub_doc = np.searchsorted(some, doc[pick])
        sub_starts = np.flatnonzero(np.diff(sub_doc, prepend=-1))
        found, ll = fit(p[:, pick], sub_doc, sub_starts, words[some], mask, rounds)
        ll -= penalty * (k - 1) * (1 + np.log(words[some])) / 2
        better = ll > value[some]
        at = some[better]
        value[at] = ll[better]
        chosen[:, at] = found[:, better]
        score[at] = found[:, better].max(0)
    return chosen, np.clip(score, 0, 1)


def long_mixture(parts, n_lang: int, rounds: int = ROUNDS, penalty: float = 2.0) -> tuple[np.ndarray, float]:
    """mixture() of one document; parts() reads its likelihoods (languages x words) anew, piece by piece."""

    def fit(share, rounds):
        for _ in range(rounds):
            new = np.zeros(n_lang)
            for loglik in parts():
                r = np.exp(loglik - loglik.max(0)) * share[:, None]
                new += (r / np.maximum(r.sum(0), 1e-300)).sum(1)
            was, share = share, new / words
            if np.abs(share - was).max() <= SETTLED:
                break
        return share, sum(np.log(np.maximum((np.exp(x - x.max(0)) * share[:, None]).sum(0), 1e-300)).sum() for x in parts())

    words, singles = 0, np.zeros(n_lang)
    for loglik in parts():
        words += loglik.shape[1]
        singles += np.maximum(loglik - loglik.max(0), -690).sum(1)
    share, _ = fit(np.full(n_lang, 1 / n_lang), rounds)
    value, chosen = singles.max(), np.zeros(n_lang)
    chosen[singles.argmax()] = 1
    score = 1 / np.exp(np.clip(singles - value, -700, 0)).sum()
    order = np.argsort(-share, kind="stable")
    for k in range(2, n_lang + 1):
        kth = share[order[k - 1]]
        if not (kth * words >= 1 and kth > 0.01):
            break
        mask = np.zeros(n_lang)
        mask[order[:k]] = 1 / k
        found, ll = fit(mask, rounds)
        ll -= penalty * (k - 1) * (1 + np.log(words)) / 2
        if ll > value:
            value, chosen, score = ll, found, found.max()
    return chosen, float(np.clip(score, 0, 1))


def word_likelihoods(model: Model, data: np.ndarray, size: int):
    """Likelihoods (languages x words) of one text piece by piece; a word that a cut divides is summed across it."""
    held = None
    for letters in pieces(data, size):
        values = model.log_p[:, letters.bucket]
        at = letters.word_start
        first = at[0] if len(at) else values.shape[1]
        if held is not None and first:
            held = held + values[:, :first].sum(1, dtype=np.float64)
        if not len(at):
            continue
        sums = _sums(values, at).astype(np.float64)
        yield sums[:, :-1] if held is None else np.column_stack([held, sums[:, :-1]])
        held = sums[:, -1]
    if held is not None:
        yield held[:, None]


_PREDICTED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("languages", pa.string())])


def _any_letter(raw: np.ndarray, size: int = 1 << 20) -> bool:
    """Whether a text holds a letter; bytes from 0x80 on need not be letters."""
    for i in range(0, len(raw), size):
        part = raw[i : i + size]
        if (IS_LETTER[part] & (part < 128)).any():
            return True
    return any(LETTER.search(raw[max(0, i - 3) : i + size].tobytes().decode("utf-8", "ignore")) for i in range(0, len(raw), size))


def _predict(model: Model, piece: int, carried: int):
    # a piece holds as many likelihoods as a chunk of a few languages
    size = max(1, piece // 2 * DENSE // max(DENSE, len(model.langs)))
    kept = 4 << 26  # bytes of likelihoods of a long text that are remembered instead of read anew

    def long_text(raw):
        def read():
            return word_likelihoods(model, raw, size)

        known, total = [], 0
        for x in read():
            total += x.shape[1] * (4 * len(model.langs))
            if total > kept:
                known = None
                break
            known.append(x.astype(np.float32))
        parts = read if known is None else lambda: (x.astype(np.float64) for x in known)
        return long_mixture(lambda: (x for x in parts() if x.shape[1]), len(model.langs))

    def run(batches):
        for batch in batches:
            for part, data, offsets in chunks(batch, "text", size):
                langs, scores, sets = ["und"] * len(part), np.zeros(len(part)), [""] * len(part)
                if len(data) > 2 * size and model.langs:  # one long text
                    full, (share, score) = np.arange(len(part)), (np.zeros((len(model.langs), len(part))), np.zeros(len(part)))
                    if _any_letter(data):
                        at = int(np.flatnonzero(np.diff(offsets))[0])
                        share[:, at], score[at] = long_text(data)
                        full = np.array([at])
                        share, score = share[:, full], score[full]
                    else:
                        full = full[:0]
                else:
                    letters = Letters(data, offsets)
                    full = np.flatnonzero(np.diff(letters.doc_words)) if model.langs else np.zeros(0, np.int64)
                    if len(full):
                        loglik = _sums(model.log_p[:, letters.bucket], letters.word_start).astype(np.float64)
                        share, score = mixture(loglik, letters.doc_words[:-1][full])
                for i, d in enumerate(full):
                    if not _any_letter(data[offsets[d] : offsets[d + 1]]):
                        continue
                    langs[d], scores[d] = model.langs[share[:, i].argmax()], round(float(score[i]), 6)
                    sets[d] = ",".join(f"{model.langs[k]}:{share[k, i]:.3f}" for k in np.argsort(-share[:, i], kind="stable") if share[k, i] > 0)
                out = [part.column(0), part.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(sets, pa.string())]
                yield pa.RecordBatch.from_arrays([*out, *(part.column(3 + i) for i in range(carried))], [*_PREDICTED.names, *(f"_carried{i}" for i in range(carried))])

    return lean(run)


def language_id(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), piece: int = PIECE) -> DataFrame:
    """One row per row of docs: (doc_id, held_out, lang_pred, score, languages), and the columns to carry along under their names.

    lang_pred is the largest language of the chosen set and score its share (for one language, its likelihood against
    the other single languages). Null texts, texts without a letter and every text of an empty model are `und` with
    score 0. Ties go to the first language by name. A null id counts as not held out. Repeated rows get the same result.
    carry may name the text and the id too, so that a filter needs no join; carried columns must not be named like
    results other than doc_id, which then is left out.
    """
    held = F.coalesce(held_out(id_col), F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text_col).alias("text"), *(F.col(c).alias(f"_carried{i}") for i, c in enumerate(carry)))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    found = rows.mapInArrow(_predict(model, piece, len(carry)), ", ".join(["doc_id long, held_out boolean, lang_pred string, score double, languages string", *(f"_carried{i} {kinds[f'_carried{i}']}" for i in range(len(carry)))]))
    names = [c for c in _PREDICTED.names if c not in carry]
    return found.select(*names, *(F.col(f"_carried{i}").alias(c) for i, c in enumerate(carry)))


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def learn_and_predict(docs: DataFrame) -> DataFrame:
    """Learns from the labelled rows that are not held out, and predicts all rows."""
    return language_id(docs, train(docs.where(~held_out()).select("text", "lang")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn_and_predict(spark.read.parquet(f"{sf_dir}/documents.parquet"))
