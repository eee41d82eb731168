"""Language identification by segmentation-marginalised unigrams.

Over a fixed public vocabulary every language has piece probabilities.  A word's likelihood is the sum over all
its segmentations into pieces, which a forward pass computes; a text's is the product over its words.  The
probabilities are fitted by expectation-maximisation (forward-backward counts) on labelled documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import bound_batches, stage
from .tokenizers import library

#: Code points of words that are looked up at a time, one word at least.
CHUNK = 100_000
#: Probability of a character that no piece covers, in every language.
UNKNOWN = 1e-7
#: UTF-8 bytes of text that are scored at a time.
BLOCK = 1_000_000
UNDETERMINED = "und"
#: keep_identified() rejects a text if more than UNEXPLAINED of its words are likelier by MARGIN nats without a language
#: than in the text's best one, and the text as a whole by EVIDENCE nats.
UNEXPLAINED, MARGIN, EVIDENCE = 0.5, 3.0, 100.0
_SLOTS = 1 << 21
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by number, in order of their hashes, found through a table of slots; longest in code points.

    A slot holds its piece, -1 for none or -2 for several, which are searched.
    """

    size: int
    longest: int
    slots: np.ndarray
    hashes: np.ndarray

    def find(self, h: np.ndarray) -> np.ndarray:
        """The pieces of hashes, -1 for none."""
        found = self.slots[(h >> np.uint64(11)) % np.uint64(_SLOTS)]
        crowded = found == -2
        if crowded.any():
            found[crowded] = np.minimum(np.searchsorted(self.hashes, h[crowded]), self.size - 1)
        return np.where((found >= 0) & (self.hashes[found] == h), found, -1)


def _roll(h: np.ndarray, codes: np.ndarray) -> np.ndarray:
    h = (h ^ codes.astype(np.uint64)) * _MIX
    return h ^ (h >> np.uint64(29))


@lru_cache(None)
def vocabulary(name: str) -> Vocabulary:
    """The pieces of a SentencePiece file that are plain strings."""
    sp = library(name)
    own = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    hashes = np.zeros(len(own), np.uint64)
    for i, p in enumerate(own):
        h = np.zeros(1, np.uint64)
        for c in p:
            h = _roll(h, np.array([ord(c)]))
        hashes[i] = h[0]
    hashes = np.unique(hashes)
    assert len(hashes) == len(set(own)) == len(own)
    slots = np.full(_SLOTS, -1, np.int32)
    at, first, counts = np.unique((hashes >> np.uint64(11)) % np.uint64(_SLOTS), return_index=True, return_counts=True)
    slots[at] = np.where(counts > 1, -2, first)
    return Vocabulary(len(own), max(map(len, own)), slots, hashes)


def lattices(words: list[str], v: Vocabulary) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indices of words, pieces[word, end, length - 1] or -1) for groups of words of one length, some CHUNK code points each."""
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by_length.setdefault(len(w), []).append(i)
    for n, same in by_length.items():
        step = max(1, CHUNK // max(n, 1))
        for at in range(0, len(same), step):
            index = same[at : at + step]
            codes = np.frombuffer("".join(words[i] for i in index).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(index), n)
            pieces = np.full((len(index), n + 1, v.longest), -1, np.int32)
            h = np.zeros((len(index), n), np.uint64)
            for length in range(1, min(v.longest, n) + 1):
                h = _roll(h[:, : n - length + 1], codes[:, length - 1 :])
                pieces[:, length:, length - 1] = v.find(h)
            yield np.array(index), pieces


def lengths_at(pieces: np.ndarray) -> list[list[int]]:
    """For each end, the lengths of two and more of the pieces that some word has there."""
    out: list[list[int]] = [[] for _ in range(pieces.shape[1])]
    for j, k in zip(*np.nonzero((pieces[:, :, 1:] >= 0).any(axis=0)), strict=True):
        out[j].append(int(k) + 2)
    return out


def forward(pieces: np.ndarray, p: np.ndarray, whole: bool = False) -> np.ndarray:
    """log alpha of the words' ends [word, language], or with whole of all ends [word, end, language].

    p has a last row for "no such piece".  A lone character counts UNKNOWN at least.  The sums that later steps need
    are scaled by the newest one before the range of a double ends, so words may have any length.
    """
    n, reach = pieces.shape[1] - 1, pieces.shape[2]
    alpha = np.zeros((len(pieces), n + 1, p.shape[1]))
    alpha[:, 0] = 1
    scale = np.zeros((len(pieces), p.shape[1]))
    logs = np.zeros_like(alpha) if whole else None
    lengths = lengths_at(pieces)
    for j in range(1, n + 1):
        a = alpha[:, j - 1] * np.maximum(p[pieces[:, j, 0]], UNKNOWN)
        for length in lengths[j]:
            a += alpha[:, j - length] * p[pieces[:, j, length - 1]]
        alpha[:, j] = a
        if whole:
            logs[:, j] = np.log(a) + scale
        if j % reach == 0:
            alpha[:, max(0, j - reach) : j + 1] /= a[:, None]
            scale += np.log(a)
    return logs if whole else np.log(alpha[:, n]) + scale


def expected(pieces: np.ndarray, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected counts [piece, language] of weighted words, by forward-backward.

    Going back, through[word, end] is the probability that a segmentation passes the end; a piece's share of it is
    its part of the forward sum there.
    """
    n = pieces.shape[1] - 1
    alpha, through = forward(pieces, p, whole=True), np.zeros((len(pieces), n + 1, p.shape[1]))
    through[:, n] = 1
    out = np.zeros_like(p)
    lengths = lengths_at(pieces)
    for j in range(n, 0, -1):
        for length in (1, *lengths[j]):
            own = pieces[:, j, length - 1]
            q = np.maximum(p[own], UNKNOWN) if length == 1 else p[own]
            part = through[:, j] * q * np.exp(alpha[:, j - length] - alpha[:, j])
            through[:, j - length] += part
            np.add.at(out, own, part * weight)
    return out


def words_of(text: str) -> list[str]:
    """Words with their mark of a beginning."""
    return ["▁" + w for w in text.split()]


@dataclass(frozen=True)
class LanguageModel:
    """log-free piece probabilities [piece or none, language]."""

    tokenizer: str
    langs: list[str]
    p: np.ndarray


def train(
    docs: DataFrame, tokenizer: str = "piece_bpe_32k.model", train_docs: int = 1000, rounds: int = 2, max_langs: int = 256,
    text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
) -> LanguageModel:
    """Fit on a sample of some ``train_docs`` labelled documents of each language, chosen by a hash of the id.

    Rows with a null text or label teach nothing, nor do labels beyond the ``max_langs`` most frequent (ties to the
    first in order).  Both bound what is fitted on; nothing else is sampled.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    own = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id")).where("lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in own.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_langs).collect()}
    langs = sorted(sizes)
    v = vocabulary(tokenizer)
    if not langs:
        return LanguageModel(tokenizer, [], np.zeros((v.size + 1, 0)))
    share = F.lit(0.0)
    for lang in langs:
        share = F.when(F.col("lang") == lang, min(1.0, train_docs / sizes[lang])).otherwise(share)
    own = own.where(F.pmod(F.xxhash64("id", F.lit("train")), F.lit(1 << 30)) < share * (1 << 30))

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            c: Counter = Counter()
            for lang, text in zip(part["lang"], part["text"], strict=True):
                c.update((lang, w) for w in words_of(text))
            yield pd.DataFrame([(*k, n) for k, n in c.items()], columns=["lang", "word", "n"])

    words = own.select("lang", "text").mapInPandas(count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = stage(words, "lang-words")
    p = np.full((v.size + 1, len(langs)), 1 / v.size)
    p[-1] = 0
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(p)  # vocabulary x languages

        def step(parts: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            p, v = sent.value, vocabulary(tokenizer)
            total = np.zeros_like(p)
            for part in parts:
                for k, lang in enumerate(langs):
                    mine = part[part["lang"] == lang]
                    n = mine["n"].to_numpy(float)
                    for index, pieces in lattices(mine["word"].tolist(), v):
                        total[:, k] += expected(pieces, p[:, [k]], n[index][:, None])[:, 0]
            piece, lang = np.nonzero(total)
            yield pd.DataFrame({"piece": piece, "lang": lang, "n": total[piece, lang]})

        got = words.mapInPandas(step, "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
        p = np.full((v.size + 1, len(langs)), 0.01)
        p[got["piece"], got["lang"]] += got["n"]
        p[-1] = 0
        p /= p.sum(axis=0)
    return LanguageModel(tokenizer, langs, p)


def word_scores(model: LanguageModel, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log-likelihood [distinct word, language], distinct word of each word, words before each text and in all)."""
    v, lists = vocabulary(model.tokenizer), [words_of(t) for t in texts]
    codes, distinct = pd.factorize(np.array([w for x in lists for w in x] or [""], dtype=object))
    logs = np.zeros((len(distinct), len(model.langs)))
    for index, pieces in lattices(list(distinct), v):
        logs[index] = forward(pieces, model.p)
    return logs, codes, np.cumsum([0, *(len(x) for x in lists)])


def sum_texts(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums [text, language] of values [word, language]."""
    sums = np.vstack([np.zeros(values.shape[1]), np.cumsum(values, axis=0)])
    return sums[at[1:]] - sums[at[:-1]]


def score_texts(model: LanguageModel, texts: list[str]) -> np.ndarray:
    """log-likelihood [text, language], whole texts."""
    logs, codes, at = word_scores(model, texts)
    return sum_texts(logs[codes], at)


def blocks(texts: list[str | None]) -> Iterator[list[int]]:
    """The numbers of the texts that have a letter, some BLOCK of text at a time."""
    out, size = [], 0
    for i, t in enumerate(texts):
        if t and any(map(str.isalpha, t)):
            out.append(i)
            size += len(t)
            if size >= BLOCK:
                yield out
                out, size = [], 0
    if out:
        yield out


def predictor(model: LanguageModel):  # noqa: ANN201
    """A pandas function from a text column to (lang, score); ``und`` and 0 where the text is null or has no letter."""
    sent_model = model

    @F.pandas_udf("lang string, score double")
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        langs = sent_model.langs
        for part in parts:
            texts = part.tolist()
            lang, score = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts))
            for todo in blocks(texts) if langs else ():
                ll = score_texts(sent_model, [texts[i] for i in todo])
                best = ll.argmax(axis=1)
                lang[todo] = np.array(langs, object)[best]
                score[todo] = 1 / np.exp(ll - ll.max(axis=1, keepdims=True)).sum(axis=1)
            yield pd.DataFrame({"lang": lang, "score": score})

    return predict


def with_background(model: LanguageModel) -> LanguageModel:
    """The model with one more language, in which all pieces are alike: text without a language."""
    even = np.full((len(model.p), 1), 1 / (len(model.p) - 1))
    even[-1] = 0
    return LanguageModel(model.tokenizer, [*model.langs, UNDETERMINED], np.hstack([model.p, even]))


def explained(model: LanguageModel, texts: list[str]) -> np.ndarray:
    """Which texts some language explains; model comes from with_background()."""
    logs, codes, at = word_scores(model, texts)
    gain = (logs[:, :-1] - logs[:, -1:])[codes]
    sums, rows = sum_texts(gain, at), np.arange(len(texts))
    best = sums.argmax(axis=1)
    odd = sum_texts((gain < -MARGIN).astype(float), at)[rows, best]
    return (odd <= UNEXPLAINED * np.diff(at)) | (sums[rows, best] >= -EVIDENCE)


def identified(model: LanguageModel):  # noqa: ANN201
    """A pandas function from a text column to whether it has a letter and, if the model knows languages, one explains it."""
    sent_model = with_background(model)

    @F.pandas_udf("boolean")
    def keep(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            texts = part.tolist()
            out = np.zeros(len(texts), bool)
            for todo in blocks(texts):
                out[todo] = explained(sent_model, [texts[i] for i in todo]) if len(sent_model.langs) > 1 else True
            yield pd.Series(out)

    return keep


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves no remainder by 5; null ids count as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **fit: object) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score.

    Learns from rows that are not held out.  Texts of any length are scored whole; of equally likely languages the
    first in order is named.  Repeated rows and null ids keep rows of their own; extra columns are ignored; an empty
    table gives an empty result; without any label all is ``und``.
    """
    model = train(docs.where(~held_out(F.col(id_col))), text_col=text_col, lang_col=lang_col, id_col=id_col, **fit)
    out = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), predictor(model)(F.col(text_col)).alias("found"))
    return out.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs without those that have no language; all columns stay as they are.

    Those are texts that are null, have no letter, or that the fitted model rejects: most words are clearly
    likelier as pieces without a language than in the best language (explained()).  A rejection takes EVIDENCE nats,
    so short texts, and long words within prose, do not lead to one.  Where no row that is learnt from has a label,
    there is no model to reject by and all texts with a letter stay.
    """
    model = train(docs.where(~held_out(F.col(id_col))), text_col=text_col, lang_col=lang_col, id_col=id_col)
    return docs.where(identified(model)(F.col(text_col)))
