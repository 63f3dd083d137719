"""Scoring documents for abusive, hateful or sexual content.

A document is a case if some passage of it is, so the unit of the model is the
passage: a sentence, or overlapping windows of a long one.  Words are undisguised
first (look-alike letters, zero-width characters, digits for letters, spaced,
dotted, stretched and masked spellings); identifiers, paths and numbers become
placeholders.  Features are hashed word n-grams and skip-grams.  The model is a
logistic regression trained by FTRL-proximal: a learning rate per coordinate and
L1 sparsity, which leaves a small set of weights to broadcast.

People's verdicts are on documents and partly wrong.  Training alternates: the
passages of documents called clean are negative; of a document called a case the
highest scored passages are positive, and documents whose verdict models that did
not see them contradict are set aside.

The threshold comes from the scores that models gave to documents they did not
see.  Labels favour cases, so clean documents weigh as much more as it takes to
bring cases down to ``base_rate`` of all; the best F-score under these weights, in
which precision counts twice as much as recall, holds.
Where even a cautious estimate of precision there is below one half, the verdicts
are too few to tell cases, and no document is called one (``threshold`` infinite).

The classifier is fitted on the driver on at most ``max_documents`` labelled
documents of at most ``max_chars`` characters together (drawn by the hash of
their id where there are more); every document is scored, over its whole text, by
Arrow batches on the executors.

Defined results: null verdicts do not count, the majority of the others holds and
ties are left out; null, empty and blank texts score 0; copies score alike and
repeated rows give a row each; without at least one verdict of either kind every
score is 0 and no document is a case; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.workspace import ship

#: Letters of other scripts that look like Latin ones (fixed values).
LOOKALIKES = str.maketrans(
    "аеорсухіѕјкмтвнАВЕКМНОРСТУХІЅЈαορνκιτ",
    "aeopcyxisjkmtbhABEKMHOPCTYXISJaopvkit",
)
#: Digits and signs that stand for letters inside a word (fixed values).
STANDINS = str.maketrans("013457@$+!|€", "oieastastile")
#: A line break within a sentence: the next line goes on in lower case, or both are in capitals.
_WRAP = re.compile(r"(?<=\S)[ \t]*\r?\n[ \t]*(?=[a-zß-öø-ÿ])|(?<=[A-ZÀ-Þ]{2})[ \t]*\r?\n[ \t]*(?=[A-ZÀ-Þ]{2})")
_NUMBERED = re.compile(r"^[^\W\d_]{2,}\d+$")
_HIDDEN = re.compile("[­᠎​-‏⁠-⁤﻿]")
_CHUNK = re.compile(r"<[\w-]+>|\S+")
_ENDS = re.compile(r"[.!?;]+[\"'”“»)\]]*$")
_QUOTES = "\"“”„«»‘’`"
_EDGE = ".,;:!?()[]{}<>…*#-–—=" + _QUOTES + "'"
_SPLIT_LETTERS = re.compile(r"^(?:[^\W\d_][.\-_*·|]){2,}[^\W\d_]$")
_MASKED = re.compile(r"^[^\W\d_]+[*#]+[^\W\d_]+$|^[^\W\d_]+[*#]{2,}$")
_MIXED = re.compile(r"(?=.*[^\W\d_])(?=.*[\d@$+!|€])^[\w@$+!|€]+$")
_STRETCH = re.compile(r"([^\W\d_])\1{2,}")
_CAMEL = re.compile(r"[a-zß-ÿ][A-Z]")
_PART = re.compile(r"[A-ZÀ-Þ]?[a-zß-ÿ]+|[A-ZÀ-Þ]+(?![a-zß-ÿ])")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|\d+")


def _plain(core: str) -> str:
    return _STRETCH.sub(r"\1", core.lower())


@lru_cache(maxsize=100_000)
def words_of(chunk: str) -> tuple[str, ...]:
    """Normalised words of a run of non-space characters, quotes as words of their own."""
    out: list[str] = []
    if chunk[0] in _QUOTES or chunk.lstrip("([")[:1] in _QUOTES and chunk.lstrip("(["):
        out.append('"')
    core = chunk.strip(_EDGE)
    closing = '"' if any(q in chunk[-3:] for q in _QUOTES) and len(chunk) > 1 else None
    if core:
        if _SPLIT_LETTERS.match(core):
            out.append(_plain(re.sub(r"[^\w]|_", "", core)))
        elif _MASKED.match(core):
            letters = re.sub(r"[*#]+", "*", core.lower())
            out += ["<mask>", letters]
        elif _CAMEL.search(core) or "_" in core or "/" in core or "::" in core:
            out.append("<id>")
        elif core.isdigit():
            out.append("0")
        elif _NUMBERED.match(core):
            out.append("<id>")
        elif _MIXED.match(core):
            out.append(_plain(re.sub(r"[^\w]|\d|_", "", core.translate(STANDINS))) or "0")
        else:
            out += ["0" if w[0].isdigit() else _plain(w) for w in _WORD.findall(core)]
    if closing:
        out.append(closing)
    return tuple(out)


def spaced(letters: list[str]) -> list[str]:
    """A run of single letters: a word spelled out, or just letters.  After an
    article or pronoun the word may begin with either letter."""
    if len(letters) < 4:
        return [x.lower() for x in letters]
    whole = _plain("".join(letters))
    return [whole, _plain("".join(letters[1:]))] if whole[0] in "ai" else [whole]


@lru_cache(maxsize=200_000)
def _read(chunk: str) -> tuple[str | None, tuple[str, ...], tuple[str, ...], bool]:
    """(single letter or '' for a tag or None, words, parts of a name, whether a sentence ends)."""
    if chunk[0] == "<" and chunk[-1] == ">":
        return "", (), (), True
    bare = chunk.strip(_EDGE)
    if len(bare) == 1 and bare.isalpha():
        return bare, (), (), False
    named = words_of(chunk)
    parts: tuple[str, ...] = ()
    if "<id>" in named and "/" not in bare:  # a name may speak, too
        parts = tuple(_plain(x) for x in _PART.findall(bare))
    return None, named, parts if len(parts) > 1 else (), bool(_ENDS.search(chunk))


def passages(text: str | None, window: int = 16, stride: int = 8) -> list[tuple[str, ...]]:
    """The distinct passages of a text as tuples of normalised words."""
    if not text or not text.strip():
        return []
    if not text.isascii():
        text = _HIDDEN.sub("", unicodedata.normalize("NFKC", text)).translate(LOOKALIKES)
    if "\n" in text:
        text = _WRAP.sub(" ", text)
    found: dict[tuple[str, ...], None] = {}

    def close(words: list[str]) -> None:
        if not words:
            return
        if len(words) <= window:
            found[tuple(words)] = None
            return
        for at in range(0, len(words) - window + stride, stride):
            found[tuple(words[at : at + window])] = None

    for line in text.split("\n"):
        words: list[str] = ["<s>"]
        letters: list[str] = []
        for chunk in _CHUNK.findall(line):
            letter, named, parts, ends = _read(chunk)
            if letter:
                letters.append(letter)
                continue
            if letters:
                words += spaced(letters)
                letters = []
            words += named
            if parts:
                close(["<name>", *parts])
            if ends:
                close(words[1:] and words)
                words = ["<s>"]
        words += spaced(letters)
        close(words[1:] and words)
    return list(found)


@dataclass
class Rows:
    """Feature rows of passages, one after another."""

    flat: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, rows: list[np.ndarray]) -> Rows:
        ends = np.cumsum([len(r) for r in rows], dtype=np.int64) if rows else np.zeros(0, np.int64)
        return cls(np.concatenate(rows) if rows else np.zeros(0, np.int32), np.concatenate(([0], ends)).astype(np.int64))

    def __len__(self) -> int:
        return len(self.starts) - 1

    def margins(self, weights: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self))
        for at in range(0, len(self), 50_000):  # a piece at a time, to stay small
            starts = self.starts[at : at + 50_001]
            out[at : at + 50_000] = np.add.reduceat(weights[self.flat[starts[0] : starts[-1]]], starts[:-1] - starts[0])
        return out

    def pick(self, which: np.ndarray) -> Rows:
        ends = np.concatenate(([0], np.cumsum(self.starts[which + 1] - self.starts[which]))).astype(np.int64)
        at = np.repeat(self.starts[which] - ends[:-1], np.diff(ends)) + np.arange(ends[-1])
        return Rows(self.flat[at], ends)


#: Offsets of the words of a feature: n-grams and, with gaps, skip-grams.
_GRAMS = ((0,), (0, 1), (0, 1, 2), (0, 2), (0, 3))
_MIX, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@lru_cache(maxsize=500_000)
def _word_hash(word: str) -> int:
    return zlib.crc32(word.encode()) << 32 | zlib.adler32(word.encode())


def features(found: list[tuple[str, ...]], bits: int, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed features of passages, all at once: (passage, feature) pairs in
    order, only those ``wanted`` (a flag a feature) if given."""
    words = np.fromiter((_word_hash(w) for p in found for w in p), np.uint64)
    owner = np.repeat(np.arange(len(found)), [len(p) for p in found])
    pairs = []
    for salt, offsets in enumerate(_GRAMS):
        last = offsets[-1]
        n = len(words) - last
        if n <= 0:
            continue
        key = np.full(n, salt + 1, np.uint64)
        for o in offsets:
            key = (key ^ words[o : o + n]) * _MIX
            key ^= key >> np.uint64(31)
        key = (key * _MIX2) >> np.uint64(64 - bits)
        inside = owner[:n] == owner[last:]
        if wanted is not None:
            inside &= wanted[key]
        pairs.append((owner[:n][inside] << bits) | key[inside].astype(np.int64))
    pair = np.concatenate(pairs) if pairs else np.zeros(0, np.int64)
    pair.sort()
    pair = pair[np.append(True, pair[1:] != pair[:-1])] if len(pair) else pair
    return pair >> bits, pair & ((1 << bits) - 1)


def feature_rows(found: list[tuple[str, ...]], bits: int) -> list[np.ndarray]:
    owner, feature = features(found, bits)
    return np.split(feature.astype(np.int32), np.searchsorted(owner, np.arange(1, len(found))))


@dataclass
class Ftrl:
    """FTRL-proximal logistic regression on binary features."""

    bits: int = 20
    alpha: float = 0.2
    beta: float = 1.0
    l1: float = 1.0
    l2: float = 1.0
    z: np.ndarray = field(init=False)
    n: np.ndarray = field(init=False)
    bias_z: float = 0.0
    bias_n: float = 0.0

    def __post_init__(self) -> None:
        self.z, self.n = np.zeros(1 << self.bits), np.zeros(1 << self.bits)

    def weights(self, at: np.ndarray | None = None) -> np.ndarray:
        z, n = (self.z, self.n) if at is None else (self.z[at], self.n[at])
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    @property
    def bias(self) -> float:
        return -self.bias_z / ((self.beta + np.sqrt(self.bias_n)) / self.alpha)

    def learn(self, rows: Rows, labels: np.ndarray, importance: np.ndarray, epochs: int, seed: int, batch: int = 128) -> None:
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), batch):
                ids = order[at : at + batch]
                some = rows.pick(ids)
                uniq, inverse = np.unique(some.flat, return_inverse=True)
                w = self.weights(uniq)
                which = np.repeat(np.arange(len(ids)), np.diff(some.starts))
                margin = np.bincount(which, w[inverse], len(ids)) + self.bias
                p = 1 / (1 + np.exp(-np.clip(margin, -35, 35)))
                g = (p - labels[ids]) * importance[ids]
                grad = np.bincount(inverse, g[which], len(uniq))
                n = self.n[uniq]
                sigma = (np.sqrt(n + grad * grad) - np.sqrt(n)) / self.alpha
                self.z[uniq] += grad - sigma * w
                self.n[uniq] = n + grad * grad
                b, total = self.bias, g.sum()
                sigma_b = (np.sqrt(self.bias_n + total * total) - np.sqrt(self.bias_n)) / self.alpha
                self.bias_z += total - sigma_b * b
                self.bias_n += total * total


@dataclass
class AbuseModel:
    """Sparse weights: sorted feature numbers and their values, and a bias; from which
    score on a document is a case, and what was found of it on documents held out."""

    at: np.ndarray
    value: np.ndarray
    bias: float
    bits: int
    threshold: float = math.inf
    precision: float = 0.0
    recall: float = 0.0
    documents: int = 0
    cases: int = 0

    def dense(self) -> np.ndarray:
        w = np.zeros(1 << self.bits)
        w[self.at] = self.value
        return w


def cut(score: np.ndarray, y: np.ndarray, base_rate: float, caution: float = 1.0) -> tuple[float, float, float]:
    """(margin, precision, recall): the cut of best F0.5 among held-out scores, clean
    documents weighted so that cases are ``base_rate`` of all; infinite if precision,
    ``caution`` standard errors down (Wilson), is below one half."""
    cases, clean = int(y.sum()), int(len(y) - y.sum())
    weight = (1 - base_rate) / base_rate * cases / clean
    order = np.argsort(-score, kind="stable")
    right = np.cumsum(y[order])
    wrong = np.arange(1, len(y) + 1) - right
    finite = np.isfinite(score[order])
    last = np.append(score[order][1:] != score[order][:-1], True)  # of equal scores all or none
    f = np.where(last & finite, 1.25 * right / (0.25 * cases + right + weight * wrong), 0.0)
    at = int(f.argmax())
    n, share = at + 1, right[at] / (at + 1)
    z = caution * caution / n
    least = (share + z / 2 - caution * math.sqrt(share * (1 - share) / n + z / (4 * n))) / (1 + z)
    if least < weight * (1 - least):
        return math.inf, 0.0, 0.0
    return float(score[order][at]), float(right[at] / (right[at] + weight * wrong[at])), float(right[at] / cases)


def fit(
    texts: list[str | None], labels: list[int], bits: int = 20, rounds: int = 2, folds: int = 3, epochs: int = 3, positive_weight: float = 2.0,
    doubt: float = 0.98, base_rate: float = 0.03, seed: int = 5, **ftrl,
) -> AbuseModel | None:
    """A passage model from verdicts on documents; None without both verdicts.

    Which passage of a case is the case, and which verdicts to set aside, is
    always judged by models that did not see the document: first by how often its
    features occur in other cases, then by ``folds``-fold training.  A case whose
    worst passage ranks below the ``doubt`` quantile of clean documents is set
    aside, and so is a clean document that scores as a plain case.
    """
    y = np.array(labels, np.int64)
    if len(y) == 0 or y.min() == y.max():
        return None
    rows: list[np.ndarray] = []
    owner: list[int] = []
    for i, t in enumerate(texts):
        found = passages(t)
        if found:
            rows += feature_rows(found, bits)
            owner += [i] * len(found)
    own = np.array(owner, np.int64)
    case = y[own] == 1 if len(own) else np.zeros(0, bool)
    if not len(rows) or case.all() or not case.any():
        return None
    data = Rows.of(rows)
    rows.clear()

    def by_document(label: int) -> np.ndarray:
        """In how many documents of one verdict each feature occurs."""
        counts = np.zeros(1 << bits)
        ends = np.searchsorted(own, np.arange(len(y) + 1))
        for i in np.flatnonzero(y == label):
            counts[np.unique(data.flat[data.starts[ends[i]] : data.starts[ends[i + 1]]])] += 1
        return counts

    def top_of(score: np.ndarray) -> np.ndarray:
        top = np.full(len(y), -np.inf)
        np.maximum.at(top, own, score)
        return top

    def learn(positive: np.ndarray, negative: np.ndarray, turn: int) -> Ftrl:
        use = np.flatnonzero(positive | negative)
        model = Ftrl(bits=bits, **ftrl)
        target = positive[use].astype(np.float64)
        model.learn(data.pick(use), target, np.where(target > 0, positive_weight, 1.0), epochs, seed + turn)
        return model

    others = np.maximum(by_document(1) - 1, 0)  # without the document itself
    share = max(1, y.sum()) / max(1, len(y) - y.sum())
    evidence = np.log((others + 0.2) / (by_document(0) + 0.2) / share)
    score = data.margins(np.maximum(evidence, 0)) / np.diff(data.starts)
    part = np.random.default_rng(seed).permutation(len(y)) % folds
    keep = np.ones(len(y), bool)
    clean = np.zeros(len(own), bool)
    sure = np.zeros(len(own), bool)
    for turn in range(rounds):
        positive = case & keep[own] & ((score >= top_of(score)[own] - 1e-12) | sure)
        negative = (~case & keep[own]) | (clean & ~positive)
        unseen = np.zeros(len(own))
        for k in range(folds):
            rest = part[own] != k
            model = learn(positive & rest, negative & rest, turn)
            held = np.flatnonzero(~rest)
            unseen[held] = data.pick(held).margins(model.weights()) + model.bias
        score = unseen
        top = top_of(score)
        usual = np.quantile(top[(y == 0) & np.isfinite(top)], doubt)
        keep = ~(((y == 1) & (top < min(usual, 0.0))) | ((y == 0) & (top > 2.0)))
        clean, sure = case & (score < -2.0), case & (score > 1.0)
    positive = case & keep[own] & ((score >= top_of(score)[own] - 1e-12) | sure)
    model = learn(positive, (~case & keep[own]) | (clean & ~positive), rounds)
    w = model.weights()
    at = np.flatnonzero(w)
    margin, precision, recall = cut(top, y, base_rate)
    threshold = 1 / (1 + math.exp(-margin)) if math.isfinite(margin) else math.inf
    return AbuseModel(at, w[at], float(model.bias), bits, threshold, precision, recall, len(y), int(y.sum()))


class Scorer:
    """Scores texts with the weights laid out in an array, many passages at a time."""

    def __init__(self, model: AbuseModel, at_once: int = 4_000):
        self.model, self.weights, self.at_once = model, model.dense(), at_once
        self.wanted = self.weights != 0

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        """Of each text the probability that its worst passage is a case."""
        out = np.zeros(len(texts))
        found: list[tuple[str, ...]] = []
        owner: list[int] = []

        def flush() -> None:
            if found:
                at, feature = features(found, self.model.bits, self.wanted)
                margin = np.bincount(at, self.weights[feature], len(found)) + self.model.bias
                np.maximum.at(out, owner, 1 / (1 + np.exp(-np.clip(margin, -35, 35))))
                found.clear()
                owner.clear()

        for i, text in enumerate(texts):
            own = passages(text)
            found += own
            owner += [i] * len(own)
            if len(found) >= self.at_once:
                flush()
        flush()
        return out


def verdicts(labels: DataFrame) -> DataFrame:
    """(doc_id, label): the majority of the non-null verdicts, ties left out."""
    return (
        labels.where(F.col("abusive").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.sum(F.when(F.col("abusive") > 0, 1).otherwise(-1)).alias("lead"))
        .where("lead <> 0")
        .select("doc_id", (F.col("lead") > 0).cast("int").alias("label"))
    )


def train(documents: DataFrame, labels: DataFrame, max_documents: int = 20_000, max_chars: int = 100_000_000, **options) -> AbuseModel | None:
    """The model fitted on at most ``max_documents`` labelled documents, of at most
    ``max_chars`` characters together."""
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    judged = verdicts(labels).orderBy(*order).limit(max_documents)
    labelled = (
        documents.select("doc_id", "text").where(F.col("text").isNotNull())
        .join(F.broadcast(judged), "doc_id")  # at most max_documents rows
        .groupBy("doc_id", "label").agg(F.min("text").alias("text"))
        .withColumn("held", F.sum(F.length("text")).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
        .where(F.col("held") <= max_chars)
        .select("text", "label")
        .toPandas()
    )
    return fit(labelled["text"].tolist(), labelled["label"].tolist(), **options)


def abuse_score(text: Column, model: AbuseModel | None, spark) -> Column:
    """Probability that the worst passage of the text is a case."""
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = Scorer(shared.value) if shared.value is not None else lambda texts: np.zeros(len(texts))
        for texts in batches:
            yield pd.Series(score(texts.tolist()))

    return scored(text)


def is_case(model: AbuseModel | None) -> Column:
    """Whether a ``score`` makes a document a case; never without a threshold."""
    return F.col("score") >= (model.threshold if model else math.inf)


def source_rates(scored: DataFrame, source: Column, model: AbuseModel | None) -> DataFrame:
    """Per source: documents, cases, the rate of cases and the mean score."""
    return (
        scored.groupBy(source.alias("source"))
        .agg(F.count("*").alias("documents"), F.sum(is_case(model).cast("bigint")).alias("cases"), F.avg("score").alias("mean_score"))
        .withColumn("rate", F.col("cases") / F.col("documents"))
    )
