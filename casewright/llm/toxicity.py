"""Toxicity by non-negative positive-unlabelled learning (nnPU, Kiryo et al. 2017).

Training data: a bounded sample of confirmed toxic documents and a bounded sample of any
documents, taken as unlabelled. The risk is prior * E_P[l(f)] + max(0, E_U[l(-f)] - prior *
E_P[l(-f)]) with the logistic loss; when the second term is negative its gradient is turned
round. The class prior is the toxic share among labelled training rows.

Features of a text are its distinct words (runs of letters, lower case), the beginnings of
its longer words, and the beginnings shared by two different words or more - insults of a
language with rich endings. The vocabulary is the ``vocabulary`` features that separate the
two samples best, so the model that travels to the executors has a fixed size. Whole texts of
all documents are scored.

Only rows of ``labels`` with crc32(doc_id as text) mod 5 <> 0 are read for learning.

Defined cases: null and empty texts get the score of a text without features; documents
without id are scored but never train; repeated rows are scored each; no positive rows:
every score is 0; labels with null ids or values are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.llm._linear import Adam, Sparse, sigmoid
from casewright.llm._store import table, unused
from casewright.llm._words import strings_of

POSITIVE_DOCS = 1500
UNLABELLED_DOCS = 3000
VOCABULARY = 4096
ROUNDS = 300
#: A feature is looked at if it stands in so many toxic documents, and in such a share of them.
MIN_DOCS, MIN_SHARE = 4, 0.01
FOLDS = 5
_PREFIXES = range(4, 10)
_CACHE = 150_000
_LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> set[bytes]:
    return set(text.lower().encode("utf-8", "replace").translate(_LETTERS).split()) if text else set()


def word_features(word: bytes) -> list[str]:
    """The word's own feature and those of its proper beginnings."""
    w = word.decode("utf-8", "replace")
    return ["w" + w, *["p" + w[:k] for k in _PREFIXES if k < len(w)]]


def count_features(docs: list[tuple[bytes, ...]], least: float) -> Counter:
    """Features and the documents they stand in, if at least ``least``; one kind is counted at a time, so the rare ones never pile up."""
    words = Counter(w for doc in docs for w in doc)
    out = Counter({"w" + w.decode("utf-8", "replace"): n for w, n in words.items() if n >= least})
    shown = {w: w.decode("utf-8", "replace") for w in words}
    for k in _PREFIXES:
        single, double = Counter(), Counter()
        for doc in docs:
            seen = Counter(w[:k] for x in doc if len(w := shown[x]) > k)
            single.update(seen.keys())
            double.update(p for p, n in seen.items() if n > 1)
        out.update({"p" + p: n for p, n in single.items() if n >= least})
        out.update({"d" + p: n for p, n in double.items() if n >= least})
    return out


class _Known:
    """Finds the features of a fixed set in a document's words; a word is looked up once while it is remembered."""

    def __init__(self, features):
        self.features = frozenset(features)
        self.single = frozenset(f for f in self.features if f[0] != "d") | {"p" + f[1:] for f in self.features if f[0] == "d"}
        self.of_word: dict[bytes, tuple] = {}

    def __call__(self, words) -> list[str]:
        seen: dict[str, int] = {}
        for word in words:
            found = self.of_word.get(word)
            if found is None:
                if len(self.of_word) > _CACHE:
                    self.of_word.clear()
                found = self.of_word[word] = tuple(f for f in word_features(word) if f in self.single)
            for f in found:
                seen[f] = seen.get(f, 0) + 1
        out = [f for f in seen if f in self.features]
        return out + [d for f, n in seen.items() if n > 1 and f[0] == "p" and (d := "d" + f[1:]) in self.features]


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(False))


def _sample(docs: DataFrame, ids: DataFrame) -> list[tuple[bytes, ...]]:
    """The distinct words of the documents with the given (bounded) ids."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b" ".join(sorted(words_of(t))) for t in strings_of(batch.column(0))], pa.binary())], names=["words"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")
    kept: dict[bytes, bytes] = {}  # one object per distinct word
    return [tuple(kept.setdefault(w, w) for w in bytes(r["words"]).split()) for r in found.dropDuplicates(["doc_id"]).select("text").mapInArrow(run, "words binary").collect()]


def fit(docs: DataFrame, labels: DataFrame, positive_docs: int = POSITIVE_DOCS, unlabelled_docs: int = UNLABELLED_DOCS, vocabulary: int = VOCABULARY, rounds: int = ROUNDS) -> dict:
    """{"bias": b, feature: weight, ...}; empty without positive rows."""
    train = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    prior = train.agg(F.avg("toxic")).first()[0]
    order = F.xxhash64("doc_id", F.lit(7))
    some = lambda ids, n: ids.orderBy(order, "doc_id").limit(n)
    toxic = _sample(docs, some(train.where("toxic = 1").select("doc_id").distinct(), positive_docs))
    other = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    unlabelled = _sample(docs, some(other.distinct(), unlabelled_docs))
    if not toxic or not unlabelled:
        return {}
    return fit_nnpu(toxic, unlabelled, float(np.clip(prior, 0.01, 0.5)), vocabulary, rounds)


def fit_nnpu(toxic, unlabelled, prior: float, vocabulary: int = VOCABULARY, rounds: int = ROUNDS) -> dict:
    """Model from documents given as their distinct words."""
    toxic = sorted({tuple(sorted(words)) for words in toxic})  # copies say nothing new
    in_p = count_features(toxic, max(MIN_DOCS, MIN_SHARE * len(toxic)))
    known = _Known(in_p)
    in_u = Counter(f for words in unlabelled for f in known(words))
    p, u = len(toxic), len(unlabelled)
    apart = lambda f: (in_p[f] / p - in_u[f] / u) / np.sqrt((in_p[f] + in_u[f] + 1) / (p + u) / min(p, u))
    chosen = sorted(in_p, key=lambda f: (-abs(apart(f)), f))[:vocabulary]
    at = {f: i for i, f in enumerate(chosen)}
    n = len(at)
    known = _Known(at)

    def matrix(docs) -> Sparse:
        cols = [np.array(sorted(at[f] for f in known(words)) + [n], np.int64) for words in docs]
        return Sparse([(c, np.ones(len(c))) for c in cols], n + 1)

    xp, xu = matrix(toxic), matrix(unlabelled)
    w = np.zeros(n + 1)
    w[n] = np.log(prior / (1 - prior))
    adam = Adam(n + 1, 0.05)
    for _ in range(rounds):
        fp, fu = xp.dot(w), xu.dot(w)
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        g_negative = xu.back(sigmoid(fu) / u) - prior * xp.back(sigmoid(fp) / p)
        if negative < 0:
            g = -g_negative
        else:
            g = prior * xp.back(-sigmoid(-fp) / p) + g_negative
        decay = 2e-4 * w
        decay[n] = 0
        adam.step(w, g + decay)
    return {f: float(w[i]) for f, i in at.items() if abs(w[i]) > 1e-3} | {"bias": float(w[n])}


class _Scorer:
    """Scores texts by a model."""

    def __init__(self, model: dict):
        self.bias = model.get("bias")
        self.weight = {f: v for f, v in model.items() if f != "bias"}
        self.known = _Known(self.weight)

    def __call__(self, text: str | None) -> float:
        if self.bias is None:
            return 0.0
        total = self.bias
        for f in sorted(self.known(words_of(text))):
            total += self.weight[f]
        return float(sigmoid(np.float64(total)))


def score(docs: DataFrame, model: dict, name: str = "score") -> DataFrame:
    """``docs`` with a score column appended."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    at = names.index("text")

    def run(batches):
        scorer = _Scorer(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([scorer(t) for t in strings_of(batch.column(at))], pa.float64())], names=[*names, name])

    return docs.mapInArrow(run, docs.withColumn(name, F.lit(0.0)).schema)


def non_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` without those scored at ``threshold`` or more."""
    name = unused(docs.columns, "_toxicity")
    return score(docs, fit(docs, labels), name).where(F.col(name) < threshold).drop(name)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
