"""Quality classifier from weak labels: EM over labellers' votes, then a hashed linear scorer.

Each heuristic labeller votes good, bad or abstains on a whole text. The counts of vote
patterns (at most 3 ** labellers) over all documents are everything expectation-maximisation
needs to estimate each labeller's accuracy in both classes and the class prior, so EM is exact
over the corpus and small. Patterns' posteriors are the soft targets of a linear model over
hashed word shapes and text statistics, fitted on a bounded sample and applied to every text.

Defined cases: null and empty texts have no votes and no words; they get score 0 and are not
kept; documents without id are scored but not sampled; repeated rows are scored each; an empty
table gives no rows; a corpus without votes keeps everything that has words.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.llm._linear import Adam, Sparse, sigmoid
from casewright.llm._store import table, unused
from casewright.llm._words import mix, strings_of

SAMPLE_DOCS = 6000
BITS = 14
ROUNDS = 200
GOOD, BAD, NONE = 1, 0, 2
#: Labellers that vote bad above a bound of their statistic, with the bound below which the
#: statistic is unremarkable. One more labeller votes good when every statistic is unremarkable.
LIMITS = (
    ("symbols", 0.06, 0.02),
    ("uppercase", 0.5, 0.2),
    ("same_word", 0.1, 0.03),
    ("repeated_5grams", 0.3, 0.1),
    ("repeated_lines", 0.4, 0.2),
    ("bare_symbols", 0.1, 0.03),
    ("not_letters", 0.25, 0.12),
    ("top_word", 0.3, 0.2),
)
LABELLERS = (*(name for name, _, _ in LIMITS), "unremarkable")
_CACHE = 150_000
_DIGITS = str.maketrans("12345678", "99999999")
_SYMBOLS = frozenset("#$%&*|!~^<>{}[]\\=+@_")
#: Marks the packed facts of a word over 255 characters.
_LONG = 1 << 48
_NOT_LETTER = re.compile(r"[\W\d_]")


def _case(run: str) -> str:
    """x, X or Xx for a run of letters in lower, upper or title case, xX for others."""
    return "x" if run.islower() else "X" if run.isupper() else "Xx" if run.istitle() else "xX"


def _word_info(word: str) -> tuple[int, tuple[int, ...] | None]:
    """Packed facts of a word: hashed shape, length, letters, capitals, symbols (each up to 255); and by how much the four exceed that, if the word is longer.

    The shape of a word is the case of its letters and every other character in it, digits alike.
    """
    if word.isalpha():
        others, letters = "", len(word)
    else:
        others = "".join(_NOT_LETTER.findall(word))
        letters = len(word) - len(others)
    capitals = 0 if word.islower() else sum(map(str.isupper, word))
    symbols = sum(c in _SYMBOLS for c in others)
    shape = (_case(word) if letters else "") + others.translate(_DIGITS)
    cap = lambda v: min(v, 255)
    packed = (zlib.crc32(shape.encode("utf-8", "replace")) & ((1 << BITS) - 1)) | cap(len(word)) << 16 | cap(letters) << 24 | cap(capitals) << 32 | cap(symbols) << 40
    if len(word) <= 255:
        return packed, None
    return packed | _LONG, tuple(v - cap(v) for v in (len(word), letters, capitals, symbols))


class _Info(dict):
    """word -> its row in ``facts``, and in ``excess`` if it is long; forgets all at the start of a text once it holds ``_CACHE`` words."""

    def __init__(self):
        self.facts = np.empty(1 << 16, np.int64)
        self.excess: dict[int, tuple[int, ...]] = {}

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self)
        if at >= len(self.facts):
            self.facts = np.concatenate([self.facts, np.empty_like(self.facts)])
        self.facts[at], excess = _word_info(word)
        if excess:
            self.excess[at] = excess
        return at

    def clear(self) -> None:
        super().clear()
        self.excess.clear()


def describe(text: str | None, info: _Info) -> tuple[dict, np.ndarray] | None:
    """Statistics by labeller and the words' shape codes; None without words."""
    words = text.split() if text else []
    n = len(words)
    if not n:
        return None
    if len(info) > _CACHE:
        info.clear()
    ids = np.fromiter(map(info.__getitem__, words), np.int64, n)
    facts = info.facts[ids]
    used, counts = np.unique(ids, return_counts=True)
    of = info.facts[used]
    totals = [int((of >> at & 255) @ counts) for at in (16, 24, 32, 40)]
    if info.excess:
        for i in np.flatnonzero(of & _LONG).tolist():
            totals = [t + int(counts[i]) * more for t, more in zip(totals, info.excess[int(used[i])])]
    chars, letters, capitals, symbols = totals
    stats = {
        "symbols": symbols / chars,
        "uppercase": capitals / letters if letters else 0.0,
        "same_word": float((ids[1:] == ids[:-1]).mean()) if n >= 20 else None,
        "bare_symbols": float((of >> 24 & 255 == 0) @ counts) / n if n >= 10 else None,
        "not_letters": 1 - letters / chars if n >= 30 else None,
        "top_word": counts.max() / n if n >= 20 else None,
        "repeated_5grams": None,
        "repeated_lines": None,
    }
    if n >= 30:
        h = ids.astype(np.uint64)
        with np.errstate(over="ignore"):
            g = mix(h[:-4] * np.uint64(31) + h[1:-3] * np.uint64(961) + h[2:-2] * np.uint64(29791) + h[3:-1] * np.uint64(923521) + h[4:] * np.uint64(28629151))
        stats["repeated_5grams"] = 1 - len(np.unique(g)) / len(g)
    lines = [x for x in text.split("\n") if x]
    if len(lines) >= 4:
        stats["repeated_lines"] = 1 - len(set(lines)) / len(lines)
    return stats, facts & ((1 << BITS) - 1)


def votes(stats: dict) -> list[int]:
    bad = [BAD if stats[name] is not None and stats[name] > limit else NONE for name, limit, _ in LIMITS]
    calm = all(stats[name] is None or stats[name] <= low for name, _, low in LIMITS)
    return [*bad, GOOD if calm else NONE]


def pattern(found: list[int]) -> int:
    code = 0
    for v in found:
        code = code * 3 + v
    return code


def unpack(code: int) -> list[int]:
    return [code // 3**i % 3 for i in range(len(LABELLERS) - 1, -1, -1)]


def expectation_maximisation(patterns: dict[int, int], rounds: int = 200) -> tuple[float, np.ndarray, dict[int, float]]:
    """(prior of good, chances [labeller, class, vote], posterior of good per pattern) from counts of vote patterns.

    Labellers are independent within a class. Not voting is an outcome like the others, so a
    labeller that only ever votes one way is judged by how often it does in either class.
    """
    codes = sorted(patterns)
    count = np.array([patterns[c] for c in codes], float)
    v = np.array([unpack(c) for c in codes]).reshape(len(codes), len(LABELLERS))
    is_vote = np.stack([v == k for k in (BAD, GOOD, NONE)], axis=-1).astype(float)
    prior = 0.85
    chance = np.tile([[[0.3, 0.05, 0.65], [0.02, 0.6, 0.38]]], (len(LABELLERS), 1, 1))
    for _ in range(rounds):
        log_p = np.einsum("nlk,lck->nc", is_vote, np.log(chance)) + np.log([1 - prior, prior])
        p = sigmoid(log_p[:, 1] - log_p[:, 0])
        share = np.stack([count * (1 - p), count * p], axis=1)
        prior = float(np.clip((share[:, 1].sum() + 1) / (count.sum() + 2), 0.02, 0.98))
        chance = np.einsum("nc,nlk->lck", share, is_vote) + 0.1
        chance /= chance.sum(axis=2, keepdims=True)
    return prior, chance, dict(zip(codes, p.tolist()))


def hashed_row(stats: dict, shapes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns and values: share of each word shape, one indicator per statistic's bin, a constant."""
    cols, counts = np.unique(shapes, return_counts=True)
    bins = [(i * 32 + min(31, int(stats[name] * 40))) if stats[name] is not None else i * 32 + 31 for i, (name, _, _) in enumerate(LIMITS)]
    extra = (1 << BITS) + np.array([*bins, 32 * len(LIMITS)])
    return np.concatenate([cols, extra]), np.concatenate([4.0 * counts / counts.sum(), np.ones(len(extra))])


WIDTH = (1 << BITS) + 32 * len(LIMITS) + 1


def count_patterns(docs: DataFrame) -> dict[int, int]:
    """Vote patterns of all documents, counted; at most 3 ** labellers rows come back."""

    def run(batches):
        info, total = _Info(), np.zeros(3 ** len(LABELLERS), np.int64)
        for batch in batches:
            for text in strings_of(batch.column(0)):
                if (found := describe(text, info)) is not None:
                    total[pattern(votes(found[0]))] += 1
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int64)), pa.array(total[used])], names=["pattern", "rows"])

    rows = docs.select(F.col("text").cast("string")).mapInArrow(run, "pattern long, rows long")
    return {r[0]: r[1] for r in rows.groupBy("pattern").agg(F.sum("rows")).collect()}


def _sample(docs: DataFrame, size: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    def run(batches):
        info = _Info()
        for batch in batches:
            found = [x for t in strings_of(batch.column(0)) if (x := describe(t, info)) is not None]
            rows = [hashed_row(*x) for x in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array([pattern(votes(x[0])) for x in found], pa.int64()), pa.array([c.astype(np.int64).tobytes() for c, _ in rows], pa.binary()), pa.array([v.astype(np.float64).tobytes() for _, v in rows], pa.binary())],
                names=["pattern", "cols", "vals"],
            )

    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null")
    ids = ids.distinct().orderBy(F.xxhash64("doc_id", F.lit(8)), "doc_id").limit(size)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id"])
    got = found.select("text").mapInArrow(run, "pattern long, cols binary, vals binary").collect()
    return [(r[0], np.frombuffer(r[1], np.int64), np.frombuffer(r[2], np.float64)) for r in got]


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, rounds: int = ROUNDS) -> tuple[np.ndarray, dict[int, float]]:
    """(weights of the scorer, posterior per vote pattern)."""
    counts = count_patterns(docs)
    if not counts:
        return np.zeros(WIDTH), {}
    _, _, posterior = expectation_maximisation(counts)
    sample = sorted(_sample(docs, sample_docs), key=lambda r: (r[0], r[1].tobytes(), r[2].tobytes()))
    w = np.zeros(WIDTH)
    if not sample:
        return w, posterior
    x, y = Sparse([(c, v) for _, c, v in sample], WIDTH), np.array([posterior[p] for p, _, _ in sample])
    adam = Adam(WIDTH, 0.05)
    for _ in range(rounds):
        adam.step(w, x.back((sigmoid(x.dot(w)) - y) / len(y)) + 1e-5 * w)
    return w, posterior


def score(docs: DataFrame, model: tuple[np.ndarray, dict[int, float]], added: tuple[str, str] = ("posterior", "quality")) -> DataFrame:
    """``docs`` with posterior (of the votes; null without words) and quality (the scorer's) appended, under the names in ``added``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    at = names.index("text")

    def run(batches):
        info = _Info()
        w, posterior = shared.value
        for batch in batches:
            post, good = [], []
            for text in strings_of(batch.column(at)):
                found = describe(text, info)
                if found is None:
                    post.append(None)
                    good.append(0.0)
                    continue
                cols, vals = hashed_row(*found)
                post.append(posterior.get(pattern(votes(found[0]))))
                good.append(float(sigmoid(np.float64(w[cols] @ vals))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(post, pa.float64()), pa.array(good, pa.float64())], names=[*names, *added])

    return docs.mapInArrow(run, docs.withColumn(added[0], F.lit(None).cast("double")).withColumn(added[1], F.lit(0.0)).schema)


def good_documents(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` without those the scorer rejects."""
    names = docs.columns
    added = unused(names, "posterior"), unused(names, "quality")
    return score(docs, fit(docs), added).where(F.col(added[1]) >= threshold).select(*names)


def op8_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, fit(docs)).select(F.col("doc_id").cast("long").alias("doc_id"), "posterior", F.col("quality").alias("score"), (F.col("quality") >= 0.5).alias("keep"))
