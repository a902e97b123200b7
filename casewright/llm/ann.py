"""Approximate nearest neighbours: multiprobe p-stable hashing with exact reranking.

Unit vectors are hashed by floor((a.x + b) / w) with Gaussian (2-stable) a, ``hashes`` of
them per table. For a query, a neighbour at distance d projects to a normal around the
query's own projection, which gives each perturbed bucket an estimated success
probability; the ``probes`` best buckets of each table are visited (they are found exactly,
dimension by dimension, because the probability is a product).

Equal vectors are one class that keeps its k + 1 smallest ids, so a vector repeated in a
third of all rows is one candidate. Classes are written once, in blocks of bounded size, with
their bucket of every table. A task takes a block of classes and a block of queries: it
merges the buckets that a query probes in all tables into one set of candidates, reranks
those exactly, once, and returns the k best; blocks are merged last. Blocks are dealt by
class, not by bucket, so a hot bucket meets no task whole.

``fit_index`` chooses hashes, width and probes for the table at hand. ``FIT_QUERIES`` vectors
are compared with all rows; of the settings that would find ``WANTED`` of their neighbours the
one is taken that visits the smallest share of ``FIT_ROWS`` sampled rows. The index holds
every row, whatever the sample. Recall against brute force is measured in the tests.

Defined cases: vectors that are null, zero or hold null or non-finite components take no
part, as rows or queries; vectors of another length than the query are no candidates;
ties go to the smaller vec_id; a query whose buckets hold fewer than k rows is compared with all
rows, so it gets k or all there are; rows of one vec_id
and vector are one candidate, with different vectors one each, and as a query one, the least
vector; rows without id are not indexed; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casewright.llm._store import materialize, table
from casewright.llm._vectors import doubles, matrix, named, takes_part

BLOCK_ROWS, BLOCK_QUERIES = 8192, 256
#: Share of the fitted queries' neighbours that a setting has to find.
WANTED = 0.97
#: Bounds of the fit: queries compared with all rows, and rows on which the visited share is estimated.
FIT_QUERIES, FIT_ROWS = 96, 4096
FIT_PROBES = (16, 64)
TABLES = 12
_SPAN, _BASE = 3, 64


@dataclass(frozen=True)
class Setting:
    tables: int = TABLES
    hashes: int = 8
    width: float = 2.5
    probes: int = 128
    #: Distance of the neighbours looked for, between unit vectors.
    near: float = 1.1


def _functions(dim: int, table_no: int, hashes: int, width: float) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([20_240_101, dim, table_no])
    return rng.standard_normal((dim, hashes)), rng.uniform(0, width, hashes)


def _positions(x: np.ndarray, table_no: int, hashes: int, width: float) -> np.ndarray:
    a, b = _functions(x.shape[1], table_no, hashes, width)
    return (x @ a + b) / width


def _code(parts: np.ndarray) -> np.ndarray:
    code = np.zeros(len(parts), np.int64)
    for m in range(parts.shape[1]):
        code = code * _BASE + np.clip(parts[:, m] + _BASE // 2, 0, _BASE - 1)
    return code


def _normal_cdf(z: np.ndarray) -> np.ndarray:
    """Logistic-type approximation of the normal distribution function (error below 2e-4)."""
    return 1.0 / (1.0 + np.exp(-1.5976 * z - 0.07056 * z**3))


def probe_codes(positions: np.ndarray, probes: int, width: float, near: float) -> np.ndarray:
    """Codes of the most likely buckets of each row of ``positions``, best first."""
    code, log_p = np.zeros((len(positions), 1), np.int64), np.zeros((len(positions), 1))
    home, spread = np.floor(positions).astype(np.int64), near / width
    for m in range(positions.shape[1]):
        cell = home[:, m, None] + np.arange(-_SPAN, _SPAN + 1)
        at = positions[:, m, None]
        p = np.log(np.maximum(_normal_cdf((cell + 1 - at) / spread) - _normal_cdf((cell - at) / spread), 1e-300))
        code = (code[:, :, None] * _BASE + np.clip(cell + _BASE // 2, 0, _BASE - 1)[:, None, :]).reshape(len(code), -1)
        log_p = (log_p[:, :, None] + p[:, None, :]).reshape(len(code), -1)
        keep = np.argsort(-log_p, axis=1, kind="stable")[:, :probes]
        code, log_p = np.take_along_axis(code, keep, 1), np.take_along_axis(log_p, keep, 1)
    return code


def row_codes(x: np.ndarray, s: Setting) -> np.ndarray:
    """Bucket of every row of ``x`` in every table, as 32 mixed bits (a chance meeting only adds a candidate)."""
    return np.column_stack([_mixed(_code(np.floor(_positions(x, t, s.hashes, s.width)).astype(np.int64))) for t in range(s.tables)])


def query_codes(x: np.ndarray, s: Setting) -> np.ndarray:
    """Buckets that every row of ``x`` visits: (rows, tables, probes)."""
    return np.stack([_mixed(probe_codes(_positions(x, t, s.hashes, s.width), s.probes, s.width, s.near)) for t in range(s.tables)], axis=1)


def _mixed(code: np.ndarray) -> np.ndarray:
    return ((code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def candidates(rows: np.ndarray, probes: np.ndarray) -> np.ndarray:
    """(queries, rows): whether the query visits the row's bucket in any table."""
    met = np.zeros((len(probes), len(rows)), bool)
    for t in range(rows.shape[1]):
        codes, which = np.unique(rows[:, t], return_inverse=True)
        at = np.minimum(np.searchsorted(codes, probes[:, t]), len(codes) - 1)
        seen = np.zeros((len(probes), len(codes)), bool)
        query, probe = np.nonzero(codes[at] == probes[:, t])
        seen[query, at[query, probe]] = True
        met |= seen[:, which]
    return met


def _closest(good: DataFrame, queries: list, k: int) -> dict[int, list[bytes]]:
    """The k nearest vectors of each of a few queries (vec_id, dim, raw), compared with all rows."""
    units = {d: (np.array([q.vec_id for q in queries if q.dim == d]), matrix([bytes(q.raw) for q in queries if q.dim == d])) for d in {q.dim for q in queries}}

    def run(batches):
        for batch in batches:
            dims, ids = batch.column("dim").to_numpy(), batch.column("vec_id").to_numpy()
            for d in set(np.unique(dims).tolist()) & set(units):
                at = np.flatnonzero(dims == d)
                raws = batch.column("raw").take(pa.array(at)).to_pylist()
                score = units[d][1] @ matrix(raws).T
                score[units[d][0][:, None] == ids[at][None, :]] = -2.0
                best = np.argpartition(-score, min(k, len(at)) - 1, axis=1)[:, :k]
                out = [(int(q), float(score[i, j]), raws[j]) for i, q in enumerate(units[d][0]) for j in best[i].tolist() if score[i, j] > -2]
                yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], kind) for c, kind in enumerate((pa.int64(), pa.float64(), pa.binary()))], names=["query_id", "score", "raw"])

    found = good.select("vec_id", "dim", "raw").mapInArrow(run, "query_id long, score double, raw binary")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "raw"))
    out: dict[int, list[bytes]] = {}
    for r in found.withColumn("rank", place).where(F.col("rank") <= k).collect():
        out.setdefault(r.query_id, []).append(bytes(r.raw))
    return out


def fit_index(good: DataFrame, k: int, wanted: float = WANTED) -> Setting:
    """The setting that finds the wanted share of some queries' true neighbours at the smallest share of rows visited."""
    by_hash = lambda seed, n: good.select("vec_id", "dim", "raw").orderBy(F.xxhash64(F.lit(seed), "vec_id", "name")).limit(n).collect()
    rows, queries = by_hash(1, FIT_ROWS), by_hash(2, FIT_QUERIES)
    if not queries:
        return Setting()
    dim = max({q.dim for q in queries}, key=lambda d: sum(q.dim == d for q in queries))
    queries, rows = [q for q in queries if q.dim == dim], [r for r in rows if r.dim == dim]
    closest = _closest(good, queries, k)
    pairs = [(i, raw) for i, q in enumerate(queries) for raw in closest.get(q.vec_id, [])]
    if not pairs or not rows:
        return Setting()
    x, y, z = matrix([bytes(q.raw) for q in queries]), matrix([raw for _, raw in pairs]), matrix([bytes(r.raw) for r in rows])
    mine = np.array([i for i, _ in pairs])
    near = max(float(np.quantile(np.linalg.norm(x[mine] - y, axis=1), 0.9)), 0.05)
    best, most = None, None
    for hashes in (16, 14, 12, 10, 8, 6, 4, 2):
        s = Setting(TABLES, hashes, 2.2 * near, max(FIT_PROBES), near)
        asked, found, sampled = query_codes(x, s), row_codes(y, s), row_codes(z, s)
        for probes in FIT_PROBES:  # the best buckets come first
            met = candidates(found, asked[:, :, :probes])[mine, np.arange(len(mine))].mean()
            visited = candidates(sampled, asked[:, :, :probes]).mean()
            s = replace(s, probes=probes)
            most = max(most or (met, -visited, s), (met, -visited, s), key=lambda e: e[:2])
            if met >= wanted and (best is None or visited < best[0]):
                best = (visited, s)
    return best[1] if best else most[2]


ROWS_KIND = "dim int, block int, units binary, codes binary, ids binary, counts binary"


def nearest(vectors: DataFrame, is_query, k: int = 5, setting: Setting | None = None, hashes: int | None = None, probes: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for the rows where ``is_query`` holds, never the query's own row.

    The setting is fitted unless it, or its number of hashes or probes, is given.
    """
    given = {n: v for n, v in (("hashes", hashes), ("probes", probes)) if v is not None}
    if given:
        setting = replace(setting or Setting(), **given)
    chosen = doubles(vectors).where(takes_part() & F.col("vec_id").isNotNull())
    good = materialize(named(chosen), "vectors")
    s = setting or fit_index(good, k)
    # A class keeps as many ids as an answer can hold, and one more in case the query is one of them.
    place = F.row_number().over(Window.partitionBy("name").orderBy("vec_id"))
    few = good.select("name", "vec_id").distinct().withColumn("_place", place).where(F.col("_place") <= k + 1).groupBy("name").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    classes = materialize(good.groupBy("name").agg(F.first("dim").alias("dim"), F.first("raw").alias("raw")).join(few, "name"), "classes")
    blocks = max(1, math.ceil(classes.count() / block_rows))

    def index(key, t):
        raws, ids = t["raw"].to_pylist(), t["ids"].to_pylist()
        order = sorted(range(len(raws)), key=lambda i: ids[i])
        x = matrix([raws[i] for i in order])
        counts = np.array([len(ids[i]) for i in order], np.int64)
        flat = np.array([v for i in order for v in ids[i]], np.int64)
        cols = [pa.array([v.as_py()], pa.int32()) for v in key] + [pa.array([a.tobytes()], pa.binary()) for a in (x, row_codes(x, s), flat, counts)]
        return pa.table(cols, names=["dim", "block", "units", "codes", "ids", "counts"])

    rows = classes.withColumn("block", F.pmod(F.xxhash64("name"), F.lit(blocks)).cast("int")).select("dim", "block", "raw", "ids")
    rows = materialize(rows.groupBy("dim", "block").applyInArrow(index, ROWS_KIND), "index")
    asked = good.join(vectors.where(is_query).select(F.col("vec_id").cast("long").alias("vec_id")).distinct(), "vec_id", "left_semi")
    asked = materialize(asked.groupBy("vec_id").agg(F.min(F.struct("dim", "raw")).alias("v")).select("vec_id", "v.dim", "v.raw"), "queries")

    def rerank(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                row = {n: batch.column(n)[at].as_py() for n in batch.schema.names}
                dim = row["dim"]
                x = np.frombuffer(row["units"], np.float64).reshape(-1, dim)
                counts, ids = np.frombuffer(row["counts"], np.int64), np.frombuffer(row["ids"], np.int64)
                start = np.cumsum(counts) - counts
                queries = np.frombuffer(row["q_ids"], np.int64)
                asked_ = np.frombuffer(row["q_units"], np.float64).reshape(-1, dim)
                met = None
                if row["q_codes"] is not None:
                    met = candidates(np.frombuffer(row["codes"], np.uint32).reshape(len(x), -1), np.frombuffer(row["q_codes"], np.uint32).reshape(len(queries), s.tables, -1))
                out: list[list[np.ndarray]] = [[], [], []]
                lone = np.where(counts == 1, ids[start], -1) if len(ids) else ids
                for i, query in enumerate(queries.tolist()):
                    c = np.flatnonzero((lone != query) | (counts > 1) if met is None else met[i] & ((lone != query) | (counts > 1)))
                    if not len(c):
                        continue
                    score = x[c] @ asked_[i]
                    if len(c) > k:  # each holds another row than the query's; whatever ties with the last stays in
                        high = np.flatnonzero(score >= np.partition(score, -k)[-k])
                        c, score = c[high], score[high]
                    places = np.concatenate([np.arange(start[j], start[j] + counts[j]) for j in c.tolist()])
                    score, found = np.repeat(score, counts[c]), ids[places]
                    other = found != query
                    score, found = score[other], found[other]
                    best = np.lexsort((found, -score))[:k]
                    for column, value in zip(out, (np.full(len(best), query, np.int64), found[best], score[best])):
                        column.append(value)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], names=["query_id", "vec_id", "score"])

    def best_of(asked: DataFrame, everything: bool) -> DataFrame:
        n = max(1, math.ceil(asked.count() / BLOCK_QUERIES))

        def pack(key, t):
            x = matrix(t["raw"].to_pylist())
            codes = None if everything else query_codes(x, s).tobytes()
            cols = [pa.array([v.as_py()], pa.int32()) for v in key] + [pa.array([a], pa.binary()) for a in (t["vec_id"].to_numpy().astype(np.int64).tobytes(), x.tobytes(), codes)]
            return pa.table(cols, names=["dim", "part", "q_ids", "q_units", "q_codes"])

        parts = asked.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")).select("dim", "part", "vec_id", "raw")
        parts = parts.groupBy("dim", "part").applyInArrow(pack, "dim int, part int, q_ids binary, q_units binary, q_codes binary")
        everywhere = parts.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        tops = everywhere.join(rows.hint("shuffle_hash"), ["dim", "block"]).mapInArrow(rerank, "query_id long, vec_id long, score double")
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return tops.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    found = materialize(best_of(asked, False), "nearest")
    others = good.select("vec_id").distinct().limit(k + 1).count() - 1
    enough = found.groupBy("query_id").count().where(F.col("count") >= min(k, others)).select(F.col("query_id").alias("vec_id"))
    short = materialize(asked.join(enough, "vec_id", "left_anti"), "short")
    if short.isEmpty():
        return found
    exact = best_of(short, True)
    return found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").select(*exact.columns).unionByName(exact)


def op6_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
