"""Training-data operators against brute force, on small tables with hard cases."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from casewright.llm import ann, embedding_dedup, graph, jaccard_join, licenses, mixing, packing, quality, sharding, toxicity, warc
from tests.conftest import SF, rows_of

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, cid string, size string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark, rows):
    """Documents with extra columns whose names clash with internal ones."""
    return spark.createDataFrame([(i, t, "en", s, 0, "k", "c", "z") for i, t, s in rows], DOCS)


def hard_rows():
    rnd = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    base = [rnd.choice(words) for _ in range(120)]
    rows = [(0, " ".join(base), "a"), (1, " ".join(base), "a"), (2, " ".join(base[:60] + ["other"] + base[61:]), "b"), (3, " ".join(rnd.choice(words) for _ in range(120)), "b")]
    rows += [(4, None, "a"), (5, "", None), (6, "   \n", None), (7, "two words", "a"), (8, "Two  WORDS", "c"), (9, "one two three four five", "c"), (None, "one two three four five", "c"), (None, None, None)]
    rows += [(10, " ".join(rnd.choice(words) for _ in range(9000)), "a"), (11, " ".join(base), "a"), (11, " ".join(base), "a"), (12, "É café ÉÉ\x0bnaïve x", "d"), (13, "a" * 5000, "d")]
    return rows


@pytest.fixture(scope="module")
def hard(spark):
    return table(spark, hard_rows()).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


def union_find(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


# --- graph ---------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rnd = random.Random(seed)
    edges = [(rnd.randrange(80), rnd.randrange(80)) for _ in range(60)] + [(200 + i, 201 + i) for i in range(30)] + [(5, 5)]
    want = union_find({x for a, b in edges if a != b for x in (a, b)}, [e for e in edges if e[0] != e[1]])
    got = {r.id: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want


# --- 1 mixing ------------------------------------------------------------------------------


def test_mixing_against_its_sql(spark, duck):
    got = mixing.op1_source_mixing(spark, SF)
    want = duck.sql(mixing.ORACLE)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(want.columns, want.fetchall())


def test_mixing_in_small_buckets_is_the_same(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert sorted(map(tuple, mixing.mix(docs, bucket_rows=5).collect())) == sorted(map(tuple, mixing.mix(docs).collect()))


def test_mixing_hard_cases(hard, empty):
    rows = mixing.mix(hard).collect()
    assert len(rows) == len(hard_rows())
    sizes = {}
    for i, t, s in hard_rows():
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert {r.source: r.source_size for r in rows} == sizes
    targets = {r.source: r.target for r in rows}
    assert sum(targets.values()) == pytest.approx(sum(sizes.values()))
    assert all(targets[s] <= 3 * sizes[s] + 1e-6 for s in targets) and all(r.taken <= 3 * r["size"] for r in rows)
    assert mixing.mix(empty).count() == 0
    assert mixing.mixed_documents(empty).count() == 0
    assert mixing.mixed_documents(hard.where("doc_id < 11")).columns == hard.columns


def test_repeated_rows_are_drawn_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 40")
    docs = docs.unionByName(docs).unionByName(docs)
    want = {r.source: r.words for r in mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("words")).collect()}
    mixed = mixing.mixed_documents(docs).groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("words"))
    assert {r.source: r.words for r in mixed.collect()} == {s: w for s, w in want.items() if w}


def test_heavier_documents_are_drawn_more_often(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "plain words only").otherwise("### $$$ %%%").alias("text"), F.lit("a").alias("source"))
    other = docs.select("doc_id", "text", F.lit("b").alias("source"))
    got = mixing.mix(docs.unionByName(other)).where("source = 'a'").groupBy(F.col("doc_id") % 2).agg(F.avg("copies")).collect()
    assert dict(map(tuple, got))[0] > 1.2 * dict(map(tuple, got))[1]


# --- 2 licences ----------------------------------------------------------------------------


def brute_license(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    starts, labels = [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                starts.append(i)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_licenses_against_brute_force(spark, hard, empty):
    texts = ["Under the MIT License, under the mit license.", "cc-by-nc 4.0 / CC BY NC", "xunder the mit license", "Apache License, Version 2.0", "under the mit licenses", "é under\nthe\tMIT--license", "Licensed under the Apache License Version 2"]
    docs = table(spark, [(100 + i, t, "s") for i, t in enumerate(texts)]).unionByName(hard).unionByName(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars", F.lit("").alias("key"), F.lit("").alias("cid"), F.lit("").alias("size")))
    want = sorted((str(r.doc_id), *brute_license(r.text)) for r in docs.collect())
    got = sorted((str(r.doc_id), r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.license_scan(docs).collect())
    assert list(map(str, got)) == list(map(str, want))
    assert licenses.license_scan(empty).count() == 0


@pytest.mark.parametrize(
    "text, labels, obligation",
    [("MIT", {"mit"}, 1), ("MIT OR GPL-2.0-only", {"mit", "gpl"}, 1), ("MIT AND GPL-3.0", {"mit", "gpl"}, 3), ("GPL-2.0 WITH Classpath-exception-2.0", {"gpl"}, 2), ("(MIT OR GPL-2.0) AND MPL-2.0", {"mit", "gpl", "mpl"}, 2),
     ("MIT OR GPL-2.0 AND AGPL-3.0", {"mit", "gpl", "agpl"}, 1), ("CC-BY-NC-4.0", {"cc-by-nc"}, 4), ("MIT AND", {"mit"}, 1), ("(MIT", {"mit"}, 1), ("Unheard-1.0 OR MIT", {"mit"}, 1)],
)
def test_expressions(text, labels, obligation):
    assert licenses.evaluate(text) == (frozenset(labels), obligation)


@pytest.mark.parametrize("text", ["", "and or", "()", "Unheard-1.0", ") MIT"])
def test_expressions_without_a_known_name(text):
    assert licenses.evaluate(text) is None


def test_identifier_tag_is_read():
    got = licenses.scan(b"// SPDX-License-Identifier: (MIT OR Apache-2.0)\nrest of it")
    assert got[5] == "apache-2,mit" and got[6] == pytest.approx(0.98) and got[7] == 1


# --- 3 Jaccard join ------------------------------------------------------------------------


def brute_degrees(rows, k=5, percent=75):
    sets = []
    for _, t, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append({tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)})
    linked = lambda x, y: bool(x and y) and 100 * len(x & y) >= percent * len(x | y)
    return sorted((str(d), len(x), sum(linked(x, y) for j, y in enumerate(sets) if i != j)) for i, ((d, _, _), x) in enumerate(zip(rows, sets)))


def brute_jaccard(rows, k=5, percent=75):
    sets = []
    for _, t, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append({tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)})
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    part = union_find(range(len(rows)), links)
    least = {}
    for i, (d, _, _) in enumerate(rows):
        if d is not None:
            least[part[i]] = min(least.get(part[i], d), d)
    return sorted((str(d), len(sets[i]), str(least.get(part[i]) if sets[i] else d)) for i, (d, _, _) in enumerate(rows))


def near_copies(seed, groups=6, size=9):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(groups):
        base = [rnd.choice(words) for _ in range(rnd.choice((8, 30, 90)))]
        for _ in range(size):
            t = base.copy()
            for _ in range(rnd.randrange(5)):
                t[rnd.randrange(len(t))] = rnd.choice(words)
            rows.append((len(rows) * 3 + 1, " ".join(t), "s"))
    shared = [rnd.choice(words) for _ in range(60)]
    rows += [(1000 + i, " ".join(shared + [rnd.choice(words) for _ in range(5 + 3 * i)]), "s") for i in range(20)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("rows", [hard_rows(), near_copies(1), near_copies(2)])
def test_jaccard_against_brute_force(spark, rows):
    got = jaccard_join.jaccard_components(table(spark, rows)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted((str(r[0]), r[1], str(r[2])) for r in got) == brute_jaccard(rows)


@pytest.mark.parametrize("rows", [hard_rows(), near_copies(1), near_copies(3, groups=2, size=40)])
def test_every_jaccard_link_is_counted(spark, rows):
    got = jaccard_join.jaccard_degrees(table(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, r.links) for r in got) == brute_degrees(rows)


def shared_line(seed, docs=60):
    """Unlinked documents with one passage in common, some of them near copies of each other."""
    rnd = random.Random(seed)
    passage = [f"p{i}" for i in range(6)]
    rows = []
    for i in range(docs):
        words = [f"w{rnd.randrange(4000)}" for _ in range(rnd.choice((4, 5, 9, 18, 40)))]
        rows.append((i, " ".join(passage + words), "s"))
        if i % 5 == 0:
            rows.append((1000 + i, " ".join(passage + words[:-1] + ["end"]), "s"))
    return rows


@pytest.mark.parametrize("rows", [shared_line(1), shared_line(2), near_copies(4, groups=2, size=30)])
def test_frequent_shingles_are_compared_in_blocks(spark, rows, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 3)
    monkeypatch.setattr(jaccard_join, "CHUNK_ROWS", 40)
    test_jaccard_against_brute_force(spark, rows)
    test_every_jaccard_link_is_counted(spark, rows)


def test_chunks_lose_no_row():
    rng = np.random.default_rng(4)
    h, cid, place = rng.integers(0, 30, 500), rng.integers(0, 80, 500), rng.integers(0, 9, 500)
    columns = [c.to_pylist() for c in jaccard_join.combine(h, cid, place, 7)]
    assert sorted(zip(columns[0], columns[2], columns[3])) == sorted(zip(h.tolist(), cid.tolist(), place.tolist()))
    for x in set(h.tolist()):
        own = sorted((p, c) for g, c, p in zip(h.tolist(), cid.tolist(), place.tolist()) if g == x)
        mine = [(salt, c, p, lead) for g, salt, c, p, lead in zip(*columns) if g == x]
        assert [(p, c) for salt, c, p, _ in mine if salt == 0] == [own[0]] and {salt for salt, *_ in mine} <= {0, 7}
        assert {None if lead is None else (lead["place"], lead["cid"]) for *_, lead in mine} == {own[0] if len({c for _, c in own}) > 1 else None}


def test_no_jaccard_links_in_nothing(empty):
    assert jaccard_join.jaccard_degrees(empty).count() == 0


def test_jaccard_of_nothing_and_keepers(spark, hard, empty):
    assert jaccard_join.jaccard_components(empty).count() == 0
    kept = jaccard_join.one_of_each(hard)
    assert kept.columns == hard.columns
    ids = sorted(str(r.doc_id) for r in kept.collect())
    assert ids == sorted(map(str, [0, 3, 4, 5, 6, 7, 9, None, 10, 12, 13]))


def test_histogram_never_bounds_too_low():
    rnd = np.random.default_rng(1)
    for n, m, common in ((50, 60, 40), (500, 400, 100), (7, 9, 7), (3000, 10, 5)):
        both = np.unique(rnd.integers(0, 2**63, n + m, dtype=np.uint64) * 2 + 1)
        x, y = np.sort(both[:n]), np.sort(np.concatenate([both[:common], both[n:]])[:m])
        inter = len(np.intersect1d(x, y))
        assert jaccard_join.histogram_bound(jaccard_join.histogram(x), jaccard_join.histogram(y), len(x), len(y)) >= inter


# --- 4 and 6 vectors -----------------------------------------------------------------------


def hard_vectors(spark, n=300, dim=16):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((n, dim))
    for i in range(0, 60):
        x[i] = x[60 + i % 6] + rng.standard_normal(dim) * 0.15
    rows = [(i, [float(v) for v in r], 0, "k") for i, r in enumerate(x)]
    rows += [(n, rows[5][1], 1, "k"), (n + 1, None, 1, "k"), (n + 2, [0.0] * dim, 1, "k"), (n + 3, [float("nan")] + [1.0] * (dim - 1), 1, "k"), (n + 4, [None] + [1.0] * (dim - 1), 1, "k"), (n + 5, [1e30] * dim, 1, "k"), (n + 6, [1.0, 2.0], 1, "k")]
    rows += [(7, rows[7][1], 0, "k")]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, cid string")


def unit_of(v):
    if v is None or any(c is None or not np.isfinite(c) for c in v) or not any(v):
        return None
    v = np.array(v) / max(abs(c) for c in v)
    return v / np.linalg.norm(v)


def test_near_duplicate_vectors_against_brute_force(spark):
    rows, df = hard_vectors(spark)
    units = [unit_of(r[1]) for r in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and units[i] @ units[j] >= 0.9]
    part = union_find(range(len(rows)), links)
    least = {p: min(rows[i][0] for i in range(len(rows)) if part[i] == p) for p in set(part.values())}
    degree = [sum(i in e for e in links) for i in range(len(rows))]
    want = sorted((rows[i][0], degree[i], least[part[i]], rows[i][0] == least[part[i]]) for i in range(len(rows)))
    assert sorted(map(tuple, embedding_dedup.near_duplicates(df, block=64).collect())) == want
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_tile_bounds_lose_nothing():
    rng = np.random.default_rng(9)
    x = rng.standard_normal((200, 32))
    x[100:] = x[:100] + rng.standard_normal((100, 32)) * 0.5
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    i, j = embedding_dedup.tile_links(x, x, 0.9)
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*(a.tolist() for a in np.nonzero(np.einsum("ik,jk->ij", x, x) >= 0.9))))


def test_nearest_recall_and_hard_cases(spark):
    rows, df = hard_vectors(spark)
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    units = {r[0]: unit_of(r[1]) for r in rows}
    hits = total = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, len(found) + 1)) and q not in [f[1] for f in found]
        want = sorted(((-(units[q] @ u), v) for v, u in units.items() if u is not None and v != q and len(u) == len(units[q])))[:5]
        hits += len({v for _, v in want} & {f[1] for f in found})
        total += len(want)
        assert all(abs(s - units[q] @ units[v]) < 1e-12 for _, v, s in found)
    assert hits / total >= 0.9 and n_queries(rows) == len(got)
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_few_vectors_are_all_found(spark):
    df = spark.createDataFrame([(i, [float(a), float(b), 1.0]) for i, (a, b) in enumerate([(9, 0), (-9, 1), (0, 9), (1, -9)])], "vec_id long, embedding array<double>")
    got = sorted(tuple(r)[:3] for r in ann.nearest(df, F.col("vec_id") < 2, hashes=6, probes=1).collect())
    assert [(q, rank) for q, rank, _ in got] == [(0, 1), (0, 2), (0, 3), (1, 1), (1, 2), (1, 3)]
    assert {v for q, _, v in got if q == 0} == {1, 2, 3}


def n_queries(rows):
    return len({r[0] for r in rows if r[0] % 20 == 0 and unit_of(r[1]) is not None})


def test_recall_on_the_provided_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    x = {r.vec_id: unit_of([float(v) for v in r.embedding]) for r in df.collect()}
    got = {}
    for r in ann.op6_nearest_neighbours(spark, "/root/testdata/sf0.01").collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = [len(got[q] & {v for _, v in sorted((-(x[q] @ u), v) for v, u in x.items() if v != q)[:5]}) for q in x if q % 50 == 0]
    assert sum(hit) / (5 * len(hit)) >= 0.9


# --- 5 sharding ----------------------------------------------------------------------------


def test_sharding_balances_and_keeps_copies_together(spark, hard, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sharding.karmarkar_karp(docs, 7, 16).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    load, where, slots = {}, {}, {}
    for r in rows:
        assert r["size"] == len(texts[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
        load[r.shard] = load.get(r.shard, 0) + r["size"]
        where.setdefault(texts[r.doc_id], set()).add(r.shard)
        slots.setdefault(r.shard, []).append(r.slot)
    assert max(map(len, where.values())) == 1
    assert max(load.values()) - min(load.values()) < 0.02 * sum(load.values()) / 7
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    found = sharding.karmarkar_karp(hard, 5).collect()
    assert len(found) == len(hard_rows()) and {(r["size"], r.text_crc32) for r in found if r.doc_id in (4, 5)} == {(16, 0)}
    assert sharding.karmarkar_karp(empty).count() == 0


def test_a_hot_group_is_spread(spark):
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 300, "same text").otherwise(F.concat(F.lit("text "), F.col("id") + 100)).alias("text"))
    load = [r[1] for r in sharding.karmarkar_karp(docs, 10).groupBy("shard").agg(F.sum("size")).collect()]
    assert len(load) == 10 and max(load) < 1.2 * min(load)


def test_differencing_places_every_slot_once():
    rng = np.random.default_rng(1)
    parts = rng.integers(0, 100, (20, 6))
    place = sharding.difference(parts)
    assert all(sorted(p) == list(range(6)) for p in place.tolist())
    loads = np.zeros(6, int)
    for p, v in zip(place, parts):
        loads[p] += v
    assert loads.max() - loads.min() <= 10


# --- 7 packing -----------------------------------------------------------------------------


def test_packing_round_trip(spark, hard, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    odd = table(spark, [(200 + i, t, "s") for i, t in enumerate(["a<|endoftext|>b", "x'S don't 'll", "a b c\x1cd\x85e", "é ́x", "ΑΣ ΑΣ. İ", "日本語 テキスト", "​zero", "12 3a4", "ÀÉ,ñ!?"])])
    docs = hard.unionByName(odd).unionByName(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars", F.lit("").alias("key"), F.lit("").alias("cid"), F.lit("").alias("size")))
    want = []
    for r in docs.collect():
        ids = np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(r.doc_id, i // 4096, i, len(ids[i : i + 4096]), zlib.crc32(ids[i : i + 4096].tobytes())) for i in range(0, len(ids), 4096)]
    got = packing.pack_documents(docs).collect()
    assert sorted(map(str, (tuple(r)[:5] for r in got))) == sorted(map(str, want))
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= -(-sum(w[3] for w in want) // 4096) + 1
    assert packing.pack_documents(empty).count() == 0


def test_local_search_empties_a_bin():
    lengths = np.array([5, 5, 4, 3, 3])  # 20 = two bins of 10: (5, 5) and (4, 3, 3)
    found = packing.local_search([[0, 2], [1, 3], [4]], lengths, 10)
    assert len(found) == 2 and sorted(i for b in found for i in b) == [0, 1, 2, 3, 4]
    assert all(sum(lengths[i] for i in b) <= 10 for b in found)


def test_local_search_leaves_no_exchange_unmade():
    capacity, lengths = 100, np.random.default_rng(1).integers(25, 50, 400)
    bins = packing.local_search(packing.best_fit(lengths, capacity), lengths, capacity)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    fill = [int(lengths[b].sum()) for b in bins]
    assert max(fill) <= capacity and sum(f < capacity for f in fill) > 64 and len(bins) > -(-sum(fill) // capacity)
    for d, donor in enumerate(bins):
        one = [int(lengths[i]) for i in donor]
        given = one + [x + y for n, x in enumerate(one) for y in one[:n]]
        for r, taker in enumerate(bins):
            if r != d and fill[d] < capacity and fill[r] < capacity:
                assert not any(x <= capacity - fill[r] and fill[r] + x > fill[d] for x in one)
                assert fill[r] < fill[d] or not any(0 < g - lengths[k] <= capacity - fill[r] for g in given for k in taker)


def test_best_fit_takes_the_tightest():
    assert sorted(map(sorted, packing.best_fit(np.array([6, 5, 4, 5]), 10))) == [[0, 2], [1, 3]]


# --- 8 quality -----------------------------------------------------------------------------


def test_quality_agrees_with_the_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = quality.op8_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    rate = {r.quality: r.k for r in got.groupBy("quality").agg(F.avg(F.col("keep").cast("int")).alias("k")).collect()}
    assert rate[1] > 0.98 and rate[0] < 0.1


def test_expectation_maximisation_recovers_accuracies():
    rng = np.random.default_rng(4)
    labels = len(quality.LABELLERS)
    truth = rng.random(20_000) < 0.8
    chance = np.linspace(0.3, 0.8, labels)
    counts = {}
    for good in truth:
        v = [quality.BAD if (not good and rng.random() < c) or (good and rng.random() < 0.01) else quality.NONE for c in chance[:-1]]
        v.append(quality.GOOD if good and rng.random() < 0.9 else quality.NONE)
        counts[quality.pattern(v)] = counts.get(quality.pattern(v), 0) + 1
    prior, found, _ = quality.expectation_maximisation(counts)
    assert abs(prior - 0.8) < 0.03 and np.abs(found[:-1, 0, quality.BAD] - chance[:-1]).max() < 0.06
    assert quality.unpack(quality.pattern([0, 1, 2, 0, 1, 2, 0, 1, 2])) == [0, 1, 2, 0, 1, 2, 0, 1, 2]


def test_quality_hard_cases(spark, hard, empty):
    got = quality.score(hard.select("doc_id", "text"), quality.fit(hard)).collect()
    assert len(got) == len(hard_rows()) and all(0 <= r.quality <= 1 for r in got)
    assert all(r.quality == 0 and r.posterior is None for r in got if not (r.text or "").split())
    assert quality.good_documents(hard).columns == hard.columns
    assert quality.good_documents(empty).count() == 0


# --- 9 revisits ----------------------------------------------------------------------------


def test_revisits_against_sql(spark, duck):
    got = warc.op9_revisit_resolution(spark, SF)
    want = duck.sql(warc.ORACLE)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(want.columns, want.fetchall())


RECORDS = "record_id long, url string, ts long, status int, headers map<string,string>, digest string, bucket string"


@pytest.mark.parametrize("bucket_rows", [1, 3, 1000])
def test_revisit_rules(spark, bucket_rows):
    full = lambda i, url, ts, **h: (i, url, ts, 200, {k.replace("_", "-"): v for k, v in h.items()}, f"d{i}", "x")
    again = lambda i, url, ts, **h: (i, url, ts, 304, {k.replace("_", "-"): v for k, v in h.items()}, None, "x")
    rows = [
        full(1, "http://www.A.com/p/?b=2&a=1&utm_source=z#top", 10, etag='"x"', date="10", content_length="5"), again(2, "https://a.com:443/p?a=1&b=2", 20, etag='W/"x"', date="20", content_length="0", expires="99"),
        full(3, "http://a.com/p?a=1&b=2", 30, etag='"y"'), again(4, "http://a.com/p?a=1&b=2", 31, etag='"x"'), again(5, "http://a.com/p?a=1&b=2", 30, etag='"x"'), again(6, "http://b.com/", 50, etag='"x"'),
        full(7, "http://c.com", 5, last_modified="m"), again(8, "http://c.com/", 6, last_modified="m"), again(9, "http://c.com/", 7), again(10, None, 7, etag="q"), again(11, "http://c.com", None), full(12, "http://c.com", 5, last_modified="n"),
    ]
    got = {r.record_id: (r.resolution, r.response_id) for r in warc.resolve_revisits(spark.createDataFrame(rows, RECORDS), bucket_rows).collect()}
    assert got == {
        2: ("resolved", 1), 4: ("validator_mismatch", None), 5: ("resolved", 1), 6: ("no_response", None), 8: ("validator_mismatch", None), 9: ("validator_mismatch", None), 10: ("no_key", None), 11: ("no_key", None),
    }
    merged = next(r.headers for r in warc.resolve_revisits(spark.createDataFrame(rows, RECORDS), bucket_rows).collect() if r.record_id == 2)
    assert merged == {"content-length": "5", "etag": 'W/"x"', "date": "20", "expires": "99"}
    assert warc.resolve_revisits(spark.createDataFrame([], RECORDS)).count() == 0


@pytest.mark.parametrize("bucket_rows", [1, 1000])
def test_revisits_by_usual_header_names_and_complete_responses(spark, bucket_rows):
    rows = [
        (1, "http://a.com", 10, 200, {"ETag": '"x"', "Content-Length": "5"}, "d1", "x"), (2, "http://a.com", 20, 304, {"Etag": 'W/"x"', "Date": "20"}, None, "x"),
        (3, "http://b.com", 10, 200, {"Last-Modified": "m"}, "d3", "x"), (4, "http://b.com", 20, 304, {"last-modified": "m"}, None, "x"),
        (5, "http://c.com", 10, 200, {"etag": '"y"'}, "d5", "x"), *[(10 + i, "http://c.com", 11 + i, status, {"etag": '"z"'}, "bad", "x") for i, status in enumerate((404, 500, 206, 301, 302, None))], (6, "http://c.com", 30, 304, {"etag": '"y"'}, None, "x"),
        (7, "http://d.com", 10, 404, {"etag": '"y"'}, "bad", "x"), (8, "http://d.com", 30, 304, {"etag": '"y"'}, None, "x"), (9, "http://a.com", 40, 304, None, None, "x"),
    ]
    found = {r.record_id: r for r in warc.resolve_revisits(spark.createDataFrame(rows, RECORDS), bucket_rows).collect()}
    assert {i: (r.resolution, r.response_id) for i, r in found.items()} == {2: ("resolved", 1), 4: ("resolved", 3), 6: ("resolved", 5), 8: ("no_response", None), 9: ("validator_mismatch", None)}
    assert found[2].headers == {"Content-Length": "5", "Etag": 'W/"x"', "Date": "20"}


def test_a_url_captured_densely_is_cut_by_captures_not_by_time(spark):
    rows = [(i, "http://hot.com", 1_000_000 + i // 2, 200 if i % 6 == 0 else 304, {"etag": f'"{i // 12}"'}, "d", "x") for i in range(600)]
    rows += [(1000 + i, f"http://u{i}.com", i * 40_000, 200 if i % 2 else 304, {"etag": '"x"'}, "d", "x") for i in range(100)]
    log = spark.createDataFrame(rows, RECORDS).repartition(4)
    found = lambda n: sorted((r.record_id, r.resolution, -1 if r.response_id is None else r.response_id) for r in warc.resolve_revisits(log, n).collect())
    fine = found(20)
    want = []
    for i, url, ts, status, tags, *_ in rows:
        if status == 304:
            last = max(((t, j, g) for j, u, t, s, g, *_ in rows if u == url and s == 200 and t < ts), key=lambda r: r[:2], default=None)
            good = last is not None and last[2] == tags
            want.append((i, "no_response" if last is None else "resolved" if good else "validator_mismatch", last[1] if good else -1))
    assert fine == found(10**6) == sorted(want) and {r[1] for r in fine} == {"no_response", "resolved", "validator_mismatch"}
    sizes = [r["count"] for r in warc.bucketed(log.withColumnRenamed("url", "curl").drop("bucket"), 20).groupBy("curl", "bucket").count().collect()]
    assert sum(sizes) == 700 and max(sizes) <= 80


# --- 10 toxicity ---------------------------------------------------------------------------


def test_toxicity_on_the_held_out_fold(spark):
    sf = "/root/testdata/sf0.1"
    got = toxicity.op10_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").select("toxic", "predicted").collect()
    toxic, clean = [r.predicted for r in got if r.toxic == 1], [r.predicted for r in got if r.toxic == 0]
    assert np.mean(toxic) > 0.85 and np.mean(clean) < 0.03


def test_the_negative_part_is_kept_from_going_below_zero():
    rnd = random.Random(1)
    word = lambda: f"v{rnd.randrange(50)}".encode()
    toxic = [{word() for _ in range(8)} | {b"insult"} for _ in range(60)]
    rest = [{word() for _ in range(8)} for _ in range(180)] + [{word() for _ in range(8)} | {b"insult"} for _ in range(20)]
    model = toxicity.fit_nnpu(toxic, rest, 0.1)
    score = toxicity._Scorer(model)
    assert score("v1 v2 insult") > 0.5 > score("v1 v2 v3")


def test_toxicity_hard_cases(spark, hard, empty):
    labels = spark.createDataFrame([(0, 1), (1, 1), (2, 1), (3, 0), (None, 1), (7, None)], "doc_id long, toxic int")
    for docs, found in ((hard, labels), (hard, labels.limit(0)), (empty, labels)):
        rows = toxicity.score(docs.select("doc_id", "text"), toxicity.fit(docs, found)).collect()
        assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.non_toxic(hard, labels).columns == hard.columns


RESERVED = ("posterior", "Quality", "_toxicity", "_digest", "_id", "_of", "_copies", "_again", "_content", "_cid", "_same")


def test_stages_leave_columns_with_internal_names_alone(spark, hard):
    labels = spark.createDataFrame([(i, int(i == 0)) for i in range(12)], "doc_id long, toxic int")  # few toxic ones: not everything is dropped
    plain = hard.where("doc_id < 12")
    docs = plain.select("*", *[F.lit(f"own {n}").alias(n) for n in RESERVED])
    for stage in (quality.good_documents, lambda d: toxicity.non_toxic(d, labels), jaccard_join.one_of_each, mixing.mixed_documents):
        got = stage(docs)
        assert got.columns == docs.columns
        rows = got.collect()
        assert rows, stage
        assert all(r[n] == f"own {n}" for r in rows for n in RESERVED)
        assert sorted((r.doc_id, r.text or "") for r in rows) == sorted((r.doc_id, r.text or "") for r in stage(plain).collect())


def test_long_words_count_in_full():
    info = quality._Info()
    stats, _ = quality.describe("a" * 4000 + "#" * 60 + "B" * 1000, info)
    assert stats["symbols"] == 60 / 5060 and stats["uppercase"] == 1000 / 5000
    stats, _ = quality.describe("plain words " * 20 + "日" * 20_000 + "1" * 300 + " " + "日" * 20_000 + "1" * 300, info)
    assert stats["not_letters"] == pytest.approx(600 / (200 + 40_600)) and stats["bare_symbols"] == 0
    stats, _ = quality.describe("plain words " * 20 + "1" * 300, info)
    assert stats["bare_symbols"] == 1 / 41 and stats["not_letters"] == pytest.approx(300 / 500)


def test_the_whole_shape_of_a_word_is_hashed():
    shape = lambda w: quality.describe(w, quality._Info())[1][0]
    assert shape("-" * 40 + "+") != shape("-" * 40 + "=")


def repeated(spark):
    """Documents of which one, early in both samples' orders, is repeated in most rows."""
    ids = spark.range(60).select(F.col("id").alias("doc_id")).where(~toxicity.held_out(F.col("doc_id")))
    docs = ids.select("doc_id", F.concat(F.lit("plain words and "), F.col("doc_id") * 7).alias("text"))
    first = [docs.orderBy(F.xxhash64("doc_id", F.lit(salt)), "doc_id").limit(1) for salt in (7, 8)]
    for one in first:
        docs = docs.unionByName(one.crossJoin(spark.range(200)).select("doc_id", "text"))
    return docs


def test_samples_hold_distinct_documents(spark, monkeypatch):
    docs = repeated(spark)
    assert len(quality._sample(docs, 20)) == 20
    seen = []
    monkeypatch.setattr(toxicity, "fit_nnpu", lambda toxic, unlabelled, *rest: seen.append(len(unlabelled)) or {})
    toxicity.fit(docs, docs.select("doc_id").distinct().withColumn("toxic", F.lit(1)), unlabelled_docs=20)
    assert seen == [20]


# --- pipeline ------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = p.table(spark, SF, "documents")
    ids = {r.doc_id for r in docs.collect()}
    labels = {r.doc_id: r for r in p.table(spark, SF, "labels").collect()}
    for name, stage in p.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns
        docs = p.materialize(after, f"test-{name}")
        rows = docs.collect()
        assert {r.doc_id for r in rows} <= ids
        if name == "quality":
            assert np.mean([labels[r.doc_id].quality for r in rows if r.doc_id in labels]) > 0.95
        if name == "jaccard":
            want = brute_jaccard([(r.doc_id, r.text, "s") for r in rows])
            assert all(a == c for a, n, c in want)  # no two of those left are linked
        ids = {r.doc_id for r in rows}
    packed = p.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == ids and sum(r.piece == 0 for r in packed) == docs.count()
