"""N-gram Jaccard self-join: exact links between documents whose shingle sets are alike.

1. Equal word sequences form one class (64-bit content id; two different texts of a corpus
   share an id with probability n^2 / 2^65). Only distinct contents are compared.
2. A hashed frequency table of fixed size, over all documents, gives one global order,
   rarest shingles first. Any fixed order is lossless; frequency makes it cheap: what many
   documents share comes last and seldom falls into a prefix.
3. Two sets with Jaccard >= t share a shingle of their first n - ceil(t n) + 1 ones. A task
   first combines its own prefix rows: a shingle's first row, by (position in the set, size),
   leads the others, and only leads meet those of other tasks. Leads, the hub among them and
   the neighbours in that order are the first candidates, after the length and positional filters.
4. Candidates are verified once per pair: a histogram of hash ranges bounds the overlap
   (in place of the suffix filter: it partitions the whole set, into a range for every four
   shingles, so it needs no common order of the suffixes), what remains is intersected in full.
5. Links found so far give components. Only shingles that still span several components
   yield further pairs, across components alone, verified the same way. Members of a frequent
   shingle are compared in bounded blocks of like lengths, and only the pairs that their
   histograms let pass come out. So every candidate pair is either verified or already joined:
   no link between different parts is lost, and a group of thousands of near copies costs
   about one check per member.

Defined cases: words are cut at 0x20 and 0x09-0x0D after lowering A-Z; under k words the
whole sequence is one shingle; null and empty texts have no set and link with nothing;
repeated rows are copies; null ids are allowed (a component's id is its smallest non-null
one); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from casewright.llm._sketch import bitmap, bitmap_bits, in_bitmap, pack_blocks, sum_blocks
from casewright.llm._store import discard, hot_join, materialize, table, unused
from casewright.llm._words import WordHashes, shingle_hashes, texts_of
from casewright.llm.graph import connected_components

K = 5
PERCENT = 75
COUNTER_BITS = 22
#: Members of one shingle that are compared by a join; above, in blocks of so many.
BLOCK = 512
#: Two that meet at so many prefix shingles are checked first, wherever those stand.
OFTEN = 3
_SEEN = 200_000


def content_id(words: list[bytes]) -> int:
    return int.from_bytes(hashlib.blake2b(b" ".join(words), digest_size=8).digest(), "little", signed=True)


def histogram(found: np.ndarray) -> bytes:
    """Shingles per hash range, about one range for every four shingles."""
    ranges = max(1, len(found) // 4).bit_length() - 1
    counts = np.bincount((found >> np.uint64(63 - ranges) >> np.uint64(1)).astype(np.int64), minlength=1 << ranges)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def _frequency_levels(counts: np.ndarray) -> np.ndarray:
    """Counters on a logarithmic scale of 256 steps: 4 MB to broadcast."""
    return np.minimum(255, np.round(8 * np.log2(1.0 + counts))).astype(np.uint8)


def _describe(docs: DataFrame, k: int) -> DataFrame:
    """Rows (doc_id, cid, n, hist) of all documents, and each task's blocks of shingle counters."""
    names = ["doc_id", "cid", "n", "hist", "block", "counts"]

    def run(batches):
        hashes, counts, seen = WordHashes(), np.zeros(1 << COUNTER_BITS, np.uint32), set()
        shift = np.uint64(64 - COUNTER_BITS)
        for batch in batches:
            cids, sizes, hists, fresh = [], [], [], []
            for text in texts_of(batch.column(1)):
                words = text.lower().split() if text else []
                found = shingle_hashes(words, hashes, k)
                cid = content_id(words) if words else None
                cids.append(cid)
                sizes.append(len(found))
                hists.append(histogram(found) if words else None)
                if words and cid not in seen:
                    if len(seen) < _SEEN:
                        seen.add(cid)
                    fresh.append((found >> shift).astype(np.int64))
            if fresh:
                counts += np.bincount(np.concatenate(fresh), minlength=len(counts)).astype(np.uint32)
            none = [pa.nulls(len(cids), pa.int32()), pa.nulls(len(cids), pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(hists, pa.binary()), *none], names=names)
        used, packed = pack_blocks(counts)
        none = pa.nulls(len(used), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, pa.nulls(len(used), pa.binary()), pa.array(used, pa.int32()), pa.array(packed, pa.binary())], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, cid long, n long, hist binary, block int, counts binary")


def _distinct_sets(docs: DataFrame, k: int, wanted=None):
    """Iterator function over batches of texts: (content id, sorted shingles), each content once per task."""

    def each(batches):
        hashes, seen = WordHashes(), set()
        for batch in batches:
            for text in texts_of(batch.column(0)):
                words = text.lower().split() if text else []
                if not words:
                    continue
                cid = content_id(words)
                if cid in seen or (wanted is not None and not wanted(cid)):
                    continue
                if len(seen) < _SEEN:
                    seen.add(cid)
                yield cid, shingle_hashes(words, hashes, k)

    return each


PREFIX = "h long, salt long, cid long, place long, lead struct<cid: long, place: long>"
#: Prefix rows that a task combines at a time.
CHUNK_ROWS = 500_000


def combine(h: np.ndarray, cid: np.ndarray, place: np.ndarray, salt: int) -> list[pa.Array]:
    """Columns of ``PREFIX``: of the rows with one shingle the first by (place, cid) leads, under salt 0.

    The others keep to themselves under ``salt``, so a shingle's rows of all chunks meet by their leads
    alone and a hot shingle is one row a chunk. All name their lead where the chunk holds several contents.
    """
    order = np.lexsort((cid, place, h))
    h, cid, place = h[order], cid[order], place[order]
    leads = np.ones(len(h), bool)
    leads[1:] = h[1:] != h[:-1]
    group = np.cumsum(leads) - 1
    lead = np.flatnonzero(leads)[group]
    company = np.bincount(group, cid != cid[lead])[group] > 0
    struct = pa.StructArray.from_arrays([pa.array(x[lead]) for x in (cid, place)], names=["cid", "place"], mask=pa.array(~company))
    return [pa.array(h), pa.array(np.where(leads, 0, salt)), pa.array(cid), pa.array(place), struct]


def _prefixes(docs: DataFrame, levels, k: int, percent: int) -> DataFrame:
    """Rows of ``PREFIX``: the rarest n - ceil(t n) + 1 shingles of each content, rarest first; place is position * 2**32 + n."""
    each, chunk = _distinct_sets(docs, k), CHUNK_ROWS

    def run(batches):
        from pyspark import TaskContext

        level, shift = levels.value, np.uint64(64 - COUNTER_BITS)
        held: list = []
        rows, salt = 0, 0
        task = TaskContext.get().partitionId() + 1

        def flush():
            cid = np.concatenate([np.full(len(h), c, np.int64) for c, h, _ in held])
            both = np.concatenate([(np.arange(len(h), dtype=np.int64) << 32) + n for _, h, n in held])
            h = np.concatenate([h for _, h, _ in held]).view(np.int64)
            whole = pa.RecordBatch.from_arrays(combine(h, cid, both, (task << 24) + salt), names=["h", "salt", "cid", "place", "lead"])
            return [whole.slice(at, 65536) for at in range(0, whole.num_rows, 65536)]

        for cid, found in each(batches):
            n = len(found)
            p = n - (percent * n + 99) // 100 + 1
            rank = (level[(found >> shift).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (found >> np.uint64(8))
            first = np.argpartition(rank, p - 1)[:p] if p < n else np.arange(n)
            held.append((cid, found[first[np.lexsort((found[first], rank[first]))]], n))
            rows += p
            if rows > chunk:
                yield from flush()
                held, rows, salt = [], 0, salt + 1
        if held:
            yield from flush()

    return docs.select(F.col("text").cast("string")).mapInArrow(run, PREFIX)


def _sets(docs: DataFrame, wanted_bits, k: int) -> DataFrame:
    """(cid, items): sorted shingles of the wanted contents (with the bitmap's few false positives); a content may come from several tasks."""

    def wanted(cid: int) -> bool:
        return in_bitmap(wanted_bits.value, cid)

    each = _distinct_sets(docs, k, wanted)

    def run(batches):
        cols, size = [[], []], 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary())], names=["cid", "items"])

        for cid, found in each(batches):
            cols[0].append(cid)
            cols[1].append(found.tobytes())
            size += found.nbytes
            if size > 8_000_000:
                yield flush()
                cols, size = [[], []], 0
        if cols[0]:
            yield flush()

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "cid long, items binary")


def _enough(inter, nx, ny, percent: int):
    """100 * intersection >= percent * union, in integers."""
    return 100 * inter >= percent * (nx + ny - inter)


def histogram_bound(x: bytes, y: bytes, nx: int, ny: int) -> int:
    """Upper bound of the overlap of two sets from their histograms: (nx + ny - sum of differences) / 2."""
    a, b = np.frombuffer(x, np.uint8).astype(np.int64), np.frombuffer(y, np.uint8).astype(np.int64)
    if 255 in (a.max(), b.max()):
        return min(nx, ny)
    small = min(len(a), len(b))
    return (nx + ny - int(np.abs(a.reshape(small, -1).sum(1) - b.reshape(small, -1).sum(1)).sum())) // 2


def _near(pairs: DataFrame, hists: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose histograms allow a link: the suffix filter."""

    def run(batches):
        for batch in batches:
            nx, ny, x, y = (c.to_pylist() for c in batch.columns[2:])
            good = [bool(_enough(histogram_bound(p, q, m, n), m, n, percent)) for m, n, p, q in zip(nx, ny, x, y)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    side = lambda end: hists.select(F.col("cid").alias(end), F.col("n").alias(f"n_{end}"), F.col("hist").alias(f"hist_{end}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "hist_a", "hist_b").mapInArrow(run, "a long, b long")


def _linked(near: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs of ``near`` (a written table) that link, as a written table. Only the texts that stand in a pair are shingled again and shipped."""
    spark = docs.sparkSession

    def run(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                good.append(bool(_enough(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), percent)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    ids = materialize(near.select(F.explode(F.array("a", "b")).alias("cid")).distinct(), "wanted")
    wanted = spark.sparkContext.broadcast(bitmap(ids, bitmap_bits(ids.count())))
    discard(ids)
    found = materialize(_sets(docs, wanted, k), "sets")
    sets = found.groupBy("cid").agg(F.first("items").alias("items"))
    side = lambda end: sets.select(F.col("cid").alias(end), F.col("items").alias(f"items_{end}"))
    edges = materialize(near.join(side("a"), "a").join(side("b"), "b").select("a", "b", "items_a", "items_b").mapInArrow(run, "a long, b long"), "edges")
    discard(found)
    free_shuffles(spark)
    return edges


def _alike(n1, n2, percent: int):
    """The length filter."""
    return 100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)


def _early(n1, pos1, n2, pos2, percent: int):
    """The positional filter: whether enough shingles are left if this is the first one in common."""
    return (100 + percent) * F.least(n1 - pos1, n2 - pos2) >= percent * (n1 + n2)


def coarse(hist: bytes) -> bytes | None:
    """A histogram folded to 64 ranges at most, 16 bits each; None where a range was too full to count."""
    fine = np.frombuffer(hist, np.uint8)
    return None if fine.max() == 255 else fine.reshape(min(64, len(fine)), -1).sum(axis=1).astype(np.uint16).tobytes()


def block_pairs(x: tuple, y: tuple, same: bool, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of the members of two blocks (cid, component, n, pos, coarse histograms) that pass every filter.

    Between different components only; by length, position and the histograms' bound, one row of ``x`` at a time.
    """
    (cx, kx, nx, px, hx), (cy, ky, ny, py, hy) = x, y
    by_ranges = {r: (at, np.stack([np.frombuffer(hy[j], np.uint16) for j in at]).astype(np.int32)) for r in {len(v) // 2 for v in hy if v is not None} if len(at := [j for j, v in enumerate(hy) if v is not None and len(v) // 2 == r])}
    unknown = np.array([v is None for v in hy], bool)
    out_i, out_j = [], []
    for i in range(len(cx)):
        good = (ky != kx[i]) & (cy != cx[i]) & (100 * np.minimum(ny, nx[i]) >= percent * np.maximum(ny, nx[i])) & ((100 + percent) * np.minimum(ny - py, nx[i] - px[i]) >= percent * (ny + nx[i]))
        if same:
            good[: i + 1] = False
        if not good.any():
            continue
        if hx[i] is not None:
            mine = np.frombuffer(hx[i], np.uint16).astype(np.int32)
            near = unknown.copy()
            for ranges, (at, theirs) in by_ranges.items():
                least = min(ranges, len(mine))
                apart = np.abs(theirs.reshape(len(at), least, -1).sum(axis=2) - mine.reshape(least, -1).sum(axis=1)).sum(axis=1)
                near[at] = _enough((ny[at] + nx[i] - apart) // 2, ny[at], nx[i], percent)
            good &= near
        j = np.flatnonzero(good)
        out_i.append(np.full(len(j), i))
        out_j.append(j)
    empty = [np.empty(0, np.int64)]
    return np.concatenate(out_i or empty), np.concatenate(out_j or empty)


def _split(rows: DataFrame) -> DataFrame:
    """The rows of shingles that several components share, with the number of rows m of their shingle.

    ``rows``: h, salt, cid, n, pos, component, a written table. Only leads are joined by the shingle itself.
    """
    ends = rows.groupBy("h").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("m")).where("low <> high").select("h", "m")
    others = rows.where("salt <> 0")
    places = others.select("h", "salt").distinct().join(ends, "h")
    return rows.where("salt = 0").join(ends, "h").drop("salt").unionByName(others.join(places, ["h", "salt"]).drop("salt"))


def _met(rows: DataFrame, hists: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of contents of different components that meet at a shingle and pass the length and positional filters.

    ``rows``: h, cid, n, pos, component and m, the shingle's number of members. Up to ``BLOCK`` members are
    joined. The members of a more frequent shingle are cut into blocks by length, and blocks of comparable
    lengths compared two by two in numpy; of their pairs only those come out that the histograms let pass.
    """
    few, many = rows.where(F.col("m") <= BLOCK).drop("m"), materialize(rows.where(F.col("m") > BLOCK), "frequent")
    x, y = few.alias("x"), few.alias("y")
    across = (F.col("x.h") == F.col("y.h")) & (F.col("x.cid") < F.col("y.cid")) & (F.col("x.component") != F.col("y.component"))
    possible = _alike(F.col("x.n"), F.col("y.n"), percent) & _early(F.col("x.n"), F.col("x.pos"), F.col("y.n"), F.col("y.pos"), percent)
    pairs = x.join(y, across & possible).select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b")).distinct()
    if many.isEmpty():
        return pairs

    def fold(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([coarse(v) for v in batch.column(1).to_pylist()], pa.binary())], names=["cid", "coarse"])

    known = hists.join(many.select("cid").distinct(), "cid", "left_semi").select("cid", "hist").mapInArrow(fold, "cid long, coarse binary")
    # Lengths of one class differ by the threshold's ratio at most, so only a class and the next can link.
    step = -math.log(percent / 100)
    many = many.withColumn("length", F.floor(F.log(F.col("n").cast("double")) / F.lit(step)).cast("int")).withColumn("block", F.pmod(F.xxhash64("cid"), F.ceil(F.col("m") / BLOCK).cast("long")).cast("int"))
    members = many.join(known, "cid").select("h", "m", "length", "block", "cid", "component", "n", "pos", "coarse")
    columns = ("cid", "component", "n", "pos")

    def pack(key, t):
        flat = [pa.array([t[c].to_numpy().astype(np.int64).tobytes()], pa.binary()) for c in columns]
        return pa.table([pa.array([k.as_py()]).cast(kind) for k, kind in zip(key, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))] + flat + [pa.array([t["coarse"].to_pylist()], pa.list_(pa.binary()))], names=["h", "m", "length", "block", *columns, "coarse"])

    kinds = "h long, m long, length int, block int, " + ", ".join(f"{c} binary" for c in columns) + ", coarse array<binary>"
    blocks = materialize(members.groupBy("h", "m", "length", "block").applyInArrow(pack, kinds), "blocks")

    def compare(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                row = {n: batch.column(n)[at].as_py() for n in batch.schema.names}
                x, y = ((*(np.frombuffer(row[f"{c}{k}"], np.int64) for c in columns), row[f"coarse{k}"]) for k in "12")
                i, j = block_pairs(x, y, row["length1"] == row["length2"] and row["block1"] == row["block2"], percent)
                a, b = x[0][i], y[0][j]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    side = lambda k: blocks.select("h", *[F.col(c).alias(f"{c}{k}") for c in ("length", "block", *columns, "coarse")])
    last = (F.ceil(blocks["m"] / BLOCK) - 1).cast("int")
    left = blocks.select("h", F.explode(F.array(F.struct("length", F.col("block").alias("low")), F.struct((F.col("length") + 1).alias("length"), F.lit(0).alias("low")))).alias("to"), last.alias("last"), *[F.col(c).alias(f"{c}1") for c in ("length", "block", *columns, "coarse")])
    left = left.withColumn("block2", F.explode(F.sequence("to.low", "last"))).withColumn("length2", F.col("to.length")).drop("to", "last")
    tiles = left.join(side("2"), ["h", "length2", "block2"])
    return pairs.unionByName(tiles.mapInArrow(compare, "a long, b long")).distinct()


def free_shuffles(spark) -> None:
    """Let the driver forget finished shuffles, whose files would otherwise stay on disk."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def jaccard_links(docs: DataFrame, k: int = K, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(documents: doc_id, cid, n_shingles; components: id, component), both written tables over content ids."""
    spark = docs.sparkSession
    described = materialize(_describe(docs, k), "described")
    levels = spark.sparkContext.broadcast(_frequency_levels(sum_blocks(described.where("block is not null").select("block", "counts"), COUNTER_BITS, "uint32")))
    members = described.where("block is null").select("doc_id", "cid", F.col("n").alias("n_shingles"))
    hists = described.where("cid is not null").groupBy("cid").agg(F.first("n").alias("n"), F.first("hist").alias("hist"))
    by_shingle = Window.partitionBy("h", "salt").orderBy("place", "cid")
    rows = _prefixes(docs, levels, k, percent)
    for name, c in (("hub", F.first(F.struct("cid", "place"))), ("prev", F.lag(F.struct("cid", "place"))), ("next", F.lead("cid"))):
        rows = rows.withColumn(name, c.over(by_shingle))
    rows = materialize(rows.where("prev.cid <> cid or next <> cid or lead is not null").drop("next"), "shared")
    free_shuffles(spark)

    # Checked first: the chunk's lead, the hub of the leads - the member that has it earliest, so the one with the fewest
    # shingles of its own - and the neighbour in that order, if the shingle stands early enough or
    # the two meet several times; and everyone's most frequent meeting.
    size, pos = lambda c: F.col(c).bitwiseAND(F.lit(0xFFFFFFFF)), lambda c: F.shiftright(F.col(c), 32)
    rows = rows.withColumn("n", size("place")).withColumn("pos", pos("place"))
    meets = [F.struct(F.col(f"{w}.cid").alias("other"), size(f"{w}.place").alias("n2"), pos(f"{w}.place").alias("pos2")) for w in ("hub", "prev", "lead")]
    beside = rows.select("cid", "n", "pos", F.explode(F.array_distinct(F.array(*meets))).alias("m")).select("cid", "n", "pos", "m.*").where((F.col("other") != F.col("cid")) & _alike(F.col("n"), F.col("n2"), percent))
    beside = beside.groupBy(F.least("cid", "other").alias("a"), F.greatest("cid", "other").alias("b")).agg(F.count(F.lit(1)).alias("times"), F.max(_early(F.col("n"), F.col("pos"), F.col("n2"), F.col("pos2"), percent)).alias("early"))
    beside = materialize(beside, "beside")
    ends = beside.select(F.explode(F.array(F.struct(F.col("a").alias("one"), F.col("b").alias("other"), "times"), F.struct(F.col("b").alias("one"), F.col("a").alias("other"), "times"))).alias("e")).select("e.*")
    best = ends.groupBy("one").agg(F.max(F.struct("times", F.xxhash64("one", "other"), "other")).alias("m"))
    best = best.select(F.least("one", "m.other").alias("a"), F.greatest("one", "m.other").alias("b"))
    first = beside.where((F.col("times") >= OFTEN) | F.col("early")).select("a", "b").unionByName(best).distinct()
    first = materialize(_near(first, hists, percent), "near")
    discard(beside)
    edges = _linked(first, docs, k, percent)
    parts = materialize(connected_components(edges), "parts")

    labelled = rows.select("h", "salt", "cid", "n", "pos").join(parts.withColumnRenamed("id", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    labelled = materialize(labelled, "labelled")
    discard(rows)
    more = materialize(_near(_met(_split(labelled), hists, percent).join(first, ["a", "b"], "left_anti"), hists, percent), "near")
    discard(labelled, edges)
    free_shuffles(spark)
    if more.isEmpty():
        return members, parts
    stars = parts.select(F.col("id").alias("a"), F.col("component").alias("b"))
    final = materialize(connected_components(stars.unionByName(_linked(more, docs, k, percent))), "parts")
    return members, final


def jaccard_components(docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """doc_id, cid, n_shingles, part (internal), component_id of every document.

    A component's smallest id is found over its contents, one row each, and sent back to contents and
    to rows over salted keys: one component, or one copied text, may hold any share of them.
    """
    members, parts = jaccard_links(docs, k, percent)
    members = materialize(members, "members")
    contents = members.where("cid is not null").groupBy("cid").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    contents = materialize(contents.join(parts.withColumnRenamed("id", "cid"), "cid", "left"), "contents")
    several = F.lit(None).cast("long")
    grouped = contents.where("component is not null").withColumnRenamed("component", "part")
    heads = grouped.groupBy("part").agg(F.min("least").alias("component_id"))
    grouped = hot_join(grouped, heads, "part", "cid", several).select("cid", "copies", "least", "part", "component_id")
    alone = contents.where("component is null").select("cid", "copies", "least", F.col("cid").alias("part"), F.col("least").alias("component_id"))
    facts = grouped.unionByName(alone).withColumn("lone", F.when(F.col("copies") == 1, F.col("least"))).drop("copies", "least")
    worded = hot_join(members.where("cid is not null"), facts, "cid", "doc_id", F.col("lone")).select("doc_id", "cid", "n_shingles", "part", "component_id")
    none = members.where("cid is null").select("doc_id", "cid", "n_shingles", F.lit(None).cast("long").alias("part"), F.col("doc_id").alias("component_id"))
    return worded.unionByName(none)


def jaccard_pairs(docs: DataFrame, k: int = K, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(documents: doc_id, cid, n_shingles; every link between different contents: a, b with a < b), both written tables.

    Unlike ``jaccard_links`` this verifies every candidate, those inside a component too, so its
    work and result grow with the number of links: the square of a group of near copies.
    """
    described = materialize(_describe(docs, k), "described")
    levels = docs.sparkSession.sparkContext.broadcast(_frequency_levels(sum_blocks(described.where("block is not null").select("block", "counts"), COUNTER_BITS, "uint32")))
    members = described.where("block is null").select("doc_id", "cid", F.col("n").alias("n_shingles"))
    hists = described.where("cid is not null").groupBy("cid").agg(F.first("n").alias("n"), F.first("hist").alias("hist"))
    size, pos = F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftright("place", 32)
    rows = materialize(_prefixes(docs, levels, k, percent).select("h", "salt", "cid", size.alias("n"), pos.alias("pos"), F.col("cid").alias("component")), "prefixes")
    pairs = _met(_split(rows), hists, percent)
    near = materialize(_near(pairs, hists, percent), "near")
    discard(rows)
    return members, _linked(near, docs, k, percent)


def jaccard_degrees(docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, links of every document: the exact number of other rows it links with, copies included."""
    members, edges = jaccard_pairs(docs, k, percent)
    copies = materialize(members.where("cid is not null").groupBy("cid").agg(F.count(F.lit(1)).alias("copies")), "copies")
    ends = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = ends.join(copies.withColumnRenamed("cid", "b"), "b").groupBy(F.col("a").alias("cid")).agg(F.sum("copies").alias("others"))
    links = copies.join(others, "cid", "left").select("cid", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
    return members.join(links, "cid", "left").select("doc_id", "n_shingles", F.coalesce("links", F.lit(0)).alias("links"))


def one_of_each(docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row for each component: the smallest doc_id, nulls last. Texts without words all stay."""
    members = jaccard_components(docs, k, percent).where("cid is not null")
    copies = members.groupBy("part", "doc_id", "cid").agg(F.count(F.lit(1)).alias("same"))
    keep = copies.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "cid", "same")).alias("kept"))
    names, fields = docs.columns, docs.schema.fields
    content, id_, cid, same = (unused(names, n) for n in ("_content", "_id", "_cid", "_same"))
    keep = materialize(keep.select(F.col("kept.doc_id").alias(id_), F.col("kept.cid").alias(cid), F.col("kept.same").alias(same)), "keep")
    at = names.index("text")

    def tag(batches):
        for batch in batches:
            cids = [content_id(w) if t and (w := t.lower().split()) else None for t in texts_of(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cids, pa.int64())], names=[*names, content])

    tagged = docs.mapInArrow(tag, StructType([*fields, StructField(content, LongType())]))
    kept = tagged.join(keep, F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.col(content) == F.col(cid)), "left").where(F.col(content).isNull() | F.col(cid).isNotNull())
    if keep.where(F.col(same) > 1).isEmpty():
        return kept.select(*names)
    once = kept.where(F.col(same) > 1).dropDuplicates(["doc_id", content])
    return kept.where(F.col(same).isNull() | (F.col(same) == 1)).unionByName(once).select(*names)


def op3_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
