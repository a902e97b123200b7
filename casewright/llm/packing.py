"""Best-fit packing of tokenised documents into sequences of bounded length.

Tokens: the caller's tokenizer file, ids followed by one end id. Words repeat, so each
worker keeps the ids of the chunks it has met (bounded) and encodes only new ones:
plain Latin chunks through a byte-pair encoder over the same merges, everything else
through the tokenizer itself. White space never crosses a token, which makes a text's
ids the concatenation of its chunks' ids.

Packing: pieces are dealt by hash into blocks of bounded size. A block is packed
best-fit decreasing; then its least filled bin gives documents away - a plain move, a
one-for-one or a two-for-one exchange, each increasing the sum of squared fills - until
it is empty or nothing improves. Blocks cost at most one underfull bin each.

Defined cases: null text is empty and yields the end id alone; empty table, no rows;
repeated rows are packed as often as they occur; other columns are ignored.
"""

from __future__ import annotations

import functools
import json
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.llm._store import materialize, table
from casewright.llm._words import texts_of

MAX_TOKENS = 4096
END_ID = 1
BLOCK_PIECES = 8192
_CHUNKS = 400_000
#: Fixed values of the tokenizer's pre-tokenizer: its split pattern.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Printable ASCII and Latin letters, without the dotted capital I: their lower case and NFC form are single and plain.
_PLAIN = regex.compile(r"[\x21-\x7e¡-įı-ſ]+")


def _byte_alphabet() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from code point 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(other)}


class ChunkIds(dict):
    """chunk bytes -> little-endian uint32 ids."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        suffix, byte_of, vocab = model["end_of_word_suffix"], _byte_alphabet(), model["vocab"]

        def raw(token: str) -> bytes:
            end = token.endswith(suffix)
            return bytes(byte_of[c] for c in (token[: -len(suffix)] if end else token)) + b" " * end

        ranks, ids = {}, []
        for c, b in sorted(byte_of.items(), key=lambda x: x[1]):
            ranks[bytes([b])] = len(ranks)
            ids.append(vocab[c])
        for c, b in sorted(byte_of.items(), key=lambda x: x[1]):
            if b != 32:  # a word's last byte and its end mark are one symbol before any merge
                ranks[bytes([b]) + b" "] = len(ranks)
                ids.append(vocab[c + suffix])
        for m in model["merges"]:
            left, right = m if isinstance(m, list) else m.split(" ")
            ranks[raw(left) + raw(right)] = len(ranks)
            ids.append(vocab[left + right])
        self.pairs = tiktoken.Encoding("own", pat_str=r"[^ ]+ ", mergeable_ranks=ranks, special_tokens={})
        self.ids = np.array(ids, dtype="<u4")
        self.ends = np.zeros(len(ids), dtype=bool)
        for key, rank in ranks.items():
            self.ends[rank] = key.endswith(b" ") and len(key) > 1

    def learn(self, chunks: list[bytes]) -> None:
        texts = [c.decode() for c in chunks]
        plain = [i for i, t in enumerate(texts) if _PLAIN.fullmatch(t) and "<|" not in t]
        pieces, counts = [], []
        for i in plain:
            found = _PIECES.findall(texts[i].lower())
            pieces += found
            counts.append(len(found))
        if pieces:
            got = np.array(self.pairs.encode_ordinary(" ".join(pieces) + " "), dtype=np.int64)
            stops = np.flatnonzero(self.ends[got])[np.cumsum(counts) - 1] + 1
            raw, at = self.ids[got].tobytes(), 0
            for i, stop in zip(plain, (stops * 4).tolist()):
                self[chunks[i]] = raw[at:stop]
                at = stop
        for i in sorted(set(range(len(texts))) - set(plain)):
            self[chunks[i]] = np.array(self.whole.encode(texts[i], add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, text: bytes) -> bytes:
        chunks = text.split()
        try:
            return b"".join(map(self.__getitem__, chunks))
        except KeyError:
            if len(self) > _CHUNKS:
                self.clear()
            self.learn([c for c in set(chunks) if c not in self])
            out = b"".join(map(self.__getitem__, chunks))
            for c in set(chunks):
                if len(c) > 64:
                    del self[c]
            return out


@functools.lru_cache(maxsize=1)
def _encoder(path: str) -> ChunkIds:
    return ChunkIds(path)


_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenized_pieces(docs: DataFrame, tokenizer: str, max_tokens: int = MAX_TOKENS, end_id: int = END_ID) -> DataFrame:
    """One row per piece of at most ``max_tokens`` ids: doc_id, piece, start, length, ids_crc32."""
    tail, step = np.array([end_id], dtype="<u4").tobytes(), 4 * max_tokens

    def run(batches):
        encoder = _encoder(tokenizer)
        for batch in batches:
            rows = [[], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
                ids = encoder.encode(text or b"") + tail
                for piece, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    for col, value in zip(rows, (doc, piece, at // 4, len(part) // 4, zlib.crc32(part))):
                        col.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _PIECE)


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each item goes where the least room is left that still holds it."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r set: some bin has r left
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        fit = rooms >> need
        if fit:
            room = need + (fit & -fit).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        by_room.setdefault(room - need, []).append(b)
        rooms |= 1 << (room - need)
    return bins


def _exchange(d: int, bins: list[list[int]], where: np.ndarray, fill: np.ndarray, size: np.ndarray, capacity: int, takers: np.ndarray) -> int | None:
    """One improving move, one-for-one or two-for-one exchange out of bin d into one of ``takers`` (a mask of bins); the taker, or None if there is none."""
    room = np.where(takers, capacity - fill, 0)
    open_ = np.flatnonzero(room)
    if not len(open_):
        return None
    lengths, first, counts = np.unique(size[bins[d]], return_index=True, return_counts=True)  # few: their sum is at most the capacity
    for given, at in zip(lengths[::-1].tolist(), first[::-1].tolist()):
        fits = open_[(room[open_] >= given) & (fill[open_] + given > fill[d])]
        if len(fits):
            r = int(fits[np.argmin(room[fits])])
            i = bins[d].pop(at)
            bins[r].append(i)
            where[i] = r
            fill[d] -= given
            fill[r] += given
            return r
    items = np.flatnonzero(((room > 0) & (fill >= fill[d]))[where])
    if not len(items):
        return None
    # least[g]: the shortest item whose place and its bin's room hold g
    holds = size[items] + room[where[items]]
    least = np.full(capacity + 1, capacity + 1)
    np.minimum.at(least, holds, size[items])
    least = np.minimum.accumulate(least[::-1])[::-1]
    x, y = np.triu_indices(len(lengths))
    twice = (x != y) | (counts[x] > 1)
    x, y = x[twice], y[twice]
    given = np.concatenate([lengths, lengths[x] + lengths[y]])
    gain = given - least[given]
    best = int(np.argmax(gain))
    if gain[best] <= 0:
        return None
    wanted = [lengths[best]] if best < len(lengths) else [lengths[x[best - len(lengths)]], lengths[y[best - len(lengths)]]]
    k = int(items[np.flatnonzero((holds >= given[best]) & (size[items] == least[given[best]]))[0]])
    r = int(where[k])
    for length in wanted:
        i = next(i for i in bins[d] if size[i] == length)
        bins[d].remove(i)
        bins[r].append(i)
        where[i] = r
    bins[r].remove(k)
    bins[d].append(k)
    where[k] = d
    fill[d] -= gain[best]
    fill[r] += gain[best]
    return r


def local_search(bins: list[list[int]], lengths: np.ndarray, capacity: int, again: int = 64) -> list[list[int]]:
    """Empty bins by moves and exchanges that each increase the sum of squared fills.

    The least filled bin gives first; when it has nothing to give, the next ones make room,
    and after each success the search begins anew. Once the first ``again`` bins have nothing
    to give, all other underfull ones give in turn what they can before it begins anew. Stops
    at the fewest bins possible, or when no bin has anything left to give; the rising sum ends
    the search. A bin that had nothing to give is only tried again with the bins changed since.
    """
    size, bins = np.asarray(lengths, np.int64), [list(b) for b in bins]
    where = np.empty(len(size), np.int64)
    for b, members in enumerate(bins):
        where[members] = b
    fill = np.array([size[b].sum() for b in bins], np.int64)
    fewest = -(-int(fill.sum()) // capacity)
    changed, checked, clock = np.zeros(len(bins), np.int64), np.full(len(bins), -1), 0

    def give(d: int) -> bool:
        nonlocal clock
        takers = (changed > checked[d]) & (fill > 0)
        takers[d] = False
        r = _exchange(d, bins, where, fill, size, capacity, takers) if 0 < fill[d] < capacity else None
        if r is None:
            checked[d] = clock
            return False
        clock += 1
        changed[[d, r]], checked[[d, r]] = clock, -1
        return True

    def give_all(d: int) -> bool:
        given = give(d)
        while given and give(d):
            pass
        return given

    while np.count_nonzero(fill) > fewest:
        order = [d for d in np.argsort(fill, kind="stable").tolist() if 0 < fill[d] < capacity]
        if not any(map(give, order[:again])) and not any([give_all(d) for d in order[again:]]):
            break
    return [b for b in bins if b]


def pack(pieces: DataFrame, max_tokens: int = MAX_TOKENS, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """Add sequence_id and offset to a written table of pieces (columns of ``tokenized_pieces``)."""
    n_blocks = max(1, -(-pieces.count() // block_pieces))

    def run(key, pdf):
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], ignore_index=True)
        lengths = pdf["length"].to_numpy(np.int64)
        sequence, offset = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
        for n, members in enumerate(local_search(best_fit(lengths, max_tokens), lengths, max_tokens)):
            sequence[members] = (int(key[0]) << 32) + n
            offset[members] = np.cumsum(lengths[members]) - lengths[members]
        return pd.DataFrame({c: pdf[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")} | {"sequence_id": sequence, "offset": offset}).astype({"doc_id": "Int64"})

    block = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(n_blocks))
    return pieces.withColumn("block", block).groupBy("block").applyInPandas(run, _PIECE + ", sequence_id long, offset long")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Tokenise and pack ``docs`` (doc_id, text)."""
    return pack(materialize(tokenized_pieces(docs, tokenizer or default_tokenizer(), max_tokens), "pieces"), max_tokens)


def op7_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
