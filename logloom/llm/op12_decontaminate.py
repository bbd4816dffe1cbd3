"""Benchmark decontamination: occurrences of word windows of benchmark items in documents, by Wu-Manber multi-pattern search.

Texts are tokenised as bytes: A-Z become a-z, and words are runs of 0-9, a-z and bytes from 0x80 on, so words of a text are hashed
without decoding it. Windows of one length L form one search. A table indexed by the hash of a block of two words holds how far the
end of a window can move on when that block is seen: at most L - 1 words, and 0 if some window ends in the block. Positions that the
table skips are never looked at. Where it says 0, windows with that block as their suffix (a bucket of a sorted array) and with an equal
hash of all words are selected, and their words are compared byte for byte. The search runs in many lanes of a batch at once, so each
step is a few array operations.

The benchmark is cut into blocks of at most `block_bytes` (checked), one of which is broadcast at a time. One block is the usual case:
texts are then read once and nothing is shuffled. With more blocks, each pass keeps what it found by the digest of a text, and passes
are merged; work grows with blocks times documents, memory doesn't.

Edge cases: null and empty texts have no words; an item with fewer words than a window, but not none, is one window; a row without
item_id marks words as hit but isn't listed; rows that repeat an item_id are one item; each row of documents gets a row, ids may be
null or repeat; empty tables give no rows or no hits; other columns are ignored. Long texts are tokenised in parts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, table, written

WORDS = 10
#: Bytes of text that are tokenised at once, and of words of a benchmark that are broadcast at once.
PART, BLOCK_BYTES = 1 << 22, 1 << 23
#: Bytes of an item in one row, so that blocks of them come out even.
PIECE = 1 << 16
LANE = 256
BITS = 20
COMPARED = 1 << 13
FOUND = "spans array<struct<begin:bigint,end:bigint>>, items array<string>"

#: 0 for bytes that are no part of a word, else the byte in lower case.
LOWER = np.zeros(256, np.uint8)
for _b in (*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)):
    LOWER[_b] = _b
for _b in range(0x41, 0x5B):
    LOWER[_b] = _b + 32
_ODD, _MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
        _powers[:] = [np.cumprod(np.full(n, x, np.uint64)) for x in (_ODD, inverse)]
    return _powers[0][:n], _powers[1][:n]


@dataclass
class Words:
    """Words of texts: lower-case bytes with zeros between words, begin and length of each word, and its hash."""

    low: np.ndarray
    begin: np.ndarray
    size: np.ndarray
    hash: np.ndarray


def tokenised(data: np.ndarray, heads: np.ndarray) -> Words:
    """Words of the texts that begin at heads (rising) of data, in parts that end between words."""
    low, cuts = LOWER[data], np.zeros(len(data) + 1, bool)
    cuts[heads] = True
    begins, sizes, hashes, at, reach = [], [], [], 0, PART
    while at < len(data):
        end = min(at + reach, len(data))
        if end < len(data):
            free = np.flatnonzero((low[at + 1 : end + 1] == 0) | cuts[at + 1 : end + 1])
            if not len(free):
                reach *= 2
                continue
            end = at + 1 + int(free[-1])
        part, cut = low[at:end], cuts[at:end]
        inside = part != 0
        fresh = inside.copy()
        fresh[1:] &= ~inside[:-1] | cut[1:]
        begin = np.flatnonzero(fresh)
        if len(begin):
            power, back = powers(len(part))
            # Bytes between words are 0, so the sum from one word's begin to the next one's is its own.
            total = np.add.reduceat(part.astype(np.uint64) * power, begin)
            size = np.add.reduceat(inside, begin, dtype=np.int64)
            h = (total * back[begin] + size.astype(np.uint64)) * _MIX
            begins.append(begin + at)
            sizes.append(size)
            hashes.append(h ^ (h >> np.uint64(29)))
        at, reach = end, PART
    if not begins:
        return Words(low, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
    return Words(low, np.concatenate(begins), np.concatenate(sizes), np.concatenate(hashes))


def gathered(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, … count[0] of them, then the same for the next."""
    before = np.cumsum(count) - count
    return np.repeat(start - before, count) + np.arange(int(count.sum()))


def same_words(a: Words, i: np.ndarray, b: Words, j: np.ndarray, length: int) -> np.ndarray:
    """Whether the `length` words from i[k] on in a are those from j[k] on in b, byte for byte."""
    out = np.zeros(len(i), bool)
    for lo in range(0, len(i), COMPARED):
        own = slice(lo, lo + COMPARED)
        x, y = i[own, None] + np.arange(length), j[own, None] + np.arange(length)
        alike = np.flatnonzero((a.size[x] == b.size[y]).all(1))
        x, y = x[alike].ravel(), y[alike].ravel()
        n = a.size[x]
        differ = a.low[gathered(a.begin[x], n)] != b.low[gathered(b.begin[y], n)]
        wrong = np.add.reduceat(differ, np.cumsum(n) - n, dtype=np.int64) if len(n) else n
        out[lo + alike[wrong.reshape(-1, length).sum(1) == 0]] = True
    return out


def window_hash(h: np.ndarray, first: np.ndarray, length: int) -> np.ndarray:
    out = np.zeros(len(first), np.uint64)
    for k in range(length):
        out = (out + h[first + k]) * _STEP
    return out ^ (out >> np.uint64(31))


class Search:
    """Wu-Manber tables for windows of one length; first: the place of each window in words."""

    def __init__(self, words: Words, first: np.ndarray, length: int):
        self.words, self.length, self.block = words, length, min(2, length)
        every = window_hash(words.hash, first, length)
        # Equal windows are one pattern; the hash finds them, bytes decide. One that merely shares a hash stays by itself.
        _, one, kind = np.unique(every, return_index=True, return_inverse=True)
        alone = np.flatnonzero(~same_words(words, first, words, first[one[kind]], length))
        kind[alone] = len(one) + np.arange(len(alone))
        self.pattern = kind
        first = first[np.r_[one, alone]]
        every = every[np.r_[one, alone]]
        self.shift = np.full(1 << BITS, length - self.block + 1, np.uint8)
        for ahead in range(length - self.block, -1, -1):
            # The block that ends `ahead` words before a window's end allows to move on by that much.
            self.shift[self.blocks(words.hash, first + length - 1 - ahead)] = ahead
        suffix = self.blocks(words.hash, first + length - 1)
        key = self.keys(suffix, every)
        order = np.argsort(key, kind="stable")
        self.key, self.first, self.id = key[order], first[order], order

    def blocks(self, h: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the block of words that ends at each place."""
        both = h[end] if self.block == 1 else h[end - 1] * _STEP + h[end]
        return (both * _MIX) >> np.uint64(64 - BITS)

    @staticmethod
    def keys(suffix: np.ndarray, every: np.ndarray) -> np.ndarray:
        """Buckets by suffix, inside them by the hash of all words."""
        return (suffix << np.uint64(64 - BITS)) | (every >> np.uint64(BITS))

    def occurrences(self, doc: Words, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, pattern) of every occurrence that lies in one text; home: the text of each word."""
        at = np.arange(self.length - 1, len(doc.hash), LANE)
        until, ends = np.minimum(at + LANE, len(doc.hash)), []
        while len(at):
            step = self.shift[self.blocks(doc.hash, at)]
            ends.append(at[step == 0])
            at = at + np.maximum(step, 1)
            ahead = at < until
            at, until = at[ahead], until[ahead]
        first = np.concatenate(ends) - self.length + 1 if ends else at
        first = first[home[first] == home[first + self.length - 1]]
        key = self.keys(self.blocks(doc.hash, first + self.length - 1), window_hash(doc.hash, first, self.length))
        low, high = np.searchsorted(self.key, key), np.searchsorted(self.key, key, "right")
        first, pick = np.repeat(first, high - low), gathered(low, high - low)
        true = same_words(doc, first, self.words, self.first[pick], self.length)
        return first[true], self.id[pick[true]]


class Block:
    """Searches for the windows of pieces (item, text, whether it is a whole item of less than a window)."""

    def __init__(self, pieces: list, length: int):
        data = b" ".join(t for _, t, _ in pieces)
        sizes = np.array([len(t) + 1 for _, t, _ in pieces], np.int64)
        heads = np.cumsum(sizes) - sizes
        words = tokenised(np.frombuffer(data, np.uint8), heads)
        begin = np.searchsorted(words.begin, np.r_[heads, len(data) + 1])
        count = np.diff(begin)
        names = sorted({i for i, _, _ in pieces if i is not None})
        number = {name: k for k, name in enumerate(names)}
        item = np.array([number.get(i, -1) for i, _, _ in pieces], np.int64)
        self.names = pa.array(names, pa.string())
        short = np.array([s for _, _, s in pieces], bool)
        self.searches = []
        for n in sorted({length, *count[short].tolist()}):
            own = np.flatnonzero(short & (count == n) if n < length else ~short)
            windows = count[own] - n + 1
            first = gathered(begin[own], windows)
            if len(first):
                search = Search(words, first, n)
                pairs = np.unique(np.stack([search.pattern, np.repeat(item[own], windows)]), axis=1)
                pairs = pairs[:, pairs[1] >= 0]
                self.searches.append((search, np.searchsorted(pairs[0], np.arange(search.pattern.max() + 2)), pairs[1]))

    def found(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """Number of words, maximal spans of hit words and sorted items of each text (large binary, no nulls)."""
        at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
        at = at - at[0]
        doc = tokenised(data, at[:-1])
        begin = np.searchsorted(doc.begin, at)
        home = np.repeat(np.arange(len(texts)), np.diff(begin))
        edge, seen = np.zeros(len(doc.hash) + 1, np.int64), [np.zeros((2, 0), np.int64)]
        for search, place, items in self.searches:
            first, pattern = search.occurrences(doc, home)
            np.add.at(edge, first, 1)
            np.add.at(edge, first + search.length, -1)
            one = np.unique(np.stack([home[first], pattern]), axis=1)
            n = place[one[1] + 1] - place[one[1]]
            seen.append(np.stack([np.repeat(one[0], n), items[gathered(place[one[1]], n)]]))
        hit = np.cumsum(edge[:-1]) > 0
        start = hit.copy()
        start[1:] &= ~hit[:-1] | (home[1:] != home[:-1])
        stop = hit.copy()
        stop[:-1] &= ~hit[1:] | (home[1:] != home[:-1])
        start, stop = np.flatnonzero(start), np.flatnonzero(stop)
        spans = pa.StructArray.from_arrays([pa.array(start - begin[home[start]]), pa.array(stop + 1 - begin[home[start]])], ["begin", "end"])
        seen = np.unique(np.concatenate(seen, axis=1), axis=1)
        ends = lambda of: pa.array(np.searchsorted(of, np.arange(len(texts) + 1)), pa.int32())
        return np.diff(begin), pa.ListArray.from_arrays(ends(home[start]), spans), pa.ListArray.from_arrays(ends(seen[0]), self.names.take(pa.array(seen[1])))


def pieces_of(items: DataFrame, length: int, id_col: str, text_col: str, piece: int = PIECE) -> DataFrame:
    """item, text (words joined by blanks, in pieces that overlap by a window less one word) and short."""
    lower = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

    def cut(batches):
        for batch in batches:
            rows = []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                words = re.findall(rb"[0-9a-z\x80-\xff]+", (t or b"").translate(lower))
                if 0 < len(words) < length:
                    rows.append((i, b" ".join(words), True))
                    continue
                lo = 0
                while lo + length <= len(words):
                    hi, size = lo, 0
                    while hi < len(words) and (size < piece or hi < lo + length):
                        size += len(words[hi]) + 1
                        hi += 1
                    rows.append((i, b" ".join(words[lo:hi]), False))
                    lo = hi - length + 1
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.binary(), pa.bool_()))], names=["item", "text", "short"])

    own = items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    return own.mapInArrow(cut, "item string, text binary, short boolean").distinct()


def in_blocks(pieces: DataFrame, block_bytes: int) -> tuple[DataFrame, int]:
    """pieces, written, with a block each; no block holds more than twice block_bytes, or one piece."""
    own = written(pieces)
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    while True:
        dealt = own.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)))
        most = dealt.groupBy("block").agg(F.sum(F.octet_length("text")).alias("n"), F.count("*").alias("pieces")).where(f"n > {2 * block_bytes} AND pieces > 1")
        if not total or not most.take(1):
            return dealt, blocks
        blocks *= 2


def searched(rows: DataFrame, pieces: DataFrame, length: int) -> DataFrame:
    """rows(key, text) as key, n_words, spans and items; pieces of one block are broadcast."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast([(r.item, bytes(r.text), r.short) for r in pieces.collect()])
    key = rows.schema["key"].dataType.simpleString()

    def run(batches):
        block = Block(shared.value, length)
        for batch in batches:
            texts = pc.fill_null(batch.column(1).cast(pa.large_binary()), b"")
            size, lo = pc.binary_length(texts).to_numpy(zero_copy_only=False), 0
            while lo < len(texts):
                hi = lo + max(1, int(np.searchsorted(np.cumsum(size[lo:]), PART, "right")))
                n, spans, items = block.found(texts.slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n), spans, items], names=["key", "n_words", "spans", "items"])
                lo = hi

    return rows.mapInArrow(run, f"key {key}, n_words bigint, {FOUND}")


def merged(found: DataFrame) -> DataFrame:
    """One row per key of what several blocks found: spans joined to maximal ones, items together."""

    def join(batches):
        for batch in batches:
            spans, items = [], []
            for lists, names in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                own = []
                for s in sorted((s for part in lists for s in part), key=lambda s: s["begin"]):
                    if own and s["begin"] <= own[-1]["end"]:
                        own[-1]["end"] = max(own[-1]["end"], s["end"])
                    else:
                        own.append(s)
                spans.append(own)
                items.append(sorted({i for part in names for i in part}))
            kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind), pa.array(items, pa.list_(pa.string()))], names=["key", "spans", "items"])

    per = found.groupBy("key").agg(F.collect_list("spans").alias("spans"), F.collect_list("items").alias("items"))
    return per.mapInArrow(join, f"key binary, {FOUND}")


def decontaminated(docs: DataFrame, items: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, spans (begin and end of maximal runs of hit words) and items (ids as strings, sorted) of each row of docs."""
    pieces, blocks = in_blocks(pieces_of(items, words, item_col, item_text_col), block_bytes)
    rows = docs.select(F.col(id_col).cast("bigint").alias("key"), F.col(text_col).alias("text"))
    if blocks == 1:
        return searched(rows, pieces, words).withColumnRenamed("key", "doc_id")
    digest = F.unhex(F.sha2(F.coalesce(text_col, F.lit("")), 256)).alias("key")
    own, passes = docs.select(digest, F.col(text_col).alias("text")), []
    for k in range(blocks):
        got = searched(own, pieces.where(F.col("block") == k), words).where("size(spans) > 0")
        passes.append(written(got.groupBy("key").agg(F.first("spans").alias("spans"), F.first("items").alias("items"))))
    every = passes[0]
    for more in passes[1:]:
        every = every.unionByName(more)
    found = written(merged(every))
    dropped(*passes)
    count = searched(docs.select(F.struct(F.col(id_col).cast("bigint").alias("doc_id"), digest).alias("key"), F.col(text_col).alias("text")), pieces.limit(0), words)
    out = count.select("key.doc_id", "key.key", "n_words").join(found, "key", "left")
    empty = found.schema
    return out.select("doc_id", "n_words", *(F.coalesce(c, F.array().cast(empty[c].dataType)).alias(c) for c in ("spans", "items")))


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["begin"])
    return got.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


# Every window of every needed length is built as a string and looked up.
OP12_SQL = r"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS win FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
g AS (SELECT k, s, n, array_to_string(w[s:s + n - 1], ' ') AS win FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n)),
o AS (SELECT k, s, g.n, item_id FROM g JOIN p USING (win)),
h AS (SELECT k, count(DISTINCT word) AS n_hit FROM (SELECT k, unnest(range(s, s + n)) AS word FROM o) GROUP BY 1),
t AS (SELECT k, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS items FROM o GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated FROM d LEFT JOIN h USING (k) LEFT JOIN t USING (k)"""
