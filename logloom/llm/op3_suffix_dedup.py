"""Suffix-array deduplication: difference-cover blockwise construction.

Every 50-byte string that also starts in a document with a smaller id is removed. The suffixes of the corpus are
never sorted as a whole:

1. Documents are packed into blocks of bounded size (a written table); equal texts of a block are kept once.
2. Suffixes are dealt out by the least hash of the 20-byte strings in their first 50 bytes, so equal 50-byte prefixes go to
   one part and neighbouring suffixes mostly do, too. Blocks tell the hashes of their runs of suffixes, packed; those
   that a single document holds are dropped, since their suffixes can't repeat.
3. Blocks ship the stretches of text whose suffixes are left, each distinct stretch once with its smallest document id.
   A hash with very many stretches is dealt out by the hash of each suffix's 50 bytes instead.
4. A task builds the suffix array of its part blockwise. The ranks of a difference-cover sample modulo 31 are computed first;
   then suffix buckets, ranges of the first two bytes, are sorted one at a time by 30 bytes, and longer ties are resolved by
   the sample's ranks: for any two places some shift below 31 takes both into the sample, so one look at two ranks compares
   them. Only one bucket's keys are held at a time. Neighbours in the sorted order that share 50 bytes form a class, and its
   smallest document id goes back to the blocks.
5. Blocks mark the places that begin such a string and remove what they cover.

Edge cases: a null text counts as empty; a null id is larger than all others; rows that repeat an id never remove
anything from each other; an empty table gives no rows; other columns are ignored; documents of any length fit, as one block.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

LENGTH, SEED = 50, 20
#: A perfect difference cover modulo 31.
CYCLE, COVER = 31, (1, 5, 11, 24, 25, 27)
BLOCK_BYTES, PART_BYTES, HOT, RUN = 3_000_000, 4_000_000, 20_000, 64
#: Suffixes of one suffix bucket, unless more begin with the same two bytes.
BUCKET = 1 << 18
#: Places of a block that are hashed at a time, so that the arrays stay in the processor's cache.
STRIP = 1 << 15
LAST = np.iinfo(np.int64).max
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD)]


def _shift_table() -> np.ndarray:
    """For two residues, the smallest shift that takes both into the cover."""
    cover = set(COVER)
    return np.array([[next(s for s in range(CYCLE) if (a + s) % CYCLE in cover and (b + s) % CYCLE in cover) for b in range(CYCLE)] for a in range(CYCLE)])


SHIFT = _shift_table()


def packed(data: np.ndarray | bytes) -> bytes:
    return zstandard.compress(data if isinstance(data, bytes) else data.tobytes(), 3)


def unpacked(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), kind)


def words8(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as an integer."""
    return np.ndarray((max(0, len(text) - 7),), "<u8", text, 0, (1,)).copy()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _K[3]
    return x ^ (x >> np.uint64(29))


def least_hashes(text: np.ndarray) -> np.ndarray:
    """For each place the least hash of the 20-byte strings within its first 50 bytes."""
    w, n = LENGTH - SEED + 1, len(text) - LENGTH + 1
    out = np.empty(n, np.uint64)
    for lo in range(0, n, STRIP):
        hi = min(lo + STRIP, n)
        b = words8(text[lo : hi + LENGTH])
        m = hi - lo + w - 1
        low, have = mixed(b[:m] * _K[0] + (b[8 : 8 + m] ^ (b[12 : 12 + m] * _K[2])) * _K[1]), 1
        while 2 * have <= w:
            low = np.minimum(low[:-have], low[have:])
            have *= 2
        out[lo:hi] = np.minimum(low[: hi - lo], low[w - have : w - have + hi - lo])
    return out


class Runs:
    """Runs of neighbouring suffixes with one least hash in a block: start, count, hash and document, found anew from the text each time."""

    def __init__(self, text: np.ndarray, ends: np.ndarray):
        self.start = self.count = self.doc = np.zeros(0, np.int64)
        self.seed = np.zeros(0, np.uint64)
        if len(text) < LENGTH + 8:
            return
        low = least_hashes(text)
        new = np.empty(len(low), bool)
        new[0] = True
        np.not_equal(low[1:], low[:-1], out=new[1:])
        begin = np.r_[0, ends[:-1]]
        new[begin[begin < len(low)]] = True
        last = np.maximum(ends - LENGTH + 1, begin)  # the first place of each document whose 50 bytes leave it
        new[last[last < len(low)]] = True
        at = np.flatnonzero(new)
        size = np.diff(np.r_[at, len(low)])
        if (size > RUN).any():  # long runs of one byte or the like are cut
            n = -(-size // RUN)
            at = np.repeat(at, n) + RUN * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
            size = np.diff(np.r_[at, len(low)])
        doc = np.searchsorted(ends, at, "right")
        good = at < last[np.minimum(doc, len(ends) - 1)]
        self.start, self.count, self.doc = at[good], size[good], doc[good]
        self.seed = mixed(low[self.start] + _K[2])

    def key(self, parts: int) -> np.ndarray:
        """Part and 32 more bits of the hash; a rare coincidence only ships a stretch too many."""
        low = (self.seed & np.uint64(0xFFFFFFFF)) % np.uint64(parts)
        return (low << np.uint64(32) | self.seed >> np.uint64(32)).astype(np.int64)


def ordered(words: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """Stable order of places by their first `depth` bytes: sorts by digits of whole bytes, each with the place in the order so far behind it.
    words: the eight bytes from each place of the text on, the first one in the highest bits."""
    bits = max(1, int(len(places)).bit_length())
    take = min(8, (64 - bits) // 8)
    order, mask = np.arange(len(places)), np.uint64((1 << bits) - 1)
    for at in range(depth - take, -take, -take):
        lo = max(at, 0)
        digit = words[places[order] + lo] >> np.uint64(64 - 8 * (at + take - lo))
        key = digit << np.uint64(bits) | np.arange(len(places), dtype=np.uint64)
        key.sort()
        order = order[(key & mask).astype(np.int64)]
    return order


def sample_ranks(words: np.ndarray, same, places: np.ndarray, n: int) -> np.ndarray:
    """Ranks, to a depth of LENGTH bytes, of the difference-cover sample's places less than CYCLE behind one of `places`; 0 elsewhere."""
    sample = (np.arange(0, n, CYCLE)[:, None] + np.array(COVER)).ravel()
    near = np.zeros(n + CYCLE + 1, np.int32)
    near[places] += 1
    near[places + CYCLE] -= 1
    near = np.cumsum(near) > 0
    sample = sample[near[np.minimum(sample, n)] & (sample < n)]
    by = sample[ordered(words, sample, LENGTH)]
    rank = np.zeros(n + CYCLE, np.int32)
    rank[by] = np.cumsum(np.r_[False, ~same(by[1:], by[:-1], (0, 8, 16, 24, 32, 40, 42))])
    return rank


def suffix_classes(text: np.ndarray, places: np.ndarray, bucket: int = BUCKET) -> tuple[np.ndarray, np.ndarray]:
    """Sorts the suffixes at `places`; returns their order and the class of each sorted one, equal where 50 bytes are.

    `text` must run on for at least 2 * LENGTH bytes behind the last place.
    """
    words = words8(text).byteswap()
    same = lambda x, y, offsets: np.logical_and.reduce([words[x + o] == words[y + o] for o in offsets])
    rank = sample_ranks(words, same, places, len(text) - LENGTH - 8)
    head = (words[places] >> np.uint64(48)).astype(np.int64)
    # Suffix buckets: ranges of the first two bytes with about `bucket` suffixes each, sorted one at a time.
    filled = np.cumsum(np.bincount(head, minlength=1 << 16))
    of = ((filled - 1) // bucket)[head]
    by = np.argsort(of.astype(np.uint16), kind="stable") if of.max(initial=0) < 1 << 16 else np.argsort(of, kind="stable")
    cut = np.r_[0, np.cumsum(np.bincount(of))] if len(of) else np.zeros(1, np.int64)
    order, fresh = by.copy(), np.ones(len(places), bool)
    for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist()):
        if lo == hi:
            continue
        own = by[lo:hi]
        own = own[ordered(words, places[own], CYCLE - 1)]
        p = places[own]
        tie = same(p[1:], p[:-1], (0, 8, 16, 22))
        group = np.cumsum(np.r_[True, ~tie]) - 1
        # Three-way partitioning of all tie groups at once, each around its first suffix, by the ranks of the sample.
        open_ = np.flatnonzero(np.bincount(group)[group] > 1)
        label, mine = group[open_], own[open_]
        while len(mine):
            q = places[mine]
            first = np.r_[True, label[1:] != label[:-1]]
            pivot = q[np.flatnonzero(first)][np.cumsum(first) - 1]
            s = SHIFT[q % CYCLE, pivot % CYCLE]
            side = np.sign(rank[q + s].astype(np.int64) - rank[pivot + s])
            if not side.any():
                break
            sub = np.lexsort((side, label))
            mine, label, side = mine[sub], label[sub], side[sub]
            own[open_] = mine
            new = np.r_[True, (label[1:] != label[:-1]) | (side[1:] != side[:-1])]
            label = np.cumsum(new) - 1
            left = (side != 0) & (np.bincount(label)[label] > 1)
            mine, open_, label = mine[left], open_[left], label[left]
        order[lo:hi] = own
        p, near = places[own], np.flatnonzero(np.r_[False, tie])
        fresh[lo + near] = ~same(p[near], p[near - 1], (0, 8, 16, 24, 32, 40, 42))
    return order, np.cumsum(fresh) - 1


def within(count: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... for each of so many consecutive rows."""
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


_BASES = 0x5851F42D4C957F2D, 0x9E3779B97F4A7C15


def stretch_hashes(text: np.ndarray, start: np.ndarray, size: np.ndarray, base: int = _BASES[0]) -> np.ndarray:
    """Polynomial hashes of stretches, from running sums over the text. Sizes must stay below 1024, where powers of two don't degenerate."""
    power, inverse = np.full(len(text), base, np.uint64), np.full(len(text), pow(base, -1, 1 << 64), np.uint64)
    power[:1] = inverse[:1] = 1
    total = np.r_[np.zeros(1, np.uint64), np.cumsum((text.astype(np.uint64) + np.uint64(1)) * np.cumprod(power))]
    return (total[start + size] - total[start]) * np.cumprod(inverse)[start]


def distinct(text: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For consecutive stretches of the text: which are the first of their kind, and each one's kind, by size and 128 bits of hash."""
    start = np.cumsum(size) - size
    h, g = (stretch_hashes(text, start, size, base) for base in _BASES)
    by = np.lexsort((g, h + size.astype(np.uint64)))
    other = lambda x: x[by][1:] != x[by][:-1]
    fresh = np.r_[True, other(h) | other(g) | other(size)]
    kind = np.empty(len(by), np.int64)
    kind[by] = np.cumsum(fresh) - 1
    return by[fresh], kind


class Shipment:
    """What a block ships. start, count, doc: runs, or single suffixes of hot hashes; at: each one's distinct stretch; u_start, u_size, u_doc, u_part: distinct
    stretches in the order of their parts, each with its first document."""

    def __init__(self, text: np.ndarray, runs: Runs, wanted: np.ndarray, hot: np.ndarray, parts: int):
        key = runs.key(parts)
        at = np.minimum(np.searchsorted(wanted, key), max(0, len(wanted) - 1))
        own = np.flatnonzero(wanted[at] == key) if len(wanted) else np.zeros(0, np.int64)
        start, count, doc, part, seed = runs.start[own], runs.count[own], runs.doc[own], key[own] >> 32, runs.seed[own]
        very = hot[at[own]] if len(wanted) else np.zeros(0, bool)
        if very.any():
            n = count[very]
            s = np.repeat(start[very], n) + within(n)
            b = words8(text)
            h = mixed(sum(b[s + o] * k for o, k in zip((0, 8, 16, 24), _K)) ^ mixed(sum(b[s + o] * k for o, k in zip((32, 40, 42), _K))))
            more = (s, np.ones(len(s), np.int64), np.repeat(doc[very], n), (h % np.uint64(parts)).astype(np.int64), h)
            start, count, doc, part, seed = (np.concatenate([x[~very], y]) for x, y in zip((start, count, doc, part, seed), more))
            by = np.argsort(start, kind="stable")
            start, count, doc, part, seed = start[by], count[by], doc[by], part[by], seed[by]
        self.start, self.count, self.doc = start, count, doc
        size = count + LENGTH - 1
        # Equal stretches have one hash, least hash, size and part; the first document comes first, since starts ascend.
        h = stretch_hashes(text, start, size) ^ mixed(seed + size.astype(np.uint64)) if len(start) else seed
        by = np.lexsort((h, part))
        other = lambda x: x[by][1:] != x[by][:-1]
        fresh = np.r_[True, other(h) | other(seed) | other(size) | other(part)] if len(by) else np.zeros(0, bool)
        self.at = np.empty(len(by), np.int64)
        self.at[by] = np.cumsum(fresh) - 1
        first = by[fresh]
        self.u_start, self.u_size, self.u_doc, self.u_part = start[first], size[first], doc[first], part[first]

    def parts(self, text: np.ndarray, ids: np.ndarray):
        """(part, sizes, ids, bytes) of each part's distinct stretches."""
        data = text[np.repeat(self.u_start, self.u_size) + within(self.u_size)]
        cut = np.r_[np.flatnonzero(np.r_[True, self.u_part[1:] != self.u_part[:-1]]), len(self.u_part)] if len(self.u_part) else []
        place = np.r_[0, np.cumsum(self.u_size)]
        for lo, hi in zip(cut[:-1], cut[1:]):
            yield int(self.u_part[lo]), self.u_size[lo:hi].astype("<u2"), ids[self.u_doc[lo:hi]].astype("<i8"), data[place[lo] : place[hi]]

    def smallest(self, answers: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place, document and smallest id of every shipped suffix; answers: packed ids of each part's suffixes in the order they were shipped in."""
        if not len(self.start):
            return self.start, self.doc, self.start
        told = np.concatenate([unpacked(answers[g], "<i8") for g in np.unique(self.u_part).tolist()])
        n = self.u_size - LENGTH + 1
        inner = within(self.count)
        return np.repeat(self.start, self.count) + inner, np.repeat(self.doc, self.count), told[np.repeat((np.cumsum(n) - n)[self.at], self.count) + inner]


def blocks_of(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """block, ids of its distinct texts, their ends, the packed texts, and (id, place) of the other copies."""

    def run(batches):
        number, rows, size = TaskContext.get().partitionId() << 32, [], 0

        def emit():
            rows.sort(key=lambda r: r[0])
            first: dict[bytes, int] = {}
            ids, texts, copies = [], [], []
            for i, t in rows:
                at = first.setdefault(t, len(ids))
                if at == len(ids):
                    ids.append(i)
                    texts.append(t)
                else:
                    copies += [i, at]
            cols = [[number], [np.array(ids, "<i8").tobytes()], [np.cumsum([len(t) for t in texts]).astype("<i8").tobytes()], [packed(b"".join(texts))], [np.array(copies, "<i8").tobytes()], [sum(map(len, texts))]]
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["block", "ids", "ends", "texts", "copies", "bytes"])

        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    rows.append((LAST if i is None else i, (t or "").encode("utf-8", "surrogatepass")))
                    size += len(rows[-1][1]) + 64
                    if size >= block_bytes:
                        yield emit()
                        number, rows, size = number + 1, [], 0
        if rows:
            yield emit()

    return docs.mapInArrow(run, "block bigint, ids binary, ends binary, texts binary, copies binary, bytes bigint")


def opened(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """text (with room behind its end), ids and ends of a block."""
    text = np.frombuffer(zstandard.decompress(row.texts) + bytes(2 * LENGTH), np.uint8)
    return text, np.frombuffer(row.ids, "<i8"), np.frombuffer(row.ends, "<i8")


def wanted_of(back: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys that repeat across documents, and whether each is hot."""
    if not len(back):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    keys = np.concatenate([unpacked(x, "<i8") for x in back["keys"]])
    hot = np.concatenate([unpacked(x, "?") for x in back["hot"]])
    by = np.argsort(keys)
    return keys[by], hot[by]


def cut_apart(text: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """gone and all other bytes of those UTF-8 characters that lose a byte."""
    character = np.cumsum((text & 0xC0) != 0x80)
    return np.bincount(character, gone, minlength=len(text) + 1)[character] > 0


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, part_bytes: int = PART_BYTES, hot_count: int = HOT, texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 per row. Where texts is set, also kept_text: the kept bytes without those
    characters of which a byte is removed, so that each cut lies between two characters; all others stay as they are."""
    blocks = written(blocks_of(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")), block_bytes))
    parts = int(max(64, -(-(blocks.agg(F.sum("bytes")).first()[0] or 0) // part_bytes)))

    def tell(batches):
        for batch in batches:
            for row in batch.to_pandas().itertuples():
                text, _, ends = opened(row)
                runs = Runs(text[: len(text) - 2 * LENGTH + 8], ends)
                key, doc = runs.key(parts), runs.doc
                by = np.lexsort((doc, key))
                key, doc = key[by], doc[by]
                fresh = np.r_[True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])] if len(key) else np.zeros(0, bool)
                key, count = np.unique(key[fresh], return_counts=True)
                cut = np.searchsorted(key >> 32, np.arange(parts + 1))
                some = np.flatnonzero(np.diff(cut))
                low, count = (key & 0xFFFFFFFF).astype("<u4"), np.minimum(count, 255).astype(np.uint8)
                cols = [[int(g) for g in some], [row.block] * len(some), [low[cut[g] : cut[g + 1]].tobytes() for g in some], [packed(count[cut[g] : cut[g + 1]]) for g in some]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int32(), pa.int64(), pa.binary(), pa.binary()])], names=["part", "block", "low", "counts"])

    def repeated(f: pd.DataFrame) -> pd.DataFrame:
        low = np.concatenate([np.frombuffer(x, "<u4") for x in f.low])
        count = np.concatenate([unpacked(x, np.uint8) for x in f.counts]).astype(np.int64)
        block = np.repeat(np.arange(len(f)), [len(x) // 4 for x in f.low])
        by = np.argsort(low, kind="stable")
        low, count, block = low[by], count[by], block[by]
        at = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
        total = np.repeat(np.add.reduceat(count, at), np.diff(np.r_[at, len(low)]))
        keep = total > 1
        low, block, hot = low[keep].astype(np.int64), block[keep], total[keep] > hot_count
        by = np.argsort(block, kind="stable")
        low, block, hot = low[by], block[by], hot[by]
        cut, base = np.searchsorted(block, np.arange(len(f) + 1)), int(f.part.iloc[0]) << 32
        some = np.flatnonzero(np.diff(cut))
        return pd.DataFrame({"block": f.block.to_numpy()[some], "keys": [packed((low[cut[k] : cut[k + 1]] + base).astype("<i8")) for k in some], "hot": [packed(hot[cut[k] : cut[k + 1]]) for k in some]})

    back = written(blocks.select("block", "ids", "ends", "texts").mapInArrow(tell, "part int, block bigint, low binary, counts binary").groupBy("part").applyInPandas(repeated, "block bigint, keys binary, hot binary"))

    def ship(own: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for row in own.itertuples():
            text, ids, ends = opened(row)
            sent = Shipment(text, Runs(text[: len(text) - 2 * LENGTH + 8], ends), *wanted_of(back), parts)
            rows += [(g, row.block, sizes.tobytes(), packed(first), packed(data)) for g, sizes, first, data in sent.parts(text, ids)]
        return pd.DataFrame(rows, columns=["part", "block", "sizes", "ids", "data"])

    def classify(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("block")
        size = np.concatenate([np.frombuffer(x, "<u2") for x in f.sizes]).astype(np.int64)
        ids = np.concatenate([unpacked(x, "<i8") for x in f.ids])
        text = np.frombuffer(b"".join(zstandard.decompress(x) for x in f["data"]), np.uint8)
        # Stretches that several blocks ship are sorted once, under their smallest id.
        one, kind = distinct(text, size)
        least = np.full(len(one), LAST)
        np.minimum.at(least, kind, ids)
        start = np.cumsum(size) - size
        text = np.r_[text[np.repeat(start[one], size[one]) + within(size[one])], np.zeros(3 * LENGTH, np.uint8)]
        m = size[one] - LENGTH + 1
        place = np.repeat(np.cumsum(size[one]) - size[one], m) + within(m)
        order, group = suffix_classes(text, place)
        smallest = np.minimum.reduceat(np.repeat(least, m)[order], np.flatnonzero(np.r_[True, group[1:] != group[:-1]]))
        answer = np.empty(len(place), np.int64)
        answer[order] = smallest[group]
        n = size - LENGTH + 1
        first = answer[np.repeat((np.cumsum(m) - m)[kind], n) + within(n)]
        rows, at, unit = [], 0, 0
        for block, sizes in zip(f.block, f.sizes):
            k = len(sizes) // 2
            m = int(n[unit : unit + k].sum())
            rows.append((f.part.iloc[0], block, packed(first[at : at + m].astype("<i8"))))
            at, unit = at + m, unit + k
        return pd.DataFrame(rows, columns=["part", "block", "first"])

    stretches = blocks.select("block", "ids", "ends", "texts").groupBy("block").cogroup(back.groupBy("block")).applyInPandas(ship, "part int, block bigint, sizes binary, ids binary, data binary")
    firsts = stretches.groupBy("part").applyInPandas(classify, "part int, block bigint, first binary")
    told = firsts.select("block", "part", "first", F.lit(None).cast("binary").alias("keys"), F.lit(None).cast("binary").alias("hot")).unionByName(back.select("block", F.lit(None).cast("int").alias("part"), F.lit(None).cast("binary").alias("first"), "keys", "hot"))

    def remove(own: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for row in own.itertuples():
            text, ids, ends = opened(row)
            runs = Runs(text[: len(text) - 2 * LENGTH + 8], ends)
            sent = Shipment(text, runs, *wanted_of(told[told["keys"].notna()]), parts)
            answers = told[told["first"].notna()]
            place, doc, first = sent.smallest(dict(zip(answers["part"].astype(int).tolist(), answers["first"])))
            place = place[first < ids[doc]]
            mark = np.zeros(len(text) + LENGTH + 1, np.int32)
            mark[place] += 1  # a place begins one suffix alone
            mark[place + LENGTH] -= 1
            gone = np.cumsum(mark)[: len(text)] > 0
            begin = np.r_[0, ends[:-1]]
            done = []
            for i, a, b in zip(ids.tolist(), begin.tolist(), ends.tolist()):
                g = gone[a:b]
                kept = text[a:b][~g].tobytes()
                whole = text[a:b][~cut_apart(text[a:b], g)].tobytes().decode("utf-8", "replace") if texts else None
                done.append((b - a, int(g.sum()), int(g[:1].sum() + (g[1:] & ~g[:-1]).sum()), whole, kept))
                rows.append((i, *done[-1]))
            copies = np.frombuffer(row.copies, "<i8").reshape(-1, 2).tolist()
            for i, at in copies:
                size = done[at][0]
                rows.append((i, *(done[at] if i == ids[at] or size < LENGTH else (size, size, 1, "" if texts else None, b""))))
        return pd.DataFrame([(i, *x, hashlib.sha256(k).hexdigest()) for i, *x, k in rows], columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_text", "kept_sha256"])

    out = blocks.drop("bytes").groupBy("block").cogroup(told.groupBy("block")).applyInPandas(remove, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_text string, kept_sha256 string")
    out = out.withColumn("doc_id", F.when(F.col("doc_id") != int(LAST), F.col("doc_id")))
    return out if texts else out.drop("kept_text")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))
