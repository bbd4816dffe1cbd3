"""N-gram Jaccard join with set-relation skipping.

A document's set holds its distinct four-word shingles as 64-bit hashes; equal sets are one class. All sets are ordered by
one global order, rare shingles first: blocks of documents tell parts of the hash range which shingles they hold, the parts
count them over all documents and tell the blocks back, so the order follows true document frequencies, in steps of an eighth of
a power of two, whatever the size of the input. Two sets of Jaccard similarity t share a shingle among the first n - ceil(t n) + 1
of each, so an inverted list over those prefixes holds every candidate. A shingle of a single set can't be shared: it keeps
its place but enters no list, and a document whose prefix holds nothing else goes no further.

Lists are cut into blocks by size band: a set of n shingles lies in bands floor(log n / log 1/t) and the next one up, so sets of
reachable size share a block and all others are skipped. Of the next band, only places early enough in the order are kept: a
set whose first common shingle is at place i shares at most n - i, which bounds the size of the partner. The smallest id of a
block leads it. Blocks with one leader are one group; a set without a partner that its size and the shared part of their prefixes
leave within reach leaves the group before any text is read. A group is answered from its leader: with d = 1 - Jaccard, a
metric, the partners of x are among the sets y with |d(x, leader) - d(y, leader)| <= 1 - t, a stretch of the group sorted by that
distance; all with d(x, leader) + d(y, leader) <= 1 - t are partners without a look, and what lies between is counted exactly. Groups
of over `block` sets are dealt into sub-blocks, each pair of which is a group of its own. A link counts in the group of the
smallest leader that both its sets share, so counts of links and local roots leave a group; components follow from the roots.

Edge cases: a null text or one without words has an empty set and links with nothing; fewer than four words are one
shingle; repeated rows each give a row; a null id keeps its row with null links and
component and counts as no one's partner; an empty table gives no rows; other
columns are ignored. A hash stands for its shingle: two shingles collide with a chance of 2^-64.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, dropped, table, written

PERCENT, WORDS, BLOCK, SALTS = 85, 4, 1500, 16
#: Bytes of text in a block, and of text whose shingles one part counts.
BLOCK_BYTES, PART_BYTES = 3_000_000, 12_000_000
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


class Shingler(dict):
    """Hashes of words, filled on demand and bounded, and the sets made from them."""

    def __init__(self, words: int = WORDS):
        super().__init__()
        self.n = words

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def set_of(self, text: str | None) -> np.ndarray:
        """Sorted distinct shingle hashes (uint64)."""
        return self.set_of_bytes((text or "").encode("utf-8", "surrogatepass"))

    def set_of_bytes(self, text: bytes) -> np.ndarray:
        words = text.translate(_LOWER).split()
        if not words:
            return np.zeros(0, np.uint64)
        if len(words) < self.n:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
        w = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        m = len(w) - self.n + 1
        h = np.zeros(m, np.uint64)
        for k in range(self.n):
            h = (h ^ (h >> np.uint64(29))) * _ODD[k % 4] + w[k : k + m]
        h = (h ^ (h >> np.uint64(32))) * _ODD[4]
        return np.unique(h ^ (h >> np.uint64(29)))


def planes(x: np.ndarray) -> bytes:
    """Ascending 32-bit numbers, packed as differences whose bytes stand apart."""
    step = np.diff(x, prepend=np.uint32(0)).astype("<u4")
    return zstandard.compress(np.ascontiguousarray(step.view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def from_planes(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(raw.T).view("<u4").ravel(), dtype=np.uint32)


def keys_of(sets: list[np.ndarray], parts: int) -> np.ndarray:
    """Part and 32 more bits of each shingle's hash; shingles that coincide only count as more frequent."""
    h = np.concatenate([*sets, np.zeros(0, np.uint64)])
    return (h & np.uint64(0xFFFFFFFF)) % np.uint64(parts) << np.uint64(32) | h >> np.uint64(32)


BLOCKS = "block bigint, docs array<struct<doc_id:bigint,n:bigint,sig:binary>>, reps array<bigint>, ends binary, texts binary, part int, low binary, counts binary"


def blocks_of(docs: DataFrame, words: int, parts: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Two kinds of rows. Blocks: each document's id, set size and signature, then the smallest id and the text of each distinct set.
    With a part: the block's shingles of that part and in how many of its sets each is."""
    struct = pa.struct([("doc_id", pa.int64()), ("n", pa.int64()), ("sig", pa.binary())])
    schema = pa.schema([("block", pa.int64()), ("docs", pa.list_(struct)), ("reps", pa.list_(pa.int64())), ("ends", pa.binary()), ("texts", pa.binary()), ("part", pa.int32()), ("low", pa.binary()), ("counts", pa.binary())])

    def run(batches):
        number, rows, size, shingler = TaskContext.get().partitionId() << 32, [], 0, Shingler(words)

        def emit():
            told, least = [], {}
            for i, t in rows:
                own = shingler.set_of_bytes(t)
                sig = xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None
                told.append((i, len(own), sig))
                if sig is not None and i is not None and (sig not in least or i < least[sig][0]):
                    least[sig] = i, t, own
            reps = list(least.values())
            key, count = np.unique(keys_of([x for *_, x in reps], parts), return_counts=True)
            part, low, count = (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.uint32), np.minimum(count, 65_535).astype("<u2")
            cut = [*np.flatnonzero(np.r_[True, part[1:] != part[:-1]]).tolist(), len(part)] if len(part) else []
            ends = np.cumsum([len(t) for _, t, _ in reps]).astype("<i8")
            out = [{"block": number, "docs": [dict(zip(("doc_id", "n", "sig"), x)) for x in told], "reps": [i for i, *_ in reps], "ends": ends.tobytes(), "texts": zstandard.compress(b"".join(t for _, t, _ in reps), 3)}]
            out += [{"block": number, "part": int(part[a]), "low": planes(low[a:b]), "counts": zstandard.compress(count[a:b].tobytes(), 1)} for a, b in zip(cut, cut[1:])]
            return pa.RecordBatch.from_pylist(out, schema)

        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                cut = batch.slice(lo, 500)
                for i, t in zip(cut.column(0).to_pylist(), cut.column(1).to_pylist()):
                    rows.append((i, (t or "").encode("utf-8", "surrogatepass")))
                    size += len(rows[-1][1]) + 64
                    if size >= block_bytes:
                        yield emit()
                        number, rows, size = number + 1, [], 0
        if rows:
            yield emit()

    return docs.mapInArrow(run, BLOCKS)


def levels(f: pd.DataFrame) -> pd.DataFrame:
    """Frequency levels of one part's shingles for each block, in the order in which the block told them; 0 for those of a single set."""
    low = [from_planes(x) for x in f.low]
    size = np.array([len(x) for x in low])
    low, count = np.concatenate(low), np.concatenate([np.frombuffer(zstandard.decompress(x), "<u2") for x in f.counts]).astype(np.int64)
    by = np.argsort(low)
    at = np.flatnonzero(np.r_[True, low[by][1:] != low[by][:-1]])
    total = np.add.reduceat(count[by], at)
    level = np.empty(len(low), np.uint8)
    level[by] = np.repeat(np.minimum(np.rint(8 * np.log2(total)), 255).astype(np.uint8), np.diff(np.r_[at, len(low)]))
    cut = np.r_[0, np.cumsum(size)].tolist()
    return pd.DataFrame({"block": f.block, "part": f.part, "level": [zstandard.compress(level[a:b].tobytes(), 1) for a, b in zip(cut, cut[1:])]})


PREFIXES = "doc_id bigint, n bigint, held bigint, band int, up bigint, sig binary, pos array<int>, token array<bigint>, packed binary"


def prefixes(own: pd.DataFrame, told: pd.DataFrame, words: int, parts: int, percent: int) -> pd.DataFrame:
    """For each set of a block whose prefix holds a shared shingle: prefix length, places and shingles shared with others, and the packed text."""
    out, shingler = [], Shingler(words)
    for row in own.itertuples():
        data, ends = zstandard.decompress(row.texts), np.frombuffer(row.ends, "<i8")
        texts = [data[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]
        sets = [shingler.set_of_bytes(t) for t in texts]
        if not sets:
            continue
        told = told.sort_values("part")
        level = np.frombuffer(b"".join(zstandard.decompress(x) for x in told.level), np.uint8)
        level = level[np.unique(keys_of(sets, parts), return_inverse=True)[1].ravel()]
        at = 0
        for i, t, s in zip(row.reps, texts, sets):
            rank, n = level[at : at + len(s)], len(s)
            at += n
            held = prefix_length(n, percent)
            if np.count_nonzero(rank == 0) >= held:
                continue
            first = np.lexsort((s, rank))[:held]
            pos = np.flatnonzero(rank[first])
            out.append((i, n, held, band(n, percent), reach(n, percent), xxhash.xxh3_128_digest(s.tobytes()), pos.astype(np.int32), s[first[pos]].view(np.int64), zstandard.compress(t, 3)))
    return pd.DataFrame(out, columns=["doc_id", "n", "held", "band", "up", "sig", "pos", "token", "packed"])


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def linked(a: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    return 100 * a >= percent * (na + nb - a)


def partners(prefixes: list[np.ndarray], n: np.ndarray, size: np.ndarray, percent: int) -> np.ndarray:
    """Whether each set of a group has a partner within reach by size n and by what their prefixes, of `size` places, share."""
    near = np.zeros(len(prefixes), bool)
    token, own = np.unique(np.concatenate(prefixes), return_inverse=True)
    row = np.repeat(np.arange(len(prefixes)), [len(x) for x in prefixes])
    shared = np.bincount(own, minlength=len(token)) > 1
    keep = shared[own]
    row, col, width = row[keep], (np.cumsum(shared) - 1)[own[keep]], int(shared.sum())
    for lo in range(0, len(prefixes), 512):
        a = np.arange(lo, min(lo + 512, len(prefixes)))
        common = np.zeros((len(a), len(prefixes)), np.float32)
        for c0 in range(0, width, 2048):
            on = (col >= c0) & (col < c0 + 2048)
            m = np.zeros((len(prefixes), min(2048, width - c0)), np.float32)
            m[row[on], col[on] - c0] = 1
            common += m[a] @ m.T
        most = np.maximum((n - size)[a][:, None], (n - size)[None, :]) + common
        ok = (100 + percent) * most >= percent * (n[a][:, None] + n[None, :]) - 0.5
        ok &= 100 * np.minimum(n[a][:, None], n[None, :]) >= percent * np.maximum(n[a][:, None], n[None, :])
        ok &= common > 0
        ok[np.arange(len(a)), a] = False
        near[a] = ok.any(1)
    return near


def band(n: int, percent: int = PERCENT) -> int:
    return math.floor(math.log(n) / math.log(100 / percent) + 1e-9)


def reach(n: int, percent: int = PERCENT) -> int:
    """How many places of the prefix may be the first common one with a set of the next size band."""
    top = band(n, percent)
    return next((i for i in range(prefix_length(n, percent)) if (m := (n - i) * (100 + percent) // percent - n) < n or band(m, percent) == top), prefix_length(n, percent))


class Common:
    """Counts of what rows share, from lists of values per row; values that a single row holds are left out."""

    def __init__(self, lists: list[np.ndarray]):
        value, own = np.unique(np.concatenate(lists), return_inverse=True)
        row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        shared = np.bincount(own, minlength=len(value)) > 1
        keep = shared[own]
        by = np.argsort(own[keep], kind="stable")
        self.row, self.col, self.width = row[keep][by], (np.cumsum(shared) - 1)[own[keep]][by], int(shared.sum())

    def count(self, a: int, b: int, first: int, last: int, step: int = 4096) -> np.ndarray:
        """Rows a to b against rows first to last."""
        got = np.zeros((b - a, last - first), np.float32)
        for c0 in range(0, self.width, step):
            lo, hi = np.searchsorted(self.col, [c0, c0 + step])
            row, col = self.row[lo:hi], self.col[lo:hi] - c0
            left, right = (row >= a) & (row < b), (row >= first) & (row < last)
            if left.any() and right.any():
                m1, m2 = np.zeros((b - a, min(step, self.width - c0)), np.float32), np.zeros((last - first, min(step, self.width - c0)), np.float32)
                m1[row[left] - a, col[left]] = 1
                m2[row[right] - first, col[right]] = 1
                got += m1 @ m2.T
        return np.rint(got).astype(np.int64)


def answer_group(sets: list[np.ndarray], lead: int, sub: np.ndarray | None, weight: np.ndarray, earlier: list[np.ndarray], percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Weighted count of links and root (a place) of each set of a group; -1 as count where it has no link here. lead: the leader's
    place; sub: for pairs of sub-blocks, only pairs across them count; earlier: the smaller leaders in whose groups a set is, too.

    What x and y share is derived from what y shares with the leader l, which is counted once: |x & y| = |l & y| - |l - x| + |dx & dy|,
    where dx and dy are the differences of x and y from l, taken both ways. Near the leader these are short."""
    size = np.array([len(s) for s in sets])
    inter = np.array([len(np.intersect1d(s, sets[lead], assume_unique=True)) if k != lead else len(s) for k, s in enumerate(sets)])
    distance = 1 - inter / (size + size[lead] - inter)
    order = np.argsort(distance, kind="stable")
    d, n, w, far = distance[order], size[order], weight[order], 1 - percent / 100
    held, gone = inter[order], size[lead] - inter[order]
    s = None if sub is None else sub[order]
    differences, others = Common([np.setxor1d(sets[k], sets[lead], assume_unique=True) for k in order]), Common([earlier[k] for k in order])
    count, linked_here, root = np.zeros(len(order), np.int64), np.zeros(len(order), bool), np.arange(len(order))
    for a in range(0, len(order), 256):
        b = min(a + 256, len(order))
        # Later places only, since pairs are symmetric; sets up to `sure` are partners of all of these by way of the leader.
        last = int(np.searchsorted(d, d[b - 1] + far + 1e-9, "right"))
        sure = min(max(int(np.searchsorted(d, far - d[b - 1] - 1e-9)), a), last)
        ok = np.ones((b - a, last - a), bool)
        shared = held[None, sure:last] - gone[a:b, None] + differences.count(a, b, sure, last)
        ok[:, sure - a :] = linked(shared, n[a:b, None], n[None, sure:last], percent)
        ok &= np.arange(a, last)[None, :] > np.arange(a, b)[:, None]
        if s is not None:
            ok &= (s[a:b, None] != s[None, a:last]) & (s[a:b, None] >= 0) & (s[None, a:last] >= 0)
        for i in np.flatnonzero(ok.any(1)):
            j = np.flatnonzero(ok[i]) + a
            linked_here[i + a] = linked_here[j] = True
            met = np.unique(np.append(root[j], root[i + a]))
            if len(met) > 1:
                root[np.isin(root, met)] = met[0]
        if others.width:
            ok &= others.count(a, b, a, last) == 0
        count[a:b] += ok @ w[a:last]
        count[a:last] += w[a:b] @ ok
    out, at = np.full(len(order), -1), np.empty(len(order), np.int64)
    out[order[linked_here]] = count[linked_here]
    at[order] = order[root]
    return out, at


def jaccard_components(docs: DataFrame, percent: int = PERCENT, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, group_rows: int = 1500) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links, the number of other documents linked with it, for every row."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    # The size of all texts only sets the number of parts.
    parts = int(max(64, -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART_BYTES)))
    told = written(blocks_of(docs, words, parts))
    rows = written(told.where("part IS NULL").select(F.explode("docs").alias("d")).select("d.*"))
    classes = rows.where("sig IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "sig").distinct().groupBy("sig").agg(F.min("doc_id").alias("rep"), F.count("*").alias("weight"))
    classes = written(classes)
    back = told.where("part IS NOT NULL").select("block", "part", "low", "counts").groupBy("part").applyInPandas(levels, "block bigint, part int, level binary")
    texts = told.where("part IS NULL").select("block", "reps", "ends", "texts").groupBy("block")
    found = texts.cogroup(back.groupBy("block")).applyInPandas(lambda own, told: prefixes(own, told, words, parts, percent), PREFIXES)
    # Index lists over the prefixes of one document per class.
    reps = written(found.join(classes.select(F.col("rep").alias("doc_id"), "sig"), ["doc_id", "sig"], "left_semi").dropDuplicates(["doc_id", "sig"]))
    dropped(told)
    # shape packs the size n, how many shingles lie behind the places that an index block holds, and whether it is the own band.
    shape = lambda rest, own: F.shiftleft("n", 32) + 2 * rest + own
    behind = F.col("n") - F.col("held")
    entries = reps.select("doc_id", shape(behind, 1).alias("low"), shape(F.col("n") - F.col("up"), 0).alias("high"), "band", "up", F.explode(F.arrays_zip("pos", "token")).alias("e")).select("doc_id", "low", "high", "band", "up", "e.*")
    lists = entries.groupBy("token").agg(F.count("*").alias("size")).where("size > 1").select("token")
    places = F.struct("band", F.col("low").alias("shape")), F.struct((F.col("band") + 1).alias("band"), F.col("high").alias("shape"))
    entries = entries.withColumn("at", F.when(F.col("pos") < F.col("up"), F.array(*places)).otherwise(F.array(places[0])))
    banded = written(entries.join(lists, "token").select("doc_id", "token", F.explode("at").alias("at")).select("doc_id", "token", "at.*"))
    leaders = banded.groupBy("token", "band").agg(F.min(F.struct("doc_id", "shape")).alias("lead"), F.count("*").alias("size")).where("size > 1")
    met = banded.join(leaders.select("token", "band", F.col("lead.doc_id").alias("lead"), F.col("lead.shape").alias("lead_shape")), ["token", "band"]).where("doc_id <> lead")
    # A leader with one other set is a plain pair. With c common shingles among the places both hold in the band of the larger, all
    # other common ones lie behind those places of one of the two; too few end the pair here.
    once = (F.col("shape").bitwiseOR(F.col("lead_shape")).bitwiseAND(1)) == 1
    n, rest = (lambda c: F.shiftright(c, 32)), (lambda c: F.shiftright(F.col(c).bitwiseAND(0xFFFFFFFF), 1))
    need = F.ceil(F.lit(percent) * (n("shape") + n("lead_shape")) / (100 + percent) - 1e-6)
    short = (need - F.greatest(rest("shape"), rest("lead_shape"))).cast("bigint")
    met_pairs = written(met.groupBy("doc_id", "lead").agg(F.count_if(once).alias("common"), F.max(F.when(once, short)).alias("short")))

    # One leader may have a large part of all pairs, so pairs meet their leader's count by leader and salt.
    def counted(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        groups = pairs.groupBy("lead").agg(F.count("*").alias("members"))
        salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return groups, pairs.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, ["lead", "salt"]).drop("salt")

    pairs = written(counted(met_pairs)[1].where((F.col("members") > 1) | (F.col("common") >= F.col("short"))).select("doc_id", "lead"))
    groups, placed = counted(pairs)
    subs = F.ceil(F.col("members") / block).cast("int").alias("subs")
    groups, placed = groups.select("lead", subs), placed.select("doc_id", "lead", subs)
    placed = placed.withColumn("sub", F.pmod(F.xxhash64("doc_id", "lead"), F.col("subs")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)))
    placed = placed.select("doc_id", F.struct("lead", F.least("sub", "other").alias("p"), F.greatest("sub", "other").alias("q"), "sub").alias("at"))
    own = groups.withColumn("p", F.explode(F.sequence(F.lit(0), F.col("subs") - 1))).withColumn("q", F.explode(F.sequence("p", F.col("subs") - 1)))
    placed = placed.unionByName(own.select(F.col("lead").alias("doc_id"), F.struct("lead", "p", "q", F.lit(-1).alias("sub")).alias("at")))
    n_groups = max(1, pairs.count() // group_rows)
    group_of = F.pmod(F.xxhash64("lead", "p", "q"), F.lit(n_groups))
    # First pass over the groups, with prefixes cut to 31 bits: sets without a partner within reach leave. Coincidences only keep more.
    first = reps.select("doc_id", "n", "held", F.transform("token", lambda t: F.shiftright(t, 33).cast("int")).alias("prefix")).join(placed.groupBy("doc_id").agg(F.collect_set("at").alias("ats")), "doc_id")
    first = first.select("doc_id", "n", "held", "prefix", F.explode("ats").alias("at")).select("doc_id", "n", "held", "prefix", "at.*").withColumn("g", group_of)

    def reachable(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["lead", "p", "q", "doc_id"], kind="stable").drop_duplicates(["lead", "p", "q", "doc_id"])
        key = f[["lead", "p", "q"]].to_numpy()
        cut = [*np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1)]).tolist(), len(f)]
        n, held, lead, keep = f.n.to_numpy(), f.held.to_numpy(), (f.doc_id == f.lead).to_numpy(), np.zeros(len(f), bool)
        prefixes = f.prefix.to_list()
        for lo, hi in zip(cut, cut[1:]):
            near = partners(prefixes[lo:hi], n[lo:hi], held[lo:hi], percent)
            keep[lo:hi] = near | (lead[lo:hi] & near.any())
        return f.loc[keep, ["doc_id", "lead", "p", "q", "sub"]]

    kept = first.groupBy("g").applyInPandas(reachable, "doc_id bigint, lead bigint, p int, q int, sub int")
    wanted = written(kept.groupBy("doc_id").agg(F.collect_set(F.struct("lead", "p", "q", "sub")).alias("ats")).join(classes.groupBy(F.col("rep").alias("doc_id")).agg(F.max("weight").alias("weight")), "doc_id"))
    # Texts are far smaller than sets of hashes once compressed, so they travel and groups make the sets anew.
    members = reps.select("doc_id", "packed").join(wanted, "doc_id").select("doc_id", "packed", "weight", F.array_distinct(F.transform("ats", lambda x: x["lead"])).alias("leads"), F.explode("ats").alias("at"))
    members = members.select("doc_id", "packed", "weight", "at.*", F.filter("leads", lambda x: x < F.col("at.lead")).alias("earlier"))
    members = members.withColumn("g", group_of)

    def answer(f: pd.DataFrame) -> pd.DataFrame:
        out, shingler, unpack = [], Shingler(words), zstandard.ZstdDecompressor()
        f = f.drop_duplicates(["lead", "p", "q", "doc_id"])
        made: dict[int, np.ndarray] = {}
        for i, x in zip(f.doc_id.tolist(), f.packed):
            if i not in made:
                made[i] = shingler.set_of_bytes(unpack.decompress(x))
        for (lead, p, q), own in f.groupby(["lead", "p", "q"]):
            ids, sub = own.doc_id.to_numpy(), own["sub"].to_numpy()
            at_lead = np.flatnonzero(ids == lead)
            if len(at_lead):
                count, root = answer_group([made[i] for i in ids.tolist()], int(at_lead[0]), sub if p != q else None, own.weight.to_numpy(), own.earlier.to_list(), percent)
                some = np.flatnonzero(count >= 0)
                out += zip(ids[some].tolist(), count[some].tolist(), ids[root[some]].tolist())
        return pd.DataFrame(out, columns=["doc_id", "links", "root"], dtype="int64")

    found = written(members.groupBy("g").applyInPandas(answer, "doc_id bigint, links bigint, root bigint"))
    dropped(reps, banded, met_pairs, pairs, wanted)
    links = found.groupBy(F.col("doc_id").alias("rep")).agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("doc_id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep").join(links, "rep", "left")
    out = rows.select("doc_id", "n", "sig").join(classes, "sig", "left").join(joined, "rep", "left")
    has_id = F.col("doc_id").isNotNull()
    alone = F.when(has_id, F.coalesce("component", "rep", "doc_id"))
    n_links = F.when(has_id, F.coalesce("links", F.lit(0)) + F.coalesce("weight", F.lit(1)) - 1)
    return out.select("doc_id", F.col("n").alias("n_shingles"), alone.alias("component_id"), n_links.cast("bigint").alias("n_links"))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
