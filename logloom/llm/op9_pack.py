"""Packing tokens into sequences by order-preserving dynamic programming.

Documents keep their order. Cuts may fall at document ends (free), sentence ends (a small penalty) or, in stretches
without either, at fixed places (a larger one). With P the tokens before a cut, f its least cost and L the sequence
length, a sequence from cut i to cut j costs a price of its own, which keeps fragments away, and L - (P[j] - P[i]) of
padding, or none when its length is a power of two, so

    f(j) = price + penalty(j) + min( L - P[j] + min{ f(i) + P[i] : P[j] - P[i] <= L },  min{ f(i) : P[j] - P[i] = 2^k } )

and a monotone queue keeps the inner minimum in constant time per cut. Spark's input partitions are streamed in
blocks of whole documents of about `block_tokens` tokens, so memory is bounded, no text is shuffled and a lost task is
repeated alone. A block always ends a sequence.

Edge cases: a null id is packed like any other; a null text counts as empty and gives the end id alone; repeated rows each give pieces; an empty table
gives no rows; other columns are ignored; a text of any length is cut where needed.
"""

from __future__ import annotations

import base64
import re
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

LENGTH = 2048
SENTENCE_PENALTY, FORCED_PENALTY = 16, 64
#: Price of a sequence, in tokens of padding.
SEQUENCE_PRICE = 128
#: A place for a forced cut at least every so many tokens.
FORCED_EVERY = 128
#: White space beside a space: words there don't split at spaces alone.
_BESIDE = re.compile(r"\s |^ | \s| $")


class TextIds:
    """Ids of texts. A byte-level vocabulary never merges across a space between two visible characters, so each distinct word is encoded once per task.

    `ranks_path` holds the same vocabulary as ranks, for a faster encoder of words; texts with white space beside
    spaces or with a special token's string go through the tokenizer itself. The table is emptied at `table_words`.
    """

    def __init__(self, tokenizer_path: str, ranks_path: str, end_id: int, table_words: int = 600_000):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(tokenizer_path)
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = [x.content for x in self.t.get_added_tokens_decoder().values()]
        self.end, self.limit, self.words = np.array([end_id], "<u4").tobytes(), table_words, {}
        self.stops, self.spaced = np.zeros((2, self.t.get_vocab_size()), bool)
        for raw, i in ranks.items():
            self.stops[i] = re.search(rb"[.!?\n]\W*$", raw) is not None
            self.spaced[i] = raw[:1] == b" "

    def whole(self, text: str) -> bytes:
        return np.array(self.t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, words: list[str]) -> None:
        """Encodes distinct words, each behind a space, as one text and splits it where a token starts with a space."""
        for lo in range(0, len(words), 1000):
            part = words[lo : lo + 1000]
            ids = np.array(self.fast.encode_ordinary(" " + " ".join(part)), "<u4")
            at = [*(4 * np.flatnonzero(self.spaced[ids])).tolist(), 4 * len(ids)]
            if len(at) != len(part) + 1:
                raise ValueError("a word gave no token of its own")
            raw = ids.tobytes()
            self.words.update(zip(part, [raw[a:b] for a, b in zip(at, at[1:])]))

    def batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text with the end id."""
        cut = [None if not t or _BESIDE.search(t) or any(x in t for x in self.special) else t.split(" ") for t in texts]
        used: set[str] = set()
        for words in cut:
            if words:
                used.update(words[1:])
        fresh = used.difference(self.words)
        if len(self.words) + len(fresh) > self.limit:
            self.words.clear()
            fresh = used
        self.learn(list(fresh))
        get, out = self.words.__getitem__, []
        for t, words in zip(texts, cut):
            if words is None:
                out.append((self.whole(t) if t else b"") + self.end)
            else:
                out.append(b"".join([np.array(self.fast.encode_ordinary(words[0]), "<u4").tobytes(), *map(get, words[1:]), self.end]))
        return out


def cuts(ends: np.ndarray, stops: np.ndarray, length: int = LENGTH) -> list[int]:
    """Chosen cuts of a block, 0 and its end included. ends: places behind each document, stops: places behind each sentence."""
    stops = np.setdiff1d(stops, ends, assume_unique=False)
    place = np.concatenate([[0], ends, stops])
    cost = np.concatenate([np.zeros(1 + len(ends), np.int64), np.full(len(stops), SENTENCE_PENALTY)])
    order = np.argsort(place, kind="stable")
    place, cost = place[order], cost[order]
    far = np.flatnonzero(np.diff(place) > 2 * FORCED_EVERY)
    if len(far):
        forced = np.concatenate([np.arange(a + FORCED_EVERY, b - FORCED_EVERY // 2, FORCED_EVERY) for a, b in zip(place[far].tolist(), place[far + 1].tolist())])
        place, cost = np.concatenate([place, forced]), np.concatenate([cost, np.full(len(forced), FORCED_PENALTY)])
        order = np.argsort(place, kind="stable")
        place, cost = place[order], cost[order]
    P, pen, places = place.tolist(), cost.tolist(), place
    # Cuts exactly a power of two before a cut, found for all cuts at once; few cuts have one.
    exact: dict[int, list[int]] = {}
    for k in range(length.bit_length()):
        at = np.searchsorted(places, places - (1 << k))
        hit = np.flatnonzero(places[at] == places - (1 << k))
        for j, i in zip(hit.tolist(), at[hit].tolist()):
            exact.setdefault(j, []).append(i)
    f, back, key, queue = [0] * len(P), [0] * len(P), [0] * len(P), deque([0])
    for j in range(1, len(P)):
        p = P[j]
        while P[queue[0]] < p - length:
            queue.popleft()
        i = queue[0]
        best = key[i] + length - p
        for k in exact.get(j, ()):
            if f[k] < best:
                best, i = f[k], k
        best += pen[j] + SEQUENCE_PRICE
        f[j], back[j], key[j] = best, i, best + p
        while queue and key[queue[-1]] >= best + p:
            queue.pop()
        queue.append(j)
    chosen, j = [P[-1]], len(P) - 1
    while j:
        j = back[j]
        chosen.append(P[j])
    return chosen[::-1]


def pack(docs: DataFrame, tokenizer_path: str, ranks_path: str, end_id: int = 1, length: int = LENGTH, block_tokens: int = 500_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces: doc_id, start, ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id, offset. sequence_id holds the input partition in its upper bits."""

    def emit(coder, block, base):
        ids = [b for _, b in block]
        counts = [len(b) // 4 for b in ids]
        chosen = cuts(np.cumsum(counts), np.flatnonzero(coder.stops[np.frombuffer(b"".join(ids), "<u4")]) + 1, length)
        out, s, at = [], 0, 0
        for (doc, b), n in zip(block, counts):
            start = 0
            while start < n:
                while chosen[s + 1] <= at + start:
                    s += 1
                stop = min(n, chosen[s + 1] - at)
                out.append((doc, start, b[4 * start : 4 * stop], n, base + s, at + start - chosen[s]))
                start = stop
            at += n
        cols = list(zip(*out))
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset"]), base + len(chosen) - 1

    def run(batches):
        coder = TextIds(tokenizer_path, ranks_path, end_id)
        base, block, tokens = TaskContext.get().partitionId() << 40, [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                for doc, b in zip(part.column(0).to_pylist(), coder.batch(part.column(1).to_pylist())):
                    block.append((doc, b))
                    tokens += len(b) // 4
                    if tokens >= block_tokens:
                        rows, base = emit(coder, block, base)
                        yield rows
                        block, tokens = [], 0
        if block:
            yield emit(coder, block, base)[0]

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, start bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")


def packed(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    out = pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return out.select("doc_id", "start", (F.length("ids") / 4).cast("bigint").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
