"""SentencePiece encoding and decoding through a table of distinct marked words.

When no piece holds a whitespace marker after another character, no merge crosses the start of a marked word. A
text is then cut before each run of spaces, every distinct marked word is segmented once per task, and the ids are
joined back by position. The table is emptied when it reaches `table_words` entries, so memory is bounded and the
result doesn't depend on it. A model whose pieces do cross markers, or whose normaliser changes texts, is refused.

Edge cases: a null text counts as empty and gives only the begin and end ids; repeated rows each give a row; an empty
table gives no rows; other columns are ignored; whole texts are encoded, and marked words of any length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

MARK = "▁"


class WordTable:
    """Ids of a text from the ids of its distinct marked words."""

    def __init__(self, model_path: str, table_words: int = 600_000):
        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        names = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        if any(MARK in x.lstrip(MARK) for x in names):
            raise ValueError("pieces cross whitespace markers: marked words can't be segmented alone")
        probe = "A  b\nＡ cé é\t① "
        if self.sp.decode(self.sp.encode(probe)) != probe:
            raise ValueError("the model's normaliser changes texts")
        self.limit, self.words = table_words, {}
        self.marked = np.array([x.startswith(MARK) for x in names])
        self.ends = (np.array([self.sp.bos_id()], "<u4").tobytes(), np.array([self.sp.eos_id()], "<u4").tobytes())

    def learn(self, words: list[str]) -> None:
        """Encodes distinct words, each behind one marker. Plain ones are encoded as one text and split where a piece starts with the marker."""
        plain = []
        for w in words:
            if w and w[0] != " ":
                plain.append(w)
            else:
                self.words[w] = np.array(self.sp.encode(w) if w else [self.sp.piece_to_id(MARK)], "<u4").tobytes()
        for lo in range(0, len(plain), 1000):
            part = plain[lo : lo + 1000]
            ids = np.array(self.sp.encode(" ".join(part)), "<u4")
            at = [*(4 * np.flatnonzero(self.marked[ids])).tolist(), 4 * len(ids)]
            if len(at) != len(part) + 1:
                raise ValueError("a word gave no marker of its own")
            raw = ids.tobytes()
            self.words.update(zip(part, [raw[a:b] for a, b in zip(at, at[1:])]))

    @staticmethod
    def cut(text: str) -> list[str]:
        """Marked words without their last marker: a run of n markers leaves n - 1 spaces at the start of its word."""
        words = text.replace(MARK, " ").split(" ")
        if "" not in words:
            return words
        joined, spaces = [], 0
        for w in words[:-1]:
            if w:
                joined.append(" " * spaces + w)
                spaces = 0
            else:
                spaces += 1
        return [*joined, " " * spaces + words[-1]]

    def batch(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, with begin and end."""
        cut = [self.cut(t) if t else [] for t in texts]
        used: set[str] = set()
        for words in cut:
            used.update(words)
        fresh = used.difference(self.words)
        if len(self.words) + len(fresh) > self.limit:
            self.words.clear()
            fresh = used
        self.learn(list(fresh))
        get = self.words.__getitem__
        return [b"".join([self.ends[0], *map(get, words), self.ends[1]]) for words in cut]

    def decode(self, ids: bytes) -> str:
        return self.sp.decode(np.frombuffer(ids, "<u4").tolist())


def sentencepiece_codec(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", table_words: int = 600_000) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit) and decoded, the text that the ids give back."""

    def run(batches):
        words = WordTable(model_path, table_words)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                ids = words.batch(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array([words.decode(x) for x in ids], pa.string())], names=["doc_id", "ids", "decoded"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, ids binary, decoded string")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = sentencepiece_codec(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select("doc_id", (F.length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
