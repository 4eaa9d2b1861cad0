"""Packing: documents to token sequences of one length, by bounded-space online best fit in each partition and a merge of what is left."""
from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetcost.llm.common import slices, written

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, open boolean, part long"
_KEPT = 500_000         # entries of a lookup table
_LONGEST = 64           # characters of an entry


class Pieces(dict):
    """Ids of a letter run, a digit or a symbol run, as the tokenizer's model has them; it is asked once per piece."""

    #: The byte-level alphabet: a printable byte stands for itself, the others, in order, for the characters from 256 on.
    _plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    _alphabet = {b: 256 + n for n, b in enumerate(sorted(set(range(256)) - set(_plain)))}

    def __init__(self, model):
        super().__init__()
        self.model = model

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= _KEPT:
            self.clear()
        spelled = piece.encode().decode("latin-1").translate(self._alphabet)
        got = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(spelled)])
        if len(piece) <= _LONGEST:
            self[piece] = got
        return got


class Encoder(dict):
    """Token ids of a text; equal to the tokenizer's own encode().

    The tokenizer splits a lower-cased text into letter runs, digits and symbol runs and encodes each by itself; none has white space in
    it. So the text is cut at white space, words are looked up in this dict, and their pieces when a word is new. Texts with characters
    whose case, normal form or class needs the tokenizer's tables, or with its special tokens, go through the tokenizer whole.
    """
    _other = re.compile("[^\t\n\r\x20-\x7e\xa1-\xa9\xab\xac\xae-\xb1\xb4\xb6-\xb8\xbb\xbf-į]")
    _special = re.compile("<\\|startoftext\\|>|<\\|endoftext\\|>")
    _split = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-į]+|[0-9]|[^\\sa-z0-9\xdf-\xf6\xf8-į]+")

    def __init__(self, path: str):
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.pieces = Pieces(self.tokenizer.model)

    def __missing__(self, word: str) -> bytes:
        if len(self) >= _KEPT:
            self.clear()
        got = b"".join(map(self.pieces.__getitem__, self._split.findall(word)))
        if len(word) <= _LONGEST:
            self[word] = got
        return got

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if self._other.search(text) or "<|" in text and self._special.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.__getitem__, text.lower().split()))


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One to a Python process, so the next task there finds what the one before has looked up."""
    return Encoder(path)


class Packer:
    """At most `windows` open windows of `size` tokens. A piece goes to the window with the least room that holds it. When none does and
    no more may be opened, the fullest is filled up with the head of the piece and emitted."""

    def __init__(self, size: int, windows: int, first_id: int, part: int):
        self.size, self.windows, self.next_id, self.part = size, windows, first_id, part
        self.open: list[list] = []      # [room, sequence id, pieces]
        self.out: list[tuple] = []

    def emit(self, window: list, still_open: bool = False) -> None:
        at = 0
        for doc, start, ids, total in window[2]:
            n = len(ids) // 4
            self.out.append((doc, start, n, ids, total, window[1], at, still_open, self.part))
            at += n

    def new(self) -> list:
        self.next_id += 1
        return [self.size, self.next_id - 1, []]

    def add(self, doc, start: int, ids: bytes, total: int) -> None:
        size = 4 * self.size
        while len(ids) >= size:
            w = self.new()
            w[2].append((doc, start, ids[:size], total))
            self.emit(w)
            ids, start = ids[size:], start + self.size
        while ids:
            n = len(ids) // 4
            fits = [w for w in self.open if w[0] >= n]
            if fits:
                w = min(fits)
            elif len(self.open) < self.windows:
                w = self.new()
                self.open.append(w)
            else:
                w = min(self.open)
                n = w[0]
            w[2].append((doc, start, ids[:4 * n], total))
            w[0] -= n
            ids, start = ids[4 * n:], start + n
            if not w[0]:
                self.open.remove(w)
                self.emit(w)

    def drain(self) -> pd.DataFrame:
        rows, self.out = self.out, []
        return pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "open", "part"])


def _powers(window: list, packer: Packer) -> None:
    """Emit a window's pieces as sequences whose lengths are powers of two, so that none of them is padded."""
    pieces, left = list(window[2]), packer.size - window[0]
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        part = packer.new()
        while room:
            doc, start, ids, total = pieces.pop(0)
            n = min(room, len(ids) // 4)
            part[2].append((doc, start, ids[:4 * n], total))
            room -= n
            if len(ids) > 4 * n:
                pieces.insert(0, (doc, start + n, ids[4 * n:], total))
        packer.emit(part)


def pack(docs: DataFrame, tokenizer_path: str, size: int = 2048, windows: int = 16, fan_in: int = 16, end_id: int = END_ID,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    A document is its token ids and `end_id`; a null or empty text is `end_id` alone. Each id lies in one piece, offsets in a sequence
    have no gaps, and a sequence holds `size` tokens, except those made of the very last window, whose lengths are powers of two.
    Repeated rows are packed each; other columns are ignored; an empty table gives no rows.

    Documents are packed where they are read; each partition keeps `windows` windows open and hands them over when it ends. Those are
    merged in a tree, `fan_in` partitions to a task, so no task gets more than `fan_in * windows` windows, however many there are.
    Sequence ids come from the partition and a count in it, so a task that runs again gives the same ones. Pieces are written to the
    shared folder once, so that texts are tokenized once.
    """
    parts = max(1, docs.rdd.getNumPartitions())

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        encode, packer, end = encoder(tokenizer_path).ids, Packer(size, windows, part << 34, part), np.array([end_id], "<u4").tobytes()
        for b in slices(batches):
            for doc, text in zip(b["id"], b["t"]):
                ids = encode(text) + end
                packer.add(doc, 0, ids, len(ids) // 4)
            yield packer.drain()
        for w in packer.open:
            packer.emit(w, still_open=True)
        yield packer.drain()

    def merge(level: int, last: bool):
        def merged(key: tuple, pieces: pd.DataFrame) -> pd.DataFrame:
            part = int(key[0])
            packer = Packer(size, 1, (level << 58) + (part << 34), part)
            for p in pieces.sort_values(["sequence_id", "offset"]).itertuples():
                packer.add(p.doc_id, p.start, p.ids, p.doc_tokens)
            for w in packer.open:
                if last:
                    _powers(w, packer)
                else:
                    packer.emit(w, still_open=True)
            return packer.drain()
        return merged

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    pieces = written(source.mapInPandas(first, SCHEMA))
    done, level = pieces.where(~F.col("open")), 0
    while True:
        parts, level = -(-parts // fan_in), level + 1
        left = pieces.where("open").withColumn("part", F.floor(F.col("part") / fan_in).cast("long"))
        pieces = written(left.groupBy("part").applyInPandas(merge(level, parts == 1), SCHEMA))
        done = done.unionByName(pieces.where(~F.col("open")))
        if parts == 1:
            return done.drop("open", "part").withColumnRenamed("doc_id", id_col)


def run(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from fleetcost.llm.common import table
    packed = pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return packed.select("doc_id", "start", "length", F.crc32("ids").cast("long").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
