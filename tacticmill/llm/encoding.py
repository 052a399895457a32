"""Encoding of a whole corpus with a public byte-level BPE tokenizer.

``encode`` gives the token ids of each text, without special tokens; NULL and
empty texts have the empty list. ``decode`` is its inverse.

Method. Encoding is reduced over a tree of halves: a text longer than LEAF is
halved until its parts are short, the parts are encoded, and neighbours are
joined by encoding anew a window around the seam. The window grows to both
sides until it ends at places where a token boundary is certain whatever
stands around them: the end of a run of letters or of digits, before a blank, a mark or a sign of the other class. No
piece of the split pattern reaches across such a place, so the tokens outside
the window are those of the whole text, and the join is associative. Decoding
concatenates the bytes of the parts up the same tree.

Defined results: texts are encoded as they are, strings of special tokens
included as ordinary text; a text without any certain boundary is encoded in
one window; repeated rows are encoded like any other row; other columns are
ignored. The vocabulary's path is a parameter and must be readable by the executors.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAF = 8192
DEFAULT_DIR = "/opt/tokenizers"
DEFAULT_VOCABULARY = "byte_bpe_50k.tiktoken"

# Fixed value: the split pattern of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_LETTER = "A-Za-zÀ-ÖØ-öø-ÿĀ-ſА-яЁё一-龥ぁ-んァ-ヶ가-힣"
_OTHER = r" \t\n.,;:!?()\[\]{}<>\"'`/\\|@#$%^&*+=~_\-，。、；：！？（）「」『』《》“”‘’…—–"
#: The end of a run of letters or of digits. The classes are those on which all versions of Unicode agree.
_SURE = re.compile(f"(?<=[{_LETTER}])(?=[{_OTHER}0-9])|(?<=[0-9])(?=[{_OTHER}{_LETTER}])")


class TreeEncoder:
    def __init__(self, path: str, leaf: int = LEAF):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.bpe = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.width = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            self.width[rank] = len(token)
        self.leaf = leaf

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, dtype=np.int32)
        return self._node(text, 0, len(text))

    def _plain(self, text: str) -> np.ndarray:
        return np.array(self.bpe.encode_ordinary(text), dtype=np.int32)

    def _node(self, text: str, start: int, stop: int) -> np.ndarray:
        if stop - start <= self.leaf:
            return self._plain(text[start:stop])
        middle = (start + stop) // 2
        return self.join(text, start, middle, stop, self._node(text, start, middle), self._node(text, middle, stop))

    def join(self, text: str, start: int, middle: int, stop: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of text[start:stop] from those of its parts up to and from middle."""
        reach, a, b = 32, start, stop
        while middle - reach > start:
            sure = [m.start() for m in _SURE.finditer(text, middle - reach, middle)]
            sure = [s for s in sure if s > start]
            if sure:
                a = sure[-1]
                break
            reach *= 4
        reach = 32
        while middle + reach < stop:
            found = _SURE.search(text, middle + 1, middle + reach)
            if found and found.start() < stop:
                b = found.start()
                break
            reach *= 4
        head = left[: len(left) - self._tokens(left[::-1], len(text[a:middle].encode("utf-8", "surrogatepass")))]
        tail = right[self._tokens(right, len(text[middle:b].encode("utf-8", "surrogatepass"))) :]
        return np.concatenate((head, self._plain(text[a:b]), tail))

    def _tokens(self, ids: np.ndarray, size: int) -> int:
        """How many of the first ids make up size bytes."""
        reach = 64
        while True:
            ends = np.cumsum(self.width[ids[:reach]])
            if size == 0:
                return 0
            at = int(np.searchsorted(ends, size))
            if at < len(ends):
                if ends[at] != size:
                    raise ValueError("no token boundary at a certain place")
                return at + 1
            if reach >= len(ids):
                raise ValueError("no token boundary at a certain place")
            reach *= 8

    def decode(self, ids) -> str:
        ids = [int(i) for i in ids] if ids is not None else []
        return self._bytes(ids, 0, len(ids)).decode("utf-8", "replace")

    def _bytes(self, ids: list[int], start: int, stop: int) -> bytes:
        if stop - start <= self.leaf:
            return self.bpe.decode_bytes(ids[start:stop])
        middle = (start + stop) // 2
        return self._bytes(ids, start, middle) + self._bytes(ids, middle, stop)


@lru_cache(maxsize=4)
def encoder(path: str, leaf: int = LEAF) -> TreeEncoder:
    """One encoder for each worker process."""
    return TreeEncoder(path, leaf)


def vocabulary_path(spark: SparkSession, name: str = DEFAULT_VOCABULARY) -> str:
    """The vocabulary file under the folder of the setting spark.tacticmill.tokenizers."""
    return os.path.join(spark.conf.get("spark.tacticmill.tokenizers", DEFAULT_DIR), name)


def encode(text: Column, path: str, leaf: int = LEAF) -> Column:
    @F.pandas_udf(T.ArrayType(T.IntegerType(), False))
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoder(path, leaf)
        for texts in batches:
            yield pd.Series([e.encode(t) for t in texts], dtype=object)

    return ids(text)


def count_tokens(text: Column, path: str, leaf: int = LEAF) -> Column:
    @F.pandas_udf(T.LongType())
    def size(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoder(path, leaf)
        for texts in batches:
            yield pd.Series([len(e.encode(t)) for t in texts], dtype="int64")

    return size(text)


def decode(ids: Column, path: str) -> Column:
    @F.pandas_udf(T.StringType())
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoder(path)
        for lists in batches:
            yield pd.Series([e.decode(i) for i in lists], dtype=object)

    return text(ids)


def encode_corpus(df: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """(key, ids), one row for each row of df; a map-only pass over two columns."""
    return df.select(F.col(key), encode(F.col(text), path).alias("ids"))
