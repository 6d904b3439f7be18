"""Vocabulary caches: words and the token ids that they stand for."""

from __future__ import annotations

import re
import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import TokenizerError
from ..shared import store
from ..sources.text import TAKEN_ROWS, first_of

MAGIC, VERSION = b"IMSVCACH", 1  # fixed values of the file format
MARK = "▁"
_LETTER = re.compile(r"[^\W\d_]")


def save(path: str, vocab: dict[str, list[int]]) -> None:
    with open(path, "wb") as f:
        f.write(MAGIC + struct.pack("<IQ", VERSION, len(vocab)))
        for word, ids in vocab.items():
            raw = word.encode()
            f.write(struct.pack("<I", len(raw)) + raw + struct.pack(f"<I{len(ids)}I", len(ids), *ids))


def load(path: str) -> dict[str, list[int]]:
    with open(path, "rb") as f:
        data = f.read()
    count = _header(data)
    if count is None:
        raise TokenizerError(f"{path} is no vocabulary cache of version {VERSION}")
    out, at = {}, 20
    try:
        for _ in range(count):
            (n,) = struct.unpack_from("<I", data, at)
            word = data[at + 4 : at + 4 + n].decode()
            at += 4 + n
            (n,) = struct.unpack_from("<I", data, at)
            out[word] = list(struct.unpack_from(f"<{n}I", data, at + 4))
            at += 4 + 4 * n
    except struct.error as e:
        raise TokenizerError(f"{path} ends early") from e
    return out


def _header(data: bytes) -> int | None:
    if len(data) < 20 or data[:8] != MAGIC or struct.unpack_from("<I", data, 8)[0] != VERSION:
        return None
    return struct.unpack_from("<Q", data, 12)[0]


def count(path: str) -> int | None:
    """Entries that a cache file says it has, or None if it is none."""
    try:
        with open(path, "rb") as f:
            return _header(f.read(20))
    except OSError:
        return None


def from_tokenizer(tokenizer) -> dict[str, list[int]]:
    """Words of a tokenizer's own vocabulary that a cache can answer, with their ids.

    Marked tokens of at most 45 characters after the mark and other tokens of 2 to 20, each with
    a letter; what the tokenizer has no ids for is left out.
    """
    out = {}
    for token in tokenizer.get_vocab():
        marked = token.startswith(MARK)
        if _LETTER.search(token) and (marked and len(token) - 1 <= 45 or not marked and 2 <= len(token) <= 20):
            if ids := tokenizer.encode(token, add_special_tokens=False).ids:
                out[token] = ids
    return out


def words(texts: DataFrame, column: str = "text") -> DataFrame:
    """(word): lower-cased words, one row for each occurrence."""
    return texts.select(F.explode(F.split(F.lower(F.col(column)), r"(?U)\s+")).alias("word")).where("word != ''")


def top_words(texts: DataFrame, column: str = "text", *, most: int = 1_500_000, max_chars: int = 45) -> DataFrame:
    """(word, n): the commonest words with a letter, ties by word; words of digits only are left out.

    More than a task may hold are counted once, stored and numbered by many tasks.
    """
    fit = words(texts, column).where((F.length("word") <= max_chars) & F.rlike("word", F.lit(r"\p{IsAlphabetic}")))
    counts = fit.groupBy("word").agg(F.count("*").alias("n"))
    return first_of(counts if most <= TAKEN_ROWS else store(counts, "counts"), most, F.desc("n"), "word")


def from_corpus(texts: DataFrame, tokenizer, column: str = "text", *, most: int = 1_500_000) -> dict[str, list[int]]:
    """Cache entries for a corpus's commonest words; the number of entries is bounded by ``most``."""
    out = {}
    for r in top_words(texts, column, most=most).toLocalIterator():
        out[MARK + r.word] = tokenizer.encode(MARK + r.word, add_special_tokens=False).ids
    return out
