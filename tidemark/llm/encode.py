"""Encoding of texts with a public byte-level BPE vocabulary.

Long texts are cut into leaves of a binary tree that threads encode in parallel; two neighbours are joined by
encoding a window around their join again, which grows until both sides agree exactly.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Fixed value: the pattern that splits text before the merges, published with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
LEAF_CHARS = 8192


@lru_cache(maxsize=4)
def encoding(path: str):
    """The vocabulary's encoder, read once per Python worker. Strings that look like special tokens are ordinary text to it."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


# Joining ---------------------------------------------------------------------------------------------------------


@lru_cache(maxsize=65536)
def _kind(c: str) -> str:
    """Letter, number, space, other; ``?`` for characters whose kind may differ between Unicode versions."""
    category = unicodedata.category(c)
    if category[0] in "LN":
        return category[0]
    if category[0] == "Z" or c in "\t\n\v\f\r\x85":
        return "S"
    return "?" if category == "Cn" else "P"


def _sure(text: str, i: int) -> bool:
    """True if the pattern has a boundary before ``text[i]`` whatever comes before and after these two characters.

    No match goes on from a letter or a number into another kind, nor from other characters into a number
    or a space.
    """
    a, b = _kind(text[i - 1]), _kind(text[i])
    return "?" not in (a, b) and a != b and (a in "LN" or (a == "P" and b in "NS"))


def _whole_characters(enc, tokens: list[int], following: int | None) -> tuple[int, int]:
    """The first and the last token edge of ``tokens`` that lie between characters."""
    parts = enc.decode_tokens_bytes(tokens)
    inside = [bool(p) and p[0] & 0xC0 == 0x80 for p in parts]
    low = next((i for i, x in enumerate(inside) if not x), len(tokens))
    high = len(tokens)
    if following is not None and enc.decode_single_token_bytes(following)[0] & 0xC0 == 0x80:
        high = next((i for i in range(len(tokens) - 1, -1, -1) if not inside[i]), 0)
    return low, high


def _edge(enc, tokens: list[int], size: int) -> int | None:
    """The number of tokens that make up the first ``size`` bytes, if a token ends there."""
    for i, part in enumerate(enc.decode_tokens_bytes(tokens)):
        if size <= 0:
            return i if size == 0 else None
        size -= len(part)
    return len(tokens) if size == 0 else None


def join(left: list[int], right: list[int], enc, width: int = 32) -> list[int]:
    """The ids of the text of ``left`` and ``right`` together, given the ids of each.

    First choice for the window's ends are boundaries of the pattern that hold in any context (``_sure``), one
    in the left text and one in the right: what is before and after is then independent of the join. If
    the join lies deep inside one long run that the pattern doesn't split, the window is part of a single
    BPE word; there, ids that agree with the old ones at both ends are exact, as a sequence of tokens is an encoding if and
    only if each pair of neighbours is. The window doubles until one of these holds or it is everything.
    """
    if not left or not right:
        return left + right
    while True:
        a, b = left[-width:], right[:width]
        low, _ = _whole_characters(enc, a, None) if len(a) < len(left) else (0, 0)
        _, high = _whole_characters(enc, b, right[len(b)] if len(b) < len(right) else None)
        a, b = a[low:], b[:high]
        before, after = enc.decode_bytes(a).decode(), enc.decode_bytes(b).decode()
        text, cut = before + after, len(before)
        all_left, all_right = len(a) == len(left), len(b) == len(right)
        start = next((i for i in range(cut - 1, 0, -1) if _sure(text, i)), 0 if all_left else None)
        end = next((i for i in range(cut + 1, len(text)) if _sure(text, i)), len(text) if all_right else None)
        if start is not None and end is not None:
            i, j = _edge(enc, a, len(text[:start].encode())), _edge(enc, b, len(text[cut:end].encode()))
            if i is not None and j is not None:
                return left[: len(left) - len(a) + i] + enc.encode_ordinary(text[start:end]) + right[j:]
        if width >= 256 and len(a) > 24 and len(b) > 24:
            p, q = _whole_characters(enc, a[8:], None)[0] + 8, _whole_characters(enc, b[:-8], b[-8])[1]
            inner = enc.decode_bytes(a[p:] + b[:q]).decode()
            if "?" not in (kinds := set(map(_kind, text))) and len(kinds) == 1:
                new = enc.encode_ordinary(inner)
                if new[:2] == a[p : p + 2] and new[-2:] == b[q - 2 : q]:
                    return left[: len(left) - len(a) + p] + new + right[q:]
        if all_left and all_right:
            return enc.encode_ordinary(text)
        width *= 2


def join_all(parts: list[list[int]], enc) -> list[int]:
    """Neighbours joined in pairs, level by level."""
    while len(parts) > 1:
        pairs = [join(parts[i], parts[i + 1], enc) for i in range(0, len(parts) - 1, 2)]
        parts = pairs + ([parts[-1]] if len(parts) % 2 else [])
    return parts[0] if parts else []


def halves(text: str, leaf: int) -> list[str]:
    """The leaves of the tree that halves ``text`` until no part has more than ``leaf`` characters."""
    n = 1
    while -(-len(text) // n) > leaf:
        n *= 2
    return [text[len(text) * i // n : len(text) * (i + 1) // n] for i in range(n)]


# Spark -----------------------------------------------------------------------------------------------------------


def _ids(lists: list[list[int]]) -> pa.Array:
    offsets = np.zeros(len(lists) + 1, np.int32)
    np.cumsum([len(x) for x in lists], out=offsets[1:])
    flat = np.fromiter((x for one in lists for x in one), np.int32, int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def encode_text(text: str, enc, leaf: int, threads: int) -> list[int]:
    """The ids of one text: of its leaves in parallel, then joined in pairs."""
    if len(text) <= leaf:
        return enc.encode_ordinary(text)
    return join_all(enc.encode_ordinary_batch(halves(text, leaf), num_threads=threads), enc)


def encode_corpus(texts: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY, leaf: int = LEAF_CHARS, threads: int = 4) -> DataFrame:
    """(key, ids): the token ids of every row's text, without special tokens.

    Null and empty texts have empty ids. Rows keep their number: repeated rows and keys stay repeated, null keys stay. Texts are read
    once and encoded where they are read, without a shuffle. One of more than ``leaf`` characters is cut into the leaves of a
    tree, which ``threads`` threads of its task encode in parallel (the encoder works outside Python's lock) and which are
    then joined in pairs: a text has to end up in one row anyway. Other columns are ignored.
    """
    kind = texts.schema[key].dataType.simpleString()

    def encode_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocabulary)
        for one in batches:
            ids = [encode_text(t, enc, leaf, threads) if t else [] for t in one.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([one.column(0), _ids(ids)], ["_key", "ids"])

    rows = texts.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    return rows.mapInArrow(encode_rows, f"_key {kind}, ids array<int>").withColumnRenamed("_key", key)
