"""Encoding of a corpus with a public byte-level BPE, each repeated piece of text encoded once.

Texts are cut into content-defined chunks: a cut falls where a rolling hash of the characters before it says
so. Equal passages of different documents fall into equal chunks; the chunks are brought together by their
digest (in partitions that are split where one digest is too frequent), each different chunk is encoded once
a partition, and the ids go back to their documents. A cut may fall within a token, so every join is repaired:
the ids around it are turned back into text, from the last sure boundary of pre-tokens before the join to the
first one after it, and encoded again; the window grows until the new ids agree with the old ones at its ends.
"""

from __future__ import annotations

import base64
import importlib.util
import os
from collections.abc import Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidloom.session import spread

#: The rolling hash looks at so many characters; chunks have about 2**BITS characters, LEAST at least and MOST at most.
WINDOW, BITS, LEAST, MOST = 16, 9, 192, 4096
#: A worker forgets its encoded pre-tokens, and a partition its chunks, when it holds so many.
PIECES, CHUNKS = 400_000, 20_000
#: A sure boundary of pre-tokens: a letter, then a space and a letter, or a mark of the scripts without spaces; no pre-token holds both sides.
_SURE = regex.compile(r"(?<=\p{L})(?= \p{L}|[。！？，、；：「」『』（）])")
TOKENIZERS = "/opt/tokenizers"


def _tokenizers(folder: str) -> ModuleType:
    """The module in the tokenizers' folder, which has the pattern of their pre-tokens."""
    spec = importlib.util.spec_from_file_location("public_tokenizers_of_folder", os.path.join(folder, "__init__.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


class Encoder:
    """byte-level BPE over pre-tokens, with the ids of each pre-token remembered as 16-bit numbers."""

    def __init__(self, ranks_file: str) -> None:
        P = _tokenizers(os.path.dirname(ranks_file))
        with open(ranks_file, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self.bpe = tiktoken.Encoding("corpus", pat_str=P.PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        self.pre = regex.compile(P.PATTERN)
        self.seen: dict[str, bytes] = {}

    def packed(self, text: str) -> bytes:
        seen, pieces = self.seen, self.pre.findall(text)
        try:
            return b"".join([seen[p] for p in pieces])
        except KeyError:
            if len(seen) > PIECES:
                seen.clear()
            for p in pieces:
                if p not in seen:
                    seen[p] = np.array(self.bpe.encode_ordinary(p), dtype=np.uint16).tobytes()
            return b"".join([seen[p] for p in pieces])

    def text(self, ids: np.ndarray) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids.tolist()])

    def merged(self, parts: list[bytes]) -> bytes:
        """The packed ids of a text from those of its parts in order, joined two by two: each is re-encoded a logarithmic number of times at most."""
        while len(parts) > 1:
            parts = [self.joined(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0]

    def joined(self, left: bytes, right: bytes) -> bytes:
        """The packed ids of a text from those of its two parts, equal to encoding it whole."""
        a, b = np.frombuffer(left, np.uint16), np.frombuffer(right, np.uint16)
        reach = 40
        while True:
            i, j = max(0, len(a) - reach), min(len(b), reach)
            x, y = self.text(a[i:]), self.text(b[:j])
            # a window may begin and end within a character; only whole characters are looked at
            x0 = next((k for k in range(len(x)) if x[k] & 0xC0 != 0x80), len(x))
            before, after = x[x0:].decode(errors="ignore"), y
            end = len(after)
            while end and _partial(after[:end]):
                end -= 1
            after = after[:end].decode(errors="ignore")
            # the join itself may fall between any two characters, never within one
            lefts = [m.start() for m in _SURE.finditer(before)]
            rights = [m.start() for m in _SURE.finditer(after)]
            lo = 0 if i == 0 else (_byte_at(before, lefts[-1]) + x0 if lefts else None)
            hi = len(y) if j == len(b) else (_byte_at(after, rights[0]) if rights else None)
            if lo is not None and hi is not None:
                ka, kb = _tokens_to(self, a[i:], lo), _tokens_to(self, b[:j], hi)
                if ka is not None and kb is not None:
                    middle = self.packed((x[lo:] + y[:hi]).decode())
                    return left[: 2 * (i + ka)] + middle + right[2 * kb :]
            if i == 0 and j == len(b):
                return self.packed((x + y).decode())
            reach *= 4


def _partial(raw: bytes) -> bool:
    """Whether the bytes end within a character."""
    for k in range(1, min(4, len(raw)) + 1):
        c = raw[-k]
        if c & 0xC0 != 0x80:
            return k < (1 if c < 0x80 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4)
    return bool(raw)


def _byte_at(text: str, chars: int) -> int:
    return len(text[:chars].encode())


def _tokens_to(enc: Encoder, ids: np.ndarray, byte: int) -> int | None:
    """How many ids make up the first ``byte`` bytes, or None if an id lies across that place."""
    at = 0
    for k, i in enumerate(ids.tolist()):
        if at == byte:
            return k
        at += len(enc.bytes_of[i])
        if at > byte:
            return None
    return len(ids) if at == byte else None


_P = np.uint32(0x9E3779B1)
_POW = np.array([pow(int(_P), WINDOW - 1 - k, 2**32) for k in range(WINDOW)], dtype=np.uint32)


def cuts(text: str) -> list[int]:
    """Where the content-defined chunks of a text end, in characters."""
    n = len(text)
    if n <= LEAST:
        return [n]
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    marks = np.flatnonzero(_rolling(c) >> np.uint32(32 - BITS) == 0) + 1
    out, last = [], 0
    for m in [*marks.tolist(), n]:
        while m - last > MOST:
            last += MOST
            out.append(last)
        if m - last >= LEAST and m < n:
            out.append(m)
            last = m
    if not out or out[-1] != n:
        out.append(n)
    return out


def _rolling(c: np.ndarray) -> np.ndarray:
    """For each character a hash of the WINDOW characters that end with it."""
    with np.errstate(over="ignore"):
        h = np.zeros(len(c), np.uint32)
        for k in range(WINDOW):
            h[k:] += c[: len(c) - k] * _POW[WINDOW - 1 - k]
        return (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)


def encoded(df: DataFrame, id_col: str, text_col: str, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(id, ids): the token ids of each row's text, exactly those of encoding it whole, without special tokens.

    Texts that are null or empty have an empty list. Strings of special tokens are ordinary text. Repeated rows
    come out once; an id with several texts has a row for each. Other columns play no part. The vocabulary must
    have fewer than 65,536 ids.
    """
    ranks = os.path.join(folder, f"{tokenizer}.tiktoken")
    src = spread(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")))
    kind = dict(src.dtypes)["id"]

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            who, own, seq, digest, chunk = [], [], [], [], []
            for r, t in enumerate(b.column(1).to_pylist()):
                last, whole = 0, xxhash.xxh3_64_intdigest(t.encode()) if t else 0
                for k, end in enumerate(cuts(t) if t else [0]):
                    piece = (t or "")[last:end]
                    who.append(r)
                    own.append(whole)
                    seq.append(k)
                    digest.append(xxhash.xxh3_64_intdigest(piece.encode()) if piece else 0)
                    chunk.append(piece)
                    last = end
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(who, pa.int32())), pa.array(np.array(own, dtype=np.uint64).view(np.int64)), pa.array(seq, pa.int32()), pa.array(np.array(digest, dtype=np.uint64).view(np.int64)), pa.array(chunk, pa.string())], ["id", "text", "seq", "digest", "chunk"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, done = Encoder(ranks), {}
        for b in batches:
            out = []
            for d, c in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                have = done.get(d)
                if have is None or have[0] != c:
                    if len(done) >= CHUNKS:
                        done.clear()
                    have = done[d] = (c, enc.packed(c))
                out.append(have[1])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out, pa.binary())], ["id", "text", "seq", "packed"])

    def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = None
        for b in batches:
            parts = b.column(1)
            off = np.asarray(parts.offsets)
            packed = parts.values.field(1).to_pylist()
            out = []
            for r in range(len(off) - 1):
                own = packed[off[r] : off[r + 1]]
                if len(own) > 1:
                    enc = enc or Encoder(ranks)
                out.append(enc.merged(own) if len(own) > 1 else own[0])
            ids = np.frombuffer(b"".join(out), np.uint16).astype(np.int32)
            offsets = np.zeros(len(out) + 1, np.int32)
            np.cumsum([len(x) // 2 for x in out], out=offsets[1:])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], ["id", "ids"])

    chunks = src.mapInArrow(chunked, f"id {kind}, text bigint, seq int, digest bigint, chunk string")
    by_digest = chunks.hint("rebalance", "digest")
    codes = by_digest.mapInArrow(encode, f"id {kind}, text bigint, seq int, packed binary")
    docs = codes.groupBy("id", "text").agg(F.sort_array(F.collect_set(F.struct("seq", "packed"))).alias("parts")).drop("text")
    return docs.mapInArrow(repaired, f"id {kind}, ids array<int>").select(F.col("id").alias(id_col), "ids")
