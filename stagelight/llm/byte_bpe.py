"""Byte-level BPE by dynamic programming over prefixes.

The encoding of a piece's prefix ends in exactly one token, and that token is the only one whose pair with the last token of
what lies before it encodes to the pair itself. So a table that holds for each byte prefix its last token is filled from left
to right, each entry settled once for all: appended bytes only add entries, and an edit leaves those before it as they are.
Walking the table backwards gives the ids. Whole pieces that are in the vocabulary are one token, as in the tiktoken library.

A text is split by the pattern first and each match is encoded separately. `Encoded` keeps a text's pieces, so that appending
or editing re-splits only from just before the change to the first old boundary after it.

Everything is done row by row in Arrow batches; nothing is shuffled. Null texts count as empty and have no ids. Very long
texts and pieces take time in proportion to their bytes. Repeated rows are encoded each. Other columns aren't read.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Pieces that a worker remembers at most, and a quarter of the token pairs; a full cache starts anew.
CACHED = 250_000
NEVER = 1 << 40
SLICE = 256  # rows


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Tokenizer:
    """Encodes and decodes with one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.split = regex.compile(pattern).findall
        self.iterate = regex.compile(pattern).finditer
        #: By left token: whether a right one fits.
        self.pairs: dict[int, dict[int, bool]] = {}
        self.learned = 0
        #: The packed ids of pieces met before.
        self.pieces: dict[str, bytes] = {}
        self.longest = max(map(len, ranks))
        #: A token that its own bytes do not merge into is met only as a whole piece; the others by the bytes they begin with.
        self.trie: dict[int, tuple] = {}
        #: The two parts of a token that merge last.
        self.parts: dict[int, tuple[int, int]] = {}
        for t, i in ranks.items():
            last = self._merged(t, 2)
            if len(t) == 1 or len(last) == 2:
                self._grow(t, i)
            if len(t) > 1 and len(last) == 2:
                self.parts[i] = (ranks[last[0]], ranks[last[1]])

    def _grow(self, token: bytes, rank: int) -> None:
        """Nodes of the trie are their children and the token that ends there, or None."""
        children = self.trie
        for byte in token[:-1]:
            if byte not in children:
                children[byte] = ({}, None)
            children = children[byte][0]
        below = children.get(token[-1])
        children[token[-1]] = (below[0] if below else {}, rank)

    def _merged(self, piece: bytes, least: int = 1) -> list[bytes]:
        """The plain merging of a short byte string, best-ranked neighbours first and the leftmost of equals, down to `least` parts; fewer merges if none is left."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > least:
            rank, at = min((self.ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == NEVER:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, left: int, right: int) -> bool:
        """Whether these tokens, side by side, are the encoding of their bytes.

        Going back in time, undo the later merge at either side of the boundary: at no time may the two parts that meet
        there have merged before the next merge of each.
        """
        a, b, a_next, b_next = left, right, NEVER, NEVER
        bytes_of, rank_of, parts = self.bytes_of, self.ranks.get, self.parts
        while True:
            rank = rank_of(bytes_of[a] + bytes_of[b], NEVER)
            if rank < a_next and rank <= b_next and rank != NEVER:
                return False
            # Single bytes are there from the start.
            if a in parts and (b not in parts or a > b):
                a_next, a = a, parts[a][1]
            elif b in parts:
                b_next, b = b, parts[b][0]
            else:
                return True

    def extend(self, piece: bytes, last: list[int], done: int = 0) -> list[int]:
        """Fill last, where last[i] is the last token of the first i bytes, from its first `done` settled entries on."""
        n, trie, pairs, longest = len(piece), self.trie, self.pairs, self.longest
        del last[done + 1 :]
        last.extend([-1] * (n - done))
        # A token that ends beyond `done` can begin up to a token's length before it.
        for start in range(max(0, done - longest), n):
            before, children, end = last[start], trie, start
            known = pairs.get(before)
            if known is None:
                known = pairs[before] = {}
            for byte in piece[start : start + longest]:
                node = children.get(byte)
                if node is None:
                    break
                end += 1
                children, token = node
                if token is not None and last[end] < 0:
                    if start:
                        ok = known.get(token)
                        if ok is None:
                            ok = self._learn(known, before, token)
                        if not ok:
                            continue
                    last[end] = token
        return last

    def _learn(self, known: dict[int, bool], left: int, right: int) -> bool:
        self.learned += 1
        if self.learned >= 4 * CACHED:
            self.learned = 0
            self.pairs.clear()
        known[right] = ok = self.fits(left, right)
        return ok

    def backwards(self, last: list[int]) -> list[int]:
        ids, at = [], len(last) - 1
        while at:
            ids.append(last[at])
            at -= len(self.bytes_of[last[at]])
        return ids[::-1]

    def piece(self, text: str) -> bytes:
        found = self.pieces.get(text)
        if found is None:
            raw = text.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(raw)
            found = array("I", [whole] if whole is not None else self.backwards(self.extend(raw, [0]))).tobytes()
            if len(text) <= 64:
                if len(self.pieces) >= CACHED:
                    self.pieces.clear()
                self.pieces[text] = found
        return found

    def encode(self, text: str) -> array:
        known, piece, ids = self.pieces, self.piece, array("I")
        ids.frombytes(b"".join([known.get(m) or piece(m) for m in self.split(text)]))
        return ids

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class Encoded:
    """A text that is encoded piece by piece and can grow or change."""

    def __init__(self, tokenizer: Tokenizer, text: str = ""):
        self.tokenizer, self.text, self.starts, self.ids = tokenizer, "", [], []
        self.replace(0, 0, text)

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, end: int, by: str) -> int:
        """Put `by` in place of text[start:end]; gives the number of pieces that were split anew."""
        old, shift = self.starts, len(by) - (end - start)
        self.text = self.text[:start] + by + self.text[end:]
        # A match depends on its own characters and the next two at most, so pieces that end well before the change stay.
        keep = next((i for i in range(len(old) - 1, -1, -1) if old[i] <= start), 0)
        keep = max(0, keep - 2)
        later = {s + shift: i for i, s in enumerate(old) if s > end}
        starts, ids = [], []
        begin, rest = (old[keep] if old else 0), len(old)
        for m in self.tokenizer.iterate(self.text, begin):
            if (i := later.get(m.start())) is not None:
                rest = i
                break
            starts.append(m.start())
            ids.append(self.tokenizer.piece(m[0]))
        self.starts = old[:keep] + starts + [s + shift for s in old[rest:]]
        self.ids = self.ids[:keep] + ids + self.ids[rest:]
        return len(starts)

    def tokens(self) -> list[int]:
        ids = array("I")
        ids.frombytes(b"".join(self.ids))
        return ids.tolist()


_ready: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    """One a worker and vocabulary."""
    if path not in _ready:
        _ready[path] = Tokenizer(read_ranks(path))
        gc.freeze()  # the trie is never garbage
    return _ready[path]


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """docs with a column of token ids, array<int>, and if wanted one of the SHA-256 of what they decode to, in hexadecimals.

    The new columns' names must be free in docs.
    """
    taken = {c.lower() for c in docs.columns} & {c.lower() for c in (ids, decoded) if c}
    if taken:
        raise ValueError(f"docs already has {sorted(taken)}")
    kind = T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType())), *([T.StructField(decoded, T.StringType())] if decoded else [])])
    at = docs.columns.index(text)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for batch in batches:
            # A few rows at a time: a whole batch of ids and strings would hold ten times the room of its texts.
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                found = [np.frombuffer(t.encode(x), dtype=np.int32) if x else np.empty(0, np.int32) for x in part.column(at).to_pylist()]
                ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
                column = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))
                columns, names = [*part.columns, column], [*part.schema.names, ids]
                if decoded:
                    columns, names = [*columns, pa.array([hashlib.sha256(t.decode(x.view(np.uint32).tolist())).hexdigest() for x in found], pa.string())], [*names, decoded]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(encoded, kind)


def decode(docs: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """docs with the text of a column of token ids; bytes that are not UTF-8 become replacement characters."""

    @F.pandas_udf("string")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = tokenizer(path)
        for rows in batches:
            yield pd.Series([t.decode([] if x is None else x).decode("utf-8", "replace") for x in rows])

    return docs.withColumn(text, decoded(F.col(ids)))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """docs with n_tokens, ids_sha256 and decoded_sha256; ids go no further than the task that made them."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        t = tokenizer(path)
        for texts in batches:
            out = []
            for text in texts:
                ids = t.encode(text or "")
                little = np.frombuffer(ids, dtype=np.uint32).astype("<u4").tobytes() if len(ids) else b""
                out.append((len(ids), hashlib.sha256(little).hexdigest(), hashlib.sha256(t.decode(ids)).hexdigest()))
            yield pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.withColumn("_digest", digest(F.coalesce(F.col("text"), F.lit("")))).select(*docs.columns, "_digest.*")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(docs, public_tokenizers.path(VOCABULARY)).drop("text")
