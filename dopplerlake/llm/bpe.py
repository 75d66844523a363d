"""Byte-level BPE encoding and decoding (operator 2).

Method: contiguous rank array. A short word holds its part boundaries and the merge rank of every adjacent pair in
plain arrays; the minimum is searched again and again, its boundary deleted and the two neighbouring ranks refreshed.
Words beyond `SHORT` bytes take the same merges in the same order from a heap, since rescanning would be quadratic.

Texts are cut at single spaces first: a piece that neither starts nor ends with white space is tokenized alike wherever
it stands, so its ids can be kept. The memory of pieces is bounded (two generations of `KEPT`).

Null text: as empty text (no ids). Any other column is kept. Ids travel as little-endian unsigned 32-bit integers in a
binary column, which is compact in shuffles and needs no per-element boxing in the JVM.
"""

from __future__ import annotations

import heapq
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import tokenizer_path

#: The published pre-tokenization pattern of byte-level BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHORT = 192
KEPT = 220_000
NONE = 1 << 30


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary, by the published rule."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    letters = {chr(b): b for b in plain}
    extra = [b for b in range(256) if b not in set(plain)]
    return letters | {chr(256 + i): b for i, b in enumerate(extra)}


class _Kept(dict):
    """Piece -> ids as bytes; computes what is missing. At KEPT entries a new generation begins: what is used again moves
    over from the one before, the rest goes with the next change, so pieces in use survive and memory stays bounded."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= KEPT:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class _Uneven(Exception):
    """White space meets the cut at a space, so the text has to be split as a whole."""


class RankBPE:
    """Encoder and decoder for one vocabulary file of the `tokenizers` library (kind BPE, byte level).

    With `library`, pieces that are not kept are left to the tiktoken library instead of the rank array: for jobs whose
    own work is another, such as packing.
    """

    def __init__(self, path: str, library: bool = False):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.texts = [b""] * (max([*vocab.values(), *added.values()]) + 1)
        for token, i in vocab.items():
            self.texts[i] = token.encode() if token in added else raw(token)
        for token, i in added.items():
            self.texts[i] = token.encode()
        self.added = added
        self.single = [0] * 256
        for letter, b in letters.items():
            self.single[b] = vocab[letter]
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank.setdefault(vocab[a] << 20 | vocab[b], r)
            self.made.append(vocab[a + b])
        self.find = regex.compile(PATTERN).findall
        self.split_added = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.words = _Kept(lambda w: array("I", self.merge(w.encode())).tobytes())
        self.spaced = _Kept(self._spaced)
        if library:
            import tiktoken

            ranks = {text: i for i, text in enumerate(self.texts) if i not in set(added.values())}
            ordinary = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            self._cut = lambda text: array("I", ordinary(text)).tobytes()
        else:
            self._cut = lambda text: b"".join(map(self.words.__getitem__, self.find(text)))

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pre-token by the rank array."""
        ids = [self.single[b] for b in word]
        if len(ids) > SHORT:
            return self._merge_long(ids)
        rank, made = self.rank.get, self.made
        bounds = list(range(len(ids) + 1))
        ranks = [rank(a << 20 | b, NONE) for a, b in zip(ids, ids[1:])]
        while ranks:
            least = min(ranks)
            if least == NONE:
                break
            i = ranks.index(least)
            ids[i] = made[least]
            del ids[i + 1], bounds[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(ids[i - 1] << 20 | ids[i], NONE)
            if i < len(ranks):
                ranks[i] = rank(ids[i] << 20 | ids[i + 1], NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        rank, n = self.rank.get, len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank(ids[i] << 20 | ids[i + 1], NONE)) != NONE]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = self.made[r], False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for left in (before[i], i):
                right = after[left] if left >= 0 else n
                if left >= 0 and right < n and (q := rank(ids[left] << 20 | ids[right], NONE)) != NONE:
                    heapq.heappush(heap, (q, left, ids[left], ids[right]))
        return [x for x, on in zip(ids, alive) if on]

    def _spaced(self, piece: str) -> bytes:
        if not piece or piece[0].isspace() or piece[-1].isspace():
            raise _Uneven
        return self._cut(" " + piece)

    def _plain(self, text: str) -> bytes:
        head, *rest = text.split(" ")
        try:
            if head and head[-1].isspace():
                raise _Uneven
            return b"".join([self._cut(head), *map(self.spaced.__getitem__, rest)])
        except _Uneven:
            return self._cut(text)

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers; added tokens in the text become their own ids."""
        if self.split_added is None or not any(t in text for t in self.added):
            return self._plain(text)
        out, at = [], 0
        for m in self.split_added.finditer(text):
            out += [self._plain(text[at : m.start()]), np.array([self.added[m[0]]], "<u4").tobytes()]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.texts.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def encoder(path: str, library: bool = False) -> RankBPE:
    """One encoder for each worker and vocabulary file."""
    return RankBPE(path, library)


def _mapped(df: DataFrame, source: str, target: str, kind: T.DataType, arrow: pa.DataType, make) -> DataFrame:
    rest = [c for c in df.columns if c not in (source, target)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                values = [f(v) for v in part.column(source).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), pa.array(values, arrow)], [*rest, target])

    schema = T.StructType([*(df.schema[c] for c in rest), T.StructField(target, kind)])
    return df.select(*(F.col(f"`{c}`") for c in [*rest, source])).mapInArrow(run, schema)


def bpe_encode(df: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None) -> DataFrame:
    """Replaces column `text` by binary column `ids`. Null text: no ids. All other columns are kept."""
    path = path or tokenizer_path()
    return _mapped(df, text, ids, T.BinaryType(), pa.binary(), lambda: (lambda e: lambda v: e.encode(v or ""))(encoder(path)))


def bpe_decode(df: DataFrame, ids: str = "ids", text: str = "text", path: str | None = None) -> DataFrame:
    """Replaces binary column `ids` by column `text`, added tokens included. Null ids: empty text."""
    path = path or tokenizer_path()
    return _mapped(df, ids, text, T.StringType(), pa.string(), lambda: (lambda e: lambda v: e.decode(v or b""))(encoder(path)))


def op2_bpe_round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Digests of encoding and decoding each whole text: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    coded = bpe_encode(docs.select("doc_id", "text"), path=path).withColumns(
        {"n_tokens": (F.octet_length("ids") / 4).cast("long"), "ids_sha256": F.sha2("ids", 256)}
    )
    back = bpe_decode(coded, text="decoded", path=path)
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
