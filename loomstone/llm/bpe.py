"""Byte-level BPE encoding and decoding by dynamic programming over prefixes.

For a piece of text of n bytes there is exactly one BPE encoding of each prefix, so it is enough to store
the last token of every prefix. An Aho-Corasick automaton over the vocabulary gives, at each position, the
tokens that are suffixes of the prefix; of these exactly one is compatible with the last token of the prefix
before it, that is, the two encode to themselves when put side by side. Back-pointers from the end then give
the ids. Work is linear in the number of matches, also for pieces of many thousand bytes.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers.pre_tokenizers import ByteLevel

from loomstone.llm.common import Known, id_and_text, map_arrow, resident

#: White space as the tokenizer's pattern language counts it.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Fixed value: the pre-tokenizer's pattern, part of the vocabulary's definition.
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Words with at most one space before them, and the rest of the white space: no piece crosses these bounds.
CHUNKS = rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"

#: Unicode version whose letters and digits are the same for the pattern's engine here and for the tokenizers library; newer
#: characters go through the library's own splitter, as its tables are of another version than those of ``regex``.
SETTLED = unicodedata.ucd_3_2_0

#: Bounds of the caches in a worker (entries).
CHUNK_CACHE, PAIR_CACHE = 600_000, 400_000
ENDLESS = 1 << 60


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves and the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


@lru_cache(maxsize=1)
def newer_characters() -> re.Pattern:
    """Characters that SETTLED does not assign."""
    ranges, category = [], SETTLED.category
    for c in range(128, 0x110000):
        if category(chr(c)) == "Cn":
            if ranges and ranges[-1][1] == c - 1:
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges) + "]")


class ByteBPE:
    """One vocabulary: tables, automaton and bounded caches. Built once in each Python worker, and let go there when another operator's task begins."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, byte_of = spec["model"], byte_of_char()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ids = {t: i for t, i in model["vocab"].items() if t not in self.special}
        self.token_bytes: list[bytes] = [b""] * (1 + max([*ids.values(), *self.special.values()]))
        for t, i in ids.items():
            self.token_bytes[i] = bytes(byte_of[c] for c in t)
        for t, i in self.special.items():
            self.token_bytes[i] = t.encode()
        self.rank: dict[tuple[int, int], int] = {}
        made: dict[int, tuple[int, int, int]] = {}
        for r, (a, b) in enumerate(x.split(" ") if isinstance(x, str) else x for x in model["merges"]):
            pair = (ids[a], ids[b])
            self.rank.setdefault(pair, r)
            made.setdefault(ids[a + b], (*pair, r))
        # What stands at a token's right and left edge while it grows, each with the rank of the merge that ends it.
        self.right, self.left = {}, {}
        for i in ids.values():
            for side, edges in ((1, self.right), (0, self.left)):
                spine, t, until = [], i, ENDLESS
                while True:
                    spine.append((t, until))
                    if t not in made:
                        break
                    t, until = made[t][side], made[t][2]
                edges[i] = spine[::-1]
        self.whole = {self.token_bytes[i]: i for i in ids.values()}
        self.automaton = ahocorasick.Automaton()
        for b, i in self.whole.items():
            self.automaton.add_word(b.decode("latin-1"), (i, len(b)))
        self.automaton.make_automaton()
        self.fits: dict[int, bool] = {}
        self.chunks = Known(self.chunk, CHUNK_CACHE)
        self.decimal = [str(i) for i in range(len(self.token_bytes))]
        self.pieces = regex.compile(PIECES)
        self.words = re.compile(CHUNKS)
        self.newer, self.splitter = newer_characters(), ByteLevel(add_prefix_space=False, use_regex=True)
        self.apart = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def compatible(self, a: int, b: int) -> bool:
        """Whether the tokens stay two when their bytes are encoded together: replay both edges in order of rank and
        look for a merge across the border that comes first (of equal ranks, the leftmost pair merges first)."""
        ra, lb, i, j = self.right[a], self.left[b], 0, 0
        rank = self.rank.get
        while True:
            (x, x_until), (y, y_until) = ra[i], lb[j]
            across = rank((x, y), ENDLESS)
            if across < x_until and across <= y_until and across < ENDLESS:
                return False
            if x_until == y_until == ENDLESS:
                return True
            if x_until <= y_until:
                i += 1
            else:
                j += 1

    def encode_piece(self, piece: bytes) -> list[int]:
        if piece in self.whole:
            return [self.whole[piece]]
        n, fits = len(piece), self.fits
        last, back = [-1] * (n + 1), [0] * (n + 1)
        for end, (token, size) in self.automaton.iter(piece.decode("latin-1")):
            end += 1
            if last[end] >= 0:
                continue
            start = end - size
            if start:
                pair = last[start] << 32 | token
                ok = fits.get(pair)
                if ok is None:
                    if len(fits) >= PAIR_CACHE:
                        fits.clear()
                    ok = fits[pair] = self.compatible(last[start], token)
                if not ok:
                    continue
            last[end], back[end] = token, start
        out = []
        while n:
            out.append(last[n])
            n = back[n]
        return out[::-1]

    def encode_pieces(self, chunk: str) -> list[int]:
        if not chunk.isascii() and self.newer.search(chunk):
            pieces = [chunk[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(chunk)]
        else:
            pieces = self.pieces.findall(chunk)
        return [i for p in pieces for i in self.encode_piece(p.encode())]

    def chunk(self, chunk: str) -> bytes:
        if chunk.isascii() and chunk[1:].isalpha():  # one piece: letters after at most one other character, a space or a letter
            ids = self.encode_piece(chunk.encode()) if chunk[0] == " " or chunk[0].isalpha() else self.encode_pieces(chunk)
        else:
            ids = self.encode_pieces(chunk)
        return array("I", ids).tobytes()

    def ids(self, text: str) -> np.ndarray:
        found, known = [], self.chunks.__getitem__
        parts = self.apart.split(text) if self.apart and any(t in text for t in self.special) else (text,)
        for part in parts:
            if part in self.special:
                found.append(np.array([self.special[part]], "<u4").tobytes())
            else:
                found += map(known, self.words.findall(part))
        return np.frombuffer(b"".join(found), "<u4")

    def encode(self, text: str) -> tuple[np.ndarray, str]:
        """The ids as an array, and as decimal text joined by commas."""
        ids = self.ids(text)
        return ids, ",".join(map(self.decimal.__getitem__, ids.tolist()))

    def decode(self, ids: Iterator[int]) -> str:
        """Bytes that are not UTF-8 become U+FFFD; ids outside the vocabulary give nothing."""
        table, n = self.token_bytes, len(self.token_bytes)
        try:
            return b"".join([table[i] for i in ids]).decode("utf-8", "replace")
        except IndexError:
            return b"".join([table[i] for i in ids if 0 <= i < n]).decode("utf-8", "replace")


def vocabulary(path: str) -> ByteBPE:
    return resident(("byte-bpe", path), lambda: ByteBPE(path))


def bpe_encode(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, ids array<int>.

    A null or empty text gives an empty array; a null doc_id stays null; repeated rows are encoded each; other
    columns are left out, so none can clash; an empty table gives an empty table. No shuffle.
    """
    path = tokenizer or default_path()

    def make():
        bpe = vocabulary(path)

        def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
            arrays = [bpe.ids(t) for t in batch.column(1).to_pylist()]
            offsets = np.zeros(len(arrays) + 1, np.int32)
            np.cumsum([len(a) for a in arrays], out=offsets[1:])
            values = pa.array(np.concatenate(arrays).astype(np.int32) if arrays else np.zeros(0, np.int32))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), values)], ["doc_id", "ids"])

        return fn

    return map_arrow(id_and_text(docs, id_col, text_col), make, "doc_id long, ids array<int>", rows=256, keeps=("byte-bpe", path))


def bpe_decode(encoded: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: doc_id, text. A null array gives an empty text; unknown ids and null ids give nothing."""
    path = tokenizer or default_path()

    def make():
        bpe = vocabulary(path)

        def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [bpe.decode([i for i in ids or () if i is not None]) for ids in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

        return fn

    from pyspark.sql import functions as F

    return map_arrow(encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")), make, "doc_id long, text string", rows=256, keeps=("byte-bpe", path))


def bpe_round_trip(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, then decode the ids, in one pass over the texts; of both results the digests: doc_id, n_tokens,
    ids_sha256 (of the decimal ids joined by commas), decoded_sha256. Edge cases as in bpe_encode."""
    path = tokenizer or default_path()

    def make():
        bpe, sha = vocabulary(path), hashlib.sha256

        def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts, of_ids, of_texts = [], [], []
            for text in batch.column(1).to_pylist():
                ids, decimal = bpe.encode(text)
                counts.append(len(ids))
                of_ids.append(sha(decimal.encode()).hexdigest())
                of_texts.append(sha(bpe.decode(ids.tolist()).encode()).hexdigest())
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_texts, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return fn

    return map_arrow(id_and_text(docs, id_col, text_col), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", rows=256, keeps=("byte-bpe", path))
