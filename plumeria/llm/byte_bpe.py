"""Byte-level BPE encoding by backtracking over longest matches, and decoding.

The vocabulary's byte strings are mapped to Latin-1 so that a byte is a character, and held in an
Aho-Corasick automaton, whose trie gives the longest token that begins at a place: it is asked at the
places that the encoder comes to, and reads no further than the longest token. The encoder takes
the longest token at each place that is compatible with the token before it; where none is, it
marks the place as a dead end and steps back. A pair of tokens is compatible if no merge across their
border comes before those that make them, so that merging the two byte strings by rank gives just
these two tokens again; a sequence whose adjacent pairs are all compatible is the one that the merges
give. Answers for pairs are memoised and each place is left at most once as a dead end, so for a given
vocabulary the work is linear in the pre-token: its length times, at most, the longest token's.

Whole pre-tokens are memoised too, with bounded size. Decoding joins the byte strings of the ids.

Nulls count as empty texts (no ids). Repeated rows stay repeated; an empty table gives no rows; other
columns play no part. Pre-tokens of any length are encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumeria.llm.common import give_back, ship

#: Pre-tokens and pairs kept by a worker before the memo is emptied; the longest pre-token kept.
MEMO_PARTS, MEMO_PAIRS, MEMO_CHARS = 250_000, 500_000, 64


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merges(data: bytes, ranks: dict[bytes, int]) -> Iterator[list[bytes]]:
    """The definition: merge the adjacent pair of lowest rank, leftmost first, until none is left. All states."""
    parts = [data[i : i + 1] for i in range(len(data))]
    yield parts
    while len(parts) > 1:
        rank, i = min((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank == 1 << 60:
            return
        parts = [*parts[:i], parts[i] + parts[i + 1], *parts[i + 2 :]]
        yield parts


#: Characters that a text may hold to be split by the faster pattern, where the classes have the same meaning.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
PLAIN = re.compile(f"[\t\n\r -~{LETTERS}]*").fullmatch


class ByteBpe(dict):
    """pre-token -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.ranks = ranks
        self.token = {i: t for t, i in ranks.items()}
        self.split_any = regex.compile(pattern).findall
        plain = pattern.replace(r"\s\p{L}\p{N}", rf"\s{LETTERS}0-9").replace(r"\p{L}", f"[{LETTERS}]").replace(r"\p{N}", "[0-9]")
        self.split_plain = self.split_any if r"\p" in plain or r"\w" in plain else re.compile(plain).findall
        self.base = max(ranks.values()) + 1
        self.pairs: dict[int, bool] = {}
        self.parts: dict[int, tuple[int, int]] = {}  # of a token, what its last merge joins
        kept: list[str] = []
        for t, i in ranks.items():
            *_, two, last = [[], *merges(t, ranks)]
            if last == [t]:  # a token that the merges never give can't be part of an answer
                kept.append(t.decode("latin-1"))
                if len(t) > 1:
                    self.parts[i] = ranks[two[0]], ranks[two[1]]
        self.most = max(map(len, kept))
        self.automaton = ahocorasick.Automaton()
        self.longest: dict[str, int] = {}  # prefix of tokens -> the longest token that it starts with
        self.shorter: dict[int, int] = {}  # token -> the next shorter one that it starts with, or -1
        for t in sorted(kept):
            self.automaton.add_word(t, ranks[t.encode("latin-1")])
            at = -1
            for n in range(1, len(t)):
                at = self.longest.setdefault(t[:n], at)
            i = self.longest[t] = ranks[t.encode("latin-1")]
            self.shorter[i] = at
        self.size = {i: len(t) for i, t in self.token.items()}
        self.automaton.make_automaton()

    def split(self, text: str) -> list[str]:
        return self.split_plain(text) if PLAIN(text) else self.split_any(text)

    def chain(self, i: int, side: int) -> list[int]:
        """From a single byte up to the token: what stands at that side of it while it is merged."""
        out = [i]
        while out[-1] in self.parts:
            out.append(self.parts[out[-1]][side])
        return out[::-1]

    def compatible(self, left: int, right: int) -> bool:
        """No merge across the border comes before those that make the two tokens (left ones first), or after."""
        if len(self.pairs) >= MEMO_PAIRS:
            self.pairs.clear()
        ls, rs, a, b, never = self.chain(left, 1), self.chain(right, 0), 0, 0, 1 << 60
        while True:
            next_l = ls[a + 1] if a + 1 < len(ls) else never
            next_r = rs[b + 1] if b + 1 < len(rs) else never
            across = self.ranks.get(self.token[ls[a]] + self.token[rs[b]], never)
            if across < next_l and across <= next_r:
                known = False
                break
            if next_l == next_r == never:
                known = True
                break
            if next_l <= next_r:
                a += 1
            else:
                b += 1
        self.pairs[left * self.base + right] = known
        return known

    def encode_part(self, data: bytes) -> list[int]:
        s = data.decode("latin-1")
        end, base, most = len(s), self.base, self.most
        longest, shorter, size, reach, known = self.longest, self.shorter, self.size, self.automaton.longest_prefix, self.pairs.get
        ids: list[int] = []
        dead = bytearray(end + 1)
        pos, last = 0, -1
        i = longest.get(s[: reach(s[:most])], -1)  # the token to try next, or -1
        while True:
            while i >= 0:
                if not dead[pos + size[i]]:
                    if last < 0:
                        break
                    fits = known(last * base + i)
                    if fits or fits is None and self.compatible(last, i):
                        break
                i = shorter[i]
            if i >= 0:
                ids.append(i)
                last = i
                pos += size[i]
                if pos == end:
                    return ids
                rest = s[pos : pos + most]
                i = longest.get(rest[: reach(rest)], -1)
            elif ids:
                dead[pos] = 1  # no compatible token goes on from here
                ids.pop()
                pos -= size[last]
                i, last = shorter[last], ids[-1] if ids else -1
            else:
                raise ValueError("bytes that the vocabulary does not hold")

    def __missing__(self, part: str) -> bytes:
        packed = array("I", self.encode_part(part.encode())).tobytes()
        if len(part) <= MEMO_CHARS:
            if len(self) >= MEMO_PARTS:
                self.clear()
            self[part] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """ids of a text, packed."""
        return b"".join(map(self.__getitem__, self.split(text)))

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, memoryview(packed).cast("I")))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> ByteBpe:
    """One for each worker process."""
    return ByteBpe(read_ranks(path), pattern)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>): the ids of each text."""
    ship(docs.sparkSession)

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(path, pattern)
        for texts in batches:
            yield pd.Series([memoryview(c.encode(t)).cast("I").tolist() for t in texts])
        give_back()

    return docs.select(id_col, ids(F.coalesce(F.col(text_col), F.lit(""))).alias("ids"))


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, data binary): the bytes of each row's ids. Null ids give no bytes."""
    ship(encoded.sparkSession)

    @F.pandas_udf("binary")
    def data(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        token = codec(path, pattern).token
        for rows in batches:
            yield pd.Series([b"" if r is None else b"".join(map(token.__getitem__, r)) for r in rows])

    return encoded.select(id_col, data(ids_col).alias("data"))


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) in one pass: encode, decode the ids, and hash both."""
    ship(docs.sparkSession)

    @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def summary(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = codec(path, pattern)
        for texts in batches:
            rows = []
            for t in texts:  # one text at a time becomes a string of this process
                packed = c.encode(t.as_py())
                rows.append((len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(c.decode(packed)).hexdigest()))
            n, ids, data = zip(*rows) if rows else ((), (), ())
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(data, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])
        give_back()

    return docs.select(id_col, summary(F.coalesce(F.col(text_col), F.lit(""))).alias("s")).select(id_col, "s.*")
