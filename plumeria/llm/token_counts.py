"""Token counts by the whole-token shortcut, for sentencepiece BPE vocabularies.

The library puts a mark (U+2581) before the text and in place of every space, then merges. Where
no piece holds the mark after another character, no merge crosses the start of a word; a
character that no longer piece holds (such as a newline) is a boundary too. So the text falls
into parts, each a run of marks with what follows it or what follows a boundary character, and
the counts of the parts add up. Both facts are checked when a vocabulary is loaded; one without
them is refused.

Offline, every piece is encoded alone, and those that come back as one token are proven whole: a
part that equals one counts 1 without a merge. Only the other parts are merged, once each, and
kept in a memo of bounded size.

Nulls and empty texts count 0 tokens. Repeated rows stay repeated; an empty table gives no rows; other
columns play no part. A text without any boundary is one part and is merged at once, as the library would.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumeria.llm.common import ship

MARK = "▁"
#: Parts kept in a worker's memo before it is emptied, and the longest part that is kept.
MEMO_PARTS, MEMO_CHARS = 400_000, 64


class PartCounts(dict):
    """part -> number of tokens. A part starts with spaces (for marks), or follows a boundary character."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=model_path)
        skip = lambda i: m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i)
        pieces = {i: m.id_to_piece(i) for i in range(m.get_piece_size()) if not skip(i)}
        if any(MARK in p.lstrip(MARK) for p in pieces.values()):
            raise ValueError("a piece crosses the start of a word")
        if m.encode("  a") != m.encode(MARK + MARK + "a") or len(m.encode("a  ")) < 2:
            raise ValueError("the model drops or changes white space")
        joined = {c for p in pieces.values() if len(p) > 1 for c in p}
        self.breaks = [c for c in "\n\t" if c not in joined]
        if not self.breaks:
            raise ValueError("no boundary character")
        self.lead = len(m.encode(self.breaks[0]))  # the mark and a boundary character
        b = re.escape("".join(self.breaks))
        self.split = re.compile(f"[ {MARK}]+[^ {MARK}{b}]*|[^ {MARK}{b}]+|[{b}]").findall
        self.proven = {}
        for i, p in pieces.items():
            part = p.replace(MARK, " ")
            alone = m.encode(part[1:]) if part[0] == " " and len(part) > 1 else m.encode(self.breaks[0] + part)[self.lead :]
            if part == " " or alone == [i]:
                self.proven[part] = 1
        for c in self.breaks:
            self.proven[c] = len(m.encode(c)) - 1
        self.update(self.proven)

    def merged(self, part: str) -> int:
        if part[0] in (" ", MARK) and len(part) > 1:
            return len(self.model.encode(part[1:]))  # the library puts the first mark itself
        return len(self.model.encode(self.breaks[0] + part)) - self.lead

    def __missing__(self, part: str) -> int:
        n = self.merged(part)
        if len(part) <= MEMO_CHARS:
            if len(self) > MEMO_PARTS + len(self.proven):
                self.clear()
                self.update(self.proven)
            self[part] = n
        return n

    def count(self, text: str | None) -> int:
        return sum(map(self.__getitem__, self.split(" " + text))) if text else 0


@lru_cache(maxsize=2)
def part_counts(model_path: str) -> PartCounts:
    """One for each worker process."""
    return PartCounts(model_path)


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens). ``model_path``: a sentencepiece BPE model that every executor has at that path."""
    ship(docs.sparkSession)

    @F.pandas_udf("long")
    def n_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = part_counts(model_path).count
        for texts in batches:
            yield pd.Series([count(t) for t in texts], dtype="int64")

    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"), n_tokens(text).alias("n_tokens"))
