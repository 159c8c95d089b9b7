"""Token counts by prefix dynamic programming over SentencePiece text.

The count of tokens is known at every prefix of a text, in two levels that add up:

1. No piece of the vocabulary has a word mark after another character, so no merge
   crosses the start of a segment (a run of word marks and what follows it).  The
   count at a segment's end is the count before it plus the segment's own: one
   addition a segment, with each distinct segment counted once a task.
2. Within a segment, a sequence of pieces is the encoding just if each two
   neighbours are the encoding of what they spell together.  So the last piece of a
   prefix is the one piece that ends there and agrees with the last piece before it,
   and the prefix has one token more than that shorter prefix.  Each place looks at
   the pieces that end there only; no prefix is encoded again.  Whether two pieces
   agree is asked of the library once a task and remembered.

Truncation and budget questions are answered from these counts: ``cut_for_budget`` and
``tokens_of_prefix`` from the stored ones, ``longest_fit`` within the pass over a text.
A longer prefix may have fewer tokens (a merge), so the longest fit is the last place
that fits, not the place before the first that doesn't.

The properties are checked on the vocabulary when it is loaded.  Defined results: a
null or empty text has no bytes and no tokens, and its one prefix, the empty one, has
none; rows are kept one for one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

MARK = "▁"
SEGMENT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Distinct segments (of at most so many characters) and pairs of pieces that a task
#: remembers: memory only, counts don't depend on it.
MEMORY, REMEMBERED = 300_000, 64
#: A character that no piece has: nothing merges with it.
BARRIER = "\ue000"


@lru_cache(maxsize=2)
def _processor(model: str):
    """The library's processor, its pieces (without bytes and control signs) and the tokens of BARRIER."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    pieces = {sp.id_to_piece(i) for i in range(sp.vocab_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
    ahead = len(sp.encode(BARRIER))
    whole = list(pieces)
    own = sp.encode([BARRIER + p for p in whole], num_threads=1)
    if any(MARK in p.lstrip(MARK) for p in pieces) or not sp.encode(" a", out_type=str)[0].startswith(MARK) or any(BARRIER in p for p in pieces) or any(len(x) != ahead + 1 for x in own):
        raise ValueError(f"{model}: merges cross segments, or pieces aren't their own encoding; prefix counts would not be exact")
    return sp, frozenset(pieces), ahead


def segments(text: str) -> list[str]:
    """The text as the library sees it (a leading mark, marks for spaces), cut before each run of marks."""
    if not text:
        return []
    if MARK not in text and "  " not in text and text[0] != " " and text[-1] != " ":
        return [MARK + w for w in text.split(" ")]
    return SEGMENT.findall(MARK + text.replace(" ", MARK))


class PrefixCounter:
    """Counts of prefixes of texts, with the counts of segments and pairs of pieces remembered."""

    def __init__(self, model: str):
        self.sp, self.pieces, self.ahead = _processor(model)
        self.longest = max(map(len, self.pieces))
        self.known: dict[str, int] = {}
        self.agreed: dict[tuple[str, str], bool] = {}

    def own(self, parts: list[str]) -> list[int]:
        """Tokens of each segment."""
        got = list(map(self.known.get, parts))
        if None in got:
            if len(self.known) > MEMORY:
                self.known.clear()
            new = [p for p in dict.fromkeys(parts) if p not in self.known]
            # The library puts one mark before each text, so a segment's first mark is left out.
            found = dict(zip(new, map(len, self.sp.encode([p[1:] for p in new], num_threads=1))))
            if MARK in found:  # the library gives an empty text no token, but a lone mark is one
                found[MARK] = 1
            got = [found[p] if n is None and p in found else n if n is not None else self.known[p] for p, n in zip(parts, got)]
            self.known.update((p, n) for p, n in found.items() if len(p) <= REMEMBERED)
        return got

    def agree(self, a: str, b: str) -> bool:
        """Are two neighbouring pieces the encoding of what they spell?"""
        found = self.agreed.get((a, b))
        if found is None:
            if len(self.agreed) > MEMORY:
                self.agreed.clear()
            found = self.agreed[a, b] = self.sp.encode(BARRIER + a + b, out_type=str)[self.ahead :] == [a, b]
        return found

    def within(self, segment: str) -> list[int]:
        """Tokens of every prefix of a segment, the empty one first."""
        counts, last = [0], [""]
        for end in range(1, len(segment) + 1):
            sign = segment[end - 1]
            if sign not in self.pieces:  # spelt by its bytes; nothing merges with it
                counts.append(counts[-1] + len(sign.encode()))
                last.append("")
                continue
            for start in range(max(0, end - self.longest), end):
                piece = segment[start:end]
                if piece in self.pieces and (not last[start] or self.agree(last[start], piece)):
                    counts.append(counts[start] + 1)
                    last.append(piece)
                    break
            else:
                raise ValueError(f"no piece ends at {end} of {segment!r}")
        return counts

    def ends(self, text: str) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Segments of a text, where they end (code points of the text), and the tokens up to there."""
        parts = segments(text)
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts))) - 1
        return parts, ends, np.cumsum(np.array(self.own(parts), np.int64))

    def every(self, text: str) -> np.ndarray:
        """Tokens of every prefix of a text, the empty one first."""
        parts, _, done = self.ends(text)
        out = [np.zeros(1, np.int64)]
        for i, part in enumerate(parts):
            own = np.array(self.within(part)[1 if i else 2 :], np.int64)  # the first mark is not in the text
            out.append(own + (done[i - 1] if i else 0))
        return np.concatenate(out)

    def longest_fit(self, text: str, limit: int) -> tuple[int, int]:
        """Tokens of a text, and code points of its longest prefix of at most limit tokens."""
        parts, ends, done = self.ends(text)
        if not parts or done[-1] <= limit:
            return (int(done[-1]) if parts else 0), len(text)
        i = int(np.searchsorted(done, limit, side="right"))  # the first segment that ends beyond the limit
        start, before = (int(ends[i - 1]), int(done[i - 1])) if i else (-1, 0)
        inside = self.within(parts[i])
        fits = max(k for k, n in enumerate(inside) if before + n <= limit)
        return int(done[-1]), max(0, start + fits)


def prefix_counts(documents: DataFrame, model: str, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, prefix_tokens): ``prefix_tokens[k]`` is the exact token count of the first k code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PrefixCounter(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = [t or "" for t in part.column(1).to_pylist()]
                found = [counter.every(t) for t in texts]
                columns = [part.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array([int(x[-1]) for x in found], pa.int64()), pa.array([x.astype(np.int32) for x in found], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_tokens", "prefix_tokens"])

    kind = documents.schema[id_col].dataType.simpleString()
    return documents.select(F.col(id_col).alias("doc_id"), "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, prefix_tokens array<int>")


def cut_for_budget(budget: int) -> Column:
    """Code points of the longest prefix of at most ``budget`` tokens, from the stored counts."""
    return F.array_max(F.transform("prefix_tokens", lambda n, k: F.when(n <= budget, k)))


def tokens_of_prefix(n_chars: Column) -> Column:
    """Tokens of the first n_chars code points, from the stored counts."""
    return F.get("prefix_tokens", n_chars)


def token_counts(documents: DataFrame, model: str, limit: int, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, chars_in_limit): the count of each whole text and its longest prefix within the limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PrefixCounter(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                found = np.array([counter.longest_fit(t, limit) for t in texts], np.int64).reshape(-1, 2)
                columns = [part.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(found[:, 0]), pa.array(found[:, 1])]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_tokens", "chars_in_limit"])

    kind = documents.schema[id_col].dataType.simpleString()
    return documents.select(F.col(id_col).alias("doc_id"), "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, chars_in_limit long")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every whole text of ``documents``."""
    import public_tokenizers

    counts = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), 4096)
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"), "chars_in_limit")
