"""Operator 8: token counts by heap-and-linked-list byte-pair merging, without making identifiers.

Works on sentencepiece BPE models with identity normalisation, a dummy prefix and byte fallback. The text is cut where no
piece of the vocabulary spans two neighbouring characters (no merge can cross there), and counts of such slices are cached
in bounded memory. A count is initial symbols minus merges, plus the extra bytes of characters outside the vocabulary.

Nulls: a null text counts as empty (0 tokens); a null doc_id is carried along. Repeated rows are counted one by one, an
empty table gives no rows, other columns are ignored, whatever their names. Ties: equal ranks merge from the left. Very long
texts are read whole, slices of LONG characters or more are not kept in the cache.
"""

from __future__ import annotations

import heapq

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .common import map_rows, table

LIMIT = 4096
CACHE = 400_000
#: Slices of so many characters are counted anew each time, so that the cache is bounded in bytes too.
LONG = 200
SPACE = "▁"


class MergeCounter(dict):
    """Slice between spaces (without its leading space) -> token count; holds at most `limit` slices, none of them long."""

    def __init__(self, model_path: str, limit: int = CACHE):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.limit = limit
        self.rank: dict[str, float] = {}
        self.pairs: set[str] = set()
        for i in range(sp.get_piece_size()):
            if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                continue
            piece = sp.id_to_piece(i)
            self.rank[piece] = -sp.get_score(i)  # low rank merges first
            self.pairs.update(a + b for a, b in zip(piece, piece[1:]))
        if any(p[1] == SPACE and p[0] != SPACE for p in self.pairs):
            raise ValueError("a piece holds a space after another character; slices between spaces would not be exact")

    def merged(self, symbols: str) -> int:
        """The count of one slice: a heap of adjacent pairs by (rank, place) over a linked list of symbols."""
        rank, n = self.rank, len(symbols)
        extra = sum(len(c.encode()) - 1 for c in symbols if c not in rank)
        if n < 2:
            return n + extra
        text, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank[p], i, p) for i in range(n - 1) if (p := symbols[i : i + 2]) in rank]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, whole = heapq.heappop(heap)
            j = after[i] if text[i] else n
            if j >= n or text[i] + text[j] != whole:
                continue  # one of the two has been merged since
            text[i], text[j] = whole, ""
            merges += 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (p := whole + text[k]) in rank:
                    heapq.heappush(heap, (rank[p], i, p))
            h = before[i]
            if h >= 0 and (p := text[h] + whole) in rank:
                heapq.heappush(heap, (rank[p], h, p))
        return n - merges + extra

    def slice_count(self, symbols: str) -> int:
        """Cuts where no piece spans and adds up."""
        start = total = 0
        pairs = self.pairs
        for i in range(1, len(symbols)):
            if symbols[i - 1 : i + 1] not in pairs:
                total += self.merged(symbols[start:i])
                start = i
        return total + self.merged(symbols[start:])

    def __missing__(self, word: str) -> int:
        found = self.slice_count(SPACE + word)
        if len(self) < self.limit and len(word) < LONG:
            self[word] = found
        return found

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        if not text:
            return 0
        if SPACE in text or "  " in text or text[-1] == " " or text[0] == " ":
            total, spaces = 0, 0
            for part in text.replace(SPACE, " ").split(" "):
                spaces += 1
                if part:
                    total += self[part] if spaces == 1 else self.slice_count(SPACE * spaces + part)
                    spaces = 0
            return total + (self.slice_count(SPACE * spaces) if spaces else 0)
        return sum(map(self.__getitem__, text.split(" ")))


def token_counts(docs: DataFrame, model_path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(doc_id, text) -> doc_id, n_bytes, n_tokens, over_limit."""
    path, state = model_path or public_tokenizers.path("piece_bpe_32k.model"), {}

    def work(columns):
        counter = state.get("counter") or state.setdefault("counter", MergeCounter(path))
        texts = [t or "" for t in columns[1]]
        n = [counter.count(t) for t in texts]
        return {"doc_id": columns[0], "n_bytes": [len(t.encode()) for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

    return map_rows(docs.select("doc_id", "text"), work, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents", "doc_id", "text"))
