"""Operator 10: byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Boundaries are found without a regular expression: every code point is mapped to a class by one table, every class is a
transition function over a few states, and the functions are composed by an associative scan (blocks first, then the
blocks' products, then each block from its true entry state). The slices between boundaries go through cached pair
merging by rank; the offsets of their ids are kept, and decoding says where each slice begins in the bytes.

Nulls: a null text is empty; a null doc_id is carried along. Repeated rows are coded one by one, an empty table gives no
rows, other columns are ignored, whatever their names. Very long texts: boundaries take a few arrays of the text's length,
slices of over 512 bytes are merged with a heap, those of over 200 characters are not kept in the cache.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, SparkSession

from .common import map_rows, table

CACHE = 400_000
BLOCK = 64
#: Characters of texts that are cut by one scan, about.
TOGETHER = 1 << 18
#: Classes of code points.
LETTER, NUMBER, OTHER, BLANK, GAP, QUOTE = range(6)
#: States of the scan: in a run of letters, of numbers, of other signs, after a space, after other white space, and in a
#: contraction: just behind a quote that opens a token.
IN_LETTER, IN_NUMBER, IN_OTHER, AFTER_BLANK, AFTER_GAP, OPEN_QUOTE = range(6)


def members(pattern: str) -> np.ndarray:
    """The code points that a pattern of one character matches, by the library's own Unicode tables."""
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    library = tiktoken.Encoding("classes", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    return np.frombuffer(bytes(library.encode_ordinary(every)).decode().encode("utf-32-le"), "<u4")


def class_table() -> np.ndarray:
    """The class of every code point. Letters, numbers and white space are those of the library's Unicode version, which may
    be newer than Python's."""
    out = np.full(0x110000, OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", GAP)):
        out[members(pattern)] = kind
    out[32], out[39] = BLANK, QUOTE
    return out


def transitions() -> np.ndarray:
    """[class, state] -> state. A quote opens a contraction unless it goes on with a run of signs or follows a space."""
    f = np.empty((6, 6), np.uint8)
    f[LETTER], f[NUMBER], f[OTHER], f[BLANK], f[GAP] = IN_LETTER, IN_NUMBER, IN_OTHER, AFTER_BLANK, AFTER_GAP
    f[QUOTE] = OPEN_QUOTE
    f[QUOTE, [IN_OTHER, AFTER_BLANK, OPEN_QUOTE]] = IN_OTHER
    return f


def scan(classes: np.ndarray, f: np.ndarray, start: int, block: int = BLOCK) -> np.ndarray:
    """The state behind each position: an associative scan over compositions of transition functions."""
    n = len(classes)
    if n <= block:
        out, s = np.empty(n, np.uint8), start
        for i, c in enumerate(classes.tolist()):
            out[i] = s = f[c, s]
        return out
    blocks = n // block
    head = np.ascontiguousarray(classes[: blocks * block].reshape(blocks, block).T)
    product = np.tile(np.arange(f.shape[1], dtype=np.uint8), (blocks, 1))
    for row in head:  # compose within all blocks at once
        product = f[row[:, None], product]
    entry = np.empty(blocks, np.uint8)
    entry[0] = start
    entry[1:] = _through(product, start)[:-1]
    out, s = np.empty((block, blocks), np.uint8), entry
    for i, row in enumerate(head):
        out[i] = s = f[row, s]
    whole = out.T.reshape(-1)
    return np.concatenate([whole, scan(classes[blocks * block :], f, int(whole[-1]), block)])


def _through(products: np.ndarray, start: int) -> np.ndarray:
    """States behind each block: doubling over function composition."""
    total, step = products.copy(), 1
    while step < len(total):
        total[step:] = np.take_along_axis(total[step:], total[:-step].copy(), axis=1)
        step *= 2
    return total[:, start]


_STATE: dict = {}


def boundaries(points: np.ndarray, edges=()) -> np.ndarray:
    """Where tokens of the pattern begin, as positions in the code points (0 first; none for an empty text), and at edges."""
    if not len(points):
        return np.empty(0, np.int64)
    if "table" not in _STATE:
        _STATE["table"], _STATE["f"] = class_table(), transitions()
    kind = _STATE["table"][points]
    state = scan(kind, _STATE["f"], AFTER_GAP)
    white = (kind == BLANK) | (kind == GAP)
    run = np.where(kind == QUOTE, OTHER, kind)  # runs do not tell quotes from other signs
    cut = np.ones(len(points), bool)
    w, r = white[1:], run[1:]
    follows_white = white[:-1]
    same = (r == run[:-1]) & ~w & ~follows_white
    joined = ~w & (kind[:-1] == BLANK)  # a space goes with what follows
    last_of_run = np.append(~white[2:], False)  # the last of some white space, if something follows, stands alone
    inside = w & follows_white & ~last_of_run
    cut[1:] = ~(same | joined | inside)
    # contractions: the quote and one or two letters are a token, whatever letters follow
    quote = np.flatnonzero(state == OPEN_QUOTE)
    if len(quote):
        padded = np.append(points, [0, 0])
        a, b = padded[quote + 1], padded[quote + 2]
        one = np.isin(a, [115, 116, 109, 100])  # s t m d
        two = ((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108))  # re ve ll
        for hit, size in ((quote[one], 2), (quote[two], 3)):
            for k in range(1, size):
                cut[hit + k] = False
            end = hit + size
            cut[end[end < len(points)]] = True
    cut[edges] = True
    return np.flatnonzero(cut)


class PairMerger(dict):
    """Slice of text -> its ids as little-endian unsigned 32-bit bytes, by merging the adjacent pair of lowest rank."""

    def __init__(self, ranks_path: str, limit: int = CACHE):
        with open(ranks_path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self.limit = limit
        self.sizes = np.zeros(max(self.bytes_of, default=0) + 1, np.int64)
        for number, raw in self.bytes_of.items():
            self.sizes[number] = len(raw)

    def merge(self, raw: bytes) -> list[int]:
        ranks = self.ranks
        if raw in ranks:
            return [ranks[raw]]
        if len(raw) > 512:
            return self._merge_long(raw)
        parts = [raw[i : i + 1] for i in range(len(raw))]
        none = len(ranks) + 256
        keys = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
        while keys:
            low = min(keys)
            if low == none:
                break
            i = keys.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del keys[i]
            if i < len(keys):
                keys[i] = ranks.get(parts[i] + parts[i + 1], none)
            if i:
                keys[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
        return [ranks[p] for p in parts]

    def _merge_long(self, raw: bytes) -> list[int]:
        """The same by a heap over a linked list, for runs of thousands of bytes."""
        import heapq

        ranks, n = self.ranks, len(raw)
        part, after, before = [raw[i : i + 1] for i in range(n)], list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, raw[i : i + 2]) for i in range(n - 1) if (r := ranks.get(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i] if part[i] else n
            if j >= n or part[i] + part[j] != pair:
                continue
            part[i], part[j] = pair, b""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get(pair + part[k])) is not None:
                    heapq.heappush(heap, (r, i, pair + part[k]))
            h = before[i]
            if h >= 0 and (r := ranks.get(part[h] + pair)) is not None:
                heapq.heappush(heap, (r, h, part[h] + pair))
        return [ranks[p] for p in part if p]

    def __missing__(self, piece: str) -> bytes:
        found = np.array(self.merge(piece.encode()), "<u4").tobytes()
        if len(self) < self.limit and len(piece) < 200:
            self[piece] = found
        return found

    def encode_all(self, texts: list[str]) -> Iterator[tuple[list[bytes], np.ndarray]]:
        """For each text, the ids of its slices and the positions of their first code points.

        Many texts are cut by one scan, a line feed between them: it leads to the state that a text begins in, ends every
        contraction and run, and what it would change at the edges of texts is cut there anyway.
        """
        at = 0
        while at < len(texts):
            end, held = at + 1, len(texts[at])
            while end < len(texts) and held + len(texts[end]) < TOGETHER:
                held += len(texts[end])
                end += 1
            yield from self._encode_together(texts[at:end])
            at = end

    def _encode_together(self, texts: list[str]) -> Iterator[tuple[list[bytes], np.ndarray]]:
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        ends = np.cumsum(sizes) - 1  # of each text, where its line feed stands
        begins, joined = ends + 1 - sizes, "\n".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        starts = boundaries(points, np.concatenate([begins[begins < len(points)], ends[:-1]]))
        first, last = np.searchsorted(starts, begins), np.searchsorted(starts, ends)
        place = [*starts.tolist(), len(joined)]
        for a, i, j, end in zip(begins.tolist(), first.tolist(), last.tolist(), ends.tolist()):
            cut = [*place[i:j], end]
            yield list(map(self.__getitem__, [joined[x:y] for x, y in zip(cut, cut[1:])])), starts[i:j] - a

    def encode(self, text: str) -> tuple[list[bytes], np.ndarray]:
        """The ids of each slice of a text, and the position of its first code point."""
        return next(self._encode_together([text]))

    def decode(self, ids: bytes, offsets=()) -> tuple[bytes, np.ndarray]:
        """The bytes that ids stand for, and where the slices whose ids begin at the offsets begin in them."""
        numbers = np.frombuffer(ids, "<u4")
        ends = np.append(0, np.cumsum(self.sizes[numbers]))
        return b"".join(map(self.bytes_of.__getitem__, numbers.tolist())), ends[np.asarray(offsets, np.int64)]


def id_offsets(slices: list[bytes]) -> np.ndarray:
    """Where each slice's ids begin, counted in ids."""
    sizes = np.fromiter(map(len, slices), np.int64, len(slices)) // 4
    return np.cumsum(sizes) - sizes


def _coder(path: str, state: dict) -> PairMerger:
    return state.get("coder") or state.setdefault("coder", PairMerger(path))


def encode_documents(docs: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """(doc_id, text) -> doc_id, ids (little-endian unsigned 32-bit), offsets (code point each slice starts at), id_offsets
    (id each slice starts at)."""
    path, state = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), {}

    def work(columns):
        both = list(_coder(path, state).encode_all([t or "" for t in columns[1]]))
        return {"doc_id": columns[0], "ids": [b"".join(x) for x, _ in both], "offsets": [o.tolist() for _, o in both], "id_offsets": [id_offsets(x).tolist() for x, _ in both]}

    return map_rows(docs.select("doc_id", "text"), work, "doc_id long, ids binary, offsets array<long>, id_offsets array<long>")


def decode_documents(coded: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """(doc_id, ids, id_offsets) -> doc_id, text_bytes, byte_offsets (byte each slice starts at)."""
    path, state = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), {}

    def work(columns):
        both = [_coder(path, state).decode(x or b"", o or []) for x, o in zip(*columns[1:])]
        return {"doc_id": columns[0], "text_bytes": [b for b, _ in both], "byte_offsets": [o.tolist() for _, o in both]}

    return map_rows(coded.select("doc_id", "ids", "id_offsets"), work, "doc_id long, text_bytes binary, byte_offsets array<long>")


def code_digests(docs: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """Encodes (doc_id, text), decodes the ids, finds every slice again at the offsets that were kept, and returns digests."""
    path, state = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), {}

    def work(columns):
        out = {name: [] for name in ("n_tokens", "n_slices", "ids_sha256", "decoded_sha256")}
        coder = _coder(path, state)
        for slices, starts in coder.encode_all([t or "" for t in columns[1]]):
            ids = b"".join(slices)
            text, begins = coder.decode(ids, id_offsets(slices))
            if len(begins) != len(starts) or (begins[1:] <= begins[:-1]).any():
                raise AssertionError("slices do not come back where they were cut")
            row = len(ids) // 4, len(starts), hashlib.sha256(ids).hexdigest(), hashlib.sha256(text).hexdigest()
            for name, x in zip(out, row):
                out[name].append(x)
        return {"doc_id": columns[0], **out}

    return map_rows(docs.select("doc_id", "text"), work, "doc_id long, n_tokens long, n_slices long, ids_sha256 string, decoded_sha256 string")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_digests(table(spark, sf_dir, "documents", "doc_id", "text"))
