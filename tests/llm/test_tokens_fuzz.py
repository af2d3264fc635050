"""Token operators against their libraries on generated texts."""

import base64

import numpy as np
import public_tokenizers as P
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from abacora.llm.byte_bpe import PairMerger, id_offsets
from abacora.llm.token_counts import MergeCounter

PARTS = ["a", "b", "s", "t", "'", "'s", "'ll", "'re", "'ve", " ", "  ", "\n", "\t", "\r\n", "1", "23", ".", "!", "é", "日", " ", "\u3000", "▁", "the", "ing", "\x1c", "́", "👍", "½", "\x00", "<s>", "<0x41>", "<|endoftext|>"]
texts = st.one_of(st.lists(st.sampled_from(PARTS), max_size=40).map("".join), st.text(max_size=60).filter(lambda t: t.encode("utf-8", "ignore").decode() == t))
with open(P.path("byte_bpe_50k.tiktoken"), "rb") as lines:
    RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
CODER = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
MERGER = PairMerger(P.path("byte_bpe_50k.tiktoken"))
PIECES = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
COUNTER = MergeCounter(P.path("piece_bpe_32k.model"))


@settings(max_examples=1500, deadline=None)
@given(texts)
def test_byte_bpe(text):
    slices, offsets = MERGER.encode(text)
    ids = b"".join(slices)
    assert ids == np.array(CODER.encode_ordinary(text), "<u4").tobytes()
    decoded, begins = MERGER.decode(ids, id_offsets(slices))
    assert decoded == text.encode() and len(begins) == len(offsets)
    assert offsets.tolist() == sorted(set(offsets.tolist())) and (not text or offsets[0] == 0)


@settings(max_examples=700, deadline=None)
@given(st.lists(texts, max_size=6))
def test_texts_cut_together_are_cut_alike(several):
    for text, (slices, offsets) in zip(several, MERGER.encode_all(several), strict=True):
        alone, where = MERGER.encode(text)
        assert slices == alone and offsets.tolist() == where.tolist()


@settings(max_examples=1500, deadline=None)
@given(texts)
def test_piece_counts(text):
    assert COUNTER.count(text) == len(PIECES.encode(text))


def test_very_long_runs():
    for text in ("a" * 20_000, " " * 5_000, "\n" * 5_000, "ab" * 9_000, "é" * 3_000):
        assert b"".join(MERGER.encode(text)[0]) == np.array(CODER.encode_ordinary(text), "<u4").tobytes()
        assert COUNTER.count(text) == len(PIECES.encode(text))
