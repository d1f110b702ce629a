"""The encoder against the library's own ids, and what it keeps."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from descria.llm.tokens import Encoder

ODD = [
    "On. on, ON; the End.\nthe end:\nThe END!", ".x", "x", ". . .", "a.b.c e.g. 3.5 3.", "it's. IT'S, it'\nre 're.", "J̌. ǰ, Ä. ä\nİ i̇",
    "straße. STRASSE, Überß.\nÄ ΣΟΣ. İIıi K k", "x\n.y\n,z\ńe", "a..b,,c?!d", "<|ENDOFTEXT|>. a", "A\r\nB. C", "a\n b", "tail. ", "word1.word2 A1.B2", "你.好 a。b A‍.B",
]


@pytest.mark.parametrize("vocabulary", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_those_of_the_library(vocabulary):
    rng = np.random.default_rng(3)
    parts = np.array([*"aAbzZ.,;:!?'1\n éÉ́̌", "The", "end", "'s", " I", ". ", ".\n"])
    texts = ODD + ["".join(rng.choice(parts, rng.integers(1, 30))) for _ in range(4000)]
    own = Tokenizer.from_file(public_tokenizers.path(vocabulary))
    want = [np.array(x.ids, "<u4").tobytes() for x in own.encode_batch_fast(texts, add_special_tokens=False)]
    encoder = Encoder(public_tokenizers.path(vocabulary))
    assert encoder.encode(pa.array(texts)) == want
    assert [encoder.encode(pa.array([x]))[0] for x in ODD] == want[: len(ODD)]


def test_a_word_is_kept_once_whatever_stands_around_it():
    encoder = Encoder(public_tokenizers.path("word_bpe_49k.json"))
    encoder.encode(pa.array(["so word Word word. WORD, word; word! Word! WORD? word: Word; word,\nword. word\nword"]))
    assert encoder.pieces.size == 10  # "so", " word", "word", six signs and the line end
