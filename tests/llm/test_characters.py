"""Every character below U+30000 is encoded as the tokenizers library does."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from quarrymill.llm import bpe, packing
from quarrymill.llm._text import utf8


def probes():
    return [f"x{c}y {c}! {c}{c}1{c}'s a{c} {c}" for c in map(chr, range(0x30000)) if not 0xD800 <= ord(c) < 0xE000]


def cut(ids, counts):
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_all_characters(name):
    path, texts = public_tokenizers.path(name), probes()
    want = [x.ids for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    data = utf8(pa.array(texts, pa.large_string()))
    assert cut(*bpe.load(path).encode_all(*data)) == want
    if name.startswith("byte"):
        assert cut(*packing.byte_encoder(path)(*data)) == want
