"""Rows that begin with white space behind rows that end in a word, in one chunk."""

import pyarrow as pa

from rillworks.llm import substring_dedup
from rillworks.llm._text import chunks


def test_kept_text_has_no_leading_space():
    texts = ["one two", " three  four ", "\tfive", "", " ", "six", "\n\nseven"]
    (c,) = chunks(pa.array(texts))
    out = list(substring_dedup.kept(c, [None] * len(texts), [None] * len(texts)))
    assert [x[2] for x in out] == [" ".join(t.split()) for t in texts]
