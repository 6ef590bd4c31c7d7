"""Ids that need more than 16 bits."""

from __future__ import annotations

import numpy as np
import public_tokenizers

from touchline.llm import packing

WORDS = public_tokenizers.path("word_bpe_49k.json")


def test_ids_above_16_bits_are_packed_whole(spark):
    df = spark.createDataFrame([(1, "some words"), (2, "")], "doc_id long, text string")
    got = packing.pack(df, WORDS, end_id=70_000).collect()
    ends = [int(np.frombuffer(r.ids, dtype="<u4")[-1]) for r in got if r.start + r.length == r.doc_tokens]
    assert ends == [70_000, 70_000]
    assert (packing.id_width(WORDS, 1), packing.id_width(WORDS, 70_000)) == (2, 4)
