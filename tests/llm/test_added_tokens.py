"""Packed ids are those of a plain ``tokenizers`` call, also where a text holds an added token's literal."""

import zlib

import numpy as np

from tablewright.llm.packing import pack
from tablewright.llm.tokens import JSON_FILE, vocabulary_path

TEXTS = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n\n y", "<|endoftext| >", "é" * 5000 + "<|endoftext|>", "none here", "word <|endoftext|> " * 1500]


def test_packed_ids_of_added_tokens(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary_path(JSON_FILE))
    found = pack(spark.createDataFrame([*enumerate(TEXTS)], "doc_id long, text string"), keep_ids=True).toPandas()
    assert tokenizer.encode(TEXTS[0], add_special_tokens=False).ids == [64, 220, 50256, 275]
    for k, mine in found.sort_values("piece").groupby("doc_id"):
        ids = np.array([*tokenizer.encode(TEXTS[k], add_special_tokens=False).ids, 0], "<u4")
        assert b"".join(mine.ids) == ids.tobytes() and mine.length.sum() == len(ids)
        assert all(zlib.crc32(x) == c for x, c in zip(mine.ids, mine.ids_crc32, strict=True))
