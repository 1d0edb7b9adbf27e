"""Token ids of a public byte-level vocabulary.

The ids are those of the ``tokenizers`` library with the file
``byte_bpe_50k.json`` and without special tokens; ``tiktoken`` gives the same ids
from the same vocabulary several times faster and does the work here. Texts with
extremely long unbroken pieces go to ``tokenizers``, whose merge loop stays
near-linear there. Where a literal added token in a text is to be one id, as in a
plain call of ``tokenizers``, texts that hold one go there too. The vocabulary files
are parameters and are not part of this repository.
"""

from __future__ import annotations

import base64
import functools
import json as json_format
import re

import numpy as np

RANKS_FILE = "byte_bpe_50k.tiktoken"
JSON_FILE = "byte_bpe_50k.json"
END_OF_DOCUMENT = 50256
_LONG_PIECE = re.compile(r"\S{4000}|\s{4000}")


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def _fast(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.cache
def _steady(path: str, plain: bool = True):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = plain
    return found


@functools.cache
def _added(path: str) -> list[str]:
    """The literals of the vocabulary's added tokens."""
    with open(path, encoding="utf-8") as file:
        return [token["content"] for token in json_format.load(file).get("added_tokens") or []]


def encode(text: str | None, ranks: str | None = None, json: str | None = None, *, added: bool = False) -> np.ndarray:
    """Ids of a whole text as uint32; null and empty texts have none. With ``added``, literals of added tokens are one id each."""
    if not text:
        return np.empty(0, dtype=np.uint32)
    if added:
        path = json or vocabulary_path(JSON_FILE)
        if any(literal in text for literal in _added(path)):
            return np.array(_steady(path, plain=False).encode(text, add_special_tokens=False).ids, dtype=np.uint32)
    if _LONG_PIECE.search(text):
        ids = _steady(json or vocabulary_path(JSON_FILE)).encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype=np.uint32)
    return np.array(_fast(ranks or vocabulary_path(RANKS_FILE)).encode_ordinary(text), dtype=np.uint32)
