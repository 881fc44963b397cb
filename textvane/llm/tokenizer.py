"""Byte-pair ids of texts, from a tokenizer file that each executor has at the same path.

The file's own library and the one used here give the same ids; this one is several times faster.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import regex
import tiktoken

DEFAULT = public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in such files: printable bytes for themselves, others from 256 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def encoding(path: str = DEFAULT) -> tiktoken.Encoding:
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    letters = _byte_letters()
    ranks = {bytes(letters[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in special}
    return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


# A run of blanks this long is cut out of its text: the library's matcher steps back through it blank by blank
# and gives up on some hundred thousand.
BLANKS = regex.compile(r"\p{White_Space}{10000,}")


def _parts(text: str) -> Iterator[tuple[str, bool]]:
    """The text in pieces that the pattern never matches across, and whether one is a single match.

    Of a run of blanks before another character the pattern takes all but the last together.
    """
    at = 0
    for run in BLANKS.finditer(text):
        last = run.end() if run.end() == len(text) else run.end() - 1
        yield text[at:run.start()], False
        yield text[run.start():last], True
        at = last
    yield text[at:], False


def ids(text: str | None, path: str = DEFAULT, special: bool = True) -> np.ndarray:
    """Ids of a text (null as empty). With `special`, special tokens spelt out in the text keep their ids."""
    if not text:
        return np.zeros(0, np.uint32)
    enc = encoding(path)
    out: list[int] = []
    for part, single in _parts(text):
        if single:
            out += enc._core_bpe.encode_single_piece(part.encode())
        elif part:
            out += enc.encode(part, allowed_special="all") if special else enc.encode_ordinary(part)
    return np.asarray(out, np.uint32)
