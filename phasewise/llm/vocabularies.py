"""Public vocabularies: token ids of whole texts, however long they or their runs of white space are."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np

FOLDER = "/opt/tokenizers"
#: Names of vocabulary files there: byte-level BPE for many languages and for one, and pieces with byte fallback.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
VOCABULARIES = (VOCABULARY, "byte_bpe_50k.tiktoken", "piece_bpe_32k.model")
#: The usual split of byte-level BPE, a fixed value of the published vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters that \s stands for in it: Unicode's White_Space.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Runs of white space of this length are split off, as the pattern's lookahead keeps a stack of them.
RUN = 4096
#: Characters that are encoded at once, about.
STRETCH = 1 << 20
_RUN = re.compile(f"[{SPACE}]{{{RUN},}}")
_EDGE = re.compile(f"(?<=[^{SPACE}])(?=[{SPACE}])")


def stretches(text: str) -> Iterator[tuple[str, bool]]:
    """Parts of `text` that have the tokens of the whole, and whether a part is one unit of the pattern.

    The pattern never joins white space to what is before it, and of a run it
    leaves the last character to what follows.
    """
    at = 0
    for run in _RUN.finditer(text):
        yield from ((x, False) for x in _short(text, at, run.start()))
        at = run.end() if run.end() == len(text) else run.end() - 1
        yield text[run.start() : at], True
    yield from ((x, False) for x in _short(text, at, len(text)))


def _short(text: str, a: int, b: int) -> Iterator[str]:
    while b - a > STRETCH:
        edge = _EDGE.search(text, a + STRETCH, b)
        if edge is None or edge.start() >= b:
            break
        yield text[a : edge.start()]
        a = edge.start()
    if a < b:
        yield text[a:b]


class ByteBPE:
    """A file of ranks; part marks the tokens that are not whole characters."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.part = np.zeros(max(ranks.values()) + 1, bool)
        for piece, rank in ranks.items():
            try:
                piece.decode()
            except UnicodeDecodeError:
                self.part[rank] = True
        self.encoding = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.ranks = ranks

    @cached_property
    def unit(self):
        """The encoding of a text that is one unit of the pattern; made where a text needs it, as it is large."""
        import tiktoken

        return tiktoken.Encoding(f"{self.encoding.name} unit", pat_str="(?s:.+)", mergeable_ranks=self.ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        found = [(self.unit if whole else self.encoding).encode_to_numpy(x, disallowed_special=()) for x, whole in stretches(text)]
        return found[0] if len(found) == 1 else np.concatenate(found) if found else np.zeros(0, np.uint32)


class Pieces:
    """A file of pieces; part marks the bytes that stand in for characters without a piece."""

    def __init__(self, path: str):
        import sentencepiece

        self.file = sentencepiece.SentencePieceProcessor(model_file=path)
        self.part = np.array([self.file.is_byte(i) for i in range(self.file.get_piece_size())])

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.file.encode(text, num_threads=1), np.uint32)


@lru_cache(maxsize=8)
def vocabulary(path: str) -> ByteBPE | Pieces:
    return Pieces(path) if path.endswith(".model") else ByteBPE(path)
