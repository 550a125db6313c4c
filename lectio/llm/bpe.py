"""A byte-level BPE vocabulary file, exact, with a fast path for texts in common letters."""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from pathlib import Path

import numpy as np

#: Texts whose pre-tokens no version of Unicode changes: printable ASCII, newlines and accented Latin letters.
PLAIN = re.compile("[\n -~\u00c0-\u00ff]*")
# Fixed value: the pre-token pattern of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteBPE:
    """ids(texts) as little-endian uint32 bytes, equal to tokenizers' encode(text, add_special_tokens=False).ids.

    added: the content of an added token, such as <|endoftext|>, in a text is that token, as the file has it; else it is
    encoded like any other text.

    Where the file's ids are in the order of its merges, the same vocabulary is also a table of ranks, whose encoder is
    four times as fast; it takes the texts that both libraries are bound to cut alike, and tokenizers takes the rest.
    """

    def __init__(self, path: str, added: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = not added
        # tokens that aren't special are found in either case
        self.apart = [t.content for t in self.tok.get_added_tokens_decoder().values() if added or not t.special]
        self.ranked = self._ranked(path, self.tok.get_vocab())

    @staticmethod
    def _ranked(path: str, vocab: dict[str, int]):
        import tiktoken

        model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
        merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        if [vocab[t] for t in merges] != list(range(256, 256 + len(merges))):
            return None
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {**{chr(b): b for b in shown}, **{chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}}
        ranks = {bytes(letters[c] for c in t): vocab[t] for t in [*letters, *merges]}
        return tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def plain(self, text: str) -> bytes:
        return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def fast(self, text: str) -> bytes:
        try:
            return self.ranked.encode_to_numpy(text).astype("<u4", copy=False).tobytes()
        except ValueError:  # its pattern backtracks, and runs of a million spaces or newlines exceed its stack
            return self.plain(text)

    def ids(self, texts: list[str]) -> list[bytes]:
        if self.ranked is None:
            return [self.plain(t) for t in texts]
        return [self.fast(t) if PLAIN.fullmatch(t) and not any(a in t for a in self.apart) else self.plain(t) for t in texts]


@lru_cache(maxsize=2)
def load(path: str, added: bool = False) -> ByteBPE:
    return ByteBPE(path, added)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
