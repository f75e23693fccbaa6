"""Ids of whole texts by a public byte-level BPE vocabulary.

``byte_bpe_50k.json`` (tokenizers) and ``byte_bpe_50k.tiktoken`` hold the same
vocabulary; the second library gives the same ids in an eighth of the time and
straight into arrays.  A text that contains the text of a special token is
encoded by the first library, which makes one id of it.
"""

from __future__ import annotations

import base64
import os

import numpy as np
import public_tokenizers

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
BYTE_BPE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")

_workers: dict[tuple[str, str], "Encoder"] = {}


class Encoder:
    def __init__(self, path: str, ranks_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.special = [t.content for t in self.full.get_added_tokens_decoder().values()]
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        """The ids of one whole text."""
        if any(s in text for s in self.special):
            return np.array(self.full.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, disallowed_special=())


def encoder(path: str = BYTE_BPE, ranks_path: str = BYTE_BPE_RANKS) -> Encoder:
    """The worker's encoder for a vocabulary (kept between tasks)."""
    if (path, ranks_path) not in _workers:
        _workers[path, ranks_path] = Encoder(path, ranks_path)
    return _workers[path, ranks_path]
