"""Public byte-level BPE vocabularies, read from a folder that is a parameter and never copied."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import numpy as np

#: Folder of the vocabulary files; override by argument or by this environment variable.
DEFAULT_FOLDER = os.environ.get("QUORIX_TOKENIZERS", "/opt/tokenizers")

# Fixed value: the published pre-tokenisation pattern of the 50k byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class ByteBpe:
    """One vocabulary: encodes ordinary text (strings like special tokens included) and knows each id's bytes."""

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.encoding = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        size = max(ranks.values()) + 1
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in ranks.items():
            self.bytes_of[i] = token

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text. Lone surrogates are replaced as UTF-8 readers do."""
        return np.array(self.encoding.encode_ordinary(text), self.dtype)

    def encode_bytes(self, raw: bytes) -> np.ndarray:
        return self.encode(raw.decode("utf-8", "replace"))


@lru_cache(maxsize=4)
def byte_bpe(name: str = "byte_bpe_50k", folder: str | None = None) -> ByteBpe:
    """The vocabulary `name`.tiktoken of `folder`, loaded once per Python worker."""
    return ByteBpe(os.path.join(folder or DEFAULT_FOLDER, f"{name}.tiktoken"))
