"""The tokenizers and sentencepiece libraries over whole texts, with a worker's cache where texts can be cut."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from itertools import repeat

import numpy as np

from metrifold.llm.pieces import PartCache


def is_byte_level(path: str) -> bool:
    """Whether a tokenizer file has the pre-token pattern and special tokens for which cuts are proven."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        j = json.load(f)
    pre = j.get("pre_tokenizer") or {}
    return pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and j.get("normalizer") is None and all("<|" in t["content"] for t in j.get("added_tokens", []))


class ByteLevel:
    """Ids (little-endian bytes of the narrowest kind) or token counts of whole texts, as the library for ``path`` gives them."""

    def __init__(self, path: str, counts: bool, table: dict | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        if path.endswith(".model"):
            import sentencepiece

            processor = sentencepiece.SentencePieceProcessor(model_file=path)
            self.ids = processor.encode
            size = processor.get_piece_size()
        else:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(path)
            self.library.no_truncation()
            self.library.no_padding()
            self.ids = lambda text: self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids
            size = self.library.get_vocab_size()
        self.kind = np.dtype("<u2" if size <= 65536 else "<u4")
        self.counts, self.cache = counts, None
        if is_byte_level(path):
            self.begins = np.zeros(size, bool)  # tokens that begin with the space byte
            self.begins[[i for token, i in self.library.get_vocab().items() if token[0] == "\u0120"]] = True
            self.cache = PartCache(self._led, self.whole, sum if counts else b"".join, mb=96, table=table)

    def whole(self, text: str) -> int | bytes:
        ids = self.ids(text)
        return len(ids) if self.counts else np.array(ids, self.kind).tobytes()

    def _led(self, parts: list[str]) -> list:
        """The parts go through the library as one text and are told apart by the tokens that begin with a space."""
        ids = np.array(self.ids(" " + " ".join(parts)), self.kind)
        at = np.append(np.flatnonzero(self.begins[ids]), len(ids))
        if len(at) != len(parts) + 1:
            return [self.whole(" " + part) for part in parts]
        if self.counts:
            return np.diff(at).tolist()
        data, ends = ids.tobytes(), (at * self.kind.itemsize).tolist()
        return [data[a:b] for a, b in zip(ends, ends[1:])]

    def values(self, texts: list[str]) -> Iterator[int | bytes]:
        cut = self.cache.values(texts) if self.cache is not None else repeat(None)
        return (self.whole(text) if got is None else got for text, got in zip(texts, cut))
