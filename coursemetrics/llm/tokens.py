"""Token ids of whole texts with a public tokenizer, exact and in bounded memory.

A byte-level tokenizer cuts a text into pre-tokens by a pattern in which a single space can only begin
a pre-token. A space with a non-white character on both sides is therefore a safe boundary, and long
texts are encoded block by block.

Two libraries read such a vocabulary. Where its merges are numbered in order of their ids, the ranks of
the second one follow from the file, and it gives the same ids several times faster; it gets the
blocks made of characters that both class alike (ASCII and Latin letters) without special strings. All
other blocks go to the file's own library.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np

# U+180E was white space in older Unicode tables; it never makes a boundary.
SAFE = re.compile(r"(?<=[^\s᠎]) (?=[^\s᠎])")
#: Fixed value: the public pattern of byte-level pre-tokenizers.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
UNUSUAL = re.compile("[^\\t\\n -~\\xa1-\\xac\\xae-\\u024f]")
BLOCK = 1 << 16


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, others from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@lru_cache(maxsize=4)
def load(path: str):
    """(library's tokenizer, the faster one or None, pattern of special strings or None)."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".model"):
        import sentencepiece
        return sentencepiece.SentencePieceProcessor(model_file=path), None, None
    from tokenizers import Tokenizer
    tool = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    before, model = told.get("pre_tokenizer") or {}, told["model"]
    if before.get("type") != "ByteLevel":
        return tool, None, None
    special = [x["content"] for x in told.get("added_tokens") or ()]
    special = re.compile("|".join(map(re.escape, special))) if special else None
    merges = ["".join(x) if isinstance(x, list) else x.replace(" ", "") for x in model["merges"]]
    vocab = model["vocab"]
    if before.get("add_prefix_space") or not before.get("use_regex") or told.get("normalizer") or model.get("dropout") \
            or model.get("ignore_merges") or len(vocab) != 256 + len(merges) or any(vocab[x] != 256 + i for i, x in enumerate(merges)):
        return tool, None, special
    import tiktoken
    letters = byte_letters()
    ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items()}
    return tool, tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), special


def blocks(text: str, limit: int = BLOCK):
    """``text`` in order, cut at the first safe boundary after every ``limit`` characters."""
    at = 0
    while len(text) - at > limit:
        found = SAFE.search(text, at + limit)
        if found is None:
            break
        yield text[at:found.start()]
        at = found.start()
    yield text[at:]


def by_size(texts: list[str], limit: int):
    """Slices of ``texts`` of about ``limit`` characters each."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text) + 8
        if size >= limit:
            yield texts[start:i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield texts[start:]


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes, or their number only."""

    def __init__(self, path: str, ids: bool):
        (self.tool, self.fast, self.special), self.ids = load(path), ids
        self.bytewise = not path.endswith(".model") and (self.fast is not None or self.special is not None)
        self.sentences = path.endswith(".model")

    def _own(self, texts: list[str]) -> list:
        """By the file's own library."""
        if self.sentences:
            found = self.tool.encode(texts, num_threads=1)
        else:
            found = [e.ids for e in self.tool.encode_batch_fast(texts, add_special_tokens=False)]
        return [self._as(x) for x in found]

    def _as(self, ids: list[int]):
        return np.array(ids, "<u4").tobytes() if self.ids else len(ids)

    def _group(self, texts: list[str]) -> list:
        out: list = [None] * len(texts)
        slow = []
        for i, text in enumerate(texts):
            if self.fast is None or UNUSUAL.search(text) or self.special and self.special.search(text):
                slow.append(i)
            else:
                out[i] = self._as(self.fast.encode_ordinary(text))
        if slow:
            for i, x in zip(slow, self._own([texts[i] for i in slow])):
                out[i] = x
        return out

    def stream(self, texts: list[str], limit: int = 1 << 20):
        """Results in the order of ``texts``, encoded in groups balanced by size."""
        none = b"" if self.ids else 0
        cut = [list(blocks(x)) if self.bytewise and len(x) > BLOCK else [x] for x in texts]
        flat = (x for part in by_size([b for x in cut for b in x], limit) for x in self._group(part))
        for parts in cut:
            if len(parts) == 1:
                yield next(flat)
            else:
                got = [next(flat) for _ in parts]
                yield none.join(got) if self.ids else sum(got)
