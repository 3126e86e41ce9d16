"""Counting the tokens of texts, with a shortcut for pieces that are tokens themselves.

Before any text is read, each vocabulary string is merged once: those that end
as one token are proven whole, and a piece equal to one of them counts 1 without
a merge. Only the other pieces are merged, each once for as long as it is cached.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Pieces
from .common import map_batches, text_of


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves; the others take the code points from 256 on, in order.
    """
    own = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Merges:
    """A byte-level BPE model of the ``tokenizers`` library's JSON format."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        bpe, letters = model["model"], byte_letters()
        if bpe["type"] != "BPE" or model["pre_tokenizer"]["type"] != "ByteLevel" or bpe.get("ignore_merges") or model["normalizer"]:
            raise ValueError("a byte-level BPE model without a normalizer is needed")
        byte_of = {letter: bytes([b]) for b, letter in enumerate(letters)}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in bpe["merges"])
        as_bytes = lambda s: b"".join(map(byte_of.__getitem__, s))
        self.rank = {(as_bytes(a), as_bytes(b)): k for k, (a, b) in enumerate(pairs)}
        self.special = [t["content"] for t in model["added_tokens"]]
        plain = set(self.special)
        self.whole = frozenset(data for data in (as_bytes(s) for s in bpe["vocab"] if s not in plain) if self.merged(data) == 1)

    def merged(self, data: bytes) -> int:
        """Tokens left when the pair of lowest rank, the leftmost of equal ones, is merged until none has a rank."""
        if len(data) > 48:
            return self._merged_long(data)
        parts, rank, none = [data[i : i + 1] for i in range(len(data))], self.rank.get, len(self.rank)
        ranks = [rank(pair, none) for pair in zip(parts, parts[1:], strict=False)]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), none)
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), none)
        return len(parts)

    def _merged_long(self, data: bytes) -> int:
        """The same with a heap and a linked list, in n log n steps."""
        n = len(data)
        parts: list[bytes | None] = [data[i : i + 1] for i in range(n)]
        after, before, left = list(range(1, n + 1)), list(range(-1, n - 1)), n
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := self.rank.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if parts[i] is a or parts[i] == a else n
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j], after[i], left = a + b, None, after[j], left - 1
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := self.rank.get((parts[x], parts[y]))) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return left

    def counts(self, pieces: list[str]) -> Iterator[tuple[str, int]]:
        for piece in pieces:
            data = piece.encode("utf-8", "surrogatepass")
            yield piece, 1 if data in self.whole else self.merged(data)


_loaded: dict[tuple, tuple[Merges, Pieces]] = {}


def token_counter(path: str, pattern: str) -> tuple[Merges, Pieces]:
    """Of a Python worker."""
    if (path, pattern) not in _loaded:
        merges = Merges(path)
        _loaded[path, pattern] = merges, Pieces(pattern, merges.counts, sum)
    return _loaded[path, pattern]


def count_tokens(docs: DataFrame, path: str, pattern: str, limit: int) -> DataFrame:
    """Tokens of every whole text: doc_id, n_bytes, n_tokens, over_limit.

    Strings of special tokens inside a text count as one token each, as is the
    library's default, and part what stands around them. A null text is empty: no
    bytes, no tokens. Repeated rows and null ids are kept; other columns aren't read.
    """

    def make():
        merges, pieces = token_counter(path, pattern)
        special = merges.special

        def batch(keys, texts):
            parts, owner, extra = [], [], [0] * len(texts)
            for k, text in enumerate(texts):
                here = [text]
                for s in special:
                    if s in text:
                        here = [p for x in here for p in x.split(s)]
                extra[k] = len(here) - 1
                parts += here
                owner += [k] * len(here)
            for k, n in zip(owner, pieces(parts), strict=True):
                extra[k] += n
            return zip(keys, extra, strict=True)

        return batch

    out = map_batches(docs.select("doc_id", F.octet_length(text_of(docs)).cast("long").alias("n_bytes"), text_of(docs).alias("text")).select(F.struct("doc_id", "n_bytes").alias("key"), "text"), make, "key struct<doc_id: long, n_bytes: long>, n_tokens long")
    return out.select("key.doc_id", "key.n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
