"""Byte-level BPE by prefix dynamic programming.

For each prefix of a byte string there is exactly one token that can be the
last of the prefix's encoding: the one that stays next to the last token of
what precedes it, when BPE merges by rank. Storing that token for every prefix
gives the encoding of the whole (walk back from the end) and of every prefix,
lets text be appended without looking back, and after an edit needs new entries
only until the stored ones are reached again.

Cost is linear in the text, whatever its shape: a run of a million equal
letters, which the pairwise merge takes quadratic time for, is no special case.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame

from .common import map_batches, text_of

#: Entries of each cache of a Python worker; a full one loses every other entry.
CACHE_ENTRIES = 500_000


def halve(cache: dict) -> None:
    if len(cache) >= CACHE_ENTRIES:
        for key in list(cache)[::2]:
            del cache[key]


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a file of ``base64 rank`` lines."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


class Vocabulary:
    """Ranks, the two parts from which each token is merged, and which tokens may stand side by side."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.parts = {rank: self._merged_from(token, rank) for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        #: By token: the longest other token that it ends with.
        self.shorter = {rank: next((ranks[token[i:]] for i in range(1, len(token)) if token[i:] in ranks), -1) for token, rank in ranks.items()}
        self._build_states()
        self.size = {rank: len(token) for token, rank in ranks.items()}
        self.fitting: dict[int, bool] = {}

    def _build_states(self) -> None:
        """A state for each prefix of a token: the longest such prefix that the bytes so far end with.

        ``token_at`` has the longest token that a state's bytes end with. Steps are
        filled in when they are first taken.
        """
        children: list[dict[int, int]] = [{}]
        self.token_at, depth = [-1], [b""]
        for token in sorted(self.ranks):
            state = 0
            for k, byte in enumerate(token):
                after = children[state].get(byte)
                if after is None:
                    after = children[state][byte] = len(children)
                    children.append({})
                    depth.append(token[: k + 1])
                    self.token_at.append(-1)
                state = after
        self._children, self._fall, self.steps = children, [0] * len(children), {}
        for state in sorted(range(1, len(children)), key=lambda s: len(depth[s])):
            for byte, after in children[state].items():
                self._fall[after] = self.step(self._fall[state], byte)
            own = self.ranks.get(depth[state])
            self.token_at[state] = self.token_at[self._fall[state]] if own is None else own

    def step(self, state: int, byte: int) -> int:
        """The state after one more byte."""
        known = self.steps.get(state << 8 | byte)
        if known is None:
            at = state
            while (known := self._children[at].get(byte)) is None and at:
                at = self._fall[at]
            self.steps[state << 8 | byte] = known = known or 0
        return known

    def _merged_from(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The last two parts of ``token`` when merges below its own rank are applied."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = rank, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1], rank)
                if r < best:
                    best, at = r, i
            if at < 0:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None

    def fits(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens gives these two tokens again."""
        halve(self.fitting)
        answer = self.fitting[left << 32 | right] = self._stay_apart(left, right)
        return answer

    def _stay_apart(self, left: int, right: int) -> bool:
        """Undo the merges of both tokens from the last to the first.

        At each moment the two tokens that touch the border are known; a merge
        across it breaks the border if its rank comes before that of the merge
        which next changes either side. Of equal ranks the leftmost goes first.
        """
        before = len(self.ranks) + 1  # a merge across the border has to have a rank below this
        while True:
            across = self.ranks.get(self.bytes_of[left] + self.bytes_of[right])
            if across is not None and across < before:
                return False
            parts_l, parts_r = self.parts[left], self.parts[right]
            if parts_l is None and parts_r is None:
                return True
            # the younger merge is undone first
            if parts_r is None or (parts_l is not None and left > right):
                before, left = left, parts_l[1]
            else:
                before, right = right + 1, parts_r[0]


class PrefixTable:
    """The last token of each prefix of a byte string, which may grow and be edited."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last, self.state = vocabulary, b"", [-1], [0]
        self.append(data)

    def append(self, data: bytes) -> None:
        """Exact, without looking at more than the longest token's length of what is there."""
        start = len(self.data)
        self.data += data
        self._fill(start + 1, len(self.data) + 1)

    def _fill(self, first: int, stop: int) -> None:
        """Entries from ``first`` on: of the tokens that the prefix ends with, from the longest on, the one that fits what precedes it."""
        data, last, states, v = self.data, self.last, self.state, self.vocabulary
        step, token_at, size, shorter, known = v.steps.get, v.token_at, v.size, v.shorter, v.fitting.get
        state = states[first - 1]
        for end in range(first, stop):
            after = step(state << 8 | data[end - 1])
            state = v.step(state, data[end - 1]) if after is None else after
            states.append(state)
            token = token_at[state]
            at = end - size[token]
            while at:
                fit = known(last[at] << 32 | token)
                if fit is None:
                    fit = v.fits(last[at], token)
                if fit:
                    break
                token = shorter[token]
                at = end - size[token]
            last.append(token)

    def truncate(self, end: int) -> None:
        """Back to the prefix of length ``end``, whose entries are as they were."""
        self.data = self.data[:end]
        del self.last[end + 1 :], self.state[end + 1 :]

    def replace(self, start: int, stop: int, data: bytes) -> int:
        """Put ``data`` for bytes start to stop; returns how many entries were made anew.

        An entry depends on the bytes and entries at most one longest token
        before it, so once that many in a row agree with the old ones the rest does too.
        """
        tail, old, shift = self.data[stop:], self.last[stop + 1 :], start + len(data)
        longest = self.vocabulary.longest
        states = self.state[stop + 1 :]
        self.data, self.last, self.state = self.data[:start], self.last[: start + 1], self.state[: start + 1]
        self.append(data)
        self.data += tail
        agree, made = 0, len(data)
        for i, before in enumerate(old):
            if agree >= longest:
                self.last.extend(old[i:])
                self.state.extend(states[i:])
                break
            self._fill(shift + i + 1, shift + i + 2)
            token = self.last[-1]
            agree, made = (agree + 1 if token == before else 0), made + 1
        return made

    def ids(self, end: int | None = None) -> list[int]:
        """Token ids of the prefix of length ``end`` (default: all)."""
        at, out = len(self.data) if end is None else end, []
        while at:
            out.append(self.last[at])
            at -= self.vocabulary.size[out[-1]]
        return out[::-1]


def encode_pieces(vocabulary: Vocabulary, pieces: list[str]) -> Iterator[tuple[str, list[int]]]:
    """Ids of each match of the splitting pattern.

    A piece that is a token keeps its one id. The others go through one table in
    sorted order, so that each starts from the entries of the prefix it shares
    with the one before.
    """
    table = PrefixTable(vocabulary)
    for data, piece in sorted((p.encode("utf-8", "surrogatepass"), p) for p in pieces):
        whole = vocabulary.ranks.get(data)
        if whole is not None and (len(data) == 1 or vocabulary.parts[whole]):
            yield piece, [whole]
            continue
        shared, before = 0, table.data
        for a, b in zip(before, data, strict=False):
            if a != b:
                break
            shared += 1
        table.truncate(shared)
        table.append(data[shared:])
        yield piece, table.ids()


class Pieces:
    """Split texts by a pattern of the ``| ?\\p{L}+|...|\\s+(?!\\S)|\\s+`` kind, with a result for each piece kept.

    No piece crosses from a character that isn't white space to a space that a
    further such character follows, nor over a line end between two such characters.
    Texts are first cut there, which is a plain ``split``; only words seen for the
    first time meet the pattern. Texts where a cut would touch other white space are
    split by the pattern as a whole.
    ``of_pieces`` yields each new piece with its result, ``join`` combines results.
    """

    #: Characters that some patterns count as white space and others don't.
    odd = "\x1c\x1d\x1e\x1f\x85\u180e\u200b\u2060\ufeff"

    def __init__(self, pattern: str, of_pieces: Callable, join: Callable):
        import regex

        self.findall, self.of_pieces, self.join = regex.compile(pattern).findall, of_pieces, join
        self.pieces: dict[str, object] = {}
        self.words: dict[str, object] = {}

    def _learn(self, found: Iterable[list[str]]) -> None:
        halve(self.pieces)
        new = set().union(*found).difference(self.pieces)
        self.pieces.update(self.of_pieces(new))

    def __call__(self, texts: list[str]) -> list:
        """The result of each text.

        Lines and their words are cut apart. A NUL before a word says that no space
        stands before it, as at the start of a line; texts with a NUL of their own
        aren't cut.
        """
        halve(self.words)
        cut = [("\0" + text.replace("\n", " \n \0")).split(" ") if text and "\0" not in text else None for text in texts]
        new = {}
        for word in set().union(*(words for words in cut if words)).difference(self.words):
            first = word[:1] == "\0"
            own = word[first:]
            if word == "\n":
                new[word] = [word]
            elif own.isascii() and own.isalpha():
                new[word] = [own if first else " " + own]
            elif not own or own[0].isspace() or own[0] in self.odd or own[-1].isspace() or own[-1] in self.odd:
                self.words[word] = None
            else:
                new[word] = self.findall(own if first else " " + own)
        self._learn(new.values())
        known = self.pieces.__getitem__
        for word, pieces in new.items():
            self.words[word] = known(pieces[0]) if len(pieces) == 1 else self.join(map(known, pieces))
        return [self._one(words, text) for words, text in zip(cut, texts, strict=True)]

    def _one(self, words: list[str] | None, text: str):
        try:
            return self.join(map(self.words.__getitem__, words))
        except TypeError:  # a word, or all of them, is None: only the whole text can be cut
            found = self.findall(text)
            self._learn([found])
            return self.join(map(self.pieces.__getitem__, found))


_loaded: dict[tuple, object] = {}


def text_encoder(path: str, pattern: str) -> tuple[Pieces, dict[str, bytes]]:
    """Of a Python worker: texts to ids joined by spaces, and bytes by id."""
    key = ("ids", path, pattern)
    if key not in _loaded:
        v = Vocabulary(read_ranks(path))
        joined = {rank: str(rank) for rank in v.bytes_of}
        pieces = Pieces(pattern, lambda new: ((piece, " ".join(map(joined.__getitem__, ids))) for piece, ids in encode_pieces(v, new)), " ".join)
        _loaded[key] = pieces, {joined[rank]: token for rank, token in v.bytes_of.items()}
    return _loaded[key]


def _encoded(docs: DataFrame, path: str, pattern: str, id_column: str, text_column: str, columns: str, row: Callable) -> DataFrame:
    def make():
        pieces, bytes_of = text_encoder(path, pattern)

        def batch(keys, texts):
            for key, ids in zip(keys, pieces(texts), strict=True):
                decoded = b"".join(map(bytes_of.__getitem__, ids.split(" "))) if ids else b""
                yield key, *row(ids, ids.count(" ") + 1 if ids else 0, decoded)

        return batch

    kind = docs.schema[id_column].dataType.simpleString()
    return map_batches(docs.select(docs[id_column], text_of(docs, text_column).alias("text")), make, f"`{id_column}` {kind}, {columns}")


def encode(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Ids of every whole text, and the text that decoding them gives.

    Returns the id column, ``ids`` (decimal, joined by a space), ``n_tokens`` and
    ``decoded`` (binary). A null text is empty and has no ids; repeated rows and
    null ids are kept as they are; other columns of ``docs`` aren't read.
    """
    return _encoded(docs, path, pattern, id_column, text_column, "ids string, n_tokens long, decoded binary", lambda *x: x)


def _digests(ids: str, n: int, decoded: bytes) -> tuple:
    return n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Of each document: doc_id, n_tokens and SHA-256 of the joined ids and of the decoded bytes.

    As :func:`encode`, with only digests leaving the Python worker.
    """
    return _encoded(docs, path, pattern, "doc_id", "text", "n_tokens long, ids_sha256 string, decoded_sha256 string", _digests)
