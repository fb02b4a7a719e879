"""Byte-level BPE: encoding by a lazily determinised transducer, decoding by a UTF-8 state machine.

A sequence of tokens is the BPE encoding of its bytes exactly if each neighbouring pair encodes to
itself. That makes a nondeterministic transducer: it walks the trie of token bytes and may emit a
token where one ends, if it goes with the token before. Its subset construction is built only as
texts need it: a state is the set of open walks, each with the tokens it has chosen but not yet
emitted. What all walks have in common is emitted at once; as no walk is longer than the longest
token, the lookahead is bounded, and a text takes one step a byte.

The decoder takes ids one at a time. Its state is the unfinished UTF-8 sequence (at most three
bytes); what a token does in a state is worked out once. Bytes that cannot be continued to a
character become U+FFFD.

Remembered states, pairs and pieces are bounded by `MEMORY`; when full they start afresh, which
changes no result. The vocabulary file is read once by the driver (its size is fixed) and sent to the
executors; its path is a parameter.

Defined cases: null and empty texts have no ids and decode to the empty text. Special tokens are
ordinary text. Repeated rows give repeated results.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leasebook.llm.common import map_rows

MEMORY = 1 << 19
LONGEST_REMEMBERED = 64


def merge_by_rank(raw: bytes, ranks: dict[bytes, int], stop: int | None = None) -> list[int]:
    """BPE as defined: join the neighbours of lowest rank, the first of equals, until none can be joined.

    With `stop`, the merge of that rank is not done any more.
    """
    parts = [raw[i: i + 1] for i in range(len(raw))]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], len(ranks)))
        if ranks.get(parts[best] + parts[best + 1], stop) == stop:
            break
        parts[best: best + 2] = [parts[best] + parts[best + 1]]
    return [ranks[p] for p in parts]


class Transducer:
    """Bytes to ids of one piece."""

    ROOT = 0

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.child: dict[int, int] = {}
        self.token = {}
        self.inner = set()
        nodes = 1
        for raw, id_ in ranks.items():
            at = self.ROOT
            for b in raw:
                self.inner.add(at)
                step = at << 8 | b
                if step not in self.child:
                    self.child[step] = nodes
                    nodes += 1
                at = self.child[step]
            self.token[at] = id_
        self.pairs: dict[tuple[int, int], bool] = {}
        self.parts: dict[int, tuple[int, int] | None] = {}
        self._forget()

    def _forget(self) -> None:
        start = ((self.ROOT, -1, ()),)
        self.states, self.number, self.steps = [start], {start: 0}, {}

    def halves(self, id_: int) -> tuple[int, int] | None:
        """The two tokens whose merge made this one; None for a single byte, or one that merges never make."""
        if id_ not in self.parts:
            raw = self.bytes_of[id_]
            parts = merge_by_rank(raw, self.ranks, stop=id_)
            self.parts[id_] = (parts[0], parts[1]) if len(raw) > 1 and len(parts) == 2 else None
        return self.parts[id_]

    def goes(self, before: int, id_: int) -> bool:
        """Do the two tokens' bytes encode to these two tokens (or one token's to itself)?"""
        if before < 0:
            return len(self.bytes_of[id_]) == 1 or self.halves(id_) is not None
        known = self.pairs.get((before, id_))
        if known is None:
            if len(self.pairs) > MEMORY:
                self.pairs.clear()
            known = self.pairs[before, id_] = self._apart(before, id_)
        return known

    def _apart(self, left: int, right: int) -> bool:
        """Does no merge cross the border of two tokens while each is being made?

        The merges of both are undone, last (highest rank) first. At each point the parts beside
        the border would have merged if their join's rank came before the merge undone last; of
        equal ranks, the one further left came first.
        """
        until = len(self.ranks)
        while True:
            joined = self.ranks.get(self.bytes_of[left] + self.bytes_of[right])
            if joined is not None and joined < until:
                return False
            options = [(id_, side) for side, id_ in enumerate((left, right)) if self.halves(id_)]
            if not options:
                return True
            id_, side = max(options)
            until = id_ + side
            if side:
                right = self.halves(id_)[0]
            else:
                left = self.halves(id_)[1]

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        walks, ended = [], None
        for node, before, chosen in self.states[state]:
            to = self.child.get(node << 8 | byte)
            if to is None:
                continue
            id_ = self.token.get(to)
            if ended is None and id_ is not None and self.goes(before, id_):
                ended = (self.ROOT, id_, (*chosen, id_))
            if to in self.inner:
                walks.append((to, before, chosen))
        walks.append(ended)
        common = 0
        while all(len(w[2]) > common and w[2][common] == walks[0][2][common] for w in walks):
            common += 1
        out = walks[0][2][:common]
        found = tuple((node, before, chosen[common:]) for node, before, chosen in walks)
        if found not in self.number:
            self.number[found] = len(self.states)
            self.states.append(found)
        return self.number[found], out

    def encode(self, raw: bytes) -> list[int]:
        ids: list[int] = []
        if len(self.steps) > MEMORY:
            self._forget()
        state, get = 0, self.steps.get
        for byte in raw:
            key = state << 8 | byte
            step = get(key)
            if step is None:
                if len(self.steps) > 2 * MEMORY:  # within one very long piece: keep the state, forget the rest
                    now = self.states[state]
                    self._forget()
                    get = self.steps.get
                    self.number[now] = state = len(self.states)
                    self.states.append(now)
                    key = state << 8 | byte
                step = self.steps[key] = self._step(state, byte)
            state = step[0]
            if step[1]:
                ids += step[1]
        return ids + list(self.states[state][-1][2])


class Encoder(dict):
    """Text to ids: pieces of the split pattern, each through the transducer; a dict of pieces seen.

    When half of the memory is full its pieces become the old ones, which stay until the next time.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        self.old: dict[str, tuple[int, ...]] = {}
        self.ranks, self.split, self.machine = ranks, regex.compile(pattern), Transducer(ranks)

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.old.get(piece)
        if ids is None:
            raw = piece.encode()
            whole = self.ranks.get(raw)
            ids = (whole,) if whole is not None else tuple(self.machine.encode(raw))
        if len(piece) <= LONGEST_REMEMBERED:
            if len(self) > MEMORY // 2:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        """Ids as little-endian unsigned 32-bit integers."""
        pieces = (m[0] for m in self.split.finditer(text)) if len(text) > 1 << 22 else self.split.findall(text)
        return np.fromiter(chain.from_iterable(map(self.__getitem__, pieces)), "<u4")


def utf8(pending: bytes, more: bytes) -> tuple[str, bytes]:
    """Characters finished by `more` after the unfinished sequence `pending`, and what is unfinished then."""
    out: list[str] = []
    held = bytearray()
    need, low, high = 0, 0x80, 0xBF

    def put(byte: int) -> None:
        nonlocal need, low, high
        if need and low <= byte <= high:
            held.append(byte)
            need, low, high = need - 1, 0x80, 0xBF
        else:
            if need:
                out.append("�")
                held.clear()
                need, low, high = 0, 0x80, 0xBF
            if byte < 0x80:
                held.append(byte)
            elif 0xC2 <= byte <= 0xF4:
                held.append(byte)
                need = 1 + (byte >= 0xE0) + (byte >= 0xF0)
                low = {0xE0: 0xA0, 0xF0: 0x90}.get(byte, 0x80)
                high = {0xED: 0x9F, 0xF4: 0x8F}.get(byte, 0xBF)
            else:
                out.append("�")
                return
        if not need:
            out.append(held.decode())
            held.clear()

    for byte in chain(pending, more):
        put(byte)
    return "".join(out), bytes(held)


class Decoder(dict):
    """(unfinished bytes, id) to (characters, unfinished bytes), worked out when first met."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.bytes_of = {i: t for t, i in ranks.items()}
        # Text of the tokens that are whole characters: what they do where nothing is unfinished.
        self.whole = {i: text for i, t in self.bytes_of.items() for text, rest in [utf8(b"", t)] if not rest and "\ufffd" not in text}

    def __missing__(self, key: tuple[bytes, int]) -> tuple[str, bytes]:
        if len(self) > MEMORY:
            self.clear()
        found = self[key] = utf8(key[0], self.bytes_of[key[1]])
        return found

    def stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text as it becomes known, one item an id, and one for an unfinished end."""
        pending = b""
        for id_ in ids:
            text, pending = self[pending, id_]
            yield text
        if pending:
            yield "�"

    def decode(self, ids: Iterable[int]) -> str:
        """The text of `stream`, with the short way for tokens of whole characters."""
        out: list[str] = []
        pending, whole = b"", self.whole.get
        for id_ in ids:
            text = None if pending else whole(id_)
            if text is None:
                text, pending = self[pending, id_]
            out.append(text)
        return "".join(out) + ("�" if pending else "")


@lru_cache(maxsize=2)
def coders(vocabulary: bytes, pattern: str) -> tuple[Encoder, Decoder]:
    ranks = {base64.b64decode(t): int(i) for t, i in map(bytes.split, vocabulary.splitlines()) if t}
    return Encoder(ranks, pattern), Decoder(ranks)


def encode_decode(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Per row of `docs`: doc_id, n_tokens, ids (little-endian unsigned 32-bit integers), decoded (text from the ids)."""
    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        vocabulary = docs.sparkSession.sparkContext.broadcast(file.read())

    def code(batch: dict[str, list]) -> Iterator[tuple]:
        encoder, decoder = coders(vocabulary.value, pattern)
        for doc_id, raw in zip(batch["doc_id"], batch["raw"]):
            ids = encoder.encode((raw or b"").decode("utf-8", "replace"))
            yield doc_id, len(ids), ids.tobytes(), decoder.decode(ids.tolist())

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("raw"))
    return map_rows(rows, code, "doc_id long, n_tokens long, ids binary, decoded string", 256)
