"""Byte-pair merge tables read from tokenizer files, and merging with a heap over a linked list."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

MASK = (1 << 32) - 1


class Merges:
    """Which two adjacent symbols join, how early, and into which symbol.

    Symbols are numbers; ``rank`` and ``made`` are keyed by left * 2^32 + right.
    Lower ranks join first, equal ones from the left.
    """

    def __init__(self):
        self.rank: dict[int, int] = {}
        self.made: dict[int, int] = {}

    def add(self, left: int, right: int, rank: int, made: int) -> None:
        key = left << 32 | right
        if key not in self.rank:
            self.rank[key], self.made[key] = rank, made

    def merge(self, symbols: list[int]) -> int:
        """Joins within the list, in place, and tells how many joins there were.

        A symbol taken in by its left neighbour becomes -1.  The heap holds
        pairs by rank and place; each join pushes the two pairs it creates, and
        a popped pair whose symbols have changed since is passed over.  Time
        is n log n also for one piece as long as a text.
        """
        rank, made, n = self.rank, self.made, len(symbols)
        heap = [r << 32 | i for i in range(n - 1) if (r := rank.get(symbols[i] << 32 | symbols[i + 1])) is not None]
        if not heap:
            return 0
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        symbols.append(-1)  # right of the last
        joins = 0
        while heap:
            top = heappop(heap)
            i = top & MASK
            j = after[i]
            key = symbols[i] << 32 | symbols[j]
            if symbols[i] < 0 or symbols[j] < 0 or rank.get(key) != top >> 32:
                continue
            symbols[i], symbols[j] = made[key], -1
            after[i] = k = after[j]
            joins += 1
            if k < n:
                before[k] = i
                if (r := rank.get(symbols[i] << 32 | symbols[k])) is not None:
                    heappush(heap, r << 32 | i)
            if (p := before[i]) >= 0 and (r := rank.get(symbols[p] << 32 | symbols[i])) is not None:
                heappush(heap, r << 32 | p)
        symbols.pop()
        return joins


    def merge_short(self, symbols: list[int]) -> list[int]:
        """What ``merge`` leaves, by looking for the lowest rank each time: quicker for a few symbols."""
        get, made, none = self.rank.get, self.made, 1 << 62
        ranks = [get(a << 32 | b, none) for a, b in zip(symbols, symbols[1:], strict=False)]
        while ranks and (least := min(ranks)) < none:
            i = ranks.index(least)
            symbols[i] = new = made[symbols[i] << 32 | symbols[i + 1]]
            del symbols[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get(new << 32 | symbols[i + 1], none)
            if i:
                ranks[i - 1] = get(symbols[i - 1] << 32 | new, none)
        return symbols


def merges_of_json(path: str) -> tuple[dict, dict[str, int], Merges]:
    """The file's content, its vocabulary, and its merges in order of the file."""
    with open(path, encoding="utf-8") as f:
        content = json.load(f)
    model = content["model"]
    if model["type"] != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("unk_token") or model.get("ignore_merges"):
        raise ValueError("only plain byte-pair models without dropout, byte fallback or an unknown token")
    vocab, found = model["vocab"], Merges()
    prefix = len(model.get("continuing_subword_prefix") or "")
    for rank, pair in enumerate(model["merges"]):
        left, right = pair.split(" ") if isinstance(pair, str) else pair
        found.add(vocab[left], vocab[right], rank, vocab[left + right[prefix:]])
    return content, vocab, found


def fields(data: bytes) -> Iterator[tuple[int, bytes | int | float]]:
    """Number and value of each field of a protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
        elif kind == 2:
            size = number()
            at += size
            yield tag >> 3, data[at - size : at]
        else:
            size = {1: 8, 5: 4}[kind]
            at += size
            yield tag >> 3, struct.unpack("<f" if size == 4 else "<d", data[at - size : at])[0]


#: Fixed values of the SentencePiece model format: field numbers and kinds of piece.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
MODEL_TYPE, BPE_TYPE, BYTE_FALLBACK, BLANK_SUFFIX, UNK_SURFACE = 3, 2, 35, 24, 44
CHARSMAP, DUMMY_PREFIX, REMOVE_EXTRA, ESCAPE = 2, 3, 4, 5
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BLANK = "▁"


class PieceModel:
    """Pieces, merges and normaliser settings of a SentencePiece BPE model file."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        trainer, normaliser = {}, {}
        for number, value in fields(data):
            if number == PIECES:
                piece = dict(fields(value))
                self.pieces.append(piece[1].decode())
                scores.append(piece.get(2, 0.0))
                self.kinds.append(piece.get(3, NORMAL))
            elif number == TRAINER:
                trainer = dict(fields(value))
            elif number == NORMALIZER:
                normaliser = dict(fields(value))
        if trainer.get(MODEL_TYPE, 1) != BPE_TYPE or trainer.get(BLANK_SUFFIX, 0) or {USER_DEFINED, UNUSED} & set(self.kinds):
            raise ValueError("only BPE models without user-defined or unused pieces, blanks before words")
        self.byte_fallback = bool(trainer.get(BYTE_FALLBACK, 0))
        self.unk_surface = trainer.get(UNK_SURFACE, " ⁇ ".encode()).decode()
        self.charsmap: bytes = normaliser.get(CHARSMAP, b"")
        self.dummy_prefix = bool(normaliser.get(DUMMY_PREFIX, 1))
        self.remove_extra = bool(normaliser.get(REMOVE_EXTRA, 1))
        self.escape = bool(normaliser.get(ESCAPE, 1))
        self.unk = self.kinds.index(UNKNOWN)
        self.byte_ids = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        self._tables(scores)

    def _tables(self, scores: list[float]) -> None:
        self.number = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == NORMAL}
        if any(c not in self.number for p in self.number for c in p):
            raise ValueError("every character of a piece must be a piece")
        #: Which characters stand side by side in some piece: nothing ever joins over another place.
        self.adjacent = {p[i : i + 2] for p in self.number for i in range(len(p) - 1)}
        order = {s: r for r, s in enumerate(sorted({scores[i] for i in self.number.values()}, reverse=True))}
        self.merges = Merges()
        for p, i in self.number.items():
            for k in range(1, len(p)):
                left, right = self.number.get(p[:k]), self.number.get(p[k:])
                if left is not None and right is not None:
                    self.merges.add(left, right, order[scores[i]], i)

    def stretches(self, text: str) -> list[str]:
        """The normalised text cut where no piece reaches across."""
        found, start = [], 0
        for i, pair in enumerate(map(str.__add__, text, text[1:]), 1):
            if pair not in self.adjacent:
                found.append(text[start:i])
                start = i
        return [*found, text[start:]] if text else []

    def symbols(self, stretch: str) -> list[int]:
        """Numbers of its characters; one that is no piece stands alone in its stretch, as -1."""
        get = self.number.get
        return [get(c, -1) for c in stretch]
