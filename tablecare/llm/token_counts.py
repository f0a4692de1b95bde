"""Token counts by heap-and-linked-list byte-pair merging; no token ids are made.

A piece of text starts as its symbols; the adjacent pair of lowest rank is
popped from a heap and joined, again and again.  The count is the symbols less
the joins.  ``.json`` files are read as the tokenizers library does, ``.model``
files as sentencepiece does.

Defined cases: a null or empty text has 0 tokens; special strings in a text
count as one token each, as that library's default; repeated rows are counted
each; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tablecare.llm.bpe import PieceModel, merges_of_json
from tablecare.llm.texts import Memory, id_and_text, lengths, slices

#: Words and pieces whose counts a worker remembers; emptied when full, results don't change.
REMEMBERED = 800_000

_PLAIN = re.compile(r"([A-Za-z]+)([.,]?)")


class JsonCounter:
    """Counts for a file of the tokenizers library, whose normaliser and pre-tokenizer it applies."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        content, self.vocab, self.merges = merges_of_json(path)
        self.normalizer, self.pre_tokenizer = tokenizer.normalizer, tokenizer.pre_tokenizer
        self.suffix = content["model"].get("end_of_word_suffix") or ""
        added = content.get("added_tokens") or []
        if any(a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] for a in added):
            raise ValueError("only added tokens that are matched as they stand")
        strings = sorted((a["content"] for a in added), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, strings))) if strings else None
        self.words = Memory(lambda w: self._stretch(w) if w else 0, REMEMBERED)
        self.pieces = Memory(self._piece, REMEMBERED)
        #: White space is dropped and nothing reaches over it, so words count one by one.
        self.by_words = self._pieces("a b\nc") == ["a", "b", "c"] and not any(re.search(r"[ \n]", s) for s in strings)
        tried = ["The", "Reed.", "inding,", "Zq", "I."]
        self.plain = all(self._pieces(w) == [x.lower() for x in _PLAIN.fullmatch(w).groups() if x] for w in tried)

    def _pieces(self, text: str) -> list[str]:
        if self.normalizer is not None:
            text = self.normalizer.normalize_str(text)
        return [p for p, _ in self.pre_tokenizer.pre_tokenize_str(text)] if self.pre_tokenizer is not None else [text]

    def _piece(self, piece: str) -> int:
        """Initial symbols less joins."""
        get = self.vocab.get
        symbols = [s for s in map(get, [*piece[:-1], piece[-1] + self.suffix]) if s is not None]
        return len(symbols) - self.merges.merge(symbols)

    def _stretch(self, text: str) -> int:
        """Tokens of a text or word, special strings included."""
        total = 0
        if self.special is not None and self.special.search(text):
            total = sum(1 for _ in self.special.finditer(text))
            parts = self.special.split(text)
        else:
            if self.plain and (m := _PLAIN.fullmatch(text)):
                return self.pieces[m[1].lower()] + (self.pieces[m[2]] if m[2] else 0)
            parts = [text]
        return total + sum(self.pieces[p] for part in parts if part for p in self._pieces(part) if p)

    def count(self, text: str) -> int:
        if not self.by_words:
            return self._stretch(text)
        self.words.trim()
        self.pieces.trim()
        return sum(map(self.words.__getitem__, text.replace("\n", " ").split(" ")))


class PieceCounter:
    """Counts for a sentencepiece BPE model."""

    def __init__(self, path: str):
        from tablecare.llm.pieces import Normaliser

        with open(path, "rb") as f:
            self.model = PieceModel(f.read())
        self.normaliser = Normaliser(self.model)
        self.known = Memory(self._stretch, REMEMBERED)

    def _stretch(self, stretch: str) -> int:
        """Tokens between two safe cuts; for a character that is no piece, its bytes below zero."""
        symbols = self.model.symbols(stretch)
        return -len(stretch.encode()) if symbols[0] < 0 else len(symbols) - self.model.merges.merge(symbols)

    def count(self, text: str) -> int:
        self.known.trim()
        total, unknown = 0, False
        for stretch in self.model.stretches(self.normaliser.text(text)):
            n = self.known[stretch]
            if n > 0:
                total, unknown = total + n, False
            elif self.model.byte_fallback:
                total -= n
            else:  # a run of unknown characters is one token
                total, unknown = total + (not unknown), True
        return total


@lru_cache(maxsize=2)
def counter(path: str) -> JsonCounter | PieceCounter:
    """One for each worker process."""
    return PieceCounter(path) if path.endswith(".model") else JsonCounter(path)


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether there are more than ``limit`` tokens, one row a document."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(tokenizer).count
        for batch in batches:
            for piece in slices(batch):
                texts = piece.column("text")
                found = np.fromiter((tokens(t.as_py()) for t in texts), np.int64, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array(lengths(texts)), pa.array(found), pa.array(found > limit)],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return id_and_text(docs, id_col, text_col).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


