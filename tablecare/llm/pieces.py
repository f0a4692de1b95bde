"""SentencePiece BPE encoding that keeps offsets, and decoding.

Text is normalised by the longest prefix found in the model's compiled
character map, each normalised byte remembering the source byte it came from;
pieces made of the normalised text are projected to byte spans of the source.

``encode`` gives ids and spans, ``decode`` texts, ``round_trip`` digests of
both without moving the lists between processes.

Defined cases: a null or empty text has no ids and decodes to the empty text;
a character that is no piece becomes its bytes, of which the last carries the
span (or the unknown piece, in a model without byte pieces); repeated rows are
encoded each; empty tables give empty results.
"""

from __future__ import annotations

import codecs
import hashlib
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tablecare.llm.bpe import BLANK, BYTE, CONTROL, PieceModel
from tablecare.llm.texts import Memory, id_and_text, slices

#: Words, and stretches between safe cuts, that a worker remembers; emptied when full, results don't change.
REMEMBERED = 300_000

#: Symbols up to which merging looks through all pairs instead of keeping a heap.
SHORT = 40

codecs.register_error("each_byte", lambda e: ("�" * (e.end - e.start), e.end))


class CharMap:
    """The compiled map: a double-array trie over bytes, then the replacements, each ended by a zero byte."""

    def __init__(self, blob: bytes):
        size = struct.unpack("<I", blob[:4])[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.texts = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """Replacement of the longest known prefix from ``at``, and its length."""
        units, node, best = self.units, 0, None
        if not units:
            return None
        node ^= self._child(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            unit = units[node]
            if unit & 0x800000FF != data[i]:  # the label of a unit that isn't a value
                break
            node ^= self._child(unit)
            if unit >> 8 & 1:  # a value hangs below
                best = (units[node] & 0x7FFFFFFF, i + 1 - at)
        if best is None:
            return None
        start, length = best
        return self.texts[start : self.texts.index(0, start)], length

    @staticmethod
    def _child(unit: int) -> int:
        """Where a unit's children are, relative to it; a flag scales the distance by 256."""
        return unit >> 10 << ((unit & 0x200) >> 6)


class Normaliser:
    def __init__(self, model: PieceModel):
        self.model = model
        self.map = CharMap(model.charsmap)
        self.blank = BLANK if model.escape else " "
        #: Every character stands for itself, blanks apart.
        self.plain = not model.charsmap and not model.remove_extra and model.escape and model.dummy_prefix

    def text(self, text: str) -> str:
        if self.plain:
            return BLANK + text.replace(" ", BLANK) if text else ""
        return self.aligned(text)[0]

    def aligned(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and the source byte of each of its bytes and of its end."""
        data, m = text.encode(), self.model
        out, source = bytearray(), []
        blank = self.blank.encode()

        def put(piece: bytes, at: int) -> None:
            out.extend(piece)
            source.extend([at] * len(piece))

        at, steps = 0, []
        while at < len(data):
            if (found := self.map.longest(data, at)) is None:
                size = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
                found = data[at : at + size], size
            steps.append((at, *found))
            at += found[1]
        if m.remove_extra:
            while steps and steps[0][1] == b" ":
                steps.pop(0)
        if not steps:
            return "", np.zeros(1, np.int64)
        if m.dummy_prefix:
            put(blank, steps[0][0])
        after_blank = m.remove_extra
        for at, piece, _ in steps:
            if after_blank:
                piece = piece.lstrip(b" ")
            for part in re.findall(rb" |[^ ]+", piece):
                put(blank if part == b" " else part, at)
            if piece or not after_blank:
                after_blank = m.remove_extra and piece.endswith(b" ")
        end = steps[-1][0] + steps[-1][2]
        if m.remove_extra:
            while out.endswith(blank):
                del out[-len(blank) :]
                end = source[len(out)]
        return out.decode(), np.array([*source[: len(out)], end], np.int64)


class Encoder:
    """Ids and spans of texts; words seen before are taken from memory."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.model = PieceModel(f.read())
        self.normaliser = Normaliser(self.model)
        m = self.model
        #: Nothing reaches over the start of a blank run or over a line end, so words can be taken one by one.
        self.by_words = self.normaliser.plain and not any(BLANK == b and a != BLANK or "\n" in (a, b) for a, b in m.adjacent)
        self.words = Memory(self._word, REMEMBERED)
        self.parts = Memory(self._part, REMEMBERED)
        self.lengths = [len(p.encode()) - (2 * p.count(BLANK) if self.by_words else 0) for p in m.pieces]
        self.runs = re.compile(f"{BLANK}+[^{BLANK}\n]*|[^{BLANK}\n]+|\n")

    def _part(self, stretch: str) -> bytes:
        """(id, length) of each piece as 32-bit integers; a blank is as long as it is in the source, or in the normalised text."""
        m, symbols = self.model, self.model.symbols(stretch)
        if symbols[0] < 0:
            data = stretch.encode()
            pairs = [(m.byte_ids[b], 0) for b in data[:-1]] + [(m.byte_ids[data[-1]], len(data))] if m.byte_fallback else [(m.unk, len(data))]
        else:
            if len(symbols) > SHORT:
                m.merges.merge(symbols)
            else:
                m.merges.merge_short(symbols)
            pairs = [(i, self.lengths[i]) for i in symbols if i >= 0]
        return array("i", [x for pair in pairs for x in pair]).tobytes()

    def _word(self, word: str) -> bytes:
        """A word that stood between single blanks; a line end is kept at its start."""
        whole = ["\n", *self.model.stretches(word[1:])] if word.startswith("\n") else self.model.stretches(BLANK + word)
        return b"".join(map(self.parts.__getitem__, whole))

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, and the first byte and end of each piece in the source."""
        if not text:
            return _NONE, _NONE, _NONE
        self.words.trim()
        self.parts.trim()
        if not self.by_words or BLANK in text:
            return self._general(text)
        if "  " in text or "\n\n" in text or " \n" in text or text[0] == " ":
            found = b"".join(map(self.parts.__getitem__, (s for r in self.runs.findall(BLANK + text.replace(" ", BLANK)) for s in self.model.stretches(r))))
        else:
            found = b"".join(map(self.words.__getitem__, text.replace("\n", " \n").split(" ")))
        pairs = np.frombuffer(found, "<i4").reshape(-1, 2)
        ends = np.cumsum(pairs[:, 1]) - 1  # the blank put before the text has no byte there
        starts = np.empty_like(ends)
        starts[0], starts[1:] = 0, ends[:-1]
        return pairs[:, 0], starts, ends

    def _general(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        normal, source = self.normaliser.aligned(text)
        pairs: list[tuple[int, int]] = []
        merged = not self.model.byte_fallback
        for s in self.model.stretches(normal):
            part = np.frombuffer(self.parts[s], "<i4").reshape(-1, 2)
            if self.by_words:
                part = self._normalised_lengths(part, s)
            for i, n in part.tolist():
                if merged and i == self.model.unk and pairs and pairs[-1][0] == i:  # a run of unknown characters is one piece
                    pairs[-1] = (i, pairs[-1][1] + n)
                else:
                    pairs.append((i, n))
        if not pairs:
            return _NONE, _NONE, _NONE
        table = np.array(pairs, np.int64)
        ends = np.cumsum(table[:, 1])
        return table[:, 0].astype(np.int32), source[ends - table[:, 1]], source[ends]

    def _normalised_lengths(self, part: np.ndarray, stretch: str) -> np.ndarray:
        if self.model.symbols(stretch)[0] < 0:
            return part
        return np.array([(i, len(self.model.pieces[i].encode())) for i in part[:, 0].tolist()], np.int32)


_NONE = np.zeros(0, np.int32)


class Decoder:
    def __init__(self, model: PieceModel):
        self.model = model
        self.texts = [p.replace(BLANK, " ") for p in model.pieces]
        for i, kind in enumerate(model.kinds):
            if kind == CONTROL:
                self.texts[i] = ""
        self.texts[model.unk] = model.unk_surface
        self.byte = {i: b for b, i in model.byte_ids.items()}
        for i, b in self.byte.items():
            self.texts[i] = chr(b) if b < 0x80 else ""
        self.high = np.zeros(len(model.pieces), bool)
        self.high[[i for i, b in self.byte.items() if b >= 0x80]] = True
        self.skips = model.dummy_prefix or model.remove_extra

    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids; bytes that are no UTF-8 become U+FFFD each."""
        if not len(ids):
            return ""
        listed = ids.tolist()
        start = self._leading(listed) if self.skips else 0
        head = "" if not start else "".join(self._stripped(listed[:start]))
        rest, body = ids[start:], listed[start:]
        if self.high[rest].any():
            return head + self._with_bytes(body)
        return head + "".join(map(self.texts.__getitem__, body))

    def _leading(self, listed: list[int]) -> int:
        """How many pieces from the start are to be read without a leading blank."""
        for k, i in enumerate(listed):
            if self.model.kinds[i] == BYTE:
                return k
            piece = self.model.pieces[i]
            if i == self.model.unk:
                return k
            if self.model.kinds[i] != CONTROL and (not self.model.remove_extra or piece != BLANK):
                return k + 1
        return len(listed)

    def _stripped(self, listed: list[int]) -> Iterator[str]:
        for i in listed:
            text = self.texts[i]
            yield text[1:] if self.model.pieces[i].startswith(BLANK) else text

    def _with_bytes(self, listed: list[int]) -> str:
        out, run = [], bytearray()
        for i in listed:
            if (b := self.byte.get(i)) is not None:
                run.append(b)
                continue
            if run:
                out.append(run.decode("utf-8", "each_byte"))
                run.clear()
            out.append(self.texts[i])
        out.append(run.decode("utf-8", "each_byte"))
        return "".join(out)


@lru_cache(maxsize=2)
def coder(path: str) -> tuple[Encoder, Decoder]:
    """One for each worker process."""
    encoder = Encoder(path)
    return encoder, Decoder(encoder.model)


ENCODED = "doc_id long, ids array<int>, starts array<int>, ends array<int>"


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate([*parts, _NONE]).astype(np.int32)))


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, and the first byte and end of each piece in the UTF-8 text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = coder(model)[0].encode
        for batch in batches:
            for piece in slices(batch):
                found = [one(t.as_py()) for t in piece.column("text")]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *(_lists([f[k] for f in found]) for k in range(3))], ["doc_id", "ids", "starts", "ends"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, ENCODED)


def decode(tokens: DataFrame, model: str) -> DataFrame:
    """doc_id and text of ``encode``'s rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = coder(model)[1].decode
        for batch in batches:
            texts = [one(np.array(ids.as_py() or [], np.int32)) for ids in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of ids, decoded text and spans (CRC-32 of all ends), one row a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = coder(model)
        decimal = [str(i) for i in range(len(encoder.model.pieces))].__getitem__
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            for piece in slices(batch):
                rows = []
                for t in piece.column("text"):
                    ids, _, ends = encoder.encode(t.as_py())
                    rows.append((len(ids), sha(",".join(map(decimal, ids.tolist()))), sha(decoder.decode(ids)), zlib.crc32(ends.astype("<i4").tobytes())))
                counts, *rest = zip(*rows, strict=True)
                kinds = (pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array(counts, pa.int64()), *(pa.array(c, k) for c, k in zip(rest, kinds, strict=True))],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ends_crc32"],
                )

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ends_crc32 long")
