"""Exact encoding with a merge-type (BPE) sentencepiece vocabulary by backtracking, and decoding.

The library merges the adjacent symbols whose joined piece has the best score, leftmost first, until
nothing merges. A sequence of pieces is the result of that process exactly when every two neighbours,
joined and merged anew, come apart into themselves again: the first merge over a boundary of the
sequence would also be the first one in that pair. So the text is covered from the left with the
longest piece (Aho-Corasick finds the pieces at all positions in one pass) that is compatible with the
piece before it; where none is, the last piece is taken back and a shorter one tried. A prefix of a
text has one encoding only, so a position that failed once fails always: a bitfield keeps those
positions, and the work is linear in the text.

A character outside the vocabulary is a symbol of its own, spelled by the byte pieces of its UTF-8
form. Text is cut before a space mark that follows another character, and between letters and others, where
no piece of the vocabulary spans such a place (then no merge does); each distinct part is encoded once per worker.

Defined cases: null and empty texts have the end id only; equal or repeated rows are encoded one by
one; a null doc_id is kept; an empty table gives an empty result; other columns are ignored. Models
with user-defined symbols are not supported; unused pieces are an error.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.llm.common import ship

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
NEVER = float("-inf")
#: Parts a worker remembers with their ids (those of at most LONG_PART characters) and pairs with their verdicts; a full memory is emptied.
CACHE_PARTS, LONG_PART, CACHE_PAIRS = 1_000_000, 64, 1_000_000
#: A worker hands on its rows after this many ids and characters.
FLUSH = 2_000_000

ENCODED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])


def cuts(pieces: Iterable[str]) -> list[tuple[str, str]]:
    """Ways to cut a normalised text into parts, the finest first, each with the places that no piece may span."""
    odd = re.escape("".join(sorted({c for p in pieces for c in p if re.match(r"[^\W\d_]", c) and not c.isalpha()})))  # number signs
    letter, other = rf"[^\W\d_{odd}]", rf"(?:[\d_{odd}]|[^\w{SPACE}])"
    return [(f"{SPACE}*{letter}+|{SPACE}*{other}+|{SPACE}+", f"{letter}{other}|{other}{letter}|[^{SPACE}]{SPACE}"),
            (f"{SPACE}*[^{SPACE}]+|{SPACE}+", f"[^{SPACE}]{SPACE}")]


class PieceCodec:
    """``encode(text)`` gives the ids as int32 bytes (without an end id), ``decode(ids)`` the text."""

    _loaded: dict[str, "PieceCodec"] = {}

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        if any(model.is_unused(i) for i in ids):
            raise ValueError("models with unused pieces are not supported")
        normal = [i for i in ids if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i))]
        self.id = {model.id_to_piece(i): i for i in normal}
        self.score = {model.id_to_piece(i): model.get_score(i) for i in normal}
        self.byte = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.found = ahocorasick.Automaton()
        for piece in self.id:
            self.found.add_word(piece, len(piece))
        self.found.make_automaton()
        self.parts = next((re.compile(parts) for parts, spanned in cuts(self.id) if not any(re.search(spanned, p) for p in self.id)), None)
        self.known: dict[str, bytes] = {}
        self.widest = max(map(len, self.id))
        self.next_shorter: dict[str, str | None] = {}
        self.pairs: dict[tuple[str | None, str], bool] = {}

    @classmethod
    def load(cls, path: str | None = None) -> "PieceCodec":
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(MODEL)
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def merged(self, text: str) -> list[str]:
        """The merge process itself, for the few characters of one or two pieces."""
        symbols, score = list(text), self.score.get
        gains = [score(a + b, NEVER) for a, b in zip(symbols, symbols[1:])]
        while gains and (best := max(gains)) > NEVER:
            k = gains.index(best)  # the leftmost of the best
            symbols[k:k + 2] = [symbols[k] + symbols[k + 1]]
            del gains[k]
            if k:
                gains[k - 1] = score(symbols[k - 1] + symbols[k], NEVER)
            if k < len(gains):
                gains[k] = score(symbols[k] + symbols[k + 1], NEVER)
        return symbols

    def compatible(self, left: str | None, right: str) -> bool:
        """Whether the two pieces (or, at the start, the one) stay as they are when merged anew."""
        key = (left, right)
        verdict = self.pairs.get(key)
        if verdict is None:
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            verdict = self.pairs[key] = self.merged(right) == [right] if left is None else self.merged(left + right) == [left, right]
        return verdict

    def longest(self, text: str, pos: int) -> str:
        """The longest piece that starts here; a character outside the vocabulary stands for itself."""
        ahead = text[pos:pos + self.widest]
        for end, length in self.found.iter_long(ahead):
            return ahead[:length] if end + 1 == length else ahead[0]
        return ahead[0]

    def shorter(self, piece: str) -> str | None:
        """The next shorter piece that starts the same way."""
        if piece not in self.next_shorter:
            cuts = (piece[:n] for n in range(len(piece) - 1, 0, -1))
            self.next_shorter[piece] = next((c for c in cuts if len(c) == 1 or c in self.id), None)
        return self.next_shorter[piece]

    def cover(self, text: str) -> list[str]:
        """The pieces (and unknown characters) of a normalised text."""
        n = len(text)
        failed = bytearray((n >> 3) + 1)
        pieces: list[str] = []
        last: str | None = None
        pos = 0
        piece = self.longest(text, 0) if n else None
        known = self.pairs
        while pos < n:
            while piece is not None:
                end = pos + len(piece)
                if not failed[end >> 3] >> (end & 7) & 1:
                    verdict = known.get((last, piece))
                    if verdict or verdict is None and self.compatible(last, piece):
                        break
                piece = self.shorter(piece)
            if piece is not None:
                pieces.append(piece)
                last, pos = piece, end
                if pos < n:
                    piece = self.longest(text, pos)
            else:
                failed[pos >> 3] |= 1 << (pos & 7)
                last = pieces.pop()
                pos -= len(last)
                piece = self.shorter(last)
                last = pieces[-1] if pieces else None
        return pieces

    def _ids(self, part: str) -> bytes:
        out: list[int] = []
        for piece in self.cover(part):
            at = self.id.get(piece)
            if at is None:
                out += [self.byte[b] for b in piece.encode()]
            else:
                out.append(at)
        return array("i", out).tobytes()

    def encode(self, text: str) -> bytes:
        shown = self.model.normalize(text)
        parts = self.parts.findall(shown) if self.parts else [shown] if shown else []
        known = self.known
        try:
            return b"".join([known[p] for p in parts])
        except KeyError:
            out = []
            for p in parts:
                ids = known.get(p)
                if ids is None:
                    ids = self._ids(p)
                    if len(p) <= LONG_PART:
                        if len(known) >= CACHE_PARTS:
                            known.clear()
                        known[p] = ids
                out.append(ids)
            return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        return self.model.decode(ids)


def encode_documents(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """One row per document: (doc_id, ids with the end id, the text that the ids decode to)."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = PieceCodec.load(model_path)
        end = np.asarray([codec.model.eos_id()], dtype="<i4").tobytes()
        for batch in batches:
            doc_ids, coded, texts, held = [], [], [], 0
            for doc, text in zip(batch.column(0), batch.column(1)):
                ids = codec.encode(text.as_py() or "") + end
                doc_ids.append(doc.as_py())
                coded.append(ids)
                texts.append(codec.decode(np.frombuffer(ids, dtype="<i4").tolist()))
                held += len(ids) // 4 + len(texts[-1])
                if held >= FLUSH:
                    yield _batch(doc_ids, coded, texts)
                    doc_ids, coded, texts, held = [], [], [], 0
            yield _batch(doc_ids, coded, texts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, ENCODED)


def _batch(doc_ids: list, coded: list[bytes], texts: list[str]) -> pa.RecordBatch:
    offsets = np.cumsum([0, *(len(c) // 4 for c in coded)], dtype="<i4")
    ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(coded), dtype="<i4"), pa.int32()))
    return pa.record_batch([pa.array(doc_ids, pa.int64()), ids, pa.array(texts, pa.string())], names=ENCODED.names)


def digests(encoded: DataFrame) -> DataFrame:
    """The report of the registered query: counts and digests of ids and decoded texts."""
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                          F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
                          F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
