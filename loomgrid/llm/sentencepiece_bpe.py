"""Exact merge-type (BPE) encoding of a sentencepiece model by backtracking, and decoding.

A merge-type model joins the adjacent pair whose joined piece has the best score until none is left.  A
sequence of pieces is that result exactly if every two neighbours are what their joined text is encoded to.
So a chunk is covered from the left by its longest piece (found for all positions by one Aho-Corasick
pass), shortened while it doesn't suit its left neighbour; a position from which no piece leads on is marked
in a bitfield (a byte a position, so that marking one costs the same in a chunk of any length) and never tried again.  Whether two pieces suit each other is found by merging their joined
characters again, and remembered.

No piece has the space mark behind another character (checked when a model is read), so merges never cross
the start of a run of marks: a text is cut there, and a chunk is cut again between any two characters that
are neighbours in no piece.  Each distinct chunk is encoded once per worker while it stays in a bounded memory.  Characters without a piece become byte pieces, or the unknown id where the
model has none.

Edge cases: a null text counts as empty; an empty text has the begin and end ids only; an empty table gives
no rows; rows that repeat get equal rows; very long texts are whole, and taken in slices of bounded rows and bytes;
where two merges have equal scores the left one comes first, as in the library; extra columns, of any name, are
ignored.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import claim, slices, small_batches, table

MARK = "▁"
CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: As CHUNK, and between a letter and anything else; for texts without the characters that a model joins across this.
PART = re.compile(rf"{MARK}*[^\W\d_]+|{MARK}*[\W\d_](?:(?!{MARK})[\W\d_])*")
LETTER = re.compile(r"[^\W\d_]")
REMEMBERED = 100_000  # in each of two generations
REMEMBERED_PAIRS = 300_000
LONG = 48
MODEL_NAME = "piece_bpe_32k.model"


class Memory(dict):
    """``make(key)`` of the keys used of late: a full generation becomes the old one, whose used keys come back."""

    def __init__(self, make: Callable, size: int = REMEMBERED):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        if (found := self.old.get(key)) is None:
            found = self.make(key)
        if len(key) <= LONG:
            if len(self) >= self.size:
                self.old = dict(self)
                self.clear()
            self[key] = found
        return found


class MergeEncoder:
    """Encoder and decoder of one model file (identity normalisation with a leading space mark)."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.normalize(" Ａ  ﬁ\t") != f"{MARK * 2}Ａ{MARK * 2}ﬁ\t":
            raise ValueError("the model must keep its text as it is, with a leading space mark")
        n = model.get_piece_size()
        self.bos, self.eos, self.unk = model.bos_id(), model.eos_id(), model.unk_id()
        self.ends = [array("I", [x]).tobytes() for x in (self.bos, self.eos)]
        self.byte = {}
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.out: list[bytes] = [b""] * n
        self.is_byte = [False] * n
        for at in range(n):
            piece = model.id_to_piece(at)
            if model.is_byte(at):
                self.byte[int(piece[3:5], 16)] = at
                self.out[at] = bytes([int(piece[3:5], 16)])
                self.is_byte[at] = True
            elif at == self.unk:
                self.out[at] = " ⁇ ".encode()
            elif not model.is_control(at):
                self.id[piece] = at
                self.score[piece] = model.get_score(at)
                self.out[at] = piece.replace(MARK, " ").encode()
                if re.search(f"[^{MARK}]{MARK}", piece):
                    raise ValueError("a piece has a space mark behind another character")
        self.bytes_below = frozenset(self.byte.values())
        self.near = {x for piece in self.id for x in zip(piece, piece[1:], strict=False)}
        self.pairs: dict[tuple[str, str], bool] = {}
        across = set()
        for pair in self.near:
            letters = [c for c in pair if LETTER.match(c)]
            if MARK not in pair and len(letters) == 1:
                across.add(letters[0] if not letters[0].isalpha() else next(c for c in pair if c not in letters))
        self.glue = re.compile(f"[{re.escape(''.join(sorted(across)))}]") if across else None
        self.known = Memory(self._chunk)
        own = [x for x in self.id if len(x) == 1 or self.merge(x) == [x]]
        self.words = ahocorasick.Automaton()
        for x in own:
            self.words.add_word(x, (len(x) - 1, x))
        self.words.make_automaton()
        # The longest proper prefix of each piece that is a piece itself.
        kept = set(own)
        self.shorter = {x: next((x[:k] for k in range(len(x) - 1, 0, -1) if x[:k] in kept), None) for x in own}

    def merge(self, text: str) -> list[str]:
        """The merges themselves: used on single pieces and pairs of pieces only."""
        parts = list(text)
        score = self.score
        while len(parts) > 1:
            best, where = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, where = s, k
            if where < 0:
                break
            parts[where : where + 2] = [parts[where] + parts[where + 1]]
        return parts

    def suits(self, left: str, right: str) -> bool:
        """Whether ``left`` and ``right`` are what their joined text is encoded to."""
        key = (left, right)
        if (found := self.pairs.get(key)) is None:
            if len(self.pairs) >= REMEMBERED_PAIRS:
                self.pairs.clear()
            found = self.pairs[key] = self.merge(left + right) == [left, right]
        return found

    def pieces(self, chunk: str) -> list[str]:
        """The pieces of a chunk; a character without a piece stands for itself."""
        n = len(chunk)
        longest: list[str] = list(chunk)
        for end, (less, piece) in self.words.iter(chunk):  # by rising end, so the last found is the longest
            longest[end - less] = piece
        known, shorter, pairs, suits = self.id, self.shorter, self.pairs, self.suits
        open_at = bytearray(b"\1") * (n + 1)  # the positions that may still lead on
        out: list[str] = []
        at, last, piece = 0, "", longest[0] if n else None
        while piece is not None:
            end = at + len(piece)
            if open_at[end]:
                ok = not last or last not in known or piece not in known
                if not ok and (ok := pairs.get((last, piece))) is None:
                    ok = suits(last, piece)
                if ok:
                    out.append(piece)
                    last, at = piece, end
                    piece = longest[at] if at < n else None
                    continue
            if (piece := shorter.get(piece)) is None:
                if not out:
                    raise AssertionError("a chunk has no encoding")
                open_at[at] = 0
                piece = out.pop()
                last = out[-1] if out else ""
                at -= len(piece)
        return out

    def part_ids(self, part: str) -> list[int]:
        """The ids of a part whose neighbouring characters are neighbours in some piece."""
        if len(part) == 1:
            found = [part]
        else:
            found = self.pieces(part)
        ids = [*map(self.id.get, found)]
        if None not in ids:
            return ids
        ids = []
        for piece in found:
            if (at := self.id.get(piece)) is not None:
                ids.append(at)
            elif self.byte:
                ids.extend(self.byte[b] for b in piece.encode())
            else:
                ids.append(self.unk)
        return ids

    def chunk_ids(self, chunk: str) -> list[int]:
        if chunk[-1:].isalpha() and chunk.lstrip(MARK).isalpha():
            return self.part_ids(chunk)
        near, ids, start = self.near, [], 0
        cuts = [k for k, x in enumerate(zip(chunk, chunk[1:], strict=False), 1) if x not in near]
        for end in [*cuts, len(chunk)]:
            ids += self.part_ids(chunk[start:end])
            start = end
        return ids

    def _chunk(self, chunk: str) -> tuple[bytes, bytes]:
        """A chunk's ids as bytes, and what these ids decode to."""
        ids = self.chunk_ids(chunk)
        return array("I", ids).tobytes(), self._bytes(ids)

    def both(self, text: str) -> tuple[bytes, bytes]:
        """Ids as little-endian unsigned 32-bit integers, with begin and end, and the decoded text in UTF-8."""
        if not text:
            return self.ends[0] + self.ends[1], b""
        marked = MARK + text.encode("utf-8", "replace").decode().replace(" ", MARK)
        cut = CHUNK if self.glue and self.glue.search(marked) else PART
        found = list(map(self.known.__getitem__, cut.findall(marked)))
        return self.ends[0] + b"".join([ids for ids, _ in found]) + self.ends[1], b"".join([said for _, said in found])[1:]

    def forget(self) -> None:
        self.known.clear()
        self.known.old = {}
        self.pairs.clear()

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.both(text)[0], "<u4").tolist()

    def _bytes(self, ids: Iterable[int]) -> bytes:
        if self.bytes_below.isdisjoint(ids):
            return b"".join([self.out[at] for at in ids])
        out, run = [], bytearray()
        for at in ids:
            if self.is_byte[at]:
                run += self.out[at]
                continue
            out += [self._run(run), self.out[at]]
            run.clear()
        return b"".join([*out, self._run(run)])

    @staticmethod
    def _run(run: bytearray) -> bytes:
        """A run of byte pieces; each byte that belongs to no character becomes U+FFFD."""
        try:
            run.decode()
            return bytes(run)
        except UnicodeDecodeError:
            out, at = [], 0
            while at < len(run):
                size = next((k for k in (1, 2, 3, 4) if _valid(run[at : at + k], k)), 0)
                out.append(bytes(run[at : at + size]) if size else "�".encode())
                at += size or 1
            return b"".join(out)

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: begin and end ids say nothing, the leading space mark goes."""
        ids = list(ids)
        said = self._bytes(ids)
        ids = [x for x in ids if x not in (self.bos, self.eos)]
        return (said[1:] if ids and not self.is_byte[ids[0]] and said[:1] == b" " and ids[0] != self.unk else said).decode()


def _valid(part: bytes | bytearray, size: int) -> bool:
    try:
        return len(part) == size and len(part.decode()) == 1
    except UnicodeDecodeError:
        return False


@cache
def encoder(path: str) -> MergeEncoder:
    return MergeEncoder(path)


def model_path() -> str:
    """The model's place in the installed package of public vocabularies."""
    import public_tokenizers

    return public_tokenizers.path(MODEL_NAME)


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded string), for use beyond the digests."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(path or model_path())
        claim("sentencepiece", model.forget)
        for batch in slices(batches, "text", 256):
            made = [model.both(x.as_py() or "") for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([np.frombuffer(x, "<i4") for x, _ in made], pa.list_(pa.int32())), pa.array([x.decode() for _, x in made], pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digest_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole text."""
    small_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(path or model_path())
        claim("sentencepiece", model.forget)
        for batch in batches:
            n, a, b = [], [], []
            for text in batch.column("text"):
                ids, said = model.both(text.as_py() or "")
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                b.append(hashlib.sha256(said).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(table(spark, sf_dir, "documents"))
