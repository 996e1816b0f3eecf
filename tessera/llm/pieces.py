"""SentencePiece encoding by a streaming Viterbi pass with a bounded window, and decoding."""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

BLANK = "▁"
#: Bytes of keys and values (and ENTRY for each entry) of each of a cache's two generations, and entries of the table of pairs: bounds a worker's memory.
MOST_BYTES, ENTRY, MOST_PAIRS = 96 << 20, 200, 600_000


class Recent(dict):
    """What `made` gives for each key. A full generation becomes the old one, whose entries come back when they are asked for; what would take a 64th of it is not kept."""

    def __init__(self, made: Callable):
        self.made, self.old, self.held = made, {}, 0

    def __missing__(self, key):
        got = self.old.get(key)
        if got is None:
            got = self.made(key)
        size = 4 * len(key) + 8 * len(got) + ENTRY
        if 64 * size > MOST_BYTES:
            return got
        if self.held + size > MOST_BYTES:
            self.old = dict(self)
            self.clear()
            self.held = 0
        self[key] = got
        self.held += size
        return got


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


class Pieces:
    """Encoder and decoder for a SentencePiece model of kind BPE with byte fallback and a blank put in front.

    A lattice node is a place between characters. The best path to a node is the BPE encoding of the text before it; its
    last piece is the one that may follow the last piece of the path it extends, that is, whose letters, merged by
    the model's scores after that piece's letters, give back the two. So a node keeps one backpointer, as in Viterbi decoding.
    """

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.texts = [sp.id_to_piece(i) for i in range(sp.vocab_size())]
        self.bytes = {int(self.texts[i][3:5], 16): i for i in range(len(self.texts)) if sp.is_byte(i)}
        normal = [i for i in range(len(self.texts)) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.ids = {self.texts[i]: i for i in normal}
        self.score = {self.texts[i]: sp.get_score(i) for i in normal}
        self.longest = max(map(len, self.ids))
        #: Neighbours inside some piece: between others no piece stands across.
        self.joined = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.may: dict[tuple[str, str], bool] = {}
        self.units = Recent(self.unit)
        self.parts = Recent(lambda part: [i for _, ids in self.stream(part) for i in ids])
        byte_of = {i: b for b, i in self.bytes.items()}
        silent = {i for i in range(len(self.texts)) if sp.is_control(i)}
        self.raw = [b"" if i in silent else bytes([byte_of[i]]) if i in byte_of else t.replace(BLANK, " ").encode() for i, t in enumerate(self.texts)]

    def merged(self, letters: list[str]) -> list[str]:
        """BPE as the model defines it: the pair with the best score, leftmost first, until none is a piece."""
        score, none = self.score.get, -np.inf
        pairs = [score(a + b, none) for a, b in zip(letters, letters[1:], strict=False)]
        while pairs and (best := max(pairs)) > none:
            i = pairs.index(best)
            letters[i : i + 2] = [letters[i] + letters[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = score(letters[i - 1] + letters[i], none)
            if i < len(pairs):
                pairs[i] = score(letters[i] + letters[i + 1], none)
        return letters

    def follows(self, a: str, b: str) -> bool:
        got = self.may.get((a, b))
        if got is None:
            if len(self.may) > MOST_PAIRS:
                self.may.clear()
            got = self.may[a, b] = self.merged([*(a + b)]) == ([a, b] if a else [b])
        return got

    def of(self, piece: str) -> list[int]:
        i = self.ids.get(piece)
        return [i] if i is not None else [self.bytes[b] for b in piece.encode()]

    def stream(self, characters: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
        """(text, ids) as soon as they are settled.

        Holds the nodes of the last `longest` characters, from which alone a piece can still begin, and those back to
        the boundary that all their paths share; when the boundary moves, what stands before it is given out.
        """
        longest, ids = self.longest, self.ids
        text: list[str] = []  # from the boundary on
        last, back = [""], [0]
        for c in characters:
            text.append(c)
            i = len(text)
            tail = "".join(text[max(0, i - longest) :])
            for n in range(1, len(tail) + 1):
                piece = tail[len(tail) - n :]
                # After the boundary the piece before it still decides, so it is kept as last[0].
                if (piece in ids or n == 1) and last[i - n] is not None and self.follows(last[i - n], piece):
                    last.append(piece)
                    back.append(i - n)
                    break
            else:
                last.append(None)
                back.append(-1)
            if i >= 2 * longest:
                yield from self.settle(text, last, back, i - longest + 1)
        yield from self.settle(text, last, back, len(text))

    def settle(self, text: list[str], last: list, back: list[int], oldest: int) -> Iterator[tuple[str, list[int]]]:
        live = {i for i in range(oldest, len(text) + 1) if last[i] is not None}
        while len(live) > 1:
            top = max(live)
            live.discard(top)
            live.add(back[top])
        boundary = live.pop()
        if boundary <= 0:
            return
        path, at = [], boundary
        while at > 0:
            path.append(last[at])
            at = back[at]
        yield "".join(text[:boundary]), [i for piece in path[::-1] for i in self.of(piece)]
        del text[:boundary], last[:boundary], back[:boundary]
        back[:] = [b - boundary for b in back]
        back[0] = 0

    def part(self, part: str) -> list[int]:
        """Ids of a text across whose ends no piece stands; those of short ones are kept."""
        return self.parts[part] if len(part) <= 64 else [i for _, ids in self.stream(part) for i in ids]

    def unit(self, word: str) -> bytes:
        """Ids of a blank and a word, as bytes, split where no piece stands across."""
        whole, cuts = BLANK + word, [0]
        cuts += [i for i in range(1, len(whole)) if whole[i - 1 : i + 1] not in self.joined]
        ids = [i for a, b in zip(cuts, [*cuts[1:], len(whole)], strict=True) for i in self.part(whole[a:b])]
        return array("I", ids).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, as bytes of little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        if "  " in text or BLANK in text or text[0] == " " or text[-1] == " ":
            # Runs of blanks merge among themselves: such a text is streamed between single blanks.
            return self.blanks(text.replace(BLANK, " "))
        words = text.split(" ")
        if max(map(len, words)) > 1000:
            return b"".join([self.units[w] if len(w) <= 64 else self.unit(w) for w in words])
        return b"".join(map(self.units.__getitem__, words))

    def blanks(self, text: str) -> bytes:
        out, run = [], ""
        words = text.split(" ")
        for i, w in enumerate(words):
            if w == "" and i < len(words) - 1:
                run += BLANK
            elif run or w == "":
                out.append(array("I", self.part(run + BLANK + w)).tobytes())
                run = ""
            else:
                out.append(self.units[w] if len(w) <= 64 else self.unit(w))
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """The text of ids, as UTF-8, without the blank put in front."""
        return b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<u4").tolist())).removeprefix(b" ")


@cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


def encoded(docs: DataFrame, path: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, n_pieces, ids (binary, little-endian unsigned 32-bit), round_trip.

    round_trip tells whether decoding gives the text back; it can fail only for texts that hold the blank's own sign.
    Null texts count as empty: no ids. Equal rows each come out; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for batch in batches:
            texts = batch.column(1)
            for at in range(0, batch.num_rows, 512):
                raw = ["" if x is None else x for x in texts[at : at + 512].to_pylist()]
                ids = [p.encode(x) for x in raw]
                same = [p.decode(i) == x.encode() for i, x in zip(ids, raw, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[at : at + 512], pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(same)], ["doc_id", "n_pieces", "ids", "round_trip"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(tidy(run), "doc_id long, n_pieces long, ids binary, round_trip boolean")


def decoded(rows: DataFrame, path: str, ids: str = "ids", id_col: str = "doc_id") -> DataFrame:
    """One row per row: doc_id and the text of its ids; null ids count as none. Bytes that are no UTF-8 become U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for batch in batches:
            out = [p.decode(x or b"").decode(errors="replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(tidy(run), "doc_id long, text string")


def checksum(docs: DataFrame, path: str) -> DataFrame:
    """encoded() with ids_crc32 in place of ids."""
    return encoded(docs, path).select("doc_id", "n_pieces", F.crc32("ids").alias("ids_crc32"), "round_trip")


def crc32(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())
