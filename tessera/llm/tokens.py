"""Exact token counts and ids of a word-level BPE tokenizer file (library: tokenizers).

Two ways to the same ids: the library itself (`Encoder.ids`), and a dynamic program over the prefixes of each word
(`PrefixCounter`), which stores the count at every prefix.
"""

from __future__ import annotations

import json
import os
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from itertools import accumulate
from sys import getsizeof

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

#: Pre-tokens of the tokenizer file, as its own pre_tokenizer states them (fixed value).
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
END = "</w>"
#: Bytes of keys and values (and 100 for each entry) that one of a worker's caches holds before it is emptied: bounds its memory.
MOST_BYTES = 96 << 20


class Known(dict):
    """What `made` gives for each key, kept until they take MOST_BYTES; what would take a 64th of that alone is not kept."""

    def __init__(self, made: Callable):
        self.made, self.held = made, 0

    def __missing__(self, key):
        got = self.made(key)
        size = getsizeof(key) + getsizeof(got) + 100
        if 64 * size > MOST_BYTES:
            return got
        if self.held + size > MOST_BYTES:
            self.clear()
            self.held = 0
        self[key] = got
        self.held += size
        return got


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@cache
def library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level BPE: itself if printable, else the next one from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class PrefixCounter:
    """Token counts of every prefix of a word, by one pass over it.

    The last token of a text's BPE encoding is the one suffix of it that may follow the last token of the encoding of what
    stands before; so a prefix needs only the last token and the count of shorter prefixes. Two tokens may follow each
    other if merging their joined letters gives back the two. A prefix that ends a word has its last letter marked.
    """

    def __init__(self, path: str):
        model = json.loads(open(path, encoding="utf-8").read())["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.ranks = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): i for i, m in enumerate(model["merges"])}
        made = {a + b for a, b in self.ranks}
        self.plain = {t for t in self.ids if not t.endswith(END) and (t in made or len(t) == 1)}
        self.final = {t[: -len(END)] for t in self.ids if t.endswith(END) and (t in made or len(t) == 1 + len(END))}
        self.longest = max(map(len, [*self.plain, *self.final]))
        self.may: dict[tuple[str, str, bool], bool] = {}
        self.held = 0

    def merged(self, letters: list[str]) -> list[str]:
        """BPE as it is defined: join the pair of least rank, leftmost first, until none is left."""
        rank, none = self.ranks.get, 1 << 60
        pairs = [rank(p, none) for p in zip(letters, letters[1:], strict=False)]
        while pairs and (best := min(pairs)) < none:
            i = pairs.index(best)
            letters[i : i + 2] = [letters[i] + letters[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = rank((letters[i - 1], letters[i]), none)
            if i < len(pairs):
                pairs[i] = rank((letters[i], letters[i + 1]), none)
        return letters

    def follows(self, a: str, b: str, last: bool) -> bool:
        key = (a, b, last)
        got = self.may.get(key)
        if got is None:
            self.held += getsizeof(a) + getsizeof(b) + getsizeof(key) + 100
            if self.held > MOST_BYTES:
                self.may.clear()
                self.held = 0
            letters = [*(a + b)]
            letters[-1] += END * last
            got = self.may[key] = self.merged(letters) == ([a, b + END * last] if a else [b + END * last])
        return got

    def word(self, letters: str) -> tuple[list[int], list[str]]:
        """For a word in byte letters: the token count of each prefix as a word of its own, and the tokens of the whole."""
        n, longest, follows = len(letters), self.longest, self.follows
        open_count, open_last, back = [0] * (n + 1), [""] * (n + 1), [0] * (n + 1)
        closed = [0] * (n + 1)
        final, final_at = "", 0
        for i in range(1, n + 1):
            for j in range(i - 1, max(-1, i - longest - 1), -1):
                piece = letters[j:i]
                if not open_last[i] and piece in self.plain and (j == 0 or open_last[j]) and follows(open_last[j], piece, False):
                    open_last[i], open_count[i], back[i] = piece, open_count[j] + 1, j
                if not closed[i] and piece in self.final and (j == 0 or open_last[j]) and follows(open_last[j], piece, True):
                    closed[i] = open_count[j] + 1
                    if i == n:
                        final, final_at = piece, j
                if open_last[i] and closed[i]:
                    break
        tokens = [final + END] if n else []
        at = final_at
        while at > 0:
            tokens.append(open_last[at])
            at = back[at]
        return closed[1:], tokens[::-1]


@cache
def prefix_counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def letters_of(piece: str) -> str:
    return piece if piece.isascii() and piece.isprintable() else "".join(map(byte_letters().__getitem__, piece.encode()))


class Words:
    """Words between white space are independent, so each distinct one is split once."""

    def __init__(self, path: str):
        self.path, self.tokenizer = path, library(path)
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")

    def parts(self, word: str) -> list[str]:
        """Pre-tokens of a word; special strings come whole."""
        if word.isascii():
            low = word.lower()
            if low.isalpha():
                return [low]
            if low[:-1].isalpha() and low[-1] in ",.;:!?)":
                return [low[:-1], low[-1]]
        out: list[str] = []
        for part in self.special_split.split(word) if "<|" in word else (word,):
            if part in self.special:
                out.append(part)
            elif part:
                out += PIECE.findall(part.lower() if part.isascii() else self.tokenizer.normalizer.normalize_str(part))
        return out

    @staticmethod
    def split(text: bytes) -> list[bytes]:
        """The words of a text; letters' case changes no id, but that of special strings counts."""
        return text.split() if b"<|" in text else text.lower().split()


class Counter(Words):
    """Exact token counts of whole texts, by the prefix program of each distinct piece."""

    def __init__(self, path: str):
        super().__init__(path)
        self.prefix = prefix_counter(path)
        #: The counts of a piece's prefixes, by byte; a special string has its own alone.
        self.pieces = Known(lambda piece: array("I", [1] if piece in self.special else self.prefix.word(letters_of(piece))[0]))
        self.words = Known(lambda word: sum(self.pieces[p][-1] for p in self.parts(word.decode())))
        self.normal = Known(self.tokenizer.normalizer.normalize_str)

    def total(self, pieces: Iterable[str]) -> int:
        return sum(self.pieces[p][-1] for p in pieces)

    def prefix_runs(self, word: str) -> Iterator[tuple[int, int]]:
        """(i, count) of each prefix word[:i], in order.

        Pieces before the cut are summed, and the piece that is cut has its stored counts. Cuts inside a special string,
        and in parts that are not in normal form C, are counted anew from the last piece on.
        """
        done = at = 0
        begin = before = 0  # where the last piece begins, and the count before it
        for part in self.special_split.split(word) if "<|" in word else (word,):
            made = [c.lower() for c in part] if part.isascii() else [self.normal[c] for c in part]
            line = "".join(made)
            special = part in self.special
            if special or not part.isascii() and not (unicodedata.is_normalized("NFC", part) and regex.sub(" +", " ", line) == self.tokenizer.normalizer.normalize_str(part)):
                for i in range(at + 1, at + len(part) + 1):
                    n = before + self.count(word[begin:i].encode())
                    yield i, n
                if special:
                    begin, before = at, done
                done = n
            else:
                ends, i = [*accumulate(map(len, made))], 0
                for found in PIECE.finditer(line):
                    piece, (start, end) = found[0], found.span()
                    while ends[i] <= start:
                        i += 1
                        yield at + i, done
                    if start == (ends[i - 1] if i else 0):
                        begin, before = at + i, done
                    counts, size, seen = self.pieces[piece], 0, start
                    contraction = piece[0] == "'" and piece[1:].isalpha()
                    while i < len(ends) and ends[i] <= end:
                        size += len(line[seen : ends[i]].encode())
                        seen = ends[i]
                        i += 1
                        yield at + i, done + (self.total(PIECE.findall(line[start:seen])) if contraction else counts[size - 1])
                    done += counts[-1]
                for j in range(i, len(part)):
                    yield at + j + 1, done
            at += len(part)

    def kept_inside(self, word: str, limit: int) -> int:
        """Code points of the longest prefix of a word, shorter than it, of at most `limit` tokens; 0 if there is none."""
        return max((i for i, n in self.prefix_runs(word) if n <= limit and i < len(word)), default=0)

    def count(self, text: bytes) -> int:
        return sum(map(self.words.__getitem__, self.split(text)))

    def prefix_counts(self, text: str) -> list[int]:
        """The exact count of the text cut after each code point, for texts that the normalizer leaves at their length."""
        out, done, at = [], 0, 0
        for found in regex.finditer(r"[^\x20\x09-\x0D]+", text):
            out += [done] * (found.start() - at)
            word = found[0]
            for i in range(1, len(word) + 1):
                out.append(done + self.count(word[:i].encode()))
            done, at = out[-1], found.end()
        return out + [done] * (len(text) - at)


@cache
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, path: str, limit: int = 2048, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_tokens, over_limit, kept_chars.

    kept_chars is the longest prefix (code points, at a word's end or inside a word) whose exact count is at most `limit`; it
    comes from the stored prefix counts. Null texts count as empty: 0 bytes, 0 tokens. Equal rows each come out.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            sizes, counts, kept = [], [], []
            for x in batch.column(1).cast(pa.large_binary()):
                raw = x.as_buffer().to_pybytes() if x.is_valid else b""
                n = c.count(raw)
                sizes.append(len(raw))
                counts.append(n)
                kept.append(len(raw.decode()) if n <= limit else budget_prefix(c, raw, limit))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts]), pa.array(kept, pa.int64())], ["doc_id", "n_bytes", "n_tokens", "over_limit", "kept_chars"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(tidy(run), "doc_id long, n_bytes long, n_tokens long, over_limit boolean, kept_chars long")


def budget_prefix(c: Counter, raw: bytes, limit: int) -> int:
    """Code points of the longest prefix of at most `limit` tokens, where the count of a word's prefixes decides inside a word."""
    used = at = 0
    text = raw.decode()
    for found in regex.finditer(r"[^\x20\x09-\x0D]+", text):
        n = c.count(found[0].encode())
        if used + n > limit:
            inside = c.kept_inside(found[0], limit - used)
            return found.start() + inside if inside else at
        used, at = used + n, found.end()
    return len(text)


class Encoder(Words):
    """Ids of whole texts as the library gives them, as bytes of little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        super().__init__(path)
        model = self.tokenizer.model
        of = lambda piece: [self.special[piece]] if piece in self.special else [t.id for t in model.tokenize(letters_of(piece))]
        self.pieces = Known(lambda piece: array("I", of(piece)).tobytes())
        self.words = Known(lambda word: b"".join(map(self.pieces.__getitem__, self.parts(word.decode()))))

    def ids(self, text: str) -> list[int]:
        """By the library's own call."""
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, text: bytes) -> bytes:
        return b"".join(map(self.words.__getitem__, self.split(text)))


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)
