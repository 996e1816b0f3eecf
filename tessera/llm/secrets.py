"""Secrets in texts: fixed patterns, and a linear-chain conditional random field that finds further ones."""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections.abc import Iterator
from functools import cache, lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, runs, slices, tidy

#: The kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
HINTS = (*KEYWORDS, b"key", b"bearer", b"credential", b"auth", b"-----begin")
WRAP = b"\"'`,;:()<>[]{}|."

OUTSIDE, BEGIN, INSIDE = range(3)


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the fixed patterns, code points, by start and kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= 24]
    return [(a, KINDS[k], b) for a, k, b in sorted(found)]


#: What a word's shape, its neighbours and its file tell; names of the weights.
FEATURES = (
    "bias", "digit", "digits>=4", "digits>=third", "digits only", "letters and digits", "upper after lower", "length>=8", "length>=12", "length>=16", "length>=20", "length>=32",
    "hexadecimal>=16", "upper and digits>=12", "inner dash or underscore", "inner slash or plus", "ends with =", "holds = or :", "holds a dot", "looks like a link or an address",
    "hint inside", "is a hint", "known prefix", "previous is a hint", "previous ends with = or :", "hint two before", "next is none", "previous has this shape", "file has a hint", "file has many digits",
)
PREFIXES = (b"AKIA", b"ghp_", b"gho_", b"sk-", b"sk_live_", b"xoxb-", b"xoxp-", b"eyJ", b"AIza", b"glpat-", b"-----BEGIN")
_hint = re.compile(b"|".join(HINTS), re.I)
_only_hint = re.compile(rb"[-_a-z]*(?:" + b"|".join(HINTS) + rb")[-_a-z]*[=:]?", re.I)
_number = re.compile(rb"[0-9][0-9 .,:/+-]*")
_hexadecimal = re.compile(rb"[0-9a-fA-F]{16,}")
_loud = re.compile(rb"(?=.*[0-9])[A-Z0-9]{12,}")
_mixed = re.compile(rb"[a-z][A-Z]|[0-9][a-zA-Z][0-9]")
_long = re.compile(rb"[A-Za-z0-9+/_=-]{20,}")


def features(words: list[bytes], i: int, hinted: bool, numeric: bool) -> list[int]:
    """Numbers of the features that word i of a text has."""
    core = words[i].strip(WRAP)
    digits = sum(48 <= c < 58 for c in core)
    letters = sum(65 <= c < 91 or 97 <= c < 123 for c in core)
    before = words[i - 1] if i else b""
    two = words[i - 2] if i > 1 else b""
    n = len(core)
    on = (
        True, digits > 0, digits >= 4, digits * 3 >= n > 0, bool(_number.fullmatch(core)), digits > 0 and letters > 0, bool(_mixed.search(core)), n >= 8, n >= 12, n >= 16, n >= 20, n >= 32,
        bool(_hexadecimal.fullmatch(core)), bool(_loud.fullmatch(core)), any(c in b"-_" for c in core[1:-1]), any(c in b"/+" for c in core[1:-1]), core.endswith(b"="), any(c in b"=:" for c in core), b"." in core, b"://" in core or b"@" in core or core.startswith(b"www."),
        bool(_hint.search(core)), n <= 64 and bool(_only_hint.fullmatch(core)), core.startswith(PREFIXES), bool(_hint.search(before)), before.endswith((b"=", b":")), bool(_hint.search(two)), i + 1 == len(words), bool(_long.fullmatch(core)) and bool(_long.fullmatch(before.strip(WRAP))), hinted, numeric,
    )
    return [k for k, x in enumerate(on) if x]


def example(rng: random.Random) -> tuple[list[bytes], list[int]]:
    """A made-up line with its tags: prose and harmless numbers, and in half of the cases a secret."""
    pick = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    syllables = ("an", "the", "tion", "er", "is", "on", "re", "ing", "eau", "sch", "ción", "wh", "ou")
    prose = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 5))) + rng.choice(("", "", "", ",", "."))
    harmless = (
        lambda: pick(string.digits, rng.randint(1, 6)), lambda: pick(string.digits, rng.randint(13, 19)), lambda: f"{rng.randint(1, 28):02}/{rng.randint(1, 12):02}/{rng.randint(1990, 2030)}", lambda: f"{rng.randint(1, 255)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}.{rng.randint(1, 255)}",
        lambda: f"+{rng.randint(1, 99)}-{pick(string.digits, 3)}-{pick(string.digits, 7)}", lambda: f"https://{prose().strip('.,')}.example/{pick(string.ascii_lowercase, 8)}?id={pick(string.digits, 6)}", lambda: f"{prose().strip('.,')}{rng.randint(1, 99)}@example.org",
        lambda: f"v{rng.randint(1, 9)}.{rng.randint(0, 30)}", lambda: f"{rng.randint(1, 999)}.{rng.randint(10, 99)}", lambda: prose() + prose() + prose() + prose() + prose(), lambda: pick(string.ascii_uppercase, rng.randint(2, 9)), lambda: f"{rng.choice(('Q', 'Section', 'item-'))}{rng.randint(1, 40)}", lambda: "the-" + pick(string.ascii_lowercase, 9) + "-" + pick(string.ascii_lowercase, 12), lambda: prose().title() + prose().strip(".,").title(), lambda: rng.choice(("Bearer", "bearer", "keyboard", "authority", "author:", "monkey", "tokens")),
        lambda: f"{pick(string.hexdigits[:16], 8)}-{pick(string.hexdigits[:16], 4)}-{pick(string.hexdigits[:16], 4)}-{pick(string.hexdigits[:16], 12)}", lambda: rng.choice(("token", "key", "secret", "password", "keys")),
    )
    alnum = string.ascii_letters + string.digits
    mixed_case = lambda: "".join(pick(string.ascii_uppercase, 1) + pick(string.ascii_lowercase, rng.randint(2, 6)) for _ in range(rng.randint(3, 5)))
    secret = (
        lambda: "ghp_" + pick(alnum, 36), lambda: "sk-" + pick(alnum, rng.randint(24, 48)), lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16), lambda: pick(string.hexdigits[:16], rng.choice((32, 40, 64))), lambda: "eyJ" + pick(alnum, 30) + "." + pick(alnum + "-_", 60) + "." + pick(alnum + "-_", 43),
        lambda: pick(alnum + "+/", rng.randint(28, 64)) + rng.choice(("", "=", "==")), lambda: "xoxb-" + pick(string.digits, 11) + "-" + pick(alnum, 24),
    )
    words: list[str] = []
    tags: list[int] = []

    def put(tag: int, *more: str) -> None:
        words.extend(more)
        tags.extend([tag] * len(more))

    for _ in range(rng.randint(2, 10)):
        put(OUTSIDE, rng.choice(harmless)() if rng.random() < 0.35 else prose())
    if rng.random() < 0.5:
        quote = rng.choice(("", "", '"', "'"))
        kind = rng.random()
        if kind < 0.35:
            put(OUTSIDE, rng.choice(("password", "passwd", "secret", "token", "api_key", "Authorization", "client_secret", "access key", "SECRET_KEY")) + rng.choice((":", "=", " =", " :")))
            words[-1:], tags[-1:] = words[-1].split(" "), [OUTSIDE] * len(words[-1].split(" "))
            if words[-1] == "":
                words.pop(), tags.pop()
            short = lambda: mixed_case() if rng.random() < 0.3 else pick(alnum + "!@$%", rng.randint(8, 20)) + pick(string.digits, 2)
            put(BEGIN, quote + (rng.choice(secret)() if rng.random() < 0.6 else short()) + quote)
        elif kind < 0.55:
            put(OUTSIDE, *rng.choice((("Bearer",), ("Authorization:", "Bearer"), ("bearer",))))
            put(BEGIN, mixed_case() if rng.random() < 0.3 else rng.choice(secret)())
        elif kind < 0.7:
            put(OUTSIDE, "-----BEGIN", *rng.choice(((), ("RSA",), ("EC",))), "PRIVATE", "KEY-----")
            put(BEGIN, pick(alnum + "+/", 64))
            put(INSIDE, *(pick(alnum + "+/", 64) for _ in range(rng.randint(0, 4))))
            put(INSIDE, pick(string.ascii_letters if rng.random() < 0.5 else alnum, rng.randint(20, 60)) + rng.choice(("", "=")))
            put(OUTSIDE, *rng.choice(((), ("-----END", "PRIVATE", "KEY-----"))))
        else:
            put(BEGIN, quote + rng.choice(secret)() + quote)
    for _ in range(rng.randint(1, 8)):
        put(OUTSIDE, rng.choice(harmless)() if rng.random() < 0.35 else prose())
    return [w.encode() for w in words], tags


def file_features(words: list[bytes]) -> tuple[bool, bool]:
    """Whether a text has a hint in some word, and a digit in over a fifth of its words."""
    return any(_hint.search(w) for w in words), 5 * sum(any(48 <= c < 58 for c in w) for w in words) > len(words)


@cache
def trained(examples: int = 1500, seed: int = 11, rounds: int = 300, ridge: float = 2e-4, close: float = 2e-3) -> tuple[np.ndarray, np.ndarray]:
    """(weights[feature, tag], moves[tag, tag]) that maximise the tags' conditional likelihood on made-up lines.

    Gradient steps (Adam) on expected minus observed counts, which the forward-backward recursion gives for all lines at
    once, until no component of the gradient is over `close`, or for `rounds` steps.
    """
    rng = random.Random(seed)
    lines = sorted((example(rng) for _ in range(examples)), key=lambda x: -len(x[0]))
    longest = len(lines[0][0])
    x = np.zeros((longest, examples, len(FEATURES)))
    y = np.zeros((longest, examples), int)
    there = np.zeros((longest, examples), bool)
    for n, (words, tags) in enumerate(lines):
        hinted, numeric = file_features(words)
        for i, tag in enumerate(tags):
            x[i, n, features(words, i, hinted, numeric)] = 1
            y[i, n], there[i, n] = tag, True
    flat = x[there]
    observed = flat.T @ np.eye(3)[y[there]]
    observed_moves = np.einsum("na,nb->ab", np.eye(3)[y[:-1][there[1:]]], np.eye(3)[y[1:][there[1:]]])
    held = there.sum(axis=1)  # lines are in order of length, so those that have a word i are the first ones
    weights, moves = np.zeros((len(FEATURES), 3)), np.zeros((3, 3))
    moves[OUTSIDE, INSIDE] = -4.0
    state = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(moves), np.zeros_like(moves)]
    for step in range(1, rounds + 1):
        # Scaled recursions on probabilities; each word's scores are shifted by their maximum.
        emit = np.zeros((longest, examples, 3))
        score = flat @ weights
        emit[there] = np.exp(score - score.max(axis=1, keepdims=True))
        move = np.exp(moves)
        forward, backward, scale = np.zeros_like(emit), np.ones_like(emit), np.ones((longest, examples, 1))
        forward[0] = emit[0]
        for i in range(longest):
            k = held[i]
            if i:
                forward[i, :k] = (forward[i - 1, :k] @ move) * emit[i, :k]
            scale[i, :k] = forward[i, :k].sum(axis=1, keepdims=True)
            forward[i, :k] /= scale[i, :k]
        for i in range(longest - 2, -1, -1):
            k = held[i + 1]
            backward[i, :k] = ((backward[i + 1, :k] * emit[i + 1, :k]) @ move.T) / scale[i + 1, :k]
        tag = (forward * backward)[there]
        after = (backward[1:] * emit[1:] / scale[1:])[there[1:]]
        pair = move * (forward[:-1][there[1:]].T @ after)
        grads = [(observed - flat.T @ tag) / examples - ridge * weights, (observed_moves - pair) / examples - ridge * moves]
        if max(np.abs(g).max() for g in grads) < close:
            break
        for k, (value, grad) in enumerate(zip((weights, moves), grads, strict=True)):
            state[2 * k] = 0.9 * state[2 * k] + 0.1 * grad
            state[2 * k + 1] = 0.99 * state[2 * k + 1] + 0.01 * grad * grad
            value += 0.2 * (state[2 * k] / (1 - 0.9**step)) / (np.sqrt(state[2 * k + 1] / (1 - 0.99**step)) + 1e-8)
    return weights, moves


def viterbi(emit: np.ndarray | list, moves: np.ndarray) -> list[int]:
    """The best tags of a chain; ties to the lower tag."""
    (m00, m01, m02), (m10, m11, m12), (m20, m21, m22) = np.asarray(moves).tolist()
    emit = emit.tolist() if isinstance(emit, np.ndarray) else emit
    a, b, c = emit[0]
    back: list[tuple[int, int, int]] = []
    for e, f, g in emit[1:]:
        x, i = a + m00, 0
        if b + m10 > x:
            x, i = b + m10, 1
        if c + m20 > x:
            x, i = c + m20, 2
        y, j = a + m01, 0
        if b + m11 > y:
            y, j = b + m11, 1
        if c + m21 > y:
            y, j = c + m21, 2
        z, k = a + m02, 0
        if b + m12 > z:
            z, k = b + m12, 1
        if c + m22 > z:
            z, k = c + m22, 2
        back.append((i, j, k))
        a, b, c = x + e, y + f, z + g
    tag = 0 if a >= b and a >= c else 1 if b >= c else 2
    tags = [tag]
    for held in reversed(back):
        tag = held[tag]
        tags.append(tag)
    return tags[::-1]


#: Features that an ordinary word may have, by number: all others are off.
ORDINARY = [FEATURES.index(x) for x in ("length>=8", "length>=12", "next is none", "file has a hint", "file has many digits")]


def proven_reach(weights: np.ndarray, moves: np.ndarray, most: int = 3) -> int | None:
    """The least r for which a word with r ordinary words on either side (fewer at the ends of a text), itself ordinary, is outside in every best chain; None if there is none up to `most`.

    Shown by exchange: whatever its tag, those of its neighbours and those beyond, setting it and some of the words
    beside it to outside gains, even if each of them is the ordinary word that is least clearly outside.
    """
    gain = np.full(3, np.inf)
    for on in product((False, True), repeat=len(ORDINARY)):
        e = weights[[0, *(k for k, x in zip(ORDINARY, on, strict=True) if x)]].sum(axis=0)
        gain = np.minimum(gain, e[OUTSIDE] - e)
    m = np.zeros((4, 4))  # tag 3: no word
    m[:3, :3] = moves

    def proven(left: int, right: int, r: int) -> bool:
        n = left + 1 + right
        for tags in product(range(3), repeat=n):
            if tags[left] == OUTSIDE:
                continue
            for before, after in product(range(3) if left == r else (3,), range(3) if right == r else (3,)):
                chain = [before, *tags, after]
                for a, b in product(range(1, left + 2), range(left + 2, n + 2)):
                    mine = [*chain[:a], *([OUTSIDE] * (b - a)), *chain[b:]]
                    if sum(gain[t] for t in chain[a:b]) + sum(m[x, y] for x, y in zip(mine[a - 1 : b], mine[a : b + 1], strict=True)) - sum(m[x, y] for x, y in zip(chain[a - 1 : b], chain[a : b + 1], strict=True)) > 1e-9:
                        break
                else:
                    return False
        return True

    return next((r for r in range(most + 1) if all(proven(x, y, r) for x in range(r + 1) for y in range(r + 1) if r in (x, y) or (x, y) == (0, 0))), None)


@cache
def model() -> tuple[np.ndarray, np.ndarray, int | None]:
    weights, moves = trained()
    return weights, moves, proven_reach(weights, moves)


class Tagger:
    """Viterbi decoding of whole texts. Words that are proven to be outside are not looked at, which splits a text into chains."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray, reach: int | None = None):
        self.weights, self.moves, self.reach = weights, moves, reach
        self.emit = lru_cache(1 << 16)(lambda on: tuple(weights[list(on)].sum(axis=0).tolist()))

    def spans(self, words: list[bytes], look: list[int], hinted: bool, numeric: bool, odd: set[int] | None = None) -> list[tuple[int, int]]:
        """(first word, word after the last) of the secrets; look: the words that may be other than outside, in order; odd: those that are not ordinary (None: unknown)."""
        found: list[tuple[int, int]] = []
        at, n = 0, len(words)
        o_moves, to_o = self.moves[OUTSIDE].tolist(), self.moves[:, OUTSIDE].tolist()
        rest = tuple(k for k, x in zip(ORDINARY[3:], (hinted, numeric), strict=True) if x)
        while at < len(look):
            end = at + 1
            while end < len(look) and look[end] == look[end - 1] + 1:
                end += 1
            chain = []
            for i in look[at:end]:
                if odd is None or i in odd:
                    on = tuple(features(words, i, hinted, numeric))
                else:
                    size = len(words[i].strip(WRAP))
                    on = (0, *ORDINARY[: (size >= 8) + (size >= 12)], *(ORDINARY[2:3] if i + 1 == n else ()), *rest)
                chain.append(self.emit(on))
            first, last = look[at], look[end - 1]
            if first > 0:
                chain[0] = tuple(x + y for x, y in zip(chain[0], o_moves, strict=True))
            if last + 1 < n:
                chain[-1] = tuple(x + y for x, y in zip(chain[-1], to_o, strict=True))
            for k, tag in enumerate(viterbi(chain, self.moves), first):
                if tag == INSIDE and found and found[-1][1] == k:
                    found[-1] = (found[-1][0], k + 1)
                elif tag != OUTSIDE:
                    found.append((k, k + 1))
            at = end
        return found


DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
HEXADECIMAL = np.zeros(256, bool)
HEXADECIMAL[[*range(48, 58), *range(97, 103)]] = True
UPPER, LOWER, MARK, STOP = (np.zeros(256, bool) for _ in range(4))
UPPER[65:91] = LOWER[97:123] = True
MARK[list(b"=/+_-@")] = True
STOP[list(b".:=")] = True


def odd_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray, hints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words that have a digit, words that are not ordinary) of texts joined; hints: words with a hint inside.

    An ordinary word has under 16 bytes, no digit, none of MARK, no upper-case letter after another letter, no point or colon before
    its last byte, no hint in it or in the two words before, and none before it that ends with = or a colon.
    """
    space = SPACE[data]
    nothing = np.zeros(1, bool)
    upper = UPPER[data]
    inner = STOP[data] & np.concatenate([~space[1:], nothing])
    cased = upper & np.concatenate([nothing, (upper | LOWER[data])[:-1]])
    strange = DIGIT[data] | MARK[data] | inner | cased
    count = np.concatenate([[0], np.cumsum(strange, dtype=np.int32)])
    digits = np.concatenate([[0], np.cumsum(DIGIT[data], dtype=np.int32)])
    has_digit = digits[ends] > digits[starts]
    same = np.concatenate([nothing, doc[1:] == doc[:-1]])
    cue = np.concatenate([nothing, STOP[data[ends[:-1] - 1]]])
    one = np.concatenate([nothing, hints[:-1]])
    two = np.concatenate([nothing, one[:-1] & same[:-1]])
    return has_digit, (count[ends] > count[starts]) | (ends - starts >= 16) | hints | same & (cue | one | two)


def scan_rows(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, tagger: Tagger) -> list[list[tuple[int, str, int]]]:
    """All spans of each text, by start and kind; CRF spans inside a base span are dropped."""
    n = rows.num_rows
    out: list[list[tuple[int, str, int]]] = [[] for _ in range(n)]
    if not len(data):
        return out
    low, raw = data.tobytes().lower(), data.tobytes()
    doc_of = lambda x: np.searchsorted(offsets, x, "right") - 1
    places: set[int] = set()
    for hint in HINTS:
        at = low.find(hint)
        while at >= 0:
            places.add(at)
            at = low.find(hint, at + 1)
    near = np.array(sorted(places), np.int64)  # where hints may begin
    ids = np.concatenate([[0], np.cumsum(HEXADECIMAL[data], dtype=np.int32)])
    long_hex = np.flatnonzero(ids[24:] - ids[:-24] == 24) if len(ids) > 24 else np.zeros(0, np.int64)
    access, at = [], raw.find(b"AKIA")
    while at >= 0:
        access.append(at)
        at = raw.find(b"AKIA", at + 1)
    starts, ends, doc = runs(~SPACE[data], offsets)
    base = set(doc_of(np.concatenate([near, long_hex, np.array(access, np.int64)])).tolist())
    if not len(starts):
        return out
    # Texts stand side by side here: a hint counts in the word that holds the whole of it.
    hint_word = np.searchsorted(starts, near, "right") - 1
    hints = np.zeros(len(starts), bool)
    for k in np.unique(hint_word).tolist():
        hints[k] = bool(_hint.search(raw[starts[k] : ends[k]]))
    hinted = np.zeros(n, bool)
    hinted[doc[hints]] = True
    has_digit, odd = odd_words(data, starts, ends, doc, hints)
    first = np.searchsorted(doc, np.arange(n + 1))
    per_doc = np.concatenate([[0], np.cumsum(has_digit)])
    numeric = 5 * (per_doc[first[1:]] - per_doc[first[:-1]]) > first[1:] - first[:-1]
    look = odd.copy() if tagger.reach is not None else np.ones(len(odd), bool)
    for k in range(1, (tagger.reach or 0) + 1):
        apart = doc[k:] != doc[:-k]
        look[k:] |= odd[:-k] & ~apart
        look[:-k] |= odd[k:] & ~apart
    looked = np.flatnonzero(look)
    for d in sorted(base | set(doc[odd].tolist() if tagger.reach is not None else doc.tolist())):
        body = raw[offsets[d] : offsets[d + 1]]
        found = base_spans(body.decode()) if d in base else []
        own = looked[np.searchsorted(looked, first[d]) : np.searchsorted(looked, first[d + 1])]
        more: list[tuple[int, str, int]] = []
        if len(own):
            words = _Words(raw, starts, ends, int(first[d]), int(first[d + 1]))
            for a, b in tagger.spans(words, (own - first[d]).tolist(), bool(hinted[d]), bool(numeric[d]), set((own[odd[own]] - first[d]).tolist())):
                lo, hi = int(starts[first[d] + a]), int(ends[first[d] + b - 1])
                piece = raw[lo:hi]
                lo += len(piece) - len(piece.lstrip(WRAP))
                hi -= len(piece) - len(piece.rstrip(WRAP))
                if hi > lo:
                    begin = len(raw[offsets[d] : lo].decode())
                    more.append((begin, "crf", begin + len(raw[lo:hi].decode())))
        kept = [x for x in more if not any(a <= x[0] and x[2] <= b for a, _, b in found)]
        out[d] = sorted(found + kept, key=lambda x: (x[0], KINDS.index(x[1])))
    return out


class _Words:
    """The words of one text, cut out when asked for."""

    def __init__(self, raw: bytes, starts: np.ndarray, ends: np.ndarray, first: int, last: int):
        self.raw, self.starts, self.ends, self.first, self.n = raw, starts, ends, first, last - first

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> bytes:
        return self.raw[self.starts[self.first + i] : self.ends[self.first + i]]


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, kind, b in spans)


def redacted(text: str, spans: list[tuple[int, str, int]], mark: str = "[secret]") -> str:
    """The text with each run of overlapping spans replaced by `mark`."""
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]]) if spans else text


def scan(docs: DataFrame, text: str = "text", id_col: str = "doc_id", mark: str = "[secret]") -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_crf, redacted (the text without its secrets).

    Null texts count as empty: no spans, redacted empty. Equal rows each come out; an empty table gives no rows.
    """
    fitted = model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(*fitted)
        for batch in batches:
            for rows, data, offsets in slices(batch, "text"):
                found = scan_rows(rows, data, offsets, tagger)
                texts = rows.column(1)
                body = [redacted(texts[i].as_py(), s, mark) if s else None for i, s in enumerate(found)]
                clean = pa.array([x is None for x in body])
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0),
                        *(pa.array([sum(x[1] == kind for x in s) for s in found], pa.int64()) for kind in KINDS[:3]),
                        pa.array([hashlib.sha256(joined([x for x in s if x[1] != "crf"]).encode()).hexdigest() for s in found]),
                        pa.array([joined(s) for s in found]),
                        pa.array([sum(x[1] == "crf" for x in s) for s in found], pa.int64()),
                        pa.compute.if_else(clean, texts, pa.array(body, pa.string())),
                    ],
                    ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_crf", "redacted"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_crf long, redacted string")


def replaced(docs: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """docs with each secret in the text replaced by `mark`; null texts become empty."""
    fitted = model()
    at, names = docs.columns.index(text), [f"c{i}" for i in range(len(docs.columns))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(*fitted)
        for batch in batches:
            filled = batch.set_column(at, names[at], pa.compute.fill_null(batch.column(at), ""))
            for rows, data, offsets in slices(filled, names[at]):
                texts = rows.column(at)
                body = [redacted(texts[i].as_py(), s, mark) if s else None for i, s in enumerate(scan_rows(rows, data, offsets, tagger))]
                yield rows.set_column(at, names[at], pa.compute.if_else(pa.array([x is None for x in body]), texts, pa.array(body, pa.string())))

    given = docs.withColumn(text, F.col(text).cast("string"))
    kinds = ", ".join(f"{n} {given.schema[c].dataType.simpleString()}" for n, c in zip(names, docs.columns, strict=True))
    renamed = given.select(*(F.col(c).alias(n) for c, n in zip(docs.columns, names, strict=True)))
    return renamed.mapInArrow(tidy(run), kinds).toDF(*docs.columns)
