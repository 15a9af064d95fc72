"""Secret scans: base patterns, and a linear-chain conditional random field (CRF) that adds spans they miss."""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import words
from corpusloom.session import extended, prepare, stash

#: Base patterns over UTF-8 bytes, in the order in which kinds are listed.
ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]{14,}")
#: An assigned value as a training example: it goes on to a blank, quote, comma, semicolon, bracket or next URL parameter.
VALUE = re.compile(rb"""(?:(?!&[A-Za-z0-9_.-]+=)[^\s"'`,;<>(){}\[\]])+""")
#: Padding of base64 after a token.
PADDING = re.compile(rb"={1,2}(?![A-Za-z0-9+/_.=\x80-\xff-])")
KINDS = ("assign", "access", "hex", "crf")
ASSIGN_LEAST, HEX_LEAST = 12, 16

#: Distinct windows the CRF learns from at most (a third each: values of base spans as they stand; values without their
#: key word and made-up secrets; neither; each taken by hash), tokens of a training window, windows of one document at
#: most, and steps of the optimiser.
SAMPLE_ROWS, WINDOW, WINDOWS_EACH, STEPS = 4500, 40, 4, 80
#: One in so many distinct texts is never learned from, so that ``measure`` can tell what the CRF finds there.
HELD_OUT = 5

#: Words near which a value is often a secret.
KEYWORDS = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "key", "auth", "bearer", "credential", "private")

BEGIN, INSIDE, OUTSIDE = 0, 1, 2
#: Labels that may not follow: an inside needs a begin or an inside before it.
FORBIDDEN = -1e6


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


LOWERCASE, UPPERCASE, DIGIT = _table("abcdefghijklmnopqrstuvwxyz"), _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("0123456789")
HEX = _table("0123456789abcdef")
HIGH = np.arange(256) >= 128
SYMBOL = _table("+/_.-")
BREAK = ~(LOWERCASE | UPPERCASE | DIGIT | HIGH | SYMBOL)
ASSIGNS, QUOTE = _table("=:"), _table("\"'")
#: Bytes that end a value of several tokens.
APART = _table("\t\n\v\f\r \"'`,;<>(){}[]")
CLASS = (LOWERCASE * 1 + UPPERCASE * 2 + DIGIT * 3 + HIGH * 1 + SYMBOL * 4).astype(np.uint8)

#: Sizes of the token features, in the order in which ``features`` gives them.
SIZES = (8, 10, 5, 6, 4, 2, 2, 2, 2, 2, 3, 3, 10, 2)


def _keyword(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Tokens that are a keyword in either case, compared by their first eight bytes and length."""
    code = np.zeros(len(starts), np.uint64)
    for k in range(8):
        byte = words.LOWER[data[np.minimum(starts + k, len(data) - 1)]].astype(np.uint64)
        code = code << np.uint64(8) | np.where(sizes > k, byte, np.uint64(0))
    out = np.zeros(len(starts), bool)
    for word in KEYWORDS:
        out |= (code == np.uint64(int.from_bytes(word.encode()[:8].ljust(8, b"\0"), "big"))) & (sizes == len(word))
    return out


@dataclass
class Tokens:
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    features: list[np.ndarray]


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    """Tokens (runs of letters, digits, ``+/_.-`` and non-ASCII bytes) with their feature numbers.

    Shape: length, composition, shares of digits and capitals, changes between letter and digit classes. Neighbours: a keyword as the
    token before or two before, an assignment sign or quote before, the composition of the next token, no blank, quote
    or bracket since the token before. File: how common digits and assignment signs are in the document.
    """
    starts, ends, first = words.split(data, offsets, BREAK)
    if not len(starts):
        return Tokens(starts, ends, first, [np.zeros(0, np.int64)] * len(SIZES))
    sizes = ends - starts
    count = lambda flags: np.add.reduceat(flags[data].astype(np.int32), starts)  # noqa: E731  gaps between tokens have none
    lower, upper, digit, high, symbol = map(count, (LOWERCASE, UPPERCASE, DIGIT, HIGH, SYMBOL))
    hexes = count(HEX)
    kinds = CLASS[data]
    change = np.zeros(len(data), np.int32)
    change[1:] = (kinds[1:] != kinds[:-1]) & (kinds[1:] > 0) & (kinds[:-1] > 0)
    change[starts] = 0
    changes = np.add.reduceat(change, starts)
    letters = lower + upper + high
    composition = np.select(
        [
            digit == sizes,
            (hexes == sizes) & (digit > 0),
            (lower + high == sizes),
            (upper == 1) & (digit + symbol == 0),
            upper == sizes,
            (upper > 0) & (digit > 0) & (lower == 0) & (symbol == 0),
            (upper > 0) & (digit > 0) & (lower > 0),
            (digit > 0) & (letters > 0) & (symbol == 0),
            (symbol > 0) & (digit > 0),
        ],
        range(9),
        9,
    )
    head = np.zeros(len(starts), bool)
    head[first[:-1][first[:-1] < len(starts)]] = True
    keyword = _keyword(data, starts, sizes)
    before = np.concatenate([[False], keyword[:-1]]) & ~head
    before2 = np.concatenate([[False], before[:-1]]) & ~head
    near = lambda flags: np.any([flags[data[np.maximum(starts - k, 0)]] & (starts >= k) & (starts - k >= left) for k in (1, 2, 3)], axis=0)
    left = np.concatenate([[0], ends[:-1]])
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    left = np.maximum(left, offsets[:-1][owner])
    parted = np.concatenate([[0], np.cumsum(APART[data])])
    joined = (parted[starts] == parted[left]) & ~head
    following = np.append(composition[1:], 9)
    following[np.append(head[1:], True)] = 9
    total = np.maximum(np.diff(offsets), 1)
    full = np.flatnonzero(np.diff(offsets))
    per_doc = np.zeros((2, len(total)))
    for row, flags in enumerate((DIGIT, ASSIGNS)):
        per_doc[row, full] = np.add.reduceat(flags[data].astype(np.int32), offsets[:-1][full])
    file_digits = np.digitize(per_doc[0] / total, [0.01, 0.1])[owner]
    file_assigns = np.digitize(per_doc[1] / total, [0.0005, 0.01])[owner]
    found = [
        np.digitize(sizes, [4, 8, 12, 16, 20, 28, 40]),
        composition,
        np.digitize(digit / sizes, [0.01, 0.25, 0.6, 0.99]),
        np.digitize(changes, [1, 2, 4, 8, 16]),
        np.digitize(upper / sizes, [0.01, 0.3, 0.7]),
        before.astype(np.int64),
        before2.astype(np.int64),
        near(ASSIGNS).astype(np.int64),
        near(QUOTE).astype(np.int64),
        keyword.astype(np.int64),
        file_digits,
        file_assigns,
        following,
        joined.astype(np.int64),
    ]
    return Tokens(starts, ends, first, found)


@dataclass
class Crf:
    """weights: for each feature [value, label]; moves: [from, to] with forbidden ones set."""

    weights: list[np.ndarray]
    moves: np.ndarray

    def scores(self, features: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(features[0]), 3))
        for w, values in zip(self.weights, features):
            out += w[values]
        return out


def viterbi(scores: np.ndarray, moves: np.ndarray) -> list[int]:
    """The best labels of one run of tokens whose neighbours on both sides are outside (or the text's ends)."""
    best, back = [scores[0][y] + moves[OUTSIDE][y] for y in range(3)], []
    for s in scores[1:]:
        step = [max(range(3), key=lambda x: best[x] + moves[x][y]) for y in range(3)]
        back.append(step)
        best = [best[step[y]] + moves[step[y]][y] + s[y] for y in range(3)]
    labels = [max(range(3), key=lambda y: best[y] + moves[y][OUTSIDE])]
    for step in reversed(back):
        labels.append(step[labels[-1]])
    return labels[::-1]


def decode(model: Crf, tokens: Tokens) -> list[tuple[int, int]]:
    """Token ranges [a, b) tagged as secrets, the same as by Viterbi over each whole document.

    A token is outside on every best path where its outside score leads by more than any change of its neighbours can
    make up for: three moves, and a following inside that would turn into a begin. Viterbi runs between such tokens.
    """
    n = len(tokens.starts)
    if not n:
        return []
    scores = model.scores(tokens.features)
    allowed = model.moves[model.moves > FORBIDDEN / 2]
    reach = 3 * (allowed.max() - allowed.min())
    turn = np.maximum(0, np.append(scores[1:, INSIDE] - scores[1:, BEGIN], 0))
    sure = scores[:, OUTSIDE] - np.maximum(scores[:, BEGIN], scores[:, INSIDE]) > reach + turn
    open_ = np.flatnonzero(~sure)
    if not len(open_):
        return []
    head = np.zeros(n + 1, bool)
    head[tokens.first] = True
    cut = np.flatnonzero((np.diff(open_) > 1) | head[open_[1:]]) + 1
    moves, out = model.moves.tolist(), []
    for run in np.split(open_, cut):
        begin = None
        for t, label in zip(run.tolist(), viterbi(scores[run].tolist(), moves)):
            if begin is not None and label != INSIDE:
                out.append((begin, t))
                begin = None
            if label == BEGIN:
                begin = t
        if begin is not None:
            out.append((begin, int(run[-1]) + 1))
    return out


def base_spans(data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """For each document its base spans (byte start, kind, byte end), by start and kind."""
    raw = memoryview(data)
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(offsets) - 1)]
    signs = np.concatenate([[0], np.cumsum(ASSIGNS[data])])[offsets]
    for d in np.flatnonzero(signs[1:] > signs[:-1]).tolist():
        for m in ASSIGN.finditer(raw, int(offsets[d]), int(offsets[d + 1])):
            if m.end(1) - m.start(1) >= ASSIGN_LEAST:
                out[d].append((m.start() - int(offsets[d]), 0, m.end() - int(offsets[d])))
    for m in ACCESS.finditer(raw):
        d = int(np.searchsorted(offsets, m.start(), "right")) - 1
        if m.end() <= offsets[d + 1]:
            out[d].append((m.start() - int(offsets[d]), 1, m.end() - int(offsets[d])))
        else:  # the run goes on into the next document: judge each document's own part
            for e in range(d, int(np.searchsorted(offsets, m.end(), "left"))):
                for x in ACCESS.finditer(raw, max(m.start(), int(offsets[e])), min(m.end(), int(offsets[e + 1]))):
                    out[e].append((x.start() - int(offsets[e]), 1, x.end() - int(offsets[e])))
    starts, ends, first = words.split(data, offsets, ~HEX)
    long_ = np.flatnonzero(ends - starts >= HEX_LEAST)
    for d, a, b in zip((np.searchsorted(first, long_, "right") - 1).tolist(), starts[long_].tolist(), ends[long_].tolist()):
        out[d].append((a - int(offsets[d]), 2, b - int(offsets[d])))
    return [sorted(x) for x in out]


def examples(data: np.ndarray, offsets: np.ndarray, spans: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int]]]:
    """For each document the values of its base spans that the CRF learns from, as disjoint byte ranges [start, end) of
    ``data``. Plain numbers are no examples of secrets, nor are values without a token."""
    raw = memoryview(data)
    out: list[list[tuple[int, int]]] = [[] for _ in spans]
    for d, own in enumerate(spans):
        found = []
        for a, kind, b in own:
            low, high = int(offsets[d]) + a, int(offsets[d]) + b
            if kind == 2 and bytes(raw[low:high]).isdigit():
                continue
            if kind == 0:
                low = ASSIGN.match(raw, low, high).start(1)
                high = max(high, VALUE.match(raw, low, int(offsets[d + 1])).end())
            if not BREAK[data[low:high]].all():
                found.append((low, high))
        for low, high in sorted(found):
            if out[d] and low < out[d][-1][1]:
                out[d][-1] = out[d][-1][0], max(high, out[d][-1][1])
            else:
                out[d].append((low, high))
    return out


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whether a text holds examples, and its key; texts without a token are left out."""
    for batch in batches:
        data, offsets = words.buffer(batch["text"])
        hits, kept = [], []
        for i, j in words.spans_of_documents(offsets):
            part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            hits += [bool(own) for own in examples(part, at, base_spans(part, at))]
            kept.append(np.diff(np.concatenate([[0], np.cumsum(~BREAK[part])])[at]) > 0)
        keep = pa.array(np.concatenate([np.zeros(0, bool), *kept]))
        yield pa.record_batch({"hit": pa.array(hits, pa.bool_()).filter(keep), "key": batch["key"].filter(keep)})


_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: What introduces an assigned value, and what may stand there instead when the CRF is to do without.
LEAD = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?\Z""")
PHRASES = ("", "is ", "use ", "value ", "(", "with ", "Bearer ", "key ", "pwd ", "auth: ", "credential ", '"', "x=", "private key ", "see ")
SIGNED = ("pwd: ", "auth=", "key = ", "token: ", "password=", "secret: ", "credential: ")


def secret(rng: random.Random) -> tuple[str, str, str]:
    """A made-up secret: name of its shape, what introduces it, the value."""
    some = lambda chars, least, most: "".join(rng.choice(chars) for _ in range(rng.randint(least, most)))
    mixed = _LOWER + _UPPER + _DIGITS
    shape = rng.choice(("mixed", "base64", "capitals", "prefixed", "hex", "groups", "short", "joined"))
    value = {
        "mixed": lambda: some(mixed, 18, 42) + some(_DIGITS, 1, 2),
        "base64": lambda: some(mixed + "+/", 20, 44) + some(_DIGITS, 1, 1) + "=" * rng.randint(0, 2),
        "capitals": lambda: some(_UPPER + _DIGITS, 14, 32) + some(_DIGITS, 1, 2),
        "prefixed": lambda: some(_LOWER, 2, 4) + rng.choice("_-") + some(mixed, 18, 36) + some(_DIGITS, 1, 2),
        "hex": lambda: some("0123456789ABCDEF", 28, 44),
        "groups": lambda: "-".join(some(_UPPER + _DIGITS, 5, 5) for _ in range(rng.randint(4, 6))),
        "short": lambda: some(_LOWER + _UPPER, 4, 5) + some(_DIGITS, 2, 3) + some(_UPPER, 2, 3),
        "joined": lambda: rng.choice(":@&!").join(some(mixed, 10, 16) + some(_DIGITS, 1, 1) for _ in range(rng.randint(2, 3))),
    }[shape]()
    return shape, rng.choice(SIGNED if shape == "short" else PHRASES), value


def harmless(rng: random.Random) -> str:
    """Something that looks a little like a secret, or stands where one might, and is none."""
    some = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    word = lambda least=3, most=9: some(_LOWER, rng.randint(least, most))
    number = lambda most: str(rng.randint(1, most))
    return rng.choice(
        (
            lambda: some(_DIGITS, rng.randint(6, 19)),
            lambda: f"{rng.randint(1900, 2099)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}T{rng.randint(0, 23):02}:{rng.randint(0, 59):02}:00Z",
            lambda: ".".join(number(255) for _ in range(4)),
            lambda: f"{word()}.{word()}{number(99)}@{word()}{number(9)}.example.com",
            lambda: f"https://www.{word()}.example.org/{word()}/{word()}-{number(9999)}/{word()}.html?id={number(10**6)}",
            lambda: "-".join(some("0123456789abcdef", n) for n in (8, 4, 4, 4, 12)),
            lambda: f"/usr/{word()}/{word()}_{number(99)}.{word(3, 3)}",
            lambda: f"v{number(9)}.{number(30)}.{number(99)}-{word()}{number(9)}",
            lambda: word(16, 28),
            lambda: "".join(word().capitalize() for _ in range(rng.randint(2, 4))),
            lambda: "-".join(word() for _ in range(rng.randint(3, 5))),
            lambda: f"+{number(99)}-{some(_DIGITS, 3)}-{some(_DIGITS, 7)}",
            lambda: some(_UPPER, rng.randint(2, 5)) + "-" + number(99999),
            lambda: some(_UPPER, rng.randint(6, 14)),
            lambda: f"{rng.choice(KEYWORDS)}{rng.choice((': ', ' = ', ' ', ' is '))}{word()} {word()}",
            lambda: f"{rng.choice(KEYWORDS)}{rng.choice((': ', ' = ', ' '))}{number(9999)}",
        )
    )()


def variant(raw: bytes, own: list[tuple[int, int]], rng: random.Random) -> tuple[str, bytes, list[tuple[int, int]], int]:
    """A text changed for training or for measuring: what it shows, its bytes, its secrets, and the place of the change.

    With examples, their key words go, as do a known prefix and lower-case hexadecimal digits, which base spans go by.
    Without, a made-up secret is put between two words, or as often something harmless.
    """
    if not own:
        spaces = [m.start() for m in re.finditer(b" ", raw)] or [len(raw)]
        at = rng.choice(spaces)
        name, lead, value = secret(rng) if rng.random() < 0.5 else ("harmless", "", harmless(rng))
        head = raw[:at] + b" " + lead.encode()
        end = len(head) + len(value.encode())
        return name, head + value.encode() + raw[at:], [(len(head), end)] if name != "harmless" else [], len(head)
    out, done, found = [], 0, []
    for low, high in own:
        lead = LEAD.search(raw, max(done, low - 40), low)
        out.append(raw[done : lead.start() if lead else low] + (rng.choice(PHRASES).encode() if lead else b""))
        value = raw[low:high]
        if value.startswith(b"AKIA"):
            value = "".join(rng.choice(_UPPER) for _ in range(4)).encode() + value[4:]
        if re.fullmatch(rb"[0-9a-f]+", value):
            value = value.upper()
        start = sum(map(len, out))
        out.append(value)
        found.append((start, start + len(value)))
        done = high
    return "masked", b"".join([*out, raw[done:]]), found, found[0][0]


def _labels(tokens: Tokens, ranges: list[list[tuple[int, int]]]) -> tuple[np.ndarray, list[list[int]]]:
    """Labels of all tokens, from the byte ranges [start, end) of each document's values, and each value's first token."""
    label = np.full(len(tokens.starts), OUTSIDE)
    centres: list[list[int]] = [[] for _ in ranges]
    for d, own in enumerate(ranges):
        for low, high in own:  # the value's tokens, from its start to its end
            t = int(np.searchsorted(tokens.ends, low, "right"))
            if t < len(label) and label[t] != OUTSIDE:  # a token that the value before reaches into
                t += 1
            label[t : np.searchsorted(tokens.starts, high, "left")] = INSIDE
            if t < len(label) and label[t] == INSIDE:
                label[t] = BEGIN
                centres[d].append(t)
    return label, centres


def _changed(data: np.ndarray, offsets: np.ndarray, ranges: list[list[tuple[int, int]]], salt: int) -> tuple[list[str], np.ndarray, np.ndarray, list[list[tuple[int, int]]], list[int]]:
    """A ``variant`` of each text, as names, bytes, offsets, ranges of secrets and places."""
    raw, names, parts, secrets, places, at = data.tobytes(), [], [], [], [], 0
    for d, own in enumerate(ranges):
        low = int(offsets[d])
        text = raw[low : int(offsets[d + 1])]
        rng = random.Random(int.from_bytes(hashlib.blake2b(text, digest_size=8, salt=salt.to_bytes(2, "big")).digest(), "big"))
        name, text, found, place = variant(text, [(a - low, b - low) for a, b in own], rng)
        names.append(name)
        parts.append(text)
        secrets.append([(at + a, at + b) for a, b in found])
        places.append(at + place)
        at += len(text)
    joined = np.frombuffer(b"".join(parts), np.uint8)
    return names, joined, np.cumsum([0, *map(len, parts)]), secrets, places


def _windows(batches: Iterator[pa.RecordBatch], change: bool = True) -> Iterator[pa.RecordBatch]:
    """Training windows of the sampled documents: feature numbers and labels of up to WINDOW tokens around values, or at
    a place given by the text's length where there are none; with ``change`` also around the place of a variant's change.

    kind: 1 for windows with values of base spans, 2 with other secrets, 0 with none.
    """
    for batch in batches:
        data, offsets = words.buffer(batch["text"].unique())
        rows: list[tuple[int, list[int], list[int]]] = []
        for i, j in words.spans_of_documents(offsets):
            part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            ranges = examples(part, at, base_spans(part, at))
            versions = [(1, part, at, ranges, [])]
            if change:
                versions.append((2, *_changed(part, at, ranges, 0)[1:]))
            for kind, text, edges, secrets, places in versions:
                tokens = tokens_of(text, edges)
                label, centres = _labels(tokens, secrets)
                for d in range(j - i):
                    low, high = int(tokens.first[d]), int(tokens.first[d + 1])
                    if low == high:
                        continue
                    if kind == 1:
                        other = low + (int(edges[d + 1] - edges[d]) * 7919) % (high - low)
                    else:
                        other = min(high - 1, int(np.searchsorted(tokens.ends, places[d], "right")))
                    for c in (centres[d] or [other])[:WINDOWS_EACH]:
                        a = max(low, min(c - WINDOW // 2, high - WINDOW))
                        b = min(high, a + WINDOW)
                        while a < b - 1 and label[a] == INSIDE:  # a window starts with no value's rest
                            a += 1
                        flat = np.stack([f[a:b] for f in tokens.features], 1).ravel().tolist()
                        rows.append((kind if centres[d] else 0, flat, label[a:b].tolist()))
        yield pa.record_batch(
            {
                "kind": pa.array([r[0] for r in rows], pa.int32()),
                "features": pa.array([r[1] for r in rows], pa.list_(pa.int32())),
                "labels": pa.array([r[2] for r in rows], pa.list_(pa.int32())),
            }
        )


def fit(windows: list[tuple[list[int], list[int]]], steps: int = STEPS) -> Crf:
    """Maximum likelihood with an L2 penalty, by Adam; sums over all label paths by scaled forward and backward passes."""
    n, width = len(windows), len(SIZES)
    base = np.cumsum([0, *SIZES])
    x = np.zeros((n, WINDOW, width), np.int64)
    y = np.full((n, WINDOW), OUTSIDE)
    size = np.array([len(labels) for _, labels in windows])
    for r, (flat, labels) in enumerate(windows):
        x[r, : len(labels)] = np.array(flat).reshape(-1, width) + base[:-1]
        y[r, : len(labels)] = labels
    real = np.arange(WINDOW) < size[:, None]
    weight, moves = np.zeros((base[-1], 3)), np.zeros((3, 3))
    closed = np.zeros((3, 3), bool)
    closed[OUTSIDE, INSIDE] = True
    target_w = np.zeros_like(weight)
    np.add.at(target_w, (x[real], y[real][:, None]), 1)
    target_m = np.zeros((3, 3))
    both = real[:, 1:]
    np.add.at(target_m, (y[:, :-1][both], y[:, 1:][both]), 1)
    kinds, kind = np.unique(x[real], axis=0, return_inverse=True)  # prose repeats the same feature numbers
    kind = kind.ravel()
    moments = [np.zeros_like(weight), np.zeros_like(weight), np.zeros_like(moves), np.zeros_like(moves)]
    for step in range(1, steps + 1):
        score = weight[kinds].sum(1)
        psi = np.zeros((n, WINDOW, 3))
        psi[real] = np.exp(score - score.max(1, keepdims=True))[kind]
        psi[:, 0, INSIDE] = 0.0
        psi[~real] = [0.0, 0.0, 1.0]
        move = np.exp(np.where(closed, FORBIDDEN, moves))
        forward, backward = np.zeros((WINDOW, n, 3)), np.ones((WINDOW, n, 3))
        forward[0] = psi[:, 0] / psi[:, 0].sum(1, keepdims=True)
        for t in range(1, WINDOW):
            step_ = np.where(real[:, t, None], forward[t - 1] @ move, 1.0) * psi[:, t]
            forward[t] = step_ / step_.sum(1, keepdims=True)
        for t in range(WINDOW - 2, -1, -1):
            step_ = psi[:, t + 1] * backward[t + 1]
            step_ = np.where(real[:, t + 1, None], step_ @ move.T, 1.0)
            backward[t] = step_ / step_.sum(1, keepdims=True)
        share = forward * backward
        share = (share / share.sum(2, keepdims=True)).transpose(1, 0, 2)[real]
        of_kind = np.stack([np.bincount(kind, share[:, c], len(kinds)) for c in range(3)], 1)
        expect_w = np.stack([np.bincount(kinds.ravel(), np.repeat(of_kind[:, c], width), base[-1]) for c in range(3)], 1)
        expect_m = np.zeros((3, 3))
        for t in range(1, WINDOW):
            on = real[:, t]
            pair = forward[t - 1][on][:, :, None] * move * (psi[on, t] * backward[t][on])[:, None, :]
            expect_m += (pair / pair.sum((1, 2), keepdims=True)).sum(0)
        for at, (value, grad) in enumerate(((weight, (target_w - expect_w) / n - 1e-4 * weight), (moves, (target_m - expect_m) / n - 1e-4 * moves))):
            m, v = moments[2 * at], moments[2 * at + 1]
            m += 0.1 * (grad - m)
            v += 0.01 * (grad**2 - v)
            value += 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Crf([weight[a:b] for a, b in zip(base, base[1:])], np.where(closed, FORBIDDEN, moves))


def learn(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, steps: int = STEPS) -> Crf | None:
    """A CRF from the values of base spans and from made-up secrets, or None where no text has a token.

    What the base patterns go by is hidden in a third of the windows, so that shape and other neighbours have to do, and
    harmless look-alikes are put into as many texts as made-up secrets are. Distinct texts with and without examples are
    sampled apart, each by hash, so neither rare secrets nor copies change what is learnt from: up to a third of
    ``sample_rows`` distinct windows of each kind, all of which the fit uses. One text in HELD_OUT is left out.
    """
    each = max(1, sample_rows // 3)
    texts = docs.where("text IS NOT NULL").select("text", F.xxhash64("text").alias("key"))
    texts = texts.where(F.pmod("key", F.lit(HELD_OUT)) != HELD_OUT - 1)
    keys = stash(texts.mapInArrow(_classes, "hit boolean, key long").distinct(), "keys")
    rows = {r["hit"]: r["count"] for r in keys.groupBy("hit").count().collect()}
    if not rows:
        return None
    below = F.when(F.col("hit"), min(1.0, 1.2 * each / rows.get(True, 1))).otherwise(min(1.0, 1.2 * each / rows.get(False, 1)))
    chance = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) / float(1 << 30)
    taken = [r["key"] for r in keys.where(chance < below).collect()]  # some more than needed, as texts may share a window
    sampled = texts.where(F.col("key").isin(taken)).select("text")
    windows = sampled.mapInArrow(_windows, "kind int, features array<int>, labels array<int>").distinct()
    found = [(h, tuple(f), tuple(y)) for h, f, y in windows.collect()]  # at most 2 * WINDOWS_EACH a sampled text
    found.sort(key=lambda r: hashlib.md5(np.array([*r[1], *r[2]], np.int32).tobytes()).digest())
    return fit([r[1:] for kind in (1, 2, 0) for r in [x for x in found if x[0] == kind][:each]], steps)


def measure(docs: DataFrame, model: Crf) -> DataFrame:
    """(shape, secrets, found, extra) over variants of the distinct texts that ``learn`` left out.

    shape is ``masked`` for values without what base patterns go by, else that of the made-up secret, or ``harmless``.
    found counts secrets that spans cover wholly, extra the CRF's spans that touch no secret.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            data, offsets = words.buffer(batch["text"])
            for i, j in words.spans_of_documents(offsets):
                part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                names, text, edges, secrets, _ = _changed(part, at, examples(part, at, base_spans(part, at)), 1)
                for d, (base, added) in enumerate(byte_spans(text, edges, shared.value)):
                    own = [(a - int(edges[d]), b - int(edges[d])) for a, b in secrets[d]]
                    inside = np.zeros(int(edges[d + 1] - edges[d]), bool)
                    for a, _, b in base + added:
                        inside[a:b] = True
                    inside |= BREAK[text[edges[d] : edges[d + 1]]]
                    found = sum(bool(inside[a:b].all()) for a, b in own)
                    extra = sum(not any(a < y and x < b for x, y in own) for a, _, b in added)
                    out.append((names[d], len(own), found, extra))
            columns = list(zip(*out)) or [()] * 4
            kinds = (pa.string(), *[pa.int64()] * 3)
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["shape", "secrets", "found", "extra"])

    texts = docs.where(F.pmod(F.xxhash64("text"), F.lit(HELD_OUT)) == HELD_OUT - 1).select("text").distinct()
    rows = texts.where("text <> ''").mapInArrow(run, "shape string, secrets long, found long, extra long")
    return rows.groupBy("shape").agg(*[F.sum(c).alias(c) for c in ("secrets", "found", "extra")])


def beside(
    data: np.ndarray, offsets: np.ndarray, d: int, tokens: Tokens, a: int, b: int, base: list[tuple[int, int, int]]
) -> list[tuple[int, int]]:
    """What base spans leave of the tagged tokens [a, b) of document d, with padding: byte ranges in the document that
    overlap no base span and hold a whole token, so that the rest of a value goes where a base span has its start."""
    left, end = int(offsets[d]), int(tokens.ends[b - 1])
    if m := PADDING.match(memoryview(data), end, int(offsets[d + 1])):
        end = m.end()
    at, pieces = int(tokens.starts[a]) - left, []
    for x, _, y in [*base, (end - left, 0, end - left)]:
        if y <= at and x < end - left:
            continue
        if min(x, end - left) > at:
            pieces.append((at, min(x, end - left)))
        at = max(at, y)
    inner = [(int(tokens.starts[t]) - left, int(tokens.ends[t]) - left) for t in range(a, b)] if pieces else []
    return [(x, y) for x, y in pieces if any(x <= p and q <= y for p, q in inner)]


def byte_spans(part: np.ndarray, at: np.ndarray, model: Crf | None) -> list[tuple[list, list]]:
    """For each document its base spans and its added ones, as (start, kind, end) in bytes of the document."""
    base = base_spans(part, at)
    added: list[list[tuple[int, int, int]]] = [[] for _ in base]
    if model is not None:
        tokens = tokens_of(part, at)
        for a, b in decode(model, tokens):
            d = int(np.searchsorted(tokens.first, a, "right")) - 1
            added[d] += [(low, 3, high) for low, high in beside(part, at, d, tokens, a, b, base[d])]
    return list(zip(base, added))


def scan_column(texts: pa.Array, model: Crf | None) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """For each text its base spans and its added ones, as (start, kind, end) in code points."""
    data, offsets = words.buffer(texts)
    out = []
    for i, j in words.spans_of_documents(offsets):
        part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        for d, (base, added) in enumerate(byte_spans(part, at, model)):
            if not (base or added):
                out.append(([], []))
                continue
            point = np.concatenate([[0], np.cumsum((part[at[d] : at[d + 1]] & 0xC0) != 0x80)])
            out.append(tuple([(int(point[a]), k, int(point[b])) for a, k, b in own] for own in (base, added)))
    return out


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def secret_scan(docs: DataFrame, model: Crf | None, replacement: str | None = None) -> DataFrame:
    """``docs`` with spans: every secret as (kind, start, end) in code points, end exclusive, by start and kind.

    Kinds assign, access and hex are the base patterns; crf are spans that the CRF adds, of one or several tokens,
    less what base spans cover of them.
    With ``replacement``, each secret of ``text`` (overlapping ones together) is replaced by it. Defined cases: a null
    text has no spans and stays null; repeated rows are scanned alike; an input column named spans is replaced; an
    empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    docs = docs.drop("spans")
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred weights
    item = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(base + added) for base, added in scan_column(batch["text"], shared.value)]
            lists = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in own] for own in found]
            columns = dict(zip(names, batch.columns))
            if replacement is not None:
                texts = [redact(t.as_py(), own, replacement) if own else t.as_py() for t, own in zip(columns["text"], found)]
                columns["text"] = pa.array(texts, pa.string())
            yield pa.record_batch([*columns.values(), pa.array(lists, pa.list_(item))], names=[*names, "spans"])

    return docs.mapInArrow(run, extended(docs.schema, "spans array<struct<kind:string,start:int,end:int>>"))


def redact(text: str, spans: list[tuple[int, int, int]], replacement: str) -> str:
    out, at = [], 0
    for a, _, b in sorted(spans):
        if a >= at:
            out += [text[at:a], replacement]
        at = max(at, b)
    return "".join([*out, text[at:]])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    shared = spark.sparkContext.broadcast(learn(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = scan_column(batch["text"], shared.value)
            count = lambda kind: pa.array([sum(k == kind for _, k, _ in base) for base, _ in found], pa.int64())  # noqa: B023, E731
            yield pa.record_batch(
                {
                    "doc_id": batch["doc_id"],
                    "n_assign": count(0),
                    "n_access": count(1),
                    "n_hex": count(2),
                    "base_sha256": pa.array([hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found], pa.string()),
                    "spans": pa.array([written(base + added) for base, added in found], pa.string()),
                }
            )

    return docs.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
