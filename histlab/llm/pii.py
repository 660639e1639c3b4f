"""Personal data by a semi-Markov conditional random field.

Four base patterns are reported as they stand. Around signs of personal data (digits, @,
spelled-out addresses) the text is cut into tokens, and a semi-Markov model scores whole
candidate segments: features see the complete span (its digits, its shape, checksums, the
words before it) rather than single tokens, and transitions see the types of neighbouring
segments. A dynamic program over segments of bounded length chooses boundaries and types
together; base spans are given, so candidates lie outside them.

The weights are trained here, on labelled sentences that a seeded generator makes, by the
conditional log-likelihood: forward and backward sums over all segmentations give its
gradient.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

#: Fixed patterns of the base findings, written so that a scan stays linear.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_RUN = re.compile(r"[0-9]+")

BASE = ("email", "ip", "card", "phone")
#: All types of segments, in the order in which their spans are listed.
TYPES = (*BASE, "ssn", "iban")
OTHER = "-"
#: The longest segment in tokens.
MAX_TOKENS = 14
#: Digits that the longest entity can have.
MAX_DIGITS = 34
#: Code points around a sign that the model sees; up to as many more are added to the next white space.
MARGIN = 60
SEED = 20240229
SENTENCES = 1200
EPOCHS = 4
BATCH = 60
RATE, DECAY = 0.5, 1e-4

Span = tuple[int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        total += x if i % 2 == 0 else x * 2 - 9 * (x > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(_RUN.findall(s))


def emails(text: str) -> list[Span]:
    out, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            out.append((start, end))
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> dict[str, list[Span]]:
    """Leftmost non-overlapping matches of each kind; those that fail their test are dropped."""
    found: dict[str, list[Span]] = {kind: [] for kind in BASE}
    if "@" in text:
        found["email"] = emails(text)
    if _DIGIT.search(text):
        if "." in text:
            found["ip"] = [m.span() for m in _IP.finditer(text) if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m[0].split(".")))]
        for m in _CARD.finditer(text):
            digits = _digits(m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                found["card"].append(m.span())
        if "+" in text:
            found["phone"] = [m.span() for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return found


# The model.

_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[^\w\s]|_")
_SIGN = re.compile(r"@|\b[A-Z]{2}[0-9]{2}[ ]?[A-Z0-9]{4}")
#: A spelled-out address from its `at` on.
_AT = re.compile(r"(?i:\[at\]|\(at\)|\{at\}| at(?= ))")
_BEHIND = re.compile(r"(?i) {0,2}[\w-]+(?: ?(?:\[dot\]|\(dot\)|\{dot\}| dot ) ?[\w-]+|\.[\w-]+)+")
_BEFORE = re.compile(r"[\w.%+-]")
#: A place in a plain sentence rather than an address: `at` as a word, dots as they are.
_PLACE = re.compile(r"(?i)[\w.%+-]+  ?at  ?[\w-]+(?:\.[\w-]+)+")
_SHAPES = {
    "email": re.compile(r"[\w.%+-]+@[\w-]+(?:\.[\w-]+)+"),
    "spelled": re.compile(r"(?i)[\w.%+-]+ ?(?:\[at\]|\(at\)|\{at\}| at ) ?[\w-]+(?: ?(?:\[dot\]|\(dot\)|\{dot\}| dot ) ?[\w-]+|\.[\w-]+)+"),
    "ip": re.compile(r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}"),
    "phone": re.compile(r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}"),
    "plus": re.compile(r"\+[0-9][ ().0-9-]+[0-9]"),
    "ssn": re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
    "iban": re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?"),
    "grouped": re.compile(r"[0-9]{4}(?:[ -]?[0-9]{4}){3}|[0-9]{13,19}"),
    "date": re.compile(r"[0-9]{1,4}[./-][0-9]{1,2}[./-][0-9]{1,4}"),
}
#: What follows a segment that was ended too early.
_GOES_ON = re.compile(r"\.[\w-]|(?i: ?(?:\[dot\]|\(dot\)|\{dot\}| dot ))|[ -]?[0-9]")
_CUES = {
    "phone": {"phone", "tel", "telephone", "call", "mobile", "cell", "fax"},
    "email": {"mail", "email", "contact", "write", "reach"},
    "card": {"card", "visa", "mastercard", "credit", "pay"},
    "ssn": {"ssn", "social", "security"},
    "iban": {"iban", "account", "bank", "transfer"},
    "ip": {"ip", "server", "host", "address"},
}


def iban_valid(span: str) -> bool:
    s = span.replace(" ", "")
    if not 15 <= len(s) <= 34 or not s.isascii() or not s.isalnum():
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def tokens_of(text: str) -> list[Span]:
    return [m.span() for m in _TOKEN.finditer(text)]


def span_features(text: str, tokens: list[Span], i: int, j: int) -> list[str]:
    """Features of the whole segment of tokens i to j (end exclusive)."""
    start, stop = tokens[i][0], tokens[j - 1][1]
    span = text[start:stop]
    digits = _digits(span)
    out = ["bias", f"tokens:{min(j - i, 8)}", f"digits:{min(len(digits), 20)}"]
    out += [f"shape:{name}" for name, shape in _SHAPES.items() if shape.fullmatch(span)]
    if _PLACE.fullmatch(span):
        out.append("place")
    if digits and 13 <= len(digits) <= 19:
        out.append(f"luhn:{luhn(digits)}")
    if len(span) >= 15 and span[:2].isalpha() and iban_valid(span):
        out.append("iban-valid")
    if i and tokens[i - 1][1] == start:
        out.append(f"joined-left:{text[start - 1].isalnum()}")
    if j < len(tokens) and tokens[j][0] == stop:
        out.append(f"joined-right:{text[stop].isalnum() or text[stop] in '-@'}")
    if _GOES_ON.match(text, stop):
        out.append("goes-on")
    before = {text[a:b].lower() for a, b in tokens[max(0, i - 4) : i]}
    out += [f"cue:{kind}" for kind, words in _CUES.items() if before & words]
    if not digits and "@" not in span and "shape:spelled" not in out:
        out.append("plain")
    return out


def candidate(text: str, tokens: list[Span], i: int, j: int) -> bool:
    """Whether a segment can be an entity at all: it holds a sign and stays on one line."""
    span = text[tokens[i][0] : tokens[j - 1][1]]
    digits = len(_digits(span))
    return "\n" not in span and digits <= MAX_DIGITS and ("@" in span or digits >= 7 or bool(_SHAPES["spelled"].fullmatch(span)))


def candidates(text: str, tokens: list[Span], closed: list[bool] | None = None) -> Iterator[Span]:
    """All segments (first token, end token) that candidate() takes, but those with ``closed`` tokens."""
    digits, ats, spelled = [0], [0], [0]
    for a, b in tokens:
        first = text[a]
        digits.append(digits[-1] + (b - a if "0" <= first <= "9" else 0))
        ats.append(ats[-1] + (first == "@"))
        spelled.append(spelled[-1] + (b - a == 2 and text[a:b].lower() == "at"))
    lines = [text.find("\n", a, b) >= 0 for (_, a), (b, _) in zip(tokens, tokens[1:], strict=False)] + [False]
    n = len(tokens)
    for i in range(n):
        for j in range(i + 1, min(n, i + MAX_TOKENS) + 1):
            if (closed and closed[j - 1]) or (j > i + 1 and lines[j - 2]) or digits[j] - digits[i] > MAX_DIGITS:
                break
            if digits[j] - digits[i] >= 7 or ats[j] > ats[i] or (spelled[j] > spelled[i] and _SHAPES["spelled"].fullmatch(text, tokens[i][0], tokens[j - 1][1])):
                yield i, j


#: Labels of segments: OTHER, always one token long and without features, and the types.
LABELS = (OTHER, *TYPES)


@dataclass
class Model:
    """Weights: per feature one for each type, and one for each pair of neighbouring labels."""

    features: dict[str, list[float]]
    moves: list[list[float]]

    def scores(self, features: list[str]) -> list[float]:
        out = [0.0] * len(TYPES)
        for f in features:
            own = self.features.get(f)
            if own:
                out = [x + y for x, y in zip(out, own, strict=True)]
        return out


def segment(text: str, tokens: list[Span], model: Model, closed: list[bool] | None = None) -> list[tuple[int, int, str]]:
    """The best segmentation, by the Viterbi program over segments: entities as (first token, end token, type)."""
    n, moves = len(tokens), model.moves
    # Per place, for each label that a segment ending there can have: (score, start, label before).
    best: list[dict[int, tuple[float, int, int]]] = [{} for _ in range(n + 1)]
    best[0][0] = (0.0, -1, -1)
    todo = candidates(text, tokens, closed)
    at = next(todo, None)
    for i in range(n):
        here = best[i].items()

        def into(y: int, here=here) -> tuple[float, int]:
            return max((s[0] + moves[x][y], x) for x, s in here)

        score, x = into(0)
        if 0 not in best[i + 1] or score > best[i + 1][0][0]:
            best[i + 1][0] = (score, i, x)
        arrive = None
        while at is not None and at[0] == i:
            j = at[1]
            arrive = arrive or [into(y) for y in range(1, len(LABELS))]
            own, goal = model.scores(span_features(text, tokens, i, j)), best[j]
            for y, (score, x) in enumerate(arrive, 1):
                total = score + own[y - 1]
                if y not in goal or total > goal[y][0]:
                    goal[y] = (total, i, x)
            at = next(todo, None)
    out, j = [], n
    y = max((s[0], x) for x, s in best[n].items())[1]
    while j:
        _, i, x = best[j][y]
        if y:
            out.append((i, j, LABELS[y]))
        j, y = i, x
    return out[::-1]


def _sentence(rng: random.Random) -> tuple[str, list[tuple[int, int, str]]]:
    """A made sentence and its entities as (start, end, type)."""
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvwxyz") for _ in range(rng.randint(2, 9)))
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    domain = lambda: [word() for _ in range(rng.randint(1, 2))] + [rng.choice(["com", "org", "net", "de", "example"])]

    def checked(n: int) -> str:
        head = number(n - 1)
        return next(head + d for d in "0123456789" if luhn(head + d))

    def spaced(s: str) -> str:
        sep = rng.choice(["", " ", "-"])
        return sep.join(s[k : k + 4] for k in range(0, len(s), 4))

    def iban() -> str:
        country, rest = rng.choice(["DE", "FR", "ES", "GB", "NL"]), number(rng.choice([16, 18, 20]))
        body = f"{country}00{rest}"
        check = 98 - int("".join(str(int(c, 36)) for c in rest + country + "00")) % 97
        body = f"{country}{check:02d}{rest}"
        return rng.choice([body, " ".join(body[k : k + 4] for k in range(0, len(body), 4))])

    def spelled() -> str:
        at, dot = rng.choice([(" [at] ", " [dot] "), (" at ", " dot "), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" (at) ", ".")])
        return word() + at + dot.join(domain())

    def phone() -> str:
        a, b, c = number(3), number(3), number(4)
        return rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a} {b} {c}", f"+{rng.randint(1, 99)} ({a}) {b}-{c}", f"{a}.{b}.{c}", f"+{rng.randint(1, 99)} {a} {b} {c}"])

    def wrong() -> str:
        card = checked(16)
        broken = card[:-1] + str((int(card[-1]) + rng.randint(1, 9)) % 10)
        return rng.choice(
            [
                spaced(broken), f"{rng.randint(1900, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", ".".join(number(rng.randint(1, 2)) for _ in range(3)),
                f"{rng.randint(256, 999)}.{number(3)}.{number(2)}.{number(1)}", number(rng.randint(5, 12)), number(rng.randint(20, 30)),
                f"{word()} at {word()}", f"@{word()}", f"{rng.randint(1, 12)}:{number(2)}", f"{number(2)},{number(3)},{number(3)}",
                f"{word()} @ {word()}", f"{number(4)} {number(4)}", f"{number(2)} {number(2)} {number(2)} {number(2)}", f"{rng.randint(1900, 2030)} {rng.randint(1900, 2030)}",
                "".join(rng.choice("0123456789abcdef") for _ in range(rng.randint(8, 40))), f"v{number(1)}.{number(1)}.{number(2)}-{number(6)}",
                f"{word()} at {'.'.join(domain())}", f"{word()} at {word()}.{word().title()}", f"{rng.randint(1900, 2030)} {word()} {rng.randint(1900, 2030)}", f"{number(3)} {word()} {number(5)} {word()}",
            ]
        )

    makers = {
        "email": lambda: rng.choice([lambda: f"{word()}.{number(2)}@{'.'.join(domain())}", lambda: f"{word()}@{'.'.join(domain())}", spelled])(),
        "ip": lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)),
        "card": lambda: spaced(checked(16)),
        "phone": phone,
        "ssn": lambda: f"{number(3)}-{number(2)}-{number(4)}",
        "iban": iban,
    }
    text, gold = "", []
    for _ in range(rng.randint(1, 3)):
        text += " ".join(word() for _ in range(rng.randint(1, 5))) + " "
        roll = rng.random()
        if roll < 0.55:
            kind = rng.choice(list(makers))
            if rng.random() < 0.3:
                text += rng.choice(sorted(_CUES[kind])) + rng.choice([" ", ": "])
            made = makers[kind]()
            gold.append((len(text), len(text) + len(made), kind))
            text += made
        elif roll < 0.95:
            text += wrong()
        text += rng.choice([" ", ". ", ", "])
    return text + word(), gold


class Lattice:
    """Labelled sentences as arrays: all candidate segments with their features, and the gold ones.

    Sums run over all segmentations at once, sentence by sentence side by side. A segment is
    (sentence, first token, length), a label a number of LABELS; before the first token the
    label is OTHER.
    """

    def __init__(self, data: list[tuple[str, list[Span], list[tuple[int, int, str]]]], names: dict[str, int]):
        self.lengths = np.array([len(tokens) for _, tokens, _ in data])
        places, rows, columns, gold = [], [], [], []
        moves = np.zeros((len(LABELS), len(LABELS)))
        for b, (text, tokens, entities) in enumerate(data):
            number = {}
            for i, j in candidates(text, tokens):
                number[i, j] = len(places)
                for f in span_features(text, tokens, i, j):
                    rows.append(len(places))
                    columns.append(names.setdefault(f, len(names)))
                places.append((b, i, j - i - 1))
            # What is no candidate counts as OTHER.
            own = [(i, j, LABELS.index(kind)) for i, j, kind in entities if (i, j) in number]
            gold += [(number[i, j], y - 1) for i, j, y in own]
            labels, place = [0], 0
            for i, j, y in own:
                labels += [0] * (i - place) + [y]
                place = j
            labels += [0] * (len(tokens) - place)
            np.add.at(moves, (labels[:-1], labels[1:]), 1)
        self.places = np.array(places, np.int64).reshape(-1, 3)
        self.rows, self.columns = np.array(rows, np.int64), np.array(columns, np.int64)
        self.gold = np.zeros((len(places), len(TYPES)))
        for k, y in gold:
            self.gold[k, y] = 1
        self.gold_moves = moves

    def matrix(self, n: int) -> np.ndarray:
        x = np.zeros((len(self.places), n))
        x[self.rows, self.columns] = 1
        return x

    def likelihood(self, x: np.ndarray, weights: np.ndarray, moves: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """The conditional log-likelihood of the gold segmentations, and its gradients."""
        n_texts, n, labels = len(self.lengths), int(self.lengths.max(initial=0)), len(LABELS)
        own = x @ weights
        b, first, extra = self.places.T
        scores = np.full((n_texts, n + 1, MAX_TOKENS, len(TYPES)), -np.inf)
        scores[b, first, extra] = own

        def total(values: np.ndarray, axis: int) -> np.ndarray:
            top = values.max(axis, keepdims=True)
            top = np.where(np.isfinite(top), top, 0.0)
            with np.errstate(divide="ignore"):
                return np.log(np.exp(values - top).sum(axis)) + top.squeeze(axis)

        ahead = np.full((n_texts, n + 1, labels), -np.inf)  # all ways to a place, by the last label
        enter = np.full((n_texts, n + 1, labels), -np.inf)  # the same, with the move to the next label
        ahead[:, 0, 0] = 0.0
        for j in range(n + 1):
            if j:
                size = np.arange(min(j, MAX_TOKENS))
                ahead[:, j, 0] = enter[:, j - 1, 0]
                ahead[:, j, 1:] = total(enter[:, j - 1 - size, 1:] + scores[:, j - 1 - size, size], 1)
            enter[:, j] = total(ahead[:, j, :, None] + moves, 1)
        whole = total(ahead[np.arange(n_texts), self.lengths], 1)

        after = np.full((n_texts, n + 1, labels), -np.inf)  # all ways from a place, by the label before it
        leave = np.full((n_texts, n + 1, labels), -np.inf)  # the same, by the label that starts there
        for i in range(n, -1, -1):
            if i < n:
                size = np.arange(min(n - i, MAX_TOKENS))
                leave[:, i, 0] = after[:, i + 1, 0]
                leave[:, i, 1:] = total(scores[:, i, size] + after[:, i + 1 + size, 1:], 1)
                after[:, i] = total(moves + leave[:, i, None, :], 2)
            after[self.lengths == i, i] = 0.0
        share = np.exp(enter[b, first, 1:] + own + after[b, first + extra + 1, 1:] - whole[b, None])
        inside = np.arange(n + 1) < self.lengths[:, None]
        pairs = np.where(inside[..., None, None], ahead[..., None] + moves + leave[:, :, None, :] - whole[:, None, None, None], -np.inf)
        value = float((own * self.gold).sum() + (moves * self.gold_moves).sum() - whole.sum())
        return value, x.T @ (self.gold - share), self.gold_moves - np.exp(pairs).sum((0, 1))


def labelled_sentences(seed: int, sentences: int) -> list[tuple[str, list[Span], list[tuple[int, int, str]]]]:
    """(text, tokens, entities by tokens) that the generator makes."""
    rng, out = random.Random(seed), []
    for _ in range(sentences):
        text, gold = _sentence(rng)
        tokens = tokens_of(text)
        starts, stops = {a: k for k, (a, _) in enumerate(tokens)}, {b: k + 1 for k, (_, b) in enumerate(tokens)}
        out.append((text, tokens, [(starts[a], stops[b], kind) for a, b, kind in gold if a in starts and b in stops]))
    return out


def train(seed: int = SEED, sentences: int = SENTENCES, epochs: int = EPOCHS) -> Model:
    """Maximise the conditional log-likelihood, with a pull to zero, by adaptive steps; equal seeds give equal weights."""
    data, names = labelled_sentences(seed, sentences), {}
    parts = [Lattice(data[k : k + BATCH], names) for k in range(0, len(data), BATCH)]
    parts = [(part, part.matrix(len(names))) for part in parts]
    values = [np.zeros((len(names), len(TYPES))), np.zeros((len(LABELS), len(LABELS)))]
    squares = [np.full_like(v, 1e-6) for v in values]
    for _ in range(epochs):
        for part, x in parts:
            _, *slopes = part.likelihood(x, *values)
            for v, q, slope in zip(values, squares, slopes, strict=True):
                step = slope / len(part.lengths) - DECAY * v
                q += step * step
                v += RATE * step / np.sqrt(q)
    return Model({f: values[0][k].tolist() for f, k in names.items()}, values[1].tolist())


@lru_cache(maxsize=1)
def weights() -> Model:
    return train()


def digit_signs(text: str) -> Iterator[Span]:
    """The shortest stretches of 7 digits and more on one line and within MAX_TOKENS tokens."""
    runs = [m.span() for m in _RUN.finditer(text)]
    last, digits = 0, 0
    for first, (start, stop) in enumerate(runs):
        while digits < 7 and last < len(runs):
            digits += runs[last][1] - runs[last][0]
            last += 1
        if digits < 7:
            return
        end = runs[last - 1][1]
        if text.find("\n", start, end) < 0 and sum(1 for _ in islice(_TOKEN.finditer(text, start, end), MAX_TOKENS + 1)) <= MAX_TOKENS:
            yield start, end
        digits -= stop - start


def spelled_signs(text: str) -> Iterator[Span]:
    """Spelled-out addresses as far as their shape goes, whatever their length."""
    for m in _AT.finditer(text):
        behind = _BEHIND.match(text, m.end())
        if behind:
            start = m.start()
            start -= text[start - 1 : start] == " "
            while start and _BEFORE.match(text[start - 1]):
                start -= 1
            yield start, behind.end()


def _edge(text: str, at: int, step: int) -> int:
    """``at``, or the next white space from there within MARGIN."""
    for k in range(at, at + MARGIN * step, step):
        if not 0 < k < len(text):
            return max(0, min(len(text), k))
        if text[k - (step < 0)].isspace():
            return k
    return at


def regions(text: str) -> list[Span]:
    """Stretches around the signs, joined where they meet; whatever can be a candidate has a sign.

    They end at white space where there is some near, so that words are not cut.
    """
    out: list[Span] = []
    for a, b in sorted([*(m.span() for m in _SIGN.finditer(text)), *digit_signs(text), *spelled_signs(text)]):
        start, stop = max(0, a - MARGIN), min(len(text), b + MARGIN)
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    joined: list[Span] = []
    for a, b in out:
        start, stop = _edge(text, a, -1), _edge(text, b, 1)
        if joined and start <= joined[-1][1]:
            joined[-1] = (joined[-1][0], max(stop, joined[-1][1]))
        else:
            joined.append((start, stop))
    return joined


def _union(spans: list[Span]) -> list[Span]:
    out: list[Span] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def model_spans(text: str, model: Model, taken: list[Span]) -> list[tuple[int, int, str]]:
    """Spans that the model finds outside ``taken``, which are sorted and apart."""
    out, starts = [], [a for a, _ in taken]

    def meets(a: int, b: int) -> bool:
        k = bisect_right(starts, b - 1) - 1
        return k >= 0 and taken[k][1] > a

    for start, stop in regions(text):
        part = text[start:stop]
        tokens = tokens_of(part)
        closed = [meets(a + start, b + start) for a, b in tokens] if taken else None
        for i, j, kind in segment(part, tokens, model, closed):
            # A segment at the very edge of a region may have been cut; only inner ones count.
            a, b = tokens[i][0] + start, tokens[j - 1][1] + start
            if (a > start or start == 0) and (b < stop or stop == len(text)):
                out.append((a, b, kind))
    return out


def find(text: str, model: Model) -> tuple[dict[str, list[Span]], list[tuple[int, int, str]]]:
    """Base spans by kind, and the spans that the model adds: those that meet no base span."""
    base = base_spans(text)
    return base, model_spans(text, model, _union([s for spans in base.values() for s in spans]))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: id, ``carry``, and base, added and all, arrays of (kind, start, stop).

    Offsets are code points, the end exclusive; spans come by kind as in TYPES and then by
    start. Null and empty texts have none. Rows are treated one by one, so ties and repeated
    rows need no rule. Of other columns only those of ``carry`` are read. An empty table
    gives none.
    """
    trained = weights()
    keep = list(dict.fromkeys([id_col, *carry]))
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    kind = "array<struct<kind:string,start:int,stop:int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, more, both = [], [], []
            for value in batch.column(0):
                base, added = find(value.as_py() or "", trained)
                own.append([{"kind": k, "start": a, "stop": b} for k in BASE for a, b in base[k]])
                more.append([{"kind": k, "start": a, "stop": b} for a, b, k in added])
                both.append(sorted(own[-1] + more[-1], key=lambda s: (TYPES.index(s["kind"]), s["start"])))
            arrays = [pa.array(x, spans) for x in (own, more, both)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *arrays], names=[*keep, "base", "added", "all"])

    return map_batches(docs.select(F.col(text_col).alias("_text"), *keep), run, f"{schema}, base {kind}, added {kind}, all {kind}")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with each span replaced by its type in angle brackets; overlapping spans as one.

    Null text stays null; all other columns are carried unchanged.
    """
    trained = weights()
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    names = docs.columns

    def clean(text: str | None) -> str | None:
        if text is None:
            return None
        base, added = find(text, trained)
        spans = sorted([(a, b, k) for k in BASE for a, b in base[k]] + added)
        out, end = [], 0
        for a, b, k in spans:
            if a >= end:
                out.append(text[end:a] + f"<{k}>")
            end = max(end, b)
        return "".join([*out, text[end:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index(text_col)
        for batch in batches:
            columns = list(batch.columns)
            columns[at] = pa.array([clean(x.as_py()) for x in columns[at]], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return map_batches(docs, run, schema)
