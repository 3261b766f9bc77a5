"""Semi-Markov conditional random field over stretches of text that may hold personal data."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np

TYPES = ("O", "email", "ip", "card", "phone")
#: No entity spans more tokens; an O segment is one token.
MOST_TOKENS = 20
_AT = r"\s?[(\[{<]\s?(?:at|AT|@)\s?[)\]}>]\s?|\x20?@\x20?|\x20(?:at|AT)\x20"
_DOT = r"\x20?[(\[{<]\x20?(?:\.|dot|DOT)\x20?[)\]}>]\x20?|\x20(?:dot|DOT|\.)\x20"
_TOKEN = re.compile(rf"(?P<a>[A-Za-z]+)|(?P<n>[0-9]+)|(?P<at>{_AT})|(?P<dot>{_DOT}|\.)|(?P<s>\s+)|(?P<c>.)", re.S)
_KINDS = {"a": "a", "n": "9", "at": "@", "dot": ".", "s": " "}
_NUMERIC, _FIRST, _LOCAL, _DOMAIN = frozenset("9 -./()+"), frozenset("9+("), frozenset("a9._%+-"), frozenset("a9.-")
# Endings of common domains, and words that go before an entity of a type or before other numbers.
ENDINGS = frozenset("com org net edu gov io co info eu de fr es it nl ch uk us".split())
CUES = {w: kind for kind, words in {"phone": "tel phone telephone telefon call mobile cell fax ring whatsapp", "card": "card visa mastercard amex credit debit", "ip": "ip host server address", "email": "mail email contact write", "other": "version isbn order invoice id no nr ref page date total year"}.items() for w in words.split()}

Token = tuple[str, str]  # kind, text
Key = tuple  # what the features of a candidate are made of
Segment = tuple[int, int, Key]  # first token, end token, key


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def octet(digits: str) -> bool:
    """True for a number up to 255, however many zeros lead it."""
    value = digits.lstrip("0")
    return len(value) < 4 and (not value or int(value) < 256)


def tokenise(text: str) -> list[Token]:
    return [(_KINDS.get(m.lastgroup, m[0]), m[0]) for m in _TOKEN.finditer(text)]


def _edge(token: Token | None) -> str:
    return "^" if token is None else token[0] if token[0] in "9a @" else "."


def _cue(tokens: list[Token], a: int) -> str:
    """What the nearer of the two words before a token tells of it."""
    words = [text.lower() for kind, text in tokens[max(0, a - 5) : a] if kind == "a"][-2:]
    return next((CUES[w] for w in reversed(words) if w in CUES), "")


def segments(tokens: list[Token]) -> list[Segment]:
    """All candidate entities of up to MOST_TOKENS tokens, by what their type allows.

    Numbers: digits in groups, parted by single marks or a space or two, 7 to
    19 digits or four groups with dots. Addresses: one at sign, a name before
    it and a domain with a dot after it. Letters end a number, so that a long
    run of mixed letters and digits has hardly any candidate.
    """
    out: list[Segment] = []
    n = len(tokens)
    for a, (kind, _) in enumerate(tokens):
        if kind in _FIRST:
            shape, digits, sizes = "", "", ()
            for b in range(a, min(a + MOST_TOKENS, n)):
                k, text = tokens[b]
                if k not in _NUMERIC or (k == " " and (len(text) > 2 or "\n" in text)):
                    break
                shape += k
                if k == "9":
                    digits, sizes = (digits + text)[:24], (*sizes, min(len(text), 20))
                    dotted = shape == "9.9.9.9"
                    if dotted or 7 <= len(digits) <= 19:
                        good = dotted and all(octet(tokens[i][1]) for i in range(a, b + 1, 2))
                        key = (shape, sizes, len(digits), 13 <= len(digits) <= 19 and luhn(digits), good, digits[0] == "0", _edge(tokens[a - 1] if a else None), _edge(tokens[b + 1] if b + 1 < n else None), _cue(tokens, a), any(t[0] == "." and t[1] != "." for t in tokens[a:b]), "")
                        out.append((a, b + 1, key))
                    elif len(digits) > 19:
                        break
        elif kind == "@":
            starts = []
            for s in range(a - 1, max(-1, a - MOST_TOKENS // 2), -1):
                if tokens[s][0] not in _LOCAL:
                    break
                if tokens[s][0] in "a9":
                    starts.append(s)
            dots = 0
            for b in range(a + 1, min(a + MOST_TOKENS // 2, n)):
                k, text = tokens[b]
                if k not in _DOMAIN:
                    break
                dots += k == "."
                if k == "a" and dots and tokens[b - 1][0] == ".":
                    style = "@" if tokens[a][1] == "@" else "(at)" if tokens[a][1].strip()[0] in "([{<" else " @" if "@" in tokens[a][1] else " at "
                    spelt = any(t[0] == "." and t[1] != "." for t in tokens[a + 1 : b])
                    for s in starts:
                        marked = any(t[0] != "a" for t in tokens[s:a])
                        out.append((s, b + 1, (style, marked, int(spelt), text.lower() in ENDINGS, b + 1 < n and tokens[b + 1][0] in "9a.-", dots > 1, _edge(tokens[s - 1] if s else None), _edge(tokens[b + 1] if b + 1 < n else None), _cue(tokens, s), "@")))
    return out


def allowed(key: Key) -> tuple[bool, ...]:
    """Which of TYPES a candidate may be."""
    if key[-1] == "@":
        return (False, True, False, False, False)
    return (False, False, key[0] == "9.9.9.9", 12 <= key[2] <= 19, 7 <= key[2] <= 15 and key[0] != "9.9.9.9")


def features(key: Key) -> list[str]:
    """Whole-span features of a candidate."""
    if key[-1] == "@":
        style, marked, spelt, known, runs_on, deep, left, right, cue, _ = key
        return ["email", f"at name:{style} {marked} {known}", f"at spelt:{style} {spelt}", f"ending:{known}", f"runs on:{runs_on}", "mail left:" + left, "mail right:" + right, "cue:" + cue]
    shape, sizes, digits, check, octets, zero, left, right, cue, spelt, _ = key
    if shape == "9.9.9.9":  # how many digits each part has says little
        return ["dotted", f"dots:{octets} {spelt}", f"dots beside:{octets} {spelt} {left} {right}", f"check:{check} {digits >= 15}", f"dots cue:{cue}"]
    groups = "-".join(map(str, sizes[:7]))
    return ["number", "shape:" + shape, f"digits:{digits}", "groups:" + groups, f"form:{shape} {groups}", "first:" + shape[0], f"check:{check} {digits >= 15}", f"zero:{zero}", f"zero form:{zero} {digits} {shape}", f"cue form:{cue} {len(sizes)} {digits}", f"parts:{min(len(sizes), 6)}", "left:" + left, "right:" + right, "cue:" + cue]


@dataclass
class SemiCrf:
    """weights: by feature, a value for each type; moves: by type and next type."""

    weights: dict[str, np.ndarray] = field(default_factory=dict)
    moves: np.ndarray = field(default_factory=lambda: np.zeros((len(TYPES), len(TYPES))))

    def __post_init__(self):
        self._scores: dict[Key, np.ndarray] = {}

    def score(self, key: Key) -> np.ndarray:
        """Score of each type for a candidate; minus infinity where the type may not stand."""
        found = np.where(allowed(key), 0.0, -np.inf)
        for f in features(key):
            if (w := self.weights.get(f)) is not None:
                found = found + w
        return found

    def plain(self, token: Token) -> float:
        """Score of one token as plain text."""
        w = self.weights.get("O:" + token[0])
        return float(w[0]) if w is not None else 0.0

    def arcs(self, tokens: list[Token], segs: list[Segment]) -> list[list[tuple[int, np.ndarray, list[str]]]]:
        """By end token: (first token, score of each type, features)."""
        out: list[list[tuple[int, np.ndarray, list[str]]]] = [[] for _ in range(len(tokens) + 1)]
        for n, t in enumerate(tokens):
            score = np.full(len(TYPES), -np.inf)
            score[0] = self.plain(t)
            out[n + 1].append((n, score, ["O:" + t[0]]))
        for a, b, key in segs:
            out[b].append((a, self.score(key), features(key)))
        return out

    def forward(self, arcs) -> np.ndarray:
        alpha = np.full((len(arcs), len(TYPES)), -np.inf)
        alpha[0, 0] = 0.0
        for b in range(1, len(arcs)):
            alpha[b] = _lse(np.array([_lse(alpha[a][:, None] + self.moves, 0) + score for a, score, _ in arcs[b]]), 0)
        return alpha

    def backward(self, arcs) -> np.ndarray:
        beta = np.full((len(arcs), len(TYPES)), -np.inf)
        beta[-1] = 0.0
        for b in range(len(arcs) - 1, 0, -1):
            for a, score, _ in arcs[b]:
                beta[a] = np.logaddexp(beta[a], _lse(self.moves + (score + beta[b])[None, :], 1))
        return beta

    def decode(self, tokens: list[Token]) -> list[tuple[int, int, int, float]]:
        """(first token, end token, type, gain over reading its tokens as O) of the best segmentation.

        Scores are kept by key; a stretch without candidates costs its tokens only.
        """
        segs = segments(tokens)
        if not segs:
            return []
        if len(self._scores) > 100_000:
            self._scores.clear()
        moves = self.moves.tolist()
        kinds = range(len(TYPES))
        ending: dict[int, list] = {}
        for a, b, key in segs:
            score = self._scores.get(key)
            if score is None:
                score = self._scores[key] = [(y, float(s)) for y, s in enumerate(self.score(key)) if s > -np.inf]
            ending.setdefault(b, []).append((a, score))
        nothing = float("-inf")
        enter: list[list[tuple[float, int]]] = []  # by place and type: best score before it, and the type there
        best = [0.0, *[nothing] * (len(TYPES) - 1)]
        back: list[list] = [[None] * len(TYPES)]
        for b in range(1, len(tokens) + 1):
            enter.append([max((best[p] + moves[p][y], -p) for p in kinds) for y in kinds])
            now, come = [nothing] * len(TYPES), [None] * len(TYPES)
            before, prev = enter[b - 1][0]
            now[0], come[0] = before + self.plain(tokens[b - 1]), (b - 1, -prev, 0.0)
            for a, score in ending.get(b, ()):
                for y, s in score:
                    before, prev = enter[a][y]
                    if before + s > now[y]:
                        now[y], come[y] = before + s, (a, -prev, s)
            best = now
            back.append(come)
        out, b, y = [], len(tokens), max(kinds, key=lambda k: (best[k], -k))
        while b:
            a, prev, score = back[b][y]
            if y:
                out.append((a, b, y, score - sum(map(self.plain, tokens[a:b]))))
            b, y = a, prev
        return out[::-1]


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    safe = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return (np.log(np.exp(x - safe).sum(axis=axis, keepdims=True)) + safe).squeeze(axis)


def gradient(model: SemiCrf, tokens: list[Token], segs: list[Segment], gold: dict[tuple[int, int], int]) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
    """Log-likelihood of the gold segmentation, and its slope by feature and by move."""
    arcs = model.arcs(tokens, segs)
    alpha, beta = model.forward(arcs), model.backward(arcs)
    log_z = float(_lse(alpha[-1], 0))
    covered = {n for a, b in gold for n in range(a, b)}
    truth = gold | {(n, n + 1): 0 for n in range(len(tokens)) if n not in covered}
    slope: dict[str, np.ndarray] = {}
    move_slope, total = np.zeros_like(model.moves), -log_z
    for b in range(1, len(arcs)):
        for a, score, feats in arcs[b]:
            joint = np.exp(alpha[a][:, None] + model.moves + (score + beta[b])[None, :] - log_z)
            want = -joint.sum(axis=0)
            y = truth.get((a, b))
            if y is not None and (y == 0) == feats[0].startswith("O:"):
                want[y] += 1.0
                total += float(score[y])
            move_slope -= joint
            for f in feats:
                slope[f] = slope[f] + want if f in slope else want
    prev = 0
    for _, y in sorted(truth.items()):
        move_slope[prev, y] += 1.0
        total += float(model.moves[prev, y])
        prev = y
    return total, slope, move_slope


def train(examples: list[tuple[str, list[tuple[int, int, str]]]], passes: int = 4, rate: float = 0.3, decay: float = 1e-4, seed: int = 3) -> SemiCrf:
    """Maximise the conditional likelihood of (text, [(start, end, type)]) by AdaGrad on single texts.

    An example with a span that is no candidate of its type, or without any
    candidate, teaches nothing and is left out.
    """
    model = SemiCrf()
    ready = []
    for text, spans in examples:
        tokens = tokenise(text)
        borders, at = {0: 0}, 0
        for n, (_, t) in enumerate(tokens):
            at += len(t)
            borders[at] = n + 1
        segs = segments(tokens)
        may = {(a, b): allowed(key) for a, b, key in segs}
        gold = {(borders.get(s, -1), borders.get(e, -1)): TYPES.index(k) for s, e, k in spans}
        if segs and all(ab in may and may[ab][y] for ab, y in gold.items()):
            ready.append((tokens, segs, gold))
    squares: dict[str, np.ndarray] = {}
    move_squares = np.full_like(model.moves, 1e-6)
    rng = np.random.default_rng(seed)
    for _ in range(passes):
        for i in rng.permutation(len(ready)):
            _, slope, move_slope = gradient(model, *ready[i])
            for f, g in slope.items():
                w = model.weights.setdefault(f, np.zeros(len(TYPES)))
                g = g - decay * w
                squares[f] = squares.get(f, 1e-6) + g * g
                w += rate * g / np.sqrt(squares[f])
            move_squares += move_slope**2
            model.moves += rate * (move_slope - decay * model.moves) / np.sqrt(move_squares)
    assert all(math.isfinite(float(w.sum())) for w in model.weights.values())
    return model
