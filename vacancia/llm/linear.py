"""A regularized linear classifier over hashed n-grams of tokens, scored for whole batches with numpy.

Features of a token: the token itself, the pair with the next one, and the shapes of three in a row
(a shape is `a` for a word, `A` for one in capitals, `aaa` for one letter again and again, `0` for digits,
else the sign itself). Digits are masked. A line break is a token, so first and last words have features of their own.
"""

from __future__ import annotations

import re
import zlib

import numpy as np

BITS = 18
TOKEN = re.compile(r"\n|[^\W\d_]+|\d+|[^\w\s]|_+")
_P1, _P2, _P3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_MASK, _SHIFT = np.uint64((1 << BITS) - 1), np.uint64(40)
#: Tokens whose hashes a worker remembers.
MEMO = 500_000


class _Codes(dict):
    """Token to (hash << 8 | shape)."""

    def __missing__(self, token: str) -> int:
        if token[0].isdigit():
            norm, shape = "0", 2
        elif token[0].isalpha():
            norm, shape = token.lower(), 1 if len(token) > 1 and token.isupper() else 0
            if len(token) > 2 and norm == norm[0] * len(norm):
                norm, shape = "aaa", 255
        else:
            norm, shape = token[:4], 3 + zlib.crc32(token[:4].encode()) % 250
        code = zlib.crc32(norm.encode()) << 8 | shape
        if len(self) > MEMO:
            self.clear()
        self[token] = code
        return code


_codes = _Codes()


def _index(a: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((a * _P1) >> _SHIFT & _MASK).astype(np.int64)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts of lines: feature indices (tokens x 3), the text of each token, whether it is a break.

    Each text gets a break in front and behind.
    """
    codes: list[int] = []
    sizes = []
    get, find = _codes.__getitem__, TOKEN.findall
    nl = _codes["\n"]
    for t in texts:
        n = len(codes)
        codes.append(nl)
        codes.extend(map(get, find(t)))
        codes.append(nl)
        sizes.append(len(codes) - n)
    c = np.array(codes, np.uint64)
    lex, shape = c >> np.uint64(8), c & np.uint64(255)
    nxt, third = np.roll(lex, -1), (np.roll(shape, -1), np.roll(shape, -2))
    with np.errstate(over="ignore"):
        idx = np.stack([_index(lex + np.uint64(1)), _index(lex * _P2 + nxt * _P3 + np.uint64(2)), _index(shape * _P2 + third[0] * _P3 + third[1] * _P1 + np.uint64(3))], axis=1)
    return idx, np.repeat(np.arange(len(texts)), sizes), c == np.uint64(nl)


class Model:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The weight of each token, the text it is of, whether it is a break."""
        idx, of, stop = features(texts)
        return self.weights[idx[:, 0]] + self.weights[idx[:, 1]] + self.weights[idx[:, 2]], of, stop

    def lines(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The score of each line of each text (split at line breaks), and how many lines each text has."""
        w, of, stop = self.tokens(texts)
        if not len(texts):
            return np.zeros(0), np.zeros(0, int)
        at = np.nonzero(stop)[0]
        cum = np.concatenate([[0.0], np.cumsum(w)])
        score = self.bias + cum[at[1:]] - cum[at[:-1]]  # from a break to the token before the next
        same = of[at[1:]] == of[at[:-1]]
        return score[same], np.bincount(of[at], minlength=len(texts)) - 1


def train(examples: list[str], labels: np.ndarray, weight: np.ndarray | None = None, l2: float = 1e-6, rounds: int = 60, rate: float = 0.5) -> Model:
    """Logistic regression on one-line examples (labels 0 or 1) by Adagrad over the whole batch."""
    idx, of, _ = features(examples)
    keep = np.nonzero(np.append(of[1:] == of[:-1], False))[0]  # the break behind adds nothing
    idx, of = idx[keep], of[keep]
    y = labels.astype(float)
    c = np.ones(len(y)) if weight is None else weight.astype(float)
    c = c / max(c.sum(), 1e-9)
    w, b = np.zeros(1 << BITS), 0.0
    g2, b2, flat, rep = np.full(1 << BITS, 1e-12), 1e-12, idx.ravel(), np.repeat(of, 3)
    for _ in range(rounds):
        z = b + np.bincount(of, w[idx].sum(axis=1), minlength=len(y))
        err = c * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        g = np.bincount(flat, err[rep], minlength=1 << BITS) + l2 * w
        g2 += g * g
        b2 += err.sum() ** 2
        w -= rate * g / np.sqrt(g2)
        b -= rate * err.sum() / np.sqrt(b2)
    return Model(w, b)
