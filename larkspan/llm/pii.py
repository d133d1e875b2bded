r"""Personal data by patterns and a linear-chain conditional random field (operator 7).

Base patterns find e-mail addresses, IP addresses, card and phone numbers.  The
method labels words by a CRF over word-shape features of a word and its two
neighbours, trained from a small labelled table and decoded by Viterbi, all
sequences of a batch in step.  A sequence is a stretch of words in which marked
words (with a digit or an at sign) are at most GAP plain words apart, with GAP
plain words on either side; no text is cut off.

A labelled span is kept if its digits fit its kind (cards: Luhn).  The labels have
no begin mark, so neighbouring items of one kind are one run: it is cut at
separators where every part fits, and a run that doesn't fit as one is cut into
the parts that cover most of it, as even as can be.

Defined cases: null and empty texts have no spans; a labelled span that touches a
base span is left to the base; repeated rows are scanned alike; a null doc_id is
returned as null; other columns are not read.
"""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from larkspan.llm.spans import Span, apart, digest, joined
from larkspan.llm.textops import Words, slices

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)
GAP = 3
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# a digit before would have begun the match: starts inside a run of digits match no more than its first
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")


def luhn(digits: str) -> bool:
    return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def _emails(text: str) -> list[Span]:
    """As the pattern finds them, from each at sign outwards: linear in the text."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and not _NOT_LOCAL.match(text[start - 1]):
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append(("email", start, m.end()))
        done = m.end() if m else at + 1
        at = text.find("@", done)
    return out


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """Base spans by kind as listed, then start."""
    out = _emails(text)
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in _CARD.finditer(text) if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    return out + [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]


#: Features of a word: sizes of (digits, dots, at sign, plus, parenthesis, dash, letters).
_SIZES = (7, 4, 2, 2, 2, 2, 2)
_BUCKET = np.array([0, 1, 1, 2, 3, 3, 4, 4, 4, 4, 4, 4, 4, 5, 5, 5, 5, 5, 5, 5, 6])


def features(w: Words, only: np.ndarray) -> np.ndarray:
    """A row of feature values for each word of `only`."""
    s, e = w.starts[only], w.ends[only]
    if not len(only):
        return np.empty((0, len(_SIZES)), np.int64)

    def count(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[e] - total[s]

    d = w.data
    some = lambda x: np.minimum(count(x), 1)
    letter = ((d | 32) >= 97) & ((d | 32) <= 122) | (d >= 128)
    return np.stack([_BUCKET[np.minimum(count((d >= 48) & (d <= 57)), 20)], np.minimum(count(d == 46), 3), some(d == 64), some(d == 43), some((d == 40) | (d == 41)), some(d == 45), some(letter)], axis=1)


def labelled_table(n: int = 600, seed: int = 7) -> list[list[tuple[str, int]]]:
    """Sentences of (word, label index), drawn by rule: personal data between plain words, years, prices, versions and counts."""
    rng = random.Random(seed)
    plain = "the a call me at on or mail to from our number is today card address host ping write us order of for and by reach him her desk office".split()
    number = lambda n: "".join(rng.choices("0123456789", k=n))
    octet = lambda: str(rng.randint(0, 255))
    out = []
    for _ in range(n):
        words = [(x, 0) for x in rng.choices(plain, k=rng.randint(1, 5))]
        kind = rng.randrange(9)
        if kind == 0:
            words.append((f"{rng.choice(plain)}.{number(2)}@{rng.choice(plain)}{number(1)}.example.com", 1))
        elif kind == 1:
            words.append((".".join(octet() for _ in range(4)), 2))
        elif kind == 2:
            words += [(number(4), 3) for _ in range(4)]
        elif kind == 3:
            words.append((rng.choice([number(16), "-".join(number(4) for _ in range(4))]), 3))
        elif kind == 4:
            words += [(f"+{rng.randint(1, 99)}", 4), (f"({number(3)})", 4), (f"{number(3)}-{number(4)}", 4)]
        elif kind == 5:
            words += rng.choice([[(f"({number(3)})", 4), (f"{number(3)}-{number(4)}", 4)], [(f"{number(3)}-{number(3)}-{number(4)}", 4)], [(f"+{number(11)}", 4)]])
        else:
            words += rng.choice([[(number(4), 0)], [(f"{number(1)}.{number(1)}.{number(1)}", 0)], [(f"{number(2)}.{number(2)}", 0)], [(number(rng.randint(1, 8)), 0)], [(f"{number(4)}-{number(2)}-{number(2)}", 0)], [(f"({number(2)})", 0)], [(number(2), 0), (number(3), 0)], [(f"{rng.choice(plain)}-{number(2)}", 0)], [(f"@{rng.choice(plain)}", 0)], [("+", 0)]])
        words += [(x, 0) for x in rng.choices(plain, k=rng.randint(1, 4))]
        out.append(words)
    return out


_OFFSETS = np.cumsum([0, *_SIZES])[:-1]
_WIDTH = sum(_SIZES)


def _padded(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Indices of the active features of a word, the word before and the one after; _WIDTH in each third stands for none."""
    own = x + _OFFSETS
    n = len(x)
    none = np.full((1, x.shape[1]), _WIDTH)
    before, after = np.concatenate([none, own[:-1]])[:n], np.concatenate([own[1:], none])[:n]
    starts = np.zeros(n + 1, bool)
    starts[first] = True
    before[starts[:n]] = _WIDTH
    after[starts[1:] | (np.arange(n) == n - 1)] = _WIDTH
    return np.concatenate([own, before + _WIDTH + 1, after + 2 * (_WIDTH + 1)], axis=1)


def train(table: list[list[tuple[str, int]]] | None = None, steps: int = 120, rate: float = 0.2, decay: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """(emission weights by feature and label, transition weights): gradient steps (Adam) on the conditional log-likelihood, summed by forward-backward over all sentences in step."""
    table = table or labelled_table()
    w = Words(pa.array([" ".join(x for x, _ in s) for s in table]))
    gold = np.array([y for s in table for _, y in s])
    if len(gold) != len(w):
        raise ValueError("a labelled word holds white space")
    feats = _padded(features(w, np.arange(len(w))), w.first[:-1])
    k, n, longest = len(LABELS), len(table), int(w.counts.max())
    place = np.full((n, longest), len(w))
    for i in range(n):
        place[i, : w.counts[i]] = np.arange(w.first[i], w.first[i + 1])
    live = place < len(w)
    theta = [np.zeros((3 * (_WIDTH + 1), k)), np.zeros((k, k))]
    moments = [[np.zeros_like(t) for t in theta] for _ in range(2)]
    pair = np.zeros((k, k))
    inside = np.flatnonzero(w.row[1:] == w.row[:-1])
    np.add.at(pair, (gold[inside], gold[inside + 1]), 1)
    lse = lambda a, axis: (m := a.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis=axis))
    for step in range(1, steps + 1):
        emit = np.concatenate([theta[0][feats].sum(axis=1), np.zeros((1, k))])
        e, t = emit[place], theta[1]
        a, b = np.zeros((longest, n, k)), np.zeros((longest, n, k))
        a[0] = e[:, 0]
        for j in range(1, longest):
            a[j] = np.where(live[:, j, None], e[:, j] + lse(a[j - 1][:, :, None] + t[None], 1), a[j - 1])
        for j in range(longest - 2, -1, -1):
            b[j] = np.where(live[:, j + 1, None], lse(t[None] + (e[:, j + 1] + b[j + 1])[:, None, :], 2), 0.0)
        z = lse(a[-1], 1)
        p = np.exp(a + b - z[None, :, None]) * live.T[:, :, None]
        gap = np.zeros((len(w) + 1, k))
        gap[place.T] -= p
        gap = gap[:-1]
        gap[np.arange(len(w)), gold] += 1
        grad = [np.zeros_like(theta[0]), pair.copy()]
        for y in range(k):
            grad[0][:, y] = np.bincount(feats.ravel(), np.repeat(gap[:, y], feats.shape[1]), len(grad[0]))
        for j in range(1, longest):
            x = np.exp(a[j - 1][:, :, None] + t[None] + (e[:, j] + b[j])[:, None, :] - z[:, None, None])
            grad[1] -= (x * live[:, j, None, None]).sum(axis=0)
        for i in range(2):
            g = grad[i] / n - decay * theta[i]
            moments[0][i] = 0.9 * moments[0][i] + 0.1 * g
            moments[1][i] = 0.999 * moments[1][i] + 0.001 * g * g
            theta[i] = theta[i] + rate * (moments[0][i] / (1 - 0.9**step)) / (np.sqrt(moments[1][i] / (1 - 0.999**step)) + 1e-8)
    return theta[0], theta[1]


def viterbi(emit: np.ndarray, first: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The best labels of sequences that begin at `first`, all in step, the longest first."""
    sizes = np.diff([*first, len(emit)])
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = first[order], sizes[order]
    best = emit.copy()
    back = np.zeros(emit.shape, np.int8)
    for j in range(1, int(sizes[0]) if len(sizes) else 0):
        at = starts[: np.searchsorted(-sizes, -j)] + j
        ways = best[at - 1][:, :, None] + moves[None]
        back[at] = ways.argmax(axis=1)
        best[at] += ways.max(axis=1)
    out = np.zeros(len(emit), np.int64)
    out[starts + sizes - 1] = best[starts + sizes - 1].argmax(axis=1)
    for j in range(int(sizes[0]) - 1 if len(sizes) else 0, 0, -1):
        at = starts[: np.searchsorted(-sizes, -j)] + j
        out[at - 1] = back[at, out[at]]
    return out


def label(w: Words, model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A label for every word."""
    out = np.zeros(len(w), np.int64)
    d = w.data
    total = np.concatenate([[0], np.cumsum((d >= 48) & (d <= 57) | (d == 64))])
    marked = np.flatnonzero(total[w.ends] - total[w.starts])
    if not len(marked):
        return out
    near = np.unique((marked[:, None] + np.arange(-GAP, GAP + 1)).clip(0, len(w) - 1))
    first = np.flatnonzero(np.concatenate([[True], (np.diff(near) > 1) | (w.row[near[1:]] != w.row[near[:-1]])]))
    emit = model[0][_padded(features(w, near), first)].sum(axis=1)
    out[near] = viterbi(emit, first, model[1])
    return out


_EDGE = ".,;:!?\"'`|<>[]{}#*$%&"


def _fits(kind: str, digits: str) -> bool:
    return 13 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 7 <= len(digits) <= 15


def _parts(kind: str, words: list[str]) -> list[tuple[int, int]]:
    """A run of words labelled card or phone as items (first word, word after the last)."""
    digits = [_digits(x) for x in words]
    ends = [0, *(i + 1 for i, x in enumerate(words[:-1]) if x[-1] in ",;|"), len(words)]
    cut = list(zip(ends, ends[1:], strict=False))
    if all(_fits(kind, "".join(digits[i:j])) for i, j in cut):
        return cut
    if _fits(kind, "".join(digits)):
        return [(0, len(words))]
    best: list[tuple] = [(0, 0, None)]  # up to each word: digits left out, sum of squares, first word of the item that ends here
    for j in range(1, len(words) + 1):
        ways = [(best[j - 1][0] + len(digits[j - 1]), best[j - 1][1], None)]
        own = ""
        for i in range(j - 1, -1, -1):
            own = digits[i] + own
            if len(own) > 19:
                break
            if digits[i] and _fits(kind, own):
                ways.append((best[i][0], best[i][1] + len(own) ** 2, i))
        best.append(min(ways, key=lambda x: x[:2]))
    out, j = [], len(words)
    while j:
        if best[j][2] is None:
            j -= 1
        else:
            out.append((best[j][2], j))
            j = best[j][2]
    return out[::-1]


def _labelled_spans(text: str, raw: bytes, w: Words, low: int, labels: np.ndarray) -> list[Span]:
    """Items among the runs of one label in a text whose words begin with word `low`, in code points, without punctuation at the edges."""
    out, i = [], 0
    seen, chars = int(w.rows[w.row[low]]) if len(labels) else 0, 0
    while i < len(labels):
        j = i
        while j + 1 < len(labels) and labels[j + 1] == labels[i]:
            j += 1
        kind = LABELS[labels[i]]
        parts: list[tuple[int, int]] = []
        if kind in ("card", "phone"):
            parts = _parts(kind, [raw[w.starts[low + x] : w.ends[low + x]].decode() for x in range(i, j + 1)])
        elif labels[i]:
            parts = [(x, x + 1) for x in range(j + 1 - i)]  # an address is one word
        for first, after in parts:
            s, e = int(w.starts[low + i + first]), int(w.ends[low + i + after - 1])
            chars += len(raw[seen:s].decode())
            seen, start = s, chars
            found = text[start : start + len(raw[s:e].decode())]
            trimmed = found.lstrip(_EDGE)
            start += len(found) - len(trimmed)
            trimmed = trimmed.rstrip(_EDGE)
            n = len(_digits(trimmed))
            if trimmed and (kind == "email" and "@" in trimmed[1:-1] or kind == "ip" and re.fullmatch(_IP, trimmed) and n <= 12 or kind in ("card", "phone") and _fits(kind, _digits(trimmed))):
                out.append((kind, start, start + len(trimmed)))
        i = j + 1
    return out


def _scan(model):
    def run(batches):
        for b in slices(batches, "text"):
            w = Words(b.column("text"))
            labels, raw = label(w, model.value), w.data.tobytes()
            sign = np.concatenate([[0], np.cumsum((w.data >= 48) & (w.data <= 57) | (w.data == 64))])
            marked = sign[w.rows[1:]] > sign[w.rows[:-1]]
            out = []
            for i in range(b.num_rows):
                base, spans = [], []
                if marked[i]:
                    text, low, high = raw[w.rows[i] : w.rows[i + 1]].decode(), int(w.first[i]), int(w.first[i + 1])
                    base = base_spans(text)
                    more = apart(_labelled_spans(text, raw, w, low, labels[low:high]), base) if labels[low:high].any() else []
                    spans = sorted([*base, *more], key=lambda x: (KINDS.index(x[0]), x[1]))
                n = [sum(x[0] == k for x in base) for k in KINDS]
                out.append((*n, digest(base), joined(spans)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([x[j] for x in out], t) for j, t in enumerate([pa.int64()] * 4 + [pa.string()] * 2))], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return run


def find_personal(docs: DataFrame, table: list[list[tuple[str, int]]] | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every row of `docs` (doc_id, text); `table` holds labelled sentences."""
    model = docs.sparkSession.sparkContext.broadcast(train(table))
    cast = docs.selectExpr("cast(doc_id as bigint) AS doc_id", "cast(text as string) AS text")
    return cast.mapInArrow(_scan(model), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def op7_crf_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal(spark.read.parquet(f"{sf_dir}/documents.parquet"))
