r"""Secret scan by character Markov models (operator 5).

Base patterns find assignments, access keys and long hexadecimal runs.  The
method scores every other run of token characters of MIN_RUN or more: a Markov
model of random strings against one of ordinary identifiers and words, both
trained from labelled samples, compared by log-likelihood ratio per character.  A run that
falls short as a whole is searched for the stretches of MIN_RUN characters or more
that don't: keys inside paths and compound names.  Runs are found over bytes with numpy; only texts that hold a candidate are
searched with patterns.

Defined cases: null and empty texts have no spans; of a run that touches base spans
the parts beside them are scored; runs may have any length; repeated rows are
scanned alike; a null doc_id is returned as null; other columns are not read.
"""

from __future__ import annotations

import base64
import math
import random
import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from larkspan.llm.spans import Span, digest, joined
from larkspan.llm.textops import bytes_of, slices

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
MIN_RUN = 20
#: Log-likelihood ratio per character from which on a run is a secret.
THRESHOLD = 0.6
_SYMBOLS = string.ascii_letters + string.digits + "+/_=-"
_CODE = {c: i for i, c in enumerate(_SYMBOLS)}


def labelled_samples(n: int = 4000, seed: int = 5) -> list[tuple[str, int]]:
    """(text, 1 for random strings and 0 for ordinary ones), drawn by rule: base64, hex and alphanumeric keys against identifiers, paths, long words and numbers."""
    rng = random.Random(seed)
    syllables = "al an ar as at be ber ca ch co con de der di ed el en ent er es est ge gen heit ing ion keit la le lich ly ma ment mi mo na ne no on or ou par pe pre re ri ro sa schaft se si st str ta te ter th ti tion to tra un und ung us ver vi wa wi zeit".split()
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    out = []
    for _ in range(n):
        kind = rng.randrange(4)
        size = rng.randint(20, 48)
        if kind == 0:
            text = base64.b64encode(rng.randbytes(size)).decode()[:size]
        elif kind == 1:
            text = "".join(rng.choices("0123456789abcdef", k=size))
        elif kind == 2:
            text = "".join(rng.choices(string.ascii_letters + string.digits, k=size))
        else:
            text = "".join(rng.choices(string.ascii_uppercase + string.digits, k=size))
        out.append((text, 1))
        kind, parts = rng.randrange(6), [word() for _ in range(rng.randint(2, 6))]
        if kind == 0:
            text = "_".join(parts)
        elif kind == 1:
            text = parts[0] + "".join(p.capitalize() for p in parts[1:])
        elif kind == 2:
            text = "/".join(parts)
        elif kind == 3:
            text = "-".join(parts) + rng.choice(["", f"-{rng.randint(1, 2030)}", f"_v{rng.randint(1, 9)}"])
        elif kind == 4:
            text = rng.choice([str.lower, str.capitalize, str.upper])("".join(parts))
        else:
            text = rng.choice(["=", "-", "_", "+", "/"]) * rng.randint(20, 60)
        out.append((text, 0))
    return out


def train(samples: list[tuple[str, int]], smooth: float = 0.2) -> np.ndarray:
    """ratio[a, b]: log P(b | a) under random strings less that under ordinary ones; row 0 is the start."""
    counts = np.full((2, len(_SYMBOLS) + 1, len(_SYMBOLS)), smooth)
    for text, label in samples:
        codes = [_CODE[c] for c in text if c in _CODE]
        for a, b in zip([0, *(c + 1 for c in codes)], codes, strict=False):
            counts[label, a, b] += 1
    p = np.log(counts / counts.sum(axis=2, keepdims=True))
    return p[1] - p[0]


def ratio(model: np.ndarray, text: str) -> float:
    """Log-likelihood ratio per character of a run of token characters."""
    codes = [_CODE[c] for c in text]
    return float(model[[0, *(c + 1 for c in codes[:-1])], codes].sum()) / len(codes)


def base_spans(text: str) -> list[Span]:
    """Base spans by start, then kind as listed."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def beside(start: int, end: int, base: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What `base` (sorted, none inside another) leaves of start..end, in parts of MIN_RUN or more."""
    out = []
    for s, e in base:
        if s < end and e > start:
            out.append((start, s))
            start = max(start, e)
    return [(s, e) for s, e in [*out, (start, end)] if e - s >= MIN_RUN]


def stretches(model: np.ndarray, text: str, threshold: float = THRESHOLD) -> list[tuple[int, int]]:
    """Where secrets are in a run of token characters: all of it, or else its best stretches with `threshold` per character, none over another."""
    if ratio(model, text) >= threshold:
        return [(0, len(text))]
    codes = np.array([_CODE[c] for c in text])
    total = np.concatenate([[0.0], np.cumsum(model[np.concatenate([[0], codes[:-1] + 1]), codes] - threshold)])
    out, todo = [], [(0, len(text))]
    while todo:
        low, high = todo.pop()
        if high - low < MIN_RUN:
            continue
        t = total[low : high + 1]
        gain = t[MIN_RUN:] - np.minimum.accumulate(t[:-MIN_RUN])
        end = int(gain.argmax())
        if gain[end] >= 0:
            start = int(t[: end + 1].argmin())
            out.append((low + start, low + end + MIN_RUN))
            todo += [(low, low + start), (low + end + MIN_RUN, high)]
    return sorted(out)


def all_spans(text: str, base: list[Span], model: np.ndarray, threshold: float = THRESHOLD) -> list[Span]:
    taken, more, at = merged(base), [], 0
    for m in RUN.finditer(text):
        while at < len(taken) and taken[at][1] <= m.start():
            at += 1
        near = at
        while near < len(taken) and taken[near][0] < m.end():
            near += 1
        for s, e in beside(*m.span(), taken[at:near]):
            more += [("markov", s + x, s + y) for x, y in stretches(model, text[s:e], threshold)]
    return sorted([*base, *more], key=lambda x: (x[1], KINDS.index(x[0])))


def merged(spans: list[Span]) -> list[tuple[int, int]]:
    """The characters of `spans` as (start, end), sorted and apart."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(x[1:] for x in spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _runs_from(flags: np.ndarray, rows: np.ndarray, least: int) -> np.ndarray:
    """For each row, whether it has `least` flagged bytes in a row."""
    total = np.concatenate([[0], np.cumsum(flags)])
    full = np.flatnonzero(total[least:] - total[:-least] == least) if len(flags) >= least else np.empty(0, np.int64)
    row = np.searchsorted(rows, full, side="right") - 1
    inside = full + least <= rows[row + 1]
    out = np.zeros(len(rows) - 1, bool)
    out[row[inside]] = True
    return out


_TOKEN = np.zeros(256, bool)
_TOKEN[list(_SYMBOLS.encode())] = True
_KEYS = (b"passw", b"secret", b"token", b"apikey", b"api_key", b"akia")


def _scan(model, threshold: float):
    def run(batches):
        for b in slices(batches, "text"):
            data, rows = bytes_of(b.column("text"))
            raw, long = data.tobytes(), _runs_from(_TOKEN[data], rows, MIN_RUN)
            lower = raw.lower()
            has_key = any(k in lower for k in _KEYS)
            out = []
            for i in range(b.num_rows):
                s, e = int(rows[i]), int(rows[i + 1])
                base, spans = [], []
                if long[i] or has_key and any(lower.find(k, s, e) >= 0 for k in _KEYS):
                    text = raw[s:e].decode()
                    base = base_spans(text)
                    spans = all_spans(text, base, model.value, threshold)
                n = [sum(x[0] == k for x in base) for k in KINDS[:3]]
                out.append((*n, digest(base), joined(spans)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([x[j] for x in out], t) for j, t in enumerate([pa.int64()] * 3 + [pa.string()] * 2))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return run


def find_secrets(docs: DataFrame, samples: list[tuple[str, int]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row of `docs` (doc_id, text); `samples` are labelled strings (1: secret)."""
    model = docs.sparkSession.sparkContext.broadcast(train(samples or labelled_samples()))
    cast = docs.selectExpr("cast(doc_id as bigint) AS doc_id", "cast(text as string) AS text")
    return cast.mapInArrow(_scan(model, threshold), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op5_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
