r"""Language-model scoring by subword lattice likelihood (operator 8).

The pieces are those of an existing vocabulary; their ranks there give the prior
scores.  One pass of expectation-maximisation over all training words re-weights
them.  A word's probability is the sum over all its segmentations, by forward
recursion in log space; a text's is the product over its words and one end.

Words are scored once for each distinct word, not for each occurrence.  The most
frequent words (documented bound: FREQUENT, cut between two counts) go to the map tasks, which sum them;
the occurrences of all others meet their word in a join, so no word has a large
share of the rows that are shuffled.

Defined cases: null and empty texts are one end; without training texts the
counts are 0 and the prior scores hold; characters outside the vocabulary are
spelt in byte pieces; a null doc_id counts as the empty string when folds are
drawn; repeated rows are each scored and each counted; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm.lineage import stored
from larkspan.llm.textops import bytes_of, slices

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
FOLDS, HELD_OUT, FREQUENT = 7, 2, 200_000
#: Weight of the prior scores against the training words, as a number of pieces.
PRIOR = 10_000.0
_MARK, _END = "▁", ""
#: Stands after each word in flat arrays of characters; words hold no white space.
_NONE = " "
_FLUSH = 400_000


def prior_scores(path: str = VOCABULARY) -> dict[str, float]:
    """Natural log probability of each piece of a vocabulary file: by Zipf's law on its rank there.  Byte pieces are named <0xNN>; the end is the empty string."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain, others = [], []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            others.append(piece)
        elif not (model.is_control(i) or model.is_unknown(i)) and _MARK not in piece[1:]:
            plain.append((-model.get_score(i), piece))
    ranked = [*(p for _, p in sorted(plain)), *others]
    total = sum(1 / (r + 2.7) for r in range(len(ranked) + 1))
    scores = {p: -math.log((r + 2.7) * total) for r, p in enumerate(ranked)}
    scores[_END] = -math.log((len(ranked) + 2.7) * total)
    return scores


class Lattice:
    """All segmentations of words into scored pieces, for many words in step.

    A word of n characters has n + 1 places in flat arrays.  Pieces are found by
    walking a trie from all places at once; the recursions go over places by their
    distance from the start of their word.
    """

    def __init__(self, scores: dict[str, float]):
        self.end = scores[_END]
        self.byte = np.array([scores[f"<0x{b:02X}>"] for b in range(256)])
        self.pieces = [p for p in scores if p and not (p.startswith("<0x") and len(p) == 6)]
        self.scores = np.array([scores[p] for p in self.pieces])
        nodes: dict[tuple[int, str], int] = {}
        named = {0: -1}
        for i, piece in enumerate(self.pieces):
            at = 0
            for c in piece:
                at = nodes.setdefault((at, c), len(nodes) + 1)
            named[at] = i
        keys = np.array([(a << 21) | ord(c) for a, c in nodes], np.int64)
        order = np.argsort(keys)
        self.keys, self.child = keys[order], np.array(list(nodes.values()), np.int64)[order]
        self.named = np.array([named.get(i, -1) for i in range(len(nodes) + 1)], np.int64)

    def arcs(self, words: list[str]):
        """(first place of each word, distance of each place, characters, start, end, piece or -1 for bytes, score) of all arcs."""
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        first = np.cumsum(sizes) - sizes
        chars = np.frombuffer((_NONE.join(words) + _NONE).encode("utf-32-le"), np.uint32).astype(np.int64)
        place = np.arange(len(chars)) - np.repeat(first, sizes)
        at = np.arange(len(chars))
        node, found, n = np.zeros(len(chars), np.int64), [], 0
        spelt = chars != ord(_NONE)
        while len(at):
            key = (node << 21) | chars[at + n]
            i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = (self.keys[i] == key) & spelt[at + n]
            at, node, n = at[ok], self.child[i[ok]], n + 1
            piece = self.named[node]
            is_piece = piece >= 0
            found.append((at[is_piece], at[is_piece] + n, piece[is_piece]))
            if n == 1:
                bytewise = spelt.copy()
                bytewise[at[is_piece]] = False
        low = np.flatnonzero(bytewise)
        kinds, of = np.unique(chars[low], return_inverse=True)
        spellings = np.array([self.byte[list(chr(c).encode())].sum() for c in kinds.tolist()])
        start, end, piece = (np.concatenate(x) for x in zip(*found, (low, low + 1, np.full(len(low), -1)), strict=True))
        score = np.concatenate([self.scores[piece[: len(piece) - len(low)]], spellings[of] if len(low) else np.empty(0)])
        return first, place, chars, start, end, piece, score

    @staticmethod
    def _sums(n: int, place: np.ndarray, of: np.ndarray, other: np.ndarray, score: np.ndarray, back: bool) -> np.ndarray:
        """Log of the total over all ways to each place `of` arcs from their `other` place, by rising (back: falling) distance."""
        out = np.zeros(n)
        step = place[of]
        order = np.lexsort((of, -step if back else step))
        of, other, score, step = of[order], other[order], score[order], step[order]
        new = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        many = np.diff([*new, len(of)])
        turn = np.flatnonzero(np.concatenate([[True], step[new][1:] != step[new][:-1]]))
        for g, h in zip(turn.tolist(), [*turn[1:].tolist(), len(new)], strict=True):
            low, high = new[g], new[h - 1] + many[h - 1]
            ways = out[other[low:high]] + score[low:high]
            top = np.maximum.reduceat(ways, new[g:h] - low)
            out[of[new[g:h]]] = top + np.log(np.add.reduceat(np.exp(ways - np.repeat(top, many[g:h])), new[g:h] - low))
        return out

    def log_probabilities(self, words: list[str]) -> np.ndarray:
        """Natural log of the marginal probability of each word; of the end for the empty one."""
        out = np.full(len(words), self.end)
        for at in _chunks(words):
            first, place, chars, start, end, _, score = self.arcs([_MARK + words[i] for i in at])
            into = self._sums(len(chars), place, end, start, score, False)
            out[at] = into[[*(first[1:] - 1), len(chars) - 1]]
        return out

    def log_probability(self, word: str) -> float:
        return float(self.log_probabilities([word])[0])

    def expect(self, word: str, times: float, into: dict[str, float]) -> None:
        """Add to `into` how often each piece is expected in `times` occurrences of a word."""
        for piece, x in self.expected([word], [times]).items():
            into[piece] = into.get(piece, 0.0) + x

    def expected(self, words: list[str], times: list[float]) -> dict[str, float]:
        """How often each piece is expected in `times` occurrences of each word."""
        found, spelt = np.zeros(len(self.pieces)), np.zeros(256)
        for at in _chunks(words):
            first, place, chars, start, end, piece, score = self.arcs([_MARK + words[i] for i in at])
            into = self._sums(len(chars), place, end, start, score, False)
            rest = self._sums(len(chars), place, start, end, score, True)
            of = np.repeat(np.arange(len(at)), np.diff([*first, len(chars)]))[start]
            share = np.exp(into[start] + score + rest[end] - rest[first][of]) * np.array([times[i] for i in at], float)[of]
            plain = piece >= 0
            found += np.bincount(piece[plain], share[plain], len(found))
            for c, x in zip(*_totals(chars[start[~plain]], share[~plain]), strict=True):
                np.add.at(spelt, list(chr(c).encode()), x)
        out = {self.pieces[i]: float(found[i]) for i in np.flatnonzero(found)} | {f"<0x{i:02X}>": float(spelt[i]) for i in np.flatnonzero(spelt)}
        ends = sum(n for w, n in zip(words, times, strict=True) if not w)
        return out | {_END: float(ends)} if ends else out


def _totals(keys: np.ndarray, values: np.ndarray) -> tuple[list[int], list[float]]:
    kinds, of = np.unique(keys, return_inverse=True)
    return kinds.tolist(), np.bincount(of, values, len(kinds)).tolist()


def _chunks(words: list[str], limit: int = 200_000):
    """Indices of the words that aren't empty, in lists of about `limit` characters, words of like length together."""
    out, size = [], 0
    for i in sorted(range(len(words)), key=lambda i: len(words[i])):
        if not words[i]:
            continue
        if out and size + len(words[i]) > limit:
            yield out
            out, size = [], 0
        out.append(i)
        size += len(words[i])
    if out:
        yield out


def fold_of(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def _split(batch: pa.RecordBatch) -> list[list[bytes]]:
    data, rows = bytes_of(batch.column("text"))
    raw = data.tobytes()
    return [raw[s:e].lower().split() for s, e in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True)]


def _count(batches):
    """Map stage: word, how often in training texts (0 for words of held-out texts only)."""
    seen: Counter = Counter()

    def rows():
        out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()).cast(pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "c"])
        seen.clear()
        return out

    for b in slices(batches, "text"):
        for words, held in zip(_split(b), b.column("held_out").to_pylist(), strict=True):
            if held:
                for w in words:
                    seen.setdefault(w, 0)
            else:
                seen.update(words)
                seen[b""] += 1
        if len(seen) > _FLUSH:
            yield rows()
    yield rows()


def _expect(scores):
    def run(batches):
        lattice, found = Lattice(scores.value), Counter()
        for b in batches:
            found.update(lattice.expected(b.column("word").to_pylist(), b.column("c").to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.float64())], names=["piece", "times"])

    return run


def _probabilities(scores):
    def run(batches):
        lattice = Lattice(scores.value)
        for b in batches:
            found = lattice.log_probabilities(b.column("word").to_pylist()) / math.log(10)
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("c"), pa.array(found)], names=["word", "c", "model"])

    return run


_SUMS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("word", pa.string()), ("n", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("model", pa.float64())])


def _sum(frequent):
    """Map stage: a row per text with the sums over its frequent words and its end, and a row per other word of it.  A text's own row has a `word` that no word equals."""

    def run(batches):
        index, known, base, model = frequent.value
        at = TaskContext.get().partitionId() << 40
        for b in slices(batches, "text"):
            split = [[*words, b""] for words in _split(b)]
            counts = np.array([len(x) for x in split])
            words = list(chain.from_iterable(split))
            found = np.fromiter(map(index.get, words, repeat(-1)), np.int64, len(words))
            first = np.cumsum(counts) - counts
            sums = [np.add.reduceat(np.where(found >= 0, x[found], 0), first) for x in (known, base, model)]
            docs, held, rows = b.column("doc_id"), b.column("held_out"), at + np.arange(b.num_rows)
            at += b.num_rows
            marks = pa.array([f" {r}" for r in rows.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(rows), docs, held, marks, pa.array(counts), *(pa.array(s, t) for s, t in zip(sums, (pa.int64(), pa.float64(), pa.float64()), strict=True))], schema=_SUMS)
            rest = np.flatnonzero(found < 0)
            if len(rest):
                of = np.repeat(np.arange(len(counts)), counts)[rest]
                none = pa.array(np.zeros(len(rest)))
                yield pa.RecordBatch.from_arrays([pa.array(rows[of]), docs.take(pa.array(of)), held.take(pa.array(of)), pa.array([words[i] for i in rest.tolist()], pa.binary()).cast(pa.string()), pa.nulls(len(rest), pa.int64()), pa.array(np.zeros(len(rest), np.int64)), none, none], schema=_SUMS)

    return run


def trained_scores(words: DataFrame, prior: dict[str, float]) -> dict[str, float]:
    """Piece scores after one expectation-maximisation pass over (word, c); the result has one row per piece of the vocabulary at most."""
    shared = words.sparkSession.sparkContext.broadcast(prior)
    found = words.filter("c > 0").mapInArrow(_expect(shared), "piece string, times double").groupBy("piece").agg(F.sum("times").alias("times")).collect()
    times = {r.piece: r.times for r in found}
    total = sum(times.values()) + PRIOR
    return {p: math.log((times.get(p, 0.0) + PRIOR * math.exp(s)) / total) for p, s in prior.items()}


def score(docs: DataFrame, vocabulary: str = VOCABULARY, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of `docs` (doc_id, text)."""
    context = docs.sparkSession.sparkContext
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (fold_of(F.col("doc_id")) == HELD_OUT).alias("held_out"))
    words = stored(docs.mapInArrow(_count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c")))
    n, v = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, True))).first()
    scores = trained_scores(words, prior_scores(vocabulary))
    shared = context.broadcast(scores)
    size = F.floor(16 * F.log2(F.col("c") + 1))  # at most 1,024 sizes
    cut, many = 0, 0
    for r in sorted(words.groupBy(size.alias("size")).count().collect(), reverse=True):
        cut, many = r["size"], many + r["count"]
        if many > frequent:
            cut += 1
            break
    often = (size >= cut) | (F.col("word") == _END)
    top = words.filter(often).mapInArrow(_probabilities(shared), "word string, c long, model double").toPandas()  # `frequent` rows and one at most
    if not (top["word"] == _END).any():
        top.loc[len(top)] = (_END, 0, scores[_END] / math.log(10))
    index = {w.encode(): i for i, w in enumerate(top["word"])}
    c, model = top["c"].to_numpy(np.int64), top["model"].to_numpy(float)
    sums = docs.mapInArrow(_sum(context.broadcast((index, (c > 0).astype(np.int64), np.log10((c + 1) / (n + v + 1)), model))), "row long, doc_id long, held_out boolean, word string, n long, known long, base double, model double")
    rare = words.filter(~often).mapInArrow(_probabilities(shared), "word string, c long, model double").select("word", "c", F.col("model").alias("rare_model"))
    met = sums.join(rare, "word", "left")
    own = F.col("n").isNotNull()
    base = F.when(own, F.col("base")).otherwise(F.log10((F.col("c") + 1) / F.lit(float(n + v + 1))))
    return met.groupBy("row", "doc_id", "held_out").agg(
        F.sum("n").alias("n_tokens"),
        F.sum(F.when(own, F.col("known")).otherwise((F.col("c") > 0).cast("long"))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        F.sum(base).alias("base_score"),
        F.sum(F.when(own, F.col("model")).otherwise(F.col("rare_model"))).alias("score"),
    ).drop("row")


def op8_lattice_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
