import math
import zlib
from collections import Counter

import pytest

from larkspan.llm.lattice import Lattice, op8_lattice_score, prior_scores, score

SPACE = " \t\n\x0b\x0c\r"


def words_of(text):
    for s in SPACE[1:]:
        text = text.replace(s, " ")
    return [w.translate({i: i + 32 for i in range(65, 91)}) for w in text.split(" ") if w]


def base(rows):
    counts = Counter()
    for d, t in rows:
        if zlib.crc32(str("" if d is None else d).encode()) % 7 != 2:
            counts.update([*words_of(t or ""), ""])
    n, v = sum(counts.values()), len(counts)
    out = []
    for d, t in rows:
        tokens = [*words_of(t or ""), ""]
        out.append((d, zlib.crc32(str("" if d is None else d).encode()) % 7 == 2, len(tokens), sum(counts[w] > 0 for w in tokens), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens)))
    return out


def segmentations(text, pieces):
    if not text:
        yield 1.0
    for n in range(1, len(text) + 1):
        if text[:n] in pieces:
            for rest in segmentations(text[n:], pieces):
                yield pieces[text[:n]] * rest


def same(got, want):
    for g, w in zip(sorted(got, key=repr), sorted(want, key=repr), strict=True):
        assert tuple(g)[:5] == w[:5]
        assert g.base_score == pytest.approx(w[5], rel=1e-9)
        assert g.score < 0


def test_all_segmentations_count():
    pieces = {"▁": 0.1, "▁a": 0.2, "a": 0.05, "ab": 0.1, "b": 0.15, "aba": 0.02, "": 0.1}
    scores = {p: math.log(x) for p, x in pieces.items()} | {f"<0x{b:02X}>": math.log(1e-4) for b in range(256)}
    lattice = Lattice(scores)
    for word in ("a", "ab", "abab", "abaabab"):
        assert lattice.log_probability(word) == pytest.approx(math.log(sum(segmentations("▁" + word, pieces))))
    assert lattice.log_probability("é") == pytest.approx(math.log(0.1 * 1e-8))
    found = {}
    lattice.expect("ab", 3.0, found)
    ways = {("▁", "ab"): 0.01, ("▁", "a", "b"): 0.1 * 0.05 * 0.15, ("▁a", "b"): 0.03}
    for piece in ("▁", "▁a", "ab", "b", "a"):
        assert found[piece] == pytest.approx(3 * sum(x for w, x in ways.items() if piece in w) / sum(ways.values()))


def test_base_equals_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    same(op8_lattice_score(spark, "/root/testdata/sf0.001").collect(), base([tuple(r) for r in rows]))


def test_odd_rows_and_rare_words(spark):
    rows = [(1, "A b\x0bC"), (2, None), (3, ""), (4, "é " * 50), (4, "é " * 50), (None, "b b"), (5, "x" * 20000), (12, "never seen here"), (13, "b c")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, c int")
    same(score(df, frequent=2).collect(), base(rows))
    some, all_ = ({(r.doc_id, round(r.score, 6)) for r in score(df, frequent=f).collect()} for f in (2, 100))
    assert some == all_


def test_empty_table(spark):
    assert score(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_likely_words_score_higher():
    lattice = Lattice(prior_scores())
    assert lattice.log_probability("the") > lattice.log_probability("xqz")
