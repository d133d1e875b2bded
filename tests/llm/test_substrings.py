import hashlib
import re

import pytest

from larkspan.llm.substrings import op10_substring_dedup, remove_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, n=13):
    first = {}
    words = [(d, WORD.findall(t or "")) for d, t in rows]
    for d, w in words:
        for i in range(len(w) - n + 1):
            k = tuple(w[i : i + n])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - n + 1):
            if first[tuple(w[i : i + n])] < d:
                gone.update(range(i, i + n))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_equals_brute_force(spark, size):
    rows = spark.read.parquet(f"/root/testdata/{size}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, op10_substring_dedup(spark, f"/root/testdata/{size}").collect())) == brute(rows)


def test_odd_rows(spark):
    line = " ".join(f"w{i}" for i in range(30))
    rows = [(1, line), (2, "x " + line + " y"), (3, None), (4, ""), (5, line), (5, line), (6, " ".join(["a"] * 40)), (7, "a " * 40), (8, "é\x0bß " * 9), (9, "w1 w2 " + line[:40])]
    got = remove_repeats(spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, at int"))
    assert sorted(tuple(r)[:3] + (r.kept_sha256,) for r in got.collect()) == brute(rows)


def test_null_id_counts_as_largest(spark):
    line = " ".join(f"w{i}" for i in range(13))
    got = {r.doc_id: r.n_removed for r in remove_repeats(spark.createDataFrame([(None, line), (4, line)], "doc_id long, text string")).collect()}
    assert got == {None: 13, 4: 0}


def test_places_belong_to_texts(spark):
    """Different texts without an id, or of one id, lose their own repeats alone, whatever their lengths."""
    line, more = (" ".join(f"{c}{i}" for i in range(20)) for c in "wv")
    rows = [(None, " ".join(f"a{i}" for i in range(300)) + " " + line), (None, "quite short"), (None, " ".join(f"b{i}" for i in range(50))), (None, line), (7, "x " * 9 + more), (7, " ".join(f"c{i}" for i in range(40))), (1, line), (2, more), (9, " ".join(f"d{i}" for i in range(400)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r)[:3] + (r.kept_sha256,) for r in remove_repeats(df.coalesce(1)).collect()), key=repr)
    last = 2**63 - 1
    want = [(None if d == last else d, *x) for d, *x in brute([(last if d is None else d, t) for d, t in rows])]
    assert got == sorted(want, key=repr) and sum(x[2] for x in got) == 60


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
