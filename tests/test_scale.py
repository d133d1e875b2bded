"""What keeps the analysis queries linear: texts read, moved and hashed once, rows folded before exchanges, draws hashed in arrays; with the results of the plain forms."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspan.functions import draws
from larkspan.functions import text as T
from larkspan.operators import design, fact, inference, metrics, scoring
from larkspan.plans import queries

SF = "/root/testdata/sf0.001"
NAMED = design.NAMED


@pytest.fixture(scope="module")
def reviews(spark):
    rows = [(f"R{i:04d}", "s", i % 5 + 1, ["negative", "negative", "neutral", "positive", "positive"][i % 5], f"review text number {i}") for i in range(100)]
    return spark.createDataFrame(rows, "review_id string, source string, stars int, sentiment_label string, text string")


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def counted(df):
    """`df` and how many of its rows have been read."""
    seen = df.sparkSession.sparkContext.accumulator(0)

    def look(batches):
        for x in batches:
            seen.add(len(x))
            yield x

    return df.mapInPandas(look, df.schema), seen


@pytest.mark.parametrize("prefix", ["42:0:", "42:1999:", "s" * 50, "s" * 60, ""])
def test_array_hashes_equal_hashlib(prefix):
    for start, stop in ((0, 1200), (99_990, 100_020), (2**32 - 3, 2**32 + 3)):
        want = [int(hashlib.md5(f"{prefix}{i}".encode()).hexdigest()[:8], 16) for i in range(start, stop)]
        got = draws.first_words(prefix, start, stop)
        assert got.tolist() == want and draws.picks(got, 997).tolist() == [w % 997 for w in want]
    ends = [1, 5, 40, 997]
    pick = draws.picks(draws.first_words(prefix, 0, 3000), 997)
    for more in ([], list(range(998, 1070))):  # by comparison, and by search
        assert draws.kind_counts(pick, ends + more)[:4] == np.histogram(pick, [0, *ends[:-1], 998])[0].tolist()


def test_draws_take_clusters_by_hash_in_any_blocks(spark, monkeypatch):
    """Plain draws of ordered clusters, groups of unequal size; no row is made for a draw."""
    rows = [("x", i % 3, i % 2) for i in range(50)] + [("y", i % 4, 1) for i in range(23)]
    clusters = spark.createDataFrame(rows, "g string, s int, n int")
    want = []
    for g in ("x", "y"):
        own = sorted(r[1:] for r in rows if r[0] == g)
        for b in range(9):
            taken = [own[int(hashlib.md5(f"42:{b}:{i}".encode()).hexdigest()[:8], 16) % len(own)] for i in range(len(own))]
            want.append((b, sum(s for s, _ in taken), sum(n for _, n in taken), g))
    for size in (262_144, 7):
        monkeypatch.setattr(inference, "BLOCK", size)
        got = inference.resampled(clusters, ["s", "n"], 9, "42", "g")
        assert sorted(map(tuple, got.collect())) == sorted(want) and "explode" not in optimized(got)
    assert inference.resampled(clusters.limit(0), ["s", "n"], 9, "42", "g").count() == 0


def test_a_text_is_hashed_once_a_call(spark):
    assert len(re.findall(r"md5\(cast\(concat_ws\(:, prompt_text", optimized(queries.merged_long(spark, SF)))) == 3
    assert len(re.findall(r"md5\(cast\(concat\(CASE", optimized(queries.mock_scores(spark, SF)))) == 1


def test_hash_shares_equal_big_integers(spark):
    words = [f"w{i}" for i in range(30)]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(*T.hex_mods(F.md5("w"), 100, [0, 2, 4, 16])).collect()
    assert [tuple(r) for r in got] == [tuple((int(hashlib.md5(w.encode()).hexdigest(), 16) >> 4 * s) % 100 for s in (0, 2, 4, 16)) for w in words]


@pytest.mark.parametrize("name", ["merged_long", "majority_vote", "condition_means", "self_consistency", "class_metrics", "confusion", "flip_rate", "contrast_region", "contrast_gender", "lmm_region", "lmm_terms", "holm", "mock_scores"])
def test_documents_are_read_for_texts_and_for_counts_alone(spark, name):
    """Two scans, one of them without texts; rows aren't copied for a distinct count."""
    plan = optimized(queries.QUERIES[name](spark, SF))
    assert plan.count("Relation [") == 2 and plan.count("regexp_replace") == 1 and "Expand [" not in plan


def test_votes_in_the_row_equal_votes_of_a_log(spark, reviews):
    p = design.prompts(reviews)
    answered = scoring.mock_runs(p, "prompt_text", 3, fail_rate=0.3).withColumn("model", F.lit("m"))
    log = answered.select("model", "prompt_id", F.inline("runs"))
    plain = scoring.mock_scores(scoring.wanted_calls(p, 3), F.concat_ws(":", "prompt_text", F.col("run_index").cast("string")), fail_rate=0.3)
    assert rows_of(log.select("prompt_id", "run_index", "predicted_label", "error")) == rows_of(plain.select("prompt_id", "run_index", "predicted_label", "error"))
    assert rows_of(fact.majority(answered).fillna("")) == rows_of(fact.majority(log).fillna(""))
    one, many = fact.merged_in_place(answered), fact.merged_long(log, p, reviews)
    assert one.dtypes == many.dtypes and rows_of(one) == rows_of(many) and 400 < one.count() < 500
    assert rows_of(fact.load_stats(answered, p, reviews)) == rows_of(fact.load_stats(log, p, reviews)) == [("m", 500, 500, 500 - one.count())]


def test_names_are_ranked_by_hash_in_every_block(reviews):
    """The item's number decides block and slot, as in a table of all blocks."""
    order = sorted((hashlib.md5(f"42R{i:04d}".encode()).hexdigest(), f"R{i:04d}") for i in range(100))
    want = set()
    for n, (_, r) in enumerate(order):
        for c in NAMED:
            name, sub = sorted(design.NAMES[c], key=lambda x: hashlib.md5(f"42:{c}:{n // 12}:{x[0]}".encode()).hexdigest())[n % 12]
            want.add((r, c, name, sub))
    p = design.prompts(reviews)
    assert {tuple(r) for r in p.filter("condition <> 'none'").select("review_id", "condition", "name", "sub_region").collect()} == want
    assert "Join" not in optimized(p.select("prompt_id", "name")).replace("Join Inner, (_b", "")


def test_statistics_of_partial_reviews(spark):
    """Reviews without some conditions, and a model without a whole one."""
    scores = {"negative": -1, "neutral": 0, "positive": 1}
    rows = [("m", f"{r}_{c}", r, c, x, s) for r, c, x, s in [("A", NAMED[0], "positive", 3), ("A", NAMED[1], "neutral", 3), ("A", NAMED[2], "positive", 3), ("A", NAMED[3], "positive", 3), ("A", "none", "negative", 3), ("B", NAMED[0], "negative", 5), ("C", "none", "neutral", 1)]]
    rows += [("n", "D_none", "D", "none", "neutral", 3)]
    m = spark.createDataFrame([(*r, scores[r[4]]) for r in rows], "model string, prompt_id string, review_id string, condition string, predicted_label string, stars int, score int").withColumn("region", F.regexp_replace("condition", "_[^_]*$", ""))
    flips = {(r.model, r.subset): (r.n_reviews, r.n_flipped, r.flip_rate) for r in metrics.flip_rate(m).collect()}
    assert flips == {("m", "overall"): (1, 1, 1.0), ("m", "ambiguous"): (1, 1, 1.0), ("m", "clear_cut"): (0, 0, None), **{("n", s): (0, 0, None) for s in ("overall", "ambiguous", "clear_cut")}}
    (c,) = metrics.contrast(m, "region", "western", "south_asian").collect()
    x = [1, 0, -1, 1, 1]
    assert (c.n_clusters, c.mean_a, c.mean_b) == (2, 0.0, 1.0) and c.sd == pytest.approx(np.std(x, ddof=1)) and c.cohens_d == pytest.approx(-1 / np.std(x, ddof=1))


def test_one_reading_gives_intervals_and_sd_and_the_sub_region_model(reviews):
    p = design.prompts(reviews)
    m = fact.merged_in_place(scoring.mock_runs(p, "prompt_text", 1).withColumn("model", F.lit("m"))).persist()
    total = m.count()
    rows, seen = counted(m)
    diff, sd = inference.difference_with_sd(rows, "region", "western", "south_asian", replicates=20)
    assert rows_of(diff) == rows_of(inference.bootstrap_difference(m, "region", "western", "south_asian", replicates=20)) and seen.value == total
    assert diff.select(sd.alias("sd")).first().sd == pytest.approx(metrics.contrast(m, "region", "western", "south_asian").first().sd)
    rows, seen = counted(m)
    assert inference.mixed_model_subregion(rows).count() == 10 and seen.value == total
