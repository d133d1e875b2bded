"""Operators around the analysis table: recovery of known effects, agreement, scorers and readers."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspan.functions import text as T
from larkspan.operators import agreement, design, fact, inference, metrics, sampling, scoring, screening
from larkspan.sources import readers


@pytest.fixture(scope="module")
def reviews(spark):
    rows = [(f"R{i:04d}", "s", i % 5 + 1, ["negative", "negative", "neutral", "positive", "positive"][i % 5], f"review text number {i}") for i in range(250)]
    return spark.createDataFrame(rows, "review_id string, source string, stars int, sentiment_label string, text string")


def merged(reviews, column=None, level=None):
    p = design.prompts(reviews)
    hit = F.col(column) == level if column else F.lit(False)
    bias = [F.when(hit, 3.0).otherwise(0.0), F.lit(0.0), F.when(hit, -3.0).otherwise(0.0)]
    r = scoring.mock_scores(p.withColumn("run_index", F.lit(1)), F.col("prompt_text"), bias)
    return fact.merged_long(r.withColumn("model", F.lit("m")), p, reviews).persist()


def test_known_effects_are_recovered(reviews):
    """A bias on one region shows in that contrast, its interval, verdict and term, and not in the other; without a bias nothing shows."""
    biased = merged(reviews, "region", "south_asian")
    c = metrics.contrast(biased, "region", "western", "south_asian").first()
    assert c.cohens_d > 0.8 and c.n_clusters == 250
    i = inference.interval(inference.bootstrap_difference(biased, "region", "western", "south_asian", replicates=200))
    verdict = inference.tost(i, F.lit(c.sd)).first()
    assert verdict.ci95_lo > 0 and verdict.verdict == "significant" and verdict.ci95_lo < c.mean_diff < verdict.ci95_hi
    terms = {r.term: r for r in inference.with_p(inference.mixed_model_balanced(biased)).collect()}
    assert terms["region[south_asian]"].p_value < 0.001 and terms["region[south_asian]"].coef < 0
    g = inference.interval(inference.bootstrap_difference(biased, "gender", "male", "female", replicates=200)).first()
    assert g.ci95_lo < 0 < g.ci95_hi
    none = metrics.contrast(merged(reviews), "region", "western", "south_asian").first()
    assert abs(none.cohens_d) < 0.2


def test_terms_equal_a_search_over_the_likelihood(reviews):
    """The closed form and the sub-region model against generalised least squares over whole matrices, the variance ratio by grid."""
    m = merged(reviews)
    rows = m.filter(F.col("condition").isin(design.NAMED)).select("review_id", "region", "gender", "sub_region", "score").collect()

    def gls(rows, x):
        xs, y = np.array([x(r) for r in rows], float), np.array([r.score for r in rows], float)
        groups = {}
        for i, r in enumerate(rows):
            groups.setdefault(r.review_id, []).append(i)
        n, p = xs.shape

        def fit(ratio):
            a, b, c, det = np.zeros((p, p)), np.zeros(p), 0.0, 0.0
            for g in groups.values():
                v = np.linalg.inv(np.eye(len(g)) + ratio)
                a, b, c, det = a + xs[g].T @ v @ xs[g], b + xs[g].T @ v @ y[g], c + y[g] @ v @ y[g], det + math.log(1 + ratio * len(g))
            beta = np.linalg.solve(a, b)
            s2 = (c - beta @ b) / (n - p)
            return -0.5 * ((n - p) * math.log(s2) + det + np.linalg.slogdet(a)[1]), beta, np.sqrt(np.diag(np.linalg.inv(a)) * s2)

        ratio = max([0.0, *np.exp(np.linspace(-7, 1, 60))], key=lambda r: fit(r)[0])
        return fit(ratio)[1:]

    got = inference.with_p(inference.mixed_model_balanced(m)).collect()
    beta, se = gls(rows, lambda r: [1, s := r.region == "south_asian", g := r.gender == "female", s * g])
    assert [r.coef for r in got] == pytest.approx(list(beta), abs=1e-6) and [r.se for r in got] == pytest.approx(list(se), rel=0.02)
    assert all(r.p_value == pytest.approx(math.erfc(abs(r.coef / r.se) / math.sqrt(2))) and r.ci95_lo < r.coef < r.ci95_hi for r in got)
    south = [r for r in rows if r.region == "south_asian"]
    subs = sorted({r.sub_region for r in south} - {"India"})
    beta, se = gls(south, lambda r: [1, *(r.sub_region == s for s in subs), g := r.gender == "female", *((r.sub_region == s) * g for s in subs)])
    got = inference.mixed_model_subregion(m).collect()
    assert [r.coef for r in got] == pytest.approx(list(beta), abs=0.02) and [r.se for r in got] == pytest.approx(list(se), rel=0.05)


def test_holm_vector(spark):
    got = inference.holm(spark.createDataFrame([("a", 0.01), ("b", 0.02), ("c", 0.03), ("d", 0.5)], "term string, p double"))
    assert {r.term: round(r.p_holm, 9) for r in got.collect()} == {"a": 0.04, "b": 0.06, "c": 0.06, "d": 0.5}


def test_agreement_with_reviews_and_gold(spark, reviews):
    sheet = spark.createDataFrame([(f"R{i:04d}", " Positive", "NEGATIVE " if i < 5 else "positive" if i < 39 else "?") for i in range(40)], "review_id string, annotator1_label string, annotator2_label string")
    rows = agreement.sheet_with_reviews(sheet, reviews)
    assert [r.b for r in agreement.invalid_labels(rows).collect()] == ["?"]
    assert inference.kappa(rows).first().n == 39
    gold = {r.rater: r for r in agreement.against_gold(rows).collect()}
    assert gold["a"].raw_agreement == 0.4 and gold["a"].n == 40 and gold["b"].n == 39
    with pytest.raises(Exception, match="isn't there: R9999"):
        agreement.sheet_with_reviews(sheet.union(spark.createDataFrame([("R9999", "x", "y")])), reviews).collect()


def test_gate_usage_totals_and_matrix(spark, reviews):
    m = merged(reviews)
    assert metrics.of_complete_models(m, 251).count() == 0 and metrics.of_complete_models(m, 250).count() == m.count()
    usage = design.name_usage(design.prompts(reviews))
    assert all((r.n_names, r.least, r.most) == (12, 20, 21) for r in design.usage_ranges(usage).collect())
    assert sum(r.n_uses for r in design.usage_by_sub_region(usage).collect()) == 1000
    assert {r.sentiment_label: r.n for r in sampling.label_totals(reviews).collect()} == {"negative": 100, "neutral": 50, "positive": 100}
    assert sampling.preview(reviews, "review_id", 3).count() == 3
    matrix = metrics.class_metrics(m).select("n", metrics.matrix_from_json("confusion_matrix").alias("x")).first()
    assert sum(map(sum, matrix.x)) == matrix.n == 250
    assert T.quota_spec("1:45,2:45, 3:80") == {1: 45, 2: 45, 3: 80}


def test_dirty_texts_never_pass(spark):
    filler = "this is the food that we had and it was so good that i have to say we did like it very much "
    dirty = ["our server Maria was there", "the agent named John came", "with my hubby and me", "as a mom of two", "an Afghan dish", "in New Orleans", "see https://x.y", "mail a.b@c.de", "call 555-123-4567", "st. louis style"]
    df = screening.with_profile(spark.createDataFrame([(str(i), filler + x) for i, x in enumerate(dirty)] + [("short", "so good"), ("long", filler * 9), ("clean", filler)], "review_id string, raw_text string"))
    assert [r.review_id for r in df.filter(screening.reject_reason().isNull()).collect()] == ["clean"]
    named = screening.with_names(screening.with_profile(spark.createDataFrame([("a", filler + "with Maria"), ("b", filler)], "review_id string, raw_text string")), spark.createDataFrame([("Maria",)], "token string"))
    assert {r.review_id: r.reason for r in named.withColumn("reason", screening.reject_reason(named=F.col("named"))).collect()} == {"a": "person_name", "b": None}
    with pytest.raises(ValueError, match="lexicon"):
        screening.lexicon_or_fallback(None, strict=True)


def test_scorers_and_run_statistics(spark):
    prompts = spark.createDataFrame([(f"p{i}", f"text {i}") for i in range(10)], "prompt_id string, prompt_text string")
    empty = spark.createDataFrame([], "prompt_id string, run_index int, error string")
    log = scoring.run(prompts, empty, max_calls=4)
    assert all(r.queried_at_utc.endswith("+00:00") for r in log.collect())
    assert tuple(scoring.call_stats(scoring.wanted_calls(prompts, 1), log, 3).first()) == (4, 3, True)
    likely = scoring.likelihood_scorer(lambda texts, label: [[-1.0] if label == "good" else [-3.0, -3.0] for _ in texts], {"positive": "good"})
    assert {r.predicted_label for r in likely(prompts).collect()} == {"positive"}
    told = scoring.remote_scorer(lambda t: (200, "Neutral.") if t != "text 3" else (200, "no idea"), 0)(prompts).collect()
    assert {(r.predicted_label, r.error) for r in told} == {("neutral", ""), ("", "no label in the answer")}
    assert scoring.answer_of('{"a": [{"b": "Positive"}]}', ["a", 0, "b"]) == ("Positive", "")
    assert scoring.answer_of("{", ["a"])[1].startswith("malformed") and scoring.answer_of('{"a": 1}', ["a"])[1].startswith("malformed")
    with pytest.raises(ValueError, match="API_KEY"):
        scoring.key_from({}, "API_KEY")


def test_json_arrays_and_term_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('\n [{"text": "x"},\n {"text": "y"}]')
    (tmp_path / "l.json").write_text('{"text": "x"}\n{"text": "y"}\n')
    for name in ("a.json", "l.json"):
        assert sorted(r.text for r in readers.read_records(spark, str(tmp_path / name), "text string").collect()) == ["x", "y"]
    (tmp_path / "t.txt").write_text("one\n\n two-three \n")
    assert readers.read_terms(spark, str(tmp_path / "t.txt")) == ["one", "two-three"]


def test_primary_contrasts_are_families_of_two(spark):
    terms = spark.createDataFrame([(m, t, p) for m, ps in (("x", (0.01, 0.04)), ("y", (0.6, 0.5))) for t, p in zip(inference.PRIMARY, ps, strict=True)] + [("x", "intercept", 0.0)], "model string, term string, p_value double")
    got = {(r.model, r.term): round(r.p_holm, 9) for r in inference.primary_contrasts(terms).collect()}
    region, gender = inference.PRIMARY
    assert got == {("x", region): 0.02, ("x", gender): 0.04, ("y", region): 1.0, ("y", gender): 1.0}


def test_rows_without_an_id_are_numbered_by_place(spark, tmp_path):
    """The same numbers however the file is split; an id that is there stays."""
    (tmp_path / "a.jsonl").write_text("".join(f'{{"text": "t{i}", "stars": 3, "id": {json.dumps("own" if i == 7 else "")}}}\n' for i in range(1, 301)))
    want = {f"t{i}": "own" if i == 7 else f"row{i}" for i in range(1, 301)}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in (before, "1500b"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        rows = readers.read_records(spark, str(tmp_path / "a.jsonl"), "text string, stars int, id string")
        assert {r.raw_text: r.source_review_id for r in readers.reviews_from(rows).collect()} == want
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
