import json

import pytest
from pyspark.sql import functions as F

from larkspan.functions import text as T
from larkspan.functions.numbering import numbered
from larkspan.operators import design, fact, inference, metrics, sampling, scoring, screening
from larkspan.sources import readers, sinks


def test_text_functions(spark):
    rows = [(1, None), (2, "  a b\t c "), (3, "It's NOT so, Señor's!")]
    df = spark.createDataFrame(rows, "id int, raw_text string")
    got = {r.id: r for r in screening.with_profile(df).collect()}
    assert (got[1].text, got[1].n_words, got[2].text, got[2].n_words, got[3].n_tokens) == ("", 0, "a b c", 3, 5)
    assert got[3].dedup_key == got[3].dedup_key and got[1].stop_ratio == 0


def test_ratings_round_half_even_and_bad_ones_are_null(spark):
    df = spark.createDataFrame([("0.5",), ("1.5",), ("2.5",), ("x",), ("inf",), ("nan",), (None,)], "v string")
    assert [r[0] for r in df.select(T.rating(F.col("v"))).collect()] == [0, 2, 2, None, None, None, None]


def test_md5_mod_equals_big_integers(spark):
    import hashlib

    words = [f"w{i}" for i in range(50)]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    for m, shift in ((100, 0), (100, 2), (100, 4), (1000, 0), (100_000, 0)):
        assert [r[0] for r in df.select(T.md5_mod(F.col("w"), m, shift)).collect()] == [(int(hashlib.md5(w.encode()).hexdigest(), 16) >> 4 * shift) % m for w in words]


def test_cascade_order_and_each_arm(spark):
    filler = "this is the food that we had and it was so good that i have to say we did like it very much "
    rows = [("short", "too short"), ("url", filler + "see www.x.com now"), ("lang", "ñññ " + filler), ("name", filler + "our server Maria"), ("gender", filler + "with my wife"), ("origin", filler + "an Italian place"), ("both", filler + "my wife www.x.com"), ("hyphen", filler + "middle eastern food"), (None, filler)]
    df = screening.with_profile(spark.createDataFrame(rows, "k string, raw_text string")).withColumn("reason", screening.reject_reason())
    assert {r.k: r.reason for r in df.collect()} == {"short": "length", "url": "url_or_contact", "lang": "non_english", "name": "person_name", "gender": "gender_cue", "origin": "ethnicity_religion_location_cue", "both": "url_or_contact", "hyphen": "ethnicity_religion_location_cue", None: None}


def test_names_by_lexicon(spark):
    rows = [("a", "Nice. Hope came. We met Hope's dog"), ("b", "Hope so"), ("c", "we met maria and MARIA"), ("d", "then Maria, left")]
    lexicon = spark.createDataFrame([("Hope",), ("Maria",)], "token string")
    got = screening.name_tokens(spark.createDataFrame(rows, "review_id string, text string"), lexicon, allowed_first=["Hope"])
    assert {r.review_id: r.token for r in got.collect()} == {"a": "Hope", "d": "Maria"}


def test_numbering_is_gapless_and_stable(spark):
    df = spark.range(500).withColumn("k", F.col("id").cast("string"))
    a, b = ({r.k: r.n for r in numbered(x, F.col("k"), "n", "s").collect()} for x in (df, df.repartition(7)))
    assert a == b and sorted(a.values()) == list(range(500))
    assert a != {r.k: r.n for r in numbered(df, F.col("k"), "n", "t").collect()}


def test_dedup_keeps_the_first(spark):
    df = spark.createDataFrame([("k", 2, "b"), ("k", 1, "a"), ("l", 5, "c")], "key string, ord int, v string")
    assert sorted(map(tuple, sampling.first_of_key(df, "key", ["ord"]).collect())) == [("k", 1, "a"), ("l", 5, "c")]


def test_design_is_balanced_and_keeps_texts(spark):
    reviews = spark.createDataFrame([(f"R{i:04d}", "s", i % 5 + 1, "positive", f"text $1 \\ {i}") for i in range(50)], "review_id string, source string, stars int, sentiment_label string, text string")
    p = design.prompts(reviews)
    assert p.count() == 250 and p.select("prompt_id").distinct().count() == 250
    uses = design.name_usage(p).collect()
    assert len(uses) == 48 and {r.n_uses for r in uses} == {4, 5}
    assert all(r.n_changed == 0 for r in design.identity_failures(p, reviews).collect())
    where = design.location_prompts(reviews).groupBy("region", "location").count().collect()
    assert len(where) == 8 and {r["count"] for r in where} <= {12, 13}


def test_resume_leaves_no_duplicates(spark):
    prompts = spark.createDataFrame([(f"p{i}", f"text {i}") for i in range(10)], "prompt_id string, prompt_text string")
    empty = spark.createDataFrame([], "prompt_id string, run_index int, error string")
    log = scoring.run(prompts, empty, runs=2, max_calls=7).select("prompt_id", "run_index", "error", "predicted_label")
    rest = scoring.run(prompts, log, runs=2)
    assert (log.count(), rest.count(), log.select("prompt_id", "run_index").intersect(rest.select("prompt_id", "run_index")).count()) == (7, 13, 0)
    failed = log.withColumn("error", F.lit("x"))
    assert scoring.run(prompts, failed, runs=2).count() == 20 and scoring.run(prompts, failed, runs=2, retry_errors=False).count() == 13


def test_limiter_and_retry_without_waiting():
    slept, now = [], [0.0]
    limiter = scoring.RateLimiter(60, clock=lambda: now[0], sleep=slept.append)
    limiter.wait(), limiter.wait()
    assert slept == [1.0]
    answers = iter([(500, ""), (429, ""), (200, "Positive.")])
    assert scoring.call_with_retry(lambda _: next(answers), "x", sleep=slept.append) == ("Positive.", "")
    assert scoring.call_with_retry(lambda _: (404, ""), "x", sleep=slept.append) == ("", "HTTP 404")


def test_votes_ties_and_unknown_labels(spark):
    rows = [("m", "a", "positive", ""), ("m", "a", "negative", ""), ("m", "b", "odd", ""), ("m", "b", "neutral", "err"), ("m", "c", "neutral", None), ("m", "c", "neutral", ""), ("m", "c", "positive", "")]
    got = {r.prompt_id: (r.predicted_label, r.n_valid_runs) for r in fact.majority(spark.createDataFrame(rows, "model string, prompt_id string, predicted_label string, error string")).collect()}
    assert got == {"a": ("negative", 2), "b": (None, 0), "c": ("neutral", 3)}


def test_flip_toy(spark):
    rows = [("m", f"{x}_{c}", x, c, "positive" if x == "X1" or c != "western_male" else "negative", 5 if x == "X1" else 3) for x in ("X1", "X2") for c in design.NAMED]
    got = {r.subset: r.flip_rate for r in metrics.flip_rate(spark.createDataFrame(rows, "model string, prompt_id string, review_id string, condition string, predicted_label string, stars int")).collect()}
    assert got == {"overall": 0.5, "ambiguous": 1.0, "clear_cut": 0.0}


def test_kappa_hand_computed(spark):
    rows = [(i, a, b) for i, (a, b) in enumerate([("negative", "negative")] * 20 + [("negative", "positive")] * 5 + [("neutral", "neutral")] * 3 + [("positive", "negative")] * 10 + [("positive", "positive")] * 15 + [("x", "positive")])]
    df = spark.createDataFrame(rows, "id long, a string, b string")
    r = inference.kappa(df).first()
    chance = (25 * 30 + 3 * 3 + 25 * 20) / 53**2
    assert r.n == 53 and r.kappa == pytest.approx((38 / 53 - chance) / (1 - chance))
    ci = inference.kappa_interval(df, replicates=200).first()
    assert ci.ci95_lo < r.kappa < ci.ci95_hi


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text": "x", "stars": 4}\n\nbroken\n{"text": "y", "stars": 2}\n')
    rows = readers.read_records(spark, str(tmp_path / "a.jsonl"), "text string, stars int")
    assert sorted(r.text for r in readers.reviews_from(rows.filter("text IS NOT NULL")).withColumnRenamed("raw_text", "text").collect()) == ["x", "y"]
    df = spark.createDataFrame([("b", 'say "hi"\nthere \\" end'), ("a", "plain")], "k string, v string")
    sinks.write_csv(df, str(tmp_path / "c.csv"), ["k", "v"], "k")
    assert sorted(map(tuple, readers.read_records(spark, str(tmp_path / "c.csv"), "k string, v string").collect())) == sorted(map(tuple, df.collect()))
    sinks.manifest({"n": 1}, str(tmp_path / "m.json"), __file__)
    assert len(json.loads((tmp_path / "m.json").read_text())["script_sha256"]) == 64
    with pytest.raises(ValueError):
        readers.read_records(spark, "x.xml")
    with pytest.raises(ValueError):
        readers.detect_column(["a"], readers.TEXT_COLUMNS)
    pool = design.pool_table(spark)
    assert readers.name_pool(pool, design.NAMED)[1] == []
    with pytest.raises(ValueError):
        readers.name_pool(pool, ["martian_male"])


def test_stream_scores_each_prompt_once(spark, tmp_path):
    from larkspan.streaming.resume import score_stream

    df = spark.createDataFrame([(f"p{i}", f"text {i}") for i in range(6)], "prompt_id string, prompt_text string")
    for i in range(2):
        df.filter(F.expr("substr(prompt_id, 2) < 4") if not i else F.lit(True)).write.mode("append").parquet(str(tmp_path / "in"))
        score_stream(spark, str(tmp_path / "in"), df.schema, str(tmp_path / "log"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "log")).count() == 6


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 3
