"""Scorers and the resumable scoring step."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.functions.text import LABELS, hex_mods, label_in

#: Base of the pseudo-scorer's softmax: fixed value.
BASE = 2.718281828


def _first_max(values: list[Column]) -> Column:
    top = F.greatest(*values)
    return F.coalesce(*(F.when(v == top, x) for v, x in zip(values, LABELS, strict=True)))


def softmax_labels(means: list[Column]) -> tuple[list[Column], Column]:
    """Probabilities of mean log-probabilities, and the most likely label, the first on ties."""
    exps = [F.exp(m - F.greatest(*means)) for m in means]
    probs = [e / sum(exps[1:], exps[0]) for e in exps]
    return probs, _first_max(means)


def mean_log_prob(tokens: Column) -> Column:
    """Length-normalised log-probability; an empty list is an error."""
    return F.when(F.size(tokens) > 0, F.aggregate(tokens, F.lit(0.0), lambda a, x: a + x) / F.size(tokens)).otherwise(F.raise_error(F.lit("no token log-probabilities")))


def mock_scores(df: DataFrame, text: Column, bias: list[Column] | None = None, fail_rate: float = 0.0) -> DataFrame:
    """Adds predicted_label, prob_* and error by the hash of a text; `bias` is added to the three logits."""
    # a column for each step: a text is hashed once, however many expressions use its hash
    steps = df.withColumn("_digest", F.md5(text))
    steps = steps.withColumns({f"_logit{i}": x for i, x in enumerate(hex_mods(F.col("_digest"), 100, [0, 2, 4]))})
    logits = [F.col(f"_logit{i}") / 100 for i in range(3)]
    logits = [x + b for x, b in zip(logits, bias, strict=True)] if bias else logits
    steps = steps.withColumns({f"_power{i}": F.pow(F.lit(BASE), x) for i, x in enumerate(logits)})
    powers = [F.col(f"_power{i}") for i in range(3)]
    probs = [p / (powers[0] + powers[1] + powers[2]) for p in powers]
    failed = hex_mods(F.col("_digest"), 1000, [0])[0] / 1000 < fail_rate if fail_rate > 0 else F.lit(False)
    out = steps.withColumns({f"prob_{x}": F.when(~failed, p) for x, p in zip(LABELS, probs, strict=True)} | {"error": F.when(failed, "simulated failure").otherwise("")})
    # without a bias the logits decide, free of rounding
    label = _first_max([F.col(f"_logit{i}") for i in range(3)] if not bias else [F.col(f"prob_{x}") for x in LABELS])
    return out.withColumn("predicted_label", F.when(F.col("error") == "", label).otherwise(F.lit(""))).drop("_digest", *(f"_{c}{i}" for c in ("logit", "power") for i in range(3)))


def mock_runs(df: DataFrame, text: str, runs: int, **options) -> DataFrame:
    """Adds `runs`, the label and error of every run of a prompt by the hash of its text and the run's number: the calls of a prompt stay in its row."""
    out = df
    for i in range(1, runs + 1):
        one = mock_scores(out, F.concat_ws(":", text, F.lit(str(i))), **options)
        out = one.select(*out.columns, F.struct(F.lit(i).alias("run_index"), "predicted_label", "error").alias(f"_run{i}"))
    return out.select(*df.columns, F.array(*(f"_run{i}" for i in range(1, runs + 1))).alias("runs"))


SCORERS: dict[str, Callable[[DataFrame], DataFrame]] = {"mock": lambda df: mock_scores(df, F.col("prompt_text"))}


def register(name: str, scorer: Callable[[DataFrame], DataFrame]) -> None:
    SCORERS[name] = scorer


def wanted_calls(prompts: DataFrame, runs: int, deterministic: bool = False) -> DataFrame:
    return prompts.withColumn("run_index", F.explode(F.sequence(F.lit(1), F.lit(1 if deterministic else runs))))


def pending(calls: DataFrame, log: DataFrame, retry_errors: bool = True) -> DataFrame:
    """Calls without a success in the log; without `retry_errors`, without any row."""
    keys = log.filter(F.coalesce("error", F.lit("")) == "") if retry_errors else log
    return calls.join(keys.select("prompt_id", "run_index").distinct(), ["prompt_id", "run_index"], "left_anti")


def run(prompts: DataFrame, log: DataFrame, scorer: str = "mock", runs: int = 1, max_calls: int = 0, retry_errors: bool = True) -> DataFrame:
    """Rows to append to the log: the first `max_calls` pending calls (0: all), scored."""
    todo = pending(wanted_calls(prompts, runs), log, retry_errors)
    if max_calls:
        todo = todo.orderBy("prompt_id", "run_index").limit(max_calls)
    return SCORERS[scorer](todo).withColumn("queried_at_utc", utc_now())


def utc_now() -> Column:
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def call_stats(calls: DataFrame, log: DataFrame, max_calls: int = 0) -> DataFrame:
    """n_skipped (done before), n_calls (of this run), stopped_early (the cap left some)."""
    left = pending(calls, log).agg(F.count(F.lit(1)).alias("left"))
    both = calls.agg(F.count(F.lit(1)).alias("all")).join(F.broadcast(left))  # one row
    n = F.least("left", F.lit(max_calls)) if max_calls else F.col("left")
    return both.select((F.col("all") - F.col("left")).alias("n_skipped"), n.alias("n_calls"), (n < F.col("left")).alias("stopped_early"))


def run_stats(calls: DataFrame, log: DataFrame) -> DataFrame:
    """n_needed, n_done, n_errors, n_rows of a log against the wanted calls."""
    done = log.filter("coalesce(error, '') = ''").select("prompt_id", "run_index").distinct()
    needed = calls.join(done.withColumn("_d", F.lit(1)), ["prompt_id", "run_index"], "left").agg(F.count(F.lit(1)).alias("n_needed"), F.count("_d").alias("n_done"))
    return needed.join(F.broadcast(log.agg(F.sum((F.coalesce("error", F.lit("")) != "").cast("long")).alias("n_errors"), F.count(F.lit(1)).alias("n_rows"))))


class RateLimiter:
    """At most `per_minute` calls a minute, with a clock that tests can replace."""

    def __init__(self, per_minute: float, clock=time.monotonic, sleep=time.sleep):
        self.gap, self.clock, self.sleep, self.next = 60.0 / per_minute if per_minute else 0.0, clock, sleep, None

    def wait(self) -> None:
        now = self.clock()
        if self.next is not None and now < self.next:
            self.sleep(self.next - now)
            now = self.next
        self.next = now + self.gap


def call_with_retry(send: Callable[[str], tuple[int, str]], text: str, tries: int = 5, sleep=time.sleep) -> tuple[str, str]:
    """(answer, error): 429, 5xx and exceptions are tried again after 1, 2, 4 ... seconds; other statuses fail at once."""
    error = ""
    for i in range(tries):
        try:
            status, body = send(text)
        except Exception as e:  # noqa: BLE001  the transport is the caller's
            error = f"{type(e).__name__}: {e}"
        else:
            if status == 200:
                return body, ""
            error = f"HTTP {status}"
            if status != 429 and status < 500:
                return "", error
        if i < tries - 1:
            sleep(2.0**i)
    return "", error


def key_from(environment: dict[str, str], name: str) -> str:
    """The key of a service; a missing one is an error before any call."""
    if not environment.get(name):
        raise ValueError(f"the scorer needs {name}")
    return environment[name]


def answer_of(body: str, path: list[str | int]) -> tuple[str, str]:
    """(text, error) of a service's JSON answer, the text at `path`."""
    try:
        found = json.loads(body)
        for step in path:
            found = found[step]
    except (ValueError, KeyError, IndexError, TypeError) as e:
        return "", f"malformed answer: {type(e).__name__}"
    return (found, "") if isinstance(found, str) else ("", "malformed answer: no text")


def likelihood_scorer(token_log_probs: Callable[[list[str], str], list[list[float]]], labels: dict[str, str] | None = None) -> Callable[[DataFrame], DataFrame]:
    """A scorer by the mean log-probability of each label's tokens after the prompt; `token_log_probs` takes prompts and a label string, three passes a batch.  `labels` overrides the strings."""
    strings = {x: x for x in LABELS} | (labels or {})

    def score(df: DataFrame) -> DataFrame:
        def ask(batches):
            for pdf in batches:
                yield pdf.assign(**{f"_lp_{x}": token_log_probs(pdf["prompt_text"].tolist(), strings[x]) for x in LABELS})

        schema = ", ".join([*(f"{c} {t}" for c, t in df.dtypes), *(f"_lp_{x} array<double>" for x in LABELS)])
        probs, label = softmax_labels([mean_log_prob(F.col(f"_lp_{x}")) for x in LABELS])
        out = df.mapInPandas(ask, schema)
        return out.withColumns({f"prob_{x}": p for x, p in zip(LABELS, probs, strict=True)} | {"predicted_label": label, "error": F.lit("")}).drop(*(f"_lp_{x}" for x in LABELS))

    return score


def remote_scorer(send: Callable[[str], tuple[int, str]], per_minute: float) -> Callable[[DataFrame], DataFrame]:
    """A scorer that asks a service, one partition at a time so that the limit holds."""

    def score(df: DataFrame) -> DataFrame:
        def ask(batches):
            limiter = RateLimiter(per_minute)
            for pdf in batches:
                out = []
                for t in pdf["prompt_text"]:
                    limiter.wait()
                    out.append(call_with_retry(send, t))
                yield pdf.assign(raw_text=[a for a, _ in out], error=[e for _, e in out])

        schema = ", ".join(f"{c} {t}" for c, t in df.dtypes) + ", raw_text string, error string"
        out = df.coalesce(1).mapInPandas(ask, schema).withColumn("predicted_label", F.coalesce(label_in(F.col("raw_text")), F.lit("")))
        return out.withColumn("error", F.when((F.col("error") == "") & (F.col("predicted_label") == ""), "no label in the answer").otherwise(F.col("error")))

    return score
