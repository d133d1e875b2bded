"""The queries once more, as SQL for DuckDB: written apart from the operators so that each checks the other."""

from __future__ import annotations

from larkspan.functions.lists import GENDER_CUES, ORIGIN_TERMS, ROLE_NAME, STOP_WORDS, URL_CONTACT
from larkspan.functions.text import LABELS, term_pattern
from larkspan.operators.design import ASK, CONDITIONS, LOCATIONS, NAMED, NAMES
from larkspan.plans.queries import QUOTAS


def _q(x) -> str:
    return "'" + str(x).replace("'", "''") + "'"


def _list(xs) -> str:
    return ", ".join(map(_q, xs))


REVIEWS = f"""
profile AS (
  SELECT doc_id, printf('R%04d', doc_id) AS review_id, source, CAST(1 + doc_id % 5 AS INTEGER) AS stars, trim(regexp_replace(coalesce(text, ''), '[\\s\\x0b\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', ' ', 'g')) AS text FROM documents
), toks AS (
  SELECT *, regexp_extract_all(lower(text), '[a-z'']+') AS toks FROM profile
), reviews AS (
  SELECT doc_id, review_id, source, stars, CASE WHEN stars <= 2 THEN 'negative' WHEN stars = 3 THEN 'neutral' ELSE 'positive' END AS sentiment_label, text,
         CAST(CASE WHEN text = '' THEN 0 ELSE len(string_split(text, ' ')) END AS INTEGER) AS n_words, length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) / greatest(length(text), 1) AS ascii_ratio,
         CAST(len(toks) AS INTEGER) AS n_tokens, len(list_filter(toks, lambda x: x IN ({_list(STOP_WORDS)}))) / greatest(len(toks), 1) AS stop_ratio, md5(regexp_replace(lower(text), '[^a-z0-9]', '', 'g')) AS dedup_key
  FROM toks
)"""


def _rx(pattern: str) -> str:
    """For RE2, whose classes are ASCII alone; texts are normalised, so white space is the space."""
    return _q("(?i)" + pattern.replace("(?iU)", "").replace(r"\w", r"\p{L}\p{N}_").replace(r"\d", r"\p{Nd}"))


_REASON = f"""CASE WHEN stars IS NULL THEN 'bad_rating' WHEN stars NOT IN ({", ".join(map(str, QUOTAS))}) THEN 'rating_not_in_plan' WHEN n_words < 20 OR n_words > 120 THEN 'length' WHEN regexp_matches(text, {_rx(URL_CONTACT)}) THEN 'url_or_contact' WHEN ascii_ratio < 0.98 OR stop_ratio < 0.20 THEN 'non_english'
  WHEN regexp_matches(text, {_q(ROLE_NAME)}) THEN 'person_name' WHEN regexp_matches(text, {_q("(?i)" + "|".join(GENDER_CUES))}) THEN 'gender_cue' WHEN regexp_matches(text, {_rx(term_pattern(ORIGIN_TERMS))}) THEN 'ethnicity_religion_location_cue' ELSE 'eligible' END"""
ELIGIBLE = REVIEWS + f""", eligible AS (
  SELECT * FROM reviews WHERE {_REASON} = 'eligible' QUALIFY row_number() OVER (PARTITION BY dedup_key ORDER BY doc_id) = 1
)"""
_POOL = ", ".join(f"({_q(c)}, {_q(n)}, {_q(s)})" for c, pool in NAMES.items() for n, s in pool)
PROMPTS = REVIEWS + f""", pool(condition, name, sub_region) AS (VALUES {_POOL}), items AS (
  SELECT *, row_number() OVER (ORDER BY md5('42' || review_id), review_id) - 1 AS i FROM reviews
), blocks AS (
  SELECT condition, name, sub_region, b, row_number() OVER (PARTITION BY condition, b ORDER BY md5(concat_ws(':', '42', condition, b, name)), name) - 1 AS slot
  FROM pool, (SELECT unnest(range((SELECT max(i) // 12 + 1 FROM items))) AS b)
), prompts AS (
  SELECT review_id || '_' || c.condition AS prompt_id, review_id, c.condition, CASE WHEN c.condition = 'none' THEN 'none' ELSE regexp_replace(c.condition, '_[^_]*$', '') END AS region,
         CASE WHEN c.condition = 'none' THEN 'none' ELSE regexp_extract(c.condition, '[^_]*$') END AS gender, coalesce(name, '') AS name, coalesce(sub_region, 'none') AS sub_region,
         CASE WHEN c.condition = 'none' THEN '' ELSE 'Written by: ' || name || chr(10) || chr(10) END || 'Review: "' || text || {_q(ASK).replace(chr(10), "' || chr(10) || '")} AS prompt_text, sentiment_label, source, stars, text
  FROM items CROSS JOIN (VALUES {", ".join(f"({_q(c)})" for c in CONDITIONS)}) AS c(condition) LEFT JOIN blocks ON blocks.condition = c.condition AND b = i // 12 AND slot = i % 12
)"""


def _mod(text: str, m: int, shift: int = 0) -> str:
    d = f"substr(md5({text}), 1, {32 - shift})"
    return f"CAST(((('0x' || substr({d}, 1, {16 - shift}))::UBIGINT % {m}) * {2**64 % m} + ('0x' || substr({d}, {17 - shift}, 16))::UBIGINT % {m}) % {m} AS INTEGER)"


def _vote(values: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN {v} = greatest({', '.join(values)}) THEN '{x}'" for v, x in zip(values, LABELS, strict=True)) + " END"


RESPONSES = PROMPTS + f""", logits AS (
  SELECT prompt_id, run_index, {", ".join(_mod("prompt_text || ':' || run_index", 100, 2 * i) + f" AS l{i}" for i in range(3))} FROM prompts, (VALUES (1), (2), (3)) AS r(run_index)
), responses AS (
  SELECT prompt_id, run_index, 'mock' AS model, {_vote(["l0", "l1", "l2"])} AS predicted_label FROM logits
), counted AS (
  SELECT model, prompt_id, {", ".join(f"CAST(count(*) FILTER (predicted_label = '{x}') AS INTEGER) AS n{i}" for i, x in enumerate(LABELS))}, CAST(count(*) AS INTEGER) AS n_valid_runs FROM responses GROUP BY ALL
), voted AS (
  SELECT model, prompt_id, {_vote(["n0", "n1", "n2"])} AS predicted_label, greatest(n0, n1, n2) / n_valid_runs AS self_consistency, n_valid_runs FROM counted
), merged AS (
  SELECT model, v.prompt_id, predicted_label, self_consistency, n_valid_runs, review_id, condition, region, gender, sub_region, sentiment_label AS ground_truth_label, stars, source,
         CASE predicted_label WHEN 'negative' THEN -1 WHEN 'neutral' THEN 0 ELSE 1 END AS score, CASE sentiment_label WHEN 'negative' THEN -1 WHEN 'neutral' THEN 0 ELSE 1 END AS ground_truth_score,
         CAST(predicted_label = sentiment_label AS INTEGER) AS correct
  FROM voted v JOIN prompts USING (prompt_id)
), named AS (SELECT * FROM merged WHERE condition IN ({_list(NAMED)}))"""
PARTIAL = PROMPTS + f""", calls AS (SELECT prompt_id, run_index FROM prompts, (VALUES (1), (2), (3)) AS r(run_index)
), hashed AS (SELECT *, {_mod("prompt_id || ':' || run_index", 30)} AS h FROM calls
), log AS (SELECT prompt_id, run_index, CASE WHEN h % 2 = 0 THEN 'timeout' ELSE '' END AS error FROM hashed WHERE h % 3 = 0)"""
RATERS = "raters AS (SELECT doc_id AS id, CASE WHEN quality = 0 THEN 'negative' ELSE 'positive' END AS a, CASE WHEN toxic = 1 THEN 'negative' ELSE 'positive' END AS b FROM labels)"


def _contrast(column: str, a: str, b: str) -> str:
    return f"""WITH {RESPONSES}, g AS (SELECT model, count(DISTINCT review_id) AS n_clusters, avg(score) FILTER ({column} = '{a}') AS ma, avg(score) FILTER ({column} = '{b}') AS mb, stddev_samp(score) AS sd FROM named GROUP BY model)
SELECT model, n_clusters, round(ma, 9) AS mean_a, round(mb, 9) AS mean_b, round(sd, 9) AS sd, round(ma - mb, 9) AS mean_diff, round((ma - mb) / nullif(sd, 0), 9) AS cohens_d FROM g"""


def _draws(replicates: int, seed: str, order: str) -> str:
    return f"""numbered AS (SELECT *, row_number() OVER (ORDER BY {order}) - 1 AS pick FROM clusters
), size AS (SELECT count(*) AS n FROM clusters
), drawn AS (SELECT b, ('0x' || substr(md5('{seed}:' || b || ':' || i), 1, 8))::BIGINT % n AS pick FROM (SELECT unnest(range({replicates})) AS b) CROSS JOIN (SELECT n, unnest(range(n)) AS i FROM size))"""


def _boot(column: str, a: str, b: str, seed: str) -> str:
    return f"""WITH {RESPONSES}, clusters AS (
  SELECT review_id AS cluster, sum(score) FILTER ({column} = '{a}') AS sa, count(*) FILTER ({column} = '{a}') AS na, sum(score) FILTER ({column} = '{b}') AS sb, count(*) FILTER ({column} = '{b}') AS nb FROM named GROUP BY review_id
), {_draws(2000, seed, "sa, na, sb, nb")}, reps AS (SELECT b, sum(sa) / sum(na) - sum(sb) / sum(nb) AS d FROM drawn JOIN numbered USING (pick) GROUP BY b
), ci AS (SELECT round(quantile_cont(d, 0.025), 9) AS ci95_lo, round(quantile_cont(d, 0.975), 9) AS ci95_hi, round(quantile_cont(d, 0.05), 9) AS ci90_lo, round(quantile_cont(d, 0.95), 9) AS ci90_hi FROM reps)"""


def _kappa(weighted: bool) -> str:
    w = "(abs(i - j) / 2.0) * (abs(i - j) / 2.0)" if weighted else "CAST(i <> j AS INTEGER)"
    return f"""WITH {RATERS}, k(l, i) AS (VALUES {", ".join(f"('{x}', {i})" for i, x in enumerate(LABELS))}), p AS (SELECT x.i, y.i AS j FROM raters JOIN k x ON a = x.l JOIN k y ON b = y.l
), s AS (SELECT count(*) AS n, sum({w}) / count(*) AS seen, avg(CAST(i = j AS INTEGER)) AS raw FROM p
), e AS (SELECT sum({w} * ca * cb) AS chance FROM (SELECT i, count(*) AS ca FROM p GROUP BY i), (SELECT j, count(*) AS cb FROM p GROUP BY j))
SELECT n, round(raw, 9) AS raw_agreement, round(CASE WHEN chance = 0 THEN 1 ELSE 1 - seen / (chance / (n * n)) END, 9) AS kappa, CASE WHEN n < 30 THEN 'too few rows' ELSE 'ok' END AS status FROM s, e"""


_QUOTA = ", ".join(f"({s}, {q})" for s, q in QUOTAS.items())
_LOC = ", ".join(f"({_q(r)}, {_q(x)})" for r, xs in LOCATIONS.items() for x in xs)
_E = [f"list_transform(embedding[{1 + 3 * i} : {2 + 4 * i}], lambda x: -abs(CAST(x AS DOUBLE)))" for i in range(3)]
_LMM = f"""WITH {RESPONSES}, w AS (SELECT model, review_id, {", ".join(f"avg(score) FILTER (condition = '{c}') AS c{i}" for i, c in enumerate(NAMED))} FROM named GROUP BY ALL HAVING count(DISTINCT condition) = 4
), s AS (SELECT model, count(*) AS n, {", ".join(f"avg(c{i}) AS a{i}" for i in range(4))}, ({" + ".join(f"var_samp(c{i})" for i in range(4))}) * (count(*) - 1) AS wi, 4 * var_samp((c0 + c1 + c2 + c3) / 4) * (count(*) - 1) AS re FROM w GROUP BY model
), v AS (SELECT *, (wi - re) / (3 * (n - 1)) AS e, (re / (n - 1) - (wi - re) / (3 * (n - 1))) / 4 AS u FROM s
), f AS (SELECT *, CASE WHEN u < 0 THEN wi / (4 * n - 4) ELSE e END AS s2e, greatest(u, 0) AS s2u FROM v
), t AS (SELECT model, n, s2e, s2u, unnest([{{'term': 'intercept', 'coef': a0, 'var': (s2e + s2u) / n}}, {{'term': 'region[south_asian]', 'coef': a2 - a0, 'var': 2 * s2e / n}}, {{'term': 'gender[female]', 'coef': a1 - a0, 'var': 2 * s2e / n}}, {{'term': 'region[south_asian]:gender[female]', 'coef': a3 - a2 - a1 + a0, 'var': 4 * s2e / n}}], recursive := true) FROM f)"""
#: Two-sided normal tail of coef / sqrt(var), by the series erf(x) = exp(-x^2) * sum of x^(2n+1) / gamma(n + 3/2).
_X = "greatest(abs(coef / sqrt(var)) / sqrt(2), 1e-300)"
_TAIL = f"greatest(0.0, 1 - list_sum(list_transform(range(2000), lambda n: exp((2 * n + 1) * ln({_X}) - {_X} * {_X} - lgamma(n + 1.5)))))"

SQL = {
    "text_profile": f"WITH {REVIEWS} SELECT doc_id, n_words, round(ascii_ratio, 9) AS ascii_ratio, CAST(length(text) AS INTEGER) AS n_chars, n_tokens, round(stop_ratio, 9) AS stop_ratio, dedup_key FROM reviews",
    "rating_parse": "WITH r AS (SELECT event_id, CAST(round_even(value, 0) AS INTEGER) AS stars FROM events) SELECT event_id, stars, CASE WHEN stars <= 2 THEN 'negative' WHEN stars = 3 THEN 'neutral' WHEN stars > 3 THEN 'positive' END AS label, CASE WHEN stars IS NULL THEN 'bad_rating' WHEN stars NOT BETWEEN 1 AND 5 THEN 'rating_not_in_plan' END AS reason FROM r",
    "reject_funnel": f"WITH {REVIEWS}, r AS (SELECT source, {_REASON} AS reject_reason FROM reviews) SELECT source, reject_reason, count(*) AS n FROM r GROUP BY ALL UNION ALL SELECT source, 'scanned', count(*) FROM r GROUP BY source",
    "dedup_first": f"WITH {REVIEWS} SELECT dedup_key, doc_id, source FROM reviews QUALIFY row_number() OVER (PARTITION BY dedup_key ORDER BY doc_id) = 1",
    "stratified_sample": f"WITH {ELIGIBLE}, q(stars, quota) AS (VALUES {_QUOTA}) SELECT review_id, source, stars FROM (SELECT *, row_number() OVER (PARTITION BY source, stars ORDER BY md5('42:' || source || ':' || review_id), review_id) AS rn FROM eligible) JOIN q USING (stars) WHERE rn <= quota",
    "shortfall": f"WITH {ELIGIBLE}, q(stars, quota) AS (VALUES {_QUOTA}), c AS (SELECT source, stars, count(*) AS n FROM eligible GROUP BY ALL) SELECT source, stars, coalesce(n, 0) AS n_eligible, least(coalesce(n, 0), quota) AS n_selected, quota - least(coalesce(n, 0), quota) AS n_short FROM (SELECT DISTINCT source FROM eligible) CROSS JOIN q LEFT JOIN c USING (source, stars)",
    "annotation_alloc": f"WITH {ELIGIBLE} SELECT source, stars, count(*) AS n, greatest(1, CAST(round_even(150.0 * count(*) / sum(count(*)) OVER (), 0) AS INTEGER)) AS take FROM eligible GROUP BY source, stars",
    "expand_conditions": f"WITH {PROMPTS} SELECT prompt_id, review_id, condition, region, gender, name, sub_region, md5(prompt_text) AS prompt_md5 FROM prompts",
    "balanced_names": f"WITH {PROMPTS} SELECT condition, name, sub_region, count(*) AS n_uses FROM prompts WHERE condition <> 'none' GROUP BY ALL",
    "location_arm": f"""WITH {REVIEWS}, pool(region, location) AS (VALUES {_LOC}), items AS (SELECT *, row_number() OVER (ORDER BY md5('500042' || review_id), review_id) - 1 AS i FROM reviews), blocks AS (SELECT region, location, b, row_number() OVER (PARTITION BY region, b ORDER BY md5(concat_ws(':', '500042', region, b, location)), location) - 1 AS slot FROM pool, (SELECT unnest(range((SELECT max(i) // 4 + 1 FROM items))) AS b))
SELECT review_id || '_loc_' || region AS prompt_id, region, location, md5('Written in: ' || location || chr(10) || chr(10) || 'Review: "' || text || {_q(ASK).replace(chr(10), "' || chr(10) || '")}) AS prompt_md5 FROM items JOIN blocks ON b = i // 4 AND slot = i % 4""",
    "text_identity": f"WITH {PROMPTS} SELECT condition, count(*) AS n_prompts, count(*) FILTER (NOT contains(prompt_text, 'Review: \"' || text || '\"')) AS n_changed FROM prompts GROUP BY condition",
    "mock_scores": f"WITH {PROMPTS}, l AS (SELECT prompt_id, {', '.join(_mod('prompt_text', 100, 2 * i) + f' AS l{i}' for i in range(3))}, {_mod('prompt_text', 1000)} AS f FROM prompts), p AS (SELECT *, pow(2.718281828, l0 / 100) AS e0, pow(2.718281828, l1 / 100) AS e1, pow(2.718281828, l2 / 100) AS e2 FROM l) SELECT prompt_id, CASE WHEN f < 50 THEN '' ELSE {_vote(['l0', 'l1', 'l2'])} END AS predicted_label, CASE WHEN f < 50 THEN 'simulated failure' ELSE '' END AS error, {', '.join(f'CASE WHEN f >= 50 THEN round(e{i} / (e0 + e1 + e2), 9) END AS prob_{x}' for i, x in enumerate(LABELS))} FROM p",
    "softmax_labels": f"WITH m AS (SELECT vec_id, {', '.join(f'list_sum({e}) / len({e}) AS m{i}' for i, e in enumerate(_E))} FROM embeddings), e AS (SELECT *, {', '.join(f'exp(m{i} - greatest(m0, m1, m2)) AS e{i}' for i in range(3))} FROM m) SELECT vec_id, {_vote(['m0', 'm1', 'm2'])} AS label, {', '.join(f'round(e{i} / (e0 + e1 + e2), 9) AS prob_{x}' for i, x in enumerate(LABELS))} FROM e",
    "label_parse": "WITH t AS (SELECT conv_id, turn, regexp_replace(lower(concat_ws(' ', text, ['Positive!', 'neg-ative', 'no idea', 'NEUTRAL / positive'][CAST(turn % 4 + 1 AS INTEGER)])), '[^a-z]', '', 'g') AS l FROM conversations) SELECT conv_id, turn, CASE WHEN contains(l, 'negative') THEN 'negative' WHEN contains(l, 'neutral') THEN 'neutral' WHEN contains(l, 'positive') THEN 'positive' END AS label FROM t",
    "slug": "SELECT p_partkey, trim(lower(regexp_replace(concat_ws(' / ', p_name, p_type), '[^A-Za-z0-9]+', '-', 'g')), '-') AS slug FROM part",
    "resume_anti": f"WITH {PARTIAL} SELECT prompt_id, run_index FROM calls ANTI JOIN (SELECT * FROM log WHERE error = '') USING (prompt_id, run_index)",
    "resume_attempted": f"WITH {PARTIAL} SELECT prompt_id, run_index FROM calls ANTI JOIN log USING (prompt_id, run_index)",
    "run_stats": f"WITH {PARTIAL} SELECT (SELECT count(*) FROM calls) AS n_needed, count(*) FILTER (error = '') AS n_done, count(*) FILTER (error <> '') AS n_errors, count(*) AS n_rows FROM log",
    "majority_vote": f"WITH {RESPONSES} SELECT model, prompt_id, predicted_label, round(self_consistency, 9) AS self_consistency, n_valid_runs FROM voted",
    "merged_long": f"WITH {RESPONSES} SELECT * REPLACE (round(self_consistency, 9) AS self_consistency) FROM merged",
    "load_stats": f"WITH {RESPONSES} SELECT model, count(*) AS n_prompts_seen, count(*) AS n_joined, count(*) FILTER (predicted_label IS NULL) AS n_without_label FROM merged GROUP BY model",
    "condition_means": f"WITH {RESPONSES} SELECT model, condition, round(avg(score), 9) AS mean_score, round(stddev_samp(score) / sqrt(count(*)), 9) AS sem, round(1.96 * (stddev_samp(score) / sqrt(count(*))), 9) AS half_bar FROM named GROUP BY model, condition",
    "contrast_region": _contrast("region", "western", "south_asian"),
    "contrast_gender": _contrast("gender", "male", "female"),
    "confusion": f"WITH {RESPONSES} SELECT model, condition, t.l AS truth, p.l AS predicted, count(*) FILTER (ground_truth_label = t.l AND predicted_label = p.l) AS n FROM merged, (VALUES {', '.join(f'({_q(x)})' for x in LABELS)}) AS t(l), (VALUES {', '.join(f'({_q(x)})' for x in LABELS)}) AS p(l) GROUP BY ALL",
    "class_metrics": f"""WITH {RESPONSES}, k(l) AS (VALUES {", ".join(f"({_q(x)})" for x in LABELS)}), per AS (SELECT model, condition, l, count(*) FILTER (ground_truth_label = l AND predicted_label = l) AS tp, count(*) FILTER (predicted_label = l) AS np, count(*) FILTER (ground_truth_label = l) AS nt FROM merged, k GROUP BY ALL
), macro AS (SELECT model, condition, avg(coalesce(tp / nullif(np, 0), 0)) AS mp, avg(coalesce(tp / nullif(nt, 0), 0)) AS mr, avg(coalesce(2 * tp / nullif(np + nt, 0), 0)) AS mf FROM per GROUP BY ALL)
SELECT model, condition, count(*) AS n, '[' || {" || ',' || ".join("'[' || " + " || ',' || ".join(f"count(*) FILTER (ground_truth_label = '{t}' AND predicted_label = '{p}')" for p in LABELS) + " || ']'" for t in LABELS)} || ']' AS confusion_matrix, round(avg(correct), 9) AS accuracy, round(any_value(mp), 9) AS macro_precision, round(any_value(mr), 9) AS macro_recall, round(any_value(mf), 9) AS macro_f1 FROM merged JOIN macro USING (model, condition) GROUP BY model, condition""",
    "flip_rate": f"""WITH {RESPONSES}, per AS (SELECT model, review_id, count(DISTINCT condition) AS k, CAST(count(DISTINCT predicted_label) > 1 AS INTEGER) AS flip, arg_min(stars, prompt_id) AS stars FROM named GROUP BY ALL
), s AS (SELECT model, unnest(['overall', CASE WHEN stars = 3 THEN 'ambiguous' ELSE 'clear_cut' END]) AS subset, flip FROM per WHERE k = 4)
SELECT m.model, g.subset, count(flip) AS n_reviews, coalesce(sum(flip), 0)::BIGINT AS n_flipped, round(avg(flip), 9) AS flip_rate FROM (SELECT DISTINCT model FROM merged) m CROSS JOIN (VALUES ('overall'), ('ambiguous'), ('clear_cut')) AS g(subset) LEFT JOIN s ON s.model = m.model AND s.subset = g.subset GROUP BY ALL""",
    "boot_region": _boot("region", "western", "south_asian", "42") + " SELECT * FROM ci",
    "boot_gender": _boot("gender", "male", "female", "43") + " SELECT * FROM ci",
    "accuracy_ci": f"""WITH {RESPONSES}, sums AS (SELECT condition, review_id AS cluster, sum(correct) AS ok, count(*) AS n_rows FROM merged GROUP BY ALL), numbered AS (SELECT *, row_number() OVER (PARTITION BY condition ORDER BY ok, n_rows) - 1 AS pick FROM sums), size AS (SELECT condition, count(*) AS n FROM sums GROUP BY condition
), drawn AS (SELECT condition, b, ('0x' || substr(md5('42:' || b || ':' || i), 1, 8))::BIGINT % n AS pick FROM (SELECT unnest(range(1000)) AS b) CROSS JOIN (SELECT condition, n, unnest(range(n)) AS i FROM size)
), reps AS (SELECT condition, b, sum(ok) / sum(n_rows) AS d FROM drawn JOIN numbered USING (condition, pick) GROUP BY ALL)
SELECT condition, round(quantile_cont(d, 0.025), 9) AS ci95_lo, round(quantile_cont(d, 0.975), 9) AS ci95_hi FROM reps GROUP BY condition""",
    "tost": _boot("region", "western", "south_asian", "42") + ", sd AS (SELECT 0.2 * stddev_samp(score) AS r FROM named) SELECT ci90_lo, ci90_hi, ci95_lo, ci95_hi, round(r, 9) AS sesoi_raw, CASE WHEN ci90_lo > -r AND ci90_hi < r THEN 'equivalent' WHEN ci95_lo > 0 OR ci95_hi < 0 THEN 'significant' ELSE 'inconclusive' END AS verdict FROM ci, sd",
    "lmm_region": _LMM + " SELECT model, term, n AS n_groups, round(coef, 9) AS coef, round(sqrt(var), 9) AS se, round(coef / sqrt(var), 9) AS z, round(s2e, 9) AS residual_var, round(s2u, 9) AS intercept_var FROM t",
    "lmm_terms": _LMM + f" SELECT model, term, n AS n_groups, round(coef, 9) AS coef, round(sqrt(var), 9) AS se, round(coef / sqrt(var), 9) AS z, round(s2e, 9) AS residual_var, round(s2u, 9) AS intercept_var, round({_TAIL}, 9) AS p_value, round(coef - 1.959963984540054 * sqrt(var), 9) AS ci95_lo, round(coef + 1.959963984540054 * sqrt(var), 9) AS ci95_hi FROM t",
    "holm": _LMM + f", p AS (SELECT model, term, {_TAIL} AS p FROM t WHERE term IN ('region[south_asian]', 'gender[female]')), r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY p, term) AS r, count(*) OVER (PARTITION BY model) AS m FROM p) SELECT model, term, round(p, 9) AS p, round(least(1.0, max(p * (m + 1 - r)) OVER (PARTITION BY model ORDER BY r)), 9) AS p_holm FROM r",
    "kappa": _kappa(False),
    "kappa_weighted": _kappa(True),
    "kappa_ci": f"""WITH {RATERS}, clusters AS (SELECT id AS cluster, a, b FROM raters), {_draws(2000, "42", "a DESC, b DESC").replace("SELECT b, (", "SELECT r, (").replace("AS b)", "AS r)").replace(":' || b ||", ":' || r ||")}, cells AS (SELECT r, a, b, count(*) AS c FROM drawn JOIN numbered USING (pick) GROUP BY ALL
), n AS (SELECT r, sum(c) AS n, sum(c) FILTER (a <> b) AS d FROM cells GROUP BY r), ma AS (SELECT r, a AS l, sum(c) AS ca FROM cells GROUP BY ALL), mb AS (SELECT r, b AS l, sum(c) AS cb FROM cells GROUP BY ALL
), e AS (SELECT r, sum(ca * cb) AS same FROM ma JOIN mb USING (r, l) GROUP BY r), k AS (SELECT CASE WHEN coalesce(same, 0) = n * n THEN 1 ELSE 1 - (coalesce(d, 0) / n) / (1 - coalesce(same, 0) / (n * n)) END AS k FROM n LEFT JOIN e USING (r)
), o AS (SELECT list(k ORDER BY k) AS v FROM k) SELECT round(v[CAST(floor(0.025 * len(v)) AS INTEGER) + 1], 9) AS ci95_lo, round(v[CAST(floor(0.975 * len(v)) AS INTEGER)], 9) AS ci95_hi FROM o""",
    "agreement_table": f"WITH {RATERS} SELECT a, count(*) FILTER (b = 'negative') AS negative, count(*) FILTER (b = 'neutral') AS neutral, count(*) FILTER (b = 'positive') AS positive FROM raters GROUP BY a",
    "disagreements": f"WITH {RATERS} SELECT * FROM raters WHERE a <> b",
    "self_consistency": f"WITH {RESPONSES} SELECT model, round(avg(self_consistency), 9) AS mean_self_consistency, count(*) AS n_repeated, 'flips at or below 1 - self-consistency may be noise' AS note FROM merged GROUP BY model",
}
