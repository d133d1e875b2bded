"""Queries without SQL against plain Python over whole tables, and the pipeline's stages on odd rows."""

import hashlib
import re

import pytest
import xxhash

import corpus_pipeline
from larkspan.llm import decontaminate, licenses, mixing, pii, registry, secrets, sharding

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def table(spark, name="documents"):
    return [r.asDict() for r in spark.read.parquet(f"{SF}/{name}.parquet").collect()]


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()


def test_op1_equals_plain_raking(spark):
    """Labels, tokens, raked weights, the scale and the draws, each step anew."""
    def topic(t):
        return "table" if 50 * t.count("|") > len(t) else "note" if len(t) < 500 else "article" if len(t) < 5000 else "book"

    rows = [(d["doc_id"], d["source"] or "(none)", d["lang"] or "(none)", topic(d["text"] or ""), len(WORD.findall(d["text"] or ""))) for d in table(spark)]
    cells = {}
    for _, *cell, n in rows:
        cells[tuple(cell)] = cells.get(tuple(cell), 0) + n
    total, raked = sum(cells.values()), {k: float(n) for k, n in cells.items()}
    wants = []
    for i, name in enumerate(mixing.DIMENSIONS):
        sums = {}
        for k, n in cells.items():
            sums[k[i]] = sums.get(k[i], 0) + n
        powers = {k: (n / total) ** mixing.TEMPER[name] for k, n in sums.items()}
        wants.append({k: p / sum(powers.values()) * total for k, p in powers.items()})
    for _ in range(mixing.ROUNDS):
        for i, want in enumerate(wants):
            have = {}
            for k, n in raked.items():
                have[k[i]] = have.get(k[i], 0) + n
            raked = {k: n * want[k[i]] / have[k[i]] if have[k[i]] else n for k, n in raked.items()}
    weight = {k: raked[k] / n if n else 1.0 for k, n in cells.items()}
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(n * min(1, mid * weight[k]) for k, n in cells.items()) < mixing.KEEP * total else (low, mid)
    got = {r.doc_id: r for r in registry.QUERIES["op1_raked_mix"](spark, SF).collect()}
    assert len(got) == len(rows)
    for doc_id, *cell, n in rows:
        r, p = got[doc_id], min(1, high * weight[tuple(cell)])
        u = (xxhash.xxh64_intdigest(mixing.SEED.to_bytes(4, "little"), xxhash.xxh64_intdigest(str(doc_id).encode(), 42)) >> 11) / 2**53
        assert [r.source, r.lang, r.topic, r.n_tokens] == [*cell, n] and r.probability == pytest.approx(p, rel=1e-5) and (abs(u - p) < 1e-4 or r.sampled == (u < p))


def test_op5_base_equals_the_patterns(spark):
    assign = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
    got = {r.doc_id: r for r in registry.QUERIES["op5_markov_secrets"](spark, SF).collect()}
    model, values, seen = secrets.train(secrets.labelled_samples()), 0, 0
    for d in table(spark):
        t, r = d["text"] or "", got[d["doc_id"]]
        spans = [("assign", *m.span()) for m in assign.finditer(t) if len(m[1]) >= 6] + [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20] + [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        spans.sort(key=lambda x: (x[1], ["assign", "access", "hex"].index(x[0])))
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[0] == k for x in spans) for k in ("assign", "access", "hex")) and r.base_sha256 == digest(spans)
        assert {f"{k}:{s}:{e}" for k, s, e in spans} <= set(r.spans.split(","))
        for k, s, e in spans:
            value = t[s:e] if k != "assign" else assign.match(t, s)[1]
            if len(value) >= secrets.MIN_RUN and secrets.RUN.fullmatch(value):
                values, seen = values + 1, seen + bool(secrets.stretches(model, value))
    assert values and seen >= 0.95 * values  # the models alone on what the base finds


def test_op7_base_equals_the_patterns(spark):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def fits(kind, x):
        digits = re.sub("[^0-9]", "", x)
        luhn = lambda: sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0
        return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in x.split(".")), "card": lambda: 13 <= len(digits) <= 19 and luhn(), "phone": lambda: 9 <= len(digits) <= 15}[kind]()

    got = {r.doc_id: r for r in registry.QUERIES["op7_crf_personal"](spark, SF).collect()}
    model, n, found = pii.train(), 0, 0
    for d in table(spark):
        t, r = d["text"] or "", got[d["doc_id"]]
        spans = [(k, *m.span()) for k, p in patterns.items() for m in re.finditer(p, t) if fits(k, m[0])]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x[0] == k for x in spans) for k in patterns) and r.base_sha256 == digest(spans)
        if spans:
            w = pii.Words(pii.pa.array([t]))
            raw = w.data.tobytes()
            own = pii._labelled_spans(t, raw, w, 0, pii.label(w, model))
            n, found = n + len(spans), found + sum(any(k == x and s < f and b < e for x, b, f in own) for k, s, e in spans)
    assert n and found >= 0.9 * n  # the field alone on what the base finds


def test_no_benchmark_window_is_left(spark):
    items = {tuple(w[i : i + 13]) for b in table(spark, "benchmark") for w in [ALNUM.findall((b["text"] or "").lower())] for i in range(len(w) - 12)}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    holds = {r.doc_id for r in docs.collect() for w in [ALNUM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))] if any(tuple(w[i : i + 13]) in items for i in range(len(w) - 12))}
    kept = {r.doc_id for r in decontaminate.drop_contaminated(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert holds and kept == {r.doc_id for r in docs.collect()} - holds


def test_items_named_by_strings_and_shared_passages(spark):
    line = " ".join(f"w{i}" for i in range(30))
    items = spark.createDataFrame([(f"i{k}", f"a{k} {line} b{k}") for k in range(30)] + [(None, line)], "item_id string, text string")
    docs = spark.createDataFrame([(i, f"x {line} y") for i in range(20)] + [(50, "clean")], "doc_id long, text string")
    got = decontaminate.contamination(docs, items).collect()
    assert all((r.n_hit, sorted(r.item_ids)) == ((30, sorted(["", *(f"i{k}" for k in range(30))])) if r.doc_id < 50 else (0, [])) for r in got)


def test_license_rows_without_id_are_apart(spark):
    rows = [(None, "all rights"), (None, "reserved cc"), (None, "cc by"), (4, "general public"), (4, "license here")]
    got = sorted((r.n_words, r.n_base, r.base_labels) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(2, 0, ""), (2, 0, ""), (2, 0, ""), (2, 0, ""), (2, 1, "cc-by")]


def test_maps_are_stored_and_rebalanced(spark, tmp_path):
    docs = spark.createDataFrame([(i, "x" * (4000 if sharding.map_of(4)[0] == i % 4 else 10)) for i in range(4000)], "doc_id long, text string")
    path = str(tmp_path / "maps")
    sharding.store_map(spark, path, sharding.map_of(4), 4)
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        sharding.store_map(spark, path, sharding.map_of(4), 4)
    before = sharding.assign(docs, maps=path).groupBy("shard").sum("size").toPandas()["sum(size)"]
    assert sharding.rebalance(docs, path) == 5 and sharding.load_map(spark, path, 4) == (4, sharding.map_of(4))
    after = sharding.assign(docs, maps=path)
    load = after.groupBy("shard").sum("size").toPandas()["sum(size)"]
    assert load.max() <= 1.02 * load.mean() <= before.max() and {r.version for r in after.select("version").distinct().collect()} == {5}
    sharding.write_shards(docs.selectExpr("*", "1 AS shard"), str(tmp_path / "out"), sharding.map_of(4))
    assert spark.read.parquet(str(tmp_path / "out")).selectExpr("count(*)", "count(DISTINCT _shard)", "max(shard)").first()[:] == (4000, 4, 1)


@pytest.mark.parametrize("empty", [False, True])
def test_stages_take_odd_rows(spark, tmp_path, empty):
    """Nulls everywhere, empty and long texts, repeated rows, shared ids and columns named like those made on the way."""
    good = " ".join(f"the good w{i} of" for i in range(40))
    rows = [(None, good), (None, good + " more"), (1, None), (2, ""), (3, good), (3, good), (4, good + " other end"), (4, "quite the other text of " + good[::-1]), (5, " ".join(f"the w{i} of" for i in range(100_000))), (6, "x" * 1_000_000), (7, good.upper())]
    clash = "_nth string, _hit_id string, _part string, __lm_p string, __lm_n string, __lq_words string, shard string, part string, print string, n int"
    data = [(*r, None, "s" if i % 2 else None, *"abcdefghi", i) for i, r in enumerate(rows)]
    docs = spark.createDataFrame([] if empty else data, f"doc_id long, text string, lang string, source string, {clash}")
    spark.createDataFrame([(1, "nothing of it " * 9), (None, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    columns = docs.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / f"stage{i}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{i}"))
        if i < 4:
            assert docs.columns == columns
        if i == 1 and not empty:
            assert sorted((r.doc_id for r in docs.collect()), key=repr) == [3, 5, None, None]
    assert not empty or docs.count() == 0
