import re

import pytest
import xxhash

from larkspan.llm import decontaminate, simhash
from larkspan.llm.components import components
from larkspan.llm.resemblance import resembling_links

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def prints(rows):
    out = []
    for d, t in rows:
        w = WORD.findall(lower(t))
        shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
        hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        out.append((d, sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))))
    return out


def linked(found):
    parent = list(range(len(found)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(found)):
        for j in range(i):
            if (found[i][1] ^ found[j][1]).bit_count() <= 2:
                parent[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(found):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return sorted(((d, format(p, "016x"), least.get(top(i))) for i, (d, p) in enumerate(found)), key=repr)


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_simhash_equals_brute_force(spark, size):
    rows = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{size}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, simhash.op3_simhash_ball(spark, f"/root/testdata/{size}").collect()), key=repr) == linked(prints(rows))


def five_word_shingles(text):
    w = WORD.findall(lower(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_near_copies_leave_and_others_stay(spark):
    """Whole sets against brute force: no two kept texts share 0.8 of their shingles, and whatever went is near one that came before."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets = {r.doc_id: five_word_shingles(r.text) for r in docs.collect()}
    kept = {r.doc_id for r in simhash.keep_one(docs).collect()}
    firsts = {r.component_id for r in simhash.near_duplicates(docs).collect()}
    holders = {}
    for d in firsts:
        for s in sets[d]:
            holders.setdefault(s, []).append(d)
    near = {(x, y) for ds in holders.values() for x in ds for y in ds if x < y and len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y])}
    assert near and not any(x in kept and y in kept for x, y in near)
    assert firsts - kept == {max(p) for p in near if max(p) not in kept} and kept <= firsts


def test_resembling_group_of_copies(spark):
    """A large group of near copies keeps its smallest doc_id; a text that shares half of it, and short texts, stay."""
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(words[:100] + [f"x{i}"] + words[101:])) for i in range(10, 210)]
    rows += [(300, " ".join(words[:100] + [f"z{i}" for i in range(100)])), (301, "a few words"), (302, None), (10, rows[0][1])]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, a int, key string")
    assert sorted(r.doc_id for r in simhash.keep_one(df).collect()) == [10, 300, 301, 302]
    assert simhash.keep_one(df.limit(0)).collect() == [] and simhash.keep_one(df).columns == df.columns


def test_near_copies_inside_a_family(spark):
    """Pairs at 0.804 in a family at 0.75: each ends in a group of its own, wherever the hubs of its keys are."""
    passage = [f"w{i}" for i in range(304)]
    rows = [(2 * i + j, " ".join([*passage, *(f"p{i}_{k}" for k in range(12)), *(f"d{i}_{j}_{k}" for k in range(38))])) for i in range(150) for j in range(2)]
    sets = {d: five_word_shingles(t) for d, t in rows}
    assert len(sets[0] & sets[1]) >= 0.8 * len(sets[0] | sets[1]) and len(sets[0] & sets[2]) == 0.75 * len(sets[0] | sets[2])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, resembling_links(docs, docs.select("doc_id")).collect())) == [(2 * i + 1, 2 * i) for i in range(150)]


def test_simhash_odd_rows(spark):
    rows = [(5, None), (2, ""), (3, " \t"), (4, "One Two"), (9, "one two"), (None, "one two"), (7, "a b c d " * 3000), (7, "a b c d " * 3000), (None, "quite alone here")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, component long")
    got = sorted(((r.doc_id, format(r.print & (2**64 - 1), "016x"), r.component_id) for r in simhash.near_duplicates(df).collect()), key=repr)
    assert got == linked(prints(rows))
    kept = [r.doc_id for r in simhash.keep_one(df).collect()]
    assert sorted(kept, key=repr) == [2, 4, 7, None, None]
    assert simhash.keep_one(df).columns == df.columns
    assert simhash.near_duplicates(df.limit(0)).collect() == []


def test_ball_links_connect_all_within_two_bits(spark):
    base = [0x123456789ABCDEF0, -1, 0, 1 << 62]
    values = sorted({v ^ a for v in base for a in (0, 1, 2, 3, 5, 6, 1 << 40, (1 << 40) | 1, 3 << 61)})
    found = {r.node: r.component for r in components(simhash.ball_links(spark.createDataFrame([(v,) for v in values], "print long"))).collect()}
    want = {d: c for d, _, c in linked([(v, v & (2**64 - 1)) for v in values])}
    assert {v: found.get(v, v) for v in values} == want


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def hits(docs, items, n=13):
    out = []
    windows = {}
    for item, t in items:
        w = ALNUM.findall(lower(t))
        for i in range(max(1, len(w) - n + 1)) if w else []:
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    for d, t in docs:
        w, gone, found = ALNUM.findall(lower(t)), set(), set()
        for size in {len(k) for k in windows}:
            for i in range(len(w) - size + 1):
                if own := windows.get(tuple(w[i : i + size])):
                    gone.update(range(i, i + size))
                    found |= own
        out.append((d, len(w), len(gone), sorted(found, key=repr), bool(gone) and 20 * len(gone) >= len(w)))
    return sorted(out, key=repr)


def test_decontamination_equals_brute_force(spark):
    line = " ".join(f"w{i}" for i in range(40))
    items = [(1, line), (2, "Short item"), (3, None), (4, "..."), (5, "one"), (6, line[:60]), (None, "w1 w2"), (7, "é ß " * 8)]
    docs = [(1, "x " + line + " y"), (2, "a short ITEM here"), (3, None), (4, ""), (5, "w20 w21 w22 " + " ".join(f"w{i}" for i in range(23, 35))), (6, "none of it"), (7, "One. Two. One"), (7, "One. Two. One"), (None, "é,ß," * 7), (8, " ".join(["pad"] * 5000) + " short item"), (9, "é ß " * 9)]
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, gram int")
    b = spark.createDataFrame(items, "item_id long, text string")
    for block in (decontaminate.BLOCK, 7):
        got = [(r.doc_id, r.n_words, r.n_hit, sorted((None if x == 2**63 - 1 else x for x in r.item_ids), key=repr), r.contaminated) for r in decontaminate.contamination(d, b, block=block).collect()]
        assert sorted(got, key=repr) == hits(docs, items)
    assert sorted((r.doc_id for r in decontaminate.drop_contaminated(d, b).collect()), key=repr) == sorted((x[0] for x in hits(docs, items) if not x[4]), key=repr)


def test_rows_without_id_are_judged_apart(spark):
    """A clean text without an id stays beside a contaminated one; hits, items and verdicts are each text's own."""
    line, other = (" ".join(f"{c}{i}" for i in range(20)) for c in "wv")
    rows = [(None, line), (None, "x " + line), (None, line), (None, "quite clean here"), (None, other), (None, None), (None, ""), (2**63 - 1, "as clean"), (3, "clean")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    b = spark.createDataFrame([(1, line), (2, other)], "item_id long, text string")
    got = [(r.n_words, r.n_hit, sorted(r.item_ids), r.contaminated) for r in decontaminate.contamination(d, b).collect()]
    assert sorted(got) == sorted([(20, 20, [1], True), (21, 20, [1], True), (20, 20, [1], True), (3, 0, [], False), (20, 20, [2], True), (0, 0, [], False), (0, 0, [], False), (2, 0, [], False), (1, 0, [], False)])
    assert sorted((r.text for r in decontaminate.drop_contaminated(d, b).collect()), key=repr) == sorted(["quite clean here", None, "", "as clean", "clean"], key=repr)


def test_decontamination_of_empty_tables(spark):
    d, b = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(d, b).collect() == []
    assert [r.n_hit for r in decontaminate.contamination(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), b).collect()] == [0]
