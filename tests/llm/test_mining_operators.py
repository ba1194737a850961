"""Phrases, MinHash near-duplicates, clusters and near-copy candidates against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabprofile.llm import clustering as CL
from tabprofile.llm import decontaminate as DC
from tabprofile.llm import minhash as MH
from tabprofile.llm import phrases as PH
from tabprofile.llm import simhash as SH

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def generated(spark):
    """Generated code on, as in production."""
    spark.conf.set("spark.sql.codegen.wholeStage", "true")
    yield spark
    spark.conf.set("spark.sql.codegen.wholeStage", "false")


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", None) for i, t, lang in rows], SCHEMA)


# Phrases


def _pieces(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def _phrases(rows, least, longest, explained, top):
    out = []
    rows = [(i, text, "und" if lang is None else lang) for i, text, lang in rows]
    for lang in {r[2] for r in rows}:
        f, n = Counter(), 0
        for _, text, _ in (r for r in rows if r[2] == lang):
            for words in _pieces(text):
                n += len(words)
                for k in range(1, longest + 1):
                    f.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
        some = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in some.items():
            holders = [b for q, b in some.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if any(100 * b >= explained * a for b in holders):
                continue
            score, _, left, right = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -score))
    return sorted(out)


def test_phrases_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(PH, "BLOCK_WORDS", 60)
    rng = random.Random(4)
    words = ["a", "B", "été", "c d", "x'", "1", "Z​", "\x00"]
    rows = [(i, "".join(rng.choice(words) + rng.choice([" ", " ", "\t", "  ", ". ", "\n", ",", "\r\n", "?!"]) for _ in range(rng.randrange(0, 40))), rng.choice(["en", "und", None, ""])) for i in range(60)]
    rows += [(100, None, "en"), (101, "", "fr"), (102, "a a a a a a a a a a a a", "fr"), (102, "a a a a a a a a a a a a", "fr"), (103, " . ,", "es")]
    for least, longest, explained, top in ((3, 3, 50, 2000), (2, 4, 70, 5), (5, 2, 50, 3)):
        got = PH.collocations(docs_of(spark, rows), least, longest, explained, top)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(tuple(r) for r in got.collect()) == _phrases(rows, least, longest, explained, top)


def test_phrases_of_nothing_and_extra_columns(spark):
    assert PH.collocations(docs_of(spark, [])).count() == 0
    odd = docs_of(spark, [(1, "u v " * 12, "en")]).withColumns({"phrase": F.lit("x"), "n": F.lit(1), "__l": F.lit(2), "score": F.lit(0)})
    got = [tuple(r) for r in PH.collocations(odd).orderBy("rank").collect()]
    assert got == _phrases([(1, "u v " * 12, "en")], 10, 3, 50, 2000)


def test_extending_lists_is_a_merge_of_positions():
    at = np.array([0, 1, 0, 1, -1, 1, 0, 1, -1], np.int32)
    words = PH.postings(at)
    lists, pairs = PH.extend(words, words)
    assert {tuple(pairs[k]): sorted(lists[1][lists[0] == k]) for k in range(len(pairs))} == {(0, 1): [1, 3, 7], (1, 0): [2, 6]}


# MinHash


def _set(text, words=2):
    w = text.translate({c: c + 32 for c in range(65, 91)}) if text else ""
    w = re.findall(r"[^\x20\x09-\x0D]+", w)
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())


def _components(rows, percent=80, words=2):
    sets = [_set(t, words) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return Counter((d, len(sets[i]), least.get(find(i)), d is not None and d == least.get(find(i))) for i, (d, _) in enumerate(rows))


def _near_rows(rng):
    rows = []
    for g in range(12):  # groups of edits, many of them about the threshold, and small sets
        n = rng.choice([2, 3, 5, 6, 11, 40, 90])
        base = ["w%d" % rng.randrange(3000) for _ in range(n)]
        for _ in range(8):
            w = list(base)
            for _ in range(rng.randrange(0, max(2, n // 8))):
                w[rng.randrange(len(w))] = "x%d" % rng.randrange(100000)
            rows.append(" ".join(w[: rng.choice([n, n, n - 1])]))
    rows += ["", None, " \t", "One", "one", "ONE two", "one TWO", "two one", "a a", "a a a a", rows[5], rows[5].upper()]
    ids = list(range(1000, 1000 + len(rows)))
    rng.shuffle(ids)
    return list(zip(ids, rows))


def test_minhash_equals_brute_force(spark):
    rows = _near_rows(random.Random(8))
    rows += [(None, rows[0][1]), (None, "only here twice"), (None, "only here twice"), rows[3], (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("clash"))
    got = MH.near_duplicates(docs)
    assert Counter(tuple(r) for r in got.select("doc_id", "n_shingles", "component_id", "kept").collect()) == _components(rows)


def test_minhash_group_around_a_centre(spark, generated):
    """Copies of one text with one to twelve edits each: most are near the first text only."""
    rng = random.Random(3)
    base = ["b%d" % k for k in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, 150):
        w = list(base)
        for p in rng.sample(range(120), rng.randrange(1, 12)):
            w[p] = "e%d_%d" % (i, p)
        rows.append((i, " ".join(w)))
    got = MH.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(tuple(r) for r in got.select("doc_id", "n_shingles", "component_id", "kept").collect()) == _components(rows)


def _join_rows(spark, column, before):
    """Rows of the largest join on ``column`` among the executions after ``before``; the last execution's number."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store = spark._jsparkSession.sharedState().statusStore()
    runs, most, last = store.executionsList(), 0, before
    for run in (runs.apply(i).executionId() for i in range(runs.size())):
        if run <= before:
            continue
        last, values, nodes = max(last, run), store.executionMetrics(run), store.planGraph(run).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            if "Join" in node.name() and node.desc().count(column) >= 2:
                for m in (node.metrics().apply(i) for i in range(node.metrics().size())):
                    if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                        most = max(most, int(values.apply(m.accumulatorId()).replace(",", "")))
    return most, last


def test_minhash_rows_of_a_group_just_below_the_threshold_stay_in_proportion(spark, generated):
    """Texts of 400 words with a block of 24 replaced at one of 16 places: 0.83 alike in one place, 0.78 across; some blocks join two places."""
    rng = random.Random(11)
    base = ["b%d" % k for k in range(400)]
    rows = []
    for i in range(200):
        at = 8 + 24 * (i % 16) + (12 if i in (50, 51, 68) else 0)
        rows.append((i, " ".join(base[:at] + ["e%d_%d" % (i, k) for k in range(24)] + base[at + 24 :])))
    rng.shuffle(rows)
    _, before = _join_rows(spark, "__post", -1)
    got = MH.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(tuple(r) for r in got.select("doc_id", "n_shingles", "component_id", "kept").collect()) == (want := _components(rows))
    assert 1 < len({component for _, _, component, _ in want}) < 16
    most, _ = _join_rows(spark, "__post", before)
    assert 0 < most <= MH.K * len(rows)  # no more than all posts; a row for each pair and list was 22 times that


def test_minhash_other_widths_and_nothing(spark):
    rows = _near_rows(random.Random(2))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = MH.near_duplicates(docs, percent=60, words=1)
    assert Counter(tuple(r) for r in got.select("doc_id", "n_shingles", "component_id", "kept").collect()) == _components(rows, 60, 1)
    assert MH.near_duplicates(docs.limit(0)).count() == 0


def test_match_threshold_misses_seldom():
    import math

    for percent in (50, 80, 95):
        t = MH.match_threshold(percent)
        p = percent / 100
        assert sum(math.comb(MH.K, k) * p**k * (1 - p) ** (MH.K - k) for k in range(t)) <= MH.MISS


# Candidates of near copies in the pipeline


def _nine_places(n, seed=5):
    """Texts of 100 words with two adjacent words replaced at one of nine places: similar in one place, just not across."""
    rng = random.Random(seed)
    base = ["b%d" % k for k in range(100)]
    rows = []
    for i in range(n):
        at = 5 + 10 * (i % 9)
        w = list(base)
        w[at], w[at + 1] = "u%d" % rng.randrange(10**9), "v%d" % rng.randrange(10**9)
        rows.append((i, " ".join(w), i % 9))
    return rows


def test_pairs_of_a_group_just_below_the_threshold_grow_in_proportion(spark, generated):
    made = {}
    for n in (150, 300, 600):
        rows = _nine_places(n)
        texts = spark.createDataFrame(rows, "key long, text string, root long")
        apart = SH.sharing(texts, n).collect()
        assert all(a % 9 != b % 9 for a, b in apart)
        alone = SH.sharing(texts.withColumn("root", F.col("key")), n)
        made[n] = len(apart), alone.count()
        kept = SH.drop_near_copies(texts.select(F.col("key").alias("doc_id"), "text"))
        assert kept.count() == 9
    assert made[600][0] <= 100 and made[600][1] <= 3 * 600 and made[600][1] <= 2.5 * made[300][1]


def test_sharing_connects_all_that_is_similar(spark):
    rng = random.Random(6)
    base, texts = ["b%d" % k for k in range(60)], set()
    while len(texts) < 160:
        w = list(base) + ["t%d" % k for k in range(rng.randrange(0, 12))]
        for p in rng.sample(range(len(w)), rng.randrange(0, 4)):
            w[p] = "e%d" % rng.randrange(40)
        texts.add(" ".join(w))
    rows = list(enumerate(sorted(texts)))
    got = SH.sharing(spark.createDataFrame([(k, t, k) for k, t in rows], "key long, text string, root long"), len(rows)).collect()
    sets = [_set(t, 5) for _, t in rows]
    near = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in got:
        if near(a, b):
            root[find(a)] = find(b)
    assert all(find(a) == find(b) for a in range(len(rows)) for b in range(a) if near(a, b))


# Benchmark items with a common preamble


def test_documents_meet_a_common_preamble_once(spark, generated):
    preamble = " ".join("p%d" % k for k in range(25))
    items = spark.createDataFrame([(i, f"{preamble} q{i} r{i} s{i} t{i}") for i in range(1000)], "item_id long, text string")
    rows = [(i, f"intro{i} {preamble} other{i}") for i in range(200)] + [(900, "nothing of the kind"), (901, "p1 p2 p3"), (None, preamble), (902, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    real = DC._good

    def counted(*a):
        out = real(*a)
        seen.append(out.count())
        return out

    try:
        DC._good = counted
        bad = {r[0] for r in DC.contaminated_ids(docs, items).collect()}
    finally:
        DC._good = real
    assert bad == {None, *range(200)}
    assert sum(seen) <= 60 * len(rows)  # not documents times items
    few = items.where("item_id < 20")
    assert {r[0] for r in DC.contaminated(docs, few).select("doc_id").distinct().collect()} == bad


def test_stand_ins_leave_no_document_out(spark):
    """The overlap is with an item that does not stand for the others."""
    start = " ".join("p%d" % k for k in range(8))
    items = spark.createDataFrame([(i, f"{start} " + " ".join(f"q{i}_{k}" for k in range(12))) for i in range(40)], "item_id long, text string")
    rows = [(i, f"x {start} " + " ".join(f"q{i}_{k}" for k in range(12))) for i in range(40)] + [(99, start)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {r[0] for r in DC.contaminated(docs, items).select("doc_id").distinct().collect()}
    assert {r[0] for r in DC.contaminated_ids(docs, items).collect()} == want == set(range(40))


# Clusters


def _kmeans(rows, k, rounds, dim=64, scale=64):
    kept = [(i, np.floor(np.array(v, np.float64) * scale).astype(object)) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    kept = [(i, [int(x) for x in v]) for i, v in kept]
    key = lambda r: (hashlib.sha256(f"1:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    cents = [list(v) for _, v in sorted(kept, key=key)[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for at in range(rounds + 1):
        own = [min((dist(v, c), j) for j, c in enumerate(cents)) for _, v in kept]
        if at < rounds:
            for j in range(len(cents)):
                mine = [v for (_, v), o in zip(kept, own) if o[1] == j]
                if mine:
                    cents[j] = [sum(x) // len(mine) for x in zip(*mine)]
    return Counter((i, o[1], o[0]) for (i, _), o in zip(kept, own)), cents


def _vectors(rng, n, kind):
    centres = rng.normal(size=(6, 64))
    rows = []
    for i in range(n):
        v = centres[i % 6] + 0.2 * rng.normal(size=64) if kind == "groups" else np.round(rng.normal(size=64)) / 64
        rows.append((i, [float(np.float32(x)) for x in v]))
    return rows


def test_clusters_equal_a_full_scan(spark):
    rng = np.random.default_rng(1)
    for kind in ("groups", "ties"):
        rows = _vectors(rng, 90, kind)
        rows += [(200, rows[0][1]), (200, rows[1][1]), (3, rows[3][1]), (None, rows[4][1]), (201, None), (202, [0.0] * 63), (203, [float("nan")] + [0.0] * 63), (204, [None] + [0.0] * 63), (205, [float("inf")] * 64), (206, [-1.5] * 64)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cluster", F.lit("clash"))
        found, cents = CL.cluster(df, 16, 3)
        want, wanted = _kmeans(rows, 16, 3)
        assert Counter((r["vec_id"], r["cluster"], r["distance"]) for r in found.collect()) == want
        assert cents.tolist() == wanted
        whole = CL.with_inertia(found, cents).collect()
        total = sum(d * n for (_, _, d), n in want.items())
        assert all(r["inertia"] == total for r in whole)
        assert all(r["centroid_sha256"] == hashlib.sha256(",".join(map(str, wanted[r["cluster"]])).encode()).hexdigest() for r in whole)


def test_search_looks_at_the_ball_only(spark):
    rows = _vectors(np.random.default_rng(2), 240, "groups")
    found, _ = CL.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 16, 6)
    scanned = [r["scanned"] for r in found.collect()]
    assert sum(scanned) < 0.55 * len(rows) * 16 * 7


def test_few_and_no_vectors(spark):
    rows = _vectors(np.random.default_rng(3), 3, "groups")
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found, cents = CL.cluster(df, 16, 2)
    assert len(cents) == 3 and {r["distance"] for r in found.collect()} == {0}
    one, _ = CL.cluster(df.limit(1), 16, 2)
    assert one.count() == 1
    none = CL.with_inertia(*CL.cluster(df.limit(0)))
    assert none.count() == 0 and none.columns[:5] == ["vec_id", "vector", "cluster", "distance", "scanned"]
    big = spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<float>")
    try:
        CL.cluster(big)[0].count()
    except Exception as e:
        assert "beyond" in str(e)
    else:
        raise AssertionError("a component beyond the limit has to be an error")


def test_sums_are_exact():
    v = np.full((5, 64), CL.LARGEST, np.int64)
    order, apart = CL.neighbours(np.stack([np.full(64, CL.LARGEST), np.full(64, -CL.LARGEST)]))
    own, _, _, _ = CL.search(v, np.zeros(5, np.int64), np.full(5, np.inf), np.zeros(5), np.stack([np.full(64, -CL.LARGEST), np.full(64, CL.LARGEST)]), order, apart)
    assert own.tolist() == [1] * 5
