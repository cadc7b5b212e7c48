"""Operators against brute force, on hard cases and on the smallest given tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from statloom.llm import common, license_rules, license_scan, line_dedup, media, mixing, ngram_join, ordinal, packing, quality_rules, queries, substring_dedup, text_stats, token_rollup, tokenize
from statloom.llm.union_find import components

SF = "/root/testdata/sf0.001"
LONG_PASSAGE = " ".join(f"passage{i}" for i in range(90))
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def duck(sql, name="documents", path=SF):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{path}/{t}.parquet'")
    return sorted(con.execute(sql).fetchall(), key=repr)


def spark_rows(df, cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


# 1 -------------------------------------------------------------------------


def brute_removed(rows, size=50):
    big = 1 << 63
    first = {}
    for i, t in rows:
        w = words(t)
        for a in range(len(w) - size + 1):
            k = tuple(w[a : a + size])
            first[k] = min(first.get(k, big), big - 1 if i is None else i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for a in range(len(w) - size + 1):
            if first[tuple(w[a : a + size])] < (big - 1 if i is None else i):
                gone.update(range(a, a + size))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("log2_cells", [40, 8])
def test_substring_dedup_cases(cases, log2_cells):
    got = substring_dedup.substring_dedup(cases, log2_cells=log2_cells)
    assert spark_rows(got, ["doc_id", "n_words", "n_removed", "kept_sha256"]) == brute_removed(rows_of(cases))


def test_substring_dedup_oracle(spark):
    got = queries.op1_substring_dedup(spark, SF)
    want = duck(f"select doc_id, n_words, n_removed, kept_sha256 from ({queries.OP1_SQL})")
    assert spark_rows(got, ["doc_id", "n_words", "n_removed", "kept_sha256"]) == want
    assert any(r[2] for r in want)


def test_sketch_overestimates(spark):
    """However narrow the sketch, every window of two documents passes; with the given width about as many as there are."""
    frame = docs(spark).selectExpr("doc_id as k", "text")
    texts = [t.encode() for _, t in rows_of(docs(spark))]
    w = substring_dedup.Words(texts)
    at, anchor, hashes = substring_dedup._anchors(w, 50, 10)
    seen, held = defaultdict(set), defaultdict(set)
    for d, key, a in zip(w.doc[at].tolist(), substring_dedup.window_hash(hashes, at, 50, 1).view(np.int64).tolist(), anchor.tolist()):
        seen[key].add(d)
        held[a].add(d)
    repeated = {k for k, d in seen.items() if len(d) > 1}
    true = sum(len(held[a]) > 1 for a in anchor.tolist())
    for log2_cells, most in ((40, true), (14, len(at))):
        found = substring_dedup.repeated_runs(frame, 50, 10, log2_cells, 2).select("w1").collect()
        passed = [x for r in found for x in r["w1"]]
        assert repeated <= set(passed) and true <= len(passed) <= 1.02 * most
    assert repeated and true < len(at) / 2


@pytest.mark.parametrize("copies", [1, 10, 100])
def test_sketch_holds_at_more_load(spark, copies):
    """The share of anchors that pass stays the true one when there are 10 and 100 times as many."""
    F = __import__("pyspark").sql.functions
    words = F.transform(F.sequence(F.lit(1), F.lit(120)), lambda j: F.concat(F.lit("w"), F.xxhash64("id", j).cast("string")))
    frame = spark.range(60 * copies).select(F.col("id").alias("k"), F.concat_ws(" ", words).alias("text"))
    frame = frame.withColumn("text", F.when(F.col("k") % 10 == 0, F.lit("same " * 5 + LONG_PASSAGE)).otherwise(F.col("text")))
    found = substring_dedup.repeated_runs(frame, 50, 10, 40, 2)
    assert found.where("k % 10 <> 0").count() == 0 and found.select("k").distinct().count() == 6 * copies


# 2 -------------------------------------------------------------------------


def brute_components(rows, n, num, den):
    sets = []
    for i, t in rows:
        w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append((i, {tuple(w)} if 0 < len(w) < n else {tuple(w[a : a + n]) for a in range(len(w) - n + 1)}))
    up = {i: i for i, _ in sets if i is not None}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if i is not None and j is not None and s and t and den * len(s & t) >= num * len(s | t):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=repr)


@pytest.mark.parametrize("n,num,den,block", [(3, 9, 10, 512), (5, 8, 10, 512), (2, 1, 2, 3)])
def test_ngram_components(spark, cases, n, num, den, block):
    for df in (cases, docs(spark)):
        got = ngram_join.ngram_components(df, n=n, num=num, den=den, block=block)
        assert spark_rows(got, ["doc_id", "n_shingles", "component_id"]) == brute_components(rows_of(df), n, num, den)


def test_ngram_oracle(spark):
    got = queries.op2_ngram_join(spark, SF)
    want = duck(f"select doc_id, n_shingles, component_id from ({queries.OP2_SQL})")
    assert spark_rows(got, ["doc_id", "n_shingles", "component_id"]) == want
    assert any(r[0] != r[2] for r in want)


@pytest.mark.parametrize("bits", [None, 64, 256])
@pytest.mark.parametrize("seed", range(6))
def test_tree_loses_no_link(bits, seed):
    rng = np.random.default_rng(seed)
    base = [rng.choice(400, rng.integers(5, 80), replace=False) for _ in range(15)]
    sets = []
    for b in base:
        for _ in range(rng.integers(1, 8)):
            keep = b[rng.random(len(b)) > 0.05]
            sets.append(np.unique(np.concatenate([keep, rng.choice(400, rng.integers(0, 4))])).astype(np.uint64))
    links = ngram_join.tree_links(sets, 8, 10, bits)
    a, b = ngram_join._Sets(len(sets)), ngram_join._Sets(len(sets))
    for i, j in links:
        a.join(i, j)
    for i in range(len(sets)):
        for j in range(i):
            x, y = set(sets[i].tolist()), set(sets[j].tolist())
            if 10 * len(x & y) >= 8 * len(x | y):
                b.join(i, j)
    assert [a.find(i) for i in range(len(sets))] == [b.find(i) for i in range(len(sets))]


@pytest.mark.parametrize("num,den", [(9, 10), (8, 10), (1, 2)])
def test_linked_sets_share_a_first_token(num, den):
    rng = np.random.default_rng(1)
    rank = rng.integers(0, 3, 1 << ngram_join.LOG2_CELLS).astype(np.uint8)
    linked = 0
    for _ in range(1500):
        n = int(rng.integers(1, 60))
        a = rng.integers(0, 1 << 62, n).astype(np.uint64)
        b = np.concatenate([a[: n - int(rng.integers(0, n // 4 + 1))], rng.integers(0, 1 << 62, int(rng.integers(0, n // 4 + 1))).astype(np.uint64)])
        both = len(np.intersect1d(a, b))
        if den * both >= num * (len(a) + len(b) - both):
            linked += 1
            a, b = sorted((np.sort(a), np.sort(b)), key=len)
            tokens, small, at = ngram_join.prefixes(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), num, den, rank)
            first = tokens[: at[1]][small[: at[1]]]
            assert np.intersect1d(first, tokens[at[1] :]).size
    assert linked > 200


@pytest.mark.parametrize("block", [4, 40])
def test_large_families_lose_no_link(spark, block):
    """A near-copy group with a main part, strays that hang on to it by one link, and chains."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 62, 60)
    sets = [np.unique(np.concatenate([base[rng.random(60) > 0.04], rng.integers(0, 1 << 62, 2)])) for _ in range(60)]
    for _ in range(5):
        sets.append(np.unique(np.concatenate([base[rng.random(60) > 0.3], rng.integers(0, 1 << 62, 12)])))
    for _ in range(20):  # each near one other set, drifting away from the base
        other = sets[int(rng.integers(len(sets)))]
        sets.append(np.unique(np.concatenate([other[rng.random(len(other)) > 0.06], rng.integers(0, 1 << 62, 3)])))
    sets = [s.astype(np.uint64) for s in sets]
    rows = spark.createDataFrame([(1, i, s.tobytes()) for i, s in enumerate(sets)], "family long, doc_id long, tokens binary")
    got = ngram_join._Sets(len(sets))
    rows = ngram_join.dealt_in_blocks(rows.selectExpr("*", "cast(length(tokens) div 8 as long) as n"), "family", "mine", block)
    nodes, links = ngram_join.family_parts(rows, 8, 10, block)
    for r in [*nodes.collect(), *links.collect()]:
        got.join(*r)
    want = ngram_join._Sets(len(sets))
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 10 * both >= 8 * (len(sets[i]) + len(sets[j]) - both):
                want.join(i, j)
    assert [got.find(i) for i in range(len(sets))] == [want.find(i) for i in range(len(sets))]
    assert len({want.find(i) for i in range(len(sets))}) > 1


def test_sketch_parts_merge():
    rng = np.random.default_rng(6)
    parts = [(rng.integers(0, 200, 1 << ngram_join.LOG2_PART) * (rng.random(1 << ngram_join.LOG2_PART) < share)).astype(kind) for share in (0.001, 0.2, 0.9, 0) for kind in (np.uint8, np.uint32)]
    assert (ngram_join._merged([ngram_join._packed(p) for p in parts]) == sum(p.astype(np.int64) for p in parts)).all()


def test_union_find(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95), (7, 7)] + [(200, x) for x in range(201, 260)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 90, 90: 90, 95: 90} | {x: 200 for x in range(200, 260)}


def test_spread_join(spark, monkeypatch):
    monkeypatch.setattr(common, "TASK_ROWS", 10)
    monkeypatch.setattr(common, "HOT_SHARE", 3)
    rows = spark.createDataFrame([(i % 2 and 7, i) for i in range(40)] + [(k, 100 + k) for k in range(20)], "k int, v int")
    keyed = rows.groupBy("k").count().withColumnRenamed("count", "n").withColumn("w", __import__("pyspark").sql.functions.col("k") * 2)
    got = common.spread_join(rows, keyed.where("k <> 3"), ["k"], rows.count())
    want = rows.join(keyed.where("k <> 3").drop("n"), ["k"])
    assert spark_rows(got, ["k", "v", "w"]) == spark_rows(want, ["k", "v", "w"])


def test_maybe_in_misses_nothing(spark):
    rows = spark.range(30_000).withColumnRenamed("id", "v")
    flagged = common.maybe_in(rows, "v", rows.where("v % 100 = 3"))
    assert flagged.where("v % 100 = 3 and not maybe").count() == 0
    assert flagged.where("v % 100 <> 3 and maybe").count() < 300 and flagged.count() == 30_000


# 3 -------------------------------------------------------------------------


def test_ordinal_held_out(spark):
    path = "/root/testdata/sf0.01"
    d = spark.read.parquet(f"{path}/documents.parquet")
    graded = queries.grades(spark.read.parquet(f"{path}/labels.parquet"))
    train, held = graded.where("pmod(xxhash64(doc_id, 5), 4) > 0"), graded.where("pmod(xxhash64(doc_id, 5), 4) = 0")
    model = ordinal.fit_grades(d, train, 3)
    assert (np.diff(model.thresholds) > 0).all()
    found = ordinal.grade_documents(d, model, 2).join(held, "doc_id").toPandas()
    clean = found[found.grade == 2]
    assert clean.kept.mean() > 0.97
    assert (found.kept == (found.grade == 2)).mean() > 0.85  # a few hundred labels only
    assert found[found.grade == 0].expected_grade.mean() < clean.expected_grade.mean()


def test_ordinal_gradient():
    doc, slot, grade = np.array([0, 1, 1, 2, 3]), np.array([1, 1, 2, 2, 3]), np.array([0, 1, 2, 2])
    model = ordinal.fit_ordinal(doc, slot, grade, 3, least=1, ridge=1e-3, rounds=600, screen=np.ones(1 << ordinal.LOG2_WEIGHTS, bool), lowering=False)
    balance = np.sqrt(4 / (3 * np.bincount(grade)))[grade]

    def loss(w, t):
        s = ordinal._sigmoid(np.bincount(doc, w[slot], 4)[:, None] - t)
        full = np.concatenate([np.ones((4, 1)), s, np.zeros((4, 1))], axis=1)
        return -(balance * np.log(full[range(4), grade] - full[range(4), grade + 1])).mean() + 5e-4 * (w**2).sum()
    best = loss(model.weights, model.thresholds)
    for i in (1, 2, 3):
        for e in (-0.1, 0.1):
            w = model.weights.copy()
            w[i] += e
            assert loss(w, model.thresholds) > best - 1e-4


def test_ordinal_cases(spark, cases, empty):
    graded = spark.createDataFrame([(1, 2), (4, 0), (None, 1), (12, None)], "doc_id long, grade int")
    for g in (graded, graded.where("false"), graded.where("grade = 0")):
        model = ordinal.fit_grades(cases, g, 3)
        got = ordinal.grade_documents(cases, model, 2).toPandas()
        assert len(got) == cases.count() and got.tail_probability.between(0, 1).all() and got.expected_grade.between(0, 2).all()
        assert ordinal.grade_documents(empty, model, 2).count() == 0


# 4 -------------------------------------------------------------------------


def brute_stats(t):
    t = t or ""
    w = words(t)
    lines, seen, dup = t.split("\n"), set(), 0
    for x in lines:
        if words(x):
            dup += x in seen
            seen.add(x)
    count = Counter(tuple(w[a : a + 3]) for a in range(len(w) - 2))
    rep = {a + k for a in range(len(w) - 2) if count[tuple(w[a : a + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(rep)


def test_quality_rules(spark, cases, empty):
    for df, labels in ((cases, spark.createDataFrame([(1, 1), (4, 0)], "doc_id long, quality int")), (docs(spark), spark.read.parquet(f"{SF}/labels.parquet"))):
        forest = quality_rules.fit_rules(df, labels)
        got = quality_rules.quality_rules(df, forest)
        want = []
        for i, t in rows_of(df):
            s = brute_stats(t)
            want.append((i, *s, s[0] < 50 or 100 * s[4] > 50 * s[0]))
        assert spark_rows(got, ["doc_id", *text_stats.BASE, "base_failed"]) == sorted(want, key=repr)
        assert got.where("base_failed and kept").count() == 0
        assert quality_rules.quality_rules(empty, forest).count() == 0


def test_forest_is_monotone_and_learns():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 3))
    y = ((x[:, 0] < 0.6) & (x[:, 1] + 0.2 * rng.random(2000) > 0.3)).astype(float)
    forest = quality_rules.fit_forest(x, y, np.array([-1, 1, 0]))
    assert ((forest.score(x) > 0.5) == (y > 0)).mean() > 0.95
    grid = np.linspace(0, 1, 101)
    for k, sign in ((0, -1), (1, 1)):
        for _ in range(30):
            probe = np.repeat(rng.random((1, 3)), 101, axis=0)
            probe[:, k] = grid
            assert (sign * np.diff(forest.score(probe)) >= -1e-12).all()
    # the flat arrays give what a walk node by node gives
    for row in x[:20]:
        total = forest.prior
        for node in forest.roots:
            while forest.left[node] != node:
                node = forest.left[node] if row[forest.feature[node]] <= forest.threshold[node] else forest.right[node]
            total += forest.value[node]
        assert abs(1 / (1 + np.exp(-total)) - forest.score(row[None])[0]) < 1e-12


def test_rules_keep_clean(spark):
    path = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    train, held = labels.where("pmod(xxhash64(doc_id, 5), 4) > 0"), labels.where("pmod(xxhash64(doc_id, 5), 4) = 0")
    got = quality_rules.quality_rules(d, quality_rules.fit_rules(d, train)).join(held, "doc_id").where("not base_failed").toPandas()
    assert got[got.quality == 1].kept.mean() > 0.97
    assert got[got.quality == 0].kept.mean() < 0.2


# 5 -------------------------------------------------------------------------


def test_tokenizer_by_words(cases, spark):
    tok = tokenize.load(tokenize.default_path())
    texts = [(t or "") for _, t in rows_of(cases)] + [t for _, t in rows_of(docs(spark))][:60] + ["<|startoftext|>x<|endoftext|> a<|b", "é  x yΣ Σ", "́ a"]
    ids, at = tokenize.token_ids(tokenize.default_path(), [t.encode() for t in texts])
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == tok.encode(t, add_special_tokens=False).ids
    assert tokenize.token_counts(tokenize.default_path(), [t.encode() for t in texts]).tolist() == np.diff(at).tolist()


def check_packing(df, got):
    tok = tokenize.load(tokenize.default_path())
    want = Counter()
    for i, t in rows_of(df):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        for r in [r for r in got if r["doc_id"] == i and r["doc_tokens"] == len(ids)]:
            assert zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"]
        want[i] += len(ids)
    have = Counter()
    for r in got:
        have[r["doc_id"]] += r["length"]
    assert have == want
    pieces = defaultdict(list)
    for r in got:
        pieces[r["sequence_id"]].append((r["offset"], r["length"]))
    padding = 0
    for p in pieces.values():
        end = 0
        for offset, length in sorted(p):
            assert offset == end
            end += length
        assert end <= 2048
        padding += 0 if end & (end - 1) == 0 else 2048 - end
    return padding, sum(have.values())


def test_packing(spark, cases, empty):
    for df in (cases, docs(spark)):
        got = packing.pack(df).collect()
        padding, tokens = check_packing(df, got)
        assert padding < 0.03 * tokens + 4096
    assert packing.pack(empty).count() == 0


def test_plan_uses_each_piece_once():
    rng = np.random.default_rng(3)
    for size in (0, 5, 300, 200_000):
        pieces = Counter(x for n in rng.lognormal(5.8, 1, size).astype(int) + 1 for x in packing.cut(int(n), 2048, 64))
        plan = packing.plan(dict(pieces), 2048, 64)
        used = Counter()
        for p, times in plan:
            assert sum(p) <= 2048 and times > 0
            for k in p:
                used[k] += times
        assert used == pieces
        total = sum(k * v for k, v in pieces.items())
        waste = sum(t * (2048 - sum(p)) for p, t in plan)
        assert waste <= 0.01 * total + 2 * 2048


def test_nnls():
    rng = np.random.default_rng(0)
    for _ in range(20):
        a, b = rng.random((8, 12)), rng.random(8)
        x = packing.nnls(a, b)
        slope = a.T @ (b - a @ x)
        assert (x >= 0).all() and (slope <= 1e-6).all() and abs(slope[x > 0]).max(initial=0) < 1e-6


# 6 -------------------------------------------------------------------------


def brute_targets(rows):
    size = defaultdict(int)
    for s, t in rows:
        size[s] += len(words(t))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, target, open_ = Fraction(sum(size.values())), {}, set(names)
    while True:
        left = total - sum(target.values())
        level = left / sum(weight[s] for s in open_) if open_ else 0
        full = {s for s in open_ if level * weight[s] > 3 * size[s]}
        if not full:
            break
        target |= {s: Fraction(3 * size[s]) for s in full}
        open_ -= full
    return size, target | {s: level * weight[s] for s in open_}


def test_mixing(spark, cases, empty):
    block = 32
    for df in (cases, docs(spark)):
        first, again = (spark_rows(mixing.mix_sources(df), ["source", "doc_id", "size", "source_size", "target", "taken"]) for _ in range(2))
        assert first == again and len(first) == df.count()
        size, target = brute_targets([(r["source"], r["text"]) for r in df.select("source", "text").collect()])
        taken = defaultdict(int)
        for s, _, n, own, goal, took in first:
            assert own == size[s] and abs(goal - float(target[s])) <= 1e-6 * max(1, goal) and 0 <= took <= 3 * n
            taken[s] += took
        for s in size:
            assert abs(taken[s] - float(target[s])) <= 2 * block
    assert mixing.mix_sources(empty).count() == 0


def test_sainte_lague(spark):
    rng = np.random.default_rng(2)
    rows = []
    for g in range(40):
        n, seats = int(rng.integers(1, 12)), int(rng.integers(0, 200))
        rows += [(g, k, float(int(rng.pareto(1) * 50)), seats) for k in range(n)]
    got = defaultdict(dict)
    for r in mixing.sainte_lague(spark.createDataFrame(rows, "g int, k int, votes double, seats long"), ["g"], "k", "seats").collect():
        got[r["g"]][r["k"]] = r["quota"]
    for g in range(40):
        own = [(k, v, s) for h, k, v, s in rows if h == g]
        quota = {k: 0 for k, _, _ in own}
        if any(v for _, v, _ in own):
            for _ in range(own[0][2]):
                k = min((k for k, v, _ in own if v), key=lambda k: (-Fraction(next(v for j, v, _ in own if j == k)) / (2 * quota[k] + 1), k))
                quota[k] += 1
        assert got[g] == quota


# 7 -------------------------------------------------------------------------


def brute_license(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    norm = " " + " ".join(w) + " "
    base = []
    for phrase, label in license_scan.BASE_PHRASES:
        p = phrase.split()
        base += [(a, label) for a in range(len(w)) if w[a : a + len(p)] == p]
    found = []
    for p, label, k, e, s in license_rules.rules():
        if k in norm:
            for m in re.finditer(f"(?<= )(?:{e})(?= )", norm):
                if m.end() > m.start():
                    a = norm[: m.start()].count(" ") - 1
                    found.append((p, a, a + m[0].count(" "), label, s))
    kept = [y for y in found if not any(x[1] <= y[1] and x[2] >= y[2] and (x[0] < y[0] or x[0] == y[0] and (x[1] < y[1] or x[2] > y[2])) for x in found)]
    bl = sorted({x for _, x in base})
    score = max([s for *_, s in kept] + [0.9] * bool(bl) + [0.0])
    return len(w), len(base), min((a for a, _ in base), default=None), max((a for a, _ in base), default=None), ",".join(bl), ",".join(sorted({*bl, *(y[3] for y in kept)})), round(score, 4)


LICENSES = [
    "Copyright 2019 Someone. All rights reserved. Licensed under the Apache License, Version 2.0; see the LICENSE file. SPDX-License-Identifier: MIT",
    "This work is licensed under the GNU General Public License, version 3. mit license MIT License mit-license",
    "Licensed under CC BY-NC 4.0 K under the terms of the Mozilla Public License 2.0 or GNU Lesser General Public License v2.1",
    "redistributions of source code must retain the above copyright notice", "Dual licensed under MIT. Dual licensed under BSD 3-Clause", "GNU Affero General Public License v3 license",
]


def test_license_scan(spark, cases, empty):
    more = spark.createDataFrame([(i, t) for i, t in enumerate(LICENSES)], "doc_id long, text string")
    columns = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    assert len(license_rules.rules()) > 250
    for df in (cases, more, docs(spark)):
        got = spark_rows(license_scan.license_scan(df), columns)
        assert got == sorted(((i, *brute_license(t)) for i, t in rows_of(df)), key=repr)
    assert license_scan.license_scan(empty).count() == 0


def samples(expression, rng):
    """A text that an expression matches, with random choices."""
    from re import _constants as c
    from re import _parser

    def walk(parts):
        out = ""
        for op, arg in parts:
            if op is c.LITERAL:
                out += chr(arg)
            elif op is c.SUBPATTERN:
                out += walk(arg[3])
            elif op is c.BRANCH:
                out += walk(arg[1][rng.integers(len(arg[1]))])
            elif op in (c.MAX_REPEAT, c.MIN_REPEAT):
                most = 12 if arg[2][0][0] is c.IN and "+" in expression else arg[1]  # only a word may be long
                out += "".join(walk(arg[2]) for _ in range(rng.integers(arg[0], most + 1)))
            elif op is c.IN:
                kind, what = arg[rng.integers(len(arg))]
                out += "7" if kind is c.CATEGORY else chr(what) if kind is c.LITERAL else chr(rng.integers(what[0], what[1] + 1))
            else:
                raise AssertionError(op)
        return out

    return walk(_parser.parse(expression))


def test_license_gate_opens_for_every_rule():
    rng = np.random.default_rng(0)
    for p, label, keyword, expression, score in license_rules.rules():
        for _ in range(40):
            text = samples(expression, rng)
            assert keyword in text, (text, keyword)
            raw = re.sub(" ", lambda m: rng.choice([" ", "-", ", \n", "/"]), text)
            assert any(s in raw for s in license_rules.STEMS) or re.search(license_rules.SHORT_WORDS, raw), raw
            assert 0 < len(text.split()) <= license_rules.LONGEST and "\x01" not in text


def test_every_license_rule_is_found(spark):
    rng = np.random.default_rng(1)
    texts = [(i, "x " + samples(e, rng).upper() + " y") for i, _, _, e, _ in license_rules.rules()]
    columns = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    got = license_scan.license_scan(spark.createDataFrame(texts, "doc_id long, text string"))
    assert spark_rows(got, columns) == sorted(((i, *brute_license(t)) for i, t in texts), key=repr)
    assert all(r["labels"] for r in got.collect())


def test_license_scan_of_many_hits_is_quick(spark):
    import time

    license_scan.license_scan(spark.createDataFrame([(0, LICENSES[0])], "doc_id long, text string")).collect()
    start = time.time()
    r = license_scan.license_scan(spark.createDataFrame([(1, "Licensed under the MIT license. " * 50_000 + "mit license " * 50_000)], "doc_id long, text string")).first()
    assert time.time() - start < 40
    assert r["n_base"] == 100_000 and r["labels"] == "mit" and len(r["detections"]) == 100_000


# 8 -------------------------------------------------------------------------


def test_token_rollup(spark, cases, empty, tmp_path):
    tok = tokenize.load(tokenize.default_path())
    n = lambda t: len(tok.encode(t or "", add_special_tokens=False).ids)

    def want(rows):
        out = defaultdict(lambda: [0, 0])
        for r in rows:
            k = r["source"], r["lang"]
            out[k][0] += 1
            out[k][1] += n(r["text"])
        return {k: tuple(v) for k, v in out.items()}

    have = lambda s: {(r["source"], r["lang"]): (r["n_docs"], r["n_tokens"]) for r in s.totals().collect()}
    store = token_rollup.Rollup(spark, str(tmp_path / "r"))
    assert have(store) == {}
    assert store.commit("load", token_rollup.inserts(cases)) and not store.commit("load", token_rollup.inserts(cases))
    assert have(store) == want(cases.collect())
    gone, kept = cases.where("doc_id in (1, 9)"), cases.where("doc_id is null or doc_id not in (1, 9)")
    store.commit("delete", token_rollup.deletes(gone))
    assert have(store) == want(kept.collect())
    new = kept.withColumn("text", __import__("pyspark").sql.functions.lit("three new words"))
    store.commit("revise", token_rollup.revisions(kept, new))
    assert have(store) == want(new.collect())
    store.commit("empty", token_rollup.inserts(empty))
    # an attempt that broke off has no marker and does not count
    token_rollup.inserts(cases).write.parquet(str(tmp_path / "r/data/broken.1"))
    assert have(store) == want(new.collect())
    # a writer that comes second leaves nothing, and a snapshot changes no totals
    store.committed = lambda batch: False
    assert not store.commit("load", token_rollup.inserts(cases)) and len(list((tmp_path / "r/data").glob("load.*"))) == 1
    del store.committed
    assert store.compact() and not store.compact() and have(store) == want(new.collect())
    assert not store.commit("revise", token_rollup.inserts(cases)) and store.commit("again", token_rollup.inserts(gone))
    assert have(store) == want([*new.collect(), *gone.collect()]) and store.compact() and have(store) == want([*new.collect(), *gone.collect()])
    with pytest.raises(ValueError):
        store.commit("a/b", token_rollup.inserts(empty))


def test_token_rollup_query(spark):
    tok = tokenize.load(tokenize.default_path())
    want = defaultdict(lambda: [0, 0])
    for r in docs(spark).collect():
        if words(r["text"]):
            want[r["source"], r["lang"]][0] += 1
            want[r["source"], r["lang"]][1] += len(tok.encode(r["text"].strip(" \t\n"), add_special_tokens=False).ids)
    got = queries.op8_token_rollup(spark, SF).collect()
    assert {(r["source"], r["lang"]): [r["n_docs"], r["n_tokens"]] for r in got} == want


# 9 -------------------------------------------------------------------------


def slow_decode(data):
    """A plain bit-by-bit decoder of these progressive scans, block by block, from the format's rules."""
    at, tables, comps, restart, coef, size = 2, {}, {}, 0, {}, None
    zz = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    while data[at + 1] != 0xD9:
        marker, n = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body, at = data[at + 4 : at + 2 + n], at + 2 + n
        if marker == 0xC2:
            size = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            comps = {body[6 + 3 * i]: (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15) for i in range(body[5])}
            mr, mc = size[0] // 16, size[1] // 16
            coef = {c: np.zeros((mr * v, mc * h, 64), int) for c, (h, v) in comps.items()}
        elif marker == 0xC4:
            code, k, t = 0, 17, {}
            for length in range(1, 17):
                for _ in range(body[length]):
                    t[length, code] = body[k]
                    code, k = code + 1, k + 1
                code <<= 1
            tables[body[0]] = t
        elif marker == 0xDD:
            restart = int.from_bytes(body, "big")
        elif marker == 0xDA:
            chosen = [body[1 + 2 * i] for i in range(body[0])]
            ss, se, approx = body[-3:]
            end, raw = at, bytearray()
            segments = [raw]
            while True:
                if data[end] == 0xFF and data[end + 1] == 0:
                    raw.append(0xFF)
                    end += 2
                elif data[end] == 0xFF and 0xD0 <= data[end + 1] <= 0xD7:
                    raw = bytearray()
                    segments.append(raw)
                    end += 2
                elif data[end] == 0xFF:
                    break
                else:
                    raw.append(data[end])
                    end += 1
            at = end
            state = {"bits": iter(()), "pred": {}}

            def bit():
                return next(state["bits"])

            def take(k):
                v = 0
                for _ in range(k):
                    v = v << 1 | bit()
                return v

            def symbol(t):
                code = 0
                for length in range(1, 17):
                    code = code << 1 | bit()
                    if (length, code) in t:
                        return t[length, code]
                raise AssertionError

            def signed(k):
                v = take(k)
                return v if v >> (k - 1) else v - (1 << k) + 1

            def enter(seg):
                state["bits"] = iter([b >> (7 - k) & 1 for b in seg for k in range(8)])
                state["pred"] = {c: 0 for c in chosen}

            if len(chosen) > 1:
                blocks = [[(c, my * comps[c][1] + y, mx * comps[c][0] + x) for c in chosen for y in range(comps[c][1]) for x in range(comps[c][0])] for my in range(mr) for mx in range(mc)]
            else:
                c = chosen[0]
                blocks = [[(c, y, x)] for y in range(coef[c].shape[0]) for x in range(coef[c].shape[1])]
            for i, unit in enumerate(blocks):
                if i == 0 or restart and i % restart == 0:
                    enter(segments[i // restart if restart else 0])
                for c, y, x in unit:
                    blk = coef[c][y, x]
                    if ss == 0:
                        k = symbol(tables[0])
                        state["pred"][c] += signed(k) if k else 0
                        blk[0] = state["pred"][c]
                    elif approx >> 4 == 0:
                        k = ss
                        while k <= se:
                            s = symbol(tables[0x10])
                            k += s >> 4
                            blk[k] = signed(s & 15) * (1 << (approx & 15))
                            k += 1
                    else:
                        assert symbol(tables[0x10]) == 0
                        for k in range(ss, se + 1):
                            assert blk[k]
                            if bit():
                                blk[k] += 1 if blk[k] > 0 else -1
    return coef, size, zz


@pytest.mark.parametrize("n", [0, 1, 300, 3000])
def test_jpeg_round_trip(n):
    rng = np.random.default_rng(n)
    for text in (rng.integers(0, 256, n).astype(np.uint8).tobytes(), b"\xff" * n, bytes(n)):
        data = media.payload(text)
        assert len(data) % 576 == 0 and data.startswith(text)
        stored = media.encode(data)
        parts, columns, rows = media.coefficients(stored)
        assert media.payload_of(parts, columns, rows)[: len(data)].tobytes() == data
        coef, size, zz = slow_decode(stored)
        assert size == (16 * rows, 16 * columns)
        for part, c in zip(parts, (1, 2, 3)):
            assert (part == coef[c].reshape(-1, 64)).all()
        pixels = media.rgb(parts, columns, rows)
        # one pixel of luma and chroma by the definition of the transform
        block = np.zeros((8, 8))
        for k, (r, q) in enumerate(zz):
            block[r, q] = coef[1][0, 0, k]
        c = lambda u: np.sqrt(0.5) if u == 0 else 1.0
        y = sum(c(u) * c(v) / 4 * block[u, v] * np.cos((2 * 3 + 1) * u * np.pi / 16) * np.cos((2 * 5 + 1) * v * np.pi / 16) for u in range(8) for v in range(8)) + 128
        got = (parts[0].astype(np.float32) @ media.INVERSE + 128)[0].reshape(8, 8)[3, 5]
        assert abs(y - got) < 0.5 and pixels.shape == (16 * rows, 16 * columns, 3)


def test_media_columns(spark, cases, empty):
    for df in (cases, docs(spark)):
        got = media.media_columns(df, tensors=True).collect()
        want = Counter()
        for i, t in rows_of(df):
            raw = (t or "").encode()
            data = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
            want[i, len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:])] += 1
        assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == want
        for r in got:
            assert len(r["rgb"]) == 3 * r["width"] * r["height"] and r["media_bytes"] == len(r["media"]) and r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest()
    assert media.media_columns(empty).count() == 0


# 10 ------------------------------------------------------------------------


def brute_lines(rows, width=12):
    big = 1 << 63
    places, sets = defaultdict(list), {}
    for n, (i, t) in enumerate(rows):
        for pos, line in enumerate((t or "").split("\n")):
            if re.search(r"[^ \t\r\x0B\f]", line):
                places[line].append((big if i is None else i, t, pos))
                x = re.sub(r"[ \t\r\x0B\f]+", " ", line.strip(" ")).encode("utf-16-be")
                sets[line] = {x[a : a + 2 * width] for a in range(0, max(1, len(x) - 2 * width + 1), 2)}
    names = list(sets)
    up = list(range(len(names)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    index = defaultdict(set)
    for a, x in enumerate(names):
        for b in {b for s in sets[x] for b in index[s]}:
            both = len(sets[x] & sets[names[b]])
            if 10 * both >= 8 * (len(sets[x]) + len(sets[names[b]]) - both):
                up[find(a)] = find(b)
        for s in sets[x]:
            index[s].add(a)
    keep, gone = {}, defaultdict(set)
    for a, x in enumerate(names):
        for p in places[x]:
            r = find(a)
            keep[r] = min(keep.get(r, p), p, key=lambda q: (q[0], q[2]))
    for a, x in enumerate(names):
        for p in places[x]:
            k = keep[find(a)]
            if (p[0], p[2]) > (k[0], k[2]):
                gone[p[0], p[1]].add(p[2])
    out = []
    for i, t in rows:
        g = gone.get((big if i is None else i, t), set())
        lines = (t or "").split("\n")
        out.append((i, len(lines), len(g), "\n".join(x for j, x in enumerate(lines) if j not in g)))
    return sorted(out, key=repr)


def test_line_dedup(spark, cases, empty):
    for df in (cases, docs(spark)):
        got = spark_rows(line_dedup.line_dedup(df), ["doc_id", "n_lines", "n_removed", "kept_text"])
        want = brute_lines(rows_of(df))
        assert len(got) == len(want)
        # banding may miss a link near the threshold
        assert sum(a != b for a, b in zip(got, want)) <= 0.02 * len(want)
        assert sum(x[2] for x in got) >= 0.97 * sum(x[2] for x in want) > 0
    assert line_dedup.line_dedup(empty).count() == 0
