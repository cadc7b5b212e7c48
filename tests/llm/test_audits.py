"""Sharding, divergence audit and filter audit against brute force, on hard cases and on the smallest given tables."""

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from statloom.llm import divergence, filter_audit, queries, sharding

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def given(spark, name="documents"):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def duck(sql):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return sorted(con.execute(sql).fetchall(), key=repr)


def tuples(df, columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# 11 ------------------------------------------------------------------------


def plain_differencing(sizes, parts):
    """Sums of the parts, by lists that are sorted anew for each step."""
    left = [([v] + [0] * (parts - 1), i) for i, v in enumerate(sizes)]
    turn = len(left)
    while len(left) > 1:
        left.sort(key=lambda p: (p[0][-1] - p[0][0], p[1]))
        (a, _), (b, _) = left.pop(0), left.pop(0)
        left.append((sorted((x + y for x, y in zip(a, reversed(b))), reverse=True), turn))
        turn += 1
    return sorted(left[0][0])


def largest_first(sizes, parts):
    sums = [0] * parts
    for v in sorted(sizes, reverse=True):
        sums[sums.index(min(sums))] += v
    return sums


@pytest.mark.parametrize("parts", [2, 3, 16])
def test_differencing(parts):
    rng, better, tried = random.Random(parts), 0, 0
    for n in (1, 2, 5, 40, 300):
        for _ in range(4):
            sizes = sorted((rng.choice([rng.randint(1, 50), rng.randint(1, 10_000)]) for _ in range(n)), reverse=True)
            part = sharding.differencing(np.array(sizes), parts)
            sums = np.bincount(part, sizes, parts).astype(int)
            assert sorted(sums) == plain_differencing(sizes, parts)
            greedy = largest_first(sizes, parts)
            if n >= 40:
                tried += 1
                better += sums.max() - sums.min() <= max(greedy) - min(greedy)
    assert better >= 0.75 * tried
    assert len(sharding.differencing(np.array([], int), parts)) == 0


def sharded(df, rows, shards=16):
    """Checks the contract; returns bytes of each shard and the size of each group."""
    got = df.collect()
    assert sorted((repr(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == sorted((repr(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert all(r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards for r in got)
    slots, of_text, sums = defaultdict(list), defaultdict(set), [0] * shards
    for r in got:
        slots[r["shard"]].append(r["slot"])
        of_text[r["text_crc32"], r["size"]].add(r["shard"])
        sums[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in of_text.values())
    groups = Counter()
    for _, t in rows:
        groups[t or ""] += len((t or "").encode()) + 1
    return sums, list(groups.values())


def test_sharding_cases(cases, empty):
    rows = [(r["doc_id"], r["text"]) for r in cases.collect()]
    sums, groups = sharded(sharding.shard_documents(cases), rows)
    assert sorted(sums) == plain_differencing(sorted(groups, reverse=True), 16)
    assert sharding.shard_documents(empty).collect() == []
    assert len(sharding.shard_documents(cases.where("doc_id = 9")).collect()) == 1


def test_sharding_hot_group(spark):
    """A text with a third of all rows, and light groups in bundles: all other shards are near equal."""
    rng = random.Random(3)
    rows = [(i, "hot text " * 20 if i % 3 == 0 else f"text {rng.randint(1, 4000)} " + "x" * rng.randint(1, 300)) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    sums, groups = sharded(sharding.shard_documents(df), rows)
    assert max(sums) == max(groups) > 2 * sorted(sums)[-2]
    rest = sorted(sums)[:-1]
    assert rest[-1] - rest[0] < rest[0] / 1000
    sums, _ = sharded(sharding.shard_documents(df.where("doc_id % 3 > 0"), shards=5, grain=64), [r for r in rows if r[0] % 3], 5)
    assert max(sums) - min(sums) < sum(sums) / 5 / 1000


def test_sharding_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in given(spark).collect()]
    first = queries.op11_sharding(spark, SF)
    sums, groups = sharded(first, rows)
    greedy = largest_first(groups, 16)
    assert max(sums) - min(sums) <= max(greedy) - min(greedy)
    assert tuples(first, ["doc_id", "shard", "slot"]) == tuples(queries.op11_sharding(spark, SF), ["doc_id", "shard", "slot"])


def test_sharding_by_another_key(cases):
    from pyspark.sql import functions as F

    got = sharding.shard_documents(cases, shards=4, group=F.coalesce("source", F.lit("")))
    of_source = got.join(cases.select("doc_id", "source").distinct(), "doc_id").groupBy("source").agg(F.countDistinct("shard").alias("n"))
    assert {r["n"] for r in of_source.collect()} == {1}


# 12 ------------------------------------------------------------------------


def brute_divergence(rows, least=30, k=50):
    """rows: text, lang, source."""
    docs, counts, groups = Counter(), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall((text or "").translate(LOWER))
        counts[lang, source].update(terms)
        groups[lang].add(source)
        docs.update((lang, t) for t in set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for (x, t), n in docs.items() if x == lang and n >= least]

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        whole = Counter()
        for s in sources:
            whole.update(counts[lang, s])
        q, p = shares(whole), {s: shares(counts[lang, s]) for s in sources}
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources - {s}]
            terms = [(p[s][t] - q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, k)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, i + 1) for i, (v, item) in enumerate(found[:most])]
    return sorted(out, key=repr)


DIVERGENCE = ["lang", "source", "part", "item", "value", "rank"]


def triples(df):
    return [tuple(r) for r in df.select("text", "lang", "source").collect()]


@pytest.mark.parametrize("least", [1, 2, 30])
def test_divergence_cases(cases, empty, least):
    got = divergence.divergence_audit(cases, least_docs=least)
    assert tuples(got, DIVERGENCE) == brute_divergence(triples(cases), least)
    assert divergence.divergence_audit(empty).collect() == []


@pytest.mark.parametrize("block", [128, 2])
def test_divergence_many_ties(spark, monkeypatch, block):
    """Few terms of equal counts, groups without terms, letters of other scripts, more sources than a block holds."""
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "HELD_CELLS", 10)
    rng = random.Random(5)
    vocabulary = [f"{a}{b}" for a in ("x", "É", "ß", "你", "Q") for b in "abcdefghijklmnopqrstuvwxyz"]
    rows = [(" ".join(rng.choices(vocabulary, k=rng.choice([0, 3, 40]))), rng.choice(["l1", "l2", None]), rng.choice(["s1", "s2", "S3", "ä", None, "", "s7"])) for _ in range(400)]
    rows += [("1 2 3", "l4", "s1"), (None, "l4", "s2"), ("only here", "l5", "s1"), ("hot " * 3000, "l1", "s1")]
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)
    got = divergence.divergence_audit(df, least_docs=12, k=9)
    want = brute_divergence(rows, 12, 9)
    assert tuples(got, DIVERGENCE) == want
    assert any(r[2] == "term" and r[5] == 9 for r in want)


def test_divergence_query(spark):
    got = tuples(queries.op12_divergence_audit(spark, SF), DIVERGENCE)
    assert got == brute_divergence(triples(given(spark)))
    assert got == duck(f"select {', '.join(DIVERGENCE)} from ({queries.OP12_SQL})")


# 13 ------------------------------------------------------------------------


def brute_filters(rows, labels):
    """rows: doc_id, text, lang; labels: doc_id, quality, toxic."""
    ids = defaultdict(list)
    for i, t, _ in rows:
        if i is not None:
            ids[t or ""].append(i)
    good, toxic = ({i for i, *v in labels if v[c] == 1 and i is not None} for c in (0, 1))
    parts = defaultdict(list)
    for i, t, lang in rows:
        t = t or ""
        w = WORD.findall(t)
        failed = ""
        failed += "A" * (len(w) < 100)
        failed += "B" * (100 * len(set(w)) < 80 * len(w))
        failed += "C" * (100 * len(re.findall("[A-Z]", t)) > 10 * len(t))
        failed += "D" * bool(re.search(r"[#$%&*|]", t))
        failed += "E" * (i is not None and min(ids[t]) < i)
        parts[lang or ""].append((failed, i in good, i in toxic))
    out = []
    for part, docs in parts.items():
        found, shapley = [], Counter()
        for order in itertools.permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                shapley[f] += len(gone)
                found.append((part, "".join(order), step + 1, len(left), len(gone), sum(f in d[0] for d in docs) - len(gone), sum(d[0] == f for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone)))
        out += [(*r, shapley[r[1][r[2] - 1]]) for r in found]
    return sorted(out, key=repr)


FILTERS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_swaps_meet_all_orders():
    for n in (1, 2, 3, 5):
        order = list(range(n))
        seen = {tuple(order)}
        for at in filter_audit.swaps(n):
            order[at], order[at + 1] = order[at + 1], order[at]
            assert tuple(order) not in seen
            seen.add(tuple(order))
        assert len(seen) == len(list(itertools.permutations(range(n))))


def test_filter_audit_cases(spark, cases, empty):
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (3, None, 1), (6, 0, 1), (15, 1, 1), (None, 1, 1), (99, 1, 1)]
    marked = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = [tuple(r) for r in cases.select("doc_id", "text", "lang").collect()]
    got = filter_audit.filter_audit(cases, marked)
    assert tuples(got, FILTERS) == brute_filters(rows, labels)
    assert filter_audit.filter_audit(empty, marked).collect() == []
    got = filter_audit.filter_audit(cases, marked.where("false"))
    assert tuples(got, FILTERS) == brute_filters(rows, [])


def test_filter_audit_copies(spark):
    """Copies over several parts, repeated least ids, null ids, and a text with a third of all rows."""
    rng = random.Random(9)
    texts = ["", None, "A B C", "a|b", "word " * 120, " ".join(f"w{i}" for i in range(150)), "UP " * 30 + "\n#"]
    rows = [(rng.choice([None, *range(40)]), rng.choice([texts[-1], *texts, *texts]), rng.choice(["en", "de", None, ""])) for _ in range(600)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 40, 2)] + [(4, 1, 1), (4, 0, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(6)
    marked = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert tuples(filter_audit.filter_audit(df, marked), FILTERS) == brute_filters(rows, labels)


def test_filter_audit_query(spark):
    got = tuples(queries.op13_filter_audit(spark, SF), FILTERS)
    rows = [tuple(r) for r in given(spark).select("doc_id", "text", "lang").collect()]
    labels = [tuple(r) for r in given(spark, "labels").select("doc_id", "quality", "toxic").collect()]
    assert got == brute_filters(rows, labels)
    assert got == duck(f"select {', '.join(FILTERS)} from ({queries.OP13_SQL})")
