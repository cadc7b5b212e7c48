"""The pipeline's stages against plain Python on the small cases."""

import re
from collections import Counter

import corpus_pipeline as p

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(df):
    return [r.asDict() for r in df.collect()]


def shingles(text, n=5):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words)} if 0 < len(words) < n else {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def near_kept(docs):
    """Ids of documents that no document of a lesser id reaches by links."""
    sets = {d["doc_id"]: shingles(d["text"]) for d in docs if d["doc_id"] is not None}
    least = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a != b and sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            least[a] = min(least[a], least[b])
    return {i for i in sets if least[i] == i}


def test_near_duplicates_go(spark, cases):
    docs = rows(cases.select(*p.COLUMNS))
    kept = rows(p.dedup_documents(spark, cases, ""))
    assert set(kept[0]) == set(p.COLUMNS)
    least = near_kept(docs)
    assert Counter(repr(d) for d in kept) == Counter(repr(d) for d in docs if d["doc_id"] is None or d["doc_id"] in least)


def test_line_dedup_keeps_whole_lines(spark, cases):
    lines = {}
    for d in rows(cases):  # ids may be null or repeat
        lines.setdefault(d["doc_id"], set()).update((d["text"] or "").split("\n"))
    kept = rows(p.dedup_lines(spark, cases, ""))
    for d in kept:
        assert all(line in lines[d["doc_id"]] for line in (d["text"] or "").split("\n"))
    # no line stays twice, but for rows repeated with id and text, which nothing tells apart
    seen = [line for _, text in {(d["doc_id"], d["text"]) for d in kept} for line in (text or "").split("\n") if line.strip(" \t\r\x0b\f")]
    assert len(seen) == len(set(seen))


def test_mix_copies(spark, cases):
    mixed = rows(p.mixing.mix_sources(cases))
    times = {}
    for d in mixed:
        n = int(d["taken"] / d["size"] + 0.5) if d["size"] else 0
        times[d["doc_id"]] = max(n, times.get(d["doc_id"], 0))
    out = Counter(d["doc_id"] for d in rows(p.mix(spark, cases, "")))
    want = Counter()
    for d in rows(cases):
        want[d["doc_id"]] += times[d["doc_id"]]
    assert out == +want


def test_mix_of_rows_without_an_id(spark, cases):
    alone = cases.where("doc_id is null and text is not null")
    out = rows(p.mix(spark, alone, ""))
    taken = p.mixing.mix_sources(alone).first()
    assert len(out) == int(taken["taken"] / taken["size"] + 0.5) > 0


def test_stages_take_an_empty_table(spark, empty):
    for stage in (p.dedup_lines, p.dedup_documents, p.mix, p.pack):
        assert stage(spark, empty, "").count() == 0
