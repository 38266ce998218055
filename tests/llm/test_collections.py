"""Collocations, suffix order and ranked search against plain re-implementations."""

import hashlib
import math
import os
import random
import re
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import corpus  # noqa: E402

from lagloom.llm import collocations, lexical, suffixes
from lagloom.llm.bits import held, probes
from lagloom.llm.words import U64, mix
from lagloom.sources.writers import cut_lineage


@pytest.fixture(scope="module")
def documents(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("collections"))
    corpus.write(folder, null_ids=True)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return docs, [(r.doc_id, r.text, r.lang) for r in docs.collect()], spark.read.parquet(f"{folder}/benchmark.parquet")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain_collocations(rows, least, first, percent=100):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    counted = {p: a for p, a in f.items() if a >= least}
    dropped = set()
    for (lang, p), a in counted.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                if 100 * a >= percent * counted[lang, p[i : i + k]]:
                    dropped.add((lang, p[i : i + k]))
    out = set()
    for lang in n:
        scored = []
        for (g, p), a in counted.items():
            if g == lang and len(p) > 1 and (g, p) not in dropped:
                cuts = [(1000 * a * n[g] // (counted[g, p[:k]] * counted[g, p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                scored.append((-score, -a, " ".join(p).encode(), counted[g, p[:k]], counted[g, p[k:]]))
        for i, (s, a, p, left, right) in enumerate(sorted(scored)[:first]):
            out.add((lang, i + 1, p.decode(), -a, left, right, n[lang], -s))
    return out


@pytest.mark.parametrize("percent, first", [(100, 2000), (60, 5)])
def test_collocations(spark, documents, percent, first):
    docs, rows, _ = documents
    got = [tuple(r) for r in collocations.collocations(docs, 3, first=first, subsume_percent=percent).collect()]
    assert len(got) > 5 and len(got) == len(set(got)) and set(got) == plain_collocations(rows, 3, first, percent)


def test_hot_prefixes_are_counted_in_parts(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, " ".join(f"the w{rng.randrange(90)}" for _ in range(60)) + ". end, end", "en" if i % 2 else None) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(collocations, "BUNDLE", 5000)
    structure = cut_lineage(collocations.counted_phrases(docs, 5, 3)[3], "t")
    assert structure.groupBy("lang", "prefix").count().filter("count > 1").count() > 0
    got = {tuple(r) for r in collocations.collocations(docs, 5).collect()}
    assert got == plain_collocations(rows, 5, 2000)


def test_wide_scores_are_exact(spark):
    a, n, l, r = 4_000_000_000_007, 9_000_000_000_000_011, 5_000_000_000_029, 4_000_000_000_033
    wide = "decimal(20,0)"
    text = f"CAST(CAST({a}L * 1000 AS {wide}) * CAST({n}L AS {wide}) DIV (CAST({l}L AS {wide}) * CAST({r}L AS {wide})) AS BIGINT) AS s"
    assert spark.range(1).selectExpr(text).first().s == 1000 * a * n // (l * r)


def test_filter_holds_what_was_put_in():
    rng = np.random.default_rng(1)
    value = rng.integers(0, 2**63, 4000).astype(U64)
    filled = np.zeros((1 << 16) // 64, U64)
    for at in probes(value[:2000], 1 << 16):
        np.bitwise_or.at(filled, at >> 6, U64(1) << (at & 63).astype(U64))
    assert held(filled, value[:2000]).all() and held(filled, value[2000:]).mean() < 0.05


def plain_spans(rows, window):
    first = {}
    for i, text, _ in rows:
        b, own = (text or "").encode(), math.inf if i is None else i
        for s in range(len(b) - window + 1):
            first[b[s : s + window]] = min(own, first.get(b[s : s + window], math.inf))
    out = []
    for i, text, _ in rows:
        b, own = (text or "").encode(), math.inf if i is None else i
        gone = bytearray(len(b))
        for s in range(len(b) - window + 1):
            if first[b[s : s + window]] < own:
                gone[s : s + window] = b"\1" * window
        spans = [m.span() for m in re.finditer(b"\1+", bytes(gone))]
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), [a for a, _ in spans], [e for _, e in spans], hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window, gram", [(50, 20), (12, 5)])
def test_repeated_spans(spark, documents, window, gram):
    docs, rows, _ = documents
    got = [tuple(r) for r in suffixes.repeated_spans(docs, window, gram).collect()]
    assert sorted(got, key=repr) == plain_spans(rows, window)


def test_spans_with_few_symbols_in_many_blocks(spark, monkeypatch):
    """Two symbols: every gram is shared, groups are large and orders change in every round."""
    rng = random.Random(8)
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.randrange(200))), None) for i in range(200)] + [(300, "é" * 90, None), (7, "é" * 70, None)]
    monkeypatch.setattr(suffixes, "BLOCK", 2000)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in suffixes.repeated_spans(docs, 16, 7).collect()]
    assert sorted(got, key=repr) == plain_spans(rows, 16)


def test_columns_give_suffix_order_and_common_prefixes():
    rng = np.random.default_rng(3)
    rows = rng.integers(97, 100, (60, 20)).astype(np.uint8)
    group = np.sort(rng.integers(0, 9, 60))
    start, end = rng.integers(0, 5, 60), rng.integers(14, 21, 60)
    left = iter(range(19, -1, -1))
    for c, order, common in suffixes.insert_columns(group, start, end, lambda: rows[:, next(left)], 20):
        suffix = [bytes(rows[i, c : end[i]]) if start[i] <= c < end[i] else b"" for i in range(60)]
        inside = [start[i] <= c for i in range(60)]
        at = order.tolist()
        for p, q, n in zip(at, at[1:], common[1:].tolist()):
            if group[p] == group[q] and inside[p] and inside[q]:
                assert suffix[p] <= suffix[q] and n == len(os.path.commonprefix([suffix[p], suffix[q]]))
            assert group[p] <= group[q] and (group[p] == group[q] or n == 0)


def test_gram_hashes_are_those_of_the_bytes():
    rng = np.random.default_rng(4)
    buf = rng.integers(0, 3, 5000).astype(np.uint8)
    value = suffixes.gram_hashes(buf, 6)
    seen = {}
    for i, h in enumerate(value.tolist()):
        assert seen.setdefault(bytes(buf[i : i + 6]), h) == h
    assert len(value) == 4995 and len(set(seen.values())) == len(seen)


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_search(rows, items, first):
    tf = [(i, Counter(TERM.findall(lower(t)))) for i, t, _ in rows]
    n_docs, n_terms = sum(bool(c) for _, c in tf), sum(c.total() for _, c in tf)
    df = Counter(t for _, c in tf for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in tf:
            m = 25 + 75 * c.total() * n_docs // max(n_terms, 1)
            s = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t in TERM.findall(lower(text))
            )
            if s > 0:
                scored.append((-s, math.inf if i is None else i))
        out += [(item, r + 1, None if i == math.inf else i, -s) for r, (s, i) in enumerate(sorted(scored)[:first])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("first, query_terms", [(10, 1 << 14), (3, 40)])
def test_ranked_search(spark, documents, monkeypatch, first, query_terms):
    """Also in several blocks of queries, with NULL, repeated and empty ones."""
    docs, rows, items = documents
    monkeypatch.setattr(lexical, "QUERY_TERMS", query_terms)
    asked = [tuple(r) for r in items.select("item_id", "text").collect()] + [(90, "edit1 EDIT2 edit1"), (None, "word zz nowhere"), (90, "edit1 EDIT2 edit1")]
    items = spark.createDataFrame(asked, "item_id long, text string")
    got = [tuple(r) for r in lexical.top_documents(docs, items, first).collect()]
    assert sorted(got, key=repr) == plain_search(rows, asked, first)


def test_bounds_are_never_below_the_score(spark, documents):
    docs, rows, items = documents
    table = cut_lineage(lexical.index(docs), "t")
    numbered = items.select(items.item_id.alias("number"), "text")
    queries = next(lexical.query_blocks(numbered))
    lexical.weigh(queries, table)
    every = np.zeros((len(queries.number), 2), np.int64)
    found = cut_lineage(lexical.search(table, queries, every, 10), "t")
    upper = {(r.number, r.k1): r.bound for r in found.collect()}
    exact = lexical.rescored(docs.select("doc_id", "text"), found, queries).collect()
    name = {r.doc_id: r.k1 for r in lexical.named(docs).collect()}
    assert len(exact) > 50 and all(upper[r.number, name[r.doc_id]] >= r.score for r in exact if r.doc_id is not None)
