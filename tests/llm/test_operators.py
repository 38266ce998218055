"""The operators' own interfaces, against plain re-implementations."""

import os
import random
import re
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import corpus  # noqa: E402

from lagloom.llm import decontaminate, exact, minhash, mixing, private, quality, substrings, tokens, urls, warc
from lagloom.llm.graph import components
from lagloom.llm.words import U64, Words, mix
from lagloom.sources.writers import scratch_path


def frame(spark, texts, first=0):
    return spark.createDataFrame([(i + first, t) for i, t in enumerate(texts)], "doc_id long, text string")


def test_words_are_those_of_the_pattern():
    rng = random.Random(3)
    texts = ["".join(rng.choice("aB é\t\n\x0b\x1c ,") for _ in range(rng.randint(0, 40))) for _ in range(300)] + [None, ""]
    w = Words(pa.array(texts))
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    assert w.counts.tolist() == [len(s) for s in split]
    seen = {}
    flat = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for s in split for x in s]
    for word, value in zip(flat, w.hashes.tolist()):
        assert seen.setdefault(word, value) == value
    assert len(set(seen.values())) == len(seen)
    for k in (1, 3, 5):
        text, value = w.distinct_shingles(k)
        low = [[re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in s] for s in split]
        sizes = [len({tuple(s[i : i + k]) for i in range(max(1, len(s) - k + 1))}) if s else 0 for s in low]
        assert np.bincount(text, minlength=len(texts)).tolist() == sizes


def plain_super_minhash(values, slots):
    """Element by element, with the permutation drawn to the end."""
    sig = [2**64 - 1] * slots
    for v in values:
        order = list(range(slots))
        for j in range(slots):
            drawn = int(mix(np.array([(int(v) + (j + 1) * 0xA0761D6478BD642F) % 2**64], U64))[0])
            k = (drawn & 0xFFFFFFFF) % (slots - j) + j
            order[j], order[k] = order[k], order[j]
            sig[order[j]] = min(sig[order[j]], (j << 56) | (drawn >> 8))
    return sig


def test_super_minhash_with_early_stopping_equals_the_full_draw():
    rng = np.random.default_rng(5)
    sizes = [0, 1, 2, 7, 40, 90]
    text = np.repeat(np.arange(len(sizes)), sizes)
    value = rng.integers(0, 2**63, len(text)).astype(U64)
    got = minhash.super_minhash(text, value, len(sizes), 16)
    for i in range(len(sizes)):
        assert got[i].tolist() == plain_super_minhash(value[text == i], 16)


def test_signatures_estimate_the_similarity():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**63, 1100).astype(U64)
    errors = []
    for shared in (200, 500, 800, 950):
        a, b = base[:1000], np.concatenate((base[1000 - shared : 1000], rng.integers(0, 2**63, 1000 - shared).astype(U64)))
        sig = minhash.super_minhash(np.repeat([0, 1], 1000), np.concatenate((a, b)), 2)
        errors.append(abs((sig[0] == sig[1]).mean() - shared / (2000 - shared)))
    assert max(errors) < 0.15


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)]
    group = {}

    def find(i):
        while group.setdefault(i, i) != i:
            i = group[i]
        return i

    for a, b in pairs:
        if a != b:
            x, y = find(a), find(b)
            group[max(x, y)] = min(x, y)
    rows = components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {r.id: r.component for r in rows} == {i: find(i) for i in group}


def test_a_large_group_of_loose_copies_keeps_its_links(spark):
    """Many variants of one text, most of them linked only through others."""
    rng = random.Random(8)
    base = corpus.words(rng, 120)
    texts = []
    for _ in range(150):
        near = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 6, 8])):
            near[rng.randrange(len(near))] = f"edit{rng.randrange(30)}"
        texts.append(" ".join(near))
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in map(str.split, texts)]
    group = list(range(len(sets)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                group[max(x, y)] = min(x, y)
    for rounds in (0, 2):
        got = minhash.near_duplicates(frame(spark, texts), 3, 85, star_rounds=rounds).collect()
        assert {r.doc_id: r.component_id for r in got} == {i: find(i) for i in range(len(sets))}


def test_sets_at_the_very_threshold_are_linked(spark):
    """Eight words and one more at either end: 4 of 5 shingles in common."""
    rng = random.Random(3)
    texts = []
    for _ in range(10):
        base = corpus.words(rng, 8)
        texts += [" ".join(base), " ".join(base + ["end"]), " ".join(["start"] + base)]
    got = minhash.near_duplicates(frame(spark, texts), 5, 80).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i - i % 3 for i in range(30)}


def test_open_buckets_are_compared_after_a_star_round_without_pairs(spark, monkeypatch):
    """One bucket, whose hub is too long for the others; the two others are near."""
    rng = random.Random(4)
    near = corpus.words(rng, 60)
    hub = spark.range(3).orderBy(F.xxhash64("id", F.lit(0))).first().id
    texts = [" ".join(near), " ".join(near[:-1])]
    texts.insert(hub, " ".join(corpus.words(rng, 300)))
    signed = minhash.signatures
    monkeypatch.setattr(minhash, "signatures", lambda docs, words: signed(docs, words).withColumn("bands", F.array(F.lit(1).cast("long"))))
    first, second = (i for i in range(3) if i != hub)
    got = minhash.near_duplicates(frame(spark, texts), 3, 85, star_rounds=1).collect()
    assert {r.doc_id: r.component_id for r in got} == {hub: hub, first: first, second: first}


def test_directory_splits_overfull_buckets_only(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("key"))
    slots, depth = exact.directory(keys, 100)
    rows = slots.collect()
    assert depth >= 6 and {r.slot for r in rows} == set(range(2**depth)) & {r.slot for r in rows}
    placed = keys.withColumn("slot", exact.prefix("key", depth)).join(slots, "slot")
    sizes = placed.groupBy("depth", "bucket").count().collect()
    assert sum(r["count"] for r in sizes) == 5000 and max(r["count"] for r in sizes) <= 100
    parents = placed.groupBy((F.col("depth") - 1).alias("d"), F.shiftright("bucket", 1).alias("b")).count()
    assert parents.filter("count <= 50").count() == 0 or depth > 0


def test_chain_tells_texts_of_one_key_apart():
    rows = [(0, 1, 7, b"a", 3, 2), (0, 1, 7, b"b", 4, 1), (0, 1, 7, b"a", 9, 5), (0, 1, 8, b"a", 1, 1)]
    names = ("bucket", "depth", "key", "raw", "keep_id", "group_size")
    batch = pa.RecordBatch.from_pydict({n: [r[i] for r in rows] for i, n in enumerate(names)})
    out = [r for b in exact.chain([batch.slice(0, 2), batch.slice(2)]) for r in b.to_pylist()]
    assert [(r["key"], r["link"], r["keep_id"], r["group_size"]) for r in out] == [(7, 0, 9, 7), (7, 1, 4, 1), (8, 0, 1, 1)]


def test_elias_fano():
    rng = np.random.default_rng(2)
    for n, bound in ((0, 5), (1, 0), (1, 10**12), (1000, 1000), (3000, 10**9), (700, 3)):
        values = np.sort(rng.integers(0, bound + 1, n))
        code = tokens.EliasFano.from_bytes(*tokens.EliasFano.encode(values, bound).to_bytes())
        assert code.values().tolist() == values.tolist()
        assert [code.select(i) for i in range(0, n, 13)] == values[::13].tolist()
        if n >= 1000:
            _, data = code.to_bytes()
            assert len(data) * 8 <= n * (2.5 + max(0, np.log2(bound / n))) + 128


def test_shards_hold_ids_and_offsets(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["One two.", None, "", "don't stop <|endoftext|> now", "É à ñ — “q” 日本", "x" * 3000 + " 123"] * 20
    manifest = tokens.write_shards(frame(spark, texts, -7), path, shards=3).orderBy("shard").collect()
    ids = [e.ids + [1] for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    doc, start = 0, 0
    for row in manifest:
        shard = tokens.Shard(row.path)
        assert row.start == start and (shard.ids.values() + shard.head["base"]).tolist() == list(range(doc - 7, doc - 7 + row.n_docs))
        for i in range(row.n_docs):
            assert shard.read(*shard.offsets(i)).tolist() == ids[doc]
            doc += 1
        start += row.n_ids
    assert doc == len(texts)


def test_warc_filters_and_payloads(spark):
    pages = spark.createDataFrame(
        [(1, "http://a/\r\nb", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://c", None), (4, "http://d", "x" * 200_000), (None, "http://e", "y")],
        "page_id long, url string, html string",
    )
    folder = scratch_path(spark, "warc-test")
    warc.write_pages(pages, folder)
    rows = {r.record_id: r for r in warc.read_warc(spark, folder).collect()}
    assert len(rows) == 5 and bytes(rows["<urn:page:4>"].payload) == b"x" * 200_000
    assert rows["<urn:page:1>"].refers_to == "<urn:page:2>" and rows["<urn:page:1>"].payload is None
    assert rows["<urn:page:1>"].target_uri == "http://a/%0D%0Ab" and rows["<urn:page:2>"].target_uri is None
    found = warc.read_warc(spark, folder, payload=False).filter("record_type = 'revisit'")
    assert [r.record_id for r in found.collect()] == ["<urn:page:1>"]
    assert "record_type" not in found._jdf.queryExecution().executedPlan().toString().split("Filter (")[-1].split(")")[0]
    both = warc.read_warc(spark, folder).filter(F.col("record_id").isin("<urn:page:3>", "<urn:page:4>"))
    assert sorted(r.payload_bytes for r in both.collect()) == [0, 200_000]


def test_reader_takes_archives_of_others(spark, tmp_path):
    import gzip

    def whole(kind, n, body):
        return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{n}>\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"

    parts = [whole("warcinfo", 0, b"info"), whole("response", 1, b"HTTP/1.1 200 OK\r\n\r\nhello"), whole("response", 2, b"HTTP/1.1 200 OK\r\n\r\n" + b"z" * 99999)]
    (tmp_path / "a.warc").write_bytes(b"".join(parts))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in parts))
    rows = warc.read_warc(spark, str(tmp_path)).filter("record_type = 'response'").collect()
    assert sorted((r.record_id, len(r.payload)) for r in rows) == [("<1>", 5), ("<1>", 5), ("<2>", 99999), ("<2>", 99999)]


def test_factors_are_the_maximal_repeated_stretches(spark):
    rng = random.Random(4)
    shared = corpus.words(rng, 50)
    a = corpus.words(rng, 40) + shared + corpus.words(rng, 30)
    b = shared[5:] + corpus.words(rng, 10) + shared[:34]
    rows = substrings.factors(frame(spark, [" ".join(a), " ".join(b), "c d", None])).collect()
    assert sorted((r.start, r.length) for r in rows) == [(0, 45), (45, 45)]


def test_budgets_go_to_siblings_before_ancestors(spark):
    leaves = [("a", "x", "1", 100), ("a", "x", "2", 10), ("a", "y", "1", 5), ("b", "x", "1", 1000)]
    table = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long")
    got = mixing.budgets(table, {"domain": {"a": 3}}, 100, 1).collect()  # 111 tokens: 83 to a, 27 to b
    share = {(r.domain, r.lang, r.source): r.share for r in got}
    assert share == {("a", "y", "1"): 5, ("a", "x", "2"): 10, ("a", "x", "1"): 68, ("b", "x", "1"): 27}


def test_prefix_ends_within_the_budget(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)), "en", "s1" if i % 3 else "s2") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = mixing.mixed(docs, F.lit("d"), {"source": {"s1": 1, "s2": 2}}, 900, 2, seed=3)
    total = sum(len(r[1].split()) for r in rows)
    assert 0.88 * total <= out.agg(F.sum("n_tokens")).first()[0] <= 0.9 * total
    assert out.groupBy("doc_id").agg(F.max("epoch").alias("e"), F.count("*").alias("n")).filter("e <> n").count() == 0


def test_scores_of_unseen_rows_and_isotonic_steps():
    steps = quality.isotonic([(0, 10, 1), (1, 10, 4), (2, 10, 2), (3, 10, 9)])
    assert [s for s, _ in steps] == sorted(s for s, _ in steps) and [p for _, p in steps] == sorted(p for _, p in steps)
    x = quality.text_statistics(pa.array(["", None, "A b. c!", "x" * 100_000, "w " * 50_000]))
    assert np.isfinite(x).all() and (x[0] == 0).all() and (x[1] == 0).all()


def test_unseen_identifiers_are_found_by_context(spark):
    rng = random.Random(2)
    texts = [f"{' '.join(corpus.words(rng, 5))} fax number +1 (555) 555-{1000 + i} {' '.join(corpus.words(rng, 3))}" for i in range(30)]
    texts += ["see fax number 555-0199 today", "in the year 1999 there", "room 12 and 13"]
    rows = {r.doc_id: r for r in private.personal_data(frame(spark, texts)).collect()}
    assert rows[30].n_phone == 0 and rows[30].spans == "phone:15:23"
    assert rows[31].spans == rows[32].spans == ""


def test_one_strong_context_does_not_mark_an_ordinary_word(spark):
    rng = random.Random(2)
    texts = [f"{' '.join(corpus.words(rng, 5))} fax number +1 (555) 555-{1000 + i} {' '.join(corpus.words(rng, 3))}" for i in range(30)]
    texts += ["see fax number 2024 today", "call number 555-0199 now"]
    texts += [f"{' '.join(corpus.words(rng, 4))} 2024 was" for _ in range(20)] + ["2024 was", "2024 2024"]
    rows = {r.doc_id: r for r in private.personal_data(frame(spark, texts)).collect()}
    assert [rows[i].spans for i in range(30, len(texts))] == ["", "phone:12:20"] + [""] * 22


def test_url_templates_reject_bad_branches(spark):
    rows = [(i, f"http://h.com/{'spam' if i % 2 else 'news'}/{i}") for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([("h.com", f"/{'spam' if i % 2 else 'news'}/{i}", i % 2) for i in range(0, 200, 3)], "host string, path string, bad int")
    got = urls.judged(pages, [], labels).collect()
    assert {(r.template, r.verdict) for r in got} == {("/spam/*", "block"), ("/news/*", "allow")}


def judged_paths(spark, paths):
    """``paths`` holds (path, bad or None); {path: verdict} on one host."""
    pages = spark.createDataFrame([(i, "http://h.com" + p) for i, (p, _) in enumerate(paths)], "page_id long, url string")
    labels = spark.createDataFrame([("h.com", p, b) for p, b in paths if b is not None], "host string, path string, bad int")
    return {r.path: r.verdict for r in urls.judged(pages, [], labels).collect()}


def test_small_branches_of_a_large_host_are_judged_by_their_own_labels(spark):
    bad = {f"b{k}": int(k % 5 == 0) for k in range(100)}  # a hundredth of the host each
    got = judged_paths(spark, [(f"/{b}/{i}", bad[b] if i % 2 else None) for b in bad for i in range(40)])
    assert all(v == ("block" if bad[p.split("/")[1]] else "allow") for p, v in got.items())


def test_deep_branches_are_judged_by_their_own_labels(spark):
    above = "/en/2024/03/a/b"
    paths = [(f"{above}/{'spam' if i % 2 else 'news'}/{i}{'/x' * (i % 3)}", i % 2 if i % 5 else None) for i in range(300)]
    got = judged_paths(spark, paths + [("/en", 0), ("/en/2024", None), ("/" + "y/" * 40, 1)])
    assert all(v == ("block" if "/spam/" in p else "allow") for p, v in got.items() if p.startswith(above))
    assert len(got) == 303


def test_contained_items_in_pieces_and_long_documents(spark):
    rng = random.Random(12)
    item = corpus.words(rng, 40)
    long = corpus.words(rng, 20000)
    texts = [" ".join(long[:9000] + item + long[9000:]), " ".join(long[:500] + item[:22] + long[500:3000] + item[18:] + long[3000:3100]), " ".join(item[:20])]
    items = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, "")], "item_id long, text string")
    rows = decontaminate.contained(frame(spark, texts), items).collect()
    assert sorted((r.doc_id, r.item_id) for r in rows) == [(0, 1), (1, 1)]


@pytest.mark.parametrize("call", [
    lambda d: minhash.near_duplicates(d), lambda d: exact.exact_duplicates(d), lambda d: private.personal_data(d),
    lambda d: substrings.without_repeats(d), lambda d: quality.statistics(d),
])
def test_rows_without_text(spark, call):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, None), (2, "")], "doc_id long, text string")
    assert call(docs).count() == 4


def test_texts_of_one_id_go_by_themselves(spark):
    rng = random.Random(21)
    a, b, c = (corpus.words(rng, 40) for _ in range(3))
    rows = [(5, " ".join(a)), (5, " ".join(b)), (2, " ".join(a)), (3, " ".join(a[:-1])), (7, " ".join(c)), (7, " ".join(c)), (None, None), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("k1", F.lit("x")).withColumn("kept", F.lit(1))
    left = minhash.without_near_duplicates(docs)
    assert left.columns == docs.columns
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.text or "", r.k1, r.kept) for r in left.collect())
    want = [(-1, ""), (2, " ".join(a)), (4, ""), (5, " ".join(b)), (7, " ".join(c))]
    assert got == [(*w, "x", 1) for w in want]


def test_near_duplicates_of_real_tables_equal_brute_force(spark):
    """Five words and 0.8 on all documents of sf0.01: the same components, so recall is 1."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").cache()
    w = Words(docs.toPandas()["text"].pipe(pa.array))
    ids = docs.toPandas()["doc_id"].tolist()
    text, value = w.distinct_shingles(5)
    size = np.bincount(text, minlength=len(ids))
    holders = {}
    for t, v in zip(text.tolist(), value.tolist()):
        holders.setdefault(v, []).append(t)
    common = {}
    for held in holders.values():
        for i, x in enumerate(held):
            for y in held[i + 1 :]:
                common[x, y] = common.get((x, y), 0) + 1
    group = list(range(len(ids)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    links = 0
    for (x, y), n in common.items():
        if 100 * n >= 80 * (size[x] + size[y] - n):
            links += 1
            x, y = sorted((find(x), find(y)), key=lambda i: ids[i])
            group[y] = x
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()}
    assert links > 100 and got == {d: ids[find(i)] for i, d in enumerate(ids)}


def test_mixing_keeps_columns_with_the_names_it_uses(spark):
    names = ["leaf", "whole", "cutoff", "times", "domain", "epoch", "n_tokens", "row", "share", "digits"]
    rows = [(i, "a b c", "en", "s1", *[f"{n}{i}" for n in names]) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} string" for n in names))
    out = mixing.mixed(docs, F.lit("d"), {}, 500, 1, seed=1).select("row.*")
    assert out.columns == docs.columns
    got = out.collect()
    assert 20 <= len(got) <= 25 and {tuple(r) for r in got} <= set(rows)


def test_greedy_factors_judge_every_window():
    """Longest matches and the parse against all pairs of segments, words from a tiny vocabulary."""
    rng = np.random.default_rng(2)
    for _ in range(20):
        m, window, left = 40, 6, 4
        group, count = np.sort(rng.integers(0, 6, m)), np.ones(m, int)
        count[rng.integers(0, m, 3)] = 2
        start = rng.integers(0, left + 1, m)
        size = np.array([rng.integers(window, left + window - s + 1) if left + window - s > window else window for s in start])
        words = [rng.integers(0, 2, n) for n in size]
        heads = np.concatenate(([0], np.cumsum(size)))
        match = substrings.longest_matches(group, count, start, np.concatenate(words), heads, left + window, left + 1)
        seg, col, length = substrings.greedy(match, start, start + size, window)
        judged = {(i, c + k) for i, c, n in zip(seg.tolist(), col.tolist(), length.tolist()) for k in range(n - window + 1)}
        want = set()
        for i in range(m):
            for c in range(start[i], start[i] + size[i] - window + 1):
                own = words[i][c - start[i] :][:window].tolist()
                others = (j for j in range(m) if j != i and group[j] == group[i] and start[j] <= c and c + window <= start[j] + size[j])
                if count[i] > 1 or any(words[j][c - start[j] :][:window].tolist() == own for j in others):
                    want.add((i, c))
        assert judged == want


def test_periodic_and_chained_passages(spark):
    rng = random.Random(17)
    base = corpus.words(rng, 400)
    texts = [" ".join(base), " ".join(base[:60] + ["x"] + base[80:160]), " ".join(base[40:110]), " ".join(["la"] * 90), " ".join(["la", "lu"] * 40), "la " * 34]
    texts += [" ".join(base[100:140]) + "\n" + "  ".join(base[300:335]), None, "", texts[2]]
    window = 35
    split = [(t or "").split() for t in texts]
    seen = {}
    for i, w in enumerate(split):
        for s in range(len(w) - window + 1):
            seen.setdefault(tuple(w[s : s + window]), []).append((i, s))
    got = {r.doc_id: r for r in substrings.without_repeats(frame(spark, texts)).collect()}
    for i, w in enumerate(split):
        gone = {s + k for s in range(len(w) - window + 1) if len(seen[tuple(w[s : s + window])]) > 1 for k in range(window)}
        assert (got[i].n_words, got[i].n_removed) == (len(w), len(gone)), i


def test_any_tokenizer_file_gives_the_librarys_ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(31)
    signs = "abcXYZ éßñ0123'\"<|>.,;!?\t\n  -_日本×İ"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(1500)] + ["", None, "<|endoftext|> it's 12x'll"]
    for name, pieces in (("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)):
        path = public_tokenizers.path(name)
        enc = tokens.Encoder(path)
        assert enc.in_pieces is pieces
        ids, count = enc.encode(pa.array(texts, pa.string()), 1)
        want = [[*e.ids, 1] for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]
        assert count.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def test_context_after_a_place_and_beyond_a_hundred_letters(spark):
    rng = random.Random(13)
    long = "x" * 150
    texts = [f"{' '.join(corpus.words(rng, 4))} {long} +1 (555) 555-{1000 + i} {' '.join(corpus.words(rng, 3))}" for i in range(20)]
    texts += [f"{' '.join(corpus.words(rng, 4))} user{i}@a.example.org wrote {' '.join(corpus.words(rng, 2))}" for i in range(20)]
    texts += [f"so {long} 555-0199 it", f"so {'x' * 149} 555-0198 it", "then bob@localhost wrote more", "then 17 came"]
    spans = {r.doc_id: r.spans for r in private.personal_data(frame(spark, texts)).collect()}
    assert spans[40] == "phone:154:162" and spans[42] == "email:5:18" and spans[41] == spans[43] == ""


def test_a_text_of_very_many_numbers(spark):
    import time

    took = []
    for n in (4000, 16000):
        text = " ".join(f"10.0.{i % 200}.{i % 100} 77{i}" for i in range(n // 2))
        began = time.time()
        row = private.personal_data(frame(spark, [text])).first()
        took.append(time.time() - began)
        assert row.n_ip == n // 2 and len(row.spans.split(",")) == n // 2
    assert took[1] < 8 * took[0] + 5
