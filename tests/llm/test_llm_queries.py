"""Every dealt query on the small corpus, beside SQL or brute force."""

import base64
import hashlib
import os
import re
import sys
import zlib

import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), "..", "..", "tools"))
import corpus  # noqa: E402
from check_oracle import compare, connect  # noqa: E402

import corpus_pipeline  # noqa: E402
from lagloom.llm import queries  # noqa: E402
from lagloom.sources.writers import cut_lineage  # noqa: E402


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    corpus.write(path)
    return path


@pytest.fixture(scope="module")
def documents(folder):
    return pd.read_parquet(f"{folder}/documents.parquet")


def run(spark, folder, start):
    name = next(n for n in queries.QUERIES if n.startswith(start))
    return queries.QUERIES[name](spark, folder).toPandas()


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_equals_sql(spark, folder, name):
    got = queries.QUERIES[name](spark, folder).toPandas()
    assert len(got) and compare(got, connect(folder).execute(queries.ORACLE[name]).df()) is None


@pytest.mark.parametrize("name", [*sorted(queries.QUERIES), "pipeline"])
def test_empty_tables(spark, tmp_path, name):
    corpus.write(str(tmp_path), empty=True)
    call = corpus_pipeline.run if name == "pipeline" else queries.QUERIES[name]
    assert call(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", [*sorted(queries.QUERIES), "pipeline"])
def test_null_ids_and_repeated_rows(spark, tmp_path, name):
    rows = corpus.write(str(tmp_path), null_ids=True)
    call = corpus_pipeline.run if name == "pipeline" else queries.QUERIES[name]
    got = call(spark, str(tmp_path)).toPandas()
    n = {"op2_warc": 64 + 13 + 10, "op4_url_filter": 64 + 13 + 10}.get(name)
    if n or name.split("_")[0] in ("op1", "op3", "op5", "op6", "op7", "op10", "op12"):
        assert len(got) == (n or len(rows))


def test_warc(spark, folder):
    got = run(spark, folder, "op2_").set_index("page_id")
    pages = pd.read_parquet(f"{folder}/pages.parquet")
    bodies = [(h or "").encode() if isinstance(h, str) else b"" for h in pages.html]
    last = {}
    for i, body in zip(pages.page_id, bodies):
        last[body] = max(i, last.get(body, -1))
    for i, body in zip(pages.page_id, bodies):
        row = got.loc[i]
        assert row.payload_bytes == len(body)
        assert row.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert row.record_type == ("response" if last[body] == i else "revisit")
        assert pd.isna(row.refers_to) if last[body] == i else row.refers_to == last[body]


def test_url_rules(spark, folder):
    rules = [(v, r.split("/", 1)[0], "/" + r.split("/", 1)[1]) for v, r in queries.RULES]
    pages = pd.read_parquet(f"{folder}/pages.parquet").set_index("page_id")
    for row in run(spark, folder, "op4_").itertuples():
        url = pages.url[row.page_id] if isinstance(pages.url[row.page_id], str) else ""
        rest = url.split("://", 1)[1] if "://" in url else ""
        host, tail = re.match(r"([^/?#]*)(.*)", rest, re.S).groups()
        host, path = re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", tail)[0]
        fit = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (row.host, row.path) == (host, path)
        assert row.verdict in ("allow", "block")
        assert (row.rule, row.verdict) == max(fit)[1:] if fit else pd.isna(row.rule)


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


KINDS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v, d: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v, d: all(int(p) <= 255 for p in v.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda v, d: 12 <= len(d) <= 19 and luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v, d: 9 <= len(d) <= 15),
}


def test_personal_data(spark, folder, documents):
    got = run(spark, folder, "op5_").set_index("doc_id")
    for i, text in zip(documents.doc_id, documents.text):
        spans = []
        for rank, (kind, (pattern, good)) in enumerate(KINDS.items()):
            found = [m for m in re.finditer(pattern, text if isinstance(text, str) else "") if good(m[0], re.sub("[^0-9]", "", m[0]))]
            assert got.loc[i][f"n_{kind}"] == len(found), (i, kind)
            spans += [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for m in found]
        line = ",".join(s for _, _, s in sorted(spans))
        assert got.loc[i].base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert set(filter(None, line.split(","))) <= set(got.loc[i].spans.split(","))


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = run(spark, sf, "op6_").merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    assert got.held_out.equals(got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1))
    unseen = got[got.held_out]
    assert (unseen.predicted == unseen.quality).mean() > 0.97
    assert got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def expected_tokens(ids, texts):
    import numpy as np

    encoded = tokenizer().encode_batch([t if isinstance(t, str) else "" for t in texts], add_special_tokens=False)
    start = 0
    for i, e in sorted(zip(ids, encoded), key=lambda p: p[0]):
        found = np.array([*e.ids, 1], "<u4")
        yield i, start, len(found), zlib.crc32(found.tobytes())
        start += len(found)


def test_token_ids(spark, folder, documents):
    got = run(spark, folder, "op10_").sort_values("doc_id")
    assert list(got.itertuples(index=False, name=None)) == list(expected_tokens(documents.doc_id, documents.text))


def test_pipeline_stages(spark, folder, documents):
    """Each stage on its own input against brute force."""
    from lagloom.llm import minhash, quality

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    good = cut_lineage(steps["good_quality"](spark, docs, folder), "t")
    scores = quality.quality_scores(docs, spark.read.parquet(f"{folder}/labels.parquet")).toPandas()
    assert good.columns == docs.columns
    assert {r.doc_id for r in good.select("doc_id").collect()} == set(scores[scores.predicted == 1].doc_id)

    near = cut_lineage(steps["near_dedup"](spark, docs, folder), "t")
    kept = {r.doc_id for r in near.select("doc_id").collect()}
    sets = {i: shingles(t, 5) for i, t in zip(documents.doc_id, documents.text)}
    group = components(sets, 80)
    assert kept == {i for i in sets if group[i] == i}
    assert minhash.near_duplicates(docs).count() == len(documents)

    items = [shingles(t, 5) for t in pd.read_parquet(f"{folder}/benchmark.parquet").text]
    clean = cut_lineage(steps["decontaminated"](spark, near, folder), "t")
    leaks = {i for i in kept if any(s and 100 * len(s & sets[i]) >= 80 * len(s) for s in items)}
    assert leaks and {r.doc_id for r in clean.select("doc_id").collect()} == kept - leaks

    mix = cut_lineage(steps["mixed"](spark, clean, folder), "t")
    taken = mix.select("doc_id", "text").toPandas()
    assert mix.columns == docs.columns and taken.doc_id.is_unique and set(taken.doc_id) <= kept - leaks
    out = steps["token_files"](spark, mix, folder).toPandas().sort_values("doc_id")
    assert list(out.itertuples(index=False, name=None)) == list(expected_tokens(taken.doc_id, taken.text))


def shingles(text, k):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text) if isinstance(text, str) else ""
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def components(sets, percent):
    group = {i: i for i in sets}

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    group[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}
