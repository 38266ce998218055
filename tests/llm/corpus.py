"""A small corpus with everything the operators must bear, as tables in a folder."""

import os
import random

import pyarrow as pa
import pyarrow.parquet as pq

DOCS = pa.schema([
    ("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64()),
    # names that operators use inside
    ("key", pa.string()), ("kept", pa.string()), ("domain", pa.string()), ("epoch", pa.int64()), ("n_tokens", pa.string()),
    ("of", pa.string()), ("x", pa.string()), ("component", pa.int64()), ("value", pa.string()),
])
PAGES = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string()), ("digest", pa.string()), ("template", pa.string())])
ITEMS = pa.schema([("item_id", pa.int64()), ("text", pa.string())])
LABELS = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())])

URLS = [
    None, "", "no scheme/en/1", "http://", "http://Example.ORG", "https://example.org/es/5?x=1", "http://a.example.org/en/12#t",
    "http://b.example.com/fr/7", "http://b.example.com/de/7.html", "http://notexample.org/es/1", "ftp://x.com?/fr/", "http://h://e.org/",
    "http://example.organic/en/1", "http://éx.net/a b/ü", "http://only.net#frag", "http://only.net/?q",
]

PRIVATE = [
    "mail a.b+c@d-e.co.uk or x@y or a@b.c@d.e then q%x@d.e end", "1.2.3.4.5 and 256.1.1.1 and 001.02.3.255 and 1.2.3",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112 and 411111111111111111111", "+1 (523) 555-1055 or +12 or +123456789 or +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6",
    "\x01 a@b.cd \x02 é a@b.ce 8.8.8.8", "7.7.7.7" * 3, "9" * 5000 + " " + "z" * 5000 + "@zz.zz",
]


def words(rng, n):
    return [rng.choice("abcdefghijklm") + rng.choice("nopqrstu") + rng.choice("aeiouy") * rng.randint(1, 3) for _ in range(n)]


def texts(rng):
    out = [None, "", " \t\n", "one", "One", "two words", "one", "", "É x ı Σ", "word " * 400]
    shared = words(rng, 60)
    items = [words(rng, n) for n in (3, 5, 20, 40, 90)]
    for size in (12, 40, 120, 300, 4000):
        base = words(rng, size)
        out += [" ".join(base)] * 2
        for edits in (1, 2, 5, 9):
            near = list(base)
            for _ in range(edits):
                near[rng.randrange(len(near))] = "edit" + str(rng.randrange(5))
            out.append(" ".join(near).upper() if edits == 2 else "  ".join(near))
    for k in range(12):
        out.append(" ".join(words(rng, 30 + k) + shared[: 30 + 3 * k] + words(rng, 25)))
        out.append(" ".join(words(rng, 200) + items[k % 5] + words(rng, 10)))
    half = items[4]
    out.append(" ".join(half[:40] + words(rng, 500) + half[35:]))
    out.append("\n".join(" ".join(words(rng, 9)) for _ in range(3000)))
    return out + PRIVATE, [" ".join(i) for i in items] + [None, "", " ".join(items[2])]


def write(folder, seed=1, empty=False, null_ids=False):
    rng = random.Random(seed)
    docs, items = texts(rng)
    rows = [
        {"doc_id": i, "text": t, "lang": rng.choice(["en", "de", None]), "source": rng.choice(["src0", "src0", "src1", "src7", None]),
         "n_chars": len(t or ""), "key": "k", "domain": "other", "epoch": 9, "component": i}
        for i, t in enumerate(docs)
    ]
    pages = [{"page_id": i, "url": u, "html": rng.choice([None, "", "<p>a</p>", "<p>é</p>", f"<p>{i}</p>" * 50])} for i, u in enumerate(URLS * 4)]
    labels = [{"doc_id": i, "quality": int(len(t or "") > 100), "toxic": 0} for i, t in enumerate(docs)] + [{"doc_id": None, "quality": 1}, {"doc_id": 3}]
    if null_ids:
        rows += [dict(r, doc_id=None) for r in rows[::5]] + rows[::7]
        pages += [dict(p, page_id=None) for p in pages[::5]] + pages[::7]
    tables = {
        "documents": (rows, DOCS), "pages": (pages, PAGES), "labels": (labels, LABELS),
        "benchmark": ([{"item_id": i, "text": t} for i, t in enumerate(items)], ITEMS),
    }
    for name, (content, schema) in tables.items():
        full = [{f.name: r.get(f.name) for f in schema} for r in content]
        pq.write_table(pa.Table.from_pylist([] if empty else full, schema=schema), os.path.join(folder, f"{name}.parquet"))
    return rows
