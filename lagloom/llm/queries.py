"""Registered queries of the dealt operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagloom.llm import (
    collocations,
    decontaminate,
    exact,
    lexical,
    minhash,
    mixing,
    private,
    quality,
    substrings,
    suffixes,
    tokens,
    urls,
    warc,
)
from lagloom.queries.registry import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


WORDS = r"'[^\x20\x09-\x0D]+'"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op1_minhash",
    f"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({LOWER}, {WORDS}) AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * c >= 85 * (x.n + y.n - c)),
ends AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM reach r JOIN ends e ON r.b = e.a),
found AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM found LEFT JOIN sizes USING (doc_id)""",
)
def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query("op2_warc")
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(table(spark, sf_dir, "pages"))


@query(
    "op3_exact_dedup",
    """WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
  sha256(text) AS text_sha256 FROM t WINDOW w AS (PARTITION BY text)""",
)
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf_dir, "documents"))


@query("op6_quality")
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


@query(
    "op8_decontaminate",
    """WITH words AS (
  SELECT id, kind, row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM (SELECT doc_id AS id, 'd' AS kind, row_number() OVER () AS row, text FROM documents UNION ALL
        SELECT item_id, 'i', row_number() OVER (), text FROM benchmark)),
sets AS (
  SELECT id, kind, row, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
one AS (SELECT DISTINCT id, kind, row, s FROM sets),
sizes AS (SELECT id, row, count(*) AS n_item FROM one WHERE kind = 'i' GROUP BY ALL),
held AS (
  SELECT d.id AS doc_id, d.row AS doc_row, i.id AS item_id, i.row AS item_row, count(*) AS n_common
  FROM one d JOIN one i ON d.s = i.s AND d.kind = 'd' AND i.kind = 'i' GROUP BY ALL)
SELECT doc_id, item_id, n_item, n_common FROM held JOIN sizes ON item_row = row WHERE n_common * 100 >= n_item * 80""",
)
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op10_token_ids")
def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.token_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


RULES = [
    ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"),
]


def page_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, path, bad): a page whose path ends in the number of a labelled document is labelled by its quality."""
    host, path = urls.host_and_path(F.col("url"))
    number = F.regexp_extract("path", r"/(\d+)[^/0-9]*/?$", 1).try_cast("long")
    rows = pages.select(host.alias("host"), path.alias("path")).distinct().withColumn("doc_id", number)
    known = labels.groupBy("doc_id").agg((1 - F.max("quality")).alias("bad"))
    return rows.join(known, "doc_id").select("host", "path", "bad")


@query("op4_url_filter")
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = urls.judged(pages, RULES, page_labels(pages, table(spark, sf_dir, "labels")))
    return found.select("page_id", "host", "path", "rule", "verdict")


@query("op5_pii")
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private.personal_data(table(spark, sf_dir, "documents"))


#: The sources of a domain share the remainder of their number by 4; sources without a number have none.
DOMAIN = "'domain' || CAST(TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) % 4 AS STRING)"
WEIGHTS = {
    "domain": {"domain0": 2, "domain1": 3, "domain2": 1, "domain3": 2},
    "lang": {"en": 4, "de": 2, "fr": 2, "es": 2},
}
PERMILLE, EPOCHS, SEED = 900, 3, 17


def _level_sql(level: str, own: str, parent: str, above: str) -> str:
    """One level of the budget tree in SQL: saturated children first, the rest by weight."""
    cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS.get(level, {}).items())
    weight = f"CASE {level} {cases} ELSE 1 END" if cases else "1"
    part = f"PARTITION BY {parent}" if parent else ""
    same = " AND ".join(f"{level}_0.{c} IS NOT DISTINCT FROM a.{c}" for c in parent.split(", "))
    join = f"JOIN {above} a ON {same}" if parent else f", {above} a"
    return f"""{level}_0 AS (
  SELECT {own}, sum(capacity)::BIGINT AS capacity, ({weight})::BIGINT AS weight FROM leaves GROUP BY {own}),
{level}_1 AS (SELECT {level}_0.*, a.share AS budget FROM {level}_0 {join}),
{level}_2 AS (
  SELECT *, capacity * sum(weight) OVER (r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    <= weight * (budget - coalesce(sum(capacity) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS filled
  FROM {level}_1 WINDOW r AS ({part} ORDER BY capacity / weight, {level})),
{level}_3 AS (
  SELECT {own}, (CASE WHEN filled THEN capacity ELSE
    weight * (budget - coalesce(sum(capacity) FILTER (filled) OVER p, 0)) // sum(weight) FILTER (NOT filled) OVER p END)::BIGINT AS share
  FROM {level}_2 WINDOW p AS ({part}))"""


@query(
    "op9_mixing",
    f"""WITH sized AS (
  SELECT doc_id, {DOMAIN} AS domain, lang, source, len(regexp_extract_all(coalesce(text, ''), {WORDS}))::BIGINT AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, (sum(n_tokens) * {EPOCHS})::BIGINT AS capacity FROM sized GROUP BY ALL),
root AS (SELECT least(sum(tokens) * {PERMILLE} // 1000, sum(capacity))::BIGINT AS share FROM leaves),
{_level_sql("domain", "domain", "", "root")},
{_level_sql("lang", "domain, lang", "domain", "domain_3")},
{_level_sql("source", "domain, lang, source", "domain, lang", "lang_3")},
plan AS (
  SELECT l.*, share, CASE WHEN tokens > 0 THEN share // tokens ELSE 0 END AS whole,
    share - CASE WHEN tokens > 0 THEN share // tokens ELSE 0 END * tokens AS rest
  FROM leaves l JOIN source_3 s ON l.domain IS NOT DISTINCT FROM s.domain AND l.lang IS NOT DISTINCT FROM s.lang
    AND l.source IS NOT DISTINCT FROM s.source),
numbered AS (
  SELECT s.*, whole, rest, tokens, sum(n_tokens) OVER (PARTITION BY s.domain, s.lang, s.source
    ORDER BY md5(concat('{SEED}:', whole + 1, ':', doc_id)) RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM sized s JOIN plan p ON s.domain IS NOT DISTINCT FROM p.domain AND s.lang IS NOT DISTINCT FROM p.lang
    AND s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, domain, lang, source, n_tokens, unnest(range(1, whole + 1 + CASE WHEN upto <= rest AND (rest > 0 OR tokens = 0)
  THEN 1 ELSE 0 END))::INT AS epoch FROM numbered""",
)
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = mixing.mixed(docs, F.expr(DOMAIN), WEIGHTS, PERMILLE, EPOCHS, SEED)
    return found.select("doc_id", "domain", "lang", "source", "n_tokens", "epoch")


@query(
    "op7_substring_dedup",
    f"""WITH docs AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), {WORDS}) AS w FROM documents),
starts AS (SELECT row, unnest(range(1, len(w) - 33)) AS i FROM docs),
windows AS (SELECT row, i, count(*) OVER (PARTITION BY array_to_string(w[i:i + 34], ' ')) AS n FROM starts JOIN docs USING (row)),
places AS (SELECT row, unnest(range(1, len(w) + 1)) AS i FROM docs),
gone AS (
  SELECT row, i, coalesce(max(n) OVER (PARTITION BY row ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW), 0) > 1 AS out
  FROM places LEFT JOIN windows USING (row, i)),
kept AS (SELECT row, list(i ORDER BY i) FILTER (NOT out) AS places, count(*) FILTER (out) AS n_removed FROM gone GROUP BY row)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed,
  sha256(array_to_string(list_transform(coalesce(places, []), lambda i: w[i]), ' ')) AS kept_sha256 FROM docs LEFT JOIN kept USING (row)""",
)
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.without_repeats(table(spark, sf_dir, "documents"))


@query(
    "op11_collocations",
    f"""WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
sizes AS (SELECT unnest(range(1, 6)) AS k),
grams AS (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM words, sizes WHERE len(w) >= k),
counted AS (SELECT lang, k, w[i:i + k - 1] AS p, count(*)::BIGINT AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
cuts AS (SELECT lang, k, p, f AS a, unnest(range(1, k)) AS cut FROM counted WHERE k >= 2),
scored AS (
  SELECT c.lang, c.k, c.p, a, cut, x.f AS l, y.f AS r, n, (1000::HUGEINT * a * n // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c JOIN totals USING (lang) JOIN counted x ON x.lang = c.lang AND x.p = c.p[1:cut] JOIN counted y ON y.lang = c.lang AND y.p = c.p[cut + 1:]),
weakest AS (SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) AS place FROM scored),
inside AS (SELECT lang, k, p, f, unnest(range(2, k)) AS j FROM counted),
parts AS (SELECT lang, p, f, j, k, unnest(range(1, k - j + 2)) AS i FROM inside),
longest AS (SELECT lang, p[i:i + j - 1] AS p, max(f) AS f FROM parts GROUP BY ALL),
open AS (
  SELECT w.lang, array_to_string(w.p, ' ') AS phrase, a, l, r, n, score FROM weakest w LEFT JOIN longest g ON g.lang = w.lang AND g.p = w.p
  WHERE place = 1 AND (g.f IS NULL OR 100 * g.f < 100 * a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM open)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000""",
)
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query(
    "op12_suffix_dedup",
    """WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
windows AS (
  SELECT row, doc_id, unnest(range(1, n - 48)) AS i, unnest(list_transform(range(1, n - 48), lambda i: substr(h, 2 * i - 1, 100))) AS w FROM docs),
again AS (SELECT row, i, min(doc_id) OVER (PARTITION BY w) < doc_id AS smaller FROM windows),
places AS (
  SELECT row, unnest(range(1, n + 1)) AS i, unnest(list_transform(range(1, n + 1), lambda i: substr(h, 2 * i - 1, 2))) AS b FROM docs),
gone AS (
  SELECT row, i, b, coalesce(max(smaller) OVER (PARTITION BY row ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), false) AS out
  FROM places LEFT JOIN again USING (row, i)),
runs AS (SELECT row, i, b, out, out AND NOT coalesce(lag(out) OVER (PARTITION BY row ORDER BY i), false) AS first FROM gone),
kept AS (
  SELECT row, count(*) FILTER (out) AS n_removed, count(*) FILTER (first) AS n_spans,
    string_agg(b, '' ORDER BY i) FILTER (NOT out) AS left_over FROM runs GROUP BY row)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(left_over, ''))) AS kept_sha256 FROM docs LEFT JOIN kept USING (row)""",
)
def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.summary(suffixes.repeated_spans(table(spark, sf_dir, "documents")))


@query(
    "op13_lexical_search",
    f"""WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t FROM documents),
total AS (SELECT count(*)::BIGINT AS n_docs, sum(len(t))::BIGINT AS n_terms FROM docs WHERE len(t) > 0),
held AS (SELECT row, term, count(*)::BIGINT AS tf FROM (SELECT row, unnest(t) AS term FROM docs) GROUP BY ALL),
spread AS (SELECT term, count(*)::BIGINT AS df FROM held GROUP BY term),
items AS (
  SELECT row_number() OVER () AS item, item_id, unnest(regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
wanted AS (SELECT item, item_id, term, count(*)::BIGINT AS c FROM items GROUP BY ALL),
scored AS (
  SELECT item, item_id, row, sum(c * floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT
    * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * len(t) * n_docs) // n_terms))))::BIGINT AS score
  FROM wanted JOIN spread USING (term) JOIN held USING (term) JOIN docs USING (row), total GROUP BY ALL),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank, doc_id, score
  FROM scored JOIN docs USING (row) WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 10""",
)
def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.top_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
