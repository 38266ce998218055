"""Personal data in texts: base patterns, and further identifiers by bootstrapped context.

Base spans are the leftmost non-overlapping matches of each kind that pass its
check.  They seed the method: the words before and after a seed become lexical
patterns of its kind, patterns and identifier-like words (with a digit or an
``@``) form a graph, and in each round a pattern's score is the share of its
kind among all it meets.  A place's score is the mean of its patterns, weak ones
included and those left out that are too rare to say anything; a place without
a pattern has score 0.  A word's score is the mean of all its places, so that
one place in a strong context does not mark a word that also stands elsewhere.
Words that reach the threshold join the seeds of the next round, and the spans
of the result.

Everything is DataFrame and SQL functions.  Java knows no "all matches with
their places", so matches are wrapped in two control characters, and the text is
split at them; control characters of the text itself are replaced first, by
a character no pattern contains.  Expressions carry guards that keep them linear
in the length of the text: a match can only begin where its run of characters
begins, or where the match before it ended.

NULL and empty texts have no spans.  Repeated rows get equal results, rows
without ``doc_id`` too.  An empty table gives an empty one.  Of kinds with equal scores the
later by name is taken.  Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagloom.sources.writers import cut_lineage

KINDS = ("email", "ip", "card", "phone")
LEFT, RIGHT = "\x01", "\x02"

#: kind: (a cheap test that must hold, pattern with guards).
BASE = {
    "email": ("@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (".", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"),
    "card": ("", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])"),
    "phone": ("+", r"\+[0-9][ ().0-9-]+[0-9]"),
}
#: A word with a digit or an ``@``, judged in its context.
IDENTIFIER = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"

FOUND = "array<struct<begin:int,end:int,value:string,gap:string,rest:string>>"
ACCEPT, SUPPORT, SMOOTH = 0.8, 4, 1.0
CHUNK = 256  # matches of a text are appended to lists of so many, so that a long text costs no square


def matches(text: Column, pattern: str, needs: str = "") -> Column:
    """array<struct<begin, end, value, gap, rest>>: places in code points, and the text since the match before and up to the next one."""
    marked = F.regexp_replace(text, F.lit(pattern), F.lit(f"{LEFT}$0{RIGHT}"))
    parts = F.split(marked, LEFT)
    none = F.array().cast(FOUND)
    first = F.element_at(parts, 1)
    lists = F.array().cast(f"array<{FOUND}>")
    start = F.struct(F.char_length(first).alias("at"), first.alias("gap"), none.alias("block"), lists.alias("found"))

    def step(acc, part):
        value = F.substring_index(part, RIGHT, 1)
        end = acc["at"] + F.char_length(value)
        rest = F.substr(part, F.char_length(value) + 2)
        hit = F.struct(
            acc["at"].alias("begin"), end.alias("end"), value.alias("value"), acc["gap"].alias("gap"), rest.alias("rest")
        )
        full = F.size(acc["block"]) >= CHUNK
        return F.struct(
            (end + F.char_length(rest)).alias("at"), rest.alias("gap"),
            F.when(full, F.array(hit)).otherwise(F.concat(acc["block"], F.array(hit))).alias("block"),
            F.when(full, F.concat(acc["found"], F.array(acc["block"]))).otherwise(acc["found"]).alias("found"),
        )

    tail = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    found = F.aggregate(tail, start, step, lambda acc: F.flatten(F.concat(acc["found"], F.array(acc["block"]))))
    test = F.contains(text, F.lit(needs)) if needs else text.rlike("[0-9@]")
    return F.when(test, found).otherwise(none)


def passes(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.char_length(digits)
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        small = lambda p: (F.char_length(F.ltrim(p, F.lit("0"))) <= 3) & (
            F.coalesce(F.right(F.ltrim(p, F.lit("0")), F.lit(3)).try_cast("int"), F.lit(0)) <= 255
        )
        return F.forall(F.split(value, r"\."), small)
    if kind == "phone":
        return n.between(9, 15)

    def luhn(total, i):
        d = F.substr(digits, n - i, F.lit(1)).cast("int") * (1 + i % 2)
        return total + d - F.when(d > 9, 9).otherwise(0)

    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), luhn)
    return n.between(12, 19) & (total % 10 == 0)


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"], s["end"])), ",")


def base_spans(text: Column) -> Column:
    """array<struct<begin, rank, kind, end>> by place, then kind as listed."""
    return F.array_sort(F.concat(*[_of_kind(text, rank, kind) for rank, kind in enumerate(KINDS)]))


def _of_kind(text: Column, rank: int, kind: str) -> Column:
    needs, pattern = BASE[kind]
    good = F.filter(matches(text, pattern, needs), lambda m: passes(kind, m["value"]))
    named = (F.lit(rank).alias("rank"), F.lit(kind).alias("kind"))
    return F.transform(good, lambda m: F.struct(m["begin"].alias("begin"), *named, m["end"].alias("end")))


def contexts(gap: Column, rest: Column) -> Column:
    """Patterns of a place, in lower case: the word before it, the two words before it, and the word after it."""
    back = F.reverse(gap)  # from the place on backwards, so that no text is searched through
    two = F.regexp_extract(back, r"^[\x20\x09-\x0D]+([^\x20\x09-\x0D]+[\x20\x09-\x0D]+[^\x20\x09-\x0D]+)", 1)
    one = F.regexp_extract(back, r"^[\x20\x09-\x0D]+([^\x20\x09-\x0D]+)", 1)
    after = F.regexp_extract(rest, r"^[\x20\x09-\x0D]+([^\x20\x09-\x0D]+)", 1)
    two = F.regexp_replace(two, r"[\x20\x09-\x0D]+", " ")
    before = F.transform(F.filter(F.array(one, two), lambda c: c != ""), lambda c: F.lower(F.reverse(c)))
    return F.concat(before, F.when(after != "", F.array(F.concat(F.lit("\x01"), F.lower(after)))).otherwise(F.array().cast("array<string>")))


def discovered(words: DataFrame, accept: float = ACCEPT, support: int = SUPPORT) -> DataFrame:
    """(value, kind) of unseen identifiers, from ``words (value, kind or NULL, patterns)``, one row a place.

    The rounds end when one finds no more words than the one before: words that are found can
    only raise the scores of patterns, so the set grows until it stays.
    """
    places = words.groupBy("value", "kind", "patterns").agg(F.count("*").alias("n"))
    places = cut_lineage(places, "places")
    edges = places.withColumn("pattern", F.explode("patterns"))
    totals = cut_lineage(edges.groupBy("pattern").agg(F.sum("n").alias("total")), "totals")
    heard = totals.filter(F.col("total") >= support)  # a rarer pattern says nothing
    open_edges = edges.filter("kind IS NULL").drop("kind")
    seeds = edges.filter("kind IS NOT NULL").select("pattern", "value", "kind", "n")
    known, size = seeds, 0
    while True:
        score = known.groupBy("pattern", "kind").agg(F.sum("n").alias("hits"), F.count_distinct("value").alias("values"))
        score = score.join(heard, "pattern")
        score = score.select("pattern", "kind", "values", (F.col("hits") / (F.col("total") + SMOOTH)).alias("score"))
        score = cut_lineage(score, "scores")
        strong = score.filter((F.col("values") >= support) & (F.col("score") >= accept)).select("pattern", "kind")
        likely = cut_lineage(open_edges.join(strong, "pattern").select("value", "kind").distinct(), "likely")
        votes = places.filter("kind IS NULL").drop("kind").join(likely, "value").withColumn("pattern", F.explode_outer("patterns"))
        votes = votes.join(heard, "pattern", "left").join(score.drop("values"), ["pattern", "kind"], "left")
        own = F.when(F.col("total").isNotNull(), F.coalesce("score", F.lit(0.0)))
        votes = votes.groupBy("value", "kind", "patterns", "n").agg(F.coalesce(F.avg(own), F.lit(0.0)).alias("score"))
        votes = votes.groupBy("value", "kind").agg((F.sum(F.col("score") * F.col("n")) / F.sum("n")).alias("score"))
        votes = votes.filter(F.col("score") >= accept)
        best = votes.groupBy("value").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"))
        found = cut_lineage(best, "found")
        more = found.count()
        if more <= size:
            return found
        size = more
        known = seeds.unionByName(open_edges.join(found, "value").select("pattern", "value", "kind", "n"))


def instances(rows: DataFrame) -> DataFrame:
    """(id, of, begin, end, value, patterns, kind): words that a base span begins in, with its kind, and words no span touches.

    Words and spans of a text are met in order of their places, so a long text
    costs a sort and no comparison of all with all.
    """
    word = F.struct("of", F.col("w.begin").alias("begin"), F.col("w.end").alias("end"), F.col("w.value").alias("value"), F.col("w.patterns").alias("patterns"))
    words = rows.select("id", "of", F.explode("words").alias("w")).select("id", F.col("w.begin").alias("begin"), word.alias("word"))
    spans = rows.select("id", F.explode("base").alias("span")).select("id", "span.begin", "span")
    places = words.unionByName(spans, allowMissingColumns=True)
    order = Window.partitionBy("id").orderBy("begin", F.col("word").isNull(), "span.rank")
    last = F.last(F.when(F.col("word").isNotNull(), F.struct("word.begin", "word.end")), ignorenulls=True).over(order)
    before = F.max(F.struct("span.end", "span.kind")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    places = places.withColumns({"last": last, "reached": F.when(F.col("word").isNotNull(), before)})
    inside = F.when(F.col("last.end") > F.col("begin"), F.col("last.begin"))
    own = F.when(F.col("word").isNotNull(), F.col("begin")).otherwise(inside)
    early = F.when(F.col("reached.end") > F.col("begin"), F.col("reached.kind"))
    places = places.withColumns({"own": own, "early": early}).filter("own IS NOT NULL")
    head = F.min(F.when(F.col("span").isNotNull(), F.struct("span.begin", "span.rank", "span.kind"))).alias("head")
    met = places.groupBy("id", "own").agg(F.max(F.when(F.col("word").isNotNull(), F.struct("word"))).alias("w"), F.max("early").alias("early"), head)
    met = met.filter("early IS NULL OR head IS NOT NULL")  # a span's later words are no instances
    kind = F.when(F.col("head").isNotNull(), F.coalesce("early", "head.kind"))
    return met.select("id", "w.word.*", kind.alias("kind"))


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans."""
    safe = F.translate(F.coalesce("text", F.lit("")), LEFT + RIGHT, "\ufffd\ufffd")
    rows = docs.select(F.col("doc_id").cast("long"), safe.alias("text")).withColumn("base", base_spans(F.col("text")))
    ids = F.transform(
        matches(F.col("text"), IDENTIFIER),
        lambda m: F.struct(m["begin"].alias("begin"), m["end"].alias("end"), m["value"].alias("value"), contexts(m["gap"], m["rest"]).alias("patterns")),
    )
    rows = rows.select("doc_id", F.xxhash64("text").alias("of"), "base", ids.alias("words"))
    rows = cut_lineage(rows.withColumn("id", F.monotonically_increasing_id()), "spans")
    words = cut_lineage(instances(rows), "words")
    # a seed is a place in a text, so that copies of one text support a pattern once
    seed = F.when(F.col("kind").isNotNull(), F.concat_ws(":", "of", "begin")).otherwise(F.col("value"))
    found = discovered(words.select(seed.alias("value"), "kind", "patterns"))
    more = words.filter("kind IS NULL").drop("kind").join(found, "value").select("id", "begin", "end", "kind")
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1
    more = more.groupBy("id").agg(F.collect_list(F.struct("begin", rank.alias("rank"), "kind", "end")).alias("more"))
    out = rows.drop("words").join(more, "id", "left")
    every = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(rows.schema["base"].dataType))))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return out.select(
        "doc_id", *[count(k) for k in KINDS], F.sha2(spans_text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        spans_text(every).alias("spans"),
    )
