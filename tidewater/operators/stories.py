"""Stories: articles that report one event, each joined to the best earlier one it has evidence for.

An item has ``item_id, url, title_hash, strict, words, companies, entities, category, at, knowable_at``:
``words`` are the distinct words of its title that carry meaning, ``at`` is when it was
published, ``knowable_at`` when it was known; ``strict`` marks documents of regulators and
exchanges, which join on equal address or title only.  Items are taken in the order of
knowable_at and item_id, and only earlier ones are candidates.

In a batch candidates meet over an address or a title without their words, over a company or
an entity with them, and over rare words (:mod:`.alike`).  In a stream they meet over keys, each
exact for one rule: an address, a title, or a company or an entity together with a word.  All
items order their words alike, and sets of similarity j share one of their first
n - ceil(j * n) + 1, so only those words make keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch
from .alike import candidates, of_pairs, slots, stored

# Scores of equal addresses and titles, and per rule the least similarity, the
# hours apart at most, and what the two have to share.
SAME_URL, SAME_TITLE = 1.0, 0.95
COMPANY_AND_CATEGORY = (0.25, 2)
COMPANY = (0.35, 6)
ENTITY_AND_CATEGORY = (0.5, 6)
ENTITY = (0.45, 3)
WORDING = (0.7, 3)
#: Hours between the times of two items of a story, and for how long an item is remembered.
WINDOW_HOURS, REMEMBERED_HOURS = 6, 12

ITEM = "item_id long, url string, title_hash string, strict boolean, words array<string>, companies array<string>, entities array<string>, category string, at timestamp, knowable_at timestamp"
FIELDS = [x.split()[0] for x in ITEM.split(", ")]


def keys(items: DataFrame) -> Column:
    """The keys under which an item meets its candidates: every pair that a rule joins has one in common.

    All items order their words by a hash.
    """
    words = F.transform(F.array_sort(F.transform("words", lambda w: F.struct(F.xxhash64(w).alias("h"), w.alias("w")))), lambda x: x["w"])
    n = F.size("words")

    def first(least: float) -> Column:
        return F.slice(words, 1, F.greatest(n - F.ceil(n * least - 1e-9).cast("int") + 1, F.lit(0)))

    def crossed(tag: str, names: str, least: float) -> Column:
        return F.flatten(F.transform(names, lambda c: F.transform(first(least), lambda w: F.concat_ws("|", F.lit(tag), c, w))))

    none = F.array().cast("array<string>")
    similar = F.when(F.col("strict") | (n == 0), none).when(F.size("companies") > 0, F.concat(crossed("c", "companies", COMPANY_AND_CATEGORY[0]), F.transform(first(WORDING[0]), lambda w: F.concat_ws("|", F.lit("w"), w)))).otherwise(
        F.concat(crossed("e", "entities", ENTITY[0]), F.transform(first(WORDING[0]), lambda w: F.concat_ws("|", F.lit("w"), w)))
    )
    url = F.when(F.col("url") != "", F.array(F.concat_ws("|", F.lit("u"), "url"))).otherwise(none)
    return F.array_distinct(F.concat(F.array(F.concat_ws("|", F.lit("t"), "title_hash")), url, similar))


def cleaned(items: DataFrame) -> DataFrame:
    """The items with empty lists for null ones, an empty address for none, and each word, company and entity once."""
    lists = {c: F.array_distinct(F.array_compact(F.coalesce(c, F.array().cast("array<string>")))) for c in ("words", "companies", "entities")}
    return items.withColumns(lists | {"url": F.coalesce("url", F.lit("")), "strict": F.coalesce("strict", F.lit(False)), "at": F.coalesce("at", "knowable_at").cast("timestamp"), "knowable_at": F.col("knowable_at").cast("timestamp")}).select(*FIELDS)


def evidence(m: str, c: str) -> tuple[Column, Column]:
    """``(score, method)`` of two items under the prefixes ``m`` and ``c``; nulls if nothing joins them.

    Times differ in tenths of minutes.
    """
    a, b = (lambda n: F.col(f"{m}{n}")), (lambda n: F.col(f"{c}{n}"))
    hours = F.round(F.abs(F.unix_micros(a("at")) - F.unix_micros(b("at"))) / 6e7, 1) / 60
    both = F.size(F.array_intersect(a("words"), b("words")))
    j = F.when((F.size(a("words")) > 0) & (F.size(b("words")) > 0), both / (F.size(a("words")) + F.size(b("words")) - both)).otherwise(0.0)
    company, entity = F.arrays_overlap(a("companies"), b("companies")), F.arrays_overlap(a("entities"), b("entities"))
    category = (a("category") == b("category")) & (a("category") != "OTHER")
    alone = (F.size(a("companies")) == 0) & (F.size(b("companies")) == 0)
    rule = lambda limits, also: (j >= limits[0]) & (hours <= limits[1]) & also
    joined = rule(COMPANY_AND_CATEGORY, company & category) | rule(COMPANY, company) | rule(ENTITY_AND_CATEGORY, alone & entity & category) | rule(ENTITY, alone & entity) | rule(WORDING, F.lit(True))
    similar = ~a("strict") & ~b("strict") & F.coalesce(joined, F.lit(False))
    equal, how = _equal(m, c)
    return F.when(equal.isNotNull(), equal).when(similar, F.round(j, 4)), F.when(how.isNotNull(), how).when(similar, "SIMILAR")


def _equal(m: str, c: str) -> tuple[Column, Column]:
    """Score and method of two items of one address or title; nulls otherwise."""
    same_url, same_title = (F.col(f"{m}url") != "") & (F.col(f"{m}url") == F.col(f"{c}url")), F.col(f"{m}title_hash") == F.col(f"{c}title_hash")
    return F.when(same_url, SAME_URL).when(same_title, SAME_TITLE), F.when(same_url, "SAME_URL").when(same_title, "SAME_TITLE")


def _met(rows: DataFrame, columns: list[str], also: Column) -> DataFrame:
    """Rows with the same ``_k`` and ``_g``, the later one under ``m_`` and an earlier one it may join under ``c_``."""
    m, c = (rows.select("_k", "_g", *[F.col(f).alias(f"{p}{f}") for f in columns]) for p in ("m_", "c_"))
    return m.join(c, ["_k", "_g"]).where(_in_reach() & also)


def _in_reach() -> Column:
    near = F.abs(F.unix_micros("m_at") - F.unix_micros("c_at")) <= int(WINDOW_HOURS * 3.6e9)
    # the default keeps the planner from filtering one side only: then both read the same shuffle
    remembered = F.coalesce(F.unix_micros("m_knowable_at") - F.unix_micros("c_at") <= int(REMEMBERED_HOURS * 3.6e9), F.lit(False))
    return near & remembered & (F.struct("c_knowable_at", "c_item_id") < F.struct("m_knowable_at", "m_item_id"))


def links(items: DataFrame) -> DataFrame:
    """``item_id, parent_id, score, method``: each item's best earlier one, of equal scores the first; items without one have no row.

    Words are shuffled with their item once a company or entity and slot of time, never with a pair.
    """
    base = stored(cleaned(items), "story-items")
    slot = F.explode(slots(F.unix_micros("at"), int(WINDOW_HOURS * 3.6e9))).alias("_g")
    found = ["m_item_id", "c_item_id", "c_knowable_at", "score", "method"]

    # equal addresses and titles: no words
    few = ["item_id", "url", "title_hash", "at", "knowable_at"]
    marks = F.array_compact(F.array(F.concat(F.lit("t|"), "title_hash"), F.when(F.col("url") != "", F.concat(F.lit("u|"), "url"))))
    score, method = _equal("m_", "c_")
    equal = _met(base.select(F.explode(marks).alias("_k"), "*").select("_k", slot, *few), few, F.lit(True)).withColumns({"score": score, "method": method}).select(*found)

    # a company, or without any an entity: the two are compared where they meet
    plain = base.where(~F.col("strict") & (F.size("words") > 0)).withColumn("n", F.size("words"))
    some = F.size("companies") > 0
    names = F.when(some, F.transform("companies", lambda x: F.concat(F.lit("c|"), x))).otherwise(F.transform("entities", lambda x: F.concat(F.lit("e|"), x)))
    least = F.when(F.size("m_companies") > 0, COMPANY_AND_CATEGORY[0]).otherwise(ENTITY[0])
    large_enough = F.least("m_n", "c_n") / F.greatest("m_n", "c_n") >= least  # no two sets are more alike than their sizes
    named = _met(plain.select(F.explode(names).alias("_k"), "*").select("_k", slot, *FIELDS, "n"), [*FIELDS, "n"], large_enough)

    # any two of nearly the same words; hours are compared in tenths of minutes, so three seconds more may be enough
    pairs = candidates(plain.select("item_id", F.unix_seconds("at").alias("t"), "words"), WORDING[0], int(WORDING[1] * 3600) + 4)
    either = pairs.select(F.explode(F.array(F.struct(F.col("a_id").alias("x"), F.col("b_id").alias("y")), F.struct(F.col("b_id").alias("x"), F.col("a_id").alias("y")))).alias("p")).select("p.*")
    paired = of_pairs(base, pairs)
    m, c = (paired.select(*[F.col(f).alias(f"{p}{f}") for f in FIELDS]) for p in ("m_", "c_"))
    alike = either.join(m, F.col("x") == F.col("m_item_id")).join(c, F.col("y") == F.col("c_item_id")).where(_in_reach())

    score, method = evidence("m_", "c_")
    scored = equal
    for met in (named, alike):
        scored = scored.unionByName(met.withColumns({"score": score, "method": method}).where("score IS NOT NULL").select(*found))
    best = scored.groupBy(F.col("m_item_id").alias("item_id")).agg(F.min_by(F.struct(F.col("c_item_id").alias("parent_id"), "score", "method"), F.struct(-F.col("score"), "c_knowable_at", "c_item_id")).alias("b"))
    return best.select("item_id", "b.*")


def roots(parents: DataFrame) -> DataFrame:
    """``item_id, root_id`` of all items of a forest (item_id, parent_id; a root is its own parent or no row's item).

    Every round doubles how far a pointer reaches and is written, so a story of n members in a
    chain takes log2(n) rounds and no task holds a story.
    """
    spark = parents.sparkSession
    at = scratch(spark, "story-roots")
    parents.select("item_id", "parent_id").write.parquet(f"{at}/0")
    for k in range(64):
        now = spark.read.parquet(f"{at}/{k}")
        up = now.select(F.col("item_id").alias("parent_id"), F.col("parent_id").alias("_up"))
        now.join(up, "parent_id", "left").select("item_id", F.coalesce("_up", "parent_id").alias("parent_id"), (F.col("_up") != F.col("parent_id")).alias("moved")).write.parquet(f"{at}/{k + 1}")
        later = spark.read.parquet(f"{at}/{k + 1}")
        if later.where("moved").isEmpty():
            return later.select("item_id", F.col("parent_id").alias("root_id"))
    raise RuntimeError("stories did not converge")


def assign(items: DataFrame) -> DataFrame:
    """``item_id, story_id, method, score, with_id`` of every item; a story's id is that of the item that founded it.

    An item without an earlier match founds a story (method FOUNDER, score 1).  Null lists are
    empty, a null address matches nothing, a null title hash or category neither; an item
    published at an unknown time counts from when it was known; ids are unique.
    """
    found = stored(links(items), "story-links")
    placed = roots(found)
    whole = items.select("item_id").join(found, "item_id", "left").join(placed, "item_id", "left")
    return whole.select("item_id", F.coalesce("root_id", "item_id").alias("story_id"), F.coalesce("method", F.lit("FOUNDER")).alias("method"), F.coalesce("score", F.lit(1.0)).alias("score"), F.col("parent_id").alias("with_id"))
