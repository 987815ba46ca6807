"""Line dedup (operator 2): a deletion-neighbourhood join with DataFrame functions only.

A line goes when an earlier line of the corpus equals it or is within one edit
(insertion, deletion or substitution of one character).  Lines within one edit share a
variant with the edited character deleted.  A line has as many such variants as
characters, each as long as itself, so the neighbourhood is built from coarse to fine:
first whole blocks are deleted, each level only divides the blocks whose variant
another line shares, and the last level deletes single characters.  Whoever is within
one edit stays together through all levels; the edit distance is verified at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, scratch, stored, table

#: Shorter lines (list marks, headings, "Chapter 2") take no part in the one-edit join: among them an edit makes another line.
NEAR_FROM = 20
#: Blocks of the first level and of each further one.
COARSE, FINE = 2, 8
#: Blocks of at most so many characters are taken character by character.
SINGLE = 64
#: The filter between a level's two scans has 2**24 bits: 262,144 rows at most are broadcast, whatever the corpus.
FILTER_BITS = 24


def _lines(docs: DataFrame, near_from: int = NEAR_FROM) -> DataFrame:
    """The lines that may go: those that are not blank, and blank ones of ``near_from`` characters or more."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("n", F.length("line"))
    return lines.where((F.col("n") >= near_from) | F.col("line").rlike(r"[^\x20\x09-\x0D]"))


def _variants(key: Column, inner: Column, extra: Column, length: Column, blocks: int) -> list[Column]:
    """The variants of a stretch with each of its blocks deleted: structs (key, a, size) of the new key and the block.

    Blocks are laid out over ``length``, the stretch's length without the ``extra``
    character that a longer partner has; that character is deleted with the block.
    """
    cut = [F.floor(length * j / blocks).cast("int") for j in range(blocks + 1)]
    piece = lambda a, n: F.xxhash64(F.substring(inner, a + F.lit(1), n))
    before = [piece(cut[j], cut[j + 1] - cut[j]) for j in range(blocks - 1)]
    after = [piece(cut[j] + extra, cut[j + 1] - cut[j]) for j in range(1, blocks)]
    return [
        F.struct(F.xxhash64(key, F.lit(j), *before[:j], *after[j:]).alias("key"), cut[j].alias("a"), (cut[j + 1] - cut[j] + extra).alias("size"))
        for j in range(blocks)
    ]


def _profile(lines: DataFrame, near_from: int) -> DataFrame:
    """A row per line without its text: two hashes of it, and the keys of its first-level variants.

    A line has its variants twice: as a line of its length, and as one that is a
    character longer than its partner.
    """
    keys = []
    for extra in (0, 1):
        length = F.col("n") - extra
        keys += [v["key"] for v in _variants(length.cast("long"), F.col("line"), F.lit(extra), length, COARSE)]
    keys = F.when(F.col("n") >= near_from, F.array(*keys))
    return lines.select("doc_id", "line_no", "n", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("h2"), keys.alias("keys"))


def _shared(variants: DataFrame) -> DataFrame:
    """The keys that two or more different lines have."""
    return variants.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi").select("key")


def _flagged(rows: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """Adds ``_td_may``: whether a row may have one of the keys.  A bitmap of fixed size is broadcast; exact joins follow."""
    bits = (1 << FILTER_BITS) - 1
    low = lambda at: at.bitwiseAND(F.lit(63)).cast("int")
    at = F.col("key").bitwiseAND(F.lit(bits))
    words = keys.select(F.shiftright(at, 6).cast("int").alias("_td_word"), F.call_function("shiftleft", F.lit(1).cast("long"), low(at)).alias("_td_bit"))
    words = words.groupBy("_td_word").agg(F.bit_or("_td_bit").alias("_td_bits"))
    at = F.col(key).bitwiseAND(F.lit(bits))
    bit = F.call_function("shiftrightunsigned", F.col("_td_bits"), low(at)).bitwiseAND(F.lit(1)) == 1
    joined = rows.withColumn("_td_word", F.shiftright(at, 6).cast("int")).join(F.broadcast(words), "_td_word", "left")
    return joined.withColumn("_td_may", F.coalesce(bit, F.lit(False))).drop("_td_word", "_td_bits")


def _thinned(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows that may have one of the keys."""
    return _flagged(rows, keys).where("_td_may").drop("_td_may")


def near_lines(profile: DataFrame, docs: DataFrame) -> DataFrame:
    """``h, h2, kept``: the lines with an earlier one within an edit, and the earliest such (doc_id, line_no) met."""
    variants = profile.select("doc_id", "line_no", "n", "h", "h2", F.posexplode("keys").alias("i", "key"))
    shared = stored(_shared(variants))
    rows = _thinned(variants, shared).join(shared, "key", "left_semi")
    # equal lines fold into their first occurrence; only of these is the text fetched, once a line
    rows = stored(rows.groupBy("key", "i", "n", "h", "h2").agg(F.min(F.struct("doc_id", "line_no")).alias("pos")))
    wanted = rows.select("h", "h2", "pos").distinct()
    some = _thinned(docs.withColumn("key", F.xxhash64("doc_id")), wanted.select(F.xxhash64("pos.doc_id").alias("key")))
    some = _thinned(_lines(some).withColumn("key", F.xxhash64("doc_id", "line_no")), wanted.select(F.xxhash64("pos.doc_id", "pos.line_no").alias("key")))
    text_of = some.select("doc_id", "line_no", "line")
    found = wanted.join(text_of, F.col("pos.doc_id").eqNullSafe(text_of["doc_id"]) & (F.col("pos.line_no") == text_of["line_no"])).where(F.xxhash64("line") == F.col("h"))
    texts = stored(found.groupBy("h", "h2").agg(F.min("line").alias("line")))
    cut = lambda j: F.floor((F.col("n") - F.col("extra")) * j / COARSE).cast("int")
    rows = rows.withColumns({"extra": F.floor(F.col("i") / COARSE).cast("int"), "j": F.col("i") % COARSE}).join(texts, ["h", "h2"])
    inner = F.substring("line", cut(F.col("j")) + 1, cut(F.col("j") + 1) - cut(F.col("j")) + F.col("extra"))
    rows = stored(rows.select("key", "extra", "h", "h2", inner.alias("inner"), "pos"))
    while (rows.agg(F.max(F.length("inner"))).first()[0] or 0) > SINGLE:
        length = F.length("inner") - F.col("extra")
        whole = F.array(F.struct(F.xxhash64("key", F.lit(-1)).alias("key"), F.lit(0).alias("a"), F.length("inner").alias("size")))
        # by reference length, so that partners are divided alike
        divided = F.when(length >= SINGLE, F.array(*_variants(F.col("key"), F.col("inner"), F.col("extra"), length, FINE))).otherwise(whole)
        finer = rows.withColumn("v", F.explode(divided)).select(F.col("v.key").alias("key"), "extra", "h", "h2", F.substring("inner", F.col("v.a") + F.lit(1), F.col("v.size")).alias("inner"), "pos")
        shared = stored(_shared(finer))
        rows = stored(_thinned(finer, shared).join(shared, "key", "left_semi"))
    # single characters: "s" keys join lines that differ at one place, "d" keys a line and those that have one character more
    size = F.length("inner")
    without = lambda p: F.struct(F.substring("inner", F.lit(1), p).alias("l"), F.substring(F.col("inner"), p + F.lit(2), size).alias("r"))
    places = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
    replaced = F.transform(places, lambda p: F.struct(F.lit("s").alias("kind"), F.xxhash64(F.col("key"), p, without(p)).alias("at")))
    itself = F.array(F.struct(F.lit("d").alias("kind"), F.xxhash64("key", "inner").alias("at")))
    deleted = F.transform(places, lambda p: F.struct(F.lit("d").alias("kind"), F.xxhash64(F.col("key"), F.concat(without(p)["l"], without(p)["r"])).alias("at")))
    last = rows.withColumn("v", F.explode(F.when(F.col("extra") == 0, F.concat(replaced, itself)).otherwise(deleted)))
    last = last.select(F.col("v.kind").alias("kind"), F.col("v.at").alias("key"), "extra", "h", "h2", "pos")
    shared = stored(_shared(last))
    last = _thinned(last, shared)
    entry = F.struct("pos", "h", "h2")
    groups = last.groupBy("kind", "key").agg(
        F.min(F.when(F.col("extra") == 0, entry)).alias("same"), F.min(F.when(F.col("extra") == 1, entry)).alias("longer"), F.min("h").alias("lo"), F.max("h").alias("hi")
    ).where("lo <> hi")
    met = last.join(groups, ["kind", "key"])
    other = F.when((F.col("kind") == "d") & (F.col("extra") == 0), F.col("longer")).otherwise(F.col("same"))
    met = met.withColumn("other", other).where(F.col("other.pos") < F.col("pos")).select("h", "h2", "other").distinct()
    first, second = texts.withColumnRenamed("line", "x"), texts.select(F.col("h").alias("oh"), F.col("h2").alias("oh2"), F.col("line").alias("y"))
    met = met.join(first, ["h", "h2"]).join(second, (F.col("other.h") == F.col("oh")) & (F.col("other.h2") == F.col("oh2")))
    met = met.where(F.levenshtein("x", "y", 1) == 1)
    return met.groupBy("h", "h2").agg(F.min("other.pos").alias("kept"))


def duplicate_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", near_from: int = NEAR_FROM) -> DataFrame:
    """``doc_id, line_no, kept_doc, kept_line``: every line that goes, and an earlier one that stands for it.

    Lines are parted at ``\\n`` and counted from 0.  A line goes if an equal one comes
    before it in the order of (doc_id, line_no), however short it is, unless it is blank;
    from ``near_from`` characters on it also goes if an earlier line of so many characters
    is within one edit.  The input decides, not what is left of it: a line may go because
    of one that goes itself.

    A null or empty text has no such line; a null id comes first; rows of one id and
    line number are told apart by nothing, so equal lines there are one.  An empty table
    gives no rows; other columns are not looked at, whatever their names.
    """
    docs = docs.select(column(doc_id).alias("doc_id"), column(text).alias("text"))
    with scratch() as keep:
        lines = stored(_profile(_lines(docs, near_from), near_from))
        firsts = lines.groupBy("h", "h2").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count("*").alias("c"))
        near = near_lines(lines.where(F.col("n") >= near_from), docs)
        decided = stored(firsts.join(near, ["h", "h2"], "left").where("c > 1 OR kept IS NOT NULL").select("h", "h2", "first", "kept"))
        rows = lines.select("doc_id", "line_no", "h", "h2", F.col("h").alias("key"))
        rows = _thinned(rows, decided.select(F.col("h").alias("key"))).drop("key").join(decided, ["h", "h2"])
        again = F.struct("doc_id", "line_no") > F.col("first")
        gone = rows.where(again | F.col("kept").isNotNull())
        earlier = F.when(F.col("kept").isNull(), F.col("first")).otherwise(F.least("first", "kept"))
        return keep(stored(gone.select("doc_id", "line_no", earlier["doc_id"].alias("kept_doc"), earlier["line_no"].alias("kept_line"))))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", near_from: int = NEAR_FROM) -> DataFrame:
    """The rows of ``docs`` with their duplicate lines taken out of ``text``, and a last column ``removed_lines`` (count).

    All other columns and all rows stay; a text that loses every line becomes empty, a
    null one stays null.  Rows are told apart by id and text, those of one id in the order
    of a hash of the text; rows that are equal in both are treated alike.  Columns may have
    any names but ``removed_lines`` (in any case), which is refused; an empty table gives no
    rows.  Only the numbers of the lines that go stay in the shared folder.
    """
    if "removed_lines" in map(str.lower, docs.columns):
        raise ValueError("the documents already have a column removed_lines")
    # by id alone, what goes from one text would go from every other text of that id
    row = F.struct(column(doc_id).alias("id"), F.xxhash64(column(text)).alias("t"))
    # the documents' columns travel in one struct, so that none of theirs meets one of ours
    whole = docs.select(row.alias("row"), F.struct(*[column(c).alias(c) for c in docs.columns]).alias("doc"))
    with scratch() as keep:
        found = duplicate_lines(docs.select(row.alias("doc_id"), column(text).alias("text")), near_from=near_from)
        gone = keep(stored(found.groupBy(F.col("doc_id").alias("id")).agg(F.collect_set("line_no").alias("gone"))))
    # only documents that may lose a line move; one plan at every size, for what goes grows with the corpus
    keyed = _flagged(whole.withColumn("key", F.xxhash64("row")), gone.select(F.xxhash64("id").alias("key")))
    both = keyed.where("_td_may").join(gone.hint("merge"), F.col("row").eqNullSafe(F.col("id")), "left")
    body = F.col("doc").getField(text)
    both = both.withColumn("lines", F.split(body, "\n"))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    cut = F.when(F.col("gone").isNull(), body).otherwise(F.array_join(F.transform(left, lambda i: F.get(F.col("lines"), i)), "\n"))
    fields = lambda new: [new.alias(c) if c == text else F.col("doc").getField(c).alias(c) for c in docs.columns]
    some = both.select(*fields(cut), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("removed_lines"))
    return some.union(keyed.where("NOT _td_may").select(*fields(body), F.lit(0).cast("long").alias("removed_lines")))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, removed lines and the digest of what stays of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"))
    return dedup_lines(docs).select("doc_id", "n_lines", F.col("removed_lines").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE = r"""
WITH parted AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
each AS (SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) - 1 AS no FROM parted),
taken AS (SELECT * FROM each WHERE length(l) >= 20 OR regexp_matches(l, '[^\x20\x09-\x0D]')),
firsts AS (SELECT l, length(l) AS n, min((doc_id, no)) AS pos FROM taken GROUP BY l),
forms AS (
  SELECT l, n, pos, n AS ref FROM firsts WHERE n >= 20 UNION ALL SELECT l, n, pos, n - 1 FROM firsts WHERE n >= 20
), halves AS (SELECT *, left(l, (ref // 2)::BIGINT) AS pre, right(l, (ref - ref // 2)::BIGINT) AS suf FROM forms),
pairs AS (
  SELECT a.l AS x, b.l AS y FROM halves a JOIN halves b ON a.ref = b.ref AND a.pre = b.pre AND a.n = a.ref AND a.l <> b.l
  UNION SELECT a.l, b.l FROM halves a JOIN halves b ON a.ref = b.ref AND a.suf = b.suf AND a.n = a.ref AND a.l <> b.l
), near AS (SELECT x, y FROM pairs WHERE levenshtein(x, y) <= 1),
both_ways AS (SELECT x, y FROM near UNION SELECT y, x FROM near),
gone_lines AS (SELECT DISTINCT f.l FROM both_ways b JOIN firsts f ON f.l = b.x JOIN firsts g ON g.l = b.y WHERE g.pos < f.pos),
flags AS (
  SELECT e.doc_id, e.no, e.l, (f.l IS NOT NULL AND ((e.doc_id, e.no) <> f.pos OR g.l IS NOT NULL)) AS gone
  FROM each e LEFT JOIN firsts f ON f.l = e.l LEFT JOIN gone_lines g ON g.l = e.l
), kept AS (
  SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_removed,
         string_agg(l, chr(10) ORDER BY no) FILTER (WHERE NOT gone) AS kept FROM flags GROUP BY doc_id
)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
