"""Line dedup by a deletion-neighbourhood join, with DataFrame functions only.

Lines stand between line feeds; their words stand between runs of ASCII white space, of which neither length nor kind
matters, nor what stands before the first or after the last word. Two lines are near when one insertion,
deletion or replacement of a word makes them equal and both have ``least`` words or more; shorter lines have an edit
bound of 0. A line goes when an equal or a near line stands earlier (smaller doc_id, then smaller line number).

Equal lines meet under one hash. For near lines every variant with one word deleted is a key: lines of n words that
agree without their i-th word differ in that word at most, and a line that equals another one's variant is one
deletion away. So the smallest place under a key answers for all lines under it and no pairs are made. Variants are
made only for lines that share the first or the second half with another line of fitting length, which one edit
always leaves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import free_name, small, stored

NO_ID = (1 << 63) - 1
#: An array that a fold makes grows by parts of this many elements, so a long line isn't copied at each of its words.
PART = 128
VISIBLE = r"[^\x20\x09-\x0D]"
#: Runs of white space within a line, but for a single space.
UNEVEN = r"[\x09\x0B-\x0D][\x20\x09\x0B-\x0D]*|\x20[\x20\x09\x0B-\x0D]+"


def half_keys(line: Column, n: Column, m: Column, least: int) -> list[Column]:
    """Hashes of the first and second half of the words of a line, for halves of a line of m words; null below ``least``."""
    p = F.floor(m / 2).cast("int")
    part = lambda count: F.call_function("substring_index", line, F.lit(" "), count)
    return [F.when(m >= least, F.xxhash64(part(p), m, F.lit(1))), F.when(m >= least, F.xxhash64(part(p - m), m, F.lit(2)))]


def variants(words: Column, n: Column, replaced: Column, longer: Column, shorter: Column) -> Column:
    """Keys of a line, for the relations that it may have: role 0 for lines of one length without a place, 1 for the whole line, 2 for it without a word.

    The hash of a sequence is the exclusive or of hashes of words with their places, so the variant without word i is
    the hash of what stands before, of what stands after one place earlier, and nothing else.
    """
    spots = F.transform(words, lambda w, i: F.struct(F.xxhash64(w, i).alias("own"), F.xxhash64(w, i - 1).alias("early")))
    whole = F.aggregate(spots, F.lit(0).cast("long"), lambda a, s: a.bitwiseXOR(s["own"]))
    early = F.aggregate(spots, F.lit(0).cast("long"), lambda a, s: a.bitwiseXOR(s["early"]))
    longs = F.array().cast("array<bigint>")
    start = F.struct(F.lit(0).cast("long").alias("before"), early.alias("after"), longs.alias("part"), F.array().cast("array<array<bigint>>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        after = acc["after"].bitwiseXOR(s["early"])
        part, full = F.concat(acc["part"], F.array(acc["before"].bitwiseXOR(after))), F.size(acc["part"]) >= PART - 1
        return F.struct(
            acc["before"].bitwiseXOR(s["own"]).alias("before"),
            after.alias("after"),
            F.when(full, longs).otherwise(part).alias("part"),
            F.when(full, F.concat(acc["out"], F.array(part))).otherwise(acc["out"]).alias("out"),
        )

    without = F.aggregate(spots, start, step, lambda acc: F.flatten(F.concat(acc["out"], F.array(acc["part"]))))
    key = lambda role, k: F.struct(F.lit(role).alias("role"), k.alias("key"))
    none = F.array().cast("array<struct<role:int,key:bigint>>")
    return F.concat(
        F.when(replaced, F.transform(without, lambda v, i: key(0, F.xxhash64(n, i, v)))).otherwise(none),
        F.when(longer, F.transform(F.array_distinct(without), lambda v: key(2, F.xxhash64(n - 1, v)))).otherwise(none),
        F.when(shorter, F.array(key(1, F.xxhash64(n, whole)))).otherwise(none),
    )


def within_one(a: Column, b: Column) -> Column:
    """Word edit distance of at most one."""
    replaced = (F.size(a) == F.size(b)) & (F.size(F.filter(F.zip_with(a, b, lambda x, y: x != y), lambda x: x)) <= 1)

    def inserted(s: Column, l: Column) -> Column:
        same = F.array_position(F.zip_with(s, F.slice(l, F.lit(1), F.size(s)), lambda x, y: x != y), True)
        p = F.when(same == 0, F.size(s)).otherwise(same - 1).cast("int")
        rest = F.size(s) - p
        return (F.size(l) == F.size(s) + 1) & (F.slice(s, p + 1, rest) == F.slice(l, p + 2, rest))

    return F.when(F.size(a) == F.size(b), replaced).when(F.size(a) < F.size(b), inserted(a, b)).otherwise(inserted(b, a))


def lines_of(docs: DataFrame) -> DataFrame:
    """A row per line with a visible character: d (id, the largest number for null), th (hash of the text), ln, line (its words with single spaces between), h, chk."""
    text = F.col("text")
    uneven = reduce(Column.__or__, [text.contains(x) for x in ("\t", "\x0b", "\x0c", "\r", "  ")])  # where UNEVEN has a match
    text = F.when(uneven, F.regexp_replace(text, UNEVEN, " ")).otherwise(text)
    rows = docs.where(F.col("text").isNotNull()).select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("d"), F.xxhash64("text").alias("th"), F.posexplode(F.split(text, "\n")).alias("ln", "line")
    )
    rows = rows.withColumn("line", F.trim("line"))
    return rows.where(F.col("line").rlike(VISIBLE)).select("*", F.xxhash64("line").alias("h"), F.hash("line").alias("chk"))


def repeated_lines(docs: DataFrame, least: int = 8) -> DataFrame:
    """Lines that go: d, th, ln.

    Texts are never joined to find them: what is shuffled are places and hashes (96 bits of a line), and the words of
    lines that share a half with another line. Near lines are verified word by word.
    """
    lines = lines_of(docs)
    n = F.char_length("line") - F.char_length(F.replace("line", F.lit(" "), F.lit(""))) + 1
    keys = [*half_keys(F.col("line"), F.col("n"), F.col("n"), least), *half_keys(F.col("line"), F.col("n"), F.col("n") - 1, least)]
    each = lines.withColumn("n", n).select("d", "th", "ln", "h", "chk", "n", *[k.alias(f"k{i}") for i, k in enumerate(keys)])
    each = stored(each, "lines")

    first = each.groupBy("h", "chk", "n").agg(F.min("d").alias("first"), *[F.min(f"k{i}").alias(f"k{i}") for i in range(4)])
    first = stored(first, "first-lines")
    same = each.select("d", "th", "ln", "h", "chk").join(first.select("h", "chk", "first"), ["h", "chk"])
    lead = F.dense_rank().over(Window.partitionBy("d", "th", "h", "chk").orderBy("ln"))
    own = same.where("d = first").withColumn("lead", lead)
    own = stored(own.select("d", "th", "ln", "h", "chk", "lead"), "own-lines")
    equal = same.where("d > first").select("d", "th", "ln").unionByName(own.where("lead > 1").select("d", "th", "ln"))

    half = first.where(F.col("n") >= least).select("h", "chk", F.posexplode(F.array(*[f"k{i}" for i in range(4)])).alias("i", "key")).where("key IS NOT NULL")
    half = half.select("h", "chk", "key", (F.col("i") > 1).alias("long"))
    shared = half.groupBy("key").agg(F.count_if(~F.col("long")).alias("fits"), F.count_if("long").alias("longs")).where("fits > 1 OR (fits > 0 AND longs > 0)")
    shared = stored(shared, "shared-halves")
    needs = half.join(small(shared), "key").groupBy("h", "chk").agg(
        F.max(~F.col("long") & (F.col("fits") > 1)).alias("replaced"), F.max(F.col("long") & (F.col("fits") > 0)).alias("longer"), F.max(~F.col("long") & (F.col("longs") > 0)).alias("shorter")
    )
    needs = stored(needs.where("replaced OR longer OR shorter"), "needs")
    heads = lines.join(small(needs), ["h", "chk"]).select("d", "th", "ln", "h", "chk", "replaced", "longer", "shorter", F.split("line", " ").alias("words"))
    heads = heads.join(own.where("lead = 1").select("d", "th", "ln", "h", "chk"), ["d", "th", "ln", "h", "chk"], "left_semi").dropDuplicates(["h", "chk", "d"])
    heads = stored(heads, "heads")

    made = heads.select("h", F.explode(variants(F.col("words"), F.size("words"), F.col("replaced"), F.col("longer"), F.col("shorter"))).alias("v")).select("h", "v.role", "v.key")
    made = stored(made, "variants")
    many = stored(made.groupBy("key").count().where("count > 1").select("key"), "shared-variants")
    met = made.join(small(many), "key", "left_semi").join(heads.select("h", F.struct("d", "ln", "h").alias("place")), "h")
    groups = met.groupBy("key").agg(*[F.min(F.when(F.col("role") == r, F.col("place"))).alias(f"f{r}") for r in range(3)])
    other = F.when(F.col("role") == 0, F.col("f0")).when(F.col("role") == 1, F.col("f2")).otherwise(F.col("f1"))
    met = met.join(groups, "key").withColumn("other", other).where(F.struct("other.d", "other.ln") < F.struct("place.d", "place.ln")).select("place", "other").distinct()
    mine = heads.select(F.struct("d", "ln", "h").alias("place"), F.col("words").alias("mine"))
    theirs = heads.select(F.struct("d", "ln", "h").alias("other"), F.col("words").alias("theirs"))
    near = met.join(mine, "place").join(theirs, "other").where(within_one(F.col("mine"), F.col("theirs"))).select("place.*").distinct()
    near = own.where("lead = 1").join(near, ["d", "ln", "h"], "left_semi").select("d", "th", "ln")
    return equal.unionByName(near)


def flags(places: str) -> Column:
    """An array that is true at the given places (ascending, from 0), up to the last of them."""
    before = F.concat(F.array(F.lit(-1)), F.slice(places, F.lit(1), F.size(places) - 1))
    return F.flatten(F.zip_with(places, before, lambda x, b: F.concat(F.array_repeat(F.lit(False), x - b - 1), F.array(F.lit(True)))))


def dedup_lines(docs: DataFrame, least: int = 8) -> DataFrame:
    """Keep the earliest of equal and near lines.

    Adds a struct ``lines`` (a column of that name is replaced): n_lines (lines of the text with a visible character),
    n_removed, text (the lines that stay, joined as they were). Blank lines always stay. Null texts have no line and
    stay null; null ids come last, as one document; unlike texts under one id are ordered by line number, and a text that
    repeats under one id keeps the same lines each time. Ids must be whole numbers (or cast to them). An empty table
    gives no rows.
    """
    d, th, gone = free_name(docs, "d"), free_name(docs, "th"), free_name(docs, "gone")
    removed = repeated_lines(docs.select("doc_id", "text"), least).groupBy("d", "th").agg(F.array_sort(F.collect_set("ln")).alias("gone"))
    removed = removed.select("d", "th", flags("gone").alias("gone")).toDF(d, th, gone)
    rows = docs.drop("lines").withColumn(d, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn(th, F.xxhash64("text"))
    rows = rows.join(removed, [d, th], "left")
    lines = F.split("text", "\n")
    n_lines = F.coalesce(F.size(F.filter(lines, lambda x: x.rlike(VISIBLE))), F.lit(0)).cast("long")
    kept = F.filter(lines, lambda x, i: ~F.coalesce(F.get(F.col(gone), i), F.lit(False)))
    n_removed = F.coalesce(F.size(F.filter(gone, lambda x: x)), F.lit(0)).cast("long")
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return rows.withColumn("lines", F.struct(F.when(F.col("text").isNull(), F.lit(0).cast("long")).otherwise(n_lines).alias("n_lines"), n_removed.alias("n_removed"), text.alias("text"))).drop(d, th, gone)


def report(docs: DataFrame, least: int = 8) -> DataFrame:
    """Counts and digest of :func:`dedup_lines`."""
    x = F.col("lines")
    return dedup_lines(docs.select("doc_id", "text"), least).select(
        "doc_id", x["n_lines"].alias("n_lines"), x["n_removed"].alias("n_removed"), F.sha2(F.coalesce(x["text"], F.lit("")).cast("binary"), 256).alias("kept_sha256")
    )


REPORT_SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL),
a AS (SELECT doc_id, unnest(x) AS line, unnest(range(1, len(x) + 1)) AS ln FROM d),
l AS (SELECT doc_id, ln, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w FROM a),
k AS (SELECT *, array_to_string(w, ' ') AS s, len(w) AS n, row_number() OVER (PARTITION BY array_to_string(w, ' ') ORDER BY doc_id, ln) AS r FROM l WHERE len(w) > 0),
f AS (SELECT row_number() OVER (ORDER BY doc_id, ln) AS o, doc_id, ln, w, n, s FROM k WHERE r = 1 AND n >= 8),
v AS (SELECT o, n, i, array_to_string(list_concat(w[1:i - 1], w[i + 1:n]), ' ') AS t FROM (SELECT o, n, w, unnest(range(1, n + 1)) AS i FROM f)),
e AS (
  SELECT o FROM (SELECT o, min(o) OVER (PARTITION BY n, i, t) AS m FROM v) WHERE m < o
  UNION SELECT v.o FROM v JOIN f ON f.s = v.t WHERE f.o < v.o
  UNION SELECT f.o FROM v JOIN f ON f.s = v.t WHERE v.o < f.o),
g AS (SELECT doc_id, ln FROM k WHERE r > 1 UNION ALL SELECT doc_id, ln FROM f JOIN e USING (o)),
c AS (SELECT a.doc_id, string_agg(a.line, chr(10) ORDER BY a.ln) AS kept FROM a LEFT JOIN g ON a.doc_id = g.doc_id AND a.ln = g.ln WHERE g.ln IS NULL GROUP BY a.doc_id),
m AS (SELECT doc_id, count(*) AS n_removed FROM g GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_lines FROM k GROUP BY doc_id)
SELECT documents.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN c USING (doc_id)
"""
