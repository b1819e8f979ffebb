"""Secret scan: base patterns, and parts of one credential linked by an interval join within a scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Base patterns and their least lengths.
ASSIGN = (
    r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}
# A run shorter than the least can hold no longer one, so these find the same spans with fewer pieces.
LONG_ACCESS = r"AKIA[A-Z0-9]{16,}"
LONG_HEX = r"[0-9a-f]{24,}"

# Weak parts, reported only beside their complements.
IDENTITY = r"""(?:[uU]ser(?:_?[nN]ame)?|[lL]ogin|[cC]lient_?[iI][dD]|[aA]ccount(?:_?[iI][dD])?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{2,}"""
BLOB = r"(?<![A-Za-z0-9+/_.=-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{16,}=*(?![A-Za-z0-9+/_.=-])"
ENDPOINT = r"""[a-z][a-z0-9+.-]*://[^\x00-\x20"'<>]+|[hH]ost(?:[nN]ame)?["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]+"""
KINDS = ("assign", "access", "hex", "identity", "blob", "endpoint")
SPANS = "array<struct<kind:int,start:int,end:int>>"
#: Matches that are folded at once.
PART = 256


def spans_of(text: Column, pattern: str, kind: int, keep: Column | None = None, group: int = 0, least: int = 0) -> Column:
    """Spans of a pattern's leftmost non-overlapping matches, in code points.

    The text between matches comes from ``split`` and the matches from ``regexp_extract_all``; both are found by the
    same scan, so lengths alternate and a fold over them gives the places. A fold copies what it has gathered at each
    step, so it goes by parts of ``PART`` matches and gathers the parts. One-element arrays hold what is used twice.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    held = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda x: F.char_length(x) >= least)
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    pieces = F.arrays_zip(gaps.alias("gap"), F.transform(found, F.char_length).alias("size"), held.alias("held"))
    none = F.array().cast(SPANS)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.coalesce(x["gap"], F.lit(0))
        end = start + F.coalesce(x["size"], F.lit(0))
        one = F.array(F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(F.coalesce(x["held"], F.lit(False)), F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    def part(pieces: Column, acc: Column, k: Column) -> Column:
        inner = F.aggregate(F.slice(pieces, k * PART + 1, PART), F.struct(acc["at"].alias("at"), none.alias("out")), step)
        return F.transform(F.array(inner), lambda x: F.struct(x["at"].alias("at"), F.array_append(acc["out"], x["out"]).alias("out")))[0]

    def folded(pieces: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPANS}>").alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / PART).cast("int")), zero, lambda acc, k: part(pieces, acc, k), lambda acc: F.flatten(acc["out"]))

    spans = F.transform(F.array(pieces), folded)[0]
    return F.when(text.rlike(pattern) if keep is None else keep, spans).otherwise(F.array().cast(SPANS))


def scan(docs: DataFrame, scope: int = 200) -> DataFrame:
    """Secrets of every whole text.

    Base kinds (assign, access, hex) always count. A weak identity needs a secret (assign, hex or blob) within
    ``scope`` code points in the same text, a weak blob needs an identifier (access or identity), an endpoint needs
    both. A blob that overlaps a base span or an endpoint is part of that and no candidate.

    The interval join is a sweep: parts are ordered by place within a text, and the nearest end before and start after
    of each role come from running windows, one in either order, so no pairs are made and a part costs the same in a
    text of any length. Only places travel, never texts.
    Returns doc_id and spans (array of kind, start, end in order of start, then kind). Null text is empty; repeated
    rows each return a row; equal rows under one doc_id give equal results.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    every = F.concat(
        spans_of(text, ASSIGN, 0, group=2, least=LEAST["assign"]),
        spans_of(text, LONG_ACCESS, 1),
        spans_of(text, LONG_HEX, 2),
        spans_of(text, IDENTITY, 3),
        spans_of(text, BLOB, 4),
        spans_of(text, ENDPOINT, 5),
    )
    head = F.array(F.struct(F.lit(-1).alias("kind"), F.lit(-1).alias("start"), F.lit(-1).alias("end")))
    # The hash is bound to a variable, or it would be taken anew for each part of a text.
    named = lambda h: F.transform(F.concat(head, every), lambda p: F.struct(h.alias("th"), p["kind"].alias("kind"), p["start"].alias("start"), p["end"].alias("end")))
    parts = docs.select("doc_id", F.explode(F.transform(F.array(F.xxhash64(text, F.length(text))), named)[0]).alias("p")).select("doc_id", "p.*")
    parts = parts.groupBy("doc_id", "th", "kind", "start", "end").agg(F.count(F.lit(1)).alias("copies"))
    text_key = Window.partitionBy("doc_id", "th").orderBy("start", "kind", "end")
    backwards = Window.partitionBy("doc_id", "th").orderBy(F.desc("start"), F.desc("kind"), F.desc("end"))
    before, after = (w.rowsBetween(Window.unboundedPreceding, -1) for w in (text_key, backwards))

    def near(*kinds: int) -> Column:
        of = F.col("kind").isin(*kinds)
        gap_before = F.col("start") - F.max(F.when(of, F.col("end"))).over(before)
        gap_after = F.min(F.when(of, F.col("start"))).over(after) - F.col("end")
        return F.coalesce(gap_before <= scope, F.lit(False)) | F.coalesce(gap_after <= scope, F.lit(False))

    solid = F.col("kind").isin(0, 1, 2, 5)
    inside = F.coalesce(F.max(F.when(solid, F.col("end"))).over(before) > F.col("start"), F.lit(False)) | F.coalesce(
        F.min(F.when(solid, F.col("start"))).over(after) < F.col("end"), F.lit(False)
    )
    parts = parts.withColumn("blob_inside", inside).withColumn("secret", near(0, 2, 4)).withColumn("identifier", near(1, 3))
    linked = (
        F.when(F.col("kind") == 3, F.col("secret"))
        .when(F.col("kind") == 4, F.col("identifier") & ~F.col("blob_inside"))
        .when(F.col("kind") == 5, F.col("secret") & F.col("identifier"))
        .otherwise(True)
    )
    place = F.struct("start", "kind", "end")
    return (
        parts.where(linked)
        .groupBy("doc_id", "th")
        .agg(F.sort_array(F.collect_list(F.when(F.col("kind") >= 0, place))).alias("spans"), F.max(F.when(F.col("kind") < 0, F.col("copies"))).alias("copies"))
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
        .select("doc_id", "spans")
    )


def digest_of(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, scope: int = 200) -> DataFrame:
    """Counts and digests of :func:`scan`."""
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return scan(docs, scope).select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(digest_of(F.filter("spans", lambda s: s["kind"] < 3)).cast("binary"), 256).alias("base_sha256"),
        digest_of(F.col("spans")).alias("spans"),
    )
