"""Line deduplication across all documents by a deletion-neighbourhood join.

Lines are compared without blanks at their ends.  A line goes if an equal line stands earlier (by document
id, then line number), or if an earlier line is within one edit (insertion, deletion or replacement of a character) and
both lines have at least ``least`` characters, a parameter.  Lines without other characters than blanks stay.

Two lines within one edit share a variant: the shorter one is the longer one with a character deleted, or both with the
character at one place deleted are equal.  So every line emits its deletion variants as hashed keys, and equal keys
join.  Groups of equal keys form a star around their earliest line, so a group costs as many pairs as lines.  Pairs are
verified by edit distance on the lines.

Emitting a variant per character is kept for lines that can have a partner.  Two lossless tests come before it: one
edit leaves one half of a line as it was, so only lines that share a half with another one go on; and it leaves
all but one block, so only blocks whose surroundings are shared emit variants.  No test drops a line that has a
partner, and none looks at a prefix or a sample.

All of it is DataFrame work on hashes; texts move once to fetch the candidates' lines and once to be rewritten.

Defined results: null texts stay null, empty ones empty; an equal line of the same document counts as earlier if it
stands above; a row is known by its id and a 60-bit hash of its text, so rows that share an id, or have none, stand one after
the other in this order and lose lines of their own only; a null id comes first; rows equal in id and text are treated
alike, so the lines of one of them stay in all; an empty table gives an empty result; other columns, whatever their names, pass unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import store

#: lines of fewer characters go only for equal ones: one edit apart, short lines mostly say different things
MIN_CHARS = 20
BLOCK = 32  # characters; longer lines use the square root of their length
HALF = 16  # halves are cut at multiples of half of this, so lengths that differ by one mostly share cuts
BLANK = " \t\r"
GOES = "__text_lines_gone"


def row_hash(text: Column) -> Column:
    """60 bits of the text's MD5, as a number: with the document id it tells rows apart."""
    return F.conv(F.substring(F.md5(text.cast("string").cast("binary")), 1, 15), 16, 10).cast("long")


def _lines(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc, own (hash of the text), line (number), body of each line that is not blank."""
    rows = documents.select(F.col(doc_id).alias("doc"), row_hash(F.col(text)).alias("own"), F.col(text).cast("string").alias("text"))
    # in a step of its own: beside the explode the hash would be made anew for every line
    rows = rows.select("doc", "own", F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    return rows.select("doc", "own", "line", F.btrim("raw", F.lit(BLANK)).alias("body")).filter("body <> ''")


def _hashes(d: DataFrame) -> DataFrame:
    """A line as two independent 64-bit hashes."""
    return d.withColumn("h1", F.xxhash64("body")).withColumn("h2", F.xxhash64(F.lit(1), "body"))


def half_keys(body: Column, least: int) -> Column:
    """Hashes of the first and last half for each length a partner may have; null for lines too short for one."""
    n = F.char_length(body)

    def cuts(length: Column) -> Column:
        half = (length / HALF).cast("int") * F.lit(HALF // 2)
        left = F.xxhash64(F.lit("left"), half, F.substring(body, F.lit(1), half))
        right = F.xxhash64(F.lit("right"), half, F.substring(body, n - half + 1, half))
        return F.array(left, right)

    both = F.when(n % HALF == 0, F.concat(cuts(n), cuts(n - 1))).otherwise(cuts(n))
    return F.when(n >= least, both)


def block_rows(lines: DataFrame) -> DataFrame:
    """A row per line, role and block: the hash of all outside the block, and the block's characters.

    Role 0: the line as the longer or equal one of a pair.  Role 1: as the shorter one, cut so that the
    longer line has one more character in the block.
    """
    roles = lines.withColumn("role", F.explode(F.array(F.lit(0), F.lit(1))))
    roles = roles.withColumn("chars", F.char_length("body") + F.col("role"))
    roles = roles.withColumn("step", F.greatest(F.lit(BLOCK), F.ceil(F.sqrt("chars")).cast("int")))
    blocks = roles.withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("chars") - 1) / F.col("step")).cast("int"))))
    start = F.col("block") * F.col("step")
    end = F.least(start + F.col("step"), F.col("chars")) - F.col("role")
    outside = F.xxhash64(
        "chars", "block", F.substring("body", F.lit(1), start), F.substring("body", end + 1, F.col("chars"))
    )
    return blocks.select("h1", "h2", "first", "role", outside.alias("outside"), F.substring("body", start + 1, end - start).alias("inside"))


def near_lines(lines: DataFrame) -> DataFrame:
    """(h1, h2) of lines that have an earlier line within one edit, stored.

    ``lines``: distinct lines as h1, h2, first (struct doc, own, line) and body.
    """
    rows = block_rows(lines)
    shared = rows.groupBy("outside").agg(F.count("*").alias("n")).filter("n > 1").select("outside")
    rows = rows.join(shared, "outside")
    places = F.when(F.col("role") == 0, F.sequence(F.lit(1), F.char_length("inside"))).otherwise(F.array(F.lit(0)))
    variants = rows.withColumn("place", F.explode(places))
    left = F.substring("inside", F.lit(1), F.col("place") - 1)
    shorter = F.concat(left, F.substring("inside", F.col("place") + 1, F.char_length("inside")))
    variants = variants.withColumn("key", F.xxhash64("outside", F.when(F.col("role") == 0, shorter).otherwise(F.col("inside"))))
    variants = store.keep(variants.select("key", "place", "first", "h1", "h2"), "variants")
    mine = F.struct("first", "h1", "h2")
    # replaced characters: the same place deleted; a star around the earliest line
    deleted = variants.filter("place > 0")
    star = deleted.groupBy("key", "place").agg(F.min(mine).alias("hub"), F.count("*").alias("n")).filter("n > 1").drop("n")
    replaced = deleted.join(star, ["key", "place"]).filter("first > hub.first")
    replaced = replaced.select(mine.alias("later"), F.col("hub").alias("earlier"))
    # inserted or deleted characters: a line that is a variant of another; a star around that line
    whole = variants.filter("place = 0").select("key", mine.alias("short")).distinct()
    meets = deleted.join(whole, "key").select(mine.alias("long"), "short")
    turned = F.col("short")["first"] < F.col("long")["first"]
    inserted = meets.select(F.when(turned, F.col("long")).otherwise(F.col("short")).alias("later"), F.when(turned, F.col("short")).otherwise(F.col("long")).alias("earlier"))
    pairs = replaced.unionByName(inserted).select(
        F.col("later.h1").alias("h1"), F.col("later.h2").alias("h2"), F.col("earlier.h1").alias("e1"), F.col("earlier.h2").alias("e2")
    ).distinct()
    bodies = lines.select("h1", "h2", "body")
    pairs = pairs.join(bodies, ["h1", "h2"])
    pairs = pairs.join(bodies.select(F.col("h1").alias("e1"), F.col("h2").alias("e2"), F.col("body").alias("other")), ["e1", "e2"])
    near = store.keep(pairs.filter(F.levenshtein("body", "other", 1) == 1).select("h1", "h2").distinct(), "near")
    store.drop(lines.sparkSession, variants)
    return near


def repeated_lines(documents: DataFrame, *, least: int = MIN_CHARS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, own, lines): the numbers of the lines that go, for rows that have any; stored."""
    spark = documents.sparkSession
    hashed = _hashes(_lines(documents, doc_id, text))
    place = F.struct("doc", "own", "line")
    classes = hashed.select("h1", "h2", "doc", "own", "line", half_keys(F.col("body"), least).alias("halves")).groupBy("h1", "h2")
    classes = classes.agg(F.min(place).alias("first"), F.count("*").alias("n"), F.first("halves").alias("halves"))
    classes = store.keep(classes, "lines")
    # lines that share a half with another line
    halves = classes.select("h1", "h2", "first", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.count("*").alias("n")).filter("n > 1").select("half")
    wanted = store.keep(halves.join(shared, "half").select("h1", "h2", "first").distinct(), "wanted")
    # their texts, by the rows they are in
    by_row = wanted.groupBy(F.col("first.doc").alias("in"), F.col("first.own").alias("hash")).agg(F.collect_set("first.line").alias("lines"))
    texts = documents.select(F.col(doc_id).alias("doc"), row_hash(F.col(text)).alias("own"), F.split(F.col(text).cast("string"), "\n").alias("raw"))
    # a list that grows with the documents is never broadcast, also where it is still small
    found = texts.join(by_row.hint("merge"), F.col("doc").eqNullSafe(F.col("in")) & (F.col("own") == F.col("hash"))).drop("in", "hash")
    found = found.select("doc", "own", F.explode("lines").alias("line"), "raw")
    found = found.select("doc", "own", "line", F.btrim(F.get("raw", F.col("line")), F.lit(BLANK)).alias("body"))
    found = _hashes(found.filter("body <> ''")).select("h1", "h2", place.alias("first"), "body")
    kept = wanted.select("h1", "h2", F.col("first").alias("at"))
    candidates = found.join(kept, ["h1", "h2"]).filter(F.col("first").eqNullSafe(F.col("at"))).drop("at").dropDuplicates(["h1", "h2"])
    candidates = store.keep(candidates, "candidates")
    store.drop(spark, wanted)
    near = near_lines(candidates)
    store.drop(spark, candidates)
    judged = classes.join(near.withColumn("near", F.lit(True)), ["h1", "h2"], "left").withColumn("near", F.coalesce("near", F.lit(False)))
    judged = judged.filter("n > 1 OR near").select("h1", "h2", "first", "near")
    gone = hashed.select("doc", "own", "line", "h1", "h2").join(judged, ["h1", "h2"])
    gone = gone.filter(F.col("near") | ~place.eqNullSafe(F.col("first")))
    gone = store.keep(gone.groupBy("doc", "own").agg(F.collect_set("line").alias("lines")), "gone")
    store.drop(spark, classes)
    store.drop(spark, near)
    return gone


def dedup_lines(
    documents: DataFrame, *, least: int = MIN_CHARS, doc_id: str = "doc_id", text: str = "text", size: str | None = None
) -> DataFrame:
    """The documents without repeated lines; columns as they were, ``size`` (if named) as the new number of characters."""
    gone = repeated_lines(documents, least=least, doc_id=doc_id, text=text)
    names = documents.columns
    gone = gone.select(F.col("doc").alias(GOES + "_in"), F.col("own").alias(GOES + "_hash"), F.col("lines").alias(GOES))
    same = F.col(doc_id).eqNullSafe(F.col(GOES + "_in")) & (F.col(GOES + "_own") == F.col(GOES + "_hash"))
    rows = documents.withColumn(GOES + "_own", row_hash(F.col(text))).join(gone.hint("merge"), same, "left")

    def rewrite(lines: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(GOES))
        return F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")

    split = F.split(F.col(text).cast("string"), "\n")
    body = F.when(F.col(GOES).isNull(), F.col(text)).otherwise(F.transform(F.array(split), rewrite)[0])
    rows = rows.withColumn(text, body)
    if size and size in names:
        rows = rows.withColumn(size, F.char_length(text).cast(documents.schema[size].dataType))
    return rows.select(*(F.col(f"`{c}`") for c in names))
