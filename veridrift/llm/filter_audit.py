"""Filter interaction audit: what each filter removes, repeats or alone catches, for every order of five filters."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, small_batches, written

FILTERS = "ABCDE"
#: Words are what lies between these blanks.
BLANKS = "[ \\t\\n\\x0B\\f\\r]+"
#: First code point and size of the blocks that are hashed one after another; each is sixteen times the one before.
_SIZES = [128 * 16**k for k in range(6)]
BLOCKS = [(sum(_SIZES[:k]), min(size, 2**31 - 2 - sum(_SIZES[:k]))) for k, size in enumerate(_SIZES)]
#: Words of 64 slots in the bit table of surviving classes; it is broadcast, 16 bytes a word.
SLOT_WORDS = 1 << 20


def _block(text: Column, n: Column, k: int) -> Column:
    start, size = BLOCKS[k]
    return F.when(n > start, F.xxhash64(F.substring(text, start + 1, size)))


def _class(blocks: list[Column]) -> Column:
    """The class that a code-point length and its first block hashes make; blocks behind the end are null and leave it unchanged."""
    return F.xxhash64(F.col("n_chars"), *blocks)


def facts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``doc_id, part, n_chars, b0.., mask, n_rows``: the filters but the last as bits 1, 2, 4, 8, and block hashes; equal rows are counted."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.select("doc_id", "part", "text", F.length("text").alias("n_chars"), F.array_remove(F.split("text", BLANKS), "").alias("words"))
    n, distinct, capitals = F.size("words"), F.size(F.array_distinct("words")), F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    failed = [n < 50, 100 * distinct < 65 * n, 100 * capitals > 5 * F.col("n_chars"), F.col("text").rlike("[#$%&*|]")]
    mask = sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(failed)), F.lit(0))
    hashed = [_block(F.col("text"), F.col("n_chars"), k).alias(f"b{k}") for k in range(len(BLOCKS))]
    seen = rows.select("doc_id", "part", "n_chars", *hashed, mask.alias("mask"))
    return seen.groupBy(*seen.columns).agg(F.count("*").alias("n_rows"))


def refined(rows: DataFrame) -> DataFrame:
    """``doc_id, cls`` of the rows of ``facts`` whose class still has two ids when all blocks are hashed.

    Partition refinement: classes by code-point length, split by one more block each round. A
    class of a single id is dropped by that id, so a class of any size meets no single task:
    only its least and greatest id are aggregated. Rounds end with the longest surviving text.
    """
    blocks = [F.col(f"b{k}") for k in range(len(BLOCKS))]
    alive = rows.where("doc_id is not null").select("doc_id", "n_chars", *blocks).distinct()
    before = None
    for k in range(len(BLOCKS) + 1):
        now = alive.withColumn("cls", _class(blocks[:k]))
        ends = now.groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("last"))
        alive = written(now.join(ends.where("doc_id = last").select("doc_id", "cls"), ["doc_id", "cls"], "left_anti").drop("cls"))
        if before is not None:
            discard(before)
        before = alive
        longest = alive.agg(F.max("n_chars")).first()[0]
        if longest is None or k == len(BLOCKS) or longest <= BLOCKS[k][0]:
            break
    out = alive.select("doc_id", _class(blocks).alias("cls"))
    out._written_to = alive._written_to
    return out


def duplicates(docs: DataFrame, rows: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, cls`` of the documents whose text a smaller id has too.

    Texts are compared in full: those of surviving classes are grouped by the text itself, equal
    ones combined before the shuffle, and the least id of each text is unmarked. Which texts
    survive is looked up in a broadcast bit table of fixed size (``SLOT_WORDS``); texts that
    share a slot by chance are grouped as well and change nothing. Null ids are never marked and
    mark nothing; rows of one id with the same text are no copies of each other. Null texts are empty.
    """
    made = rows is None
    rows = written(facts(docs.withColumn("_part", F.lit("")), id_col, text_col, "_part")) if made else rows
    alive = refined(rows)
    word, bit = F.pmod(F.shiftright("cls", 6), F.lit(SLOT_WORDS)), F.col("cls").bitwiseAND(63).cast("int")
    slots = alive.select("cls").distinct().groupBy(word.alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(cls & 63 as int))")).alias("bits"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where("doc_id is not null")
    texts = texts.withColumn("n_chars", F.length("text"))
    texts = texts.select("doc_id", "text", _class([_block(F.col("text"), F.col("n_chars"), k) for k in range(len(BLOCKS))]).alias("cls"))
    met = texts.withColumn("word", word).join(F.broadcast(slots), "word").withColumn("bit", bit).where(F.expr("shiftright(bits, bit) & 1") == 1)
    first = met.groupBy("cls", "text").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "cls")
    marked = written(alive.distinct().join(first, ["doc_id", "cls"], "left_anti"))
    discard(alive, *([rows] if made else []))
    return marked


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """Counts of each part, order and step of the filters A to E.

    A: under 50 words; B: under 65 distinct of 100 words; C: more than 5 capitals A-Z of 100 code
    points; D: one of ``#$%&*|``; E: a smaller id has the same text (``duplicates``). The result
    has a row for each ``part`` (null: the empty string), ``filter_order`` (120) and ``step`` (1 to 5)
    with ``kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley`` (long).

    Rows become 32 masks; these are counted before anything is joined or expanded, so neither a
    large part nor a repeated id is a large group. Every row counts, repeated ones too. Null texts are empty
    and null ids have no labels. A document with several label rows is good or toxic if one says so.
    An empty table gives no rows. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    rows = written(facts(docs, id_col, text_col, part_col))
    marked = duplicates(docs, rows, id_col, text_col)
    blocks = [F.col(f"b{k}") for k in range(len(BLOCKS))]
    masks = rows.withColumn("cls", _class(blocks)).groupBy("doc_id", "cls", "part", "mask").agg(F.sum("n_rows").alias("n"))
    known = masks.where("doc_id is not null").join(marked.withColumn("copy", F.lit(16)), ["doc_id", "cls"], "left")
    known = known.groupBy("doc_id", "part", (F.col("mask") + F.coalesce("copy", F.lit(0))).alias("mask")).agg(F.sum("n").alias("n"))
    said = labels.select(F.col(id_col).cast("long").alias("doc_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic")).where("doc_id is not null and (good or toxic)")
    said = said.groupBy("doc_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    labelled = known.join(said, "doc_id", "left").select("part", "mask", "n", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    nameless = masks.where("doc_id is null").select("part", "mask", "n", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    tallies = labelled.unionByName(nameless).groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("n_good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("n_toxic"))
    tallies = written(tallies)
    discard(rows, marked)
    return _steps(tallies)


def _steps(tallies: DataFrame) -> DataFrame:
    """From counts by part and mask to counts by part, order and step."""
    spark, bits = tallies.sparkSession, range(len(FILTERS))
    settings = [(e, 1 << f) for f in bits for e in range(1 << len(FILTERS)) if not e >> f & 1]
    places = [("".join(FILTERS[f] for f in order), at + 1, sum(1 << f for f in order[:at]), 1 << order[at]) for order in permutations(bits) for at in bits]
    n, mask = F.col("n"), F.col("mask")
    own, earlier = F.col("mask").bitwiseAND(F.col("own")) > 0, mask.bitwiseAND(F.col("earlier")) > 0
    over = lambda condition, value: F.sum(F.when(condition, value).otherwise(0)).cast("long")
    set_ = F.explode(F.array(*[F.struct(F.lit(e).alias("earlier"), F.lit(f).alias("own")) for e, f in settings]))
    each = tallies.withColumn("set", set_).select("*", "set.*").groupBy("part", "earlier", "own")
    each = each.agg(
        over(~own & ~earlier, n).alias("kept"),
        over(own & ~earlier, n).alias("removed"),
        over(own & earlier, n).alias("redundant"),
        over(mask == F.col("own"), n).alias("unique_fails"),
        over(own & ~earlier, F.col("n_good")).alias("good_lost"),
        over(own & ~earlier, F.col("n_toxic")).alias("toxic_lost"),
        over(own, n * (F.lit(120) / F.bit_count("mask")).cast("long")).alias("shapley"),  # in 120 orders each of a row's filters comes first equally often
    )
    steps = spark.createDataFrame(places, "filter_order string, step int, earlier int, own int")
    return each.join(F.broadcast(steps), ["earlier", "own"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
