"""What each of five filters does in each order in which they can be applied.

Each document fails some of the filters A to E: its mask.  Documents are counted per
part and mask before anything is enumerated, so what follows works on 32 cells of a part
at most.  A recursive common table expression then extends filter prefixes: each level
adds every unused letter to every prefix, joins the mask cells of the part, carries the
bits applied so far, and emits the counts of that step.  After five levels the prefixes
are the 120 orders.

Filter E asks for the smallest doc_id among equal texts.  Texts are compared by SHA-256;
copies are counted per text, part and labels before they meet, so a text with a third
of all rows is a few rows by then.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kymora.llm.common import documents, stored

LETTERS = "ABCDE"
#: What separates words, and the limits of the filters.
BLANK, GAP = " \t\n\v\f\r", r"[\x20\x09-\x0D]+"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
SIGNS = "[#$%&*|]"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def own_failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, digest, mask): the filters A to D, which need no other document."""
    text = F.coalesce("text", F.lit(""))
    docs = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("text"), F.trim(text, F.lit(BLANK)).alias("trimmed"))
    words = F.when(F.col("trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("trimmed", GAP))
    docs = docs.withColumn("words", words)
    size = F.char_length("text")
    capitals = size - F.char_length(F.translate("text", CAPITALS, ""))
    tests = [
        F.size("words") < LEAST_WORDS,
        F.size(F.array_distinct("words")) * F.lit(100).cast("bigint") < F.size("words") * F.lit(LEAST_DISTINCT).cast("bigint"),
        capitals * F.lit(100).cast("bigint") > size * F.lit(MOST_CAPITALS).cast("bigint"),
        F.col("text").rlike(SIGNS),
    ]
    mask = sum((t.cast("int") * (1 << i) for i, t in enumerate(tests)), F.lit(0))
    return docs.select("doc_id", "part", F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)).alias("digest"), mask.alias("mask"))


def marks(labels: DataFrame) -> DataFrame:
    """(doc_id, good, toxic): one row for each labelled document; any of its rows can mark it."""
    have = set(labels.columns)

    def column(name: str) -> Column:
        return (labels[f"`{name}`"] if name in have else F.lit(None)).cast("bigint")

    rows = labels.select(column("doc_id").alias("doc_id"), (column("quality") == 1).alias("good"), (column("toxic") == 1).alias("toxic"))
    return rows.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in ("good", "toxic")])


def mask_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, cells): for each part its non-empty mask cells, 32 at most, with numbers of documents, good and toxic ones."""
    rows = own_failures(documents(docs, "source")).groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    rows = rows.join(marks(labels), "doc_id", "left").na.fill(False, ["good", "toxic"])
    # A row stands for the copies of one text in one part with one pair of labels; `ahead` are those with the least id of the row, `free` those without an id.
    copies = rows.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("ahead"), F.sum(F.when(F.isnull("doc_id"), F.col("n")).otherwise(0)).alias("free")
    )
    first = F.col("least") == F.min("least").over(W.partitionBy("digest"))
    passing = F.col("free") + F.when(first, F.col("ahead")).otherwise(0)
    copies = copies.withColumn("passing", passing)
    repeated = 1 << LETTERS.index("E")
    sides = F.array(F.struct(F.col("mask"), F.col("passing").alias("n")), F.struct((F.col("mask") + repeated).alias("mask"), (F.col("n") - F.col("passing")).alias("n")))
    each = copies.select("part", "good", "toxic", F.inline(sides)).filter("n > 0")
    cells = each.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic")
    )
    return cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))


def counted(what: str, where: str) -> str:
    return f"aggregate(filter(c.cells, x -> {where}), 0L, (s, x) -> s + x.{what})"


def enumeration() -> str:
    """The recursive query over {cells}: one row for each part and prefix of letters, with the counts of its steps."""
    letters = ", ".join(f"named_struct('letter', '{x}', 'bit', {1 << i})" for i, x in enumerate(LETTERS))
    removed = "x.mask & l.bit <> 0 AND x.mask & p.applied = 0"
    metrics = {
        "kept": counted("n", "x.mask & (p.applied | l.bit) = 0"),
        "removed": counted("n", removed),
        "redundant": counted("n", "x.mask & l.bit <> 0 AND x.mask & p.applied <> 0"),
        "unique_fails": counted("n", "x.mask = l.bit"),
        "good_lost": counted("good", removed),
        "toxic_lost": counted("toxic", removed),
    }
    step = ", ".join(["'step', p.level + 1", "'letter', l.letter", *(f"'{k}', {v}" for k, v in metrics.items())])
    kind = "array<struct<step: int, letter: string, " + ", ".join(f"{k}: bigint" for k in COUNTS) + ">>"
    return f"""
WITH RECURSIVE prefixes (part, filter_order, applied, level, steps) MAX RECURSION LEVEL {len(LETTERS) + 2} AS (
  SELECT part, '', 0, 0, CAST(array() AS {kind}) FROM {{cells}}
  UNION ALL
  SELECT p.part, concat(p.filter_order, l.letter), p.applied | l.bit, p.level + 1, CAST(concat(p.steps, array(named_struct({step}))) AS {kind})
  FROM prefixes p JOIN {{cells}} c ON c.part = p.part
  LATERAL VIEW explode(filter(array({letters}), u -> u.bit & p.applied = 0)) AS l
)
SELECT part, filter_order, inline(steps) FROM prefixes WHERE level = {len(LETTERS)}"""


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    ``docs`` (doc_id, text, source) fail A with under 50 words, B with few distinct
    words, C with many capitals, D with one of ``#$%&*|``, E where a row with a smaller
    doc_id has the same text.  There is a row for each part (source; null is the empty
    string), each of the 120 orders and each of its five steps, zeros included.
    Shapley is what the step's filter removes, summed over all orders.

    Null texts are empty ones.  Rows that repeat a doc_id and its text count each, and
    none is a smaller one of the other; rows without a doc_id count, have no label and
    neither fail E nor make others fail it.  ``labels`` (doc_id, quality, toxic) may
    repeat a doc_id: one row with 1 marks it; other documents are neither good nor
    toxic.  Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    # Rows of the recursion grow with the parts (326 each); the engine's limit of one million rows must not cut them.
    spark.conf.set("spark.sql.cteRecursionRowLimit", -1)
    cells = stored(mask_cells(docs, labels), "cells")
    steps = spark.sql(enumeration(), cells=cells)
    shapley = F.sum("removed").over(W.partitionBy("part", "letter"))
    return steps.select("part", "filter_order", "step", *COUNTS, shapley.alias("shapley"))
