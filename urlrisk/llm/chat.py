"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every turn becomes a segment, `<s>[INST] role [/INST] text </s>`, in which control strings
of role and text are escaped. A conversation's segments stand one after the other. Every
assistant turn is expanded into an example: its context is all that stands before its
reply, written out as a string, and its target, the only trainable part, is the reply.
Contexts of one conversation are prefixes of one another, so the examples' characters grow
with the square of its turns; they are written with a codec that finds such repeats.

A turn's place needs the lengths of all turns before it. Rows are range-partitioned by
(conversation, turn); each partition adds up its own lengths, and sums start from those of
the conversation's partitions before. A conversation with any share of all rows is dealt
over many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from urlrisk.llm.scratch import Scratch

BEGIN, MIDDLE, END = "<s>[INST] ", " [/INST] ", " </s>"
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
ASSISTANT = "assistant"
#: Between the parts that make a turn's place among equal turn numbers.
_ORDER = ("turn", "role", "_digest")
#: Turns beyond which a conversation's examples are dealt out in runs of that many.
RUN = 64


@dataclass(frozen=True)
class Formatted:
    """`segments`: conv_id, position, start, segment (one row per turn). `examples`:
    conv_id, position (of the last turn), mask_start, mask_end, chars, context, target."""

    segments: DataFrame
    examples: DataFrame


def escape(text: Column) -> Column:
    """`text` with backslashes doubled and one put into every control string."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in CONTROLS:
        text = F.replace(text, F.lit(control), F.lit(control[0] + "\\" + control[1:]))
    return text


def unescape(text: Column) -> Column:
    """What `escape` was given: a backslash stands for the character after it."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def segment(role: Column, text: Column) -> Column:
    return F.concat(F.lit(BEGIN), escape(role), F.lit(MIDDLE), escape(text), F.lit(END))


def parsed(of: Column) -> tuple[Column, Column]:
    """Role and text of a segment."""
    inner = F.substring(of, F.lit(len(BEGIN) + 1), F.length(of) - len(BEGIN) - len(END))
    at = F.locate(MIDDLE, inner)
    return unescape(F.substring(inner, F.lit(1), at - 1)), unescape(F.substring(inner, at + len(MIDDLE), F.length(inner)))


def _placed(turns: DataFrame, scratch: Scratch, partitions: int) -> DataFrame:
    """`conv_id, position, start, role, segment` of all turns."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text"))
    rows = turns.select("conv_id", "turn", role, text)
    rows = rows.select("conv_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("_digest"), segment(F.col("role"), F.col("text")).alias("segment"))
    # Equal rows may stand in any order among themselves; the last key deals them out.
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    ranged = rows.repartitionByRange(partitions, "conv_id", *_ORDER, "_row").withColumn("_part", F.spark_partition_id())
    # Window and join deal rows by the same keys, which are never null: one shuffle for both.
    keys = [F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("_conv"), F.col("conv_id").isNull().alias("_none")]
    ranged = scratch.put(ranged, "ranged").select("*", *keys)
    length = F.length("segment").cast("long")
    sums = ranged.groupBy("_conv", "_none", "_part").agg(F.count("*").alias("_turns"), F.sum(length).alias("_chars"))
    before = Window.partitionBy("_conv", "_none").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    first = [F.coalesce(F.sum(c).over(before), F.lit(0)).alias(n) for c, n in (("_turns", "_turn0"), ("_chars", "_char0"))]
    starts = sums.select("_conv", "_none", "_part", *first)
    within = Window.partitionBy("_conv", "_none", "_part").orderBy(*_ORDER, "_row")  # within one range partition
    here = F.coalesce(F.sum(length).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = ranged.select("*", F.row_number().over(within).alias("_nth"), here.alias("_here"))
    position, start = F.col("_turn0") + F.col("_nth") - 1, F.col("_char0") + F.col("_here")
    joined = own.join(starts, ["_conv", "_none", "_part"])
    return joined.select("conv_id", position.cast("long").alias("position"), start.cast("long").alias("start"), "role", "segment")


def format_conversations(turns: DataFrame, path: str | None = None, partitions: int | None = None) -> Formatted:
    """Segments and examples of `turns` (`conv_id, turn, role, text`), written below `path`
    (else to the shared scratch folder) and read back.

    Turns stand by turn number, null first; equal numbers by role and then by the MD5 of
    the text, equal rows as they come. Null roles and texts count as empty; a null conv_id
    is a conversation of its own. A conversation whose last turn is not an assistant's has
    one more example, of all its turns, with an empty mask. Other columns are not read. An
    empty table gives empty tables. A very long text is one segment.
    """
    spark = turns.sparkSession
    scratch = Scratch(spark, "chat")
    path = path or scratch.path("formatted")
    placed = _placed(turns, scratch, partitions or int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed.write.parquet(f"{path}/segments")
    segments = spark.read.parquet(f"{path}/segments")
    _expanded(segments).write.option("compression", "zstd").parquet(f"{path}/examples")
    return read(spark, path)


def _expanded(segments: DataFrame) -> DataFrame:
    """The examples of all conversations. A conversation's segments come together once, and
    its examples are made from that row; one of more than `RUN` turns is dealt out, a row
    for each run of examples."""
    ordered = F.array_sort(F.collect_list(F.struct("position", "start", "role", "segment")))
    whole = segments.groupBy("conv_id").agg(ordered.alias("_all")).withColumn("_n", F.size("_all"))
    runs = whole.where(F.col("_n") > RUN).withColumn("_run", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / RUN).cast("int"))))
    runs = runs.repartition("conv_id", "_run")
    few = whole.where(F.col("_n") <= RUN).withColumn("_run", F.lit(0))
    first = F.col("_run") * RUN + 1
    at = F.sequence(first, F.least(F.col("_n"), first + (RUN - 1)))
    is_target = lambda i: (F.element_at("_all", i)["role"] == ASSISTANT) | (i == F.col("_n"))
    one = few.unionByName(runs).withColumn("_i", F.explode(F.filter(at, is_target)))
    last = F.element_at("_all", F.col("_i"))
    size = F.length(last["segment"])
    head = F.when(last["role"] == ASSISTANT, F.length(segment(last["role"], F.lit(""))) - len(END)).otherwise(size)
    before = F.array_join(F.slice("_all", F.lit(1), F.col("_i") - 1)["segment"], "")
    end = last["start"] + size
    tail = F.when(last["role"] == ASSISTANT, F.lit(len(END))).otherwise(0)
    return one.select(
        "conv_id", last["position"].alias("position"), (last["start"] + head).alias("mask_start"), (end - tail).alias("mask_end"),
        end.cast("long").alias("chars"), F.concat(before, F.substring(last["segment"], F.lit(1), head)).alias("context"),
        F.substring(last["segment"], head + 1, size - head - tail).alias("target"),
    )


def read(spark: SparkSession, path: str) -> Formatted:
    return Formatted(spark.read.parquet(f"{path}/segments").drop("role"), spark.read.parquet(f"{path}/examples"))


def texts(formatted: Formatted, examples: DataFrame | None = None) -> DataFrame:
    """`examples` (by default all) with `context` and `target`, as they were written."""
    return formatted.examples if examples is None else examples


def digests(formatted: Formatted) -> DataFrame:
    """One row per conversation, read back from the output: `n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars` (characters of all its examples).

    A digest is of one string, so it holds a conversation's texts in one row. Lengths and
    loss texts are those of the examples' own strings."""
    role, text = parsed(F.col("segment"))
    of = formatted.examples
    trained = of["mask_end"] > of["mask_start"]
    chars = F.length("context") + F.length("target") + F.when(F.col("chars") > F.col("mask_end"), len(END)).otherwise(0)
    mask = of.select(F.col("conv_id").alias("_conv"), F.col("position").alias("_at"), chars.cast("long").alias("chars"), F.when(trained, unescape(F.col("target"))).alias("_loss"))
    joined = formatted.segments.join(mask, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("position") == F.col("_at")), "left")
    turns = joined.select(
        "conv_id", "position", "chars", F.concat(role, F.lit("\n"), text, F.lit("\n")).alias("turn_text"), F.coalesce("_loss", F.lit("")).alias("loss_text"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("position", "turn_text", "loss_text")))
    whole = turns.groupBy("conv_id").agg(F.count("*").alias("n_turns"), ordered.alias("_all"), F.sum("chars").alias("formatted_chars"))
    whole = whole.select("conv_id", "n_turns", "formatted_chars", F.array_join("_all.turn_text", "").alias("_turns"), F.array_join("_all.loss_text", "").alias("_loss"))
    return whole.select(
        "conv_id", "n_turns", F.sha2(F.col("_turns").cast("binary"), 256).alias("turns_sha256"), F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("_loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )
