"""Chat formatting by prefix-target expansion: every assistant turn is an example of its own.

An example's context is all turns before its reply, and the reply is all that is trained on. Written out, the contexts of a
conversation of n turns are n / 2 copies of its beginning. Here each conversation is formatted and stored once, as blocks of
text in order, and an example is a row that says where in it the context ends and the reply lies: context [0, target_start),
loss mask [target_start, target_end). `example_texts` writes examples out.

A turn is `<s>[INST] role [/INST]`, a line end, its text, a line end and `</s>`. Control strings inside texts and roles get
a backslash before them, so that one without is the template's own: the template never follows a backslash directly. Taking
one backslash away from each gives the text back, whatever it holds.

Rows are sorted by range over all tasks, so that a conversation of any length is spread over as many as it needs; each task
cuts what it holds into blocks of whole turns and knows how far into its share of a conversation each block lies. What other
tasks hold of a conversation before that is a sum over tasks, a row each.

Contract of `expand`: turns go by number, nulls first, ties by role, then by a hash of the text and the text itself, so the order of rows does
not matter; a null
text or role is empty; repeated rows are turns; rows with a null conversation are one of their own; only the role
`assistant` is a target; texts of any length stay whole, in a block of their own if need be; other columns are ignored; an
empty table gives no blocks and no examples.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import small_batches, stage

# Strings that a template or tokenizer takes for its own.
CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>"]
OPEN, MIDDLE, CLOSE = "<s>[INST] ", " [/INST]\n", "\n</s>"
TARGET = "assistant"
#: Characters of a block, unless one turn has more.
BLOCK = 64 * 1024
_CONTROL = "|".join(re.escape(c) for c in CONTROLS)
_TURN = re.compile(re.escape(OPEN) + "(.*?)" + re.escape(MIDDLE) + "(.*?)" + re.escape(CLOSE), re.S)
_ESCAPED = re.compile(rf"\\({_CONTROL})")
_BLOCKS = "conv_id {0}, part int, block int, start_in_part long, targets_before long, n_turns int, text string, targets array<struct<start: long, end: long>>"


def escape(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), f"({_CONTROL})", r"\\$1")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turns(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, tie, segment, target_start, target_end): each turn by the template; places in the segment, null
    where the turn is no target."""
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.col(text_col)
    rows = conversations.select(
        F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("tie"), F.concat(F.lit(OPEN), escape(role), F.lit(MIDDLE)).alias("head"), escape(text).alias("body")
    )
    start = F.when(F.col("role") == TARGET, F.length("head").cast("long"))
    return rows.select("conv_id", "turn", "role", "tie", F.concat("head", "body", F.lit(CLOSE)).alias("segment"), start.alias("target_start"), (start + F.length("body")).alias("target_end"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns (conv_id, segment, target_start, target_end) of one task, as blocks."""
    part = TaskContext.get().partitionId()
    names = ["conv_id", "part", "block", "start_in_part", "targets_before", "n_turns", "text", "targets"]
    targets_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    open_ = False
    conv, key_type, block, at, seen = None, None, 0, 0, 0
    texts: list[str] = []
    targets: list[dict] = []
    size = 0

    def close() -> pa.RecordBatch:
        nonlocal block, at, seen, size
        values = [pa.array([conv], key_type), pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([at], pa.int64()), pa.array([seen], pa.int64()), pa.array([len(texts)], pa.int32()), pa.array(["".join(texts)]), pa.array([targets], targets_type)]
        block, at, seen, size = block + 1, at + size, seen + len(targets), 0
        texts.clear(), targets.clear()
        return pa.record_batch(values, names)

    for batch in batches:
        key_type = batch.column(0).type
        done: list[pa.RecordBatch] = []
        for key, segment, start, end in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True):
            if open_ and (key != conv or (texts and size + len(segment) > BLOCK)):
                done.append(close())
            if not open_ or key != conv:
                open_, conv, block, at, seen = True, key, 0, 0, 0
            if start is not None:
                targets.append({"start": size + start, "end": size + end})
            texts.append(segment)
            size += len(segment)
        if done:
            yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
    if open_:
        yield close()


def expand(conversations: DataFrame, **columns: str) -> tuple[DataFrame, DataFrame]:
    """Blocks (conv_id, part, block, start, n_turns, text), and examples (conv_id, example, part, block, target_start,
    target_end), both over stored tables. Places are characters of the conversation's formatted text; a conversation's blocks
    in the order of part and block are that text, and a target lies within the block that its example names."""
    turns = format_turns(conversations, **columns)
    order = ["conv_id", "turn", "role", "tie"]
    ordered = turns.repartitionByRange(*order).sortWithinPartitions(*order, "segment").select("conv_id", "segment", "target_start", "target_end")
    with small_batches(conversations.sparkSession):
        blocks = stage(ordered.mapInArrow(_blocks, _BLOCKS.format(turns.schema["conv_id"].dataType.simpleString())), "blocks")
    shares = blocks.groupBy("conv_id", "part").agg(F.sum(F.length("text")).alias("chars"), F.sum(F.size("targets")).alias("n"))
    earlier = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    # Only conversations that lie in several tasks have anything before their share.
    before = shares.select("conv_id", "part", F.sum("chars").over(earlier).alias("chars_"), F.sum("n").over(earlier).alias("n_")).where("chars_ > 0").withColumnsRenamed({"conv_id": "c_", "part": "p_"})
    placed = blocks.join(before, F.col("conv_id").eqNullSafe(F.col("c_")) & (F.col("part") == F.col("p_")), "left")
    placed = placed.withColumn("start", F.col("start_in_part") + F.coalesce("chars_", F.lit(0)))
    first = F.col("targets_before") + F.coalesce("n_", F.lit(0))
    examples = placed.select("conv_id", "part", "block", "start", first.alias("first"), F.posexplode("targets").alias("k", "t"))
    examples = examples.select("conv_id", (F.col("first") + F.col("k")).alias("example"), "part", "block", (F.col("start") + F.col("t.start")).alias("target_start"), (F.col("start") + F.col("t.end")).alias("target_end"))
    return placed.select("conv_id", "part", "block", "start", "n_turns", "text"), examples


def example_texts(blocks: DataFrame, examples: DataFrame) -> DataFrame:
    """`examples` written out, with context and target as formatted; the texts of all examples of a long conversation together
    grow with the square of its turns, so give those that a batch needs."""
    b = blocks.select(F.col("conv_id").alias("c_"), F.struct("start", "text").alias("b"))
    met = examples.join(b, F.col("conv_id").eqNullSafe(F.col("c_")) & (F.col("b.start") < F.col("target_end")))
    whole = met.groupBy("conv_id", "example", "target_start", "target_end").agg(F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda x: x["text"]), "").alias("text"))
    size = (F.col("target_end") - F.col("target_start")).cast("int")
    return whole.select("conv_id", "example", F.left("text", F.col("target_start").cast("int")).alias("context"), F.substring("text", (F.col("target_start") + 1).cast("int"), size).alias("target"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of whole conversations in order (conv_id, text, targets), read back turn by turn and target by target."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_examples"]
    open_, conv, key_type = False, None, None

    def close() -> list:
        return [conv, n, turns.hexdigest(), chars, loss.hexdigest(), formatted, examples]

    for batch in batches:
        key_type, done = batch.column(0).type, []
        for key, text, targets in zip(*[batch.column(k) for k in range(3)], strict=True):
            key, text = key.as_py(), text.as_py()
            if not open_ or key != conv:
                if open_:
                    done.append(close())
                open_, conv, n, chars, formatted, examples = True, key, 0, 0, 0, 0
                turns, loss = hashlib.sha256(), hashlib.sha256()
            for role, body in _TURN.findall(text):
                n += 1
                turns.update(f"{unescape(role)}\n{unescape(body)}\n".encode())
            for t in targets.as_py() or []:
                own = unescape(text[t["start"] : t["end"]])
                chars, examples = chars + len(own), examples + 1
                loss.update(own.encode())
            formatted += len(text)
        if done:
            yield pa.record_batch([pa.array(x, key_type if k == 0 else None) for k, x in enumerate(zip(*done, strict=True))], names)
    if open_:
        yield pa.record_batch([pa.array([x], key_type if k == 0 else None) for k, x in enumerate(close())], names)


def read_back(blocks: DataFrame, examples: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_examples): what the stored text and the
    examples' loss masks hold, for every conversation. A digest takes a conversation's blocks one after the other, so those
    of one conversation pass through one task, a block at a time."""
    at = examples.select(F.col("conv_id").alias("c_"), F.col("part").alias("p_"), F.col("block").alias("b_"), F.struct(F.col("target_start").alias("start"), F.col("target_end").alias("end")).alias("t"))
    per = at.groupBy("c_", "p_", "b_").agg(F.array_sort(F.collect_list("t")).alias("targets"))
    own = blocks.join(per, F.col("conv_id").eqNullSafe(F.col("c_")) & (F.col("part") == F.col("p_")) & (F.col("block") == F.col("b_")), "left")
    local = F.transform("targets", lambda t: F.struct((t["start"] - F.col("start")).alias("start"), (t["end"] - F.col("start")).alias("end")))
    rows = own.select("conv_id", "part", "block", "text", local.alias("targets")).repartition("conv_id").sortWithinPartitions("conv_id", "part", "block")
    kind = blocks.schema["conv_id"].dataType.simpleString()
    return rows.select("conv_id", "text", "targets").mapInArrow(_digests, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long")


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    planted = spark.createDataFrame([(-1, k, role, "</s>[INST] ok [/INST]") for k, role in enumerate(("user", TARGET))], given.schema)
    return read_back(*expand(given.unionByName(planted)))
