"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns as context, then the reply, which alone is
trainable. An example is a run of rows, one per turn, so that no prefix is ever gathered into one value: (conv_id,
example, place, chunk), where the row of the reply ends with the reply and carries the place of its trainable text.
Turns after the last reply belong to no example; they follow as rows without an example number. The rows are made by
exploding each turn into the examples it is part of, after the one shuffle that brings a conversation together. Their
number grows with the square of a conversation's turns, as the expansion does.

Template, per turn: ``### role: `` then the text, then ``</turn>`` and a line feed. In texts and roles, backslash, ``#`` and
``<`` get a backslash in front, and ``:`` too in roles; so a marker never arises from content, and removing one
backslash before each escaped character gives the content back.

A null text is empty, a null role an empty role; a null conversation id is a conversation of its own. Turns with equal
numbers are ordered by role, then text; repeated rows stay. A conversation without assistant turns has no example,
and its turns are still there. An empty table gives an empty result. Other columns are not looked at. Texts and roles of
any length are read in linear time and bounded stack.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilwork.llm.common import cell

TRAINED = "assistant"
_OPEN, _MIDDLE, _CLOSE = "### ", ": ", "</turn>\n"


def escaped(text: Column, marks: str = r"[\\#<]") -> Column:
    return F.regexp_replace(text, "(" + marks + ")", r"\\$1")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def expand_prefixes(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per example and turn in it: conv_id, example (0..), place (0..), chunk, loss_start, loss_size.

    The chunks of an example, in order of place, are its formatted text. ``loss_start`` and ``loss_size`` (code points of
    the chunk, from 0) are set on the reply's row only.
    """
    role, text = F.coalesce(cell(role_col).cast("string"), F.lit("")), F.coalesce(cell(text_col).cast("string"), F.lit(""))
    rows = turns.select(cell(conv_col).alias("conv_id"), cell(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    order, conversation = Window.partitionBy("conv_id").orderBy("turn", "role", "text"), Window.partitionBy("conv_id")
    trained = (F.col("role") == TRAINED).cast("int")
    earlier = F.coalesce(F.sum(trained).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("place", F.row_number().over(order) - 1).withColumn("first", earlier).withColumn("examples", F.sum(trained).over(conversation))
    head = F.concat(F.lit(_OPEN), escaped(F.col("role"), r"[\\#<:]"), F.lit(_MIDDLE))
    rows = rows.withColumn("head", head).withColumn("body", escaped(F.col("text")))
    # a turn is part of its own example, if it is a reply, and of all later ones
    part_of = F.when(F.col("first") < F.col("examples"), F.sequence("first", F.col("examples") - 1)).otherwise(F.array(F.lit(None).cast("bigint")))
    rows = rows.withColumn("example", F.explode(part_of))
    reply = (F.col("role") == TRAINED) & (F.col("example") == F.col("first"))
    return rows.select(
        "conv_id",
        "example",
        "place",
        F.concat("head", "body", F.when(reply, "").otherwise(_CLOSE)).alias("chunk"),
        F.when(reply, F.length("head")).alias("loss_start"),
        F.when(reply, F.length("body")).alias("loss_size"),
    )


def render(examples: DataFrame) -> DataFrame:
    """(conv_id, example, context, reply): each example in one row; for examples that are known to fit in memory."""
    cut = F.col("loss_start").cast("int")
    part = F.struct("place", F.when(cut.isNull(), F.col("chunk")).otherwise(F.substring("chunk", F.lit(1), cut)).alias("context"))
    reply = F.substring("chunk", cut + 1, F.col("loss_size").cast("int"))
    parts = examples.where("example IS NOT NULL").groupBy("conv_id", "example").agg(F.array_sort(F.collect_list(part)).alias("p"), F.max(reply).alias("reply"))
    return parts.select("conv_id", "example", F.array_join(F.col("p.context"), "").alias("context"), "reply")


def read_back(examples: DataFrame) -> DataFrame:
    """(conv_id, place, example, role, text, loss_text, size), read from the examples' chunks and spans alone."""
    loss = F.substring("chunk", (F.col("loss_start") + 1).cast("int"), F.col("loss_size").cast("int"))
    body = F.when(F.col("loss_start").isNull(), F.regexp_replace(F.regexp_replace("chunk", r"(?s)^### (?:[^\\:]++|\\.)*+: ", ""), r"</turn>\n\z", "")).otherwise(loss)
    return examples.select(
        "conv_id",
        "place",
        "example",
        unescaped(F.regexp_extract("chunk", r"(?s)^### ((?:[^\\:]++|\\.)*+): ", 1)).alias("role"),
        unescaped(body).alias("text"),
        unescaped(loss).alias("loss_text"),
        F.length("chunk").cast("long").alias("size"),
    )


def digests(examples: DataFrame) -> DataFrame:
    """One row per conversation with the digests of what its examples hold.

    A digest reads a conversation from front to end, so its rows pass through one task, sorted; they are hashed as
    they come and never gathered. A turn is hashed from the first example that holds it; its copies in the contexts of
    later examples must be equal, else the query fails.
    """
    kind = examples.schema["conv_id"].dataType.simpleString()
    fields = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long, example_chars long"
    names = [f.split()[0] for f in fields.split(", ")]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None

        def row(s: dict) -> tuple:
            return (s["id"], s["n"], s["turns"].hexdigest(), s["chars"], s["loss"].hexdigest(), s["size"], s["examples"], s["long"])

        def rows_of(batch: pa.RecordBatch) -> Iterator[tuple]:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                yield from zip(*[some.column(k).to_pylist() for k in range(7)])

        for batch in batches:
            done, last = [], batch.column(0).type
            for conv, place, example, role, text, loss, size in rows_of(batch):
                if now is None or now["id"] != conv:
                    if now is not None:
                        done.append(row(now))
                    now = {"id": conv, "n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "size": 0, "examples": 0, "long": 0, "turn": None}
                if place == now["n"]:
                    now["n"] += 1
                    now["turns"].update(f"{role}\n{text}\n".encode())
                    now["size"] += size + (0 if loss is None else len(_CLOSE))
                    now["turn"] = (role, text)
                elif (role, text) != now["turn"]:
                    raise ValueError(f"conversation {conv}, example {example}: turn {place} differs from earlier examples")
                if loss is not None:
                    now["loss"].update(loss.encode())
                    now["chars"] += len(loss)
                    now["examples"] += 1
                if example is not None:
                    now["long"] += size
            if done:
                yield batch_of(done, last)
        if now is not None:
            yield batch_of([row(now)], last)

    def batch_of(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*rows))
        types = [kind, *[pa.string() if n.endswith("sha256") else pa.int64() for n in names]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["conv_id", *names])

    rows = examples.repartition("conv_id").sortWithinPartitions("conv_id", "place", "example")
    return read_back(rows).mapInArrow(hashed, f"conv_id {kind}, {fields}")


#: The digests by SQL, from the turns themselves.
ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
f AS (
  SELECT *, length(role) + 14 + length(text) + length(regexp_replace(text, '[^\\#<]', '', 'g')) AS size FROM c),
g AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY turn) AS upto FROM f)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(size) AS BIGINT) AS formatted_chars, count(*) FILTER (role = 'assistant') AS n_examples,
       CAST(coalesce(sum(upto - 8) FILTER (role = 'assistant'), 0) AS BIGINT) AS example_chars
FROM g GROUP BY conv_id
"""
