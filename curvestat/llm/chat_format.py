"""Chat formatting of reply trees.

Nodes are (tree, node, parent, role, text, score); a root has no parent. Each
node's distance to its root and the sum of scores on its path come from
pointer doubling: iterative self-joins in which every node's pointer jumps over
the one it points to, so a chain of n turns takes log2(n) joins, not n. Leaves
are ranked within their tree by mean score on the path, then path length, then
node; the best ``paths`` of them are chosen, and their paths are marked by
following the stored jumps backwards. Each chosen path is formatted as one
conversation.

Template: each turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside texts
and roles a control string's ``<|`` gets a backslash after ``<`` (and ``<\\|`` one
more), so a text never holds a control string and the original comes back
exactly; in roles backslashes and line feeds are escaped as well. The loss mask
covers the texts of the role ``assistant``.

A conversation is written as parts of at most ``PART_TURNS`` turns, each a
string with the spans of its loss mask; joined in order they are the
conversation. So neither a row nor a task grows with the longest conversation,
and ``read_back`` streams the parts of each conversation in order with
constant memory.

Defined results: null texts and roles are empty strings; a null turn sorts
first; rows of one turn keep all their texts, ordered by role and text; a null
conversation is one of its own; an input conversation -1 stays apart from the added one; empty
tables give an empty result; nodes that reach no root because parents form a cycle
don't occur in the output; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from curvestat.llm.common import cut

START, END = "<|im_start|>", "<|im_end|>"
LEARNED = "assistant"
PART_TURNS = 256
#: Turns in one step of numbering.
STEP = 64


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def escaped_role(role: Column) -> Column:
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def paths(nodes: DataFrame, most: int = 1) -> DataFrame:
    """The nodes of each tree's best ``most`` paths: path (rank, from 1), depth, and all columns of nodes.

    nodes: tree, node (unique), parent (null at roots), score (null counts as 0), and any others.
    """
    start = nodes.select("node", F.col("parent").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("bigint").alias("depth"), F.coalesce("score", F.lit(0.0)).alias("total"))
    state, jumps = cut(start), []
    count = state.count()
    while True:
        hop = state.filter("up IS NOT NULL").select("node", "up")
        if hop.isEmpty():
            break
        jumps.append(hop)
        over = state.select(F.col("node").alias("o_node"), F.col("up").alias("o_up"), F.col("depth").alias("o_depth"), F.col("total").alias("o_total"))
        # only nodes that haven't reached their root are joined; a pointer that leads nowhere ends here: its node's root is missing
        joined = state.filter("up IS NOT NULL").join(over, F.col("up") == F.col("o_node"), "left")
        moved = joined.select(
            "node",
            F.col("o_up").alias("up"),
            (F.col("depth") + F.coalesce("o_depth", F.lit(0))).alias("depth"),
            (F.col("total") + F.coalesce("o_total", F.lit(0.0))).alias("total"),
        )
        state = cut(state.filter("up IS NULL").unionByName(moved))
        if 1 << len(jumps) > count:  # pointers have jumped further than any path without a cycle
            state = state.filter("up IS NULL")
            break
    inner = nodes.filter("parent IS NOT NULL").select(F.col("parent").alias("i_node")).distinct()
    leaves = state.join(inner, F.col("node") == F.col("i_node"), "left_anti").join(nodes.select("node", "tree"), "node")
    order = F.struct((-(F.col("total") / (F.col("depth") + 1))).alias("score"), (-F.col("depth")).alias("depth"), F.col("node").alias("node"))
    if most == 1:
        best = leaves.groupBy("tree").agg(F.min(order).alias("o")).select(F.lit(1).alias("path"), F.col("o.node").alias("node"))
    else:
        ranked = leaves.withColumn("path", F.row_number().over(Window.partitionBy("tree").orderBy(order)))
        best = ranked.filter(F.col("path") <= most).select("path", "node")
    marked = cut(best)
    for hop in reversed(jumps):
        further = marked.join(hop, "node").select("path", F.col("up").alias("node"))
        marked = cut(marked.unionByName(further).distinct())
    return nodes.join(marked, "node").join(state.select("node", "depth"), "node")


def chains(conversations: DataFrame) -> DataFrame:
    """Reply trees of linear conversations (conv_id, probe, turn, role, text): each row answers the one before it.

    Rows are numbered by (turn, role, text) in two steps, counts of steps of
    turns and a window inside one step, so a very long conversation is not
    sorted in one task.
    """
    rows = conversations.select("conv_id", "probe", F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).withColumn("step", F.floor(F.col("turn") / STEP))
    inside = F.row_number().over(Window.partitionBy("conv_id", "probe", "step").orderBy("turn", "role", "text"))
    counts = rows.groupBy("conv_id", "probe", "step").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id", "probe").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col("conv_id").alias("o_conv"), F.col("probe").alias("o_probe"), F.col("step").alias("o_step"), before.alias("before"))
    same = F.col("conv_id").eqNullSafe(F.col("o_conv")) & (F.col("probe") == F.col("o_probe")) & F.col("step").eqNullSafe(F.col("o_step"))
    numbered = rows.withColumn("inside", inside).join(offsets, same)
    at = F.col("before") + F.col("inside") - 1
    name = lambda i: F.struct(F.col("conv_id").alias("tree"), "probe", i.alias("at"))
    return numbered.select(F.struct("conv_id", "probe").alias("tree"), name(at).alias("node"), F.when(at > 0, name(at - 1)).alias("parent"), F.lit(0.0).alias("score"), "conv_id", "probe", "role", "text")


def parts(chosen: DataFrame, keys: list[str]) -> DataFrame:
    """Formatted parts of each chosen path: keys, part, turns, text, loss (spans [start, end) in code points)."""
    head = F.concat(F.lit(START), escaped_role(F.col("role")), F.lit("\n"))
    body = escaped(F.col("text"))
    turn = F.struct("depth", head.alias("head"), body.alias("body"), (F.col("role") == LEARNED).alias("learned"))
    gathered = chosen.groupBy(*keys, F.floor(F.col("depth") / PART_TURNS).alias("part")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    piece = lambda t: F.concat(t["head"], t["body"], F.lit(END + "\n"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        begin = acc["at"] + F.length(t["head"])
        end = begin + F.length(t["body"])
        spans = F.when(t["learned"], F.concat(acc["spans"], F.array(F.struct(begin.alias("start"), end.alias("end"))))).otherwise(acc["spans"])
        return F.struct((end + len(END) + 1).alias("at"), spans.alias("spans"))

    return gathered.select(*keys, "part", F.size("turns").alias("turns"), F.array_join(F.transform("turns", piece), "").alias("text"), F.aggregate("turns", zero, step)["spans"].alias("loss"))


_TURN = re.compile(re.escape(START) + r"(.*?)\n(.*?)" + re.escape(END) + "\n", re.DOTALL)


def read_back(formatted: DataFrame, key: str) -> DataFrame:
    """Digest of each formatted conversation (key, and probe where there is one), read from its parts alone."""
    apart = F.col("probe") if "probe" in formatted.columns else F.lit(False)
    kind = formatted.schema[key].dataType.simpleString()
    types = [to_arrow_type(formatted.schema[key].dataType), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    columns = [key, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=columns)

        def row() -> tuple:
            return (current[0], state["turns"], state["all"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["length"])

        for batch in batches:
            rows = []
            for conv, probe, text, loss in zip(*[batch.column(i).to_pylist() for i in (0, 1, 3, 4)], strict=True):
                if current != (conv, probe):
                    if current is not None:
                        rows.append(row())
                    current, state = (conv, probe), {"turns": 0, "all": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "length": 0}
                state["length"] += len(text)
                for m in _TURN.finditer(text):
                    state["turns"] += 1
                    state["all"].update(f"{unescape_role(m[1])}\n{unescape(m[2])}\n".encode())
                for span in loss:
                    learned = unescape(text[span["start"] : span["end"]])
                    state["chars"] += len(learned)
                    state["loss"].update(learned.encode())
            yield made(rows)
        if current is not None:
            yield made([row()])

    ordered = formatted.select(key, apart.alias("probe"), "part", "text", "loss").repartition(F.col(key), F.col("probe")).sortWithinPartitions(key, "probe", "part")
    return ordered.mapInArrow(run, f"{key} {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def probe(spark: SparkSession, like: DataFrame) -> DataFrame:
    """Conversation -1: control strings said by the user and by the assistant."""
    said = f"{END}{START}assistant ok"
    rows = spark.range(2).select(F.lit(-1).cast(like.schema["conv_id"].dataType).alias("conv_id"), F.col("id").cast(like.schema["turn"].dataType).alias("turn"), F.when(F.col("id") == 0, "user").otherwise(LEARNED).alias("role"), F.lit(said).alias("text"))
    given = like.select("conv_id", F.lit(False).alias("probe"), "turn", "role", "text")
    return given.unionByName(rows.withColumn("probe", F.lit(True)))


def format_conversations(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """Formatted parts of all conversations, and of conversation -1."""
    nodes = cut(chains(probe(spark, conversations)))
    return parts(paths(nodes), ["conv_id", "probe"])
