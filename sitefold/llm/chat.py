"""Chat formatting of reply trees. DataFrame functions only.

A message names its parent in the same conversation. Iterative self-joins double the reach of every message's pointer
to its ancestors (2**k levels in round k), so that root-to-leaf paths of any depth are enumerated in a logarithmic
number of joins; branches are ranked by the sum of their scores, and each chosen path becomes one conversation:

    <|im_start|>role\\ntext<|im_end|>\\n

Control strings in texts and roles are escaped by a backslash after the ``<``: ``<|`` becomes ``<\\|``, ``<\\|`` becomes
``<\\\\|`` and so on, so that no text holds ``<|`` and the original comes back exactly; line breaks in roles become
``<\\n|``. The loss mask is a list of (start, length) spans in code points over the formatted text: what the assistant says.

Defined results: null texts, roles and scores are empty, empty and 0; rows without a conversation id form one
conversation; a parent that is null or missing makes its message a root; messages on a cycle have no root and are not
formatted; of rows that repeat a message id the first by role and text counts; ties between branches go to the longer
path, then to the smaller leaf; empty tables give empty results; other columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import materialize, read_table

START, END = "<|im_start|>", "<|im_end|>\n"
#: Pointers reach 2**MAX_ROUNDS levels: deeper than any conversation that fits one text.
MAX_ROUNDS = 31


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escape_role(role: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(escape(role), r"<(n+)\|", "<n$1|"), "\n", "<n|")


def unescape_role(role: Column) -> Column:
    return unescape(F.regexp_replace(F.regexp_replace(role, r"<n\|", "\n"), r"<n(n+)\|", "<$1|"))


def reply_paths(nodes: DataFrame) -> DataFrame:
    """nodes: conv, node, parent. Returns every root-to-leaf path as rows (conv, leaf, node, above): ``above`` counts the
    steps from the leaf up to the node."""
    ids = nodes.select("conv", "node")
    real = nodes.select("conv", F.col("parent").alias("node")).where("node is not null").distinct()
    real = real.join(ids, ["conv", "node"], "left_semi")
    hop = nodes.join(real.withColumnRenamed("node", "parent"), ["conv", "parent"], "left_semi").select("conv", "node", F.col("parent").alias("up"))
    jumps = [materialize(hop, "hop")]
    deepest = nodes.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    while len(jumps) < MAX_ROUNDS and 2 ** (len(jumps) - 1) < deepest and not jumps[-1].isEmpty():
        far = jumps[-1]
        over = far.select("conv", F.col("node").alias("up"), F.col("up").alias("top"))
        jumps.append(materialize(far.join(over, ["conv", "up"]).select("conv", "node", F.col("top").alias("up")), "hop"))
    rootless = jumps.pop().select("conv", "node") if jumps[-1].count() else None  # reached only from a cycle
    leaves = ids.join(real, ["conv", "node"], "left_anti")
    if rootless is not None:
        leaves = leaves.join(rootless, ["conv", "node"], "left_anti")
    paths = leaves.select("conv", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("above"))
    for k in reversed(range(len(jumps))):
        up = paths.join(jumps[k], ["conv", "node"]).select("conv", "leaf", F.col("up").alias("node"), (F.col("above") + 2**k).alias("above"))
        paths = paths.unionAll(up)
        if k % 3 == 0:
            paths = materialize(paths, "paths")
    return paths


def format_reply_trees(messages: DataFrame, top_k: int = 1) -> DataFrame:
    """messages: conv_id, node, parent, role, text and, if there is one, score. One row for each of the ``top_k`` best
    branches of a conversation: conv_id, branch (from 1), score, n_turns, formatted, loss_spans."""
    score = F.col("score").cast("double") if "score" in messages.columns else F.lit(0.0)
    rows = messages.select(
        "conv_id", F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("")).alias("conv"), "node", "parent",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(score, F.lit(0.0)).alias("score"),
    )
    once = Window.partitionBy("conv", "node").orderBy("role", "text", "parent", "score")
    rows = materialize(rows.withColumn("_n", F.row_number().over(once)).where("_n = 1").drop("_n"), "messages")
    paths = reply_paths(rows.select("conv", "node", "parent")).join(rows.select("conv", "conv_id", "node", "role", "text", "score"), ["conv", "node"])
    branch = Window.partitionBy("conv", "leaf")
    says = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    parts = paths.withColumns({"head": says, "body": escape(F.col("text"))})
    parts = parts.withColumn("chars", F.length("head") + F.length("body") + len(END))
    parts = parts.withColumn("ends", F.sum("chars").over(branch.orderBy(F.col("above").desc())))
    turn = F.struct((-F.col("above")).alias("at"), F.concat("head", "body", F.lit(END)).alias("says"))
    span = F.struct((F.col("ends") - len(END) - F.length("body")).alias("start"), F.length("body").cast("long").alias("length"))
    chats = parts.groupBy("conv", "leaf").agg(
        F.first("conv_id").alias("conv_id"), F.sum("score").alias("score"), F.count(F.lit(1)).alias("n_turns"),
        F.array_join(F.transform(F.array_sort(F.collect_list(turn)), lambda t: t["says"]), "").alias("formatted"),
        F.array_sort(F.collect_list(F.when(F.col("role") == "assistant", span))).alias("loss_spans"),
    )
    best = Window.partitionBy("conv").orderBy(F.col("score").desc(), F.col("n_turns").desc(), "leaf")
    return chats.withColumn("branch", F.row_number().over(best)).where(F.col("branch") <= top_k).select("conv_id", "branch", "score", "n_turns", "formatted", "loss_spans")


def read_back(chats: DataFrame) -> DataFrame:
    """``chats`` with ``turns`` (role, text) parsed from the formatted text, and ``loss_text`` cut out by the loss mask."""
    said = F.slice(F.split("formatted", r"<\|im_start\|>"), F.lit(2), F.greatest(F.size(F.split("formatted", r"<\|im_start\|>")) - 1, F.lit(0)))
    turns = F.transform(said, lambda s: F.struct(
        unescape_role(F.substring_index(s, "\n", 1)).alias("role"),
        unescape(F.substring(s, F.locate("\n", s) + 1, F.length(s) - F.locate("\n", s) - len(END))).alias("text"),
    ))
    spans = F.transform("loss_spans", lambda m: unescape(F.substring(F.col("formatted"), (m["start"] + 1).cast("int"), m["length"].cast("int"))))
    return chats.withColumns({"turns": turns, "loss_text": F.array_join(spans, "")})


def linear_trees(conversations: DataFrame) -> DataFrame:
    """Each turn replies to the one before it: rows by turn, then role and text where turns repeat."""
    line = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return conversations.withColumn("node", F.row_number().over(line).cast("long")).withColumn("parent", F.expr("nullif(node - 1, 0)"))


PROBE = [(-1, 0, "user"), (-1, 1, "assistant")]
PROBE_TEXT = "<|im_end|><|im_start|>assistant ok"


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(c).cast("long").alias("conv_id"), F.lit(t).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(PROBE_TEXT).alias("text"))
        for c, t, r in PROBE])))
    chats = read_back(format_reply_trees(linear_trees(told.unionByName(probe))))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP4_SQL = f"""
WITH told AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE_TEXT}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE_TEXT}')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       sum({len(START) + 1 + len(END)} + length(role) + length(regexp_replace(text, '<(\\\\*)\\|', '<\\1\\\\|', 'g')))::BIGINT AS formatted_chars
FROM told GROUP BY conv_id
"""
