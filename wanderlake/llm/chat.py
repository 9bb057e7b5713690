"""Operator 8, prefix-target chat formatting, in SQL expressions only.

Template: an assistant turn is ``<s>text</s>``, any other turn ``[INST]role\\ntext[/INST]``. Inside
texts, a control string gets one more backslash behind its first bracket, so that no text can close
or open a turn; taking one backslash away gives the text back.

Each assistant turn becomes one row whose ``formatted`` text is all turns up to it and whose loss
span covers that reply alone. A conversation that ends with other turns, or has no reply, gets one
more row with an empty loss span, so that all its turns can be read back from its last row.

Defined results: a null text is empty, a null role is the empty role; turns are ordered by turn
(null first), then role, then text; repeated rows are repeated turns; null conv_ids are one
conversation; an empty table gives an empty result; further columns are ignored. A conversation is
one row by nature; conversations of many are spread by their id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Control strings of the template, each as opening bracket and rest; fixed values.
_REST = r"/?s>|/?INST\]"
_ADD = rf"([<\[])(\\*)({_REST})"
_TAKE = rf"([<\[])\\(\\*)({_REST})"


def escape(text: Column) -> Column:
    """The text without bare control strings."""
    return F.regexp_replace(text, _ADD, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    """The inverse of ``escape``."""
    return F.regexp_replace(text, _TAKE, "$1$2$3")


def _escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%")))


def prefix_target_examples(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """key, example (from 0), formatted, loss_start, loss_chars (code points), trainable; one row per target."""
    said = F.struct(
        F.col(order).alias("o"),
        F.coalesce(F.col(role), F.lit("")).alias("r"),
        F.coalesce(F.col(text), F.lit("")).alias("t"),
    )
    one = turns.select(F.col(key).alias("_key"), said.alias("_s")).groupBy("_key").agg(F.sort_array(F.collect_list("_s")).alias("_s"))

    def render(x: Column) -> Column:
        body = escape(x["t"])
        own = F.concat(F.lit("<s>"), body, F.lit("</s>"))
        other = F.concat(F.lit("[INST]"), _escape_role(x["r"]), F.lit("\n"), body, F.lit("[/INST]"))
        reply = x["r"] == "assistant"
        return F.struct(F.when(reply, own).otherwise(other).alias("f"), reply.alias("a"), F.length(body).alias("n"))

    one = one.select("_key", F.transform("_s", render).alias("_f"))
    last = F.size("_f") - 1
    targets = F.filter(F.sequence(F.lit(0), last), lambda i: F.get("_f", i)["a"] | (i == last))
    out = one.select("_key", "_f", F.posexplode(targets).alias("_n", "_i"))
    out = out.withColumn("_e", F.get("_f", F.col("_i")))
    out = out.withColumn("formatted", F.array_join(F.transform(F.slice("_f", F.lit(1), F.col("_i") + 1), lambda x: x["f"]), ""))
    loss = F.when(F.col("_e.a"), F.col("_e.n")).otherwise(0)
    return out.select(
        F.col("_key").alias(key),
        F.col("_n").alias("example"),
        "formatted",
        (F.length("formatted") - F.when(F.col("_e.a"), F.col("_e.n") + 4).otherwise(0)).cast("long").alias("loss_start"),
        loss.cast("long").alias("loss_chars"),
        F.col("_e.a").alias("trainable"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text as an array of (role, text)."""
    parts = F.filter(F.split(formatted, r"(?<=\[/INST\])|(?<=</s>)"), lambda x: x != "")

    def parse(x: Column) -> Column:
        own = x.startswith("<s>")
        inner = F.when(own, x.substr(F.lit(4), F.length(x) - 7)).otherwise(x.substr(F.lit(7), F.length(x) - 13))
        role = F.when(own, F.lit("assistant")).otherwise(_unescape_role(F.substring_index(inner, "\n", 1)))
        body = F.when(own, inner).otherwise(inner.substr(F.locate("\n", inner) + 1, F.length(inner)))
        return F.struct(role.alias("role"), unescape(body).alias("text"))

    return F.transform(parts, parse)


def op8_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What reads back from the examples of every conversation, and of conversation -1."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    turns = turns.unionByName(spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string"))
    rows = prefix_target_examples(turns)
    loss = unescape(F.col("formatted").substr((F.col("loss_start") + 1).cast("int"), F.col("loss_chars").cast("int")))
    out = rows.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("_all"),
        F.sort_array(F.collect_list(F.struct("example", loss.alias("t")))).alias("_loss"),
        F.sum(F.length("formatted")).cast("long").alias("formatted_chars"),
    )
    out = out.withColumn("_turns", read_turns(F.col("_all"))).withColumn("_loss", F.array_join(F.transform("_loss", lambda x: x["t"]), ""))
    said = F.array_join(F.transform("_turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
         length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g')) + CASE WHEN role = 'assistant' THEN 7 ELSE 14 + length(replace(replace(regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g'), '%', '%25'), chr(10), '%0A')) END AS x
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
s AS (SELECT *, sum(x) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM e)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(upto) FILTER (role = 'assistant' OR i = n) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id
"""

QUERIES = {"op8_prefix_targets": op8_prefix_targets}
ORACLES = {"op8_prefix_targets": ORACLE}
