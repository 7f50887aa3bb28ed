"""Chat formatting by event-sourced reconstruction.

A log of events is partitioned by conversation, sorted by sequence and folded into final
messages, which are then rendered with a template that can be read back exactly.

Event kinds: ``message`` and ``edit`` set a message's text, ``regenerate`` discards what the
message had so far (its own text begins the new one), ``delta`` appends, ``delete`` removes the
message. Only events from the last non-delta one on count.

Defined results: null text is empty, null role is the empty role, null sequence sorts first,
null conversation ids form one conversation, equal sequences are taken in the order non-delta,
kind, text. Repeated rows are repeated events. Other columns are ignored. A conversation's text is one
value, because it is the product; it is gathered in chunks of turns first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TURN_OPEN = "<|im_start|>"
TURN_CLOSE = "<|im_end|>\n"
CHUNK_TURNS = 256


def escape(text: Column) -> Column:
    """Break every control string by a backslash after its first character; backslashes double."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.regexp_replace(text, r"<(\||/?s>|</?SYS>>)", "<\\\\$1")
    return F.regexp_replace(text, r"\[(/?INST\])", "[\\\\$1")


def unescape(text: Column) -> Column:
    """Inverse of ``escape``: a doubled backslash is one, a single one goes."""
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def fold_events(events: DataFrame) -> DataFrame:
    """events (conv_id, message_id, seq, kind, role, text) -> final messages
    (conv_id, message_id, first_seq, role, text)."""
    delta = F.col("kind") == "delta"
    own = Window.partitionBy("conv_id", "message_id")
    e = events.select(
        "conv_id", "message_id", "seq", F.coalesce("kind", F.lit("message")).alias("kind"),
        F.col("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    e = e.withColumn("n", F.row_number().over(own.orderBy(F.col("seq").asc_nulls_first(), delta, "kind", "text")))
    e = e.withColumn("reset", F.max(F.when(~delta, F.col("n"))).over(own))
    e = e.withColumn("first_seq", F.min("seq").over(own))
    e = e.withColumn("role", F.min_by(F.col("role"), F.when(F.col("role").isNotNull(), F.col("n"))).over(own))
    live = e.where(F.col("reset").isNull() | (F.col("n") >= F.col("reset")))
    parts = F.array_sort(F.collect_list(F.struct("n", "text")))
    m = live.groupBy("conv_id", "message_id").agg(
        F.first("first_seq").alias("first_seq"),
        F.first("role").alias("role"),
        F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("text"),
        F.min_by("kind", "n").alias("kind"),
    )
    return m.where(F.col("kind") != "delete").select(
        "conv_id", "message_id", "first_seq", F.coalesce("role", F.lit("")).alias("role"), "text"
    )


def render(messages: DataFrame, learn_role: str = "assistant", chunk_turns: int = CHUNK_TURNS) -> DataFrame:
    """messages -> one row per conversation: conv_id, n_turns, formatted, loss_mask.

    ``loss_mask`` is a run-length mask over ``formatted``: for each turn, how many code points
    are skipped, learned and skipped again. Only texts of ``learn_role`` are learned.
    """
    head = F.concat(F.lit(TURN_OPEN), F.url_encode("role"), F.lit("\n"))
    body = escape(F.col("text"))
    m = messages.select("conv_id", "message_id", "first_seq", "role", head.alias("head"), body.alias("body"))
    learned = F.col("role") == learn_role
    n_head, n_body = F.length("head").cast("long"), F.length("body").cast("long")
    m = m.select(
        "conv_id", "message_id", "first_seq",
        F.floor(F.col("first_seq") / chunk_turns).cast("long").alias("chunk"),
        F.concat("head", "body", F.lit(TURN_CLOSE)).alias("rendered"),
        F.struct(
            n_head.alias("skip"),
            F.when(learned, n_body).otherwise(0).alias("learn"),
            (F.when(learned, 0).otherwise(n_body) + len(TURN_CLOSE)).alias("rest"),
        ).alias("run"),
    )
    turns = F.array_sort(F.collect_list(F.struct("first_seq", "message_id", "rendered", "run")))
    c = m.groupBy("conv_id", "chunk").agg(turns.alias("t")).select(
        "conv_id", "chunk",
        F.array_join(F.transform("t", lambda x: x["rendered"]), "").alias("rendered"),
        F.transform("t", lambda x: x["run"]).alias("runs"),
    )
    g = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("chunk", "rendered", "runs"))).alias("c"))
    return g.select(
        "conv_id",
        F.array_join(F.transform("c", lambda x: x["rendered"]), "").alias("formatted"),
        F.flatten(F.transform("c", lambda x: x["runs"])).alias("loss_mask"),
    ).select("conv_id", F.size("loss_mask").cast("long").alias("n_turns"), "formatted", "loss_mask")


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse ``formatted`` again: adds turns (role, text) and loss_text, both unescaped."""
    segments = F.split("formatted", r"<\|im_end\|>\n", -1)
    f = formatted.withColumn("seg", F.slice(segments, F.lit(1), F.size(segments) - 1))

    def turn(s: Column) -> Column:
        first = F.substring_index(s, "\n", 1)
        return F.struct(
            F.url_decode(F.substr(first, F.lit(len(TURN_OPEN) + 1))).alias("role"),
            unescape(F.substr(s, F.length(first) + 2)).alias("text"),
        )

    masked = F.filter(F.arrays_zip("seg", "loss_mask"), lambda x: x["loss_mask"]["learn"] > 0)
    cut = F.transform(
        masked,
        lambda x: unescape(F.substr(x["seg"], (x["loss_mask"]["skip"] + 1).cast("int"), x["loss_mask"]["learn"].cast("int"))),
    )
    return f.withColumn("turns", F.transform("seg", turn)).withColumn("loss_text", F.array_join(cut, "")).drop("seg")


def turn_events(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as events: each row is a message of its own."""
    same = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    c = conversations.select("conv_id", F.col("turn").alias("seq"), "role", "text", "turn")
    return c.withColumn("copy", F.row_number().over(same)).select(
        "conv_id", F.struct("turn", "copy").alias("message_id"), "seq", F.lit("message").alias("kind"), "role", "text"
    )


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.sql(
        "SELECT -1L AS conv_id, t AS turn, r AS role, '</s>[INST] ok [/INST]' AS text "
        "FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(t, r)"
    )
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    back = read_back(render(fold_events(turn_events(rows.unionByName(own)))))
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(flat, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP1_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), shown AS (
  SELECT *, length(regexp_replace(regexp_replace(replace(text, chr(92), chr(92) || chr(92)),
    '<(\||/?s>|</?SYS>>)', '<\\\1', 'g'), '\[(/?INST\])', '[\\\1', 'g')) AS n_shown FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n_shown + length(role) + 24) AS BIGINT) AS formatted_chars
FROM shown GROUP BY conv_id
"""
