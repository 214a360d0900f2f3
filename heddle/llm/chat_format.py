"""Chat formatting: one string per conversation with control marks for turns, and the spans that carry loss.

Turn structs are collected, sorted, and adjacent turns of one role merged into one marked turn; a mark
between the merged texts keeps them apart, so that the output can be read back without loss. Control
strings inside texts are broken up by an escape mark. Only Spark expressions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm.common import cut, let, pick, running_total, table

START, END, JOINT = "<|im_start|>", "<|im_end|>", "<|im_sep|>"
ESCAPE = "␛"
#: Strings that must not appear inside a text: this template's marks and those of other common templates.
CONTROLS = [START, END, JOINT, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
_JAVA_QUOTE = r"\Q{}\E"
_BREAK = "([<\\[])(?=" + "|".join(_JAVA_QUOTE.format(c[1:]) for c in CONTROLS) + ")"


def escape(text: Column) -> Column:
    """Every escape mark gets an ``e`` behind it, every control string a mark and ``c`` behind its first character."""
    marked = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "e"))
    return F.regexp_replace(marked, _BREAK, "$1" + ESCAPE + "c")


def unescape(text: Column) -> Column:
    whole = F.replace(text, F.lit(ESCAPE + "c"), F.lit(""))
    return F.replace(whole, F.lit(ESCAPE + "e"), F.lit(ESCAPE))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(ESCAPE + "n"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(ESCAPE + "n"), F.lit("\n")))


def format_chats(
    conversations: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    loss_role: str = "assistant",
) -> DataFrame:
    """Columns ``conv_col``, formatted (string), loss_spans (array of start and exclusive end, in code points).

    A turn is ``<|im_start|>role``, a line feed, the text, ``<|im_end|>`` and a line feed; texts of adjacent
    turns of one role share a turn with ``<|im_sep|>`` between them. Each text of ``loss_role`` is one span.

    Defined results: rows are ordered by turn, then role, then text, nulls first; repeated rows stay. A null
    text or role counts as empty. Rows with a null conversation id form one conversation. An empty table
    gives no rows. Other columns are ignored.
    """
    turn = F.struct(
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    rows = pick(conversations, conv=conv_col, turn=turn_col, role=role_col, text=text_col)
    collected = rows.groupBy("conv").agg(F.array_sort(F.collect_list(turn)).alias("turns"))

    def pieces(turns: Column) -> Column:
        def piece(t: Column, i: Column) -> Column:
            opens = (i == 0) | ~F.get(turns, i - 1)["role"].eqNullSafe(t["role"])
            closes = ~F.get(turns, i + 1)["role"].eqNullSafe(t["role"])
            return F.struct(
                F.when(opens, F.concat(F.lit(START), _escape_role(t["role"]), F.lit("\n"))).otherwise(JOINT).alias("head"),
                escape(t["text"]).alias("body"),
                F.when(closes, F.lit(END + "\n")).otherwise("").alias("tail"),
                (t["role"] == loss_role).alias("loss"),
            )

        return F.transform(turns, piece)

    def spans(ps: Column) -> Column:
        sizes = F.transform(ps, lambda p: (F.length(p["head"]) + F.length(p["body"]) + F.length(p["tail"])).cast("long"))
        placed = let(
            running_total(sizes),
            lambda starts: F.transform(
                ps,
                lambda p, i: F.struct(
                    (F.get(starts, i) + F.length(p["head"])).alias("start"),
                    (F.get(starts, i) + F.length(p["head"]) + F.length(p["body"])).alias("end"),
                    p["loss"].alias("loss"),
                ),
            ),
        )
        return F.transform(F.filter(placed, lambda s: s["loss"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))

    built = let(
        pieces(F.col("turns")),
        lambda ps: F.struct(
            F.array_join(F.transform(ps, lambda p: F.concat(p["head"], p["body"], p["tail"])), "").alias("formatted"),
            spans(ps).alias("loss_spans"),
        ),
    )
    return collected.select(F.col("conv").alias(conv_col), built.alias("built")).select(
        conv_col, F.col("built.formatted").alias("formatted"), F.col("built.loss_spans").alias("loss_spans")
    )


def read_turns(formatted: Column) -> Column:
    """The turns, an array of role and text, as read from a formatted string."""
    marked = F.split(formatted, _JAVA_QUOTE.format(END + "\n"))

    def turns_of(block: Column) -> Column:
        # the mark, the role up to the first line feed, then the texts
        role_end = F.call_function("instr", block, F.lit("\n"))
        role = F.substring(block, F.lit(len(START) + 1), role_end - len(START) - 1)
        body = F.substring(block, role_end + 1, F.length(block))
        return let(
            _unescape_role(role),
            lambda r: F.transform(
                F.split(body, _JAVA_QUOTE.format(JOINT)),
                lambda text: F.struct(r.alias("role"), unescape(text).alias("text")),
            ),
        )

    return let(marked, lambda blocks: F.flatten(F.transform(F.slice(blocks, F.lit(1), F.size(blocks) - 1), turns_of)))


def read_loss(formatted: Column, loss_spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(cut(formatted, loss_spans), unescape), "")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format all conversations and one more whose texts hold control strings; digests are read back from the output."""
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    chats = format_chats(given.unionByName(extra))
    read = chats.select(
        "conv_id",
        F.length("formatted").cast("long").alias("formatted_chars"),
        read_turns(F.col("formatted")).alias("turns"),
        read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"),
    )
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def _sql_escape(x: str) -> str:
    """The same escape in DuckDB: each control string is replaced by its broken form, one after the other."""
    x = f"replace({x}, '{ESCAPE}', '{ESCAPE}e')"
    for c in CONTROLS:
        x = f"replace({x}, '{c}', '{c[0]}{ESCAPE}c{c[1:]}')"
    return x


OP2_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
placed AS (
  SELECT *, row_number() OVER w AS i, lag(role) OVER w AS before, lead(role) OVER w AS after
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
marked AS (
  SELECT *, length({_sql_escape('text')})
    + CASE WHEN before IS DISTINCT FROM role THEN {len(START) + 1} + length(replace({_sql_escape('role')}, chr(10), '{ESCAPE}n')) ELSE {len(JOINT)} END
    + CASE WHEN after IS DISTINCT FROM role THEN {len(END) + 1} ELSE 0 END AS chars
  FROM placed)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""
