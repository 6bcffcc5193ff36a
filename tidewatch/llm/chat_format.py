"""Chat formatting with Spark expressions only.

A conversation's rows are collected as structs and sorted, adjacent rows of one role become one block, and the blocks are
concatenated. Control strings inside roles and texts are escaped by a backslash behind their first character, which the
reader takes out again, so the original rows can be read back from the formatted string alone.

The loss mask is a run-length list ``runs`` of (mark_chars, chars, loss) over the formatted string: a mark, then the characters
up to the next mark and whether they count. The runs add up to the string's length.

Defined results: a null role or text counts as empty; rows are ordered by turn (nulls first), then role, then text, so ties
and repeated rows keep one place each and none is dropped; rows with a null conversation id form one conversation; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewatch.llm.common import table
from tidewatch.llm.registry import query

START, SEP, NEXT, END = "<|im_start|>", "<|im_sep|>", "<|im_next|>", "<|im_end|>"
#: Strings that mean something to this template or to others a model may have been trained with.
CONTROLS = (START, SEP, NEXT, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]")
_TAILS = "|".join(re.escape(c[1:]) for c in CONTROLS)
_FIRST = r"([<\[])"
_MARK = "|".join(re.escape(m) for m in (START, SEP, NEXT, END))


def escape(text: Column) -> Column:
    """Control strings, also those with backslashes behind the first character, get one backslash more there."""
    return F.regexp_replace(text, rf"{_FIRST}(\\*)(?={_TAILS})", r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"{_FIRST}\\(\\*)(?={_TAILS})", r"$1$2")


def format_conversations(rows: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """``(conv_id, formatted, runs)``: one string per conversation and its loss mask."""
    turn = F.struct(
        "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    sorted_rows = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("rows"))

    def piece(row: Column, i: Column) -> Column:
        # a row opens a block unless the one before has its role
        return F.struct(
            ((i > 0) & (F.get(F.col("rows"), i - 1)["role"] == row["role"])).alias("merged"), (i == 0).alias("first"),
            escape(row["role"]).alias("role"), escape(row["text"]).alias("body"), (row["role"] == loss_role).alias("loss"),
        )

    def lead(p: Column) -> Column:
        opening = F.concat(F.when(p["first"], F.lit("")).otherwise(F.lit(END)), F.lit(START), p["role"], F.lit(SEP))
        return F.when(p["merged"], F.lit(NEXT)).otherwise(opening)

    def run(mark: str, part: Column, loss: Column) -> Column:
        return F.struct(
            F.lit(len(mark)).alias("mark_chars"), F.length(part).alias("chars"), loss.alias("loss"))

    none, no = F.lit(""), F.lit(False)

    def runs_of(p: Column) -> Column:
        opening = F.array(run(START, p["role"], no), run(SEP, p["body"], p["loss"]))
        return F.when(p["merged"], F.array(run(NEXT, p["body"], p["loss"]))).when(p["first"], opening).otherwise(
            F.concat(F.array(run(END, none, no)), opening))

    pieces = sorted_rows.select("conv_id", F.transform("rows", piece).alias("pieces"))
    return pieces.select(
        "conv_id",
        F.concat(F.array_join(F.transform("pieces", lambda p: F.concat(lead(p), p["body"])), ""), F.lit(END)).alias("formatted"),
        F.concat(F.flatten(F.transform("pieces", runs_of)), F.array(run(END, none, no))).alias("runs"),
    )


def read_formatted(formatted: DataFrame) -> DataFrame:
    """``(conv_id, turns, masked, formatted_chars)`` read back from the strings and their masks.

    ``turns`` has a (role, text) for every original row, ``masked`` the unescaped text under the loss mask. A mask that does
    not fit its string is an error.
    """
    blocks = F.filter(F.split("formatted", re.escape(END)), lambda b: b != "")

    def rows_of(block: Column) -> Column:
        parts = F.split(block, re.escape(SEP), 2)
        role = unescape(F.substring(parts[0], len(START) + 1, 2_000_000_000))
        return F.transform(F.split(parts[1], re.escape(NEXT)), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    # what stands behind each mark, in order: as many as runs
    parts = F.slice(F.split("formatted", _MARK, -1), F.lit(2), F.size("runs"))
    cut = formatted.select(
        "conv_id", F.flatten(F.transform(blocks, rows_of)).alias("turns"), F.length("formatted").cast("long").alias("formatted_chars"),
        F.arrays_zip(parts.alias("part"), F.col("runs").alias("run")).alias("parts"),
    )
    covered = F.transform(F.filter("parts", lambda p: p["run"]["loss"]), lambda p: unescape(p["part"]))
    fits = F.forall("parts", lambda p: F.length(p["part"]) == p["run"]["chars"])
    return cut.select(
        "conv_id", "turns", "formatted_chars",
        F.when(fits, F.array_join(covered, "")).otherwise(F.raise_error(F.lit("the loss mask does not fit the string"))).alias("masked"),
    )


PROBE = "</s>[INST] ok [/INST]"


def with_probe(rows: DataFrame) -> DataFrame:
    """The rows plus conversation -1, whose texts are made of control strings."""
    extra = rows.sparkSession.createDataFrame(
        [(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return rows.select("conv_id", "turn", "role", "text").unionByName(extra)


def _escape_sql(column: str) -> str:
    return rf"regexp_replace({column}, '([<\[])(\\*)({_TAILS})', '\1\\\2\3', 'g')"


_SQL = f"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'),
s AS (SELECT *, lag(role) OVER w AS prev, row_number() OVER w AS i, length({_escape_sql('role')}) AS er, length({_escape_sql('text')}) AS et
      FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (sum(CASE WHEN role = prev THEN {len(NEXT)} + et
                 ELSE CASE WHEN i > 1 THEN {len(END)} ELSE 0 END + {len(START) + len(SEP)} + er + et END) + {len(END)})::BIGINT AS formatted_chars
FROM s GROUP BY conv_id"""


@query("op8_chat_format", _SQL)
def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, read back from its formatted string and loss mask."""
    read = read_formatted(format_conversations(with_probe(table(spark, sf_dir, "conversations"))))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
        F.length("masked").cast("long").alias("loss_chars"), F.sha2(F.col("masked"), 256).alias("loss_sha256"), "formatted_chars",
    )
