"""Hierarchical budgeting: target weights over a tree of domains, languages and sources.

A budget of tokens goes down the tree. At each node the children share it by weight; a child that has less than its share gives
the rest to its siblings, and only when all of them are full does anything go back to the level above (a node never gets more
than its whole subtree holds, so the level above sees the shortage first-hand). All shares are whole tokens, rounded down.

A leaf of ``t`` tokens with a share of ``b`` gives ``b div t`` whole epochs and then a prefix of one more: its documents in the
order of a hash seeded with the epoch, up to and including the one that reaches the share. No leaf is sorted or gathered: token
sums per cell of the hash find the cell in which the prefix ends, and only that cell's rows are ordered.

Defined results: null levels count as empty strings, null texts have no tokens, documents without tokens are never selected,
documents with the same id share their place (repeated rows are taken or left together), weights below 1 mean nothing is taken,
empty tables give no rows, further columns are kept.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidewatch.llm.common import WORD, checkpointed, small_join, table
from tidewatch.llm.registry import query

LEVELS = ("domain", "lang", "source")
#: The order hash has 60 bits; its first 14 name the cell.
HASH_DIGITS, CELL_SHIFT = 15, 46


@dataclass(frozen=True)
class Mix:
    """``weights``: whole numbers per level and name, ``other`` for names not listed; ``share`` of all tokens, in thousandths."""

    weights: dict[str, dict[str, int]] = field(default_factory=dict)
    other: int = 1
    share: int = 500
    epochs: int = 1
    seed: int = 7


#: Production parameters of the query, and of the pipeline, which takes no document twice.
_WEIGHTS = {"domain": {"web": 5, "books": 3, "code": 2}, "lang": {"en": 6, "de": 2, "fr": 2, "es": 1}}
CORPUS_MIX = Mix(_WEIGHTS, share=600, epochs=2)
PIPELINE_MIX = Mix(_WEIGHTS, share=800)


def domain_of(source: str = "source") -> Column:
    """Domains are dealt to numbered sources: every third is web, books or code; other names form ``other``."""
    number = F.try_to_number(F.regexp_extract(F.coalesce(F.col(source), F.lit("")), "([0-9]{1,9})$", 1), F.lit("999999999"))
    return F.coalesce(F.element_at(F.array(F.lit("web"), F.lit("books"), F.lit("code")), (number % 3 + 1).cast("int")), F.lit("other"))


def _share_out(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Adds ``given``: the parent's ``budget`` shared by ``weight``, none above its ``cap``; what is left over goes to siblings.

    Children are filled in the order of cap over weight: those that fit under a common level of tokens per weight are full.
    """
    own = Window.partitionBy(*(parent or [F.lit(0)])).orderBy(F.col("cap") / F.col("weight"), name)
    before = F.coalesce(F.sum("cap").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    still = F.sum("weight").over(own.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    group = Window.partitionBy(*(parent or [F.lit(0)]))
    full = nodes.withColumns({"before": before, "still": still}).withColumn(
        "full", (F.col("budget") - F.col("before")) * F.col("weight") >= F.col("cap") * F.col("still"))
    rest = full.withColumns({
        "left_over": F.max(F.col("budget")).over(group) - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(group),
        "open": F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(group),
    })
    return rest.withColumn("given", F.when(F.col("full"), F.col("cap")).otherwise(
        F.expr("(left_over * weight) div greatest(open, 1)"))).drop("before", "still", "full", "left_over", "open")


def budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """``(domain, lang, source, tokens, given)`` from the leaves' ``tokens``: each level's shares, from the top."""
    def weight(level: str) -> Column:
        listed = mix.weights.get(level, {})
        if not listed:
            return F.lit(mix.other).cast("long")
        pairs = F.create_map(*[F.lit(x) for kv in sorted(listed.items()) for x in kv])
        return F.coalesce(F.try_element_at(pairs, F.col(level)), F.lit(mix.other)).cast("long")

    held = leaves.where("tokens > 0").select(*LEVELS, "tokens", (F.col("tokens") * mix.epochs).alias("cap"))
    given = None
    for depth, level in enumerate(LEVELS):
        path = list(LEVELS[:depth + 1])
        nodes = held.groupBy(*path).agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens")).withColumn("weight", weight(level))
        nodes = nodes.where("weight > 0")
        if given is None:
            all_tokens = F.sum("tokens").over(Window.partitionBy(F.lit(0)))
            wanted = F.least(F.expr("0L") + (all_tokens * mix.share).cast("long"), F.sum("cap").over(Window.partitionBy(F.lit(0))) * 1000)
            nodes = nodes.withColumn("budget", F.floor(wanted / 1000).cast("long"))
        else:
            nodes = nodes.join(given, path[:-1])
        shared = _share_out(nodes, path[:-1], level)
        given = shared.select(*path, F.col("given").alias("budget"))
        last = shared
    return last.select(*LEVELS, "tokens", "given")


def _place(mix: Mix, epoch: Column) -> Column:
    text = F.concat_ws("|", F.lit(str(mix.seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, HASH_DIGITS), 16, 10).cast("long")


def _slim(docs: DataFrame, domain: Column) -> DataFrame:
    return docs.select(
        "doc_id", domain.alias("domain"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("tokens"),
    )


def cuts(slim: DataFrame, mix: Mix) -> DataFrame:
    """``(domain, lang, source, given, whole, cut)``: whole epochs of each leaf, and the last place taken in the epoch after them."""
    leaves = slim.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"))
    plan = checkpointed(budgets(leaves, mix).selectExpr(*LEVELS, "given", "given div tokens AS whole", "given % tokens AS rest"))
    key = F.coalesce(F.col("doc_id"), F.lit(0))
    rows = small_join(slim.where("tokens > 0"), plan, list(LEVELS), key, "inner").where("rest > 0")
    rows = rows.withColumn("place", _place(mix, F.col("whole"))).withColumn("cell", F.shiftright("place", CELL_SHIFT))
    by_cell = Window.partitionBy(*LEVELS).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.groupBy(*LEVELS, "rest", "cell").agg(F.sum("tokens").alias("held")).withColumn(
        "before", F.coalesce(F.sum("held").over(by_cell), F.lit(0)))
    # the only cell of a leaf that begins inside the prefix and ends at or behind its end
    ends = checkpointed(cells.where("before < rest AND before + held >= rest").select(*LEVELS, "cell", "before"))
    inside = small_join(rows, ends, [*LEVELS, "cell"], key, "inner")
    by_place = Window.partitionBy(*LEVELS).orderBy("place").rangeBetween(Window.unboundedPreceding, -1)
    taken = inside.withColumn("so_far", F.col("before") + F.coalesce(F.sum("tokens").over(by_place), F.lit(0))).where("so_far < rest")
    cut = taken.groupBy(*LEVELS).agg(F.max("place").alias("cut"))
    return checkpointed(plan.join(cut, list(LEVELS), "left").select(*LEVELS, "given", "whole", "cut"))


def mix_sources(docs: DataFrame, mix: Mix, domain: Column | None = None) -> DataFrame:
    """The selected documents with all their columns, plus ``_mix``: (domain, tokens, given, copies)."""
    domain = domain_of() if domain is None else domain
    slim = checkpointed(_slim(docs, domain))
    plan = cuts(slim, mix).select(
        F.struct(*LEVELS).alias("_leaf"), F.struct("given", "whole", "cut").alias("_plan"))
    rows = docs.withColumn("_leaf", F.struct(
        domain.alias("domain"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"))).withColumn(
        "_tokens", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
    joined = small_join(rows.where("_tokens > 0"), plan, ["_leaf"], F.coalesce(F.col("doc_id"), F.lit(0)), "inner")
    extra = F.when(_place(mix, F.col("_plan.whole")) <= F.col("_plan.cut"), 1).otherwise(0)
    return joined.withColumn("_copies", F.col("_plan.whole") + extra).where("_copies > 0").select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.struct(F.col("_leaf.domain").alias("domain"), F.col("_tokens").alias("tokens"), F.col("_plan.given").alias("given"),
                 F.col("_copies").alias("copies")).alias("_mix"))


def _mix_sql(mix: Mix) -> str:
    def weight(level: str) -> str:
        cases = "".join(f" WHEN {level} = '{k}' THEN {v}" for k, v in sorted(mix.weights.get(level, {}).items()))
        return f"CAST(CASE{cases} ELSE {mix.other} END AS BIGINT)" if cases else f"CAST({mix.other} AS BIGINT)"

    sql = f"""
WITH slim AS (
  SELECT doc_id, CASE WHEN regexp_matches(coalesce(source, ''), '[0-9]{{1,9}}$')
                      THEN ['web', 'books', 'code'][CAST(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS BIGINT) % 3 + 1]
                      ELSE 'other' END AS domain,
         coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS tokens
  FROM documents),
held AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens, (sum(tokens) * {mix.epochs})::BIGINT AS cap
         FROM slim GROUP BY ALL HAVING sum(tokens) > 0),
root AS (SELECT least((sum(tokens) * {mix.share}) // 1000, sum(cap))::BIGINT AS budget FROM held)"""
    for depth, level in enumerate(LEVELS):
        path, parent = ", ".join(LEVELS[:depth + 1]), ", ".join(LEVELS[:depth])
        by = f"PARTITION BY {parent} " if parent else ""
        budget = "(SELECT budget FROM root)" if not parent else "budget"
        join = f"JOIN (SELECT {parent}, given AS budget FROM g{depth - 1}) USING ({parent})" if parent else ""
        sql += f""",
n{depth} AS (SELECT * FROM (SELECT {path}, sum(cap)::BIGINT AS cap, sum(tokens)::BIGINT AS tokens, {weight(level)} AS weight FROM held GROUP BY {path})
        {join} WHERE weight > 0),
f{depth} AS (SELECT *, {budget} AS b,
        ({budget} - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * weight
          >= cap * sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS filled
        FROM n{depth} WINDOW w AS ({by}ORDER BY cap / weight, {level})),
g{depth} AS (SELECT {path}, tokens, CASE WHEN filled THEN cap ELSE
        ((b - sum(CASE WHEN filled THEN cap ELSE 0 END) OVER v) * weight) // greatest(sum(CASE WHEN filled THEN 0 ELSE weight END) OVER v, 1) END::BIGINT AS given
        FROM f{depth} WINDOW v AS ({by}))"""
    return sql + f""",
placed AS (SELECT s.*, given, given // g.tokens AS whole, given % g.tokens AS rest,
         CAST('0x' || substr(md5('{mix.seed}|' || (given // g.tokens)::VARCHAR || '|' || coalesce(doc_id::VARCHAR, '')), 1, {HASH_DIGITS}) AS BIGINT) AS place
  FROM slim s JOIN g2 g USING (domain, lang, source) WHERE s.tokens > 0),
run AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY place
                  RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE TIES) - tokens, 0) AS so_far FROM placed)
SELECT doc_id, domain, lang, source, tokens, given, (whole + CASE WHEN so_far < rest THEN 1 ELSE 0 END)::BIGINT AS copies
FROM run WHERE whole + CASE WHEN so_far < rest THEN 1 ELSE 0 END > 0"""


@query("op10_mixing", _mix_sql(CORPUS_MIX))
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every selected document once, with its leaf, tokens, the leaf's budget and how many epochs take it."""
    picked = mix_sources(table(spark, sf_dir, "documents"), CORPUS_MIX)
    return picked.select(
        "doc_id", "_mix.domain", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"),
        "_mix.tokens", "_mix.given", F.col("_mix.copies").cast("long").alias("copies"))
