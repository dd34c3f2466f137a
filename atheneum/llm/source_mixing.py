"""Mixing sources to target weights by iterative proportional fitting.

Token counts are summed into cells of source, language and topic. Raking multiplies the cells' weights in turn so
that the marginal sums over sources, languages and topics meet their targets, again and again until all do to within TOLERANCE
of a target. Where targets contradict each other, it ends when the weights stand still, or after MAX_ROUNDS; the largest relative
error that is left is in the plan as ``residual`` and in a warning. A document's inclusion probability is proportional to its cell's raked weight over the tokens the cell has, cut at 1; the
budget cut off there is given to the other cells in a few further rounds. A document is drawn if a hash of its id,
read as a number in [0, 1), lies below its probability, so that a run repeated on other machines draws the same rows.

Everything is DataFrame functions. Cells are as many as there are combinations of the three marginals, far fewer than
documents. Up to ``MAX_BROADCAST_CELLS`` of them, by count, are raked in one partition, where no round has to shuffle; more stay distributed. Documents are read once to count tokens
and once to be drawn.

Tokens and topics may be given as expressions over the documents, a tokenizer's counts say; words and a topic by the text's form are the defaults.

Cases: null sources, languages and texts count as ``(none)``, ``(none)`` and no tokens; a document without tokens weighs
nothing and is drawn with its cell's probability; a marginal value without a target keeps its own share; repeated
rows share their fate; an empty table gives an empty result; ``mixed`` returns all columns as they are, whatever their names.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import shared_dir

MARGINALS = ("mix_source", "mix_lang", "mix_topic")
ROUNDS, CAP_ROUNDS = 8, 4
#: Raking ends when each marginal sum is this near to its target, relatively; else when a round moves less than STILL of all weight.
TOLERANCE, STILL, MAX_ROUNDS = 1e-6, 1e-12, 1_000
#: Raking also ends when ``rounds`` more have changed the largest error by no more than this share of it.
STILL_RESIDUAL = 1e-6
#: Default targets are the marginal's own token shares to this power: below 1, large sources give way to small ones.
SMOOTHING = {"mix_source": 0.7, "mix_lang": 0.8, "mix_topic": 0.9}
NONE = "(none)"
MAX_BROADCAST_CELLS = 50_000


def n_words(text: Column) -> Column:
    """Runs without ASCII white space, the measure of tokens here."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def topic(text: Column) -> Column:
    """A coarse topic by the form of a text: contact data, links, tables, short lines, prose."""
    t = F.coalesce(text, F.lit(""))
    return (
        F.when(t.contains("@"), "contact")
        .when(t.contains("http"), "links")
        .when(t.contains(" | "), "table")
        .when(F.octet_length(t) < 60 * F.size(F.split(t, "\n")), "short_lines")
        .otherwise("prose")
    )


def measured(docs: DataFrame, text_col: str = "text", tokens: Column | None = None, topics: Column | None = None) -> DataFrame:
    """(given, marginals, mix_tokens) of each document, ``given`` holding its own columns; null tokens count as none, a null topic as ``(none)``."""
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("given"),
        F.coalesce(F.col("source").cast("string"), F.lit(NONE)).alias("mix_source"),
        F.coalesce(F.col("lang").cast("string"), F.lit(NONE)).alias("mix_lang"),
        F.coalesce((topic(F.col(text_col)) if topics is None else topics).cast("string"), F.lit(NONE)).alias("mix_topic"),
        F.coalesce((n_words(F.col(text_col)) if tokens is None else tokens).cast("long"), F.lit(0).cast("long")).alias("mix_tokens"),
    )


def with_targets(cells: DataFrame, marginal: str, given: Mapping[str, float] | None = None) -> DataFrame:
    """``cells`` with ``<marginal>_share`` added: the given weights, or the smoothed shares of the tokens, scaled to a sum of 1
    over the values there are. Sums over all cells are aggregates, so that no task holds them all."""
    values = cells.groupBy(marginal).agg(F.sum("tokens").alias("tokens"))
    total = values.agg(F.sum("tokens")).first()[0] or 0
    own = F.col("tokens") / F.lit(float(total)) if total else F.lit(0.0)
    weight = F.pow(own, F.lit(SMOOTHING[marginal]))
    if given is not None:
        named = F.create_map(*[F.lit(x) for name, share in given.items() for x in (name, float(share))])
        weight = F.coalesce(F.try_element_at(named, F.col(marginal)), own)
    values = values.select(marginal, weight.alias("w")).checkpoint()
    every = values.agg(F.sum("w")).first()[0] or 0.0
    share = F.col("w") / F.lit(every) if every else F.lit(0.0)
    return cells.join(values, marginal).withColumn(f"{marginal}_share", share).drop("w")


def few(cells: DataFrame) -> bool:
    return cells.limit(MAX_BROADCAST_CELLS + 1).count() <= MAX_BROADCAST_CELLS


def left_over(cells: DataFrame) -> tuple[float, float]:
    """Of raked cells with the weight ``before`` the last round: the largest relative error of a marginal sum, and the share of all weight that the round moved."""
    errors = [F.abs(F.sum("weight").over(W.partitionBy(m)) / F.nullif(F.col(f"{m}_share"), F.lit(0.0)) - 1.0) for m in MARGINALS]
    rows = cells.select("weight", "before", *[e.alias(f"e{i}") for i, e in enumerate(errors)])
    found = rows.agg(F.max(F.greatest("e0", "e1", "e2")), F.sum(F.abs(F.col("weight") - F.col("before"))) / F.nullif(F.sum("weight"), F.lit(0.0))).first()
    return found[0] or 0.0, found[1] or 0.0


def rake(cells: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``cells`` (marginals, tokens, ``<marginal>_share``) with ``weight`` added: shares of the tokens, fitted to each marginal in turn;
    and ``residual``, the largest relative error left. After each ``rounds`` rounds it is seen whether more are needed."""
    together, every = ((lambda df: df.coalesce(1)), 4) if few(cells) else ((lambda df: df), 2)
    out, done, last = together(cells).withColumn("weight", F.col("tokens").cast("double")), 0, None
    while True:
        for i in range(rounds):
            out = out.withColumn("before", F.col("weight"))
            for m in MARGINALS:
                total = F.sum("weight").over(W.partitionBy(m))
                out = out.withColumn("weight", F.when(total > 0, F.col("weight") * F.col(f"{m}_share") / total).otherwise(0.0))
            if i % every == every - 1 or i == rounds - 1:
                out = together(out.checkpoint())
        done += rounds
        residual, moved = left_over(out)
        if residual <= TOLERANCE:
            break
        still = last is not None and abs(last - residual) <= STILL_RESIDUAL * residual
        last = residual
        if moved <= STILL or still or done >= MAX_ROUNDS:
            warnings.warn(f"after {done} rounds a marginal is still off its target by {residual:.2g} of it", stacklevel=2)
            break
    return out.drop("before").withColumn("residual", F.lit(residual))


def probabilities(raked: DataFrame, budget: float) -> DataFrame:
    """``raked`` with ``probability`` added: ``budget`` (a share of all tokens) dealt by weight, no cell above 1. Each of a few rounds sums over the cells that are below 1."""
    out = raked.withColumn("p", F.lit(0.0))
    for _ in range(CAP_ROUNDS):
        open_ = F.col("p") < 1.0
        sums = out.agg(F.sum("tokens"), F.sum(F.when(~open_, F.col("tokens")).otherwise(0)), F.sum(F.when(open_, F.col("weight")).otherwise(0.0))).first()
        left, weights = max(0.0, budget * (sums[0] or 0) - (sums[1] or 0)), sums[2] or 0.0
        dealt = F.least(F.lit(1.0), F.lit(left) * F.col("weight") / F.lit(weights or 1.0) / F.col("tokens"))
        out = out.withColumn("p", F.when(~open_, 1.0).when(F.lit(weights > 0) & (F.col("tokens") > 0), dealt).otherwise(0.0))
    return out.withColumn("probability", F.when(F.col("tokens") > 0, F.col("p")).otherwise(F.lit(float(budget)))).drop("p")


def plan_mix(rows: DataFrame, budget: float = 0.8, given: Mapping[str, Mapping[str, float]] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """(marginals, tokens, weight, residual, probability) of each cell of ``measured`` rows."""
    given = given or {}
    shared_dir(rows.sparkSession)
    # Summed before they are shuffled, so a source with a third of the rows is a few rows a task.
    cells = rows.groupBy(*MARGINALS).agg(F.sum("mix_tokens").alias("tokens")).checkpoint()
    for m in MARGINALS:
        cells = with_targets(cells, m, given.get(m))
    return probabilities(rake(cells.checkpoint(), rounds), budget).checkpoint()


def draw_number(doc_id: Column) -> Column:
    """A number in [0, 1) from the id: the first 8 hex digits of its MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def draw(rows: DataFrame, plan: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``measured`` rows with ``probability`` and ``drawn`` added."""
    cells = plan.select(*MARGINALS, "probability")
    # Cells are counted before they are sent to every executor; beyond the limit the join shuffles.
    own = rows.join(F.broadcast(cells) if few(cells) else cells, list(MARGINALS))
    return own.withColumn("drawn", draw_number(F.col(f"given.`{id_col}`")) < F.col("probability"))


def mix_report(docs: DataFrame, budget: float = 0.8, given: Mapping[str, Mapping[str, float]] | None = None, id_col: str = "doc_id", text_col: str = "text", tokens: Column | None = None, topics: Column | None = None) -> DataFrame:
    """(id, marginals, mix_tokens, probability, drawn) of every document."""
    shared_dir(docs.sparkSession)
    rows = measured(docs, text_col, tokens, topics).select(F.struct(F.col(f"given.`{id_col}`")).alias("given"), *MARGINALS, "mix_tokens").checkpoint()
    return draw(rows, plan_mix(rows, budget, given), id_col).select(F.col(f"given.`{id_col}`"), *MARGINALS, "mix_tokens", "probability", "drawn")


def mixed(docs: DataFrame, budget: float = 0.8, given: Mapping[str, Mapping[str, float]] | None = None, id_col: str = "doc_id", text_col: str = "text", tokens: Column | None = None, topics: Column | None = None) -> DataFrame:
    """The drawn rows of ``docs``, with their own columns."""
    rows = measured(docs, text_col, tokens, topics)
    return draw(rows, plan_mix(rows, budget, given), id_col).filter("drawn").select("given.*")
