"""Translation: distinct texts once, through an injected function or a dry run, with checks after."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportloom.functions import text as t
from reportloom.operators.lineage import cut

#: Texts of one prompt. Fixed value.
BATCH = 15


def dry_run(text: Column, model: str) -> Column:
    return F.format_string("[DRY_RUN:%s] %s", F.lit(model), text)


def translated(texts: DataFrame, terms: list[tuple[str, str]], model: str = "m", function: Callable[[list[str]], list[str]] | None = None) -> DataFrame:
    """Adds translated, issues and model to (text): normalise, protect terms, translate, restore, style, check.

    Each distinct text is translated once and joined back. Empty texts pass as they are with model "none". ``function``
    gets batches of protected texts; if it fails the protected text stands for its result, so a batch never stops the job.
    """
    todo = texts.select("text").where(F.trim("text") != "").distinct().withColumn("protected", t.protect(t.normalize_source(F.col("text")), terms))
    if function is None:
        done = todo.withColumn("raw", dry_run(F.col("protected"), model))
    else:

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out: list[str] = []
                for i in range(0, len(batch), BATCH):
                    part = batch["protected"].iloc[i : i + BATCH].tolist()
                    try:
                        got = function(part)
                    except Exception:  # noqa: BLE001  a failed call leaves the text as it was
                        got = part
                    out += got if len(got) == len(part) else part
                yield batch.assign(raw=out)

        done = todo.mapInPandas(run, "text string, protected string, raw string")
    styled = t.replace_all(t.restore(F.col("raw"), terms), t.STYLE_RULES)
    done = done.withColumn("translated", styled).withColumn("issues", F.size(F.concat(t.missing(F.col("text"), F.col("translated")), t.violations(F.col("translated"), [s for s, _ in terms]))))
    joined = texts.join(done.select("text", "translated", "issues"), "text", "left")
    return joined.withColumns({"model": F.when(F.col("translated").isNull(), "none").otherwise(model), "translated": F.coalesce("translated", "text"), "issues": F.coalesce("issues", F.lit(0))})


#: Prices of a million prompt and completion tokens. Fixed values.
PRICES = (0.075, 0.30)
OUTCOME = "text string, prompt_tokens long, completion_tokens long, attempts int, error string"


def _called(function: Callable[[list], list[tuple[str, int, int]]], asked: list, attempts: int) -> list[tuple]:
    """An outcome for each text asked: a call that fails or answers another number of texts is made again, then counts as an error."""
    error = ""
    for n in range(1, attempts + 1):
        try:
            got = function(asked)
            if len(got) == len(asked):
                return [(text, int(p), int(c), n, None) for text, p, c in got]
            error = f"{len(got)} answers to {len(asked)} texts"
        except Exception as e:  # noqa: BLE001  the outcome carries what failed
            error = f"{type(e).__name__}: {e}"
    return [(None, 0, 0, attempts, error)] * len(asked)


def _outcomes(rows: DataFrame, columns: list[str], function: Callable, attempts: int, name: str) -> DataFrame:
    """Adds the outcome struct ``name``; ``function`` gets lists of BATCH texts, or of tuples of several columns."""
    fields = [f.split()[0] for f in OUTCOME.split(", ")]
    ddl = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in rows.columns] + [f"`__{f}` {x.split()[1]}" for f, x in zip(fields, OUTCOME.split(", "), strict=True)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            asked = batch[columns[0]].tolist() if len(columns) == 1 else list(batch[columns].itertuples(index=False, name=None))
            got = [o for i in range(0, len(asked), BATCH) for o in _called(function, asked[i : i + BATCH], attempts)]
            for k, f in enumerate(fields):
                batch[f"__{f}"] = pd.Series([o[k] for o in got], index=batch.index, dtype=object)
            yield batch

    out = rows.mapInPandas(run, ddl)
    return out.select(*rows.columns, F.struct(*[F.col(f"__{f}").alias(f) for f in fields]).alias(name))


def refined(
    texts: DataFrame, terms: list[tuple[str, str]], bulk: Callable[[list[str]], list[tuple[str, int, int]]], refine: Callable[[list[tuple]], list[tuple[str, int, int]]] | None = None,
    model: str = "bulk", refine_model: str = "refine", attempts: int = 2, prices: tuple[float, float] = PRICES,
) -> DataFrame:
    """Translates (text) in two passes: every distinct text once, and again those whose translation has issues.

    ``bulk`` gets protected texts, ``refine`` tuples (source, translation, issues); both answer (text, prompt tokens, completion tokens)
    for each. Adds translated, issues (of the first pass), was_refined, model, refine_model, attempts, error, prompt_tokens,
    completion_tokens and cost. A failed call leaves the normalised source, or the first translation, and its error. A refinement that
    changes nothing costs nothing, as its tokens are not counted. The outcomes of calls are checkpointed, so no later step calls again.
    Null and blank texts stay as they are, with model "none" and no cost. Rows with one text share its call, and each carries its tokens.
    """
    todo = texts.select("text").where(F.trim("text") != "").distinct().withColumn("source", t.normalize_source(F.col("text")))
    first = cut(_outcomes(todo.withColumn("protected", t.protect(F.col("source"), terms)), ["protected"], bulk, attempts, "one"))
    styled = t.replace_all(t.restore(F.coalesce("one.text", "protected"), terms), t.STYLE_RULES)
    first = first.withColumn("draft", styled)
    first = first.withColumn("issues", F.concat(t.missing(F.col("text"), F.col("draft")), t.violations(F.col("draft"), [s for s, _ in terms])))
    none = F.lit(None).cast(f"struct<{', '.join(x.replace(' ', ': ') for x in OUTCOME.split(', '))}>")
    if refine is None:
        second = first.withColumn("two", none)
    else:
        bad = F.size("issues") > 0
        asked = _outcomes(first.where(bad), ["source", "draft", "issues"], refine, attempts, "two")
        second = cut(asked).unionByName(first.where(~bad).withColumn("two", none))
    changed = F.col("two.text").isNotNull() & (F.col("two.text") != F.col("draft"))
    extra = lambda f: F.coalesce(F.col(f"one.{f}"), F.lit(0)) + F.when(changed, F.col(f"two.{f}")).otherwise(0)
    done = second.select(
        "text", F.when(changed, F.col("two.text")).otherwise(F.col("draft")).alias("translated"), F.size("issues").alias("issues"), F.coalesce(changed, F.lit(False)).alias("was_refined"),
        F.lit(model).alias("model"), F.when(changed, F.lit(refine_model)).alias("refine_model"), (F.coalesce("one.attempts", F.lit(0)) + F.coalesce("two.attempts", F.lit(0))).alias("attempts"),
        F.concat_ws("; ", "one.error", "two.error").alias("error"), extra("prompt_tokens").alias("prompt_tokens"), extra("completion_tokens").alias("completion_tokens"),
    )
    done = done.withColumn("cost", (F.col("prompt_tokens") * prices[0] + F.col("completion_tokens") * prices[1]) / 1_000_000)
    out = texts.join(done, "text", "left")
    blank = {"translated": F.col("text"), "issues": F.lit(0), "was_refined": F.lit(False), "model": F.lit("none"), "attempts": F.lit(0), "error": F.lit(""), "prompt_tokens": F.lit(0), "completion_tokens": F.lit(0), "cost": F.lit(0.0)}
    return out.withColumns({c: F.coalesce(F.col(c), v) for c, v in blank.items()})


def qa_report(df: DataFrame, terms: list[tuple[str, str]], keys: list[str]) -> DataFrame:
    """Segments, translated, refined and failed ones, tokens, cost, term violations, number mismatches and quality of each group of ``refined`` rows."""
    checked = df.withColumns({"__v": F.size(t.violations(F.coalesce("translated", F.lit("")), [s for s, _ in terms])), "__n": F.size(t.missing(F.coalesce("text", F.lit("")), F.coalesce("translated", F.lit(""))))})
    out = checked.groupBy(*keys).agg(
        F.count("*").alias("segments"), F.count_if(F.col("translated") != "").alias("translated_segments"), F.count_if("was_refined").alias("refined_segments"), F.count_if(F.col("error") != "").alias("failed_segments"),
        F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.sum("cost").alias("cost"), F.sum("__v").alias("term_violations"), F.sum("__n").alias("number_mismatches"),
    )
    issues = F.col("term_violations") + F.col("number_mismatches")
    return out.withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens")).withColumn("quality", F.round(F.greatest(F.lit(0.0), 1 - issues / F.col("segments") * 0.1), 6))


def report(df: DataFrame, keys: list[str]) -> DataFrame:
    """Segments, issues and quality, 1 less a tenth of the issues a segment, of each group."""
    out = df.groupBy(*keys).agg(F.count("*").alias("segments"), F.sum("issues").alias("issues"))
    return out.withColumn("quality", F.round(F.greatest(F.lit(0.0), 1 - F.col("issues") / F.col("segments") * 0.1), 6))


def batches(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Batch numbers of BATCH texts in order, blanks left out."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.where(F.trim("text") != "").withColumn("batch", F.floor((n - 1) / BATCH).cast("long"))


def realign(answers: DataFrame, keys: list[str], order: str, size: int = BATCH) -> DataFrame:
    """Numbered answer lines "[n] text" as (n, text): further lines join, numbers out of range drop, the last n counts."""
    head = r"^\[(\d+)\]\s*(.*)$"
    is_head = F.col("line").rlike(head)
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = answers.withColumn("block", F.sum(is_head.cast("int")).over(w)).where("block > 0")
    part = F.when(is_head, F.regexp_extract("line", head, 2)).otherwise(F.trim("line"))
    made = rows.groupBy(*keys, "block").agg(F.max(F.when(is_head, F.regexp_extract("line", head, 1).cast("int"))).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), part.alias("t")))), lambda x: x["t"]), " ").alias("text"))
    return made.where(F.col("n").between(1, size)).groupBy(*keys, "n").agg(F.max_by("text", "block").alias("text"))
