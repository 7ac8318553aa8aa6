"""Token-budgeted output of ranked results: how much of a ranking fits, and in how much detail.

No row is dropped before the budget is applied. The only fold, in `adaptive_cut`, is bounded by the budget itself. Ranks
are unique; null texts cost nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.text import estimate_tokens


def detail_level(rank: Column, remaining: Column | None = None, full: int = 3, signature: int = 4, full_needs: int = 300, signature_needs: int = 100) -> Column:
    """full for the first ranks, signature for the next, else minimal; with `remaining`, only while so much is left."""
    enough = lambda n: F.lit(True) if remaining is None else remaining > n
    return F.when((rank < full) & enough(full_needs), "full").when((rank < full + signature) & enough(signature_needs), "signature").otherwise("minimal")


def rank_rows(df: DataFrame, by: list[str], order: list[Column], most: int | None = None) -> DataFrame:
    """df with `rank` from 0 within each group; with `most`, cut to so many rows a group, as a search result is."""
    w = Window.partitionBy(*by).orderBy(*order)
    ranked = df.withColumn("rank", F.row_number().over(w) - 1)
    return ranked if most is None else ranked.filter(F.col("rank") < most)


def budget_cut(ranked: DataFrame, by: list[str], tokens: str, budget: int) -> DataFrame:
    """The rows before the first that would exceed the budget; the first always stays. Adds `used` so far."""
    upto = Window.partitionBy(*by).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    x = ranked.withColumn("used", F.sum(tokens).over(upto))
    stopped = F.max(F.when((F.col("used") > budget) & (F.col("rank") > 0), 1).otherwise(0)).over(upto)
    return x.withColumn("_s", stopped).filter("_s = 0").drop("_s")


def adaptive_cut(ranked: DataFrame, by: list[str], forms: dict[str, str], budget: int, full_needs: int = 300, signature_needs: int = 100) -> DataFrame:
    """The rows that fit when each one's form depends on its rank and on what is left: forms names the token columns of
    'full', 'signature' and 'minimal'; `full_needs` and `signature_needs` are the tokens that must be left for the richer
    forms (500 and 150 in verbose output). A fold over each group's ordered array, which ends where even the cheapest forms
    exceed the budget: no row after that can fit, so the result is the same. Rows that cost nothing stay in it."""
    least = F.least(*[F.coalesce(c, F.lit(0)) for c in forms.values()])
    spent = F.sum(least).over(Window.partitionBy(*by).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    may_fit = ranked.withColumn("_spent", spent).filter((F.col("_spent") <= budget) | (F.col("rank") == 0)).drop("_spent")
    row = F.struct("rank", *[F.col(c).alias(f"_{k}") for k, c in forms.items()], F.struct(*[c for c in ranked.columns if c not in by]).alias("row"))
    g = may_fit.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col("rank").alias("k"), row.alias("r")))).alias("rows"))
    kept_type = "array<struct<rank:int,level:string,tokens:bigint>>"
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.lit(False).alias("over"), F.array().cast(kept_type).alias("kept"))

    def step(acc: Column, item: Column) -> Column:
        r = item.r
        level = detail_level(r.rank, F.lit(budget) - acc.used, full_needs=full_needs, signature_needs=signature_needs)
        cost = F.when(level == "full", r["_full"]).when(level == "signature", r["_signature"]).otherwise(r["_minimal"]).cast("bigint")
        over = acc["over"] | ((acc.used + cost > budget) & (r.rank > 0))
        entry = F.array(F.struct(r.rank.cast("int").alias("rank"), level.alias("level"), cost.alias("tokens")))
        return F.struct(F.when(over, acc.used).otherwise(acc.used + cost).alias("used"), over.alias("over"), F.when(over, acc.kept).otherwise(F.concat(acc.kept, entry)).alias("kept"))

    x = g.withColumn("fold", F.aggregate("rows", start, step))
    k = x.select(*by, F.explode("fold.kept").alias("k")).select(*by, "k.*")
    return ranked.join(k, [*by, "rank"])


def result_forms(df: DataFrame) -> DataFrame:
    """Components with the tokens of each form: name and place; with the signature; with the snippet, too."""
    place = F.concat(F.lit("["), "type", F.lit("] "), "name", F.lit(" - "), "file", F.lit(":"), F.col("start_line").cast("string"))
    none = F.lit("")
    minimal = F.coalesce(place, none)
    signature = F.concat_ws("\n", minimal, F.nullif("signature", none))
    full = F.concat_ws("\n", signature, F.nullif("snippet", none))
    return df.withColumns({"t_minimal": estimate_tokens(minimal), "t_signature": estimate_tokens(signature), "t_full": estimate_tokens(full)})
