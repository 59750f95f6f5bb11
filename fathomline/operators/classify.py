"""Classification of documents by ordered tables of patterns, as Column expressions: no Python runs on the executors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import vocabulary as V


def hit(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(f"(?i){pattern}"), F.lit(False))


def haystack(*columns: str) -> Column:
    """Texts of the columns that are there, joined; lists count with all their items given as text by the caller."""
    return F.concat_ws(" \n ", *columns)


def hits(text: Column, patterns: tuple[str, ...]) -> Column:
    """How many of the patterns are found."""
    return reduce(Column.__add__, [hit(text, p).cast("int") for p in patterns])


def tags(text: Column, table: dict[str, tuple[str, ...]]) -> Column:
    """Names in the table's order of which any pattern is found."""
    found = [F.when(hit(text, "|".join(f"(?:{p})" for p in patterns)), F.lit(name)) for name, patterns in table.items()]
    return F.array_compact(F.array(*found))


def relevant(text: Column) -> Column:
    return hit(text, "|".join(f"(?:{p})" for p in V.RELEVANCE))


def relevance_hits(text: Column) -> Column:
    """Distinct matched phrases, lower-cased and sorted."""
    whole = "|".join(f"(?:{p})" for p in V.RELEVANCE)
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?i){whole}"), F.lit(0)), F.lower)))


def kind(df: DataFrame, text: Column) -> DataFrame:
    """factor_score, strategy_score, kind (the greater; ties are a strategy) and the kind's sub-categories."""
    df = df.withColumns({"factor_score": hits(text, V.FACTOR), "strategy_score": hits(text, V.STRATEGY)})
    df = df.withColumn("kind", F.when(F.col("factor_score") > F.col("strategy_score"), "factor").otherwise("strategy"))
    return df.withColumn("subcats", subcategories(text, F.col("kind")))


def subcategories(text: Column, of: Column) -> Column:
    return F.when(of == "factor", tags(text, V.FACTOR_SUBCATS)).otherwise(tags(text, V.STRATEGY_SUBCATS))


def template(df: DataFrame, text: Column) -> DataFrame:
    """template: the first with a match (the last takes all); matched: its matched phrases in order of patterns, distinct."""
    names = list(V.TEMPLATES)
    found = {n: F.flatten(F.array(*[F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?i){p}"), F.lit(0)), F.lower) for p in V.TEMPLATES[n]])) for n in names[:-1]}
    which, matched = F.lit(names[-1]), F.array().cast("array<string>")
    for n in reversed(names[:-1]):
        which, matched = F.when(F.size(found[n]) > 0, n).otherwise(which), F.when(F.size(found[n]) > 0, F.array_distinct(found[n])).otherwise(matched)
    return df.withColumns({"template": which, "matched": matched})


def taxonomy(df: DataFrame, text: Column, dimensions: tuple[str, ...] = tuple(V.DIMENSIONS)) -> DataFrame:
    """A list of tags for each dimension, in a column of its name."""
    return df.withColumns({d: tags(text, V.DIMENSIONS[d]) for d in dimensions})


def flat_tags(text: Column, dimensions: tuple[str, ...] = ("family", "signal", "direction")) -> Column:
    """The dimensions' tags in one list, each once."""
    return F.array_distinct(F.concat(*[tags(text, V.DIMENSIONS[d]) for d in dimensions]))


def assembled_tags(text: Column, template: Column, fixed: tuple[str, ...] = (), instrument: str | None = None) -> Column:
    """Fixed tags, the instrument, taxonomy tags and those of the template, each once, in this order."""
    own = reduce(lambda other, n: F.when(template == n, F.array(*map(F.lit, V.TEMPLATE_TAGS[n]))).otherwise(other), V.TEMPLATE_TAGS, F.array().cast("array<string>"))
    head = F.array(*map(F.lit, (*fixed, *([instrument] if instrument else [])))).cast("array<string>")
    return F.array_distinct(F.concat(head, flat_tags(text), own))
