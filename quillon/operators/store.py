"""The catalogue store: lists, lookups, LIKE searches, ratings and rules. Changes are given as the next snapshot."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import ascii_like

DEFAULT_LIMIT = 20


def like_search(table: DataFrame, text: str, columns: list[str], id_column: str, limit: int = 0) -> DataFrame:
    """Rows with the text in any of the columns; limit 0 means the default. Every match scores 1."""
    hit = reduce(lambda a, b: a | b, (ascii_like(c, text) for c in columns))
    return table.filter(hit).orderBy(id_column).limit(limit or DEFAULT_LIMIT).withColumns({"score": F.lit(1.0), "match_type": F.lit("FullText")})


def rule_search(rules: DataFrame, text: str, columns: list[str], created: str, id_column: str, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Active rules that match, oldest first."""
    if not text.strip():
        raise ValueError("a rule search needs a text")
    hit = reduce(lambda a, b: a | b, (ascii_like(c, text) for c in columns))
    return rules.filter(F.col("active") & hit).orderBy(created, id_column).limit(limit)


def rules_with_tag(rules: DataFrame, tag: str | None, tag_column: str) -> DataFrame:
    """Active rules; a tag is looked for as a part of the tag text."""
    found = rules.filter("active")
    return found if tag is None else found.filter(ascii_like(tag_column, tag))


def page(table: DataFrame, order: str, limit: int, offset: int) -> DataFrame:
    return table.orderBy(order).offset(offset).limit(limit)


def by_category(table: DataFrame, category: str | None, category_column: str, name_column: str, id_column: str, default: str = "GENERAL") -> DataFrame:
    """One category by name, or all by category and name; a null category comes first and shows as the default."""
    if category is not None:
        return table.filter(F.col(category_column) == category).orderBy(name_column, id_column)
    return table.orderBy(F.asc_nulls_first(category_column), name_column, id_column).withColumn(category_column, F.coalesce(category_column, F.lit(default)))


def first_source(sources: list[DataFrame], key: str, value: str) -> DataFrame:
    """The value of each key in the first source that has the key."""
    ranked = reduce(DataFrame.unionByName, (s.select(key, value, F.lit(i).alias("_rank")) for i, s in enumerate(sources)))
    return ranked.groupBy(key).agg(F.min_by(value, "_rank").alias(value), F.min("_rank").alias("source_rank"))


def rate(items: DataFrame, ratings: DataFrame, new: DataFrame, item: str = "item_id", score: str = "score") -> tuple[DataFrame, DataFrame]:
    """(all valid ratings, items with mean and count): scores outside 0..100 and unknown items are refused."""
    valid = new.filter(F.col(score).between(0, 100)).join(items.select(item), item, "left_semi")
    kept = ratings.unionByName(valid)
    return kept, rollup(items, kept, item, score)


def rollup(items: DataFrame, ratings: DataFrame, item: str = "item_id", score: str = "score") -> DataFrame:
    sums = ratings.groupBy(item).agg(F.avg(score).alias("mean_score"), F.count("*").alias("n_ratings"))
    return items.join(sums, item, "left").withColumn("n_ratings", F.coalesce("n_ratings", F.lit(0)))


def retire(rules: DataFrame, id_column: str, ids: list) -> DataFrame:
    """Soft delete."""
    return rules.withColumn("active", F.col("active") & ~F.col(id_column).isin(ids))


def add_rules(rules: DataFrame, new: DataFrame, id_column: str = "id", body: str = "body") -> DataFrame:
    """The rules with new ones, active, numbered on from the greatest id in the order of their bodies; blank bodies are refused."""
    if new.filter(F.col(body).isNull() | (F.trim(body) == "")).limit(1).count():
        raise ValueError("a rule needs a text")
    last = rules.agg(F.coalesce(F.max(id_column), F.lit(0)).cast("bigint").alias("n")).first()["n"]
    order = W.orderBy(body, *(c for c in new.columns if c != body))  # rules are written by hand: there are few
    added = new.withColumn(id_column, F.row_number().over(order) + last).withColumn("active", F.lit(True))
    return rules.unionByName(added, allowMissingColumns=True)
