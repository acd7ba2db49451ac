"""A registry of queries, and SQL forms of the text functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.functions: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        def put(f: Query) -> Query:
            self.functions[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return put


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toks(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), '[\\p{{L}}\\p{{N}}_]+')"


def fold_search(x: str) -> str:
    return f"strip_accents(replace(lower(coalesce({x}, '')), 'ß', 'ss'))"


def fold(x: str) -> str:
    return f"trim(regexp_replace(replace({fold_search(x)}, 'đ', 'd'), '\\s+', ' ', 'g'))"


def fold_eval(x: str) -> str:
    return f"trim(regexp_replace(replace({fold_search(x)}, 'đ', 'd'), '[^a-z0-9]+', ' ', 'g'))"


def identifier_form(x: str) -> str:
    return f"regexp_replace(replace({fold_search(x)}, 'đ', 'd'), '[^a-z0-9]+', '', 'g')"


def rank_toks(x: str) -> str:
    return f"list_filter(regexp_extract_all({fold(x)}, '[\\p{{L}}\\p{{N}}_]+'), lambda t: length(t) >= 2)"


def search_toks(x: str) -> str:
    return f"list_filter(regexp_split_to_array({fold_search(x)}, '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '\\s+', ' ', 'g'))"
