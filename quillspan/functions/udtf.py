"""Table functions for SQL users."""

from __future__ import annotations

from pyspark.sql import SparkSession


def register(spark: SparkSession) -> None:
    """SELECT * FROM tokenize('some text') gives (position, term); dropped tokens keep their position."""
    from pyspark.sql.functions import udtf

    from ..operators.query import words

    @udtf(returnType="position int, term string")
    class Tokenize:
        def eval(self, text: str):
            if text is None:
                return
            now, place = "", 0
            for c in text + " ":
                if c.isalpha() or c.isnumeric():
                    now += c
                elif now:
                    for term in words(now):
                        yield place, term
                    now, place = "", place + 1

    spark.udtf.register("tokenize", Tokenize)
