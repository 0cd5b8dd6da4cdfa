"""Token columns as rows, by a table function whose schema follows from its arguments."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

#: A row for each code: the token column, the place among its codes, the code.
ADDED = T.StructType([T.StructField("column", T.StringType()), T.StructField("position", T.IntegerType()), T.StructField("code", T.LongType())])
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def is_token(kind: T.DataType) -> bool:
    """Whether a type is one of a token column: a whole number, an array of them, or a struct of that array alone."""
    if isinstance(kind, T.StructType):
        return kind.names == ["token"] and isinstance(kind["token"].dataType, T.ArrayType) and is_token(kind["token"].dataType)
    return isinstance(kind.elementType if isinstance(kind, T.ArrayType) else kind, WHOLE)


def codes(value: Any) -> Iterator[tuple[int, int | None]]:
    """Place and code of a token value; a null value has none, a null code stays."""
    if isinstance(value, T.Row):
        value = value["token"]
    if value is not None:
        yield from enumerate(value if isinstance(value, list) else [value])


class ExplodeTokens:
    """explode_tokens: codes of token columns as rows, in SQL or as a DataFrame.

    `explode_tokens(TABLE(t), 'tok_a', 'tok_b')` gives t's other columns with ADDED; columns are named
    whatever their case, once each. `LATERAL explode_tokens(a => t.tok_a, b => t.tok_b)` gives ADDED
    alone, with the arguments' names as columns. A null value, and one without codes, has no rows; so has
    an empty table. Repeated rows stay apart. What is no token column, what the table doesn't have, and
    another column that has a name of ADDED are errors before anything runs.
    """

    def __init__(self, *_: Any, **__: Any):
        self.keep = None

    @staticmethod
    def analyze(*given: AnalyzeArgument, **named: AnalyzeArgument) -> AnalyzeResult:
        if not given:
            if not named:
                raise ValueError("explode_tokens needs a table and its columns, or named columns")
            if wrong := [k for k, a in named.items() if a.isTable or not is_token(a.dataType)]:
                raise ValueError(f"no token columns: {', '.join(wrong)}")
            return AnalyzeResult(schema=ADDED)
        table, names = given[0], [a.value for a in given[1:]]
        if named or not table.isTable or not names or not all(isinstance(n, str) for n in names):
            raise ValueError("explode_tokens takes a table and the names of its token columns as texts")
        wanted = ExplodeTokens.places(table.dataType, names)
        if wrong := [table.dataType[i].name for i in wanted if not is_token(table.dataType[i].dataType)]:
            raise ValueError(f"no token columns: {', '.join(wrong)}")
        kept = [f for i, f in enumerate(table.dataType) if i not in wanted]
        if clash := [f.name for f in kept if f.name.lower() in ADDED.names]:
            raise ValueError(f"rename {', '.join(clash)}: the result has such a column")
        return AnalyzeResult(schema=T.StructType([*kept, *ADDED]))

    @staticmethod
    def places(schema: T.StructType, names: list[str]) -> dict[int, None]:
        """Places of the named columns, in the order named."""
        at: dict[int, None] = {}
        for n in names:
            found = [i for i, c in enumerate(schema.names) if c == n] or [i for i, c in enumerate(schema.names) if c.lower() == n.lower()]
            if len(found) != 1:
                raise ValueError(f"the table has {len(found)} columns {n!r}: {', '.join(schema.names)}")
            at[found[0]] = None
        return at

    def eval(self, *given: Any, **named: Any) -> Iterator[tuple]:
        if named:
            for column, value in named.items():
                for place, code in codes(value):
                    yield column, place, code
            return
        row = given[0]
        if self.keep is None:
            columns = row.__fields__
            at = self.places(T.StructType([T.StructField(c, T.NullType()) for c in columns]), list(given[1:]))
            self.keep, self.take = [i for i in range(len(columns)) if i not in at], [(i, columns[i]) for i in at]
        kept = tuple(row[i] for i in self.keep)
        for i, column in self.take:
            for place, code in codes(row[i]):
                yield (*kept, column, place, code)


#: As a function of DataFrames: explode_tokens(df.asTable(), F.lit("tok_a")).
explode_tokens = F.udtf(ExplodeTokens, useArrow=True)
