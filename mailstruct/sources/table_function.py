"""`email_parts` in SQL: the parse as a table function.

    register(spark)
    SELECT m.email_id, p.* FROM mails m, LATERAL email_parts(m.content, max_depth => 5, payload => false) p
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.functions import udtf
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import BinaryType, BooleanType, IntegralType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from mailstruct.sources.mime import ARROW, email_rows

#: Arguments after the content, with their defaults.
OPTIONS = {"max_depth": 10, "recursive": False, "payload": True, "max_file_size_mb": 50}
NUMBERS = ("max_depth", "max_file_size_mb")


class EmailParts:
    """Part rows of one mail, as sources.mime.PARTS without email_id; without payload the column payload is left out as well.

    The options must be constants. A null mail has no rows. A mail that fails, or is larger than allowed, has one row with its error.
    """

    def __init__(self, analyzed: AnalyzeResult | None = None):
        self.names = [f.name for f in analyzed.schema.fields] if analyzed else []

    @staticmethod
    def analyze(content: AnalyzeArgument, **options: AnalyzeArgument) -> AnalyzeResult:
        if not isinstance(content.dataType, BinaryType | StringType) or content.isTable:
            raise ValueError(f"email_parts reads bytes or text, not {content.dataType.simpleString()}")
        values = dict(OPTIONS)
        for name, given in options.items():
            if name not in OPTIONS:
                raise ValueError(f"email_parts has no argument {name}; it has {', '.join(OPTIONS)}")
            kind = IntegralType if name in NUMBERS else BooleanType
            if not given.isConstantExpression or given.value is None or not isinstance(given.dataType, kind):
                raise ValueError(f"{name} must be a constant {'number' if name in NUMBERS else 'true or false'}")
            if name in NUMBERS and given.value < 0:
                raise ValueError(f"{name} must not be negative")
            values[name] = given.value
        fields = [f for f in from_arrow_schema(ARROW).fields if f.name != "email_id" and (values["payload"] or f.name != "payload")]
        return AnalyzeResult(schema=StructType(fields))

    def eval(self, content: bytes | str | None, **options: int | bool) -> Iterator[tuple]:
        if content is None:
            return
        given = OPTIONS | options
        data = content.encode() if isinstance(content, str) else bytes(content)
        if len(data) > given["max_file_size_mb"] << 20:
            rows = [{"error": f"SecurityViolationError: File size {len(data)} exceeds limit {given['max_file_size_mb'] << 20}"}]
        else:
            rows = email_rows(None, data, given["max_depth"], given["recursive"])
        for row in rows:
            headers = row.get("headers")
            row["headers"] = None if headers is None else [(h["k"], h["v"]) for h in headers]
            yield tuple(row.get(n) for n in self.names)


def register(spark, name: str = "email_parts") -> None:
    spark.udtf.register(name, udtf(EmailParts))
