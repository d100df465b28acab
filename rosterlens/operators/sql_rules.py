"""Users' page rules as table functions of SQL.

``register_table_rule`` makes ``SELECT * FROM rule(TABLE(pages))`` out of a ``PythonRule``. The function looks at
its table when the query is analysed: it asks for the columns it needs only, so the scan is pruned, and says what is
missing before a job runs. Without PARTITION BY the rows stay where they are, and no shuffle is made. Two optional constants are
read at analysis as well: ``host`` keeps pages of one host and its subdomains, ``extras`` says whether fields of the
rule beyond the known ones come along as a map.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, SelectedColumn, udtf

from rosterlens.operators.extraction import FIELDS, PythonRule

NEEDED = ("page_id", "url", "html")


def _schema(extras: bool) -> T.StructType:
    schema = T.StructType().add("page_id", T.LongType()).add("url", T.StringType()).add("rule", T.StringType()).add("ord", T.IntegerType())
    for name in FIELDS:
        schema = schema.add(name, T.StringType())
    return schema.add("extras", T.MapType(T.StringType(), T.StringType())) if extras else schema


def host_of(url: str | None) -> str:
    """The host of an URL in lower case, without a port; empty where there is none."""
    if not url or "://" not in url:
        return ""
    rest = url.split("://", 1)[1]
    for end in "/?#":
        rest = rest.split(end, 1)[0]
    return rest.rsplit("@", 1)[-1].split(":", 1)[0].lower()


def on_host(url: str | None, host: str) -> bool:
    found = host_of(url)
    return found == host or found.endswith("." + host)


@dataclass
class Settings(AnalyzeResult):
    """What the analysis found, handed to every task."""

    host: str = ""
    extras: bool = False


def table_rule(rule: PythonRule) -> type:
    """The handler class of a rule's table function. It holds the rule itself, so workers need no registry."""
    name, fn = rule.name, rule.fn

    class Handler:
        def __init__(self, analyzed: Settings) -> None:
            self.host, self.extras = analyzed.host, analyzed.extras

        @staticmethod
        def analyze(pages: AnalyzeArgument, host: AnalyzeArgument | None = None, extras: AnalyzeArgument | None = None) -> AnalyzeResult:
            if not pages.isTable:
                raise ValueError(f"{name} takes a table of pages: {name}(TABLE(pages))")
            missing = [c for c in NEEDED if c not in pages.dataType.fieldNames()]
            if missing:
                raise ValueError(f"{name} needs the columns {', '.join(NEEDED)}; missing: {', '.join(missing)}")
            for label, given, kind in (("host", host, str), ("extras", extras, bool)):
                if given is not None and (not given.isConstantExpression or not isinstance(given.value, kind)):
                    raise ValueError(f"{label} of {name} is a constant {kind.__name__}")
            wants_extras = bool(extras and extras.value)
            return Settings(_schema(wants_extras), select=[SelectedColumn(c) for c in NEEDED], host=host.value.lower() if host else "", extras=wants_extras)

        def eval(self, row: Row, host: str | None = None, extras: bool | None = None) -> Iterator[tuple]:
            if row["html"] is None or (self.host and not on_host(row["url"], self.host)):
                return
            for place, person in enumerate(fn(row["html"], row["url"]) or []):
                if person.get("name"):
                    more = ({k: str(v) for k, v in person.items() if k not in FIELDS and v is not None},) if self.extras else ()
                    yield (row["page_id"], row["url"], name, place, *(person.get(f) for f in FIELDS), *more)

    return Handler


def register_table_rule(spark: SparkSession, rule: PythonRule, name: str | None = None) -> Callable:
    """Register ``rule`` as a table function of SQL, under its own name or ``name``; returns it for calls from Python.

    Pages without HTML and people without a name give no rows; a page's people are numbered in the order of the rule.
    """
    return spark.udtf.register(name or rule.name, udtf(table_rule(rule)))
