"""Parsers by name: one uniform interface over all miners."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import partial
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..operators import bucketed, drain, frequency, iplom, lke, neural, ordered, search

#: name -> (miner, whether equal templates of different clusters stay)
PARSERS: dict[str, tuple[Callable[..., DataFrame], bool]] = {
    "ael": (bucketed.ael, False),
    "dlog": (bucketed.dlog, False),
    "drain": (drain.drain, True),
    "fttree": (bucketed.fttree, False),
    "iplom": (iplom.iplom, False),
    "lenma": (bucketed.lenma, True),
    "lfa": (frequency.lfa, False),
    "lke": (lke.lke, False),
    "logcluster": (frequency.logcluster, False),
    "logcluster_patterns": (frequency.logcluster_patterns, False),
    "logmine": (ordered.logmine, True),
    "logsig": (search.logsig, True),
    "molfi": (search.molfi, False),
    "nulog": (neural.nulog, False),
    "shiso": (ordered.shiso, True),
    "slct": (frequency.slct, False),
    "spell": (ordered.spell, True),
    "va": (frequency.va, False),
    "va_static": (partial(frequency.va, method="static"), False),
    "varl": (partial(frequency.va, method="relative-line"), False),
    "varv": (partial(frequency.va, method="relative-variable"), False),
}


#: Parsers that go on from call to call when given lists.
STATEFUL = {"dlog", "drain", "fttree", "lfa", "shiso"}


@dataclass
class Parser:
    """A miner with its parameters. ``parse`` takes a DataFrame (line_id, line) or, for small inputs, a list of lines.

    Lists given to one of the :data:`STATEFUL` parsers add to those it was given before (``reset`` forgets them).
    """

    name: str
    params: dict[str, Any] = field(default_factory=dict)
    lines: list[str] = field(default_factory=list, repr=False)

    def __post_init__(self) -> None:
        if self.name not in PARSERS:
            raise KeyError(self.name)

    def identifier(self) -> dict[str, Any]:
        return {"name": self.name, **self.params}

    def mine(self, lines: DataFrame) -> DataFrame:
        """template, n_lines, first_line_id."""
        return PARSERS[self.name][0](lines, **self.params)

    def parse(self, logs: DataFrame | list[str]) -> DataFrame | list[tuple]:
        """A DataFrame gives :meth:`mine`'s; a list gives the templates as tuples (None is the wildcard) in founding order."""
        if isinstance(logs, DataFrame):
            return self.mine(logs)
        spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
        self.lines = [*self.lines, *logs] if self.name in STATEFUL else list(logs)
        found = self.mine(spark.createDataFrame(list(enumerate(self.lines)), "line_id long, line string"))
        return [tuple(r[0]) for r in found.orderBy("first_line_id").collect()]

    def reset(self) -> None:
        """Forget the lines of earlier calls."""
        self.lines = []


def parser(name: str, **params: Any) -> Parser:
    return Parser(name, params)


def numbered(templates: DataFrame) -> DataFrame:
    """Adds template_id, the templates' founding lines, which order them as they were found."""
    return templates.withColumn("template_id", F.col("first_line_id"))


#: Miners for the table function, as (class, whether it has one state per token count).
ONLINE: dict[str, tuple[Callable[..., Any], bool]] = {
    "ael": (bucketed.Ael, True),
    "dlog": (bucketed.DLog, False),
    "drain": (drain.Drain, False),
    "fttree": (bucketed.OnlineFtTree, False),
    "lenma": (bucketed.Lenma, True),
    "shiso": (partial(ordered.Shiso, vector=ordered.letter_counts), False),
    "spell": (ordered.Spell, False),
}


class ParseLogs:
    """The table function ``parse_logs(TABLE(...), parser, parameters as JSON)``: rows (line_id, line) in, templates out.

    It mines one partition of its table: give it ``PARTITION BY`` for separate logs, and ``ORDER BY line_id``.
    """

    def __init__(self) -> None:
        self.miners: dict[int, Any] = {}

    def eval(self, row: Row, parser: str, params: str) -> None:
        import json

        make, by_length = ONLINE[parser]
        tokens = (row["line"] or "").split()
        key = len(tokens) if by_length else 0
        if key not in self.miners:
            self.miners[key] = make(**json.loads(params))
        self.miners[key].add(row["line_id"], tokens)

    def terminate(self) -> Iterator[tuple]:
        for miner in self.miners.values():
            for template, n, first in miner.templates():
                yield list(template), int(n), int(first)


def register_parse_logs(spark: SparkSession, name: str = "parse_logs") -> None:
    """Make :class:`ParseLogs` known to SQL."""
    spark.udtf.register(name, F.udtf(ParseLogs, returnType="template array<string>, n_lines long, first_line_id long"))
