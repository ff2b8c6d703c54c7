"""Query strings: `operation:argument,operation:argument`.

Operations are cut at commas and colons as they stand, without trimming or
quoting.  Only the first argument counts."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescout.operators.collection import Collection
from tablescout.operators.results import UNKNOWN, display_lines, no_result_message
from tablescout.operators.index import ContentIndex
from tablescout.operators.search import REPORTS, keyword_search, keyword_searches, report
from tablescout.sources.scratch import stored

log = logging.getLogger(__name__)
SEARCH = "semantic"


@dataclass(frozen=True)
class Operation:
    op_idx: int
    raw: str
    name: str
    args: tuple[str, ...]

    @property
    def arg(self) -> str | None:
        return self.args[0] if self.args else None


def parse_query(query: str) -> list[Operation]:
    """An empty string is one operation without a name."""
    pieces = [raw.split(":") for raw in query.split(",")]
    return [Operation(i, ":".join(p), p[0], tuple(p[1:])) for i, p in enumerate(pieces)]


def parse_frame(queries: DataFrame, column: str) -> DataFrame:
    """The same as a frame: op_idx, raw_operation, op_name, arg, n_args and the frame's other columns."""
    ops = queries.select(*[c for c in queries.columns if c != column], F.posexplode(F.split(column, ",")).alias("op_idx", "raw_operation"))
    parts = F.split("raw_operation", ":")
    return ops.withColumns({"op_name": F.get(parts, F.lit(0)), "arg": F.get(parts, F.lit(1)), "n_args": F.size(parts) - 1})


@dataclass
class OperationResult:
    """frame: what the operation returns; messages: what it says."""

    operation: Operation
    known: bool
    frame: DataFrame | None
    messages: DataFrame | None


class DiscoveryEngine:
    """Runs query strings over a collection.  `registry` maps an operation's
    name to a function of (collection, argument, in_metadata).  Unknown
    operations give a message and the next one goes on.  index: a `ContentIndex`
    or a stored frame of counts, used in place of the cells."""

    def __init__(self, collection: Collection, index: DataFrame | ContentIndex | None = None):
        self.collection, self.index = collection, index
        self.registry: dict[str, Callable[[Collection, str, bool], DataFrame]] = {SEARCH: self._search} | {name: self._report(name) for name in REPORTS}

    def _search(self, collection: Collection, argument: str, in_metadata: bool) -> DataFrame:
        return keyword_search(collection, argument, in_metadata, index=self.index)

    @staticmethod
    def _report(name: str):
        return lambda collection, argument, in_metadata: report(collection, name, argument)

    def run(self, query: str, in_metadata: bool = False) -> Iterator[OperationResult]:
        """Results one by one, so that an operation that fails loses none before
        it.  At the first search, all searches of the query are answered together."""
        operations = parse_query(query)
        log.info("Operations: %s", [o.raw for o in operations])
        searches = [o for o in operations if o.name == SEARCH and o.arg is not None]

        @cache
        def found() -> DataFrame:
            return keyword_searches(self.collection, [o.arg for o in searches], in_metadata, index=self.index)

        def search(op: Operation) -> DataFrame:
            if self.registry[SEARCH] != self._search:  # the user's own
                return self.registry[SEARCH](self.collection, op.arg, in_metadata)
            return found().where(F.col("query") == searches.index(op)).drop("query")

        return (self._one(o, operations, in_metadata, search) for o in operations)

    def _one(self, op: Operation, operations: list[Operation], in_metadata: bool, search: Callable[[Operation], DataFrame]) -> OperationResult:
        spark = self.collection.catalog.sparkSession
        if op.name not in self.registry:
            return OperationResult(op, False, None, spark.createDataFrame([(UNKNOWN % op.name,)], "message string"))
        if op.name == SEARCH:
            if op.arg is None:
                raise ValueError(f"{SEARCH} needs an argument: {SEARCH}:words")
            frame = search(op)
            return OperationResult(op, True, frame, no_result_message(frame, op.arg))
        argument = str([o.raw for o in operations]) if op.arg is None else op.arg  # without an argument, reports name all operations
        frame = self.registry[op.name](self.collection, argument, in_metadata)
        return OperationResult(op, True, frame, frame.select("message") if "message" in frame.columns else None)

    def show(self, query: str, in_metadata: bool = False, repeat: bool = False) -> None:
        """Prints what `run` finds, operation by operation.  A search is written
        once and printed from there, a partition of lines at a time."""
        for r in self.run(query, in_metadata):
            messages = r.messages
            if r.known and r.operation.name == SEARCH:
                found = stored(r.frame, "results")
                for line in display_lines(found, r.operation.arg, repeat).orderBy("line_no").toLocalIterator():
                    print(line.line)
                messages = no_result_message(found, r.operation.arg)
            for m in messages.collect() if messages is not None else []:
                print(m.message)
