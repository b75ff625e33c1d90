"""Providers as a Spark data source: companies and months, read by a function that answers for one of them.

A provider is an importable class. Made from the source's options (a dict of texts, names
in lower case), it has ``schema`` (DDL with ``isin`` and the day's column), ``day`` (that
column), ``companies()``, ``span()`` (first and last day there is) and ``read(isin, first,
last)`` (rows or Arrow batches of a company's days). A provider that keeps many companies
together has, in place of ``companies`` and ``read``, ``groups()``, ``group_of(isin)`` and
``read_group(group, companies, first, last)`` (companies: a list, or None for all of the
group). Filters on company and day choose partitions before anything is asked. A partition
is a group, or a company and month; of over ``MOST`` company-months it is some companies of
a month, so that tasks do not grow with companies. As a stream, months arrive as ``span()``
moves on; a month is offered when it is over, so it is read once.
"""

from __future__ import annotations

import datetime as dt
import importlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from factorloom.shipping import ship

NAME = "company_months"


#: partitions beyond which company-months are read together
MOST = 1000


@dataclass
class Share(InputPartition):
    """Days of a group (``companies`` None: all of it), or of companies that are asked for one by one."""

    group: object
    companies: list | None
    first: dt.date
    last: dt.date


def month_number(day: dt.date) -> int:
    return day.year * 12 + day.month - 1


def month_start(number: int) -> dt.date:
    return dt.date(number // 12, number % 12 + 1, 1)


def months(first: dt.date, last: dt.date) -> Iterator[tuple[dt.date, dt.date]]:
    """The parts of each calendar month that lie in first .. last."""
    for number in range(month_number(first), month_number(last) + 1):
        yield max(first, month_start(number)), min(last, month_start(number + 1) - dt.timedelta(1))


def shares(provider: object, wanted: set | None, first: dt.date, last: dt.date) -> list[Share]:
    """The partitions of first .. last for the ``wanted`` companies (None: all)."""
    if first > last:
        return []
    if hasattr(provider, "groups"):
        if wanted is None:
            return [Share(g, None, first, last) for g in sorted(provider.groups())]
        held: dict = {}
        for c in sorted(c for c in wanted if c is not None):
            held.setdefault(provider.group_of(c), []).append(c)
        return [Share(g, held[g], first, last) for g in sorted(provider.groups()) if g in held]
    companies = sorted(c for c in provider.companies() if wanted is None or c in wanted)
    spans = list(months(first, last))
    size = -(-len(companies) // max(1, MOST // len(spans))) or 1
    return [Share(None, companies[k : k + size], a, b) for k in range(0, len(companies), size) for a, b in spans]


def _rows(provider: object, share: Share) -> Iterator:
    if share.group is not None:
        yield from provider.read_group(share.group, share.companies, share.first, share.last)
    else:
        for isin in share.companies:
            yield from provider.read(isin, share.first, share.last)


def _as_day(value: object) -> dt.date:
    return value.date() if isinstance(value, dt.datetime) else value


class _Reader(DataSourceReader):
    def __init__(self, provider: object):
        self.provider = provider
        self.first, self.last = provider.span()
        self.companies: set | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Companies are chosen in full; days too, as partitions hold no others than those of the span that is left."""
        for f in filters:
            column, value = f.attribute, getattr(f, "value", None)
            if column == ("isin",) and isinstance(f, (EqualTo, In)):
                wanted = set(f.value) if isinstance(f, In) else {value}
                self.companies = wanted if self.companies is None else self.companies & wanted
            elif column == (self.provider.day,) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and isinstance(value, dt.date):
                day, exact = _as_day(value), not isinstance(value, dt.datetime)
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.first = max(self.first, day + dt.timedelta(exact and isinstance(f, GreaterThan)))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.last = min(self.last, day - dt.timedelta(exact and isinstance(f, LessThan)))
                if not exact:
                    yield f  # the time of day is left to Spark
            else:
                yield f

    def partitions(self) -> list[Share]:
        return shares(self.provider, self.companies, self.first, self.last)

    def read(self, partition: Share) -> Iterator:
        return _rows(self.provider, partition) if partition is not None else iter(())


class _Stream(DataSourceStreamReader):
    """Offsets are months: all before ``month`` are told."""

    def __init__(self, provider: object):
        self.provider = provider

    def initialOffset(self) -> dict:
        return {"month": month_number(self.provider.span()[0])}

    def latestOffset(self) -> dict:
        # a month is told when its last day is there
        return {"month": month_number(self.provider.span()[1] + dt.timedelta(1))}

    def partitions(self, start: dict, end: dict) -> list[Share]:
        if start["month"] >= end["month"]:
            return []
        first, last = month_start(start["month"]), month_start(end["month"]) - dt.timedelta(1)
        return shares(self.provider, None, max(first, self.provider.span()[0]), last)

    def read(self, partition: Share) -> Iterator:
        return _rows(self.provider, partition)

    def commit(self, end: dict) -> None:
        pass


class CompanyMonths(DataSource):
    """``spark.read.format("company_months").option("provider", "module:Class")...``"""

    def _provider(self) -> object:
        named = self.options.get("provider")
        if not named or ":" not in named:
            raise ValueError('option "provider" must be module:Class')
        module, _, cls = named.partition(":")
        return getattr(importlib.import_module(module), cls)({k.lower(): v for k, v in self.options.items()})

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return self._provider().schema

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self._provider())

    def streamReader(self, schema: StructType) -> _Stream:
        return _Stream(self._provider())


class DailyFiles:
    """A provider over Parquet files of groups of companies: ``path``/group=.../*.parquet with ``isin`` and ``date``, where a company's group is isin % groups.

    Options: path (a URI or an absolute path that executors can open), groups (how many),
    columns (DDL without isin), first and last (ISO days).
    """

    day = "date"

    def __init__(self, options: dict):
        from pyarrow.fs import FileSystem

        path = options["path"]
        self._files, self._root = FileSystem.from_uri(path if "://" in path else "/" + path.removeprefix("file:").lstrip("/"))
        self.schema = "isin bigint, " + options["columns"]
        self._number, self._span = int(options["groups"]), (dt.date.fromisoformat(options["first"]), dt.date.fromisoformat(options["last"]))

    def __reduce__(self):
        return _restored, (self._files, self._root, self.schema, self._number, self._span)

    def groups(self) -> list[int]:
        from pyarrow.fs import FileSelector

        return [int(f.base_name.split("=")[1]) for f in self._files.get_file_info(FileSelector(self._root)) if f.base_name.startswith("group=")]

    def group_of(self, isin: int) -> int:
        return isin % self._number

    def span(self) -> tuple[dt.date, dt.date]:
        return self._span

    def read_group(self, group: int, companies: list[int] | None, first: dt.date, last: dt.date) -> Iterator:
        import pyarrow.dataset as ds

        rows = ds.dataset(f"{self._root}/group={group}", format="parquet", filesystem=self._files)
        chosen = (ds.field("date") >= first) & (ds.field("date") <= last)
        if companies is not None:
            chosen &= ds.field("isin").isin(companies)
        return (batch for batch in rows.to_batches(columns=["isin"] + [n for n in rows.schema.names if n != "isin"], filter=chosen) if len(batch))


def _restored(files: object, root: str, schema: str, number: int, span: tuple[dt.date, dt.date]) -> DailyFiles:
    made = DailyFiles.__new__(DailyFiles)
    made._files, made._root, made.schema, made._number, made._span = files, root, schema, number, span
    return made


def register(spark: SparkSession) -> None:
    """Makes the source known to a session, and its filters pushed down."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CompanyMonths)
