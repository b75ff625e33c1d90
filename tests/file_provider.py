"""A provider for tests: days of made-up rows, and a note in a folder for each partition that is read."""

import datetime as dt
import pathlib


class Noted:
    schema, day = "isin string, date date, value int", "date"

    def __init__(self, options):
        self.folder = pathlib.Path(options["folder"])

    def companies(self):
        return ["A", "B", "C"]

    def span(self):
        return dt.date(2024, 1, 10), dt.date.fromisoformat((self.folder / "until").read_text())

    def read(self, isin, first, last):
        (self.folder / f"read-{isin}-{first}-{last}").touch()
        day = first
        while day <= last:
            yield isin, day, day.day
            day += dt.timedelta(1)
