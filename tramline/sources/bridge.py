"""Sinks as plugins: a writer of Spark's data source interface that hands rows to a class named by the user."""

from __future__ import annotations

from importlib import import_module

from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


class Bridge:
    """What a plugin does. `validate` sees each row before `apply`; a row that it refuses is counted, not sent."""

    def __init__(self, options: dict):
        self.options = options

    def validate(self, row: dict) -> bool:
        return True

    def apply(self, row: dict) -> None:
        raise NotImplementedError

    def terminate(self) -> None:
        pass


class BridgeSource(DataSource):
    """`df.write.format("tramline_bridge").option("plugin", "module:Class")`; the rows of a task share one plugin."""

    @classmethod
    def name(cls) -> str:
        return "tramline_bridge"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options))


class _Writer(DataSourceWriter):
    def __init__(self, options: dict):
        if ":" not in options.get("plugin", ""):
            raise ValueError("the option plugin must be module:Class")
        self.options = options

    def write(self, rows) -> WriterCommitMessage:
        module, name = self.options["plugin"].split(":")
        plugin = getattr(import_module(module), name)(self.options)
        try:
            for row in rows:
                x = row.asDict(recursive=True)
                if plugin.validate(x):
                    plugin.apply(x)
        finally:
            plugin.terminate()
        return WriterCommitMessage()
