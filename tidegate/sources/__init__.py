"""Connectors: where data comes from and goes to."""

from tidegate.sources.base import BaseConnector, Config, Connector, Health, ReadContext, Registry, WriteResult
from tidegate.sources.files import CsvConnector, JsonConnector, ParquetConnector
from tidegate.sources.tables import JdbcConnector, KafkaConnector, SqlConnector

__all__ = ["BaseConnector", "Config", "Connector", "CsvConnector", "Health", "JdbcConnector", "JsonConnector", "KafkaConnector", "ParquetConnector", "ReadContext", "Registry", "SqlConnector", "WriteResult", "default_registry"]


def default_registry() -> Registry:
    """All connectors; ``postgres`` is JDBC under that name."""
    return Registry([CsvConnector(), JsonConnector(), ParquetConnector(), SqlConnector(), JdbcConnector(), JdbcConnector("postgres", {"driver": "org.postgresql.Driver"}), KafkaConnector()])
