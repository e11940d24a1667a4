"""Papyra: document analytics on Spark. Filters, expressions and pipeline stages compile to DataFrame plans."""

from papyra.collection import Collection, Database, connect, create_connection
from papyra.plans.pipeline import Pipeline, aggregate
from papyra.plans.query import Query
from papyra.schema import Field, Schema, ValidationError
from papyra.session import configure
from papyra.streaming import stream, stream_into

__version__ = "0.1.0"
__all__ = ["Collection", "Database", "Field", "Pipeline", "Query", "Schema", "ValidationError", "aggregate", "configure", "connect", "create_connection", "stream", "stream_into"]
