"""Predicates over a symbol's own columns."""

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

from archgraph.functions.text import first_segment, is_test_path

# Decorators that mark a web endpoint, ignoring case.
API_DECORATOR = r"(?i)\.(route|get|post|put|delete|patch|websocket)\s*\(|@api_view|@action\b"

# Class-name endings of the service layer.
SERVICE_SUFFIXES = ("Service", "Repository", "Controller", "Manager", "Client", "Gateway", "Handler")

# Top-level packages that talk to a database.
DATABASE_PACKAGES = (
    "sqlalchemy", "django", "psycopg2", "pymongo", "redis", "sqlite3", "peewee",
    "tortoise", "asyncpg", "pymysql", "sqlmodel", "mongoengine", "sqlalchemy_utils",
)


def standard_library() -> list[str]:
    return sorted(sys.stdlib_module_names)


def is_api_endpoint(decorators: Column) -> Column:
    found = F.exists(decorators, lambda d: d.rlike(API_DECORATOR))
    return F.coalesce(found, F.lit(False))


def is_service_component(qualified_name: Column, symbol_type: Column) -> Column:
    segments = F.split(qualified_name, "[.]")
    owner = (
        F.when(symbol_type == "class", F.try_element_at(segments, F.lit(-1)))
        .when(symbol_type == "method", F.try_element_at(segments, F.lit(-2)))
    )
    return F.coalesce(owner.rlike(f"({'|'.join(SERVICE_SUFFIXES)})$"), F.lit(False))


def is_test(file_path: Column, name: Column) -> Column:
    return is_test_path(file_path) | name.startswith("test_")


def classify_import(dotted: Column, stdlib: list[str] | None = None) -> Column:
    """'database', 'external_service', or null for what is of no interest."""
    top = first_segment(dotted)
    known = standard_library() if stdlib is None else stdlib
    return (
        F.when(top.isin(*DATABASE_PACKAGES), F.lit("database"))
        .when(top.isin(*known) | (top == "") | top.startswith("_"), F.lit(None).cast("string"))
        .otherwise(F.lit("external_service"))
    )
