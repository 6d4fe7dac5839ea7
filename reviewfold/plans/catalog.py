"""Imports every module that registers queries."""

from reviewfold.plans import (  # noqa: F401
    columns_catalog,
    groups_catalog,
    models_catalog,
    rules_catalog,
    storage_catalog,
    text_catalog,
)
