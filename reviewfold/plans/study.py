"""The whole study as one lazy plan per question."""

from __future__ import annotations

from pyspark.sql import DataFrame

from reviewfold.operators import inference
from reviewfold.plans.inputs import Inputs


def ownership_effect(t: Inputs) -> DataFrame:
    """Do publicly and privately owned places differ in their negative rate?

    Reviews are counted per location, joined to the locations with the filled
    ownership, turned into rates and compared by a Welch test.
    """
    return inference.welch_test(t.owner_rates, "prob", "owner", "Public", "Private")
