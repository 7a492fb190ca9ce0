"""Scalar functions on stated values."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from seatrace.functions import scalars


@pytest.mark.parametrize(
    "text, phrases, want",
    [
        ("Passenger, all ships of this type (60)", scalars.TYPE_PHRASES, "passenger"),
        ("Cargo, Reserved for future use (75)", scalars.TYPE_PHRASES, "cargo"),
        ("Tanker, No additional information (89)", scalars.TYPE_PHRASES, "tanker"),
        ("SAR aircraft, null", scalars.TYPE_PHRASES, "SAR aircraft"),
        ("Spare,  for assignment to local vessel. (56)", scalars.TYPE_PHRASES, "spare"),
        ("Not available or no ship, default", scalars.TYPE_PHRASES, ""),
        ("Under way\xa0using engine", scalars.STATUS_PHRASES, "under way using engine"),
        ("Undefined = default", scalars.STATUS_PHRASES, ""),
        ("", scalars.TYPE_PHRASES, ""),
        (None, scalars.TYPE_PHRASES, ""),
    ],
)
def test_clean_text(spark, text, phrases, want):
    assert spark.createDataFrame([(text,)], "s string").select(scalars.clean_text(F.col("s"), phrases)).first()[0] == want
