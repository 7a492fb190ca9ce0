"""Queries without SQL do the whole job: all trees of the reference."""

from __future__ import annotations

import pytest

from seatrace.operators import learning
from seatrace.plans import registry

from .oracle import SF

SMALL = SF.replace("sf0.01", "sf0.001")


@pytest.mark.parametrize("kind, trees", [("rf", 100), ("gbt", 149)])
def test_trees_are_those_of_the_reference(spark, kind, trees, monkeypatch):
    asked = {}

    class Asked(Exception):
        pass

    def spy(*args, **options):
        asked.update(options)
        raise Asked

    monkeypatch.setattr(learning, "train_trees", spy)
    with pytest.raises(Asked):
        registry.queries()[f"train_{kind}"](spark, SMALL)
    assert asked["trees"] == trees
