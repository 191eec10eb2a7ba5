"""The full enrichment of incident rows, as one lazily built plan.

time -> weekend -> address -> sun times + day/night -> weather -> neighbourhood.
Two broadcast joins with per-day tables and one broadcast join with the
polygon grid; everything else is projection.  The incident table is read once
and never shuffled.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame

from ..operators.features import (address_features, day_night_feature, enrich, time_features,
                                  weekend_feature)
from ..operators.geo import with_neighborhood
from ..operators.joins import with_weather
from ..schemas import DEFAULT_ZONE


def enrichment_steps(sun: DataFrame, weather: DataFrame, polygons: DataFrame,
                     zone: str = DEFAULT_ZONE, how: str = "inner", **geo_opts):
    return [
        partial(time_features, zone=zone),
        weekend_feature,
        address_features,
        partial(day_night_feature, sun=sun, how=how),
        partial(with_weather, weather=weather, how=how),
        partial(with_neighborhood, polygons=polygons, **geo_opts),
    ]


def enrich_incidents(incidents: DataFrame, sun: DataFrame, weather: DataFrame,
                     polygons: DataFrame, zone: str = DEFAULT_ZONE, how: str = "inner",
                     **geo_opts) -> DataFrame:
    """All features of the classifiers, added to every incident row."""
    return enrich(incidents, enrichment_steps(sun, weather, polygons, zone, how, **geo_opts))
