"""DataFrame -> DataFrame operators."""

from .features import address_features, day_night_feature, enrich, time_features, weekend_feature
from .geo import polygon_cells, polygon_table, with_neighborhood
from .joins import with_sun_times, with_weather
from .split import combine, key_bucket, split_by_key, split_random
from .weather import daily_weather

__all__ = [
    "address_features", "combine", "daily_weather", "day_night_feature",
    "enrich", "key_bucket", "polygon_cells", "polygon_table", "split_by_key", "split_random",
    "time_features", "weekend_feature", "with_neighborhood", "with_sun_times", "with_weather",
]
