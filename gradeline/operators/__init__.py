"""DataFrame operators: joins, checks, metrics, resampling, models, calibration, fusion."""
