"""A PySpark engine for calibrated forecasts over panels of time series."""
