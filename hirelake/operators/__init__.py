"""DataFrame operators: metrics, KPIs, validation, keys, throttling."""
