from tidewatch.plans.registry import collect  # noqa: F401
