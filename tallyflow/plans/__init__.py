from tallyflow.plans.hourly import hourly_report, notification, telemetry  # noqa: F401
