from millrace.plans import queries  # noqa: F401
