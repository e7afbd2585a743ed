"""Scan plan and registered queries."""


def __getattr__(name):
    # The registry is loaded on first use, so that importing a plan stays light.
    if name in ("QUERIES", "ORACLES"):
        from auditlake.plans import file_queries, finding_queries, posture_queries, repo_queries, settings_queries  # noqa: F401
        from auditlake.plans import registry
        return getattr(registry, name)
    raise AttributeError(name)
