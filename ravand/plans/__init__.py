"""Query plans: every registered query and its SQL."""

CORE_MODULES = ["ravand.plans.data_queries", "ravand.plans.text_queries", "ravand.plans.interval_queries", "ravand.plans.signal_queries", "ravand.plans.manifest_queries", "ravand.plans.stats_queries", "ravand.plans.relational_queries"]
