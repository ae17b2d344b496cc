from daybook.operators import audience, cohort, engagement, history, revenue, spine, transitions  # noqa: F401
