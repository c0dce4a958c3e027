def load_queries():
    """All named queries; importing a module registers its own."""
    from lexfleet.plans import core, corpus_queries, file_queries, platform_queries, report_queries, tree_queries  # noqa: F401
    from lexfleet.plans.registry import QUERIES

    return dict(QUERIES)
