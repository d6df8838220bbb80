"""Registered queries: importing the modules fills the registry."""


def load():
    from farepanel.plans import panel_views  # noqa: F401
    from farepanel.plans import (  # noqa: F401
        sources_q,
        columns_q,
        joins_q,
        aggregates_q,
        history_q,
        selection_q,
        metrics_q,
        audits_q,
        models_q,
        streaming_q,
    )
    from farepanel.plans.registry import ORACLE, QUERIES

    return QUERIES, ORACLE
