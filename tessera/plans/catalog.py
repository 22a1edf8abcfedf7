"""Every query of the library and the SQL that it is held against."""

from tessera.plans import evaluation_plans, join_plans, metric_plans, overlap_plans, report_plans, rule_plans, selection_plans, source_plans, table_plans, text_plans

MODULES = (overlap_plans, join_plans, metric_plans, evaluation_plans, table_plans, text_plans, selection_plans, report_plans, rule_plans, source_plans)
QUERIES = {name: f for m in MODULES for name, f in m.registry.queries.items()}
ORACLE = {name: sql for m in MODULES for name, sql in m.registry.oracle.items()}
