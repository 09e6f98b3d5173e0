"""The public face: the names that a user of the engine works with."""

from hemicycle.operators.flows import graph_links, link_statements, with_unclassified
from hemicycle.operators.linkage import cascade, ladder, nearest_in_time, rebalance, semantic_best, token_overlap
from hemicycle.operators.profiles import agreement, cohesion, compare, composite, consistency, pathways, profile, recency_profile
from hemicycle.operators.rows import top_categories, top_category
from hemicycle.operators.scoring import adapter_column, classify, explain_tfidf, register_adapter, score_items
from hemicycle.operators.stats import benjamini_hochberg, bootstrap_means, correlation, paired_tests, sign_flip_tests, split, stratified_sample
from hemicycle.session import get_session
from hemicycle.sources.archives import bulk_documents, reports, signatories, speeches, vote_rows, zip_members
from hemicycle.sources.tables import catalog_table, export_table, report, upsert
from hemicycle.streaming.incremental import process_new

__all__ = [
    "adapter_column", "agreement", "benjamini_hochberg", "bootstrap_means", "bulk_documents", "cascade", "catalog_table", "classify", "cohesion", "compare", "composite", "consistency", "correlation", "explain_tfidf", "export_table",
    "get_session", "graph_links", "ladder", "link_statements", "nearest_in_time", "paired_tests", "pathways", "process_new", "profile", "rebalance", "recency_profile", "register_adapter", "report", "reports", "score_items", "semantic_best",
    "sign_flip_tests", "signatories", "speeches", "split", "stratified_sample", "token_overlap", "top_categories", "top_category", "upsert", "vote_rows", "with_unclassified", "zip_members",
]
