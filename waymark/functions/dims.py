"""Literal dimension tables: concerns, layers, prices, stages, priorities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The concern taxonomy in report order, with layers
CONCERNS = [
    ("BE-STRUCT", "backend"),
    ("BE-DEP", "backend"),
    ("BE-DOM", "backend"),
    ("BE-ERR", "backend"),
    ("BE-CONTRACT", "backend"),
    ("BE-ROUTE", "backend"),
    ("BE-SIZE", "backend"),
    ("BE-DUP", "backend"),
    ("BE-TEST", "backend"),
    ("FE-COM", "frontend"),
    ("FE-STATE", "frontend"),
    ("FE-ROUTE", "frontend"),
    ("FE-STYLE", "frontend"),
    ("FE-DATA", "frontend"),
    ("FE-COMM", "frontend"),
    ("FE-DUP", "frontend"),
    ("CROSS-EP", "cross-stack"),
    ("CROSS-TYPE", "cross-stack"),
    ("CROSS-PROP", "cross-stack"),
]

# A metric whose name lacks its concern, and metrics outside the taxonomy
CONCERN_OF_METRIC = {"BE-MOCK-M-001-mock-per-test-case": "BE-TEST"}
METRICS_OUTSIDE = ["BE-COVERAGE-M-001-test-coverage", "BE-TEST-M-001-test-coverage"]

# USD per million tokens
PRICES = [("codex", "estimated_gpt-5.3-codex_pricing", 1.75, 0.175, 14.0)]

# Layer pairs that must not import each other inside one module
FORBIDDEN_LAYERS = [
    ("controller", "controller"),
    ("controller", "repository"),
    ("service", "controller"),
    ("repository", "controller"),
    ("repository", "service"),
    ("entity", "controller"),
    ("entity", "service"),
    ("entity", "repository"),
]

# Deal stages, their old names and the moves between them
STAGES = ["lead", "qualified", "active", "negotiation", "closed_won", "closed_lost"]
OLD_STAGES = {"won": "closed_won", "lost": "closed_lost", "prospect": "lead", "proposal_sent": "negotiation"}
STAGE_MOVES = [
    ("lead", "qualified"),
    ("lead", "closed_lost"),
    ("qualified", "active"),
    ("qualified", "closed_lost"),
    ("active", "negotiation"),
    ("active", "closed_lost"),
    ("negotiation", "closed_won"),
    ("negotiation", "closed_lost"),
    ("closed_lost", "lead"),
]

# Order of the review queue by attribution; others come last with 9
REVIEW_PRIORITY = {
    "interface_unresolved": 0,
    "interface_contract_variance": 1,
    "test_harness_context": 2,
    "requirement_noncompliance_candidate": 3,
    "infrastructure_error": 4,
    "unclassified": 5,
}


def concerns(spark: SparkSession) -> DataFrame:
    """concern, layer, concern_order."""
    return spark.createDataFrame([(c, layer, i) for i, (c, layer) in enumerate(CONCERNS)], "concern string, layer string, concern_order int")


def stage_moves(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STAGE_MOVES, "from_stage string, to_stage string")


def forbidden_layers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FORBIDDEN_LAYERS, "from_layer string, to_layer string")


def prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRICES, "agent string, price_basis string, input double, cached double, output double")
