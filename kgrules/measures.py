"""The measures of rules."""

from __future__ import annotations

SCHEMA = "rule_id int, rule string, support long, head_size long, head_support long, head_coverage double, body_size long, confidence double"
