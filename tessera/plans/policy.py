"""The review policy: defaults, then a file, then the environment. An unknown or mistyped key is refused.

A policy is data; the functions below turn it into the predicates and thresholds of triage, analyzers and gate, so a rule that it
switches off is not part of the plan. The keys security.block_on_high, block_on_medium, quality.block_empty_catches,
block_generic_exceptions, the gate's other score thresholds and the notifications are read for compatibility; they decide nothing.
"""

from __future__ import annotations

import json
import os
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame

from tessera.operators import code, rollup, scan

Policy = dict[str, dict[str, object]]

# Sections, keys and defaults.
DEFAULTS: dict[str, dict[str, object]] = {
    "triage": {"max_lines_for_auto": 10, "max_lines_for_quick": 50, "allow_only_comments": True, "allow_only_formatting": True, "allow_test_files": True, "skip_patterns": list(scan.SKIP), "manifest_patterns": list(scan.MANIFESTS)},
    "security": {"block_on_critical": True, "block_on_high": True, "block_on_medium": False, "banned_patterns": list(scan.BANNED[:4]), "secret_patterns": list(scan.BANNED[4:])},
    "quality": {"max_class_methods": 15, "max_function_lines": 100, "max_cyclomatic_complexity": 15, "min_duplicate_lines": 8, "enforce_srp": True, "enforce_dip": True, "block_empty_catches": True, "block_generic_exceptions": False},
    "performance": {"alert_on_n_squared": True, "alert_on_n_plus_one": True, "alert_on_memory_leak": True, "max_nested_loops": 3},
    "gate": {"blocking_severity": "critical", "quality_score_threshold": 60, "security_score_threshold": 70, "performance_score_threshold": 50, "fail_pipeline_on_critical": True, "fail_pipeline_on_quality_below": 50, "fail_on_review_error": False, "fail_pipeline_on_analysis_error": True, "notify_on_critical": True, "notify_channels": []},
}


def _typed(section: str, key: str, value: object) -> object:
    default = DEFAULTS[section][key]
    if isinstance(value, str) and not isinstance(default, str):
        value = json.loads(value.lower())
    if type(value) is not type(default):
        raise ValueError(f"{section}.{key} must be {type(default).__name__}, not {value!r}")
    if isinstance(value, list) and not all(isinstance(x, str) for x in value):
        raise ValueError(f"{section}.{key} must hold texts only")
    return value


def limits(policy: Policy) -> dict[str, int]:
    """The thresholds and switches of the code analyzers under a policy."""
    quality, performance = policy["quality"], policy["performance"]
    given = {
        "methods": quality["max_class_methods"], "lines": quality["max_function_lines"], "complexity": quality["max_cyclomatic_complexity"], "duplicate": quality["min_duplicate_lines"], "loops": performance["max_nested_loops"],
        "srp": quality["enforce_srp"], "dip": quality["enforce_dip"], "n_squared": performance["alert_on_n_squared"], "n_plus_one": performance["alert_on_n_plus_one"], "memory_leak": performance["alert_on_memory_leak"],
    }
    return code.LIMITS | {name: int(value) for name, value in given.items()}


def triage(changes: DataFrame, policy: Policy) -> DataFrame:
    """The triage of changes (path, diff) under a policy."""
    rules, security = policy["triage"], policy["security"]
    lenient = tuple(name for name in scan.LENIENT if rules[f"allow_{name}"])
    banned = (*security["banned_patterns"], *security["secret_patterns"])
    return scan.triage(changes, skip=rules["skip_patterns"], manifests=rules["manifest_patterns"], banned=banned, auto_lines=rules["max_lines_for_auto"], quick_lines=rules["max_lines_for_quick"], lenient=lenient)


def gate(reviews: DataFrame, findings: DataFrame, policy: Policy) -> DataFrame:
    """The gate of reviewed files (file_path, review, analysed) under a policy; see ``rollup.gate_reviews``."""
    rules = policy["gate"]
    return rollup.gate_reviews(
        reviews, findings, rules["blocking_severity"], rules["quality_score_threshold"], rules["fail_pipeline_on_quality_below"], critical_blocks=rules["fail_pipeline_on_critical"], tell_breaking=policy["security"]["block_on_critical"]
    )


def exit_code(outcome: Column, n_unanalysed: Column, n_failed: Column, n_blocking: Column, policy: Policy) -> Column:
    """0 or 1, by what the policy lets fail."""
    rules = policy["gate"]
    return rollup.exit_code(outcome, n_unanalysed, n_failed, n_blocking, rules["fail_pipeline_on_critical"], rules["fail_pipeline_on_analysis_error"], rules["fail_on_review_error"])


def load(path: str | None = None, environment: Mapping[str, str] = os.environ, prefix: str = "TESSERA_") -> Policy:
    """The policy as nested dictionaries. The environment's ``TESSERA_GATE__BLOCKING_SEVERITY`` sets gate.blocking_severity."""
    policy = {name: dict(keys) for name, keys in DEFAULTS.items()}
    given: dict = {}
    if path:
        import yaml

        with open(path, encoding="utf-8") as text:
            given = yaml.safe_load(text) or {}
    over = {tuple(k[len(prefix) :].lower().split("__", 1)): v for k, v in environment.items() if k.startswith(prefix) and "__" in k}
    for section, keys in given.items():
        if section not in DEFAULTS or not isinstance(keys, dict):
            raise ValueError(f"unknown section {section!r}")
        over = {(section, k): v for k, v in keys.items()} | over
    for (section, key), value in over.items():
        if section not in DEFAULTS or key not in DEFAULTS[section]:
            raise ValueError(f"unknown key {section}.{key}")
        policy[section][key] = _typed(section, key, value)
    return policy
