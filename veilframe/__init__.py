"""Data governance over tables and streams of text, as Spark DataFrame transforms."""

from veilframe.operators.detect import detect
from veilframe.operators.policy import (
    AlertRule,
    AuditSettings,
    DetectionSettings,
    GovernancePolicy,
    OperatorSpec,
)
from veilframe.operators.recognizers import Recognizer, RecognizerRegistry
from veilframe.plans.protect import (
    analyze,
    anonymize,
    classify,
    explode_spans,
    scan_and_protect,
    split_by_size,
    with_spans,
)
from veilframe.sources.policy_file import load_policy, load_policy_or_default
from veilframe.sources.readers import read_texts

__all__ = [
    "AlertRule", "AuditSettings", "DetectionSettings", "GovernancePolicy", "OperatorSpec",
    "Recognizer", "RecognizerRegistry", "analyze", "anonymize", "classify", "detect",
    "explode_spans", "load_policy", "load_policy_or_default", "read_texts", "scan_and_protect",
    "split_by_size", "with_spans",
]
