"""Find, mask, restore and audit sensitive values in tables and streams of text."""

from veilspark.functions.patterns import CATEGORIES
from veilspark.functions.text import entropy
from veilspark.operators.restoring import restore
from veilspark.plans.scan import ScanResult, scan
from veilspark.sources.rules import Catalogue

__all__ = ["CATEGORIES", "Catalogue", "ScanResult", "entropy", "restore", "scan"]
