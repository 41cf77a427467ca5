"""skewlens: representation and skew analysis of large record collections on Spark."""

from .operators.category import analyze_categories
from .operators.counts import case_cube, distribution, two_way
from .operators.features import engineer_features
from .operators.persistence import analyze_persistence
from .operators.representation import analyze_geography, chi_square, representation
from .operators.trends import analyze_trends, trend
from .operators.weapons import analyze_weapons
from .plans.audit import analyze_features, run_audit
from .session import configure, shared_folder

__all__ = [
    "analyze_categories", "analyze_features", "analyze_geography", "analyze_persistence", "analyze_trends",
    "analyze_weapons", "case_cube", "chi_square", "configure", "distribution", "engineer_features",
    "representation", "run_audit", "shared_folder", "trend", "two_way",
]
