"""Whole profiles: named sections, each a lazy report, or all of them from shared passes."""

from .canary import canary
from .explore import explore
from .fused import fused
from .keylist import key_list_profile, validate_key_list
from .planner import Profile, canary_profile, explore_profile, long_report, scenario_profile
from .scenario import scenario

__all__ = [
    "Profile", "canary", "canary_profile", "explore", "explore_profile", "fused", "key_list_profile", "long_report", "scenario", "scenario_profile",
    "validate_key_list",
]
