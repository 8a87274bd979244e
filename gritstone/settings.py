"""Settings of a run, read once on the driver."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields, replace

ORDERS = ("best_effort_bottom_up", "strict_bottom_up", "proposal_aware_bottom_up")
BUDGET_MODES = ("fast_low_requests", "free_key_balanced", "quality_strict")


@dataclass(frozen=True)
class Settings:
    # The defaults.
    provider: str = "gemini"
    model: str = "gemini-2.5-flash-preview-04-17"
    base_url: str = ""
    api_keys: tuple[str, ...] = ()
    timeout_sec: int = 60
    request_workers: int = 0
    naming_mode: str = "conservative"
    skip_named: bool = True
    use_pseudocode: bool = True
    prefix: str = ""
    min_insn: int = 5
    batch_size: int = 50
    rename_order: str = "best_effort_bottom_up"
    request_budget_mode: str = "free_key_balanced"
    strict_pause_for_review: bool = True
    strict_level_batch_size: int = 40
    proposal_level_batch_size: int = 50
    proposal_use_pending_child_names: bool = True
    proposal_propagate_child_confidence: bool = True
    max_ai_requests_per_run: int = 25
    warn_if_estimated_requests_above: int = 25
    max_functions_per_rename_run: int = 250
    target_functions_per_request: int = 40
    max_functions_per_request: int = 60
    min_functions_per_request: int = 8
    max_retry_requests_per_run: int = 5
    retry_batch_shrink_factor: int = 2
    review_mode: bool = True
    auto_apply_confidence: float = 0.85
    comment_only_below_confidence: float = 0.60
    require_evidence: bool = True
    enable_cache: bool = True
    cache_ttl_days: int = 90
    max_struct_fields: int = 24
    floss_min_length: int = 4
    spa_max_depth: int = 5
    spa_max_functions: int = 300
    spa_ai_function_limit: int = 80
    spa_include_named_funcs: bool = True
    spa_include_library_funcs: bool = False
    spa_min_priority_score: int = 3
    spa_child_summary_limit: int = 12
    spa_prompt_char_budget: int = 48000


def rename_order(value: str | None) -> str:
    value = str(value or "").strip().lower()
    return value if value in ORDERS else ORDERS[0]


def budget_mode(value: str | None) -> str:
    value = str(value or "").strip().lower()
    return value if value in BUDGET_MODES else "free_key_balanced"


def from_json(text: str) -> Settings:
    """Settings from a stored object: unknown fields are dropped, missing ones get defaults, a single old key becomes a list."""
    given = json.loads(text)
    if given.get("api_key") and not given.get("api_keys"):
        given["api_keys"] = [given["api_key"]]
    known = {f.name for f in fields(Settings)}
    settings = Settings(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items() if k in known})
    return replace(settings, rename_order=rename_order(settings.rename_order), request_budget_mode=budget_mode(settings.request_budget_mode))


def to_json(settings: Settings) -> str:
    return json.dumps({f.name: getattr(settings, f.name) for f in fields(Settings)}, sort_keys=True)


def request_size(settings: Settings, mode: str) -> int:
    """Functions per request in a mode, within the settings' bounds."""
    from .operators.graphs import dynamic_batch

    s = settings
    return dynamic_batch(mode, s.target_functions_per_request, s.max_functions_per_request, s.min_functions_per_request, s.strict_level_batch_size, s.proposal_level_batch_size)
