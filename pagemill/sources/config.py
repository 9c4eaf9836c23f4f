"""Settings: one frozen record; values from a mapping win over defaults, and three rules are checked."""

from __future__ import annotations

import json
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    vault_root: str
    raw_folder: str = "00-RAW"
    audit_folder: str = "99-Audit/OCR-Pending"
    archive_folder: str = "99-Archive"
    watch_delay_seconds: int = 5
    workers: int = 2
    confidence_threshold: float = 0.85
    skip_patterns: tuple[str, ...] = ("**/.*", "**/*.tmp")
    engines: dict[str, str] = field(default_factory=dict)
    math_key: str = ""
    enhance: bool = False
    adopt: bool = False
    adopt_margin: float = 0.30
    adopt_base_max: float = 0.55
    adopt_least: float = 0.90
    rebuild: bool = False
    rebuild_adopt: bool = True
    hit_min: float = 0.9
    fabricate_max: float = 0.05
    struct_min: float = 0.5


def read(path: str) -> dict:
    """The mapping in a YAML or JSON file; YAML needs PyYAML, without which only JSON is read."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.lower().endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        try:
            return json.loads(text)  # JSON is YAML
        except ValueError:
            raise ValueError(f"{path}: PyYAML is not installed, and this is not JSON") from e
    try:
        return yaml.safe_load(text) or {}
    except yaml.YAMLError as e:
        raise ValueError(f"{path}: {e}") from e


def load(config: dict | None) -> Settings:
    """Raises ValueError unless vault.root is set and the workers are a whole number of at least 1."""
    config = config or {}
    vault, run, ocr = (config.get(k) or {} for k in ("vault", "processing", "ocr"))
    table = ocr.get("table_structure") or {}
    if not vault.get("root"):
        raise ValueError("vault.root is required")
    workers = run.get("max_worker_threads", Settings.workers)
    if isinstance(workers, bool) or not isinstance(workers, int) or workers < 1:
        raise ValueError("processing.max_worker_threads must be a whole number of at least 1")
    given = {
        "raw_folder": vault.get("raw_folder"), "audit_folder": vault.get("audit_folder"), "archive_folder": vault.get("archive_folder"),
        "watch_delay_seconds": run.get("watch_delay_seconds"), "confidence_threshold": run.get("confidence_threshold"),
        "skip_patterns": tuple(run["skip_patterns"]) if "skip_patterns" in run else None, "engines": ocr.get("engines"), "math_key": ocr.get("mathpix_api_key"),
        "enhance": table.get("enhance_on_low_quality"), "adopt": table.get("enhance_adopt"), "adopt_margin": table.get("enhance_adopt_margin"),
        "adopt_base_max": table.get("adopt_sb_max"), "adopt_least": table.get("adopt_se_min"), "rebuild": table.get("region_rebuild"),
        "rebuild_adopt": table.get("region_rebuild_adopt"), "hit_min": table.get("rebuild_hit_min"), "fabricate_max": table.get("rebuild_fabricate_max"), "struct_min": table.get("rebuild_struct_min"),
    }
    return Settings(vault_root=vault["root"], workers=workers, **{k: v for k, v in given.items() if v is not None})
