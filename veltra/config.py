"""Run configuration: YAML in, a typed object out, with checks."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields


class ConfigError(ValueError):
    def __init__(self, message: str, where: str | None = None, suggestions: list[str] | None = None):
        super().__init__(message)
        self.where, self.suggestions = where, suggestions or []


# Keys and their defaults.
@dataclass
class RunConfig:
    name: str = "demo_run"
    output_dir: str = "outputs/demo_run"
    seed: int | None = 42
    verbose: bool = True
    input_type: str = "vcf"
    vcf_path: str = ""
    phenotype_path: str = ""
    pathway_db: str = ""
    expression_path: str = ""
    expression_input_type: str = "tpm"
    expression_scoring_method: str = "ssgsea"
    ssgsea_alpha: float = 0.25
    n_clusters: int | None = None
    n_clusters_range: list[int] = field(default_factory=lambda: [2, 8])
    ancestry_pcs_path: str | None = None
    ancestry_correction: str | None = None
    ancestry_n_pcs: int = 10
    validation_run_gates: bool = True
    validation_n_permutations: int = 100
    validation_n_bootstrap: int = 50
    validation_stability_threshold: float | None = None
    validation_null_ari_max: float | None = None
    validation_calibrate: bool = True
    validation_alpha: float = 0.05
    variant_qc_enabled: bool = False
    variant_qc_min_qual: float = 30.0
    variant_qc_min_call_rate: float = 0.9
    variant_qc_hwe_p_threshold: float = 1e-6
    variant_qc_max_maf: float = 0.01
    disclaimer: str = "Research use only."


#: Sections whose keys carry the section's name in RunConfig; the others' keys are fields as they are.
PREFIXED = ("ancestry", "validation", "variant_qc")
PLAIN = ("pipeline", "data", "clustering", "output")
# What may stand in the fields.
CHOICES = {
    "input_type": ("vcf", "expression"),
    "expression_input_type": ("counts", "tpm", "fpkm", "log2"),
    "expression_scoring_method": ("ssgsea", "gsva", "mean_z"),
    "ancestry_correction": (None, "regress_out", "covariate_aware", "stratified"),
}


def load_yaml(path: str) -> dict:
    import yaml

    if not os.path.exists(path):
        raise FileNotFoundError(f"no configuration at {path}")
    with open(path) as f:
        loaded = yaml.safe_load(f)
    if not isinstance(loaded, dict):
        raise ConfigError("the configuration is empty or no mapping", suggestions=["check the YAML and its indentation"])
    return loaded


def typed(config: dict) -> RunConfig:
    """Sections flattened; unknown keys are left out."""
    known = {f.name for f in fields(RunConfig)}
    values = {}
    for section in PLAIN:
        values.update({k: v for k, v in (config.get(section) or {}).items() if k in known})
    for section in PREFIXED:
        values.update({f"{section}_{k}": v for k, v in (config.get(section) or {}).items() if f"{section}_{k}" in known})
    return RunConfig(**values)


def validate(config: dict, check_files: bool = True) -> RunConfig:
    for section in ("pipeline", "data"):
        if section not in config:
            raise ConfigError(f"no section {section}", section, [f"add '{section}:'"])
    run = typed(config)
    for name, allowed in CHOICES.items():
        if getattr(run, name) not in allowed:
            raise ConfigError(f"{name} is {getattr(run, name)!r}", name, [f"one of {', '.join(map(str, allowed))}"])
    needed = ["pathway_db", "vcf_path" if run.input_type == "vcf" else "expression_path"]
    for name in needed:
        if not getattr(run, name):
            raise ConfigError(f"{name} is missing", f"data.{name}")
    for name in [*needed, "phenotype_path", "ancestry_pcs_path"]:
        path = getattr(run, name)
        if check_files and path and "://" not in path and not os.path.exists(path):
            raise ConfigError(f"{name}: no file {path}", name)
    low, high = run.n_clusters_range
    if not 2 <= low <= high or (run.n_clusters is not None and run.n_clusters < 2):
        raise ConfigError("clusters: at least 2, and the range rises", "clustering")
    for name in ("validation_alpha", "variant_qc_min_call_rate", "variant_qc_max_maf", "variant_qc_hwe_p_threshold"):
        if not 0 <= getattr(run, name) <= 1:
            raise ConfigError(f"{name} is not between 0 and 1", name)
    for name in ("validation_n_permutations", "validation_n_bootstrap", "ancestry_n_pcs"):
        if getattr(run, name) < 1:
            raise ConfigError(f"{name} is under 1", name)
    return run
