"""Typed options of a run, with cross-field rules."""

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

PROTOCOLS = ("residue_to_class", "residue_to_value", "residues_to_class", "residues_to_value", "sequence_to_class", "sequence_to_value")


class ConfigError(ValueError):
    """A configuration that breaks a rule."""


def is_classification(protocol: str) -> bool:
    return protocol.endswith("class")


def is_per_residue(protocol: str) -> bool:
    """Whether there is a target for every residue."""
    return protocol.startswith("residue_")


def needs_residue_embeddings(protocol: str) -> bool:
    return protocol.startswith("residue")


@dataclass(frozen=True)
class Option:
    """One option: its type, default and constraints."""

    kind: type | tuple[type, ...]
    default: Any = None
    required: bool = False
    allowed: tuple = ()
    protocols: tuple[str, ...] = ()
    at_least: float | None = None
    at_most: float | None = None
    above: float | None = None
    below: float | None = None
    formats: tuple[str, ...] = ()
    check: Callable[[Any], str | None] | None = None
    multiple: bool = False  # a list of values is a hyper-parameter to search

    def problems(self, name: str, value: Any, protocol: str | None) -> list[str]:
        out = []
        if self.protocols and protocol not in self.protocols:
            out.append(f"{name} is not available for {protocol}")
        from ..operators.splits import parameter_values

        many = self.multiple and is_several(value)
        for v in parameter_values(value) if many else [value]:
            if not isinstance(v, self.kind) or isinstance(v, bool) and self.kind in (int, float):
                out.append(f"{name}: {v!r} has the wrong type")
                continue
            if self.allowed and v not in self.allowed:
                out.append(f"{name}: {v!r} is none of {self.allowed}")
            for limit, bad, what in ((self.at_least, lambda a, b: a < b, "at least"), (self.at_most, lambda a, b: a > b, "at most"),
                                     (self.above, lambda a, b: a <= b, "above"), (self.below, lambda a, b: a >= b, "below")):
                if limit is not None and bad(v, limit):
                    out.append(f"{name}: {v!r} must be {what} {limit}")
            if self.formats and not str(v).endswith(self.formats):
                out.append(f"{name}: {v!r} ends with none of {self.formats}")
            if self.check and (said := self.check(v)):
                out.append(f"{name}: {said}")
        return out


number = (int, float)
OPTIONS: dict[str, Option] = {
    "protocol": Option(str, required=True, allowed=PROTOCOLS),
    "input_file": Option(str, formats=(".fasta", ".fa")),
    "input_data": Option(object),
    "hf_dataset": Option(dict),
    "seed": Option(int, 42, at_least=0),
    "embedder_name": Option(str, "one_hot_encoding"),
    "embeddings_file": Option(str),
    "scaling_method": Option(str, "none", allowed=("none", "standard", "minmax")),
    "dimension_reduction_method": Option(str, allowed=("pca",), protocols=tuple(p for p in PROTOCOLS if not p.startswith("residue"))),
    "n_reduced_components": Option(int, above=0),
    "interaction": Option(str, allowed=("multiply", "concat"), protocols=tuple(p for p in PROTOCOLS if p.startswith("sequence"))),
    "model_choice": Option(str, "LogReg", multiple=True),
    "learning_rate": Option(number, 1e-3, above=0, multiple=True),
    "optimizer_choice": Option(str, "adam", allowed=("adam", "sgd"), multiple=True),
    "dropout_rate": Option(number, at_least=0, below=1, multiple=True),
    "bottleneck_dim": Option(int, at_least=4, multiple=True),
    "model_weights_init": Option(str, "default", allowed=("default", "normal", "xavier", "kaiming"), multiple=True),
    "num_epochs": Option(int, 200, above=0, multiple=True),
    "patience": Option(int, 10, at_least=0),
    "epsilon": Option(number, 0.001, above=0),
    "batch_size": Option(int, 128, above=0, multiple=True),
    "use_class_weights": Option(bool, False, protocols=tuple(p for p in PROTOCOLS if p.endswith("class"))),
    "limited_sample_size": Option(int, -1),
    "bootstrapping_iterations": Option(int, 30, at_least=0),
    "output_dir": Option(str),
    "auto_resume": Option(bool),
    "pretrained_model": Option(str),
    "use_half_precision": Option(bool),
    "ignore_file_inconsistencies": Option(bool, False),
}
CROSS_VALIDATION: dict[str, Option] = {
    "method": Option(str, "hold_out", allowed=("hold_out", "k_fold", "leave_p_out")),
    "k": Option(int, at_least=2), "repeat": Option(int, 1, above=0), "stratified": Option(bool, False), "nested": Option(bool, False), "nested_k": Option(int, at_least=2),
    "search_method": Option(str, allowed=("random_search", "grid_search")), "n_max_evaluations_random": Option(int, above=0),
    "p": Option(int, above=0), "choose_by": Option(str, "loss"),
}


@dataclass(frozen=True)
class Config:
    values: dict[str, Any] = field(default_factory=dict)
    cross_validation: dict[str, Any] = field(default_factory=dict)
    given: dict[str, Any] = field(default_factory=dict)  # what was set, without defaults

    def __getitem__(self, name: str) -> Any:
        return self.values[name]


def _checked(given: dict, options: dict[str, Option], protocol: str | None, where: str) -> tuple[dict, list[str]]:
    problems = [f"{where}{n}: unknown option" for n in given if n not in options]
    problems += [f"{where}{n} is missing" for n, o in options.items() if o.required and n not in given]
    for n, v in given.items():
        if n in options and v is not None:
            problems += options[n].problems(where + n, v, protocol)
    usable = {n: o.default for n, o in options.items() if not o.protocols or protocol in o.protocols}
    return usable | given, problems


def cross_rules(v: dict, cv: dict, given: dict, grid: bool, cv_given: dict) -> list[str]:
    """Rules that involve several options."""
    rules = (
        (sum(given.get(k) is not None for k in ("input_file", "input_data", "hf_dataset")) != 1, "exactly one of input_file, input_data and hf_dataset is needed"),
        (given.get("embedder_name") is not None and given.get("embeddings_file") is not None, "embedder_name and embeddings_file exclude each other"),
        ((v.get("dimension_reduction_method") is None) != (v.get("n_reduced_components") is None), "dimension_reduction_method and n_reduced_components need each other"),
        (cv["method"] == "k_fold" and cv.get("k") is None, "k_fold needs k"),
        (cv["method"] != "k_fold" and any(cv.get(x) for x in ("k", "nested", "nested_k", "stratified")), "k, stratified and nested belong to k_fold"),
        (cv["method"] == "leave_p_out" and cv.get("p") is None, "leave_p_out needs p"),
        (cv["method"] != "leave_p_out" and cv.get("p") is not None, "p belongs to leave_p_out"),
        (bool(cv.get("nested")) != (cv.get("nested_k") is not None), "nested and nested_k need each other"),
        (bool(cv.get("nested")) != (cv.get("search_method") is not None), "nested and search_method need each other"),
        (cv.get("search_method") == "random_search" and cv.get("n_max_evaluations_random") is None, "random_search needs n_max_evaluations_random"),
        (cv.get("search_method") != "random_search" and cv.get("n_max_evaluations_random") is not None, "n_max_evaluations_random belongs to random_search"),
        (bool(cv.get("nested")) and not grid, "nested cross-validation needs an option with several values"),
        (grid and not cv.get("nested"), "options with several values need nested cross-validation"),
        (bool(cv.get("stratified")) and v.get("protocol", "").startswith("residue_"), "stratified is for one target per sequence"),
        (cv["method"] in ("hold_out", "leave_p_out") and any(x in cv_given for x in ("repeat", "search_method", "n_max_evaluations_random")), f"{cv['method']} has no such options"),
        (bool(given.get("auto_resume")) and given.get("pretrained_model") is not None, "auto_resume and pretrained_model exclude each other"),
        (given.get("pretrained_model") is not None and cv["method"] != "hold_out", "pretrained_model is for hold_out"),
        (bool(given.get("auto_resume")) and given.get("output_dir") is None, "auto_resume needs output_dir"),
        (bool(given.get("use_half_precision")) and given.get("embeddings_file") is not None, "use_half_precision is for embeddings that are computed"),
        (needs_residue_embeddings(v["protocol"]) and v.get("dimension_reduction_method") is not None, "dimension_reduction_method is for one vector per sequence"),
        (not is_classification(v["protocol"]) and bool(cv.get("stratified")), "stratified is for classes; bin values first"),
    )
    return [text for broken, text in rules if broken]


def verified(given: dict) -> Config:
    """The configuration with defaults; raises ConfigError with everything that is wrong."""
    given = dict(given)
    cv_given = given.pop("cross_validation_config", None) or {}
    values, problems = _checked(given, OPTIONS, given.get("protocol"), "")
    cv, more = _checked(cv_given, CROSS_VALIDATION, given.get("protocol"), "cross_validation_config.")
    from ..operators.splits import parameter_values

    grid = any(o.multiple and n in given and len(parameter_values(given[n])) > 1 for n, o in OPTIONS.items())
    problems += more
    if not problems:
        problems = cross_rules(values, cv, given, grid, cv_given)
    if problems:
        raise ConfigError("; ".join(problems))
    from .models import chosen

    for name in parameter_values(values["model_choice"]):
        chosen(name, values["protocol"], given)
    return Config(values, cv, given)


def is_url(value: str) -> bool:
    return value.split("://", 1)[0] in ("http", "https", "ftp") and "://" in value


def is_several(value: Any) -> bool:
    """Whether an option stands for several values: a list, a range, or either as text."""
    return isinstance(value, (list, range)) or isinstance(value, str) and value.strip().startswith(("range(", "["))


def search_space(config: Config) -> dict:
    """The options with several values, and those values."""
    from ..operators.splits import parameter_values

    return {n: vs for n, o in OPTIONS.items() if o.multiple and len(vs := parameter_values(config.values.get(n))) > 1}


def read_config(path: str) -> Config:
    import yaml

    try:
        with open(path) as f:
            given = yaml.safe_load(f)
    except yaml.YAMLError as bad:
        raise ConfigError(f"{path} can't be read: {bad}") from bad
    if not isinstance(given, dict):
        raise ConfigError(f"{path} holds no options")
    return verified(given)
