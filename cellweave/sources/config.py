"""Configuration files: YAML for reclassification and ramps, JSON for sources."""

from __future__ import annotations

import json

import yaml

from cellweave.operators.reclassify import Config, parse_config


def load_yaml(path: str) -> dict:
    """A YAML file whose top level is a mapping."""
    with open(path, encoding="utf-8") as file:
        try:
            found = yaml.safe_load(file)
        except yaml.YAMLError as error:
            raise ValueError(f"{path} is no YAML: {error}") from None
    if not isinstance(found, dict):
        raise ValueError(f"{path} must hold a mapping")
    return found


def load_reclass_config(path: str) -> Config:
    return parse_config(load_yaml(path))


def load_sources(path: str | None) -> dict:
    """File name to URL or to an object; nothing without a path."""
    if path is None:
        return {}
    with open(path, encoding="utf-8") as file:
        found = json.load(file)
    if not isinstance(found, dict):
        raise ValueError(f"{path} must hold an object")
    return found
