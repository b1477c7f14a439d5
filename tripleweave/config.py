"""Run configurations: INI files of datasets, each a mapping and where its graph goes."""

from __future__ import annotations

import configparser
from dataclasses import dataclass
from pathlib import Path


@dataclass(frozen=True)
class Dataset:
    name: str
    mapping: str
    connection: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class RunConfig:
    datasets: tuple[Dataset, ...]
    output_folder: str
    remove_duplicates: bool = True
    all_in_one_file: bool = False
    name: str = "output"
    output_format: str = "n-triples"


def _yes(text: str) -> bool:
    return text.strip().lower() in ("yes", "true", "1", "on")


def load_config(path: str) -> RunConfig:
    """Keys that say how another engine holds its tables in memory (enrichment, ordered, large_file) are accepted and
    change nothing."""
    parser = configparser.ConfigParser(interpolation=configparser.ExtendedInterpolation())
    with open(path, encoding="utf-8") as f:
        parser.read_file(f)
    folder = Path(path).resolve().parent
    whole = parser["datasets"]
    place = lambda text: text if text.startswith("/") or "://" in text else str(folder / text)
    datasets = []
    for n in range(1, int(whole["number_of_datasets"]) + 1):
        part = parser[f"dataset{n}"]
        jdbc = tuple(sorted((k, part[o]) for o, k in (("url", "jdbcDSN"), ("driver", "jdbcDriver"), ("user", "username"), ("password", "password")) if part.get(o)))
        datasets.append(Dataset(part.get("name", f"dataset{n}"), place(part["mapping"]), jdbc))
    return RunConfig(tuple(datasets), place(whole["output_folder"]), _yes(whole.get("remove_duplicate", "yes")), _yes(whole.get("all_in_one_file", "no")), whole.get("name", "output"), whole.get("output_format", "n-triples").lower())
