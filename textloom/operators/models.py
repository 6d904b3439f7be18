"""Models by name: what they are called, how wide they are, where their files lie."""

from __future__ import annotations

import json
import os

from ..config import hidden_dim
from ..errors import ModelError

#: Supported names and vector widths.
REGISTRY = {
    "intfloat/multilingual-e5-small": 384,
    "intfloat/multilingual-e5-base": 768,
    "intfloat/multilingual-e5-large": 1024,
    "intfloat/e5-small-v2": 384,
    "intfloat/e5-base-v2": 768,
    "intfloat/e5-large-v2": 1024,
}
FILES = ("model.onnx", "tokenizer.json", "config.json", "vocab_cache.bin")


def full_name(name: str) -> str:
    """Names with a slash and existing paths as they are; others belong to the default organisation."""
    return name if "/" in name or os.path.exists(name) else f"intfloat/{name}"


def complete(folder: str) -> bool:
    return all(os.path.isfile(p := os.path.join(folder, f)) and os.path.getsize(p) > 0 for f in FILES)


def resolve(name: str, model_dir: str) -> tuple[str, int]:
    """(folder, width) of a model: a local folder, or a supported name's folder below ``model_dir``.

    Nothing is downloaded; ship folders to executors with SparkContext.addFile or an image.
    """
    name = full_name(name)
    folder = name if os.path.isdir(name) else os.path.join(model_dir, name.replace("/", "--"))
    if not complete(folder):
        if name not in REGISTRY and not os.path.isdir(name):
            raise ModelError(f"unknown model {name}; known: {', '.join(REGISTRY)}")
        raise ModelError(f"{folder} lacks one of {', '.join(FILES)}")
    with open(os.path.join(folder, "config.json")) as f:
        return folder, hidden_dim(json.load(f), REGISTRY.get(name, 384))


def fresh(folder: str, wanted: dict, name: str = "artifact.json") -> bool:
    """Whether the artifact's recorded settings equal ``wanted``; else it must be built again."""
    try:
        with open(os.path.join(folder, name)) as f:
            return json.load(f) == wanted
    except (OSError, ValueError):
        return False


def record(folder: str, settings: dict, name: str = "artifact.json") -> None:
    with open(os.path.join(folder, name), "w") as f:
        json.dump(settings, f, sort_keys=True)
