"""Models by scene, from defaults and the environment."""

from __future__ import annotations

import os
from collections.abc import Mapping

#: Scenes and the kind of model they take.
SCENES = {"router": "light", "doc_grade": "normal", "rewrite": "light", "decompose": "light", "generate": "strong", "chat": "light", "judge": "strong", "caption": "vision", "embedding": "embedding", "rerank": "rerank"}
#: Parts of names of models that embed images.
NOT_TEXT = ("vl", "multimodal", "vision")


def model_for(scene: str, defaults: Mapping[str, str], environment: Mapping[str, str] | None = None) -> str:
    """``MODEL_<SCENE>`` of the environment, else the default of the scene, else of its kind."""
    env = os.environ if environment is None else environment
    if scene not in SCENES:
        raise KeyError(scene)
    return env.get(f"MODEL_{scene.upper()}") or defaults.get(scene) or defaults[SCENES[scene]]


def text_embedding_model(name: str) -> str:
    """The name itself; an error if it is of a model that embeds images."""
    if any(x in name.lower() for x in NOT_TEXT):
        raise ValueError(f"{name} isn't a text embedding model")
    return name
