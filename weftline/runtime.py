"""What a process needs around its plans: logging, an accelerator, seeds, and how a model is to be loaded."""

from __future__ import annotations

import importlib.util
import logging
import random
import re
from collections.abc import Callable

FOUR_BITS_FROM = 7.0  # billions of parameters


def logger(name: str) -> logging.Logger:
    """A logger below the package's own, which gets a handler once, unless the application has set one."""
    root = logging.getLogger("weftline")
    if not root.handlers and not logging.getLogger().handlers:
        handler = logging.StreamHandler()
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
        root.addHandler(handler)
        root.setLevel(logging.INFO)
    return logging.getLogger(name)


def device() -> str:
    """The best accelerator of this machine: cuda, mps, or cpu (also where no library for the others is at hand)."""
    if importlib.util.find_spec("torch") is None:
        return "cpu"
    import torch

    found = {"cuda": torch.cuda.is_available(), "mps": torch.backends.mps.is_available()}
    return next((name for name, there in found.items() if there), "cpu")


def seed_all(seed: int) -> None:
    """Seeds of the libraries that draw on a global state; the engine's own operators take seeds as arguments."""
    import numpy as np

    random.seed(seed)
    np.random.seed(seed % 2**32)
    if importlib.util.find_spec("torch") is not None:
        import torch

        torch.manual_seed(seed)


def model_options(name: str, on: str, can_quantise: bool = False) -> dict:
    """Full precision but on cuda; there half of it, and four bits for models of seven billion parameters or more."""
    if on != "cuda":
        return {"dtype": "float32"}
    sizes = [float(x) for x in re.findall(r"(?<![\w.])(\d+(?:\.\d+)?)b(?![a-z])", name.lower())]
    big = any(size >= FOUR_BITS_FROM for size in sizes)
    return {"dtype": "bfloat16", "device_map": "auto", **({"bits": 4, "quantisation": "nf4"} if big and can_quantise else {})}


class Models:
    """Models of a process, loaded once for a name and its options by ``load(name, options)``."""

    def __init__(self, load: Callable[[str, dict], object]) -> None:
        self._load = load
        self._held: dict[tuple, object] = {}

    def get(self, name: str, **options: object) -> object:
        key = (name, *sorted(options.items()))
        if key not in self._held:
            self._held[key] = self._load(name, options)
        return self._held[key]
