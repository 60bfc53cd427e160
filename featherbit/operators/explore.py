"""Seeded random search over option lists, resumable by name."""

from __future__ import annotations

import hashlib
import json
import random
from collections.abc import Callable


def draws(options: dict[str, list], seed: int = 0, attempts: int = 100, valid: Callable[[dict], bool] | None = None) -> list[dict]:
    """Distinct valid combinations from so many draws, in the order drawn."""
    rng, seen, out = random.Random(seed), set(), []
    for _ in range(attempts):
        one = {k: rng.choice(v) for k, v in sorted(options.items())}
        name = name_of(one)
        if name not in seen and (valid is None or valid(one)):
            seen.add(name)
            out.append(one)
    return out


def name_of(options: dict) -> str:
    return hashlib.md5(json.dumps(options, sort_keys=True).encode()).hexdigest()[:12]


def fits(one: dict) -> bool:
    """A target of over half the clauses can't be reached."""
    return "target" not in one or "clauses" not in one or one["target"] <= one["clauses"] / 2


def search(options: dict[str, list], run: Callable[[dict], float], done: dict[str, float] | None = None, seed: int = 0, attempts: int = 100) -> list[tuple[str, dict, float]]:
    """(name, options, score) of all draws, best first; names in ``done`` are not run again."""
    done = dict(done or {})
    out = []
    for one in draws(options, seed, attempts, fits):
        name = name_of(one)
        if name not in done:
            done[name] = run(one)
        out.append((name, one, done[name]))
    return sorted(out, key=lambda x: (-x[2], x[0]))


def paired(left: list[dict], right: list[dict]) -> list[tuple[dict, dict]]:
    """The i-th with the i-th, as far as both go."""
    return list(zip(left, right, strict=False))
