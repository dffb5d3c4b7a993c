"""Settings as ``key value`` lines; some can be loaded again while running."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

#: Settings that a reload may change.
RELOADABLE = frozenset(("print_rows", "parallel", "heavy_parallel", "use_statistics"))


@dataclass(frozen=True)
class EngineConfig:
    print_rows: int = 10
    parallel: int = 20
    heavy_parallel: int = 1
    use_statistics: bool = False
    shuffle_partitions: int = 0


def parse_config(text: str, base: EngineConfig | None = None, reload: bool = False) -> EngineConfig:
    """Lines that begin with # are comments; unknown keys and, on reload, fixed ones are errors."""
    known = {f.name: type(f.default) for f in fields(EngineConfig)}
    found: dict[str, int | bool] = {}
    for line in text.splitlines():
        words = line.split()
        if not words or words[0].startswith("#"):
            continue
        if len(words) != 2 or words[0] not in known:
            raise ValueError(f"not a setting: {line!r}")
        if reload and words[0] not in RELOADABLE:
            raise ValueError(f"{words[0]} can't change while running")
        found[words[0]] = known[words[0]](int(words[1]))
    return replace(base or EngineConfig(), **found)


def show_config(config: EngineConfig) -> str:
    return "\n".join(f"{f.name} {int(getattr(config, f.name))}" for f in fields(config))
