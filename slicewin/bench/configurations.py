"""Bench configurations: their JSON, and the small language of their windows."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from slicewin.operators.windows import CountTumbling, Session, Sliding, Tumbling
from slicewin.sources.generators import JavaRandom, session_gaps

#: Fixed value: the seed of drawn windows.
SEED = 10


def parse(text: str) -> list:
    """The windows of one expression.

    ``Sliding(size, slide)`` in milliseconds, ``Tumbling(size)`` and ``Session(gap)`` in seconds; drawn by a fixed seed:
    ``RandomSession(n, least, most)`` in whole seconds, ``randomTumbling(n, least, most)`` in seconds cut to milliseconds,
    ``randomCount(n, least, most)`` in rows.
    """
    found = re.fullmatch(r"\s*(\w+)\s*\(([\d\s,]*)\)\s*", text)
    if not found:
        raise ValueError(f"not a window: {text!r}")
    name, numbers = found[1], [int(x) for x in re.findall(r"\d+", found[2])]
    draw = JavaRandom(SEED)
    match name, numbers:
        case "Sliding", [size, slide]:
            return [Sliding(size, slide)]
        case "Tumbling", [size]:
            return [Tumbling(size * 1000)]
        case "Session", [gap]:
            return [Session(gap * 1000)]
        case "RandomSession", [n, least, most]:
            return [Session((least + draw.below(most - least)) * 1000) for _ in range(n)]
        case "randomTumbling", [n, least, most]:
            return [Tumbling(int((least + draw.share() * (most - least)) * 1000)) for _ in range(n)]
        case "randomCount", [n, least, most]:
            return [CountTumbling(int(least + draw.share() * (most - least))) for _ in range(n)]
    raise ValueError(f"not a window: {text!r}")


@dataclass(frozen=True)
class Configuration:
    name: str
    throughput: int
    runtime: int
    windows: list[list]
    plans: list[str] = field(default_factory=lambda: ["Slicing"])
    aggregates: list[str] = field(default_factory=lambda: ["Sum"])
    gaps: list[tuple[int, int]] = field(default_factory=list)

    @staticmethod
    def read(text: str) -> Configuration:
        raw = json.loads(text)
        gap = raw.get("sessionConfig")
        gaps = session_gaps(gap["gapCount"], 2 * 60 * 1000, gap["minGapTime"], gap["maxGapTime"]) if gap else []
        windows = [[w for e in each for w in parse(e)] for each in raw["windowConfigurations"]]
        return Configuration(raw.get("name", ""), raw["throughput"], raw["runtime"], windows, raw.get("configurations", ["Slicing"]), raw.get("aggFunctions", ["Sum"]), gaps)
