"""The catalogue of a pattern index: generation, segments, tombstones.

Reading never fails: what is malformed is left out.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

VERSION = 1
FILE = "manifest.json"
LARGEST_GENERATION = 2**53 - 1


def _whole(x, least: int, most: int) -> bool:
    return isinstance(x, int) and not isinstance(x, bool) and least <= x <= most


@dataclass
class Segment:
    file: str
    checksum: str
    pattern_count: int


@dataclass
class Manifest:
    generation: int = 0
    segments: list[Segment] = field(default_factory=list)
    tombstones: list[int] = field(default_factory=list)

    @classmethod
    def parse(cls, data: bytes | str) -> Manifest:
        try:
            raw = json.loads(data)
        except ValueError:
            return cls()
        if not isinstance(raw, dict) or raw.get("format_version") != VERSION:
            return cls()
        out = cls(raw["generation"] if _whole(raw.get("generation"), 0, LARGEST_GENERATION) else 0)
        for s in raw["segments"] if isinstance(raw.get("segments"), list) else []:
            if isinstance(s, dict) and isinstance(s.get("file"), str) and s["file"] and "/" not in s["file"]:
                checksum, count = s.get("checksum"), s.get("pattern_count")
                out.segments.append(Segment(s["file"], checksum if isinstance(checksum, str) else "", count if _whole(count, 0, 2**53) else 0))
        out.add_tombstones([t for t in raw["tombstones"] if _whole(t, 0, 2**32 - 1)] if isinstance(raw.get("tombstones"), list) else [])
        return out

    def text(self) -> str:
        """Canonical, readable JSON."""
        data = {"format_version": VERSION, "generation": self.generation, "segments": [vars(s) for s in self.segments], "tombstones": self.tombstones}
        return json.dumps(data, indent=2, sort_keys=True) + "\n"

    def bump(self) -> int:
        self.generation += 1
        return self.generation

    def add_segment(self, file: str, checksum: str, pattern_count: int) -> None:
        self.segments.append(Segment(file, checksum, pattern_count))

    def set_segments(self, segments: list[Segment]) -> None:
        self.segments = list(segments)

    def add_tombstones(self, ids: list[int]) -> None:
        self.tombstones = list(dict.fromkeys([*self.tombstones, *ids]))

    def remove_tombstones(self, ids: list[int]) -> None:
        gone = set(ids)
        self.tombstones = [t for t in self.tombstones if t not in gone]

    def clear_tombstones(self) -> None:
        self.tombstones = []
