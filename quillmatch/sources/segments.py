"""A matcher built by hand, from segment files and added patterns.

A file is taken only once it has proved sound, so a missing or broken one
leaves the matcher as it was; a file is written only once its bytes have
proved to read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from quillmatch.functions.patterns import LARGEST_ID, Pattern
from quillmatch.operators.match import PatternSet, find_matches
from quillmatch.sources.index import SegmentError, pack, unpack
from quillmatch.sources.store import Store


def _place(path: str) -> tuple[str, str]:
    folder, _, name = path.rpartition("/")
    return folder or ".", name


class Matcher:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.clear()

    def clear(self) -> None:
        """Forget all patterns, segments, tombstones and the generation."""
        self._own: list[Pattern] = []
        self._segments: list[list[Pattern]] = []
        self._tombstones: frozenset[int] = frozenset()
        self.generation = 0

    def add_pattern(self, pattern_id: int, tokens: list[str | int]) -> None:
        pattern = Pattern.of(pattern_id, tokens)
        if pattern.tokens:
            self._own.append(pattern)

    def set_tombstones(self, ids: list[int]) -> None:
        """Hide these ids and no others; numbers beyond 32 bits are passed over."""
        self._tombstones = frozenset(i for i in ids if 0 <= i <= LARGEST_ID)

    def _read(self, path: str) -> list[Pattern] | None:
        folder, name = _place(path)
        try:
            return unpack(Store(self.spark, folder).read(name))
        except SegmentError:
            return None
        except Exception as error:
            if "FileNotFound" in str(error) or "NoSuchFile" in str(error) or "Is a directory" in str(error):
                return None
            raise

    def verify(self, path: str) -> bool:
        """Whether a file is a sound segment."""
        return self._read(path) is not None

    def attach(self, path: str) -> bool:
        """Add a segment file to what is there; False changes nothing."""
        found = self._read(path)
        if found is not None:
            self._segments.append(found)
        return found is not None

    def load(self, path: str) -> bool:
        """Replace everything by one segment file; False changes nothing."""
        found = self._read(path)
        if found is not None:
            self.clear()
            self._segments = [found]
        return found is not None

    def dump(self, path: str) -> bool:
        """Write the patterns added by hand; False leaves the file that is there."""
        data = pack(self._own, self.generation)
        try:
            if unpack(data) != self._own:
                return False
        except SegmentError:
            return False
        folder, name = _place(path)
        store = Store(self.spark, folder)
        store.make()
        store.replace(name, data)
        return True

    def patterns(self) -> PatternSet:
        return PatternSet([*self._segments, self._own], self._tombstones, self.generation)

    def find_matches(self, docs: DataFrame, text: Column, *keep: str) -> DataFrame:
        """Resolved matches of every text."""
        return find_matches(docs, self.patterns(), text, *keep)
