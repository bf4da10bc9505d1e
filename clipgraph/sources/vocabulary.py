"""Vocabulary files as a data source: categories, actions and attributes of a project.

A file is YAML or JSON with one or more of these parts::

    categories: [person, cup]
    actions:
      - {name: take_out, requires_source: true, requires_destination: false}
    attribute_vocab:
      color: [red, blue]

``spark.read.format("vocabulary").option("part", "action").load(path)`` gives one part as rows; ids are
places in the file. The file is checked as it is read, and one that is wrong raises ValueError.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from clipgraph.vocab import UNKNOWN

#: Parts with their key in the file and their schema.
PARTS = {
    "category": ("categories", "category string, category_id int"),
    "action": ("actions", "action string, action_id int, requires_source boolean, requires_destination boolean"),
    "attribute": ("attribute_vocab", "axis string, value string, axis_id int, value_id int"),
}


def parse(text: str) -> dict:
    """The file as a mapping; JSON needs no further library, YAML needs ``yaml``."""
    try:
        found = json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError as missing:
            raise ValueError("the vocabulary is no JSON, and YAML cannot be read without the yaml library") from missing
        try:
            found = yaml.safe_load(text)
        except yaml.YAMLError as wrong:
            raise ValueError(f"the vocabulary is neither JSON nor YAML: {wrong}") from wrong
    if not isinstance(found, dict):
        raise ValueError("a vocabulary is a mapping of parts")
    return found


def _names(values: object, what: str) -> list[str]:
    if not isinstance(values, list) or not values:
        raise ValueError(f"{what} must be a list with entries")
    for at, name in enumerate(values):
        if not isinstance(name, str) or not name.strip():
            raise ValueError(f"{what}: entry {at} is no name: {name!r}")
    doubled = sorted({n for n in values if values.count(n) > 1})
    if doubled:
        raise ValueError(f"{what}: {', '.join(doubled)} more than once")
    return values


def rows(vocabulary: dict, part: str) -> list[tuple]:
    """Rows of a part, checked: names are texts, not blank and there once; both flags of an action are true or false."""
    key, _ = PARTS[part]
    if key not in vocabulary:
        raise ValueError(f"the vocabulary has no part {key}")
    found = vocabulary[key]
    if part == "category":
        names = _names(found, key)
        if UNKNOWN in names:
            raise ValueError(f"{key}: {UNKNOWN} is added as the last one and cannot be listed")
        return [(n, i) for i, n in enumerate([*names, UNKNOWN])]
    if part == "action":
        if not isinstance(found, list) or not all(isinstance(a, dict) for a in found):
            raise ValueError(f"{key} must be a list of mappings")
        names = _names([a.get("name") for a in found], key)
        out = []
        for at, (name, entry) in enumerate(zip(names, found, strict=True)):
            flags = [entry.get(f"requires_{r}", False) for r in ("source", "destination")]
            if not all(isinstance(f, bool) for f in flags):
                raise ValueError(f"{key}: the flags of {name} must be true or false")
            out.append((name, at, *flags))
        return out
    if not isinstance(found, dict) or not found:
        raise ValueError(f"{key} must be a mapping of axes")
    axes = _names(list(found), key)
    return [(axis, value, i, j) for i, axis in enumerate(axes) for j, value in enumerate(_names(found[axis], f"{key}.{axis}"))]


class _Reader(DataSourceReader):
    """A vocabulary is small: one partition reads the file."""

    def __init__(self, path: str, part: str):
        self.path, self.part = path, part

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if "://" in self.path:
            from pyarrow import fs

            files, path = fs.FileSystem.from_uri(self.path)
            with files.open_input_stream(path) as stream:
                text = stream.read().decode()
        else:
            with open(self.path.removeprefix("file:"), encoding="utf-8") as file:
                text = file.read()
        try:
            yield from rows(parse(text), self.part)
        except ValueError as wrong:
            raise ValueError(f"{self.path}: {wrong}") from wrong


class VocabularySource(DataSource):
    """``spark.read.format("vocabulary")`` with the option ``part``: category, action or attribute."""

    @classmethod
    def name(cls) -> str:
        return "vocabulary"

    def _part(self) -> str:
        part = self.options.get("part", "category")
        if part not in PARTS:
            raise ValueError(f"unknown part {part}; known are {', '.join(PARTS)}")
        return part

    def schema(self) -> str:
        return PARTS[self._part()][1]

    def reader(self, schema) -> DataSourceReader:
        if "path" not in self.options:
            raise ValueError("the vocabulary needs a path")
        return _Reader(self.options["path"], self._part())


def load(spark: SparkSession, path: str, part: str) -> DataFrame:
    """One part of a vocabulary file on a path that every executor can read."""
    spark.dataSource.register(VocabularySource)
    return spark.read.format("vocabulary").option("part", part).load(path)


def attributes_of(loaded: DataFrame) -> dict[str, list[str]]:
    """A loaded attribute part as the mapping that attribute checks take; it is as large as the file."""
    out: dict[str, list[str]] = {}
    for axis, value in loaded.orderBy("axis_id", "value_id").select("axis", "value").collect():
        out.setdefault(axis, []).append(value)
    return out
