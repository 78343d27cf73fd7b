"""Cell files: YAML documents of cells and reports, and JSON scenes as VARIANT columns."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from periodica.operators.lattice import UnitCell

VERSION = "1"


def _ordered(v):
    """The type first, other keys sorted."""
    if isinstance(v, dict):
        keys = sorted(v, key=lambda k: (k != "type", k))
        return {k: _ordered(v[k]) for k in keys}
    return [_ordered(x) for x in v] if isinstance(v, (list, tuple)) else v


def dump_cells(cells: list[UnitCell], report: dict | None = None) -> str:
    """A YAML document of cells, with a report block if there is one; ranges are lists in it."""
    doc: dict = {"version": VERSION, "unit_cells": [_ordered(c.to_parametric()) for c in cells]}
    if report is not None:
        doc["report"] = _ordered({**report, "parameter_ranges": {k: list(v) for k, v in report.get("parameter_ranges", {}).items()}})
    return yaml.safe_dump(doc, sort_keys=False)


def load_document(text: str) -> tuple[list[UnitCell], dict | None]:
    """(cells, report or None). ValueError for another version."""
    doc = yaml.safe_load(text) or {}
    if doc.get("version") != VERSION:
        raise ValueError(f"unknown version {doc.get('version')!r}")
    report = doc.get("report")
    if report is not None:
        report = {**report, "parameter_ranges": {k: tuple(v) for k, v in report.get("parameter_ranges", {}).items()}}
    return [UnitCell.from_parametric(c) for c in doc.get("unit_cells", [])], report


CELL_SCHEMA = "file string, position int, cell string"


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """file, position, cell (JSON) of all YAML files of a path, through Spark's own file systems; a file is parsed by one task."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(f, i, json.dumps(c.to_parametric())) for f, t in zip(b.file, b.value, strict=True) for i, c in enumerate(load_document(t)[0])]
            yield pd.DataFrame(out, columns=["file", "position", "cell"])

    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    return files.select("file", "value").mapInPandas(rows, CELL_SCHEMA)


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        import glob
        import os

        found = sorted(glob.glob(os.path.join(self.path, "*.yaml"))) if os.path.isdir(self.path) else sorted(glob.glob(self.path))
        return [InputPartition(f) for f in found]

    def read(self, partition):
        with open(partition.value, encoding="utf-8") as f:
            cells, _ = load_document(f.read())
        for i, c in enumerate(cells):
            yield partition.value, i, json.dumps(c.to_parametric())


class _Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, rows):
        import os
        import uuid

        cells = [UnitCell.from_parametric(json.loads(r.cell)) for r in rows]
        if cells:
            os.makedirs(self.path, exist_ok=True)
            name = os.path.join(self.path, f"cells-{uuid.uuid4().hex}.yaml")
            with open(name + ".part", "w", encoding="utf-8") as f:
                f.write(dump_cells(cells))
            os.replace(name + ".part", name)
        return WriterCommitMessage()


class CellsYaml(DataSource):
    """format("cells_yaml"), for paths that every machine can open: one YAML document for each written partition."""

    @classmethod
    def name(cls):
        return "cells_yaml"

    def schema(self):
        return CELL_SCHEMA

    def reader(self, schema):
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"], overwrite)


def scene_types(cells: DataFrame) -> DataFrame:
    """Adds type (of the scene's root) and a1x, by paths into the parsed cell; unparsable cells give NULL."""
    v = F.try_parse_json("cell")
    return cells.withColumn("type", F.try_variant_get(v, "$.scene.type", "string")).withColumn("a1x", F.try_variant_get(v, "$.lattice.a1[0]", "double"))
