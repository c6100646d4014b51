"""Results of quantizers and indexes as a table, JSON lines or an HTML page."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "name string, accuracy double, recall double, mse double, compression_ratio double, silhouette_before double, silhouette_after double, ari_before double, ari_after double, seconds double"


@dataclass
class Report:
    rows: list[dict] = field(default_factory=list)

    def add(self, name: str, **values: float) -> Report:
        """One result; accuracy and recall are the same overlap of neighbours, so either fills both."""
        known = {f.split()[0] for f in SCHEMA.split(", ")}
        if unknown := set(values) - known:
            raise ValueError(f"unknown values {sorted(unknown)}")
        overlap = values.get("recall", values.get("accuracy"))
        self.rows.append({"name": name, **values, "accuracy": overlap, "recall": overlap})
        return self

    def table(self, spark: SparkSession) -> DataFrame:
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        cells = [tuple(r.get(n) if n == "name" or r.get(n) is None else float(r[n]) for n in names) for r in self.rows]
        return spark.createDataFrame(cells, SCHEMA)

    def write_json(self, spark: SparkSession, path: str) -> None:
        self.table(spark).write.json(path)

    def html(self, spark: SparkSession, title: str = "Quantizers") -> str:
        from html import escape

        body = self.table(spark).orderBy("name").toPandas().to_html(index=False, na_rep="", float_format=lambda x: f"{x:.4f}")  # a row a result
        return f"<!doctype html><meta charset=utf-8><title>{escape(title)}</title><h1>{escape(title)}</h1>{body}"
