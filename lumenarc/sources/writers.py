"""Exports of tables and graphs; every writer is an ordinary distributed Spark write."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lumenarc.functions.text import escape_xml


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """SNK-1. Header, quotes doubled, null as an empty field."""
    df.select(*(columns or df.columns)).write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="", nullValue="")


def write_json(df: DataFrame, path: str) -> None:
    """SNK-2. One object a line."""
    df.write.mode("overwrite").json(path)


def graphml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """SNK-6. (section, id, line): 0 header, 1 nodes (id, name), 2 edges (id, person_id_1, person_id_2, connection_type), 3 footer; ordered by section and id they are a GraphML file."""
    spark, text = nodes.sparkSession, lambda c: F.col(c).cast("string")
    ends = spark.createDataFrame([(0, 0, '<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="name" for="node" attr.name="name" attr.type="string"/><key id="type" for="edge" attr.name="type" attr.type="string"/><graph edgedefault="undirected">'), (3, 0, "</graph></graphml>")], "section int, id long, line string")
    node = F.concat(F.lit('<node id="n'), text("id"), F.lit('"><data key="name">'), escape_xml(F.col("name")), F.lit("</data></node>"))
    edge = F.concat(F.lit('<edge id="e'), text("id"), F.lit('" source="n'), text("person_id_1"), F.lit('" target="n'), text("person_id_2"), F.lit('"><data key="type">'), escape_xml(F.col("connection_type")), F.lit("</data></edge>"))
    row = lambda df, n, line: df.select(F.lit(n).alias("section"), F.col("id").cast("long").alias("id"), line.alias("line"))
    return ends.unionByName(row(nodes, 1, node)).unionByName(row(edges, 2, edge))


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """SNK-6. Part files whose order of names is the order of lines."""
    graphml_lines(nodes, edges).repartitionByRange("section", "id").sortWithinPartitions("section", "id").select("line").write.mode("overwrite").text(path)
