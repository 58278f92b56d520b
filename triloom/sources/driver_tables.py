"""The driver's Parquet tables seen as one graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .graphs import TableGraph, TableMap

#: Namespace of predicates and classes, and of subjects.
NS, ID = "urn:triloom:t#", "urn:triloom:"

#: Table, key column or columns, linked columns (column: (predicate, table linked to)), and about how many rows there are for one customer row.
_TABLES = [
    ("region", ["r_regionkey"], {}, 1e-3),
    ("nation", ["n_nationkey"], {"n_regionkey": ("n_region", "region")}, 1e-3),
    ("customer", ["c_custkey"], {"c_nationkey": ("c_nation", "nation")}, 1),
    ("supplier", ["s_suppkey"], {"s_nationkey": ("s_nation", "nation")}, 0.1),
    ("part", ["p_partkey"], {}, 1.3),
    ("orders", ["o_orderkey"], {"o_custkey": ("o_customer", "customer")}, 10),
    ("lineitem", ["l_orderkey", "l_linenumber"], {"l_orderkey": ("l_order", "orders"), "l_partkey": ("l_part", "part"), "l_suppkey": ("l_supplier", "supplier")}, 40),
    ("events", ["event_id"], {"user_id": ("user", "user")}, 7),
    ("documents", ["doc_id"], {}, 1),
    ("pages", ["page_id"], {}, 1),
    ("labels", ["doc_id"], {}, 1),
    ("benchmark", ["item_id"], {}, 0.1),
]


#: Schemas of tables that were opened, so that a query's plan costs no job to read them again.
_schemas: dict[str, StructType] = {}


def table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table."""
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def table_graph(spark: SparkSession, sf_dir: str, tables: list[str] | None = None) -> TableGraph:
    """A graph of the tables; every column is a predicate of its name, and keys and foreign keys are links."""
    maps = []
    for name, key, links, rows in _TABLES:
        if tables is not None and name not in tables:
            continue
        df = table(spark, f"{sf_dir}/{name}.parquet")
        if len(key) == 1:
            subject = key[0]
        else:
            subject = F.concat_ws("-", *key)
        predicates = {NS + c: c for c in df.columns}
        linked = {}
        for column, (predicate, target) in links.items():
            df = df.withColumn(f"{column}__link", F.col(column))
            predicates[NS + predicate] = f"{column}__link"
            linked[f"{column}__link"] = f"{ID}{target}/"
        # A line's key need not be unique in generated data, so it is not taken for one.
        maps.append(TableMap(df, f"{ID}{name}/", subject, predicates, linked, NS + name.capitalize(), True, rows * 1e6))
    return TableGraph(spark, maps)
