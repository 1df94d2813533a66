"""Registry of named queries with their SQL counterparts, and the shared fixtures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from respmosaic.plans.stable import materialise

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers ``fn(spark, sf_dir)`` under ``name``, with its SQL when there is one."""

    def keep(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


def r(c: Column | str, digits: int = 6) -> Column:
    """Rounded double without negative zero, as both engines print it."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.select(*[r(c, digits).alias(c) if c in columns else F.col(c) for c in df.columns])


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def fx_v(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as a response matrix: entity = vector, item = dimension."""
    e = table(spark, sf, "embeddings")
    return e.select(
        F.col("vec_id").alias("entity"), F.posexplode("embedding").alias("item", "value"), F.col("label").alias("grp"), (F.col("vec_id") % 2).alias("branch")
    ).select("entity", F.col("item").cast("long").alias("item"), F.col("value").cast("double").alias("value"), "grp", "branch")


def cell_missing() -> Column:
    return (F.col("entity") * 31 + F.col("item") * 17) % 23 == 0


def fx_vn(spark: SparkSession, sf: str) -> DataFrame:
    return fx_v(spark, sf).withColumn("value", F.when(~cell_missing(), F.col("value")))


def fx_big(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers x months: revenue in millions. Grows with the scale factor, has gaps."""
    li = table(spark, sf, "lineitem")
    month = (F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("long")
    revenue = F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))) / 1e6
    return materialise(li.groupBy(F.col("l_suppkey").alias("entity"), month.alias("item")).agg(revenue.alias("value")))


def fx_seq(spark: SparkSession, sf: str) -> DataFrame:
    from respmosaic.functions.text import computed, keep_letters

    d = table(spark, sf, "documents").select(F.col("doc_id").alias("item"), F.col("lang").alias("stratum"), F.col("source").alias("dataset"), F.col("text").alias("seq"))
    return computed(d, "seq", keep_letters("seq"))


def fx_items(spark: SparkSession, sf: str) -> DataFrame:
    from respmosaic.functions.text import gc_fraction

    s = fx_seq(spark, sf)
    return s.select("item", "stratum", "dataset", F.length("seq").cast("long").alias("length"), gc_fraction("seq").alias("gc"), "seq")


def fx_lab(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels").withColumnRenamed("doc_id", "item")
    return fx_items(spark, sf).join(labels, "item")


def entity_labels(v: DataFrame, column: str) -> DataFrame:
    return v.groupBy("entity").agg(F.first(column).alias("label"))


V = """v AS (SELECT vec_id AS entity, unnest(range(0, len(embedding)))::BIGINT AS item,
 unnest(embedding)::DOUBLE AS value, label AS grp, vec_id % 2 AS branch FROM embeddings)"""
VN = V + """, vn AS (SELECT entity, item, CASE WHEN (entity*31+item*17)%23 <> 0 THEN value END AS value, grp, branch FROM v)"""
BIG = """big AS (SELECT l_suppkey AS entity, (year(l_shipdate)*12+month(l_shipdate))::BIGINT AS item,
 sum(l_extendedprice*(1-l_discount))/1e6 AS value FROM lineitem GROUP BY 1,2)"""
SEQ = """s AS (SELECT doc_id AS item, lang AS stratum, source AS dataset,
 regexp_replace(upper(text),'[^ACGT]','','g') AS seq FROM documents)"""
ITEMS = SEQ + """, i AS (SELECT item, stratum, dataset, length(seq)::BIGINT AS length,
 CASE WHEN length(seq)>0 THEN length(regexp_replace(seq,'[^GC]','','g'))::DOUBLE/length(seq) ELSE 0.0 END AS gc, seq FROM s)"""
LAB = ITEMS + """, lab AS (SELECT i.*, l.quality, l.toxic FROM i JOIN labels l ON l.doc_id = i.item)"""


def fit_sql(src: str, out: str, by: tuple[str, ...] = (), clip: float | None = 0.02) -> str:
    """CTEs that clip and double-centre ``src(entity,item,value,*by)`` into ``out``."""
    keys = "".join(f"{b}, " for b in by)
    group = f"GROUP BY {', '.join(by)}" if by else ""
    use = lambda *cols: f"USING ({', '.join([*by, *cols])})"
    join_t = f"JOIN {out}_t {use()}" if by else f"CROSS JOIN {out}_t"
    if clip is None:
        head = f"{out}_c AS (SELECT {keys}entity, item, value FROM {src})"
    else:
        head = f"""{out}_t AS (SELECT {keys}quantile_cont(value, {clip}) AS threshold FROM {src} {group}),
 {out}_c AS (SELECT {keys}entity, item, CASE WHEN value IS NOT NULL THEN greatest(value, threshold) END AS value FROM {src} {join_t})"""
    return f"""{head},
 {out}_r AS (SELECT {keys}entity, avg(value) AS row_mean FROM {out}_c GROUP BY {keys}entity),
 {out}_x AS (SELECT {keys}entity, item, value - row_mean AS value FROM {out}_c JOIN {out}_r {use('entity')}),
 {out}_m AS (SELECT {keys}item, avg(value) AS col_mean FROM {out}_x GROUP BY {keys}item),
 {out} AS (SELECT {keys}entity, item, value - col_mean AS value FROM {out}_x JOIN {out}_m {use('item')})"""


def dist_sql(src: str, out: str, by: tuple[str, ...] = ()) -> str:
    """CTE ``out(*by, entity_i, entity_j, d)``: null-aware squared distances."""
    keys = "".join(f"a.{b}, " for b in by)
    same = "".join(f" AND a.{b} = b.{b}" for b in by)
    total = f"(SELECT {', '.join(by) + ', ' if by else ''}count(DISTINCT item) AS n FROM {src} {'GROUP BY ' + ', '.join(by) if by else ''})"
    on = " AND ".join(f"t.{b} = a.{b}" for b in by) or "true"
    return f"""{out} AS (SELECT {keys}a.entity AS entity_i, b.entity AS entity_j,
 sum((a.value-b.value)*(a.value-b.value)) * any_value(t.n) / nullif(count(a.value-b.value),0) AS d
 FROM {src} a JOIN {src} b ON a.item = b.item AND a.entity < b.entity{same} JOIN {total} t ON {on}
 GROUP BY {keys}a.entity, b.entity)"""
