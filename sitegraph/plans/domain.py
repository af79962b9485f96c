"""Maps the driver's tables to the domain tables; DOMAIN_SQL has the same tables for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence that an operator runs a store, as it arrived: several rows for a pair, in order of seq."""
    line, orders, part = (read(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    return (
        line.join(orders.withColumn("c_custkey", F.col("o_custkey")), F.expr("l_orderkey = o_orderkey")).join(part, F.expr("l_partkey = p_partkey"))
        .selectExpr(
            "cast(l_linenumber as int) as seq", "concat('Operator#', lpad(cast(c_custkey div 3 as string), 9, '0')) as operator_name", "l_orderkey as place_id", "p_brand as brand",
            "case when l_linenumber = 7 then 'direct' when l_returnflag = 'A' then 'franchisee' when l_returnflag = 'R' then 'franchisor' else 'unknown' end as operator_type",
            "case when l_linestatus = 'O' then 'chain_discovery' else 'per_store' end as discovered_via",
            "cast(1 - l_discount as decimal(4,2)) as confidence", "cast(l_tax as decimal(4,2)) as verification_score",
            "case when (c_custkey div 3) % 5 = 0 then '' else lpad(cast(c_custkey div 3 as string), 13, '0') end as corporate_number",
        )
    )


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer, nation = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    base = orders.join(customer, F.expr("o_custkey = c_custkey")).join(F.broadcast(nation), F.expr("c_nationkey = n_nationkey"))  # nation: 25 rows
    return base.selectExpr(
        "o_orderkey as place_id", "concat('Operator#', lpad(cast(c_custkey div 3 as string), 9, '0')) as operator_hint", "concat('Brand#', 1 + o_orderkey % 5, 1 + o_custkey % 5) as brand",
        "concat('Brand#', 1 + o_orderkey % 5, 1 + o_custkey % 5, ' ', n_name, ' #', o_orderkey % 97) as name",
        "30 + (o_orderkey * 37 % 1000) / 100.0D as lat", "130 + (o_orderkey * 91 % 1200) / 100.0D as lng", "n_name as prefecture",
        "concat(n_name, ' City', c_custkey % 20, ' Town', o_orderkey % 50, '-', o_orderkey % 9) as address",
        "case when o_orderkey % 4 = 0 then '' else concat('03-', 1000 + o_orderkey % 9000) end as phone",
        "case when o_orderkey % 3 = 0 then '' else concat('https://www.example', c_custkey % 40, '.com/s/', o_orderkey % 200) end as official_url",
        "cast(o_orderdate as date) as extracted_at",
    )


def judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").withColumn("c_custkey", F.col("o_custkey")).selectExpr(
        "o_orderkey as place_id", "case when o_orderstatus = 'O' then 1 else 0 end as is_franchise",
        "case o_orderstatus when 'F' then 'franchisee' when 'P' then 'direct' end as operation_type", "concat('Operator#', lpad(cast(c_custkey div 3 as string), 9, '0')) as operator_name",
        "case when o_custkey % 3 = 0 then '' else concat('F-', concat('Operator#', lpad(cast(c_custkey div 3 as string), 9, '0'))) end as franchisee_name", "cast((o_orderkey % 100) / 100.0 as decimal(4,2)) as confidence", "cast(o_orderdate as date) as judged_at",
    )


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, nation = read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation")
    return customer.where("c_custkey % 3 = 0").join(F.broadcast(nation), F.expr("c_nationkey = n_nationkey")).selectExpr(
        "lpad(cast(c_custkey div 3 as string), 13, '0') as corporate_number", "concat('Operator#', lpad(cast(c_custkey div 3 as string), 9, '0')) as name", "lower(replace(concat('Operator#', lpad(cast(c_custkey div 3 as string), 9, '0')), '#', '')) as normalized_name", "n_name as prefecture",
        "concat('City', c_custkey % 20) as city", "concat('Town', c_custkey % 50, '-', c_custkey % 9) as street", "case when c_custkey % 10 = 0 then '71' else '01' end as process",
    )


DOMAIN_SQL = """with arrivals as (
  select l_linenumber::int as seq, concat('Operator#', lpad((c_custkey // 3)::varchar, 9, '0')) as operator_name, l_orderkey as place_id, p_brand as brand,
    case when l_linenumber = 7 then 'direct' when l_returnflag = 'A' then 'franchisee' when l_returnflag = 'R' then 'franchisor' else 'unknown' end as operator_type,
    case when l_linestatus = 'O' then 'chain_discovery' else 'per_store' end as discovered_via,
    (1 - l_discount)::decimal(4,2) as confidence, l_tax::decimal(4,2) as verification_score,
    case when (c_custkey // 3) % 5 = 0 then '' else lpad((c_custkey // 3)::varchar, 13, '0') end as corporate_number
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join part on l_partkey = p_partkey),
operator_stores as (
  select operator_name, place_id, arg_min(brand, (seq, brand)) as brand, arg_min(operator_type, (seq, operator_type)) as operator_type, arg_min(discovered_via, (seq, discovered_via)) as discovered_via,
    max(confidence) as confidence, max(verification_score) as verification_score, max(corporate_number) as corporate_number
  from arrivals group by operator_name, place_id),
links as (
  select brand, operator_name, max(corporate_number) as corporate_number, count(distinct place_id) as estimated_store_count, min(operator_type) as operator_type,
    case when count(distinct place_id) % 2 = 0 then 'official' else 'pipeline' end as source
  from arrivals group by brand, operator_name),
stores as (
  select o_orderkey as place_id, concat('Operator#', lpad((c_custkey // 3)::varchar, 9, '0')) as operator_hint, concat('Brand#', 1 + o_orderkey % 5, 1 + o_custkey % 5) as brand,
    concat('Brand#', 1 + o_orderkey % 5, 1 + o_custkey % 5, ' ', n_name, ' #', o_orderkey % 97) as name,
    30 + (o_orderkey * 37 % 1000) / 100.0::double as lat, 130 + (o_orderkey * 91 % 1200) / 100.0::double as lng, n_name as prefecture,
    concat(n_name, ' City', c_custkey % 20, ' Town', o_orderkey % 50, '-', o_orderkey % 9) as address,
    case when o_orderkey % 4 = 0 then '' else concat('03-', 1000 + o_orderkey % 9000) end as phone,
    case when o_orderkey % 3 = 0 then '' else concat('https://www.example', c_custkey % 40, '.com/s/', o_orderkey % 200) end as official_url,
    o_orderdate::date as extracted_at
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey),
judgements as (
  select o_orderkey as place_id, case when o_orderstatus = 'O' then 1 else 0 end as is_franchise,
    case o_orderstatus when 'F' then 'franchisee' when 'P' then 'direct' end as operation_type, concat('Operator#', lpad((c_custkey // 3)::varchar, 9, '0')) as operator_name,
    case when o_custkey % 3 = 0 then '' else concat('F-', concat('Operator#', lpad((c_custkey // 3)::varchar, 9, '0'))) end as franchisee_name, ((o_orderkey % 100) / 100.0)::decimal(4,2) as confidence, o_orderdate::date as judged_at
  from orders join customer on o_custkey = c_custkey),
registry as (
  select lpad((c_custkey // 3)::varchar, 13, '0') as corporate_number, concat('Operator#', lpad((c_custkey // 3)::varchar, 9, '0')) as name, lower(replace(concat('Operator#', lpad((c_custkey // 3)::varchar, 9, '0')), '#', '')) as normalized_name, n_name as prefecture,
    concat('City', c_custkey % 20) as city, concat('Town', c_custkey % 50, '-', c_custkey % 9) as street, case when c_custkey % 10 = 0 then '71' else '01' end as process
  from customer join nation on c_nationkey = n_nationkey where c_custkey % 3 = 0)
"""
