"""Queries over the star schema: the relational surface that analysts reach through SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loamdex.plans.registry import query
from loamdex.session import table


def sql_over(spark, folder: str, names: str, text: str):
    """Run SQL over the named tables as views."""
    for name in names.split():
        table(spark, folder, name).createOrReplaceTempView(name)
    return spark.sql(text)


def money(name: str):
    return F.col(name).cast("decimal(18,2)")


_PRICE, _DISCOUNT, _TAX = (f"cast({c} as decimal(18, 2))" for c in ("l_extendedprice", "l_discount", "l_tax"))
Q1 = f"""
select l_returnflag, l_linestatus, cast(sum(l_quantity) as double) as sum_qty, cast(sum({_PRICE}) as double) as sum_base_price,
  cast(sum({_PRICE} * (1 - {_DISCOUNT})) as double) as sum_disc_price,
  cast(round(sum({_PRICE} * (1 - {_DISCOUNT}) * (1 + {_TAX})), 4) as double) as sum_charge,
  round(avg(l_quantity), 4) as avg_qty, round(avg(l_discount), 6) as avg_disc, count(*) as count_order
from lineitem where l_shipdate <= timestamp '1998-09-02 00:00:00' group by l_returnflag, l_linestatus
"""


@query("pricing_summary", Q1)
def pricing_summary(spark, folder):
    return sql_over(spark, folder, "lineitem", Q1)


@query(
    "revenue_by_nation",
    """select n_name, extract(year from o_orderdate)::int as year, cast(sum(l_extendedprice::decimal(18, 2) * (1 - l_discount::decimal(18, 2))) as double) as revenue, count(distinct o_orderkey) as orders
    from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey
    group by 1, 2""",
)
def revenue_by_nation(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    people = table(spark, folder, "customer").select("c_custkey", "c_nationkey").join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(people, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("n_name", F.year("o_orderdate").alias("year")).agg(
        F.sum(money("l_extendedprice") * (1 - money("l_discount"))).cast("double").alias("revenue"), F.countDistinct("o_orderkey").alias("orders")
    )


@query(
    "rollup_price",
    """select coalesce(p_brand, '*') as brand, coalesce(p_type, '*') as type, grouping(p_brand)::int as all_brands, grouping(p_type)::int as all_types,
    count(*) as parts, round(avg(p_retailprice), 4) as price from part group by rollup (p_brand, p_type)""",
)
def rollup_price(spark, folder):
    return table(spark, folder, "part").rollup("p_brand", "p_type").agg(
        F.grouping("p_brand").cast("int").alias("all_brands"), F.grouping("p_type").cast("int").alias("all_types"),
        F.count(F.lit(1)).alias("parts"), F.round(F.avg("p_retailprice"), 4).alias("price"),
    ).select(F.coalesce("p_brand", F.lit("*")).alias("brand"), F.coalesce("p_type", F.lit("*")).alias("type"), "all_brands", "all_types", "parts", "price")


@query(
    "cube_orders",
    """select coalesce(o_orderstatus, '*') as status, coalesce(o_orderpriority, '*') as priority, count(*) as orders
    from orders group by cube (o_orderstatus, o_orderpriority)""",
)
def cube_orders(spark, folder):
    cubed = table(spark, folder, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("orders"))
    return cubed.select(F.coalesce("o_orderstatus", F.lit("*")).alias("status"), F.coalesce("o_orderpriority", F.lit("*")).alias("priority"), "orders")


GROUPING = """
select coalesce(l_returnflag, '*') as flag, coalesce(l_linestatus, '*') as status, round(sum(l_quantity), 2) as quantity
from lineitem group by grouping sets ((l_returnflag), (l_linestatus), ())
"""


@query("grouping_sets", GROUPING)
def grouping_sets(spark, folder):
    return sql_over(spark, folder, "lineitem", GROUPING)


@query(
    "set_operations",
    """select 'both' as part, c_nationkey as nation from (select c_nationkey from customer intersect select s_nationkey from supplier)
    union all select 'customers only', c_nationkey from (select c_nationkey from customer except select s_nationkey from supplier)
    union all select 'either', c_nationkey from (select c_nationkey from customer union select s_nationkey from supplier)""",
)
def set_operations(spark, folder):
    buyers = table(spark, folder, "customer").select(F.col("c_nationkey").alias("nation"))
    sellers = table(spark, folder, "supplier").select(F.col("s_nationkey").alias("nation"))
    parts = {"both": buyers.intersect(sellers), "customers only": buyers.subtract(sellers), "either": buyers.union(sellers).distinct()}
    named = [df.select(F.lit(name).alias("part"), "nation") for name, df in parts.items()]
    return named[0].union(named[1]).union(named[2])


@query(
    "customers_without_orders",
    "select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey)",
)
def customers_without_orders(spark, folder):
    orders = table(spark, folder, "orders").select("o_custkey")
    return table(spark, folder, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query(
    "full_join_counts",
    """select coalesce(c.k, s.k) as nation, coalesce(c.n, 0) as customers, coalesce(s.n, 0) as suppliers
    from (select c_nationkey k, count(*) n from customer group by 1) c full join (select s_nationkey k, count(*) n from supplier group by 1) s on c.k = s.k""",
)
def full_join_counts(spark, folder):
    buyers = table(spark, folder, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("customers"))
    sellers = table(spark, folder, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("suppliers"))
    return buyers.join(sellers, "nation", "full").na.fill(0, ["customers", "suppliers"])


@query(
    "moving_totals",
    """select o_orderkey, round(sum(o_totalprice) over w, 2) as last_three, rank() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as dearest
    from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey rows between 2 preceding and current row)""",
)
def moving_totals(spark, folder):
    by_date = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(-2, 0)
    by_price = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, folder, "orders").select("o_orderkey", F.round(F.sum("o_totalprice").over(by_date), 2).alias("last_three"), F.rank().over(by_price).cast("long").alias("dearest"))


@query(
    "top_parts_per_supplier",
    """select l_suppkey, l_partkey, quantity, place from (select *, row_number() over (partition by l_suppkey order by quantity desc, l_partkey) as place
    from (select l_suppkey, l_partkey, sum(l_quantity) as quantity from lineitem group by 1, 2)) where place <= 3""",
)
def top_parts_per_supplier(spark, folder):
    sums = table(spark, folder, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("quantity"))
    place = F.row_number().over(Window.partitionBy("l_suppkey").orderBy(F.desc("quantity"), "l_partkey"))
    return sums.withColumn("place", place.cast("long")).filter("place <= 3")


@query(
    "as_of_orders",
    """select e.event_id, o.o_orderkey from events e asof join (select o_custkey, o_orderdate, max(o_orderkey) as o_orderkey from orders group by 1, 2) o
    on e.user_id = o.o_custkey and e.ts >= o.o_orderdate""",
)
def as_of_orders(spark, folder):
    """The order that each user had placed last before an event: both tables in one window, the last order carried on."""
    events = table(spark, folder, "events").select(F.col("user_id").alias("who"), F.col("ts"), "event_id", F.lit(None).cast("long").alias("o_orderkey"), F.lit(1).alias("late"))
    orders = table(spark, folder, "orders").select(F.col("o_custkey").alias("who"), F.col("o_orderdate").cast("timestamp_ntz").alias("ts"), F.lit(None).cast("long").alias("event_id"), "o_orderkey", F.lit(0).alias("late"))
    upto = Window.partitionBy("who").orderBy("ts", "late", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    both = events.unionByName(orders).withColumn("o_orderkey", F.last("o_orderkey", ignorenulls=True).over(upto))
    return both.filter("event_id is not null and o_orderkey is not null").select("event_id", "o_orderkey")


@query(
    "range_join_prices",
    """select p_partkey, count(*) as near from part join supplier on s_acctbal between p_retailprice - 5 and p_retailprice + 5 group by p_partkey""",
)
def range_join_prices(spark, folder):
    """Suppliers whose balance is within 5 of a part's price: buckets of width 10 make it an equi-join."""
    parts = table(spark, folder, "part").select("p_partkey", "p_retailprice")
    low, high = F.floor((F.col("p_retailprice") - 5) / 10), F.floor((F.col("p_retailprice") + 5) / 10)
    parts = parts.withColumn("bucket", F.explode(F.sequence(low, high)))
    sellers = table(spark, folder, "supplier").select("s_acctbal", F.floor(F.col("s_acctbal") / 10).alias("bucket"))
    near = parts.join(sellers, "bucket").filter("s_acctbal between p_retailprice - 5 and p_retailprice + 5")
    return near.groupBy("p_partkey").agg(F.count(F.lit(1)).alias("near"))


@query(
    "percentiles",
    """select o_orderpriority as priority, quantile_disc(o_totalprice, 0.5) as p50, quantile_disc(o_totalprice, 0.95) as p95, max(o_totalprice) as most, count(*) as n
    from orders group by 1""",
)
def percentiles(spark, folder):
    """Nearest-rank percentiles."""
    disc = lambda p: F.expr(f"percentile_disc({p}) within group (order by o_totalprice)")
    return table(spark, folder, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(
        disc(0.5).alias("p50"), disc(0.95).alias("p95"), F.max("o_totalprice").alias("most"), F.count(F.lit(1)).alias("n")
    )


@query(
    "pivot_status",
    """select o_orderpriority as priority, count(*) filter (o_orderstatus = 'F') as f, count(*) filter (o_orderstatus = 'O') as o, count(*) filter (o_orderstatus = 'P') as p
    from orders group by 1""",
)
def pivot_status(spark, folder):
    pivoted = table(spark, folder, "orders").groupBy(F.col("o_orderpriority").alias("priority")).pivot("o_orderstatus", ["F", "O", "P"]).count()
    return pivoted.select("priority", *[F.coalesce(F.col(c), F.lit(0)).alias(c.lower()) for c in ("F", "O", "P")])


@query(
    "unpivot_region",
    """select r_name, measure, value from (select r_name, count(distinct n_nationkey) as nations, count(c_custkey) as customers
    from region join nation on n_regionkey = r_regionkey left join customer on c_nationkey = n_nationkey group by 1)
    unpivot (value for measure in (nations, customers))""",
)
def unpivot_region(spark, folder):
    joined = table(spark, folder, "region").join(table(spark, folder, "nation"), F.col("r_regionkey") == F.col("n_regionkey"))
    joined = joined.join(table(spark, folder, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    wide = joined.groupBy("r_name").agg(F.countDistinct("n_nationkey").alias("nations"), F.count("c_custkey").alias("customers"))
    return wide.unpivot("r_name", ["nations", "customers"], "measure", "value")


@query(
    "recursive_regions",
    """with recursive walk as (select r_regionkey::bigint as id, r_name as path, 0 as depth from region
      union all select 1000 + n_nationkey, path || '/' || n_name, depth + 1 from walk join nation on n_regionkey = id and depth = 0)
    select id, path, depth from walk""",
)
def recursive_regions(spark, folder):
    return sql_over(
        spark, folder, "region nation",
        """with recursive walk(id, path, depth) as (select cast(r_regionkey as bigint), r_name, 0 from region
          union all select cast(1000 + n_nationkey as bigint), path || '/' || n_name, depth + 1 from walk join nation on n_regionkey = id and depth = 0)
        select id, path, depth from walk""",
    )


@query(
    "decimal_and_intervals",
    """select o_orderstatus as status, cast(sum(cast(o_totalprice as decimal(18, 2))) as double) as total,
    count(*) filter (o_orderdate >= timestamp '1995-01-01' and o_orderdate < timestamp '1995-01-01' + interval 6 month) as half_year from orders group by 1""",
)
def decimal_and_intervals(spark, folder):
    start = F.lit("1995-01-01").cast("timestamp")
    inside = (F.col("o_orderdate") >= start) & (F.col("o_orderdate") < start + F.expr("interval 6 months"))
    return table(spark, folder, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"), F.count_if(inside).alias("half_year")
    )


@query("lateral_lines", "select o_orderkey, l_linenumber, l_quantity from orders, lateral (select l_linenumber, l_quantity from lineitem where l_orderkey = o_orderkey order by l_quantity desc, l_linenumber limit 1)")
def lateral_lines(spark, folder):
    """The largest line of each order."""
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.max_by(F.struct("l_linenumber", "l_quantity"), F.struct("l_quantity", -F.col("l_linenumber"))).alias("l"))
    orders = table(spark, folder, "orders").select("o_orderkey")
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "l.l_linenumber", "l.l_quantity")
