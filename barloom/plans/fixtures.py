"""Market relations derived from the star-schema test tables.

Each relation is one SELECT that Spark and the oracle share but for a few function names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SPARK = {"string": "string", "min_by": "min_by", "max_by": "max_by", "days": "date_add({0}, cast({1} as int))"}
ORACLE = {"string": "varchar", "min_by": "arg_min", "max_by": "arg_max", "days": "({0} + cast({1} as integer))"}

_SYMBOL = "concat('S', lpad(cast({0} as <string>), 4, '0'))"
_WEEK = "cast(date_trunc('week', l_shipdate) as date)"
#: (tables, text); <name> is replaced by the engine's word, {table} by the table.
RELATIONS: dict[str, tuple[tuple[str, ...], str]] = {
    "bars": (
        ("lineitem",),
        f"""select {_SYMBOL.format("l_suppkey")} as symbol, {_WEEK} as date,
       <min_by>(px, ord) as open, max(px) as high, min(px) as low, <max_by>(px, ord) as close,
       cast(sum(l_quantity) as bigint) as volume,
       cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as traded_value, count(*) as trades
from (select *, l_extendedprice / l_quantity as px,
             row_number() over (partition by l_suppkey, date_trunc('week', l_shipdate)
                 order by l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) as ord
      from {{lineitem}}) group by 1, 2""",
    ),
    "sectors": (
        ("supplier", "nation", "region"),
        f"""select 'all' as index_name, {_SYMBOL.format("s_suppkey")} as symbol, s_name as name,
       case when s_suppkey % 10 = 9 then null else r_name end as industry, cast(null as <string>) as isin
from {{supplier}} join {{nation}} on s_nationkey = n_nationkey join {{region}} on n_regionkey = r_regionkey""",
    ),
    "filings": (
        ("supplier",),
        f"""select {_SYMBOL.format("s_suppkey")} as symbol, <days:date '1996-01-01'|(s_suppkey * 37 + g * 61) % 250 * 7> as ex,
       case (s_suppkey + g) % 12 when 0 then 'Bonus 1:1'
         when 1 then 'Face Value Split (Sub-Division) - From Rs 10/- Per Share To Rs 2/- Per Share'
         when 2 then 'Dividend - Rs 5 Per Share' when 3 then 'Bonus 1 : 1250'
         when 4 then 'Bonus 1:1 / Face Value Split From Rs 10 To Rs 2' when 5 then 'Bonus 1 : 2'
         when 6 then 'Face Value Split - From Rs 10/- Per Equity Share To Rs 2/- Per Equity Share'
         when 7 then 'Sub-Division From Rs.10/- Each To Re.1/- Each' when 8 then 'Stock  Split From Rs 10 Per Unit To Re 1 Per Unit'
         when 9 then 'Face Value Split Rs 10 (Ten) To Rs 2 (Two)' when 10 then 'Bonus Debentures 1:1'
         else 'Consolidation From Rs 1 To Rs 10' end as subject, g
from {{supplier}} cross join (values (0), (1), (2)) t(g)""",
    ),
    "index_bars": (
        ("lineitem", "supplier", "nation", "region"),
        f"""select index_name, date, close * 0.99e0 as open, close * 1.02e0 as high, close * 0.97e0 as low, close
from (select coalesce(r_name, 'ALL') as index_name, date, cast(ext as double) / cast(qty as double) as close
from (select r_name, date, sum(ext) as ext, sum(qty) as qty from (
        select r_name, {_WEEK} as date, cast(l_extendedprice as decimal(18,2)) as ext, cast(l_quantity as decimal(18,2)) as qty
        from {{lineitem}} join {{supplier}} on l_suppkey = s_suppkey
        join {{nation}} on s_nationkey = n_nationkey join {{region}} on n_regionkey = r_regionkey)
      group by grouping sets ((r_name, date), (date))))""",
    ),
    "flows": (
        ("orders",),
        """select cast(o_orderdate as date) as date,
       case o_orderstatus when 'F' then 'FII/FPI *' when 'O' then 'DII **' else 'dii' end as category,
       cast(sum(case when o_orderkey % 2 = 0 then cast(o_totalprice as decimal(18,2)) else 0 end) as <string>) as buy,
       cast(sum(case when o_orderkey % 2 = 1 then cast(o_totalprice as decimal(18,2)) else 0 end) as <string>) as sell,
       cast(sum(case when o_orderkey % 2 = 0 then cast(o_totalprice as decimal(18,2)) else -cast(o_totalprice as decimal(18,2)) end) as <string>) as net
from {orders} where o_orderstatus in ('F', 'O') group by 1, 2""",
    ),
    "trend": (
        ("lineitem", "supplier"),
        f"""select symbol, date, close * 0.995e0 as open, close * 1.001e0 as high, close * 0.98e0 as low, close, cast(1000 + n % 7 as bigint) as volume,
       close * 1000e0 as traded_value, cast(1 as bigint) as trades
from (select {_SYMBOL.format("s_suppkey")} as symbol, date, n, cast(case s_suppkey % 4 when 0 then 100 + n * 2 when 1 then case when n < 60 then 1500 - n else 100 + n * 3 end
         when 2 then case when n = 346 then 520 when n > 351 then 480 + (n - 352) * 7 else 480 end else 1000 - n end as double) as close
      from (select date, cast(row_number() over (order by date) - 1 as int) as n from (select distinct {_WEEK} as date from {{lineitem}})) cross join {{supplier}})""",
    ),
    "series": (
        ("lineitem",),
        """select concat('L', cast(l_suppkey % 3 as <string>)) as symbol, cast(row_number() over (partition by l_suppkey % 3
       order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity) as bigint) as n, l_extendedprice / l_quantity as close from {lineitem}""",
    ),
    "log": (
        ("events",),
        """select ts, event_type as job, cast(ts as date) as date, case when value > 50 then 'ok' else 'empty' end as status, cast(event_id as <string>) as detail from {events}""",
    ),
    "watch": (("supplier",), f"select {_SYMBOL.format('s_suppkey')} as symbol from {{supplier}} where s_suppkey % 7 = 3"),
    "news": (
        ("events",),
        f"""select event_id as id, {_SYMBOL.format("user_id % 120")} as symbol, event_type as title, value / 100 - 0.5 as sentiment,
       ts as published_at, cast(event_id % 9973 as bigint) as fetched_at from {{events}}""",
    ),
}


def _words(text: str, words: dict[str, str]) -> str:
    import re

    def swap(m: re.Match) -> str:
        name, _, args = m.group(1).partition(":")
        return words[name].format(*args.split("|")) if args else words[name]

    return re.sub(r"<([a-z_]+(?::[^>]*)?)>", swap, text)


def oracle(name: str) -> str:
    """The relation in the oracle's SQL, over views of the tables' names."""
    tables, text = RELATIONS[name]
    return _words(text, ORACLE).format(**{t: t for t in tables})


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables, text = RELATIONS[name]
    return spark.sql(_words(text, SPARK), **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})
