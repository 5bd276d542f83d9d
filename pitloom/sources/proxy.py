"""Raw market tables made from the star schema: suppliers as securities, ship weeks as trade days.

The mapping is deterministic; money is summed as decimals, so that results don't depend on order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lake import UniverseRules

#: Settings that fit weekly bars.
RULES = UniverseRules(ipo_min_trade_days=12, liquidity_window=20, min_valid_trade_days=10, min_median_amount=40000.0, markets=("M0", "M1", "M2", "M3"))
WINDOW, LEAST = 52, 26


def _code(key: str):
    suffix = F.when(F.col(key) % 2 == 0, F.lit(".SH")).otherwise(F.lit(".SZ"))
    return F.concat(F.lit("S"), F.lpad(F.col(key).cast("string"), 6, "0"), suffix)


def _text(date) -> F.Column:
    return F.date_format(date, "yyyyMMdd")


def _money(c):
    return c.cast("decimal(18,2)")


class Proxy:
    """Lazy raw tables by name. keep(name, build) may write what several of them are made from."""

    def __init__(self, spark: SparkSession, sf_dir: str, keep: Callable[[str, Callable[[], DataFrame]], DataFrame] = lambda name, build: build()) -> None:
        self._keep = keep
        read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
        self._supplier, self._nation, self._region, self._lineitem, self._orders = map(read, ("supplier", "nation", "region", "lineitem", "orders"))

    def _bars(self, dealt: bool = False) -> DataFrame:
        """dealt: by security, so that what is made of a security's bars needs no other shuffle."""
        week = F.to_date(F.date_trunc("week", F.col("l_shipdate").cast("timestamp")))
        price = F.col("l_extendedprice") / F.col("l_quantity")
        lines = self._lineitem.select(F.col("l_suppkey").alias("k"), week.alias("d"), price.alias("price"), _money(F.col("l_extendedprice")).alias("ext"), _money(F.col("l_quantity")).alias("qty"), _money(F.col("l_tax")).alias("tax"), _money(F.col("l_discount")).alias("disc"))
        if dealt:
            lines = lines.withColumn("ts_code", _code("k")).repartition("ts_code")
        g = lines.groupBy("k", "d", *(["ts_code"] if dealt else [])).agg(F.min("price").alias("low"), F.max("price").alias("high"), F.sum("ext").cast("double").alias("amount"), F.sum("qty").cast("double").alias("vol"), F.sum("tax").cast("double").alias("tax"), F.sum("disc").cast("double").alias("disc"), F.count(F.lit(1)).alias("n"))
        return g.withColumns({"close": F.col("amount") / F.col("vol"), "ts_code": F.col("ts_code") if dealt else _code("k")})

    def trade_cal(self) -> DataFrame:
        weeks = self._lineitem.select(F.to_date(F.date_trunc("week", F.col("l_shipdate").cast("timestamp"))).alias("d")).distinct()
        from pyspark.sql import Window

        opened = weeks.select("d", F.lag("d").over(Window.orderBy("d")).alias("p"), F.lit(1).alias("is_open"))
        shut = weeks.select(F.date_add("d", 1).alias("d"), F.col("d").alias("p"), F.lit(0).alias("is_open"))
        return opened.unionByName(shut).select(F.lit("X").alias("exchange"), _text(F.col("d")).alias("cal_date"), "is_open", _text(F.col("p")).alias("pretrade_date"))

    def stock_basic(self) -> DataFrame:
        first = self._lineitem.agg(F.to_date(F.date_trunc("week", F.min("l_shipdate").cast("timestamp"))).alias("first"))
        who = self._supplier.join(self._nation, F.col("s_nationkey") == F.col("n_nationkey")).join(self._region, F.col("n_regionkey") == F.col("r_regionkey")).crossJoin(F.broadcast(first))
        listed = F.date_add("first", ((F.col("s_suppkey") % 5) * 90).cast("int"))
        gone = F.when(F.col("s_suppkey") % 17 == 0, F.lit("20000630"))
        return who.select(_code("s_suppkey").alias("ts_code"), F.col("r_name").alias("exchange"), F.concat(F.lit("M"), F.col("n_regionkey").cast("string")).alias("market"), F.col("n_name").alias("industry"), _text(listed).alias("list_date"), gone.alias("delist_date"))

    def daily(self) -> DataFrame:
        none = F.lit(None).cast("double")
        return self._bars().select("ts_code", _text(F.col("d")).alias("trade_date"), F.col("low").alias("open"), "high", "low", "close", none.alias("pre_close"), none.alias("change"), none.alias("pct_chg"), "vol", "amount")

    def adj_factor(self) -> DataFrame:
        """Some securities have none in March, none has any in May 1996."""
        rows = self._bars().where(~((F.col("k") % 13 == 0) & (F.month("d") == 3)) & (F.date_format("d", "yyyyMM") != "199605"))
        return rows.select("ts_code", _text(F.col("d")).alias("trade_date"), (1 + 0.05 * (F.year("d") - 1995)).alias("adj_factor"))

    def daily_basic(self) -> DataFrame:
        tax, disc, mv = F.col("tax") / F.col("n"), F.col("disc") / F.col("n"), F.col("close") * (1000 + F.col("k"))
        zero = lambda x: F.when(x != 0, x)
        return self._bars(dealt=True).select("ts_code", _text(F.col("d")).alias("trade_date"), mv.alias("total_mv"), (mv * 0.6).alias("circ_mv"), (1 + 10 * tax).alias("pb"), zero(100 * disc).alias("pe_ttm"), (1 + 5 * (tax + disc)).alias("ps_ttm"), disc.alias("dv_ttm"), (F.col("vol") / 1000).alias("turnover_rate"), F.when(F.col("k") % 7 != 0, F.col("vol") / 600).alias("turnover_rate_f"), (F.col("n") / 10).alias("volume_ratio"))

    def _quarters(self) -> DataFrame:
        return self._keep("quarters", self._made_quarters)

    def _made_quarters(self) -> DataFrame:
        from pyspark.sql import Window

        end = F.last_day(F.add_months(F.date_trunc("quarter", F.col("o_orderdate").cast("timestamp")).cast("date"), 2))
        lines = self._lineitem.join(self._orders.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
        ext, disc = _money(F.col("l_extendedprice")), _money(F.col("l_discount"))
        g = lines.select(F.col("l_suppkey").alias("k"), end.alias("end"), (ext * (1 - disc)).alias("r"), (ext * disc).alias("c")).groupBy("k", "end").agg(F.sum("r").alias("r"), F.sum("c").alias("c"))
        run = Window.partitionBy("k").orderBy("end").rowsBetween(Window.unboundedPreceding, 0)
        g = g.withColumn("assets", F.sum(F.col("r") + F.col("c")).over(run).cast("double"))
        ann = F.date_add("end", (20 + F.col("k") % 40).cast("int"))
        return g.select("k", _code("k").alias("ts_code"), "end", ann.alias("ann"), F.col("r").cast("double").alias("revenue"), F.col("c").cast("double").alias("cost"), "assets")

    def _statement(self, *metrics, published: bool = True) -> DataFrame:
        filed = F.when(F.col("k") % 5 != 0, F.date_add("ann", (F.col("k") % 3).cast("int")))
        head = ["ts_code", _text(F.col("ann")).alias("ann_date"), *([_text(filed).alias("f_ann_date")] if published else []), _text(F.col("end")).alias("end_date"), (F.col("k") % 2).cast("string").alias("update_flag")]
        return self._quarters().select(*head, *metrics)

    def fina_indicator(self) -> DataFrame:
        r, c, a = F.col("revenue"), F.col("cost"), F.col("assets")
        return self._statement((r / a).alias("roe"), (c / a).alias("roa"), ((r - c) / r).alias("gross_margin"), published=False)

    def income(self) -> DataFrame:
        return self._statement("revenue", F.col("cost").alias("oper_cost"), (F.col("revenue") * 0.1).alias("n_income_attr_p"))

    def balancesheet(self) -> DataFrame:
        a = F.col("assets")
        return self._statement(a.alias("total_assets"), (a * 0.4 + F.col("cost")).alias("total_liab"), (F.col("revenue") * 0.1).alias("money_cap"), (F.col("cost") * 0.2 + 1).alias("inventories"))

    def cashflow(self) -> DataFrame:
        return self._statement(((F.col("revenue") - F.col("cost")) * (0.7 + 0.1 * (F.col("k") % 4))).alias("n_cashflow_act"))

    def forecast(self) -> DataFrame:
        ann = F.date_sub("end", 15)
        return self._quarters().select("ts_code", _text(ann).alias("ann_date"), _text(F.date_sub(ann, (F.col("k") % 4).cast("int"))).alias("first_ann_date"), _text(F.col("end")).alias("end_date"), (F.col("revenue") * 0.08).alias("net_profit_min"))

    def express(self) -> DataFrame:
        return self._quarters().where("k % 3 = 0").select("ts_code", _text(F.date_add("end", 10)).alias("ann_date"), _text(F.col("end")).alias("end_date"), "revenue")

    def table(self, name: str) -> DataFrame:
        return getattr(self, name)()
