"""Business reports: customer profitability, and where a part is used."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.plans.storage import numbered, reliable

MONEY = "decimal(18,4)"

#: Monthly quantity up to a bound, and the fee rate that holds there; beyond the last bound the last rate.
FEE_STEPS = (
    (500_000, "0.0578"), (550_000, "0.0551"), (600_000, "0.0525"), (650_000, "0.0499"), (700_000, "0.0473"),
    (750_000, "0.0446"), (800_000, "0.0420"), (850_000, "0.0394"), (940_000, "0.0368"),
)
LAST_FEE = "0.0341"

#: Fixed values of the report: account type, excluded property, credit accounts, fine account, name for no customer.
ACCOUNT_TYPE, EXCLUDED = "3", "True"
CREDIT_ACCOUNTS, FINE_ACCOUNT = ("6001.01.01", "6001.01.05", "6001.05.01"), "6711.04"
NO_CUSTOMER = "[未维护客户]"


def number(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string").try_cast(MONEY), F.lit(0).cast(MONEY))


def name(c: str) -> Column:
    return F.trim(F.col(c))


def day(c: str) -> Column:
    return F.col(c).cast("string").try_cast("timestamp_ntz").cast("date")


def fee_rate(quantity: Column) -> Column:
    rate = F.lit(LAST_FEE)
    for bound, value in reversed(FEE_STEPS):
        rate = F.when(quantity <= bound, F.lit(value)).otherwise(rate)
    return rate.cast("decimal(6,4)")


@dataclass(frozen=True)
class Range:
    """Months 'yyyy-MM', both included; either may be missing."""

    start: str | None = None
    end: str | None = None

    def days(self, c: str) -> Column:
        ok = F.lit(True)
        if self.start:
            ok = ok & (day(c) >= F.to_date(F.lit(f"{self.start}-01")))
        if self.end:
            ok = ok & (day(c) < F.add_months(F.to_date(F.lit(f"{self.end}-01")), 1))
        return ok

    def periods(self, year: str, period: str) -> Column:
        at = F.coalesce(F.trim(F.col(year).cast("string")).try_cast("int"), F.lit(0)) * 100 + F.coalesce(F.trim(F.col(period).cast("string")).try_cast("int"), F.lit(0))
        ok = F.lit(True)
        if self.start:
            ok = ok & (at >= int(self.start.replace("-", "")))
        if self.end:
            ok = ok & (at <= int(self.end.replace("-", "")))
        return ok

    def month_text(self, c: str) -> Column:
        month = F.coalesce(F.date_format(day(c), "yyyy-MM"), F.left(F.trim(F.col(c).cast("string")), F.lit(7)))
        ok = F.lit(True)
        if self.start:
            ok = ok & (month >= self.start)
        if self.end:
            ok = ok & (month <= self.end)
        return ok


def sold(receivable: DataFrame, months: Range, product: str) -> DataFrame:
    """Receivables that count as sales of the product."""
    kept = (F.trim(F.col("account_type").cast("string")) == ACCOUNT_TYPE) & (F.col("material_name") == product) & ((F.col("excluded") != EXCLUDED) | F.col("excluded").isNull()) & (name("customer_name") != "")
    return receivable.where(kept & months.days("bill_date"))


def monthly_fees(receivable: DataFrame, months: Range, product: str, customer: str | None = None) -> DataFrame:
    """(customer, fee): each month's rate comes from all customers' quantity of that month."""
    rows = sold(receivable, months, product).select(name("customer_name").alias("customer"), (F.year(day("bill_date")) * 12 + F.month(day("bill_date"))).alias("ym"), number("quantity").alias("q"))
    per = rows.groupBy("customer", "ym").agg(F.sum("q").alias("q"))
    rates = per.groupBy("ym").agg(fee_rate(F.sum("q")).alias("rate"))
    if customer:
        per = per.where(F.col("customer") == customer)
    return per.join(rates, "ym").groupBy("customer").agg(F.sum(F.col("q") * F.col("rate")).alias("management_fee"))


def prefix_sums(names: DataFrame, rows: DataFrame, value: str) -> DataFrame:
    """(customer, value): sum over rows whose name is a prefix of the customer's, or the other way round.

    Two equi-joins on prefixes instead of comparing all pairs: each customer's prefixes meet whole row names, and each
    row's proper prefixes meet whole customer names, so no pair is met twice. Only prefixes of the lengths that the
    other side has are made. Both sides grow with the customers, so neither is broadcast."""
    r = rows.groupBy(F.col("customer").alias("other")).agg(F.sum(value).alias(value))

    def prefixes(frame: DataFrame, column: str, proper: bool) -> DataFrame:
        most = F.length(column) - (1 if proper else 0)
        return frame.where(most >= 1).withColumn("prefix", F.explode(F.transform(F.sequence(F.lit(1), most), lambda n: F.substring(F.col(column), F.lit(1), n))))

    down = prefixes(names.select("customer"), "customer", False).join(r.hint("merge"), F.col("prefix") == F.col("other")).select("customer", value)
    up = prefixes(r, "other", True).join(names.select("customer").hint("merge"), F.col("prefix") == F.col("customer")).select("customer", value)
    return down.unionByName(up).groupBy("customer").agg(F.sum(value).alias(value))


def anyone(c: Column) -> Column:
    return F.lit(True)


def dimension(customers: DataFrame) -> DataFrame:
    """(customer, customer_number, customer_seller, customer_type): the largest of each attribute of a name."""
    return customers.where(name("name") != "").groupBy(name("name").alias("customer")).agg(*(F.max(c).alias(f"customer_{c}") for c in ("number", "seller", "type")))


def carried(payable: DataFrame, product: str, months: Range = Range(), wanted: Callable[[Column], Column] = anyone) -> DataFrame:
    """(customer, v): amounts of freight; who isn't named has a name of their own."""
    payer = F.coalesce(F.nullif(name("customer"), F.lit("")), F.lit(NO_CUSTOMER))
    kept = (F.col("material_name") == product) & (F.trim(F.col("account_type").cast("string")) == ACCOUNT_TYPE)
    return payable.where(kept & months.days("bill_date") & wanted(payer)).select(payer.alias("customer"), number("amount").alias("v"))


def returned(returns: DataFrame, materials: DataFrame, months: Range = Range(), wanted: Callable[[Column], Column] = anyone) -> DataFrame:
    """(customer, v): quantities that came back, at the material's price; without a price they count nothing."""
    back = returns.where((name("customer_name") != "") & months.days("bill_date") & wanted(name("customer_name")))
    prices = materials.select(F.col("number").alias("material_number"), number("price").alias("price"))
    return back.join(prices.hint("merge"), "material_number", "left").select(name("customer_name").alias("customer"), (number("quantity") * F.coalesce("price", F.lit(0).cast(MONEY))).alias("v"))


def cent_sums(rows: DataFrame, measure: str) -> DataFrame:
    """(customer, measure): sums of ``v``, to the cent."""
    return rows.groupBy("customer").agg(F.round(F.sum("v"), 2).alias(measure))


def profitability(receivable: DataFrame, payable: DataFrame, balance: DataFrame, customers: DataFrame, returns: DataFrame, materials: DataFrame, costs: DataFrame, product: str, freight: str, months: Range = Range(), customer: str | None = None) -> DataFrame:
    """One numbered row for each customer that occurs in any source.

    receivable: bill_date, customer_name, material_name, account_type, excluded, quantity; payable: bill_date, customer,
    material_name, account_type, amount; balance: year, period, account, detail_name, debit, credit; customers: name,
    number, seller, type; returns: bill_date, customer_name, material_number, quantity; materials: number, price; costs:
    customer, biz_date, amount. ``customer``: only this one; in the balance, names that contain it.

    Materials, customers and their sums grow with the business, and a file of them is far smaller than its rows in the
    driver's memory: they are joined by merge, whatever their files' size."""
    exact = (lambda c: c == customer) if customer else anyone
    like = (lambda c: c.contains(customer)) if customer else anyone
    entries = balance.where(months.periods("year", "period") & (F.trim("detail_name") != "") & like(name("detail_name")))
    spent = costs.where((F.trim(F.coalesce("customer", F.lit(""))) != "") & months.month_text("biz_date") & exact(name("customer")))
    parts = {
        "quantity": sold(receivable, months, product).where(exact(name("customer_name"))).select(name("customer_name").alias("customer"), number("quantity").alias("v")),
        "credit": entries.where(F.col("account").isin(*CREDIT_ACCOUNTS)).select(name("detail_name").alias("customer"), number("credit").alias("v")),
        "own_fine": entries.where(F.col("account") == FINE_ACCOUNT).select(X.before_slash(F.col("detail_name")).alias("customer"), number("debit").alias("v")),
        "freight": carried(payable, freight, months, exact),
        "returned": returned(returns, materials, months, exact),
        "cost": spent.select(name("customer").alias("customer"), number("amount").alias("v")),
        "management_fee": monthly_fees(receivable, months, product, customer).select("customer", F.col("management_fee").alias("v")),
    }
    # the customers are those of any part: one aggregation over all parts gives them and their sums, without joins
    every = None
    for measure, rows in parts.items():
        tagged = rows.select("customer", F.lit(measure).alias("measure"), F.col("v").cast("decimal(38,8)").alias("v"))
        every = tagged if every is None else every.unionByName(tagged)
    per = reliable(every.groupBy("customer").agg(*(F.sum(F.when(F.col("measure") == m, F.col("v"))).alias(m) for m in parts)))
    fined = per.where("own_fine IS NOT NULL").select("customer", F.col("own_fine").alias("fine"))
    out = per.join(dimension(customers).hint("merge"), "customer", "left").join(prefix_sums(per, fined, "fine").hint("merge"), "customer", "left")
    zero = lambda c, kind: F.coalesce(c, F.lit(0)).cast(kind).alias(c)
    cents = lambda c: F.round(F.coalesce(c, F.lit(0)), 4).cast("decimal(18,2)").alias(c)
    rounded = [F.round(F.coalesce(c, F.lit(0)), 2).alias(c) for c in ("freight", "returned")]
    line = (F.col("__number") + 1).cast("int").alias("line")
    return numbered(out, "customer").select(line, "customer", "customer_number", "customer_seller", "customer_type", zero("quantity", "decimal(28,4)"), *rounded, zero("management_fee", "decimal(38,8)"), F.lit(0).cast("decimal(18,2)").alias("rebate"), *map(cents, ("credit", "fine", "cost"))).orderBy("customer")


def where_used(edges: DataFrame, materials: DataFrame, child: str, all_edges: bool = True) -> DataFrame:
    """(top_id): assemblies that contain ``child`` at any depth and are in no other; cycles end the walk.

    edges: parent_id, child_number, replace_group; materials: id, number. Without ``all_edges``, edges of a replacement
    group don't count. Each round joins the newest assemblies with their parents, and is written; the walk ends where a
    round finds no assembly that isn't known, however deep that is."""
    if not all_edges:
        edges = edges.where(F.coalesce("replace_group", F.lit(0)) == 0)
    up = materials.join(edges, F.col("child_number") == F.col("number")).select(F.col("id").alias("node"), "parent_id").distinct()
    up = reliable(up)
    seen = reliable(edges.where(F.col("child_number") == child).select(F.col("parent_id").alias("node")).distinct())
    front = seen
    while not front.isEmpty():
        front = reliable(front.join(up, "node").select(F.col("parent_id").alias("node")).distinct().join(seen, "node", "left_anti"))
        seen = reliable(seen.union(front))
    return seen.join(up.select("node").distinct(), "node", "left_anti").select(F.col("node").alias("top_id"))


def direct_uses(edges: DataFrame, materials: DataFrame, child: str) -> DataFrame:
    return edges.where(F.col("child_number") == child).join(materials.select(F.col("id").alias("parent_id"), F.col("number").alias("top_number"), F.col("name").alias("top_name")), "parent_id")


def shipped(tops: DataFrame, materials: DataFrame, shipments: DataFrame, first: str, last: str, least: float) -> DataFrame:
    """Shipments of top assemblies: of a quantity or more, from first to last day, both included."""
    when = (F.col("ship_date") >= F.lit(first).cast("timestamp_ntz")) & (F.col("ship_date") <= F.lit(last).cast("timestamp_ntz"))
    numbers = tops.join(materials, F.col("top_id") == F.col("id")).select("number")
    return shipments.where(when & (F.col("quantity") >= least)).join(numbers, F.col("material_number") == F.col("number")).select("number", "quantity")


def bom_metrics(edges: DataFrame, materials: DataFrame, shipments: DataFrame, child: str, first: str, last: str, least: float = 100) -> DataFrame:
    """(metric, value): what counting edges of replacement groups changes."""
    uses = direct_uses(edges, materials, child)
    parts = [uses.agg(F.count("*").alias("value")).withColumn("metric", F.lit("direct_map_rows")), uses.agg(F.count_if(F.coalesce("replace_group", F.lit(0)) != 0).alias("value")).withColumn("metric", F.lit("direct_map_replacegroup_nonzero"))]
    for label, every in (("current", True), ("exclude_replacegroup", False)):
        tops = where_used(edges, materials, child, every)
        parts.append(tops.agg(F.count("*").alias("value")).withColumn("metric", F.lit(f"{label}_top_count")))
        parts.append(shipped(tops, materials, shipments, first, last, least).agg(F.coalesce(F.sum(F.col("quantity").cast(MONEY)), F.lit(0)).cast("long").alias("value")).withColumn("metric", F.lit(f"{label}_qty")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("metric", "value")


def top_shipments(tops: DataFrame, materials: DataFrame, shipments: DataFrame, first: str, last: str, least: float = 100, limit: int = 50) -> DataFrame:
    return shipped(tops, materials, shipments, first, last, least).groupBy("number").agg(F.sum(F.col("quantity").cast(MONEY)).alias("quantity")).orderBy(F.desc("quantity"), "number").limit(limit)


def narrowed(rows: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Decimals cast to narrower types, with the number of columns that would overflow in ``overflows``."""
    over = F.lit(0)
    for c, k in kinds.items():
        over = over + F.when(F.col(c).isNotNull() & F.col(c).try_cast(k).isNull(), 1).otherwise(0)
    return rows.withColumn("overflows", over).withColumns({c: F.col(c).try_cast(k) for c, k in kinds.items()})


def columns_of(rows: DataFrame, names: Sequence[str]) -> list[str]:
    """Names as the table spells them, whatever their case."""
    spelled = {c.lower(): c for c in rows.columns}
    return [spelled[n.lower()] for n in names if n.lower() in spelled]
