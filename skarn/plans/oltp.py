"""Order-entry transactions as set queries: stock level, order status, delivery, payment, new order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skarn.plans.layout import dealt


def stock_level(lines: DataFrame, stock: DataFrame, *, order: str, item: str, stock_item: str, quantity: str, last: int = 20, threshold: float = 15) -> DataFrame:
    """One row: how many distinct items of the last orders have less than `threshold` in stock."""
    newest = lines.agg(F.max(order).alias("_top"))
    recent = lines.crossJoin(F.broadcast(newest)).filter(F.col(order) > F.col("_top") - last).select(F.col(item).alias("_item")).distinct()  # one row
    low = stock.filter(F.col(quantity) < threshold).select(F.col(stock_item).alias("_item"))
    return recent.join(low, "_item", "left_semi").agg(F.count(F.lit(1)).alias("stock_count"))


def latest_order(orders: DataFrame, *, customer: str, order: str) -> DataFrame:
    """The last order of each customer: an aggregation, with no sort of the orders."""
    return orders.groupBy(customer).agg(F.max_by(F.struct(*[c for c in orders.columns if c != customer]), order).alias("_o")).select(customer, "_o.*")


def median_by_name(customers: DataFrame, *, name: str, order_by: str, ident: str) -> DataFrame:
    """Of customers with one name, the middle one (rounded up) in an order."""
    by = Window.partitionBy(name).orderBy(order_by, ident)
    rows = customers.withColumn("_n", F.row_number().over(by)).withColumn("_all", F.count(F.lit(1)).over(Window.partitionBy(name)))
    return rows.filter(F.col("_n") == F.floor((F.col("_all") + 1) / 2)).drop("_n", "_all")


def oldest_open(orders: DataFrame, lines: DataFrame, *, district: str, order: str, status: str, open_status: str, line_order: str, amount: str) -> DataFrame:
    """The oldest open order of each district, and the sum of its lines: what a delivery takes."""
    oldest = orders.filter(F.col(status) == open_status).groupBy(district).agg(F.min(order).alias("_o"))
    sums = lines.join(oldest, F.col(line_order) == F.col("_o"), "left_semi").groupBy(line_order).agg(F.sum(amount).alias("amount"))
    return oldest.join(sums, F.col("_o") == F.col(line_order), "left").select(district, F.col("_o").alias("order_key"), F.coalesce("amount", F.lit(0.0)).alias("amount"))


def pay(customers: DataFrame, payments: DataFrame, *, ident: str, balance: str) -> DataFrame:
    """Customers with the sums of their payments (ident, amount) taken from their balances."""
    sums = payments.groupBy(F.col(ident).alias("_c")).agg(F.sum("amount").alias("_paid"))
    both = customers.join(sums, F.col(ident) == F.col("_c"), "left")
    return both.withColumn(balance, F.col(balance) - F.coalesce("_paid", F.lit(0.0))).drop("_c", "_paid")


def restock(stock: DataFrame, sold: DataFrame, *, item: str, quantity: str) -> DataFrame:
    """Stock after new orders (item, sold): less what was sold, and 91 more as often as less than 10 would be left."""
    sums = sold.groupBy(F.col(item).alias("_i")).agg(F.sum("sold").alias("_sold"))
    left = F.col(quantity) - F.coalesce("_sold", F.lit(0))
    refill = F.when(left < 10, F.ceil((10 - left) / 91)).otherwise(0) * 91
    return stock.join(sums, F.col(item) == F.col("_i"), "left").withColumn(quantity, left + refill).drop("_i", "_sold")


def new_orders(requests: DataFrame, stock: DataFrame, prices: DataFrame, *, first_order: int, first_day: str = "1998-08-03") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The orders, order lines and stock after requests (customer, request, item, quantity).

    Orders are numbered from first_order by request, lines within an order by item; a line's amount is quantity x price. A
    request with an item that isn't in stock's table is refused whole. Partitions grow in number with the requests, and not in size.
    """
    unknown = dealt(requests, "item", like=requests).join(stock.select("item"), "item", "left_anti").select("request").distinct()
    good = dealt(requests, "request", like=requests).join(unknown, "request", "left_anti")
    by_request = good.groupBy("request").agg(F.min("customer").alias("customer"), F.count(F.lit(1)).alias("n_lines"))
    orders = by_request.withColumn("order", F.col("request") + F.lit(first_order)).withColumn("day", F.lit(first_day).cast("date")).withColumn("status", F.lit("O"))
    by = Window.partitionBy("request").orderBy("item", "quantity")
    lines = dealt(good.withColumn("line", F.row_number().over(by)), "item", like=requests).join(prices, "item")
    lines = lines.select((F.col("request") + F.lit(first_order)).alias("order"), "line", "item", "quantity", (F.col("quantity") * F.col("price")).alias("amount"))
    left = restock(stock, good.select("item", F.col("quantity").alias("sold")), item="item", quantity="in_stock")
    return orders.select("order", "customer", "day", "status", "n_lines"), lines, left


def deliver(orders: DataFrame, lines: DataFrame, customers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Delivery of the oldest open order of each district: orders (district, order, customer, status) with the delivered ones closed, and
    customers (customer, balance) with the amounts of their lines (order, amount) added."""
    oldest = oldest_open(orders, lines, district="district", order="order", status="status", open_status="O", line_order="order", amount="amount")
    oldest = oldest.select(F.col("order_key").alias("order"), "amount", F.lit(True).alias("_done"))
    after = orders.join(oldest, "order", "left")
    due = after.filter("_done").groupBy("customer").agg(F.sum("amount").alias("_due"))
    closed = after.select("district", "order", "customer", F.when(F.col("_done"), F.lit("F")).otherwise(F.col("status")).alias("status"))
    paid = customers.join(due, "customer", "left").select("customer", (F.col("balance") + F.coalesce("_due", F.lit(0.0))).alias("balance"))
    return closed, paid


#: Transactions and their shares in percent.
MIX = (("payment", 43), ("order_status", 4), ("delivery", 4), ("stock_level", 4), ("new_order", 45))


def transaction_mix(draws: DataFrame, draw: str = "draw") -> DataFrame:
    """draws with `transaction`: which one a number from 0 to 99 stands for."""
    out, low = F.lit(None).cast("string"), 100
    for name, share in reversed(MIX):
        low -= share
        out = F.when(F.col(draw) >= low, F.coalesce(out, F.lit(name))).otherwise(out)
    return draws.withColumn("transaction", out)
