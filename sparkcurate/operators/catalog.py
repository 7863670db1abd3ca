"""Product catalogue grouping and price labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkcurate.functions.text import strip

# Fixed values. Notes that mark a product as no longer sold, the in-stock prefix, label texts.
DISCONTINUED = ("ngừng kinh doanh", "hết hàng toàn quốc")
IN_STOCK_PREFIX = "còn"
NO_PRICE = "giá đang biến động, để em xác nhận lại với anh/chị"


def money(amount: Column) -> Column:
    """An amount like ``11.990.000đ``; a dash without one."""
    text = F.concat(F.translate(F.format_number(amount.cast("long"), 0), ",", "."), F.lit("đ"))
    return F.coalesce(text, F.lit("—"))


def price_label(prices: Column) -> Column:
    """One price, a range, or a note that the price is open. ``prices`` is sorted."""
    low, high = F.array_min(prices), F.array_max(prices)
    return (
        F.when(F.coalesce(F.size(prices), F.lit(0)) == 0, F.lit(NO_PRICE))
        .when(F.size(prices) == 1, money(low))
        .otherwise(F.concat(money(low), F.lit("–"), money(high)))
    )


def is_active(note: Column, markers: Sequence[str] = DISCONTINUED) -> Column:
    """No marker of a discontinued product occurs in the note."""
    lowered = F.lower(F.coalesce(note, F.lit("")))
    active = F.lit(True)
    for marker in markers:
        active = active & ~lowered.contains(marker)
    return active


def in_stock(availability: Column, prefix: str = IN_STOCK_PREFIX) -> Column:
    """The availability text starts with the in-stock prefix."""
    return F.startswith(F.lower(strip(F.coalesce(availability, F.lit("")))), F.lit(prefix))


def matching(products: DataFrame, name_part: str | None = None,
             storage_gb: int | None = None) -> DataFrame:
    """Active products by name part (any case) and storage; empty filters keep everything."""
    out = products.where(is_active(F.col("crawl_note")))
    if name_part and name_part.strip():
        out = out.where(F.lower("name").contains(name_part.strip().lower()))
    if storage_gb:
        out = out.where(F.col("storage_gb") == storage_gb)
    return out


def catalog_groups(products: DataFrame, specs: Sequence[str], pos: str = "pos") -> DataFrame:
    """One row per (series, storage): prices, colours in first-seen order, stock, first row's specs.

    Colours and prices are reduced to distinct values before they are collected, so a group's
    arrays hold its few different values however many rows it has.
    """
    keys = [F.coalesce(F.col("series"), F.lit("")).alias("series"), F.col("storage_gb")]
    rows = products.select(
        *keys, "price", F.nullif(F.col("color"), F.lit("")).alias("color"), F.col(pos).alias("pos"),
        in_stock(F.col("availability")).alias("available"), *specs,
    )
    reduced = rows.groupBy("series", "storage_gb", "price", "color").agg(
        F.min("pos").alias("pos"), F.bool_or("available").alias("available"),
        *[F.min_by(F.col(s), F.col("pos")).alias(s) for s in specs],
    )
    colours = reduced.groupBy("series", "storage_gb", "color").agg(
        F.min("pos").alias("pos"), F.collect_set("price").alias("prices"),
        F.bool_or("available").alias("available"),
        *[F.min_by(F.col(s), F.col("pos")).alias(s) for s in specs],
    )
    seen = F.array_sort(F.collect_list(
        F.when(F.col("color").isNotNull(), F.struct("pos", "color"))
    ))
    return colours.groupBy("series", "storage_gb").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("prices")))).alias("prices"),
        F.transform(seen, lambda s: s["color"]).alias("colors"),
        F.bool_or("available").alias("available"),
        *[F.min_by(F.col(s), F.col("pos")).alias(s) for s in specs],
    ).withColumn("price_label", price_label(F.col("prices")))


def stocked(groups: DataFrame) -> DataFrame:
    """Groups of which some product is in stock."""
    return groups.where("available")


def by_price(groups: DataFrame) -> DataFrame:
    """Catalogue order: lowest price first, groups without a price in front."""
    return groups.orderBy(
        F.coalesce(F.array_min("prices"), F.lit(0)), F.col("series"), F.col("storage_gb")
    )


# The template of a display line.
def catalog_line(groups: DataFrame) -> DataFrame:
    """One display line per group."""
    def part(template: str, column: str) -> Column:
        return F.when(F.col(column).isNotNull(), F.format_string(template, F.col(column)))

    specs = F.concat_ws(
        ", ", part("%s", "chip"), part('%s"', "screen_inch"), part("camera chính %sMP",
                                                                  "camera_main_mp"))
    colours = F.when(F.size("colors") > 0, F.array_join("colors", "/")).otherwise("—")
    stock = F.when(F.col("available"), "còn hàng").otherwise("hết/không rõ")
    warranty = F.coalesce(F.col("warranty_months").cast("string"), F.lit("—"))
    line = F.concat(
        F.lit("- "), F.col("series"), F.lit(" "), F.coalesce(F.col("storage_gb").cast("string"), F.lit("None")),
        F.lit("GB — "), F.col("price_label"), F.lit(" — "), specs, F.lit(" — màu: "), colours,
        F.lit(" — "), stock, F.lit(" (BH "), warranty, F.lit(" tháng)"),
    )
    return groups.withColumn("line", line)
