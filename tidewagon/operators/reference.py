"""Queries on the reference tables (REF-1..20, TOP-1, TOP-2): project, filter, order by key, page."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidewagon.functions.columns import array_or_empty, like_term

# Columns returned per table; the first one is the primary key and gives the order.
COLUMNS = {
    "warehouses": ("warehouse_id", "name", "city", "country", "latitude", "longitude", "status"),
    "customers": ("customer_id", "company_name", "contact_email", "sla_tier", "account_status"),
    "vehicles": ("vehicle_id", "vehicle_type", "license_plate", "capacity_kg", "capacity_cubic_m",
                 "home_warehouse_id", "status", "fuel_type"),
    "products": ("product_id", "sku", "name", "category", "weight_kg", "length_cm", "width_cm",
                 "height_cm", "unit_price"),
    "drivers": ("driver_id", "first_name", "last_name", "license_type", "certifications",
                "assigned_vehicle_id", "home_warehouse_id", "status"),
    "routes": ("route_id", "origin_warehouse_id", "destination_city", "destination_country",
               "distance_km", "estimated_hours", "route_type", "active"),
}
# Decimals at rest that queries return as doubles.
DOUBLES = {"latitude", "longitude", "capacity_kg", "capacity_cubic_m", "weight_kg", "length_cm",
           "width_cm", "height_cm", "unit_price", "distance_km", "estimated_hours"}
PAGE_SIZE = 50
CATEGORY_SHOWN = 20
PRODUCTS_SHOWN = 15


def _shaped(df: DataFrame, table: str) -> DataFrame:
    def column(name: str):
        if name in DOUBLES:
            return F.col(name).cast("double").alias(name)
        if name == "certifications":
            return array_or_empty(F.col(name)).alias(name)
        return F.col(name)
    return df.select(*[column(c) for c in COLUMNS[table]])


def all_rows(df: DataFrame, table: str) -> DataFrame:
    """The whole table by primary key (REF-1, 8, 13, 17)."""
    return _shaped(df, table).orderBy(COLUMNS[table][0])


def by_id(df: DataFrame, table: str, key: str) -> DataFrame:
    """Zero or one row (REF-2, 5, 9, 14)."""
    return _shaped(df.where(F.col(COLUMNS[table][0]) == key), table)


def _matching(df: DataFrame, table: str, condition) -> DataFrame:
    return all_rows(df.where(condition), table)


def _blank(term: str | None) -> bool:
    return term is None or not term.strip()


def warehouses_by_city(df: DataFrame, term: str | None, literal: bool = False) -> DataFrame:
    if _blank(term):
        return all_rows(df, "warehouses")
    return _matching(df, "warehouses", like_term(F.col("city"), term, literal))


def customers_page(df: DataFrame, limit: int = PAGE_SIZE, offset: int = 0) -> DataFrame:
    return all_rows(df, "customers").offset(offset).limit(limit)


def customers_by_company(df: DataFrame, term: str | None, literal: bool = False) -> DataFrame:
    if _blank(term):
        return customers_page(df)
    return _matching(df, "customers", like_term(F.col("company_name"), term, literal))


def customers_by_tier(df: DataFrame, tier: str) -> DataFrame:
    return _matching(df, "customers", F.col("sla_tier") == tier.upper())


def vehicles_by_warehouse(df: DataFrame, warehouse_id: str) -> DataFrame:
    return _matching(df, "vehicles", F.col("home_warehouse_id") == warehouse_id)


def products_by_category(df: DataFrame, category: str, limit: int = CATEGORY_SHOWN, offset: int = 0) -> DataFrame:
    return _matching(df, "products", F.col("category") == category.upper()).offset(offset).limit(limit)


def products_search(df: DataFrame, term: str | None, limit: int = PRODUCTS_SHOWN, literal: bool = False) -> DataFrame:
    """Name or SKU contains the term; no term gives the first page."""
    if _blank(term):
        return all_rows(df, "products").limit(limit)
    found = like_term(F.col("name"), term, literal) | like_term(F.col("sku"), term, literal)
    return _matching(df, "products", found).limit(limit)


def products_query(df: DataFrame, category: str | None = None, term: str | None = None,
                   limit: int = PAGE_SIZE, offset: int = 0) -> DataFrame:
    """A category wins over a search term, and a search term over listing everything."""
    if not _blank(category):
        return products_by_category(df, category, limit, offset)
    return products_search(df, term, limit)


def drivers_by_warehouse(df: DataFrame, warehouse_id: str) -> DataFrame:
    return _matching(df, "drivers", F.col("home_warehouse_id") == warehouse_id)


def drivers_available(df: DataFrame) -> DataFrame:
    return _matching(df, "drivers", F.col("status") == "AVAILABLE")


def routes_by_origin(df: DataFrame, warehouse_id: str) -> DataFrame:
    """Routes leaving a warehouse, inactive ones included."""
    return _matching(df, "routes", F.col("origin_warehouse_id") == warehouse_id)


def routes_by_destination(df: DataFrame, term: str, literal: bool = False) -> DataFrame:
    return _matching(df, "routes", like_term(F.col("destination_city"), term, literal))


def distinct_destinations(df: DataFrame) -> DataFrame:
    """Each destination once, in the order in which the routes first name it."""
    return (df.groupBy("destination_city", "destination_country")
            .agg(F.min("route_id").alias("first_route_id")).orderBy("first_route_id"))


def with_count(rows: DataFrame, name: str = "count") -> DataFrame:
    """The number of rows found, as one row."""
    return rows.agg(F.count("*").alias(name))
