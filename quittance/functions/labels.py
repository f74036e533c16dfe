"""The label dimension: 90 token labels, their 13 groups, value formats and colours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values: (label_id, label, group, group's place, format of the value, colour) of every label.
LABELS = [
    (0, "O", "O", 0, "MIXED", "lightyellow"),
    (1, "I-date_text", "datetime", 1, "TEXT", "darkgreen"),
    (2, "I-date_value", "datetime", 1, "DATE", "darkgreen"),
    (3, "I-time_text", "datetime", 1, "TEXT", "darkgreen"),
    (4, "I-time_value", "datetime", 1, "TIME", "darkgreen"),
    (5, "I-datetime", "datetime", 1, "DATETIME", "darkgreen"),
    (6, "I-heading", "header", 2, "MIXED", "purple"),
    (7, "I-unused8", "unused1", 3, None, ""),
    (8, "I-unused7", "unused1", 3, None, ""),
    (9, "I-unused6", "unused1", 3, None, ""),
    (10, "I-tax.header", "tax_table_header", 4, "TEXT", "darkviolet"),
    (11, "I-tax.description", "tax_table", 5, "MIXED", "brown"),
    (12, "I-tax.price", "tax_table", 5, "PRICE", "brown"),
    (13, "I-tax.price_excl", "tax_table", 5, "PRICE", "brown"),
    (14, "I-tax.price_incl", "tax_table", 5, "PRICE", "brown"),
    (15, "I-unused5", "unused2", 6, None, ""),
    (16, "I-unused4", "unused2", 6, None, ""),
    (17, "I-unused3", "unused2", 6, None, ""),
    (18, "I-unused2", "unused2", 6, None, ""),
    (19, "I-unused1", "unused2", 6, None, ""),
    (20, "I-store.name", "store", 7, "MIXED", "green"),
    (21, "I-store.address", "store", 7, "LOCATION", "green"),
    (22, "I-store.phone", "store", 7, "MIXED", "green"),
    (23, "I-store.email", "store", 7, "MIXED", "green"),
    (24, "I-store.website", "store", 7, "MIXED", "green"),
    (25, "I-store.tax_id", "store", 7, "MIXED", "green"),
    (26, "I-store.unused3", "store", 7, None, ""),
    (27, "I-store.unused2", "store", 7, None, ""),
    (28, "I-store.unused1", "store", 7, None, ""),
    (29, "I-store.etc", "store", 7, "MIXED", "green"),
    (30, "I-item.header", "item_table_header", 8, "TEXT", "indigo"),
    (31, "I-item.quantity", "item_table", 9, "NUMBER", "magenta"),
    (32, "I-item.description", "item_table", 9, "MIXED", "magenta"),
    (33, "I-item.unit_price", "item_table", 9, "PRICE", "magenta"),
    (34, "I-item.price", "item_table", 9, "PRICE", "magenta"),
    (35, "I-item.id", "item_table", 9, "MIXED", "magenta"),
    (36, "I-item.discount_description", "item_table", 9, "MIXED", "darkblue"),
    (37, "I-item.discount_price", "item_table", 9, "PRICE", "darkblue"),
    (38, "I-item.etc", "item_table", 9, "MIXED", "magenta"),
    (39, "I-item.unused11", "item_table", 9, None, ""),
    (40, "I-item.unused10", "item_table", 9, None, ""),
    (41, "I-item.unused9", "item_table", 9, None, ""),
    (42, "I-item.unused8", "item_table", 9, None, ""),
    (43, "I-item.unused7", "item_table", 9, None, ""),
    (44, "I-item.unused6", "item_table", 9, None, ""),
    (45, "I-item.unused5", "item_table", 9, None, ""),
    (46, "I-item.unused4", "item_table", 9, None, ""),
    (47, "I-item.unused3", "item_table", 9, None, ""),
    (48, "I-item.unused2", "item_table", 9, None, ""),
    (49, "I-item.unused1", "item_table", 9, None, ""),
    (50, "I-sub_total.text", "subtotal", 10, "TEXT", "blue"),
    (51, "I-sub_total.price", "subtotal", 10, "PRICE", "blue"),
    (52, "I-sub_total.discount_text", "subtotal", 10, "TEXT", "blue"),
    (53, "I-sub_total.discount_price", "subtotal", 10, "PRICE", "blue"),
    (54, "I-sub_total.discount_item_text", "subtotal", 10, "MIXED", "blue"),
    (55, "I-sub_total.discount_item_price", "subtotal", 10, "PRICE", "blue"),
    (56, "I-sub_total.tax_text", "subtotal", 10, "TEXT", "blue"),
    (57, "I-sub_total.tax_price", "subtotal", 10, "PRICE", "blue"),
    (58, "I-sub_total.tax_excl_text", "subtotal", 10, "TEXT", "blue"),
    (59, "I-sub_total.tax_excl_price", "subtotal", 10, "PRICE", "blue"),
    (60, "I-sub_total.tax_incl_text", "subtotal", 10, "TEXT", "blue"),
    (61, "I-sub_total.tax_incl_price", "subtotal", 10, "PRICE", "blue"),
    (62, "I-sub_total.service_text", "subtotal", 10, "MIXED", "blue"),
    (63, "I-sub_total.service_price", "subtotal", 10, "PRICE", "blue"),
    (64, "I-sub_total.item_rows_text", "subtotal", 10, "MIXED", "blue"),
    (65, "I-sub_total.item_rows_value", "subtotal", 10, "NUMBER", "blue"),
    (66, "I-sub_total.quantity_text", "subtotal", 10, "TEXT", "blue"),
    (67, "I-sub_total.quantity_value", "subtotal", 10, "NUMBER", "blue"),
    (68, "I-sub_total.etc_text", "subtotal", 10, "MIXED", "blue"),
    (69, "I-sub_total.etc_price", "subtotal", 10, "PRICE", "blue"),
    (70, "I-total.text", "total", 11, "TEXT", "darkred"),
    (71, "I-total.price", "total", 11, "PRICE", "darkred"),
    (72, "I-total.rounded_text", "total", 11, "TEXT", "darkred"),
    (73, "I-total.rounded_price", "total", 11, "PRICE", "darkred"),
    (74, "I-total.unused4", "total", 11, None, ""),
    (75, "I-total.unused3", "total", 11, None, ""),
    (76, "I-total.unused2", "total", 11, None, ""),
    (77, "I-total.unused1", "total", 11, None, ""),
    (78, "I-total.etc_text", "total", 11, None, "darkred"),
    (79, "I-total.etc_price", "total", 11, None, "darkred"),
    (80, "I-payment.cash_text", "payment", 12, "TEXT", "darkblue"),
    (81, "I-payment.cash_price", "payment", 12, "PRICE", "darkblue"),
    (82, "I-payment.change_text", "payment", 12, "TEXT", "darkblue"),
    (83, "I-payment.change_price", "payment", 12, "PRICE", "darkblue"),
    (84, "I-payment.other_text", "payment", 12, "TEXT", "darkblue"),
    (85, "I-payment.other_price", "payment", 12, "PRICE", "darkblue"),
    (86, "I-payment.details_total_text", "payment", 12, "TEXT", "darkblue"),
    (87, "I-payment.details_total_price", "payment", 12, "PRICE", "darkblue"),
    (88, "I-payment.etc_text", "payment", 12, "TEXT", "darkblue"),
    (89, "I-payment.etc_price", "payment", 12, "PRICE", "darkblue"),
]
LABEL_ID = {x[1]: x[0] for x in LABELS}
# Fixed values: (group, colour) in order.
GROUPS = [
    ("O", "lightyellow"),
    ("datetime", "darkgreen"),
    ("header", "purple"),
    ("unused1", ""),
    ("tax_table_header", "darkviolet"),
    ("tax_table", "brown"),
    ("unused2", ""),
    ("store", "green"),
    ("item_table_header", "indigo"),
    ("item_table", "magenta"),
    ("subtotal", "blue"),
    ("total", "darkred"),
    ("payment", "darkblue"),
]
GROUP_COLOURS = dict(GROUPS)
GROUP_NAMES = list(GROUP_COLOURS)
GROUP_ORD = {g: i for i, g in enumerate(GROUP_NAMES)}

LABEL_SCHEMA = "label_id int, label string, grp string, grp_ord int, format string, colour string"


def label_dim(spark: SparkSession) -> DataFrame:
    """The dimension as a table of 90 rows."""
    return spark.createDataFrame(LABELS, LABEL_SCHEMA)


def groups(label_ids: list[int]) -> list[str | None]:
    """The group of each id; none where no label has it."""
    return [LABELS[i][2] if 0 <= i < len(LABELS) else None for i in label_ids]


def _lookup(label_id: Column, values: list) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), label_id)


def group_of(label_id: Column) -> Column:
    return _lookup(label_id, [x[2] for x in LABELS])


def group_ord_of(label_id: Column) -> Column:
    return _lookup(label_id, [x[3] for x in LABELS])


def format_of(label_id: Column) -> Column:
    return _lookup(label_id, [x[4] for x in LABELS])


def label_of(label_id: Column) -> Column:
    return _lookup(label_id, [x[1] for x in LABELS])


def colour_of(label_id: Column) -> Column:
    return _lookup(label_id, [x[5] for x in LABELS])


def group_colour_of(grp: Column) -> Column:
    return F.get(F.array(*[F.lit(GROUP_COLOURS[g]) for g in GROUP_NAMES]), F.array_position(F.array(*map(F.lit, GROUP_NAMES)), grp).cast("int") - 1)


def same_group(labels: Column) -> Column:
    """Whether all candidates of an array share a group."""
    return F.size(F.array_distinct(F.transform(labels, lambda x: group_ord_of(x["label_id"])))) <= 1
