"""Table specifications: what to read of an entity, how its fields map to columns, and its catalogue."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators.keys import identifier

#: Entities to load first (0, small) and last (2, large); others are 1.
PRIORITY = {
    "仓库": 0, "物料": 0, "客户资料": 0, "即时库存": 0, "物料清单": 0, "物料清单子项": 0, "预测订单": 0,
    "生产订单主表": 2, "生产用料清单主表": 2, "生产用料清单明细表": 2,
}


@dataclass(frozen=True)
class TableSpec:
    """``fields``: source fields; ``columns``: target column to type; ``mapping``: source field to target column;
    ``defaults``: target column to a value for null or blank; ``filters``: conjunction; ``date_only``: columns cut to days;
    ``date``: the key column whose value, the row's partition, may not change from load to load."""

    name: str
    fields: Sequence[str]
    columns: dict[str, str]
    keys: Sequence[str]
    mapping: dict[str, str] = field(default_factory=dict)
    defaults: dict[str, str] = field(default_factory=dict)
    filters: Sequence[str] = ()
    cursor: Sequence[str] = ()
    date_only: Sequence[str] = ()
    increment: str | None = None
    table: str | None = None
    date: str | None = None

    def __post_init__(self):
        for c in (*self.columns, *self.keys):
            identifier(c)
        missing = [k for k in self.cursor if k not in self.fields]
        if missing:
            raise ValueError(f"{self.name}: cursor keys are not read: {missing}")

    @property
    def table_name(self) -> str:
        return self.table or self.name.replace(" ", "").lower()

    @property
    def identity(self) -> list[str]:
        """The key without its date."""
        return [k for k in self.keys if k != self.date]

    def sources(self, column: str) -> list[str]:
        """Source fields for a target column, first choice first: its own name, then mapped fields, then fields that
        match without regard to case, then the part of a field before its dot."""
        low = column.lower()
        choices = [f for f in self.fields if f == column]
        choices += [f for f in self.fields if self.mapping.get(f) == column]
        unmapped = [f for f in self.fields if self.mapping.get(f) not in self.columns]
        choices += [f for f in unmapped if f.lower() == low]
        choices += [f for f in unmapped if "." in f and f.split(".", 1)[0].lower() == low]
        return list(dict.fromkeys(choices))

    def resolved(self) -> dict[str, list[str]]:
        found = {c: s for c in self.columns if (s := self.sources(c))}
        if not found:
            raise ValueError(f"{self.name}: no field matches a column")
        return found


def quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def scan(rows: DataFrame, spec: TableSpec) -> DataFrame:
    """The spec's filter and fields of landed rows; both reach a Parquet scan."""
    for f in spec.filters:
        rows = rows.where(F.expr(f))
    return rows.select(*(quoted(f) for f in spec.fields if f in rows.columns))


def whole(value: Column, kind: str, double: bool = False) -> Column:
    """A whole number of any size that its type holds, also where it comes as 12.0 or 1.2E1; null where it has a fraction.

    ``double``: of doubles, those that are whole and small enough to be exact need no decimal."""
    exact = value.try_cast("decimal(38,12)")
    slow = F.when(exact == F.floor(exact), exact.cast("decimal(38,0)")).try_cast(kind)
    if not double:
        return slow
    small = (F.abs(value) < 2.0**53) & (F.rint(value) == value)
    return F.when(small, F.when(small, value).cast("bigint").try_cast(kind)).otherwise(slow)


WHOLE = ("tinyint", "smallint", "int", "bigint", "long")


def numbers(rows: DataFrame, sources: Sequence[Column], kind: str, name: str) -> tuple[dict[str, Column], Column, Column]:
    """(columns to compute first, value, whether a value that is there and not blank doesn't fit ``kind``).

    Numbers that come as such need no text. Of texts, those that a cast takes as they are need no cleaning; what the cast
    makes of a text, and the cleaned text of the others, are columns of their own, so that each is computed once. A cast that
    fails costs an exception, far more than one that doesn't: texts with a point go to decimals at once."""
    types = {t for t in (rows.select(s).schema[0].dataType.simpleString() for s in sources)}
    raw = F.col(f"__raw_{name}")
    if len(types) == 1 and (types <= {*WHOLE, "double"} or next(iter(types)).startswith("decimal") and int(next(iter(types)).rstrip(")").split(",")[1]) <= 12):
        direct = raw.try_cast(kind) if kind not in WHOLE or types <= set(WHOLE) else whole(raw, kind, types == {"double"})
        return {f"__raw_{name}": F.coalesce(*sources)}, direct, raw.isNotNull() & direct.isNull()
    fits, rest = F.col(f"__fits_{name}"), F.col(f"__rest_{name}")
    value = F.coalesce(fits, rest.try_cast(kind), *([whole(rest, kind)] if kind in WHOLE else []))
    first = {f"__raw_{name}": F.coalesce(*(s.cast("string") for s in sources))}
    first[f"__fits_{name}"] = F.when(raw.contains("."), whole(raw, kind)).otherwise(raw.try_cast(kind)) if kind in WHOLE else raw.try_cast(kind)
    first[f"__rest_{name}"] = F.when(fits.isNull() & raw.isNotNull(), X.trim_all(raw))
    return first, value, (F.coalesce(rest, F.lit("")) != "") & value.isNull()


def normalize(rows: DataFrame, spec: TableSpec, stamp: str | None = None, defaults: dict[str, str] | None = None, bad: str | None = None, unread: str | None = None) -> DataFrame:
    """Mapped to the target's columns: first source that isn't null, cleaned and typed; then defaults and the load stamp.

    ``defaults`` of a manifest give way to the spec's own. ``bad`` names a column that says whether a value that is there,
    and not blank, isn't a number of its column's type: such a row can't be loaded as it is. ``unread`` names one that says
    whether a time that is there is no time, and so becomes null. A column of which no field has landed, and that has no
    default, isn't in the result."""
    every = (defaults or {}) | spec.defaults
    first: dict[str, Column] = {}
    second: dict[str, Column] = {}
    third: dict[str, Column] = {}
    out, unfit, lost = [], F.lit(False), F.lit(False)
    for column, kind in spec.columns.items():
        sources = [quoted(f) for f in spec.sources(column) if f in rows.columns]
        if not sources and column not in every:
            continue
        if not sources:
            value = F.lit(None).cast(kind)
        elif kind.startswith("timestamp"):
            first[f"__raw_{column}"] = F.coalesce(*(s.cast("string") for s in sources))
            raw = F.col(f"__raw_{column}")
            value = X.date_only(raw) if column in spec.date_only else X.whole_seconds(raw)
            lost = lost | (value.isNull() & (F.trim(raw) != ""))
        elif kind == "string":
            first[f"__raw_{column}"] = F.coalesce(*(s.cast("string") for s in sources))
            value = X.normalized(F.col(f"__raw_{column}"))
        else:
            more, value, off = numbers(rows, sources, kind, column)
            first |= {k: v for k, v in more.items() if k.startswith("__raw_")}
            second |= {k: v for k, v in more.items() if k.startswith("__fits_")}
            third |= {k: v for k, v in more.items() if k.startswith("__rest_")}
            unfit = unfit | off
        if column in every:
            value = F.coalesce(value, F.lit(every[column]).cast(kind))
        out.append(value.alias(column))
    if stamp is not None:
        out.append(F.lit(stamp).cast("timestamp_ntz").alias("sync_time"))
    if bad is not None:
        out.append(unfit.alias(bad))
    if unread is not None:
        out.append(F.coalesce(lost, F.lit(False)).alias(unread))
    raw = rows.select(*(v.alias(k) for k, v in first.items())) if first else rows
    for step in (second, third):
        raw = raw.select("*", *(v.alias(k) for k, v in step.items())) if step else raw
    return raw.select(*out)


def increment_field(spec: TableSpec, by_table: dict[str, str], default: str = "FModifyDate") -> str:
    return by_table.get(spec.table_name) or spec.increment or default


def table_names(name: Column, mapped: dict[str, str] | None = None) -> Column:
    """The table of a form: mapped, else the form's name in lower case without spaces."""
    own = F.lower(F.replace(name, F.lit(" "), F.lit("")))
    return F.coalesce(looked_up(name, mapped), own) if mapped else own


def increment_fields(form: Column, by_table: dict[str, str], by_form: dict[str, str], default: str = "FModifyDate", mapped: dict[str, str] | None = None) -> Column:
    """The change field of a form: that of its table, else its own, else the default."""
    return F.coalesce(looked_up(table_names(form, mapped), by_table), looked_up(form, by_form), F.lit(default))


def looked_up(key: Column, known: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in known.items() for x in kv))[key] if known else F.lit(None).cast("string")


def cursor_faults(specs: DataFrame) -> DataFrame:
    """(form_name, missing): cursor keys of specs (form_name, fields, cursor) that aren't among the fields that are read."""
    return specs.select("form_name", F.explode(F.array_except("cursor", "fields")).alias("missing"))


def key_columns(spec: TableSpec, rows: DataFrame) -> DataFrame:
    """(table, position, column, n_values): a table's keys in their order, and the different values that rows have."""
    per = [rows.agg(F.count_distinct(F.struct(k)).alias("n_values")).select(F.lit(spec.table_name).alias("table"), F.lit(i).alias("position"), F.lit(k).alias("column"), "n_values") for i, k in enumerate(spec.keys, 1)]
    out = per[0]
    for p in per[1:]:
        out = out.unionAll(p)
    return out


def priority(name: Column) -> Column:
    pairs = [F.lit(x) for k, v in PRIORITY.items() for x in (k, v)]
    return F.coalesce(F.create_map(*pairs)[name], F.lit(1))


def enabled(configured: DataFrame, disabled: DataFrame) -> DataFrame:
    return configured.join(disabled.select("form_name").distinct(), "form_name", "left_anti").orderBy("form_name")


def catalogue(stored: DataFrame, configured: DataFrame) -> DataFrame:
    """Stored specs, and configured ones of other names."""
    return stored.unionByName(configured.join(stored.select("form_name").distinct(), "form_name", "left_anti"), allowMissingColumns=True)


def category_order(name: Column, ranks: dict[str, int]) -> list[Column]:
    pairs = [F.lit(x) for k, v in ranks.items() for x in (k, v)]
    return [F.coalesce(F.create_map(*pairs)[name], F.lit(999)), name]
