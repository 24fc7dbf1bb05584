"""Ingestion jobs: conform, coverage gates, adjusted bars, keyed upserts, snapshots, fingerprints, pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import coerce_number, nonzero, normalize_code

# Aliases of quote columns, canonical name first.
ALIASES = {
    "code": ("code", "ts_code", "代码", "股票代码"), "name": ("name", "名称", "股票简称"), "price": ("price", "最新价", "close", "收盘"), "pct_chg": ("pct_chg", "涨跌幅"),
    "volume": ("volume", "vol", "成交量"), "turnover": ("turnover", "amount", "成交额"), "high": ("high", "最高"), "low": ("low", "最低"), "open": ("open", "今开", "开盘"),
}
TEXT = ("code", "name")

SNAPSHOT_RANGE = 1024  # ids of a leaf


def conform(df: DataFrame, aliases: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Raw columns -> canonical ones: the first alias that is there and not blank; numbers cleaned, absent ones 0."""
    out = []
    for name, options in (aliases or ALIASES).items():
        there = [F.col(f"`{o}`") for o in options if o in df.columns]
        if name in TEXT:
            c = F.coalesce(*[nonblank(x) for x in there], F.lit("")) if there else F.lit("")
            out.append((normalize_code(c) if name == "code" else c).alias(name))
        else:
            out.append(F.coalesce(*[coerce_number(x, None) for x in there], F.lit(0.0)).alias(name) if there else F.lit(0.0).alias(name))
    return df.select(*out)


def nonblank(c: Column) -> Column:
    t = F.trim(c.cast("string"))
    return F.when(t != "", t)


def coverage_gate(raw: DataFrame, expected: int, ratio: float = 0.98) -> DataFrame:
    """One row: unique six-digit codes, how many are required, whether the batch passes."""
    codes = raw.where(F.col("code").rlike(r"^\d{6}$")).agg(F.countDistinct("code").alias("actual"))
    need = F.ceil(F.lit(expected * ratio)).cast("bigint")
    return codes.select(F.lit(expected).cast("bigint").alias("expected"), "actual", need.alias("required"), (F.col("actual") >= need).alias("passed"))


def latest_by_key(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first in `order`."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, key: list[str], version: str) -> DataFrame:
    """Last write wins; of equal versions the new row."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return latest_by_key(both, key, [F.desc(version), F.desc("_new")]).drop("_new")


def adjusted_bars(raw: DataFrame, adjusted: DataFrame) -> DataFrame:
    """Raw and adjusted bars aligned: a code without raw bars uses its adjusted ones as raw and the other way round; missing
    adjusted prices are the raw ones; factor = adjusted close / close to 8 digits, 1 where either is not positive."""
    key = ["code", "trade_date"]
    raw = raw.unionByName(adjusted.join(raw.select("code").distinct(), "code", "left_anti"))
    a = adjusted.select(*key, *[F.col(c).alias(f"adj_{c}") for c in ("open", "high", "low", "close")])
    j = raw.join(a, key, "left")
    j = j.select(*raw.columns, *[F.coalesce(f"adj_{c}", c).alias(f"adj_{c}") for c in ("open", "high", "low", "close")])
    ok = (F.col("close") > 0) & (F.col("adj_close") > 0)
    return j.withColumn("adj_factor", F.when(ok, F.round(F.col("adj_close") / nonzero(F.col("close")), 8)).otherwise(1.0))


def last_bars(bars: DataFrame, n: int) -> DataFrame:
    """The last max(6, n) bars of each code."""
    w = Window.partitionBy("code").orderBy(F.desc("trade_date"))
    return bars.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= max(6, n)).drop("_n")


def work_list(codes: DataFrame, bars: DataFrame, end: str) -> DataFrame:
    """Codes whose latest bar is before `end`, those without any first."""
    latest = bars.groupBy("code").agg(F.max("trade_date").alias("latest"))
    return codes.join(latest, "code", "left").where(F.col("latest").isNull() | (F.col("latest") < F.lit(end).cast("date")))


def enrich(df: DataFrame, other: DataFrame, key: str, columns: list[str], order: str) -> DataFrame:
    """Fill nulls or zeros of `columns` from the last row of another source."""
    last = latest_by_key(other, [key], [F.desc(order)]).select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    j = df.join(last, key, "left")
    return j.select(*[F.coalesce(nonzero(F.col(c)), F.col(f"_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def overlay(df: DataFrame, newer: DataFrame, key: str, columns: list[str], order: str) -> DataFrame:
    """Columns of the newest row of `newer` where there is one, else as they are."""
    last = latest_by_key(newer, [key], [F.desc(order)]).select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    j = df.join(last, key, "left")
    return j.select(*[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def merge_by_priority(sources: list[DataFrame], key: str, columns: list[str]) -> DataFrame:
    """Rows of several sources, later ones stronger, but only where they are not null: field by field."""
    both = None
    for i, s in enumerate(sources):
        s = s.select(key, *columns).withColumn("_p", F.lit(i))
        both = s if both is None else both.unionByName(s)
    return both.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_p"))).alias(c) for c in columns])


def fingerprint(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Order-free content hash: rows, xor and sum of row hashes; a change of any cell changes it."""
    cols = sorted(c for c in df.columns if c not in (by or []))
    h = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in cols])
    return df.groupBy(*(by or [])).agg(F.count("*").alias("rows"), F.bit_xor(h).alias("xor_hash"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("sum_hash"))


def snapshot_rows(quotes: DataFrame, snapshot_id: str) -> DataFrame:
    """Universe rows of a snapshot: status by name, first row of a code."""
    name = F.coalesce("name", F.lit(""))
    q = latest_by_key(quotes, ["trade_date", "code"], [F.col("id")])
    return q.select(F.lit(snapshot_id).alias("snapshot_id"), "trade_date", "code", name.rlike("(?i)ST").alias("is_st"), name.contains("退").alias("is_delisting"), F.when(F.col("price") > 0, "trading").otherwise("suspended").alias("status"))


def snapshot_hash(quotes: DataFrame) -> DataFrame:
    """SHA-256 of each date's rows: an immutable snapshot's content, as a tree of hashes.

    Rows go to ranges of SNAPSHOT_RANGE ids, in the order of id, ranges to their date: neither is one row for a whole date.
    """
    def joined(*of: str) -> Column:
        return F.sha2(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct(*of))), lambda x: x[of[-1]])), 256)

    row = F.sha2(F.concat_ws("|", "code", *[F.coalesce(F.col(c).cast("decimal(18,2)").cast("string"), F.lit("")) for c in ("price", "turnover")]), 256)
    leaves = quotes.select("trade_date", "id", F.floor(F.col("id") / SNAPSHOT_RANGE).alias("range"), row.alias("h")).groupBy("trade_date", "range").agg(joined("id", "h").alias("h"), F.count("*").alias("n"))
    return leaves.groupBy("trade_date").agg(joined("range", "h").alias("content_hash"), F.sum("n").alias("rows"))


def prune(parents: DataFrame, children: DataFrame, group: str, allowed: list[str], key: str) -> tuple[DataFrame, DataFrame]:
    """Parents of allowed groups, and the children that still have one."""
    kept = parents.where(F.col(group).isin(*allowed))
    return kept, children.join(kept.select(key), key, "left_semi")
