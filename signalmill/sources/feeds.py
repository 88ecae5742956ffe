"""Readers and writers of landed payload files, all with explicit schemas.

A payload that doesn't parse is kept as a corrupt line where lines are records; missing fields are null.
Payloads are files, or lines of files where ``lines`` is set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalmill.sources.landing import folder_names, landing_dir

HISTORY = "symbol string, timestamp string, catalyst string, link string, image_url string, media_id string, _corrupt_record string"
MARKET = "symbol string, name string, current_price double, price_change_percentage_24h double, total_volume double, market_cap double, sparkline_in_7d struct<price:array<double>>"
EXCHANGE = "symbols array<struct<baseAsset:string,status:string,isSpotTradingAllowed:boolean>>"
CATALOGS = "code string, data struct<catalogs:array<struct<catalogId:long,articles:array<struct<title:string,releaseDate:long>>>>>"
RANKS = (
    "code string, rank_type int, chain_id string, data struct<tokens:array<struct<symbol:string,price:string,percentChange24h:string,volume24h:string,"
    "marketCap:string,liquidity:string,searchCount24h:string,smartMoneyHoldingPercent:string,kolHoldingPercent:string,tokenTag:string,"
    "metaInfo:struct<name:string>,auditInfo:struct<riskLevel:int>>>>"
)
TRENDING = "coins array<struct<item:struct<symbol:string,name:string,score:int>>>"
TICKER = "symbol string, lastPrice string, priceChangePercent string, quoteVolume string, count long"
#: What a partition's folder is called where the value is null: a fixed value.
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
OK_CODE = "000000"
#: Announcement catalogues and what they mean: fixed values.
CATALOG_KINDS = {48: ("new_listing", "high"), 128: ("airdrop", "high"), 161: ("delisting", "high"), 49: ("news", "medium")}
#: Rank lists by their type: fixed values.
RANK_SOURCES = {10: "trending", 11: "top_search", 20: "alpha", 30: "smart_money", 40: "stock", 50: "futures"}


def mapped(key: Column, values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[key]


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Post history lines, older ones with fewer fields; bad lines stay, in _corrupt_record."""
    return spark.read.schema(HISTORY).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def append_history(posts: DataFrame, path: str) -> None:
    """Add records; a failed job adds none, by Spark's commit."""
    posts.select("symbol", "timestamp", "catalyst", "link", F.coalesce("image_url", F.lit("")).alias("image_url"), F.coalesce("media_id", F.lit("")).alias("media_id")).write.mode("append").json(path)


def read_market(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Market snapshots, files of one array each, as asset rows with up to ten history points."""
    raw = spark.read.schema(MARKET).option("multiLine", not lines).json(path).withColumn("snapshot_id", F.input_file_name())
    history = F.coalesce("sparkline_in_7d.price", F.array().cast("array<double>"))
    cap, volume = F.coalesce("market_cap", F.lit(0.0)), F.coalesce("total_volume", F.lit(0.0))
    return raw.select(
        "snapshot_id", F.upper(F.trim("symbol")).alias("symbol"), F.coalesce("name", "symbol").alias("name"), F.coalesce("current_price", F.lit(0.0)).alias("price"),
        F.coalesce("price_change_percentage_24h", F.lit(0.0)).alias("change_24h"), volume.alias("volume_24h"), cap.alias("market_cap"),
        F.slice(history, F.greatest(F.size(history) - 9, F.lit(1)), F.lit(10)).alias("history"),
    )


def read_listed(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Tradable base assets, each once."""
    pairs = spark.read.schema(EXCHANGE).option("multiLine", not lines).json(path).select(F.explode("symbols").alias("s"))
    return pairs.where((F.col("s.status") == "TRADING") & F.col("s.isSpotTradingAllowed")).select(F.upper("s.baseAsset").alias("symbol")).distinct()


def read_announcements(spark: SparkSession, path: str, per_catalog: int = 5, lines: bool = False) -> DataFrame:
    """The first articles of each catalogue page with type and impact, in the order of the page."""
    pages = spark.read.schema(CATALOGS).option("multiLine", not lines).json(path).withColumn("snapshot_id", F.input_file_name())
    articles = (
        pages.where(F.col("code") == OK_CODE).select("snapshot_id", F.explode("data.catalogs").alias("c"))
        .select("snapshot_id", F.col("c.catalogId").alias("catalog_id"), F.posexplode("c.articles").alias("ord", "a")).where(F.col("ord") < per_catalog)
    )
    kinds = {k: v[0] for k, v in CATALOG_KINDS.items()}
    impacts = {k: v[1] for k, v in CATALOG_KINDS.items()}
    key = F.col("catalog_id").cast("int")
    return articles.where(key.isin(*CATALOG_KINDS)).select(
        "snapshot_id", "ord", mapped(key, kinds).alias("ann_type"), mapped(key, impacts).alias("impact"), F.col("a.title").alias("title"), F.timestamp_millis("a.releaseDate").alias("released_at")
    )


def read_rank_lists(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Tokens of rank list pages with their position in the page."""
    pages = spark.read.schema(RANKS).option("multiLine", not lines).json(path).where(F.col("code") == OK_CODE)
    t = pages.select("rank_type", "chain_id", F.posexplode("data.tokens").alias("ord", "t"))
    real = lambda c: F.coalesce(F.col(f"t.{c}").try_cast("double"), F.lit(0.0))
    return t.where(F.trim("t.symbol") != "").select(
        "rank_type", mapped(F.col("rank_type"), RANK_SOURCES).alias("source"), "chain_id", "ord", F.upper(F.trim("t.symbol")).alias("symbol"),
        F.coalesce("t.metaInfo.name", "t.symbol").alias("name"), real("price").alias("price"), real("percentChange24h").alias("change_24h"), real("volume24h").alias("volume_24h"),
        real("marketCap").alias("market_cap"), real("liquidity").alias("liquidity"), real("searchCount24h").alias("search_count"), F.col("t.smartMoneyHoldingPercent").try_cast("double").alias("smart_money_pct"),
        real("kolHoldingPercent").alias("kol_pct"), F.col("t.tokenTag").isNotNull().alias("tagged"), F.coalesce("t.auditInfo.riskLevel", F.lit(1)).alias("risk_level"),
    )


def read_trending(spark: SparkSession, path: str, limit: int = 15, lines: bool = False) -> DataFrame:
    """Trending searches in list order."""
    return (
        spark.read.schema(TRENDING).option("multiLine", not lines).json(path).select(F.posexplode("coins").alias("ord", "c")).where(F.col("ord") < limit)
        .select("ord", F.upper("c.item.symbol").alias("symbol"), F.col("c.item.name").alias("name"), F.coalesce("c.item.score", F.lit(0)).alias("search_score"))
    )


def read_tickers(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Exchange tickers, one row per pair."""
    raw = spark.read.schema(TICKER).option("multiLine", not lines).json(path)
    real = lambda c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))
    return raw.select("symbol", real("lastPrice").alias("price"), real("priceChangePercent").alias("change_24h"), real("quoteVolume").alias("volume_24h"), F.coalesce("count", F.lit(0)).alias("trades"))


def read_candles(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Closes of hourly candles, arrays of arrays with the close fifth; bad candles are left out."""
    raw = spark.read.option("wholetext", not lines).text(path).select(F.input_file_name().alias("source"), F.from_json("value", "array<array<string>>").alias("c"))
    out = raw.select("source", F.posexplode("c").alias("ord", "candle")).select("source", "ord", F.get("candle", F.lit(4)).try_cast("double").alias("close_px"))
    return out.where("close_px is not null")


def reconciled(old: DataFrame, new: DataFrame) -> DataFrame:
    """Records of two layouts; what the older one lacks is empty text."""
    both = old.unionByName(new, allowMissingColumns=True)
    return both.withColumns({c: F.coalesce(c, F.lit("")) for c in ("image_url", "media_id") if c in both.columns})


def else_fallback(primary: DataFrame, fallback: DataFrame, group: str) -> DataFrame:
    """All of primary, and fallback for the groups that primary hasn't."""
    return primary.unionByName(fallback.join(primary.select(group).distinct(), group, "left_anti").select(*primary.columns))


def write_table(rows: DataFrame, path: str, at: str = "created_at") -> None:
    """Append to a Parquet table partitioned by day."""
    rows.withColumn("day", F.to_date(at)).write.mode("append").partitionBy("day").parquet(path)


def write_artifacts(rows: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Packages, posts and rejected drafts by day and status. Rows are brought together by both first, and large parts are cut
    again, so that the number of files follows the bytes (``spark.sql.adaptive.advisoryPartitionSizeInBytes``) and not the tasks."""
    rows.hint("rebalance", "day", "status").write.mode("append").option("maxRecordsPerFile", rows_per_file).partitionBy("day", "status").parquet(path)


def compact_artifacts(spark: SparkSession, path: str, small: int = 32 << 20, least: int = 4) -> list[tuple[str, str]]:
    """Rewrite the days and statuses that have at least ``least`` files under ``small`` bytes; which ones those were.
    Days are dates and statuses are words; nulls are parts of their own, shown as their folders' name for them.

    Files are listed by Spark without being read. The rewritten parts are staged beside the table and then replace just their
    partitions by dynamic overwrite; others keep their files. Nobody else may write meanwhile; a run that broke off can be
    repeated. A table that has only large files, or no files, stays as it is.
    """
    if not folder_names(spark, path):
        return []
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path).select("path", "length")
    part = lambda name: F.url_decode(F.replace(F.regexp_extract("path", f"/{name}=([^/]*)/", 1), F.lit("+"), F.lit("%2B")))
    crowded = files.where(F.col("length") < small).groupBy(part("day").alias("day"), part("status").alias("status")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    chosen = sorted((r.day, r.status) for r in crowded.collect())  # days of the calendar times statuses
    if not chosen:
        return []
    table = spark.read.parquet(path)
    day, status = (F.coalesce(F.col(c).cast("string"), F.lit(NO_VALUE)) for c in ("day", "status"))
    named = F.struct(day, status)
    rows = table.where(day.isin(sorted({d for d, _ in chosen})) & named.isin(*[F.struct(F.lit(d), F.lit(s)) for d, s in chosen]))
    staged = f"{landing_dir(spark)}/compacted"
    rows.hint("rebalance", "day", "status").write.partitionBy("day", "status").parquet(staged)
    spark.read.schema(table.schema).parquet(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "status").parquet(path)
    return chosen


def post_record(raw: DataFrame) -> DataFrame:
    """Content and symbol from either of their names; what is left becomes JSON metadata.

    ``raw``: fields map<string,string>.
    """
    own = ["content", "text", "coin_symbol", "symbol"]
    f = F.col("fields")
    return raw.select(
        F.coalesce(F.nullif(F.try_element_at(f, F.lit("content")), F.lit("")), F.try_element_at(f, F.lit("text")), F.lit("")).alias("content"),
        F.coalesce(F.try_element_at(f, F.lit("coin_symbol")), F.try_element_at(f, F.lit("symbol"))).alias("coin_symbol"),
        F.to_json(F.map_filter(f, lambda k, _: ~k.isin(*own))).alias("metadata"),
    )


def latest_page_order(rows: DataFrame, *by: str) -> DataFrame:
    """Position of each row in its page, from 1."""
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy("ord")))
