"""Joins of assets with announcements, dimensions and topics.

Dimensions are tables (ord, topic or category, symbol); ``ord`` is the order in which entries are tried.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from signalmill.functions.text import title_symbols, title_words
from signalmill.sources.landing import written

#: Strength of announcement types: fixed values.
PRIORITIES = {"new_listing": 10, "launchpool": 9, "megadrop": 9, "airdrop": 8, "delisting": 6, "news": 3}
#: Narratives looked for in titles: fixed values.
NARRATIVES = ("AI", "AGENT", "MEME", "L1", "L2", "DeFi", "RWA", "GAMING", "DePIN", "INFRA", "EXCHANGE", "BTC", "ETF", "AIRDROP", "LISTING")


#: Rows of a word that one task gets at most, or nearly so.
FREQUENT = 1 << 16


def _title_candidates(announcements: DataFrame) -> DataFrame:
    """Whatever may be a symbol in a title, a row each."""
    marks = F.regexp_extract_all("title", F.lit("\\(([A-Z0-9]{2,10})\\)"), F.lit(1))
    candidates = F.concat(marks, F.array_except(title_words(F.col("title")), marks))
    return announcements.select("ann_id", "ann_type", "title", F.explode(candidates).alias("symbol"))


def mentions(announcements: DataFrame, known: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """(ann_id, ann_type, title, symbol) for each known symbol of a title: those in parentheses as often as they occur,
    then other words once.

    A title's candidates are joined once with the known symbols, so that table may be of any size. Words that most titles
    hold are no reason for a large task: candidates are counted first, and the few with more than ``frequent`` rows go
    before the join if they aren't known, else they are dealt to several tasks.
    """
    words, known = _title_candidates(announcements), known.select("symbol").distinct()
    often = words.groupBy("symbol").agg(F.count("*").alias("n")).where(F.col("n") > frequent).join(known.withColumn("known", F.lit(True)), "symbol", "left")
    often = F.broadcast(often.select("symbol", F.when(F.col("known"), F.ceil(F.col("n") / frequent)).otherwise(0).cast("long").alias("shares")))
    shares = F.coalesce("shares", F.lit(1).cast("long"))
    dealt, held = (df.join(often, "symbol", "left").where(shares > 0) for df in (words, known))
    dealt = dealt.withColumn("share", F.pmod(F.xxhash64("ann_id"), shares)).drop("shares")
    held = held.select("symbol", F.explode(F.sequence(F.lit(0).cast("long"), shares - 1)).alias("share"))
    return dealt.join(held, ["symbol", "share"]).select("ann_id", "ann_type", "title", "symbol")


def _first_of_types(named: DataFrame) -> DataFrame:
    """Each symbol's first announcement of each type. A number per symbol and type: hashed, never sorted."""
    return named.groupBy("symbol", "ann_type").agg(F.min("ann_id").alias("ann_id"))


def first_mentions(announcements: DataFrame, known: DataFrame) -> DataFrame:
    """(symbol, ann_type, ann_id) of the first announcement of each type that names a known symbol: all of ``mentions``
    that the first or strongest one hangs on. What titles have in common is brought together before it is joined."""
    return _first_of_types(_title_candidates(announcements)).join(known.select("symbol").distinct(), "symbol")


def with_symbols(announcements: DataFrame, known: DataFrame) -> DataFrame:
    """Announcements with the known symbols of their titles; those without any are left out."""
    hits = mentions(announcements, known).groupBy("ann_id").agg(F.collect_set("symbol").alias("known"))
    return announcements.join(hits, "ann_id").withColumn("symbols", title_symbols(F.col("title"), F.col("known"))).drop("known")


def first_announcement(assets: DataFrame, named: DataFrame) -> DataFrame:
    """Each asset with the first announcement that names it; without one it is a market move."""
    first = _first_of_types(named).groupBy("symbol").agg(F.min_by(F.struct("ann_id", "ann_type"), "ann_id").alias("a"))
    return assets.join(first, "symbol", "left").select(*assets.columns, F.col("a.ann_id").alias("ann_id"), F.coalesce("a.ann_type", F.lit("market_move")).alias("catalyst"))


def priority(kind: Column) -> Column:
    out = F.lit(0)
    for k, v in PRIORITIES.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def strongest_catalyst(named: DataFrame) -> DataFrame:
    """Each symbol's announcement of highest priority, the earliest of equals."""
    best = _first_of_types(named).withColumn("priority", priority(F.col("ann_type"))).groupBy("symbol").agg(F.max_by(F.struct("ann_id", "ann_type", "priority"), F.struct("priority", -F.col("ann_id"))).alias("a"))
    return best.select("symbol", "a.ann_id", F.col("a.ann_type").alias("catalyst"), "a.priority")


def narratives_in(titles: DataFrame, names=NARRATIVES, whole_words: bool = False) -> DataFrame:
    """(ann_id, narrative) of each narrative name that occurs in a title, case aside: anywhere, so that "AI" is in
    "airdrop", or only as a word of its own."""
    low = F.lower("title")
    if whole_words:
        low = F.concat(F.lit(" "), F.regexp_replace(low, "[^a-z0-9]+", " "), F.lit(" "))
    hit = F.filter(F.array(*[F.lit(n) for n in names]), lambda n: F.contains(low, F.concat(F.lit(" "), F.lower(n), F.lit(" ")) if whole_words else F.lower(n)))
    return titles.select("ann_id", F.explode(hit).alias("narrative"))


#: Names of one automaton, in bytes.
BLOCK_BYTES = 8 << 20


def automaton(held: pa.Table):
    """An automaton of the keys of (key, names) that gives places in the table. A name costs it no objects of its own,
    which would take several times the memory of the names."""
    import ahocorasick

    tree, place = ahocorasick.Automaton(ahocorasick.STORE_INTS), 0
    for chunk in held["key"].chunks:
        for key in chunk:
            tree.add_word(key.as_py(), place)
            place += 1
    tree.make_automaton()
    return tree


def found_in(texts: DataFrame, names: DataFrame, any_case: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, name) for each of ``names`` (name) that occurs anywhere in a text of ``texts`` (id, text), each pair once if ids and
    names are distinct; with ``any_case`` case aside. Null and empty names are in no text, null and empty texts hold none.

    Tasks run over their texts with an Aho-Corasick automaton, so that a text is read once whatever the number and the
    length of names, and neither side is shuffled or cut into substrings. Names are dealt to blocks by hash until
    no block has more than ``block_bytes`` (or just one name); each block is broadcast by itself and read against all texts.
    """
    spark = texts.sparkSession
    own = F.lower if any_case else lambda c: F.col(c)
    kept = written(names.select("name", own("name").alias("key")).where("key <> ''").distinct(), "names")
    blocks = 1
    while True:
        block = F.pmod(F.xxhash64("key"), F.lit(blocks))
        most = kept.groupBy(block.alias("b")).agg(F.sum(F.octet_length("key") + F.octet_length("name")).alias("size"), F.count_distinct("key").alias("n")).where("n > 1").agg(F.max("size")).first()[0]
        if (most or 0) <= block_bytes:
            break
        blocks *= 2

    def scan(held):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree, names = automaton(held.value), held.value["names"].combine_chunks()
            for batch in batches:
                rows, found = [], []
                for row, text in enumerate(batch.column(1).to_pylist()):
                    hits = {place for _, place in tree.iter(text)}
                    found += hits
                    rows += [row] * len(hits)
                spellings = names.take(pa.array(found, pa.int64()))
                ids = batch.column(0).take(pa.array(rows, pa.int64())).take(pc.list_parent_indices(spellings))
                yield pa.RecordBatch.from_arrays([ids, spellings.flatten()], ["id", "name"])

        return run

    read = texts.select("id", own("text").alias("text")).where("text <> ''")
    schema = StructType([read.schema["id"], StructField("name", StringType())])
    out = spark.createDataFrame([], schema)
    for b in range(blocks):
        held = kept.where(block == b).groupBy("key").agg(F.collect_list("name").alias("names")).toArrow()  # at most block_bytes
        if held.num_rows:
            out = out.unionByName(read.mapInArrow(scan(spark.sparkContext.broadcast(held)), schema))
    return out


def assets_of_topics(topics: DataFrame, dim: DataFrame, strict_case: bool = False) -> DataFrame:
    """Assets of each topic: of the entry equal to it, else of the first entry that contains it or is
    contained in it, else the topic itself if it looks like a symbol (2 to 10 letters), else none. Case and blanks
    around it aside; with ``strict_case`` entries count as they are written, which those in mixed case never match.

    What is left after a join by equality is searched for entries, and entries are searched for it.
    """
    entries = dim.groupBy((F.col("topic") if strict_case else F.upper("topic")).alias("entry")).agg(F.min("ord").alias("ord"), F.array_sort(F.collect_set("symbol")).alias("assets"))
    entries = written(entries, "entries")  # read several times, as what is left is
    keys = topics.select("topic").distinct().withColumn("key", F.upper(F.trim("topic")))
    equal = written(keys.join(entries, F.col("key") == F.col("entry"), "left").select("topic", "key", "assets"), "equal")
    rest = equal.where("assets is null").select("topic", "key")
    as_text, as_name = (lambda df, c: df.select(F.col(c).alias("id"), F.col(c).alias("text")).distinct()), (lambda df, c: df.select(F.col(c).alias("name")))
    holding = found_in(as_text(rest, "key"), as_name(entries, "entry")).select(F.col("id").alias("key"), F.col("name").alias("entry"))
    held = found_in(as_text(entries, "entry"), as_name(rest, "key")).select(F.col("name").alias("key"), F.col("id").alias("entry"))
    inside, around = (pairs.join(rest, "key").join(entries, "entry") for pairs in (holding, held))
    near = inside.select("topic", "ord", "entry", "assets").unionByName(around.select("topic", "ord", "entry", "assets"))
    part = near.groupBy("topic").agg(F.min_by("assets", F.struct("ord", "entry")).alias("assets"))
    itself = F.when(F.col("key").rlike("^[A-Z]{2,10}$"), F.array("key")).otherwise(F.array().cast("array<string>"))
    found = equal.where("assets is not null").select("topic", "assets").unionByName(
        rest.join(part, "topic", "left").select("topic", F.coalesce("assets", itself).alias("assets"))
    )
    return topics.join(found, "topic")


def first_entry(rows: DataFrame, dim: DataFrame, name: str, otherwise: str) -> DataFrame:
    """Each row's symbol with the first dimension entry that lists it."""
    first = dim.groupBy("symbol").agg(F.min_by(name, F.struct("ord", name)).alias("entry"))
    return rows.join(first, "symbol", "left").withColumn("entry", F.coalesce("entry", F.lit(otherwise)))


def hot_score(assets: DataFrame, topics: DataFrame) -> DataFrame:
    """Each asset's highest score over the topics that list or equal it; 0 without one."""
    keys = topics.select(F.explode(F.array_distinct(F.transform(F.concat("assets", F.array("topic")), F.upper))).alias("key"), "hot_search_score")
    best = keys.groupBy("key").agg(F.max("hot_search_score").alias("hot_score"))
    return assets.join(best, F.upper("symbol") == F.col("key"), "left").select("symbol", F.coalesce("hot_score", F.lit(0.0)).alias("hot_score"))
