"""Secret scan by corpus-wide ownership frequency, in DataFrame functions alone.

Three base patterns give spans that are always reported (see ``BASE``). Beside them every long run of letters,
digits and ``+/_-`` that looks random (``LOOSE_RUN``: letters and digits, enough different characters) is a
candidate. What tells a live credential from an example is who holds it: values of base spans and loose runs are
hashed, and each hash is counted by its distinct owners and distinct repositories in the whole corpus. One that
occurs with few owners and in few repositories is *owned*; others are widely copied examples. Loose runs that are
owned become spans of kind ``owned``; base spans stay, and are counted as owned or copied.

1. One scan of the texts. Pieces between matches and the matches themselves give gaps and lengths, so that no
   position has to be searched for; texts and values don't leave the scan, only lengths and SHA-256 digests do.
2. Positions are running sums over a document's matches.
3. Frequencies: (digest, bucket, repository, owner) is made distinct before anything meets by digest. Counts of
   distinct owners and repositories are partial sums as well.
4. The verdict goes back to the matches by (digest, bucket), with ``BUCKETS`` buckets of documents, so that a
   digest which a third of all rows hold isn't one key.

Null texts are empty and have no spans. Texts of any length are scanned whole; what is held together is one
document's spans. Null owners, and null repositories, count as one more. Repeated rows are rows of their own, and
ties (spans that begin together) go by kind in the order of ``KINDS``. Other columns are ignored, whatever their names. An
empty table gives no rows. Positions are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalmill.llm.scratch import materialise

#: Kinds of spans in the order of reports.
KINDS = ("assign", "access", "hex", "owned")
_KEYWORDS = "(?i:password|passwd|secret|token|api_?key)"
_VALUE = "[A-Za-z0-9+/_.=-]"
#: Base patterns: fixed values (kind, what is matched leftmost and without overlaps, what a match must look like).
BASE = (
    ("assign", rf"""({_KEYWORDS})["']?\x20*[:=]\x20*["']?({_VALUE}+)""", rf"""^{_KEYWORDS}["']?\x20*[:=]\x20*["']?{_VALUE}{{6,}}\z"""),
    ("access", "AKIA[A-Z0-9]+", "^.{20,}"),
    ("hex", "[0-9a-f]+", "^.{24,}"),
)
#: Runs shorter than a match may be are kept out of the arrays where that can't move another match.
_SHORT_OUT = {"hex": "[0-9a-f]{24,}", "access": "AKIA[A-Z0-9]{16,}"}
LOOSE_RUN = "[A-Za-z0-9+/_-]{16,}"
LEAST_DIFFERENT = 8
MAX_OWNERS, MAX_REPOSITORIES, BUCKETS = 2, 4, 256


def _matches(text: Column, kind: int, pattern: str) -> Column:
    """Matches of one pattern in a text's order, each with the length of the text between it and the one before."""
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))
    found = F.filter(F.transform(pairs, lambda x: F.struct(F.lit(kind).alias("kind"), F.length(x["gap"]).alias("gap"), x["match"].alias("match"))), lambda x: x["match"].isNotNull())
    return F.when(text.rlike(pattern), found)


def _looks_random(run: Column) -> Column:
    return run.rlike("[A-Za-z]") & run.rlike("[0-9]") & (F.size(F.array_distinct(F.split(run, ""))) >= LEAST_DIFFERENT)


def candidates(docs: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """A row for each match, or one without a match for documents that have none, written once: row, doc_id, owner,
    repository, place, kind, gap, length, value_length, passes, digest."""
    patterns = [_SHORT_OUT.get(kind, pattern) for kind, pattern, _ in BASE] + [LOOSE_RUN]
    text = F.col("text")
    none = F.array().cast("array<struct<kind:int,gap:int,match:string>>")
    every = F.concat(*[F.coalesce(_matches(text, kind, pattern), none) for kind, pattern in enumerate(patterns)])
    # An unknown owner or repository is one of its own, told from every name by the mark before names.
    known = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), known(owner).alias("owner"), known(repository).alias("repository"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    # The place of a match in the array is that in its text, kind by kind.
    flat = rows.select("row", "doc_id", "owner", "repository", F.posexplode_outer(every).alias("place", "found"))
    match, kind = F.col("found.match"), F.col("found.kind")
    value = F.when(kind == 0, F.regexp_extract(match, BASE[0][1], 2)).otherwise(match)
    passes = F.when(kind == len(BASE), _looks_random(match))
    for k, (_, _, must) in enumerate(BASE):
        passes = F.when(kind == k, match.rlike(must)).otherwise(passes)
    flat = flat.select(
        "row", "doc_id", "owner", "repository", "place", kind.alias("kind"), F.col("found.gap").alias("gap"), F.length(match).alias("length"),
        F.length(value).alias("value_length"), passes.alias("passes"), F.when(passes, F.sha2(value, 256)).alias("digest"),
    )
    return materialise(flat, "candidates")


def verdicts(found: DataFrame, max_owners: int, max_repositories: int) -> DataFrame:
    """Whether a value is owned, by digest and bucket of documents: digest, bucket, n_owners, n_repositories, owned."""
    held = found.where("passes").select("digest", bucket().alias("bucket"), "repository", "owner").distinct()
    spread = held.groupBy("digest").agg(F.count_distinct("owner").alias("n_owners"), F.count_distinct("repository").alias("n_repositories"))
    owned = (F.col("n_owners") <= max_owners) & (F.col("n_repositories") <= max_repositories)
    return held.select("digest", "bucket").distinct().join(spread.withColumn("owned", owned), "digest")


def bucket() -> Column:
    return F.pmod(F.xxhash64("row"), F.lit(BUCKETS)).cast("int")


def scan(docs: DataFrame, owner: Column, repository: Column, max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """For each document doc_id, n_assign, n_access, n_hex, n_owned and n_copied (base spans by verdict), and
    ``base`` and ``spans``: arrays of (start, kind, end), kind as its place in ``KINDS``, in order."""
    found = candidates(docs, owner, repository)
    judged = found.withColumn("bucket", bucket()).join(verdicts(found, max_owners, max_repositories), ["digest", "bucket"], "left")
    # Documents are put together once: the running sums and the lists below use the same exchange.
    end = F.sum(F.col("gap") + F.col("length")).over(Window.partitionBy("row", "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    placed = judged.repartition("row").withColumn("end", end).withColumn("start", F.col("end") - F.col("length"))
    ok, base, owned = F.coalesce("passes", F.lit(False)), F.col("kind") < len(BASE), F.coalesce("owned", F.lit(False))
    span = F.struct("start", "kind", "end")
    where = lambda start: F.struct(start.alias("start"), F.col("end"))
    of_kind = lambda k: F.count_if(ok & (F.col("kind") == k)).alias(f"n_{KINDS[k]}")
    per = placed.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), of_kind(0), of_kind(1), of_kind(2), F.count_if(ok & base & owned).alias("n_owned"), F.count_if(ok & base & ~owned).alias("n_copied"),
        F.array_sort(F.collect_list(F.when(ok & base, span))).alias("base"),
        # What base spans report already, whole or as their values.
        F.collect_list(F.when(ok & base, where(F.col("start")))).alias("reported"), F.collect_list(F.when(ok & base, where(F.col("end") - F.col("value_length")))).alias("valued"),
        F.collect_list(F.when(ok & ~base & owned, where(F.col("start")))).alias("loose"),
    )
    added = F.transform(F.array_except("loose", F.concat("reported", "valued")), lambda x: F.struct(x["start"].alias("start"), F.lit(len(BASE)).alias("kind"), x["end"].alias("end")))
    return per.select("doc_id", "n_assign", "n_access", "n_hex", "n_owned", "n_copied", "base", F.array_sort(F.concat("base", added)).alias("spans"))


def as_text(spans: Column | str) -> Column:
    """Spans as kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat(F.get(names, x["kind"]), F.lit(":"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string"))), ",")
